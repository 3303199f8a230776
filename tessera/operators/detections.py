"""Detections: score threshold, overlap, non-maximum suppression and top-k, per image.

A detection is (img, det_id, cls, score, x1, y1, x2, y2). An image's detections are a bounded group; images are many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.functions.paths import falsy_or
from tessera.sources.files import list_directory, read_binaries

#: The defaults of prediction.
CONFIDENCE, OVERLAP, MOST = 0.25, 0.7, 300
BOX = ("x1", "y1", "x2", "y2")


def threshold(conf: float | None, default: float = CONFIDENCE) -> float:
    """The score threshold in force: none and 0 give the default."""
    return conf or default


def threshold_column(conf: Column, default: Column) -> Column:
    return falsy_or(conf, default)


def above(detections: DataFrame, conf: float | None = None, default: float = CONFIDENCE) -> DataFrame:
    """Detections that score at least the threshold; a comparison with the bare column, which the scan can use."""
    return detections.filter(F.col("score") >= threshold(conf, default))


def iou(a: dict[str, Column] | Column, b: dict[str, Column] | Column) -> Column:
    """Intersection over union of two boxes; null where both have no area."""
    wide = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    high = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    return wide * high / F.nullif(area(a) + area(b) - wide * high, F.lit(0.0))


def overlapping(detections: DataFrame, least: float = OVERLAP, agnostic: bool = False) -> DataFrame:
    """(img, id_a, id_b, iou) of pairs of one image (and class) that overlap more than `least`: an equi-join on them."""
    keys = ["img"] if agnostic else ["img", "cls"]
    a, b = detections.alias("a"), detections.alias("b")
    on = F.col("a.det_id") < F.col("b.det_id")
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    value = iou({k: F.col(f"a.{k}") for k in BOX}, {k: F.col(f"b.{k}") for k in BOX})
    return a.join(b, on).select(F.col("a.img").alias("img"), F.col("a.det_id").alias("id_a"), F.col("b.det_id").alias("id_b"), value.alias("iou")).filter(F.col("iou") > least)


def suppress(detections: DataFrame, least: float = OVERLAP, agnostic: bool = False) -> DataFrame:
    """Greedy suppression: by falling score (ties by det_id) a detection stays unless one that stays overlaps it more
    than `least`. One shuffle by image and class, then a fold over each group's sorted array."""
    keys = ["img"] if agnostic else ["img", "cls"]
    rest = [c for c in detections.columns if c not in keys]
    one = F.struct((-F.col("score")).alias("rank"), "det_id", *[c for c in rest if c != "det_id"])
    groups = detections.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("all"))
    kind = groups.schema["all"].dataType.simpleString()
    kept = F.aggregate("all", F.array().cast(kind), lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) > F.lit(least)), acc).otherwise(F.array_append(acc, b)))
    out = groups.select(*keys, F.explode(kept).alias("d"))
    return out.select(*[c if c in keys else f"d.{c}" for c in detections.columns])


def top(detections: DataFrame, most: int = MOST) -> DataFrame:
    """At most `most` detections of each image, by falling score, ties by det_id; with their rank."""
    w = Window.partitionBy("img").orderBy(F.desc("score"), "det_id")
    return detections.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= most)


def predict(images: DataFrame, model: Callable[[bytes], list[tuple[str, float, float, float, float, float]]], conf: float | None = None, img_type: str = "string", **options) -> DataFrame:
    """Post-processed detections of images (img, content): `model` gives (cls, score, x1, y1, x2, y2) of one image, and
    numbers follow its order. A null content has no detections. The model travels to the executors once a task."""

    def f(batches):
        import pandas as pd

        for b in batches:
            rows = [(i, k, *d) for i, c in zip(b["img"], b["content"]) if c is not None for k, d in enumerate(model(bytes(c)))]
            yield pd.DataFrame(rows, columns=["img", "det_id", "cls", "score", *BOX])

    schema = f"img {img_type}, det_id bigint, cls string, score double, x1 double, y1 double, x2 double, y2 double"
    return postprocess(images.select(F.col("img").cast(img_type), F.col("content").cast("binary")).mapInPandas(f, schema), conf, **options)


def predict_folder(spark: SparkSession, folder: str, model, save_dir: str | None = None, conf: float | None = None, name: str = "predictions", **options) -> DataFrame:
    """predict() over all files of a folder, saved as Parquet under save_dir/name if a folder is given. A source that
    doesn't exist is an error."""
    if list_directory(spark, folder) is None:
        raise FileNotFoundError(f"source not found: {folder}")
    out = predict(read_binaries(spark, folder).select(F.col("path").alias("img"), "content"), model, conf, **options)
    if save_dir is None:
        return out
    out.write.mode("overwrite").parquet(f"{save_dir}/{name}")
    return spark.read.parquet(f"{save_dir}/{name}")


def postprocess(detections: DataFrame, conf: float | None = None, least: float = OVERLAP, most: int = MOST, agnostic: bool = False) -> DataFrame:
    """Threshold, suppression and top-k, as one prediction does."""
    return top(suppress(above(detections, conf), least, agnostic), most)

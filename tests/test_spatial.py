"""Boxes in grids against loops over all pairs."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import detections as det, spatial
from tessera.plans import catalogue

SCHEMA = "img long, det_id long, cls string, score double, x1 double, y1 double, x2 double, y2 double, note string"


def odd_boxes():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        side = 2.0 ** rng.integers(-3, 7) * rng.uniform(0.7, 1.4, 2)
        side, (x, y) = side.tolist(), rng.uniform(-60, 60, 2).tolist()
        rows.append((int(i % 3), i, "ab"[i % 2], round(float(rng.integers(0, 6)) / 5, 1), x, y, x + side[0], y + side[1], "n"))
    rows += [(None, k, None, 0.5, 0.0, 0.0, 8.0, 8.0 + k, None) for k in range(4)]  # no image, no class: a group of its own
    rows += [(7, k, "a", 0.5, 1.0, 1.0, 3.0, 3.0, "same spot") for k in range(50)]
    rows += [(8, 1, "a", None, 0.0, 0.0, 4.0, 4.0, "no score"), (8, 2, "a", 0.9, 0.0, 0.0, 4.0, 4.0, "")]
    rows += [(9, 1, "a", 0.9, 2.0, 2.0, 2.0, 5.0, "no area"), (9, 2, "a", 0.9, 2.0, 2.0, 2.0, 5.0, ""), (9, 3, "a", 0.9, 5.0, 5.0, 1.0, 1.0, "turned"), (9, 4, "a", 0.9, None, 0.0, 1.0, 1.0, "null"), (9, 5, "a", 0.9, 0.0, 0.0, float("inf"), 1.0, "endless")]
    return rows


def test_pairs_and_suppression_of_odd_boxes(spark, monkeypatch):
    df = spark.createDataFrame(odd_boxes(), SCHEMA)
    finite = df.filter("img IS NOT NULL AND NOT (x2 = double('inf'))")
    rounded = lambda x: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in x.collect())
    for least, agnostic in ((0.3, False), (0.7, True), (0.05, True)):
        assert rounded(spatial.overlapping_by_space(finite, least, agnostic)) == rounded(det.overlapping(finite, least, agnostic))
    key = lambda x: sorted(map(str, x.collect()))
    for least, agnostic, few in ((0.3, False, 256), (0.7, True, 5)):
        monkeypatch.setattr(spatial, "FEW", few)
        got = spatial.suppress_by_rounds(df, least, agnostic)
        assert got.columns == df.columns
        assert key(got) == key(det.suppress(df, least, agnostic).select(df.columns))
    assert key(spatial.suppress_by_rounds(df, 0.0)) == key(det.suppress(df, 0.0).select(df.columns))
    assert spatial.suppress_by_rounds(df.limit(0), 0.5).count() == spatial.overlapping_by_space(df.limit(0), 0.5).count() == 0


def test_crowd_equals_a_loop(spark):
    d = catalogue.crowd(spark, "/root/testdata/sf0.001").toPandas().sort_values(["score", "det_id"], ascending=[False, True])
    want = []
    for _, part in d.groupby("cls"):
        box, left = part[["x1", "y1", "x2", "y2"]].to_numpy(), np.ones(len(part), bool)
        area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        for k in range(len(part)):
            if left[k]:
                want.append(part["det_id"].iloc[k])
                both = np.clip(np.minimum(box[:, 2:], box[k, 2:]) - np.maximum(box[:, :2], box[k, :2]), 0, None).prod(1)
                left &= ~(both / (area + area[k] - both) > 0.3)
    assert sorted(r["det_id"] for r in catalogue.det_nms_crowd(spark, "/root/testdata/sf0.001").collect()) == sorted(want)


def test_no_task_holds_an_image(spark):
    d = catalogue.crowd(spark, "/root/testdata/sf0.01")
    cells = spatial._entered(d, ["img", "cls"], 0.3, ["det_id"])
    most = cells.groupBy(*spatial.CELL).count().agg(F.max("count")).first()[0]
    assert d.select("img").distinct().count() == 1 and most < d.count() / 20


def no_cells(*_):
    raise AssertionError("a small image went to cells")


def test_small_images_are_folded_whole(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_entered", no_cells)
    df = spark.createDataFrame(odd_boxes(), SCHEMA)
    key = lambda x: sorted(map(str, x.collect()))
    assert key(spatial.suppress_by_rounds(df, 0.3)) == key(det.suppress(df, 0.3).select(df.columns))


def test_crowd_in_batches_of_ranks(spark, monkeypatch):
    d = catalogue.crowd(spark, "/root/testdata/sf0.001").filter("score >= 0.5").withColumn("img", F.expr("nullif(img, 0)"))
    key = lambda x: sorted(map(str, x.collect()))
    want = key(det.suppress(d, 0.3).select(d.columns))
    seen, rounds, beaten = [], spatial._rounds, spatial._beaten
    monkeypatch.setattr(spatial, "_rounds", lambda *x: seen.append("rounds") or rounds(*x))
    monkeypatch.setattr(spatial, "_beaten", lambda *x: seen.append("batch") or beaten(*x))
    monkeypatch.setattr(spatial, "PART", 300)
    assert key(spatial.suppress_by_rounds(d, 0.3)) == want
    assert seen.count("batch") == 3 and "rounds" not in seen
    monkeypatch.setattr(spatial, "FEW", 20)
    monkeypatch.setattr(spatial, "PART", 60)
    monkeypatch.setattr(spatial, "EDGES", 3)  # batches are made smaller, and parts that still have too many go by rounds
    boxes = spark.createDataFrame([r for r in odd_boxes() if r[0] in (0, 7)], SCHEMA)
    assert key(spatial.suppress_by_rounds(boxes, 0.3)) == key(det.suppress(boxes, 0.3).select(boxes.columns))
    assert "rounds" in seen


def test_small_images_are_paired_whole(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_entered", no_cells)
    df = spark.createDataFrame(odd_boxes(), SCHEMA).filter("NOT (x2 = double('inf'))")
    rounded = lambda x: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in x.collect())
    assert rounded(spatial.overlapping_by_space(df, 0.3)) == rounded(det.overlapping(df, 0.3))


def test_images_without_a_number_pair_nothing(spark):
    df = spark.createDataFrame([r for r in odd_boxes() if r[0] is None], SCHEMA)
    assert spatial.overlapping_by_space(df, 0.3).count() == det.overlapping(df, 0.3).count() == 0


def test_crowd_is_decided_in_few_tables(spark, monkeypatch):
    names, settled = [], spatial.settled
    monkeypatch.setattr(spatial, "settled", lambda df, name: names.append(name) or settled(df, name))
    crowd = catalogue.crowd(spark, "/root/testdata/sf0.01")  # 60,000 boxes: two batches and eleven tables before
    spatial.suppress_by_rounds(crowd, 0.3)
    assert len(names) <= 6 and "pairs" not in names


def test_chains_over_tiles_and_sizes(spark, monkeypatch):
    n, rng = 400, np.random.default_rng(3)
    rows = [(1, k, "a", 1 - k / n, 4.0 * k, 0.0, 4.0 * k + 8.0, 8.0, "") for k in range(n)]  # each hangs on the one before
    grown = np.cumprod(np.full(25, 1.3)).tolist()
    rows += [(1, n + k, "a", k / 100, -s, -s, 0.0, 0.0, "") for k, s in enumerate(grown)]  # over several bands
    x, y, side = rng.uniform(0, 60, (2, 600)).tolist() + [rng.uniform(1, 9, 600).tolist()]
    rows += [(1, 2 * n + k, "a", float(k % 7), x[k], y[k] + 100, x[k] + side[k], y[k] + 100 + side[k], "") for k in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    turns, tiles = [], spatial._tiles
    monkeypatch.setattr(spatial, "_tiles", lambda *a, **b: turns.append(a[3] if len(a) > 3 else 0) or tiles(*a, **b))
    monkeypatch.setattr(spatial, "_rounds", no_cells)
    key = lambda x: sorted(map(str, x.collect()))
    assert key(spatial.suppress_by_rounds(df, 0.3)) == key(det.suppress(df, 0.3).select(df.columns))
    assert 1 < max(turns) < 8

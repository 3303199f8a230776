"""Configuration profiles in YAML: section -> key -> scalar, read as JSON so that types survive."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

SECTIONS = "map<string,map<string,string>>"


def yaml_documents(spark: SparkSession, path: str, schema: str = "file string, document string") -> DataFrame:
    """(file, document as JSON text, null for an empty file) of YAML files. Parsed by PyYAML, whose typing is kept."""

    def parse(batches):
        import yaml

        for b in batches:
            b["document"] = [None if (d := yaml.safe_load(bytes(c))) is None else json.dumps(d, default=str) for c in b.pop("content")]
            yield b[["file", "document"]]

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    empty = spark.createDataFrame([(x,) for x in _empty_files(spark, path)], "file string").withColumn("document", F.lit(None).cast("string"))
    return files.mapInPandas(parse, schema).union(empty)


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files without a byte, which Spark's scans leave out; from the store's listing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for g in fs.globStatus(at) or [] for s in ([g] if g.isFile() else fs.listStatus(g.getPath()))]
    return [s.getPath().toString() for s in found if s.isFile() and not s.getLen() and not s.getPath().getName().startswith(("_", "."))]


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(profile_name, sections map<string,map<string,string>>); profile_name is the file's name without its ending.

    A key with a null value is present with null, a blank section is present with a null map, an empty file has null
    sections. Scalars keep their JSON spelling without the quotes of strings.
    """
    d = yaml_documents(spark, path)
    return d.select(F.regexp_extract("file", r"([^/]+)\.ya?ml$", 1).alias("profile_name"), F.from_json("document", SECTIONS).alias("sections"))


def write_snapshot(settings: DataFrame, path: str) -> None:
    """Overwrite a folder with (profile_name, document): one YAML document a profile, from section -> key -> JSON value."""

    def dump(batches):
        import yaml

        for b in batches:
            b["document"] = [yaml.safe_dump(json.loads(d), sort_keys=False) for d in b["document"]]
            yield b

    settings.mapInPandas(dump, "profile_name string, document string").write.mode("overwrite").partitionBy("profile_name").option("lineSep", "\n").text(path)

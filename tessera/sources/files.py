"""Files: listings, whole texts, binaries, and text output. Listings use the store's own API, so any store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def list_directory(spark: SparkSession, path: str) -> DataFrame | None:
    """(name, is_dir) of a folder's entries, empty folders too; None if the folder doesn't exist."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    return spark.createDataFrame([(s.getPath().getName(), bool(s.isDirectory())) for s in fs.listStatus(at)], "name string, is_dir boolean")


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, value): one row a file, whole."""
    r = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return r.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_binaries(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files, such as images, documents and checkpoints."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def with_split(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Add kind and split of a dataset tree: .../<images|labels>/<train|val>/<file>."""
    parts = F.split(F.col(path_col), "/")
    n = F.size(parts)
    at = lambda k: F.when(n > k, F.element_at(parts, -(k + 1)))
    return files.withColumns({"kind": F.when(at(2).isin("images", "labels"), at(2)), "split": F.when(at(2).isin("images", "labels"), at(1))})


def write_text(df: DataFrame, path: str) -> None:
    """Overwrite a folder with one string column, as text."""
    df.write.mode("overwrite").text(path)


def read_descriptor(spark: SparkSession, path: str) -> DataFrame:
    """(path, train, val, names map<int,string>) of dataset descriptors in YAML."""
    from tessera.sources.profiles import yaml_documents

    d = yaml_documents(spark, path, "file string, document string").select(F.from_json("document", "path string, train string, val string, names map<string,string>").alias("d"))
    return d.select("d.path", "d.train", "d.val", F.transform_keys("d.names", lambda k, _: k.try_cast("int")).alias("names"))

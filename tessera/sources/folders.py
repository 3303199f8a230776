"""A folder's listing as a source: one partition for each subfolder, with filters on folder and name taken along.

    list_folders(spark, path).filter("folder IN ('train', 'val') AND endswith(name, '.txt')")

Equality and IN on `folder` leave out whole subfolders before anything in them is listed; beginnings and ends of `name`
are looked at where a subfolder is listed. Only the top folder is listed on the driver. Hidden files (`_` and `.`) count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from tessera.sources.stores import store_of

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Tests of a name by the kind of a filter.
BY_NAME = {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__, EqualTo: str.__eq__}


@dataclass
class Subfolder(InputPartition):
    """A subfolder to list in full, or the top folder's own entries."""

    path: str
    folder: str


class FolderSource(DataSource):
    """Option: path. A path that doesn't exist gives no rows."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return "folder string, name string, path string, is_dir boolean, length long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options["path"])


class FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.folders, self.names = path, None, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what is known here; the rest goes back to Spark."""
        for f in filters:
            on = getattr(f, "attribute", None)  # a negation has none
            if on == ("folder",) and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.folders = some if self.folders is None else self.folders & some
            elif on == ("name",) and type(f) in BY_NAME:
                self.names.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Subfolder]:
        from pyarrow import fs

        store, root = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        folders = ["", *(f.base_name for f in found if f.type == fs.FileType.Directory)]
        return [Subfolder(root, f) for f in sorted(folders) if self.folders is None or f in self.folders]

    def read(self, partition: Subfolder | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # what Spark gives where no partition is planned
            return
        store, _ = store_of(self.path)
        at = f"{partition.path}/{partition.folder}" if partition.folder else partition.path
        for f in store.get_file_info(fs.FileSelector(at, recursive=bool(partition.folder), allow_not_found=True)):
            if all(BY_NAME[kind](f.base_name, value) for kind, value in self.names):
                yield partition.folder, f.base_name, f.path, f.type == fs.FileType.Directory, None if f.size is None else int(f.size)


def list_folders(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, path, is_dir, length) of all entries below a folder; folder is the subfolder of `path`, empty for
    entries of `path` itself."""
    spark.dataSource.register(FolderSource)
    spark.conf.set(PUSHDOWN, "true")  # without it Spark refuses a source that takes filters
    return spark.read.format("folders").option("path", path).load()

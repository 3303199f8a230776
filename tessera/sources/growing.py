"""A growing table as an unbounded source: Parquet files of a folder whose rows are numbered by a key that only rises.

    read_growing(spark, folder, "event_id", "event_id long, value double", checkpoint, keys_a_batch=1_000_000)

An offset is the key of the next row, so a batch is a range of keys: run again after a failure it has the same rows, and a
restart goes on after the last batch. Rows that come later must have larger keys; a key is a whole number, not null.
Files are read by their own store (pyarrow's file systems: local, hdfs, s3, ...), a partition for each row group in the range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tessera.sources.stores import store_of

LEAST = -(1 << 63)


@dataclass
class Piece(InputPartition):
    """Row group `group` of a file, rows with low <= key < high."""

    file: str
    group: int
    low: int
    high: int


def read_growing(spark: SparkSession, path: str, key: str, schema: StructType | str, checkpoint: str | None = None, keys_a_batch: int = 0) -> DataFrame:
    """The stream of a growing table. With keys_a_batch a batch spans at most so many keys; as Spark doesn't tell a source
    where a query goes on, that is read from the query's checkpoint folder."""
    spark.dataSource.register(GrowingTable)
    r = spark.readStream.format("growing").schema(schema).option("path", path).option("key", key)
    if keys_a_batch:
        if checkpoint is None:
            raise ValueError("batches can be bounded only with the checkpoint folder of the query")
        r = r.option("keys_a_batch", keys_a_batch).option("resume_at", _planned(spark, checkpoint))
    return r.load()


def _planned(spark: SparkSession, checkpoint: str) -> int:
    """The end of the last batch that a query has planned (one that isn't committed is run again before others)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = [int(n) for s in (fs.listStatus(at) if fs.exists(at) else []) if (n := s.getPath().getName()).isdigit()]
    if not numbers:
        return LEAST
    lines = spark.read.text(f"{checkpoint}/offsets/{max(numbers)}").filter("value LIKE '{\"next\"%'").collect()
    return json.loads(lines[0]["value"])["next"] if lines else LEAST


class GrowingTable(DataSource):
    """Options: path, key, keys_a_batch (0: no bound) and resume_at, from which the bound counts in the first batch."""

    @classmethod
    def name(cls) -> str:
        return "growing"

    def schema(self) -> str:
        raise ValueError("give the schema of the table")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"], self.options["key"], int(self.options.get("keys_a_batch", "0")), schema, int(self.options.get("resume_at", LEAST)))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, key: str, most: int, schema: StructType, at: int = LEAST):
        self.path, self.key, self.most, self.schema = path, key, most, schema
        self.ranges: dict[str, list[tuple[int, int]]] = {}  # of files that still matter, by row group
        self.at = at

    def _look(self) -> None:
        """Read the footers of files that are new."""
        from pyarrow import fs, parquet

        store, root = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if store.get_file_info(root).type != fs.FileType.File else [store.get_file_info(root)]
        for f in found:
            if f.type != fs.FileType.File or not f.base_name.endswith(".parquet") or f.base_name.startswith(("_", ".")) or "/_temporary/" in f.path or f.path in self.ranges:
                continue
            with parquet.ParquetFile(store.open_input_file(f.path)) as file:
                column, groups = file.schema_arrow.names.index(self.key), []
                for g in range(file.metadata.num_row_groups):
                    seen = file.metadata.row_group(g).column(column).statistics
                    if seen is None or not seen.has_min_max:  # no statistics: the column itself
                        keys = file.read_row_group(g, [self.key]).column(0)
                        groups.append((min(keys.to_pylist(), default=0), max(keys.to_pylist(), default=LEAST)))
                    else:
                        groups.append((seen.min, seen.max))
                self.ranges[f.path] = groups

    def initialOffset(self) -> dict:
        return {"next": LEAST}

    def latestOffset(self) -> dict:
        self._look()
        every = [r for groups in self.ranges.values() for r in groups]
        end = max((high + 1 for _, high in every), default=self.at)
        if self.most and every:
            end = min(end, max(self.at, min(low for low, _ in every)) + self.most)
        return {"next": max(end, self.at)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self._look()
        low, high, self.at = start["next"], end["next"], end["next"]
        return [Piece(f, g, low, high) for f, groups in sorted(self.ranges.items()) for g, (a, b) in enumerate(groups) if a < high and b >= low]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        from pyarrow import compute, parquet
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted, (store, _) = to_arrow_schema(self.schema), store_of(self.path)
        with parquet.ParquetFile(store.open_input_file(partition.file)) as file:
            for b in file.iter_batches(row_groups=[partition.group], columns=list(dict.fromkeys([*wanted.names, self.key]))):
                k = b.column(self.key)
                b = b.filter(compute.and_(compute.greater_equal(k, partition.low), compute.less(k, partition.high)))
                yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in wanted], schema=wanted)

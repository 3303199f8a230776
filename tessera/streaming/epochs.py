"""A hook that acts at every n-th epoch of each source, with the epochs kept as state between batches and runs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EveryNth(StatefulProcessor):
    """Numbers the rows of a key from 0 in the order of a column; rows whose number is a multiple of `every` come out.

    Of a key's rows in one batch only that column is held (8 bytes a row); the state is one number.
    """

    def __init__(self, key: str, order: str, every: int):
        self.key, self.order, self.every = key, order, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.epoch = handle.getValueState("epoch", "epoch long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order = np.sort(np.concatenate([r[self.order].to_numpy() for r in rows]))
        first = self.epoch.get()[0] if self.epoch.exists() else 0
        at = np.arange(-first % self.every, len(order), self.every)
        self.epoch.update((first + len(order),))
        yield pd.DataFrame({self.key: np.full(len(at), key[0]), self.order: order[at], "epoch": first + at})

    def close(self) -> None:
        pass


def every_nth(stream: DataFrame, key: str, order: str, every: int) -> DataFrame:
    """(key, order, epoch) of every n-th row of each key of a stream whose batches follow `order`, 0 among them. A null key
    or order number has no epoch. A period of 0 is an error."""
    if every < 1:
        raise ZeroDivisionError("the period is below 1")
    rows = stream.select(stream[key].cast("long").alias(key), stream[order].cast("long").alias(order)).dropna()
    return rows.groupBy(key).transformWithStateInPandas(EveryNth(key, order, every), f"`{key}` long, `{order}` long, epoch long", "Append", "None")


@contextmanager
def rocks(spark: SparkSession):
    """State that transformWithState needs, for queries started meanwhile."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)

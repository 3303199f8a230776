"""Exact dedup: two passes over a Bloom filter; only rows whose hash may repeat are shuffled.

Pass one counts hashed bits of every text's hash in a filter of bounded size (`bits.count_bits`). Pass two tests each
row against it: rows whose hash can't repeat pass straight through, the rest are grouped by their SHA-256.

Defined results: a null text counts as empty; a null id loses ties; rows that repeat one id and text are one group, of
which one row stays; an empty frame gives an empty frame; extra columns are carried by `drop_copies` and ignored by
`exact_dedup`; names that clash with the ones made here don't matter as those are made in frames of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm import bits as B
from tessera.llm._common import U64, settle


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \x09-\x0D]+", "")


def hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sha, chars, part of the hash as long) of every row."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.sha2(normalised(text).cast("binary"), 256).alias("sha"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"))


def _head(sha: Column) -> Column:
    """64 bits of the hex hash as a signed long."""
    return F.xxhash64(sha)


def _maybe_repeated(df: DataFrame, sha: str, filled, bits: int) -> DataFrame:
    """Add the column maybe: whether the filter allows that the hash repeats."""

    @F.pandas_udf("boolean")
    def test(h):
        import pandas as pd

        return pd.Series(B.contains(filled.value, h.to_numpy(np.int64).view(U64), bits))

    return df.withColumn("maybe", test(_head(F.col(sha))))


def find_repeated(rows: DataFrame, max_bits: int = B.MAX_BITS):
    """The broadcast filter of the hashes seen twice or more, and its size in bits."""
    bits = B.bits_for(rows.count(), max_bits)
    _, two = B.count_bits(rows.select(_head(F.col("sha"))), bits)
    return rows.sparkSession.sparkContext.broadcast(two), bits


def _winners(maybe: DataFrame) -> DataFrame:
    """(sha, best, group_size) of possibly repeated rows; a hot hash is aggregated before the shuffle."""
    return maybe.groupBy("sha").agg(F.min(F.struct(-F.col("chars"), F.col("id").isNull(), "id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = B.MAX_BITS) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256, passed_through."""
    rows = settle(hashed(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "hashes")
    filled, bits = find_repeated(rows, max_bits)
    tested = _maybe_repeated(rows, "sha", filled, bits)
    alone = tested.filter(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), F.lit(True).alias("passed_through"))
    maybe = tested.filter("maybe").drop("maybe")
    # winners are a table of their own, so that AQE can split the join's rows of one very frequent hash
    met = maybe.join(settle(_winners(maybe), "winners"), "sha").select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"), F.lit(False).alias("passed_through"))
    return alone.unionByName(met).withColumnRenamed("id", id_col)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = B.MAX_BITS) -> DataFrame:
    """The rows of df that stay, with their columns. Rows that can't repeat never leave their partition.

    Rows that may repeat meet the winner of their hash by (hash, id, length), so that copies of one text spread over
    partitions; of rows that are equal in all three the first stays.
    """
    rows = settle(hashed(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "hashes")
    filled, bits = find_repeated(rows, max_bits)
    best = _winners(_maybe_repeated(rows, "sha", filled, bits).filter("maybe")).select("sha", "best.id", (-F.col("best.col1")).alias("chars"))
    held = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("held"))
    text = F.col("held").getField(text_col).cast("string")
    held = held.select("held", F.sha2(normalised(text).cast("binary"), 256).alias("sha"))
    tested = _maybe_repeated(held, "sha", filled, bits)
    alone = tested.filter(~F.col("maybe")).select("held.*")
    mine = tested.filter("maybe").select("held", "sha", F.col("held").getField(id_col).cast("long").alias("id"), F.coalesce(F.length(F.col("held").getField(text_col).cast("string")), F.lit(0)).cast("long").alias("chars"))
    a, b = mine.alias("a"), best.alias("b")
    won = a.join(b, (F.col("a.sha") == F.col("b.sha")) & F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.chars") == F.col("b.chars")), "left_semi")
    return alone.unionByName(won.groupBy("sha").agg(F.first("held").alias("held")).select("held.*"))

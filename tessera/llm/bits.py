"""Bit arrays of hashes that are counted in a distributed way: seen once, seen twice or more.

A mergeable two-bit counting filter. Its size is bounded by `max_bits`, whatever the input; beyond that only more
rows count as possibly repeated, and results stay exact because a filter never misses a repeated hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import U64, mix, settle

SLICE = 1 << 20
#: 32 MB for each of the two bits: what the driver gathers and broadcasts at most.
MAX_BITS = 1 << 28
HASHES = 3


def bits_for(n: int, max_bits: int = MAX_BITS) -> int:
    """A power of two of about 16 bits a row, within the bound."""
    return int(min(max_bits, max(1 << 16, 1 << int(16 * max(n, 1) - 1).bit_length())))


def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    a, b = mix(h), mix(h ^ U64(0xD6E8FEB86659FD93)) | U64(1)
    return [(a + U64(k) * b) & U64(bits - 1) for k in range(HASHES)]


def contains(filled: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether all bits of each hash are set in a packed array."""
    out = np.ones(len(h), bool)
    for p in positions(h, bits):
        out &= (filled[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8)) & 1 == 1
    return out


def count_bits(hashes: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits (seen, seen twice or more) of a frame with one long column; nulls are left out.

    Each batch sends a position once for each time, up to twice; positions meet by slice of the array, not by key,
    so a hash that a third of all rows share adds two positions a batch.
    """
    width = min(SLICE, bits)

    def spread(batches):
        for b in batches:
            h = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            # the distinct hashes of a batch count their bits once, the repeated ones once more
            once, n = np.unique(h, return_counts=True)
            sets = [np.unique(np.stack(positions(x, bits)), axis=1) if len(x) else np.zeros((HASHES, 0), U64) for x in (once, once[n > 1])]
            p = np.concatenate([s.ravel() for s in sets])
            if len(p):
                p = np.sort(p)
                keep = np.ones(len(p), bool)
                keep[2:] = p[2:] != p[:-2]  # a position counts up to two
                p = p[keep]
                at, first = np.unique(p // U64(width), return_index=True)
                parts = np.split((p % U64(width)).astype(np.int32), first[1:])
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "at"])

    def meet(t: pa.Table) -> pa.Table:
        n = np.zeros(width, np.uint8)
        for x in t.column("at"):
            p = np.frombuffer(x.as_py(), np.int32)
            d, k = np.unique(p, return_counts=True)
            n[d] = np.minimum(2, n[d] + np.minimum(k, 2).astype(np.uint8))
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "one": pa.array([np.packbits(n >= 1, bitorder="little").tobytes()], pa.binary()), "two": pa.array([np.packbits(n >= 2, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((2, bits // 8), np.uint8)
    found = hashes.mapInArrow(spread, "slice int, at binary").groupBy("slice").applyInArrow(meet, "slice int, one binary, two binary")
    for r in found.toLocalIterator():  # one slice for each 2**20 bits, bounded by max_bits
        at = slice(r["slice"] * width // 8, (r["slice"] + 1) * width // 8)
        out[0, at], out[1, at] = np.frombuffer(r["one"], np.uint8), np.frombuffer(r["two"], np.uint8)
    return out[0], out[1]


def without_ids(df: DataFrame, drop: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose id isn't among those of drop (one long column without nulls); null ids stay.

    Rows whose id isn't in a bounded filter of the dropped ids never leave their partition; only the others meet the
    table of ids, so texts that stay aren't shuffled.
    """
    drop = settle(drop.toDF("__drop").distinct(), "drop")
    bits = bits_for(drop.count())
    filled = df.sparkSession.sparkContext.broadcast(count_bits(drop, bits)[0])

    @F.pandas_udf("boolean")
    def maybe(ids):
        import pandas as pd

        return pd.Series(contains(filled.value, ids.fillna(0).to_numpy(np.int64).view(U64), bits) & ids.notna().to_numpy())

    own = df[f"`{id_col}`"].cast("long")
    tested = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("held"), own.alias("id"), maybe(own).alias("maybe"))
    rest = tested.filter("maybe").join(drop, F.col("id") == F.col("__drop"), "left_anti")
    return tested.filter("not maybe").select("held.*").unionByName(rest.select("held.*"))

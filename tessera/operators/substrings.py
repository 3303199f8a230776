"""Many substrings in one pass over texts: an automaton of all patterns reads each text once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Patterns and characters of one automaton (some 100 bytes a character in each Python worker); more take more passes.
MOST_PATTERNS, MOST_CHARS = 50_000, 2_000_000


def _blocks(patterns: list[str]):
    """Runs of patterns within the bounds; a longer pattern comes alone."""
    held, n = [], 0
    for p in patterns:
        if held and (len(held) >= MOST_PATTERNS or n + len(p) > MOST_CHARS):
            yield held
            held, n = [], 0
        held.append(p)
        n += len(p)
    if held:
        yield held


def containing(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, pattern_col: str) -> DataFrame:
    """(id, pattern) once for each text and distinct pattern that it contains, as `contains` tells: the empty pattern is in
    each text; null texts and patterns are in nothing and contain nothing. Rows that repeat an id each give their own.

    Patterns come from the store in blocks, each of which becomes one automaton for one pass over the texts; the texts
    themselves are never shuffled.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    wanted = patterns.select(F.col(pattern_col).alias("pattern")).dropna().distinct()
    out = rows.filter(F.lit(not wanted.filter("pattern = ''").isEmpty())).select("id", F.lit("").alias("pattern"))
    kind = rows.schema["id"].dataType.simpleString()
    for block in _blocks([r["pattern"] for r in wanted.filter("pattern <> ''").orderBy("pattern").toLocalIterator()]):
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def f(batches, shared=shared):
            import ahocorasick

            found = ahocorasick.Automaton()
            for k, p in enumerate(shared.value):
                found.add_word(p, k)
            found.make_automaton()
            for b in batches:
                at, which = [], []
                for i, text in enumerate(b.column("text")):
                    seen = {k for _, k in found.iter(text.as_py())}
                    at += [i] * len(seen)
                    which += [shared.value[k] for k in seen]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(which, pa.string())], ["id", "pattern"])

        out = out.union(rows.mapInArrow(f, f"id {kind}, pattern string"))
    return out.toDF(id_col, pattern_col)

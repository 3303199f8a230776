"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source set the cutoffs.

One scan measures every text. The measures of texts that pass the base rule go into log-bucket sketches: a bucket's
count for (language, source, measure). Counts add up, so sketches merge exactly and in any order, whatever the
partitions; a quantile's relative error is at most (GAMMA - 1) / 2. Groups with fewer than `least` rows use the merged
sketch of their language, or of everything. The cutoffs then meet the measured rows in a join. A spread is the quartile
range, but never less than the measure's floor in MEASURES; where most values are 0 or alike the floor sets the cutoff.

Defined results: a null or empty text has no words and fails the base rule; null languages and sources are groups like
others; rows that repeat an id are each judged; an empty frame gives an empty frame; extra columns are ignored by
`judge` and carried by `keep_good`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm._common import U64, chunks, mix, settle, windows, words
from tessera.llm.bits import without_ids

GAMMA = 1.02
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: measure -> (least spread, whether a low value is judged too). A cutoff lies `reach` spreads beyond the quartile.
MEASURES = {"mean_word_chars": (0.5, True), "symbols_per_word": (0.04, False), "dup_line_share": (0.15, False)}
REACH = 3.0
LEAST_ROWS = 100
#: The bucket of values too small to tell from 0.
ZERO = -100_000


def measured(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row."""
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True

    def per_row(marks, offsets):
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def f(batches):
        for b in batches:
            out = np.zeros((6, b.num_rows), np.int64)
            for first, offsets, data in chunks(b.column(3)):
                start, end, row, h = words(offsets, data)
                n = len(offsets) - 1
                at = slice(first, first + n)
                out[0, at] = np.bincount(row, minlength=n)
                inside = np.zeros(len(data) + 1, np.int8)
                inside[start] += 1
                np.add.at(inside, end, -1)
                out[1, at] = per_row((np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80), offsets)
                out[2, at] = per_row(symbol[data], offsets)
                text = data.tobytes()
                for i in range(n):
                    lines = [x for x in text[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
                    out[3, first + i], out[4, first + i] = len(lines), len(lines) - len(set(lines))
                where, g = windows(row, h, 3)
                if len(where):
                    _, back, many = np.unique(mix(g ^ mix(row[where].astype(U64))), return_inverse=True, return_counts=True)
                    where = where[many[back] > 1]
                    again = np.zeros(len(row), bool)
                    for k in range(3):
                        again[where + k] = True
                    out[5, at] = np.bincount(row[again], minlength=n)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, out)], names)

    names = ["id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    cols = df.select(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))
    return cols.mapInArrow(f, "id long, lang string, source string, " + ", ".join(f"{x} long" for x in names[3:]))


def with_measures(rows: DataFrame) -> DataFrame:
    """Add the base rule and the measures that cutoffs adapt to."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return rows.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "mean_word_chars": F.col("word_chars").cast("double") / n,
        "symbols_per_word": F.col("n_symbols").cast("double") / n,
        "dup_line_share": F.col("n_dup_lines").cast("double") / F.greatest("n_lines", F.lit(1)).cast("double"),
    })


def bucket(value: Column) -> Column:
    return F.when(value > 1e-9, F.ceil(F.log(value) / F.lit(math.log(GAMMA))).cast("int")).otherwise(F.lit(ZERO))


def sketch(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): counts, aggregated before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in measures]))
    return rows.select(*keys, pairs.alias("p")).groupBy(*keys, "p.measure", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of coarser groups."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """(keys, measure, rows, one column for each quantile). A group has as many rows as buckets, a bounded number."""
    w = Window.partitionBy(*keys, "measure")
    c = sketches.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("rows", F.sum("n").over(w))
    rank = lambda q: F.floor(F.lit(q) * (F.col("rows") - 1)) + 1
    least = [F.min(F.when(F.col("upto") >= rank(q), F.col("bucket"))).alias(k) for k, q in at.items()]
    value = lambda b: F.when(F.col(b) == ZERO, F.lit(0.0)).otherwise(F.lit(2 / (GAMMA + 1)) * F.pow(F.lit(GAMMA), F.col(b)))
    return c.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), *least).withColumns({k: value(k) for k in at})


def cutoffs(rows: DataFrame, least: int = LEAST_ROWS, reach: float = REACH) -> DataFrame:
    """(lang, source, bounds): for every group its cutoffs by measure, from the finest sketch with enough rows."""
    fine = settle(sketch(rows.filter("not base_failed"), ["lang", "source"], list(MEASURES)), "sketch")
    groups = rows.select("lang", "source").distinct()
    out = None
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        q = quantiles(merge(fine, keys), keys, {"q1": 0.25, "q3": 0.75}).filter(F.col("rows") >= (least if keys else 0))
        spread = F.greatest(F.col("q3") - F.col("q1"), F.coalesce(*[F.when(F.col("measure") == m, F.lit(s)) for m, (s, _) in MEASURES.items()]))
        low = F.when(F.col("measure").isin(*[m for m, (_, both) in MEASURES.items() if both]), F.col("q1") - reach * spread)
        q = q.select(*keys, F.struct(F.lit(level).alias("level"), "measure", low.alias("low"), (F.col("q3") + reach * spread).alias("high")).alias("bound"))
        if keys:
            g, r = groups.alias("g"), q.alias("r")
            on = [F.col(f"g.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
            q = g.join(r, on[0] if len(on) == 1 else on[0] & on[1]).select("g.lang", "g.source", "r.bound")
        else:  # one row for each measure goes to the driver, and from there to every group
            rest = [F.struct(F.lit(level).alias("level"), F.lit(r["measure"]).alias("measure"), F.lit(r["low"]).cast("double").alias("low"), F.lit(r["high"]).cast("double").alias("high")) for r in q.select("bound.*").collect()]
            if not rest:
                continue
            q = groups.select("lang", "source", F.explode(F.array(*rest)).alias("bound"))
        out = q if out is None else out.unionByName(q)
    # the finest level of each measure
    best = out.groupBy("lang", "source", "bound.measure").agg(F.min_by("bound", "bound.level").alias("bound"))
    return best.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", "bound"))).alias("bounds"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_ROWS, reach: float = REACH) -> DataFrame:
    """One row for each row of df: id, lang, source, the counts and measures, base_failed, kept."""
    rows = with_measures(settle(measured(df, id_col, text_col, lang_col, source_col), "measures"))
    a, b = rows.alias("a"), cutoffs(rows, least, reach).alias("b")
    met = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    good = ~F.col("a.base_failed")
    for m in MEASURES:
        bound = F.col("b.bounds").getItem(m)
        good &= F.coalesce(F.col(f"a.{m}") <= bound.getField("high"), F.lit(True)) & F.coalesce(F.col(f"a.{m}") >= bound.getField("low"), F.lit(True))
    return met.select("a.*", good.alias("kept")).withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of df whose id has no rejected row, with their columns."""
    return without_ids(df, judge(df, id_col, **options).filter("not kept").select(id_col).filter(F.col(id_col).isNotNull()), id_col)

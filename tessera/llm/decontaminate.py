"""Benchmark decontamination: which words of a document stand in a passage of a benchmark item.

A prefix-filtered set join in built-in functions only. An item's windows (10 words, or all where there are fewer) are sets
of shingles (3 words). A document that holds a window holds all its shingles, so the window's rarest one is a sufficient
prefix: documents meet windows by that one alone. What meets must leave room for the window before and behind (length and
position), and then its words are compared.

Words are what BETWEEN_WORDS doesn't match, of the text with A-Z lower-cased. Null and empty texts have no words. Every row is
a document, repeated rows and ids included; equal texts are worked on once after the scan. Items without words have no
windows; items that repeat an id are one item; an item with a null id marks words and is in no list. Empty tables: no
documents give no rows, no items give documents without hits. Other columns of either table are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm._common import settle
from tessera.llm.divergence import pieces_between

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Windows (some 200 bytes each) up to which they are broadcast; beyond it they meet documents through a shuffle.
MOST_BROADCAST = 200_000


def words(text: Column) -> Column:
    return pieces_between(F.coalesce(text, F.lit("")), BETWEEN_WORDS)


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(window, item_id) without repeats; a window is its words with single spaces."""
    w = items.select(items["item_id"].cast("string").alias("item_id"), words(items["text"]).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("w", s, width), " "))).alias("window")).distinct()


def _shingles(rows: DataFrame, widths: list[int], column: str = "w") -> DataFrame:
    """rows with (at, h): place and hash of each run of as many words as `widths` says."""
    w = F.col(column)
    beside = F.arrays_zip(*[(w if k == 0 else F.slice(w, k + 1, 1 << 30)).alias(f"w{k}") for k in range(max(widths))])
    each = rows.select("*", F.posexplode(beside).alias("at", "s"))
    hashes = [F.when(F.col(f"s.w{k - 1}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"s.w{i}") for i in range(k)])) for k in widths]
    if len(hashes) == 1:
        return each.withColumn("h", hashes[0]).filter("h IS NOT NULL").drop("s")
    return each.withColumn("h", F.explode(F.array(*hashes))).filter("h IS NOT NULL").drop("s")


def _prefixes(texts: DataFrame, windows: DataFrame, widths: list[int], shingle: int, small: bool) -> DataFrame:
    """(h, at, window, len): each window's rarest shingle in the corpus, ties by hash and place. A window of which a
    shingle never occurs can't occur, and isn't there."""
    w = windows.select("window", F.split("window", " ").alias("w")).withColumn("len", F.size("w"))
    own = [_shingles(w.filter(F.least("len", F.lit(shingle)) == k), [k]).select("window", "len", "at", "h") for k in widths]
    own = settle(reduce(DataFrame.union, own), "window-shingles")
    asked = own.select("h").distinct()
    found = _shingles(texts, widths).select("h")
    seen = found.join(F.broadcast(asked), "h", "left_semi").groupBy("h").count() if small else found.groupBy("h").count().join(asked, "h", "left_semi")
    rare = F.min(F.struct("count", "h", "at"))
    best = own.join(seen, "h", "left").groupBy("window", "len").agg(rare.alias("x"), F.bool_and(F.col("count").isNotNull()).alias("all"))
    return settle(best.filter("all").select("x.h", "x.at", "window", "len"), "prefixes")


def occurrences(texts: DataFrame, windows: DataFrame, width: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(key, start, end, window) of every place in texts (key, w) that holds a window word for word, once for each key.

    Shingles of documents are never shuffled where the windows are few enough to be broadcast: a document's words are
    carried along by reference and only what meets a prefix is compared. More windows meet documents through a shuffle,
    for which each shingle takes along the words around it, as far as a window reaches.
    """
    lengths = windows.groupBy(F.size(F.split("window", " ")).alias("len")).count().collect()  # a row a length, `width` at most
    if not lengths:
        return windows.sparkSession.createDataFrame([], "key binary, start int, end int, window string")
    widths, small = sorted({min(shingle, r["len"]) for r in lengths}), sum(r["count"] for r in lengths) <= MOST_BROADCAST
    prefixes = _prefixes(texts, windows, widths, shingle, small).withColumnRenamed("at", "offset")
    rows = _shingles(texts, widths)
    start, room = F.col("at") - F.col("offset"), F.size("w")
    if small:
        met = rows.join(F.broadcast(prefixes), "h").filter((start >= 0) & (start + F.col("len") <= room))
        met = met.select("key", start.alias("start"), "len", "window", F.slice("w", start + 1, F.col("len")).alias("x"))
    else:
        first = F.greatest(F.col("at") - width + 1, F.lit(0))
        around = rows.select("key", "at", "h", first.alias("first"), F.slice("w", first + 1, F.lit(2 * width - 1)).alias("x"))
        met = around.join(prefixes, "h").filter((start >= 0) & (start - F.col("first") + F.col("len") <= F.size("x")))
        met = met.select("key", start.alias("start"), "len", "window", F.slice("x", start - F.col("first") + 1, F.col("len")).alias("x"))
    same = met.filter(F.array_join("x", " ") == F.col("window"))
    return same.select("key", "start", (F.col("start") + F.col("len")).alias("end"), "window").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    Results belong to texts and are found under a text's SHA-256: copies, however many, are one key when hits are counted.
    """
    named = settle(item_windows(items, width), "windows")
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(docs["doc_id"].alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"), words(text).alias("w"))
    found = settle(occurrences(keyed.select("key", "w"), named.select("window").distinct(), width, shingle), "occurrences")

    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = found.select("key", "start", "end").withColumn("n", fresh).groupBy("key").agg(F.sum("n").alias("n_hit"))
    listed = found.select("key", "window").distinct().join(named, "window").select("key", "item_id").distinct()
    ids = F.array_sort(F.collect_list("item_id"))  # nulls are left out
    listed = listed.groupBy("key").agg(F.count("item_id").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    result = settle(hit.join(listed, "key", "left"), "hits")

    zero = F.lit(0).cast("long")
    out = settle(keyed.select("doc_id", "key", F.size("w").cast("long").alias("n_words")), "document-keys").join(result, "key", "left")
    n_hit = F.coalesce("n_hit", zero)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

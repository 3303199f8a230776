"""Source divergence audit: how far a source's use of words is from that of the other sources of its language.

Plain relational, all in the JVM: the matches of a regular expression are exploded (as (term, times) of each text), counted
by group, and groups meet their language's kept terms, so that zeros are there too; smoothed shares are joined with each
other on language and term, summed by pair of sources, and ranked. All arithmetic is in integers.

A group is a (language, source) that occurs. Null text, language and source count as ''. Every row is a document of its
own, so repeated rows count each. A text without a term leaves its group in place; a language whose terms are all too rare
has pairs of value 0 and no terms. An empty table gives no rows. Ties in value go by item, in UTF-8 order. Other columns
are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm._common import settle

#: What stands between terms: the complement of [^\x00-\x40\x5B-\x60\x7B-\x7F], at which split() finds the same matches
#: as regexp_extract_all() in a thirtieth of the time.
BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are whole multiples of 1 / ONE.
ONE = 1_000_000_000
#: Pieces into which the terms of a language are dealt where they meet its groups.
PIECES = 64


def ascii_lower(text: Column) -> Column:
    """A-Z only; where a text has no other letters than these, lower() does it byte by byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def pieces_between(text: Column, between: str) -> Column:
    """The longest stretches of a lower-cased text that hold nothing of `between` (a character class with a plus)."""
    return F.array_remove(F.split(ascii_lower(text), between), "")


def term_counts(docs: DataFrame, between: str = BETWEEN_TERMS) -> DataFrame:
    """(lang, source, term, n, n_docs) of documents.

    Each text's terms are sorted and exploded beside their neighbours; only the first and the last of a run of equal terms
    go on. Counting -place for the first and place + 1 for the last adds up to a run's length, and firsts are documents.
    """
    null_is_empty = [F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(*null_is_empty, F.sort_array(pieces_between(F.coalesce(docs["text"], F.lit("")), between)).alias("t"))
    beside = F.arrays_zip(F.concat(F.array(F.lit("")), "t").alias("before"), F.col("t").alias("term"), F.slice("t", 2, 1 << 30).alias("after"))
    each = rows.select("lang", "source", F.posexplode(beside).alias("at", "s")).select("lang", "source", "at", "s.*").filter("term IS NOT NULL")
    ends = each.withColumns({"first": F.col("before") != F.col("term"), "last": F.col("after").isNull() | (F.col("after") != F.col("term"))}).filter("first OR last")
    n = F.when(F.col("last"), F.col("at") + 1).otherwise(0) - F.when(F.col("first"), F.col("at")).otherwise(0)
    return ends.groupBy("lang", "source", "term").agg(F.sum(n.cast("long")).alias("n"), F.sum(F.col("first").cast("long")).alias("n_docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(ONE * (count + 2) / (total + 2 * kept)); in decimals where counts of a large corpus times ONE leave 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    exact = F.call_function("div", wide(count + 2) * F.lit(ONE).cast("decimal(10,0)"), wide(total + 2 * kept)).cast("long")
    return F.when(count < (1 << 62) // ONE, F.call_function("div", (count + 2) * F.lit(ONE).cast("long"), total + 2 * kept)).otherwise(exact) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)); both are at most ONE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _each(left: DataFrame, right: DataFrame, salt: str) -> DataFrame:
    """Rows of left (few a language) beside those of right, by language: an equality join on language and a piece of
    `salt`, so that a language's rows are dealt to PIECES tasks."""
    left = left.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    return left.join(right.withColumn("__piece", F.pmod(F.xxhash64(salt), F.lit(PIECES)).cast("int")), ["lang", "__piece"]).drop("__piece")


def _ranked(df: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))


def audit(docs: DataFrame, least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair` has each other source of the language, part `term` the
    `most_terms` terms that a source uses most above its language's share. Kept are terms of `least_docs` documents or more.

    The corpus is read once; what is joined afterwards are counts by (language, source, term). The number of pairs is
    that of a language's sources, squared, as the result asks for.
    """
    counts = settle(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("d"))
    kept = settle(kept.filter(F.col("d") >= least_docs).select("lang", "term", "lang_n"), "kept-terms")
    used = settle(counts.select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"]), "kept-counts")
    own = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = settle(groups.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0), "groups")

    dense = _each(groups.filter("v > 0"), kept, "term").join(used, ["lang", "source", "term"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    dense = settle(dense.select("lang", "source", "term", n.alias("n"), share(n, F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "shares")

    a, b = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"))
    half = a.join(b, ["lang", "term"]).filter("source < other").groupBy("lang", "source", "other").agg(F.sum(distance(F.col("p"), F.col("q"))).alias("value"))
    half = settle(half, "pair-sums")
    both = half.union(half.select("lang", "other", "source", "value")).withColumnRenamed("other", "item")
    names = groups.select("lang", "source")
    pairs = _each(names, names.withColumnRenamed("source", "item"), "item").filter("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").fillna(0, ["value"])
    above = dense.filter("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(above, "term").filter(F.col("rank") <= most_terms))

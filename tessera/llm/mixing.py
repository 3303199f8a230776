"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents fall into cells (source, language, topic). Cells are aggregated before any shuffle; raking then works on the
table of cells alone: for each margin in turn a cell's weight is scaled by target / current total of its level, until
every level is within TOLERANCE of its target. Targets that no weights can meet end when a step no longer helps, with a
warning. A cell's factor (raked weight / tokens) times a scale gives each of its documents the probability
to stay; the scale is calibrated so that the expected tokens are `keep` of all, with probabilities that would exceed 1
held at 1, repeated until no further cell reaches 1. A document stays if the uniform number made from its id and the seed lies below.

Targets: a level's share is its share of the tokens to the power `temper`, normalised, unless `targets` gives shares.
The topic is the register of the text (`register`), unless `topic_col` names a column of the frame.

Defined results: null sources, languages and topics are levels like others; a null or empty text counts as one token;
a level whose target is 0 keeps nothing; a null id draws from the hash of an empty text; rows that repeat an id draw alike; an empty frame gives an empty frame;
extra columns are carried by `mix_sources` and ignored by `probabilities`.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm._common import settle

MARGINS = ("source", "lang", "topic")
TEMPER, KEEP, SEED = 0.7, 0.8, 17
#: How far a level may lie from its target, the rounds between two looks at that, and the most rounds.
TOLERANCE, STEP, ROUNDS = 1e-12, 4, 200
#: So many cells at most are raked in one partition, without an exchange for each margin.
ONE_PARTITION = 10_000
#: Rounds of the SQL form, which can't stop by itself: more than raking and calibration take on the test tables.
SQL_ROUNDS, SQL_HOLDS = 24, 12


def tokens(text: Column) -> Column:
    """A document's weight: a quarter of its bytes, at least 1."""
    return F.greatest(F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / 4), F.lit(1)).cast("double")


def register(text: Column) -> Column:
    """Topic by register: table rows, short note, article or long read."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(" | "), "table").when(F.length(t) < 600, "note").when(F.length(t) < 4000, "article").otherwise("long")


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: 52 bits of an MD5."""
    h = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cells(df: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """(source, lang, topic, tokens): one row a cell."""
    t = F.col(text_col).cast("string")
    return df.select(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), (register(t) if topic is None else topic).alias("topic"), tokens(t).alias("n")).groupBy(*MARGINS).agg(F.sum("n").alias("tokens"))


def rake(c: DataFrame, temper: float = TEMPER, rounds: int = ROUNDS, targets: dict[str, dict] | None = None) -> DataFrame:
    """Add share, weight: cells raked to the margins. A window spans the cells of one level, never documents."""
    c = settle(c, "cells")
    n, all_tokens = c.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    near = (lambda x: x.coalesce(1)) if n <= ONE_PARTITION else (lambda x: x)
    c = near(c).withColumn("share", F.col("tokens") / F.lit(all_tokens or 1.0))
    for m in MARGINS:
        if targets and m in targets:
            goal = F.coalesce(*[F.when(F.col(m).eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in targets[m].items()], F.lit(0.0))
        else:
            levels = c.groupBy(m).agg(F.pow(F.sum("share"), F.lit(temper)).alias("g")).agg(F.sum("g")).first()[0] or 1.0
            goal = F.pow(F.sum("share").over(Window.partitionBy(m)), F.lit(temper)) / F.lit(levels)
        c = c.withColumn(f"goal_{m}", goal)
    c = c.withColumn("weight", F.col("share"))
    total = lambda m: F.sum("weight").over(Window.partitionBy(m))
    before = None
    for k in range(rounds):
        for m in MARGINS:
            c = c.withColumn("weight", F.when(F.col(f"goal_{m}") > 0, F.col("weight") * F.col(f"goal_{m}") / total(m)).otherwise(0.0))
        if k % STEP == STEP - 1 or k == rounds - 1:
            c = near(settle(c, "raked"))
            # the last margin has just been met
            off = c.select(F.greatest(*[F.abs(total(m) - F.col(f"goal_{m}")) for m in MARGINS[:-1]]).alias("off")).agg(F.max("off")).first()[0] or 0.0
            if off <= TOLERANCE or (before is not None and off > 0.99 * before):
                break
            before = off
    if rounds and off > 1e-6:
        warnings.warn(f"a level is {off:.2g} from its target", stacklevel=2)
    return c


def probabilities(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, tokens, weight, p). A cell is held at 1 once a scale lifts it there; the scale of the
    others then rises. Only three sums a round reach the driver."""
    c = raked.select(*MARGINS, "tokens", "share", "weight", F.when(F.col("share") > 0, F.col("weight") / F.col("share")).otherwise(0.0).alias("factor"))
    most, scale, before = 0.0, 1.0, None
    while True:
        held = F.col("factor") * F.lit(most) >= 1
        n, done, rest = c.agg(F.count_if(held), F.sum(F.when(held, F.col("share")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))).first()
        if n == before or not rest:
            break
        scale, before = max(keep - done, 0.0) / rest, n
        most = max(most, scale)
    held = F.col("factor") * F.lit(most) >= 1
    return c.select(*MARGINS, "tokens", "weight", F.when(held, 1.0).otherwise(F.least(F.lit(scale) * F.col("factor"), F.lit(1.0))).alias("p"))


def with_probability(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = SEED, keep: float = KEEP, topic_col: str | None = None, **options) -> DataFrame:
    """(row struct `held`, source, lang, topic, p, u) of every row. The documents meet the cells' probabilities in a
    join whose small side is the table of cells; if it is too large to broadcast, AQE splits the hot cells."""
    topic = register(df[f"`{text_col}`"].cast("string")) if topic_col is None else df[f"`{topic_col}`"].cast("string")
    p = settle(probabilities(rake(cells(df, text_col, source_col, lang_col, topic), **options), keep), "mix")
    d = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("held"), df[source_col].alias("source"), df[lang_col].alias("lang"), topic.alias("topic"), uniform(df[f"`{id_col}`"], seed).alias("u")).alias("d")
    c = p.alias("c")
    on = [F.col(f"d.{m}").eqNullSafe(F.col(f"c.{m}")) for m in MARGINS]
    return d.join(c, on[0] & on[1] & on[2]).select("d.*", "c.p", "c.weight")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of df that the sample keeps, with their columns."""
    return with_probability(df, id_col, text_col, source_col, lang_col, **options).filter("u < p").select("held.*")


def sample_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **options) -> DataFrame:
    """(id, source, lang, topic, probability, kept) of every row."""
    rows = with_probability(df, id_col, text_col, source_col, lang_col, **options)
    return rows.select(F.col("held").getField(id_col).cast("long").alias(id_col), "source", "lang", "topic", F.round("p", 6).alias("probability"), (F.col("u") < F.col("p")).alias("kept"))


def oracle(table: str, columns: str, temper: float = TEMPER, rounds: int = SQL_ROUNDS, keep: float = KEEP, seed: int = SEED) -> str:
    """CTEs ending in mixed_<table> (all of `columns`, topic, p, u) as DuckDB SQL over a relation with the same steps."""
    q = [f"""{table}_d AS (SELECT {columns}, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN length(coalesce(text, '')) < 600 THEN 'note' WHEN length(coalesce(text, '')) < 4000 THEN 'article' ELSE 'long' END AS topic,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u, greatest(strlen(coalesce(text, '')) // 4, 1)::DOUBLE AS n FROM {table})""",
         f"{table}_c AS (SELECT source, lang, topic, sum(n) AS tokens FROM {table}_d GROUP BY ALL)",
         f"{table}_s AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM {table}_c)"]
    goals = ", ".join(f"pow(sum(share) OVER (PARTITION BY {m}), {temper}::DOUBLE) / (SELECT sum(g) FROM (SELECT pow(sum(share), {temper}::DOUBLE) AS g FROM {table}_s GROUP BY {m})) AS goal_{m}" for m in MARGINS)
    q.append(f"{table}_r0 AS MATERIALIZED (SELECT *, share AS weight, {goals} FROM {table}_s)")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            q.append(f"{table}_r{k + 1} AS MATERIALIZED (SELECT * REPLACE (weight * goal_{m} / sum(weight) OVER (PARTITION BY {m}) AS weight) FROM {table}_r{k})")
            k += 1
    q.append(f"{table}_h0 AS MATERIALIZED (SELECT *, weight / share AS factor, FALSE AS held, 0::DOUBLE AS scale FROM {table}_r{k})")
    for h in range(SQL_HOLDS):
        q.append(f"{table}_g{h} AS MATERIALIZED (SELECT * REPLACE (greatest({keep}::DOUBLE - sum(CASE WHEN held THEN share ELSE 0 END) OVER (), 0) / nullif(sum(CASE WHEN held THEN 0 ELSE weight END) OVER (), 0) AS scale) FROM {table}_h{h})")
        q.append(f"{table}_h{h + 1} AS MATERIALIZED (SELECT * REPLACE (held OR coalesce(scale, 0) * factor >= 1 AS held) FROM {table}_g{h})")
    q.append(f"{table}_p AS (SELECT source, lang, topic, CASE WHEN held THEN 1 ELSE least(coalesce(scale, 1) * factor, 1) END AS p FROM {table}_h{SQL_HOLDS})")
    q.append(f"mixed_{table} AS (SELECT d.*, p.p FROM {table}_d d JOIN {table}_p p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic)")
    return ",\n".join(q)

"""Toxicity: a logistic classifier over words and word beginnings, regularised by counterfactuals.

Training rows come from a bounded, hash-ordered sample of the labelled rows. Their words and the beginnings of longer
words are counted in a distributed way; those that tell the classes apart (by a two-sample z score) become the
features, together with the identity terms; a feature's value is its count in the text, 4 at most. For every training
row that names a group, and for a copy of each row to which a mention is added, the identity term is swapped for others,
together with the beginnings of it that are features; the loss holds the squared difference of the two scores, so that a
neutral mention of a group doesn't move the score. Features are whole 64-bit hashes, so no other word shares a feature's
weight.

Defined results: a null or empty text gets the score of the bias alone; without both classes among the labels the score
is the share of label 1 (0 without labels); labels other than 0 and 1 and null ids are left out of training; rows that
repeat an id are each scored; an empty frame gives an empty frame; extra columns are ignored by `score` and carried by
`drop_toxic`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import SPACE, U64, chunks, settle, word_hash, words

#: Bounds of the fit: labelled rows, and features that reach the driver.
SAMPLE_ROWS = 8192
FEATURES = 1024
#: A feature's least document count and z score.
LEAST_DF, LEAST_Z = 5, 5.0
#: Words that name groups of people, in lower case.
IDENTITY_TERMS = ["women", "men", "woman", "man", "girls", "boys", "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "atheist", "black", "white", "asian", "latino", "african", "european", "arab", "immigrant", "immigrants", "refugees", "gay", "lesbian", "bisexual", "transgender", "straight", "disabled", "deaf", "blind", "elderly", "young"]
#: Everything ASCII but letters and digits ends a word.
BETWEEN = SPACE.copy()
BETWEEN[[c for c in range(128) if not chr(c).isalnum()]] = True


#: Lengths in bytes of the word beginnings that are features too, and the highest count that a feature takes.
PREFIXES, MOST = (4, 5, 6, 7), 4


def _counts(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, by row, and how often each occurs, MOST at most."""
    if not len(h):
        return row, h, np.zeros(0, np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))
    return row[at], h[at], np.minimum(np.diff(np.concatenate([at, [len(row)]])), MOST)


def _features(word: str) -> np.ndarray:
    """The hashes of a word and of its beginnings."""
    b = np.frombuffer(word.encode(), np.uint8)
    return words(np.array([0, len(b)]), b, True, BETWEEN, PREFIXES)[1]


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves no remainder modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """(y, hashes, counts) of at most sample_rows labelled rows outside the held-out fold, equal word sets once."""
    picked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def f(batches):
        for b in batches:
            for first, offsets, data in chunks(b.column(1)):
                row, h, n = _counts(*words(offsets, data, True, BETWEEN, PREFIXES))
                cut = pa.array(np.searchsorted(row, np.arange(len(offsets))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(offsets) - 1), pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int32)))], ["y", "hashes", "counts"])

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most sample_rows rows are broadcast
    return text.join(F.broadcast(picked), "id").select("y", "text").mapInArrow(f, "y int, hashes array<long>, counts array<int>").dropDuplicates()


def _fit(x: np.ndarray, y: np.ndarray, identity: np.ndarray, mention: np.ndarray, penalty: float, l1: float = 2e-4, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Accelerated proximal descent on log loss + penalty * mean squared change of score under swaps + l1.

    identity holds the column of each term, mention (terms x columns) what a mention of each adds to the features.
    """
    n, d = x.shape
    terms = len(identity)
    g = np.zeros((terms, terms))  # sum of d d' over changes d of the terms under a swap; the pairs themselves aren't kept
    for k in range(n if terms > 1 else 0):
        named = np.flatnonzero(x[k, identity] > 0)
        one, two = k % terms, (k * 7 + 3) % terms
        had = set(map(int, named if len(named) else [one]))  # as written, or with a mention added
        for change in (had ^ {two}, had):  # swapped for another group, and without the mention
            at = np.array(sorted(change), int)
            sign = np.where([a in had for a in at], 1.0, -1.0)
            g[np.ix_(at, at)] += np.outer(sign, sign)
    g = mention.T @ g @ mention / max(2 * n, 1)
    rate = y.mean()
    step = 1 / (0.25 * np.linalg.eigvalsh(x.T @ x / n)[-1] + 0.25 + 2 * penalty * np.linalg.eigvalsh(g)[-1])
    w = v = np.zeros(d)
    b = c = float(np.log(rate / (1 - rate)))
    t = 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(x @ v.astype(x.dtype) + c, -30, 30))) - y  # in the type of x, which isn't copied
        new = v - step * (r.astype(x.dtype) @ x / n + 2 * penalty * (g @ v))
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = c - step * r.mean()
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c, w, b, t = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b), new, nb, s
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, penalty: float = 1.0):
    """(sorted feature hashes, weights, bias). Only sample_rows labelled rows and FEATURES words reach the driver."""
    rows = settle(train_rows(docs, labels, id_col, text_col, label_col, sample_rows), "toxic-train")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    none = np.zeros(0, U64), np.zeros(0)
    if not n0 or not n1:
        return *none, 30.0 if n1 else -30.0
    c = rows.select("y", F.explode("hashes").alias("h")).groupBy("h").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("c1"), F.count(F.lit(1)).alias("c"))
    share = F.col("c") / (n0 + n1)
    z = (F.col("c1") / n1 - (F.col("c") - F.col("c1")) / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    best = c.filter(F.col("c") >= LEAST_DF).withColumn("z", F.abs(z)).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h").limit(FEATURES)
    terms = np.unique(np.array([word_hash(t) for t in IDENTITY_TERMS], U64))
    parts = {word_hash(t): _features(t) for t in IDENTITY_TERMS}
    vocabulary = np.unique(np.concatenate([np.array([r["h"] for r in best.select("h").collect()], np.int64).view(U64), terms]))

    def known(batches):
        for b in batches:
            lists = b.column(1)
            h, at = lists.flatten().to_numpy(zero_copy_only=False).view(U64), np.asarray(lists.offsets)
            k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            hit = vocabulary[k] == h
            dense = np.zeros((b.num_rows, len(vocabulary)), np.uint8)
            dense[row[hit], k[hit]] = np.asarray(b.column(2).flatten())[hit]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in dense], pa.binary())], ["y", "x"])

    got = sorted((r["y"], bytes(r["x"])) for r in rows.mapInArrow(known, "y int, x binary").toLocalIterator())
    x = np.frombuffer(b"".join(v for _, v in got), np.uint8).reshape(len(got), -1).astype(np.float32)
    mention = np.array([np.isin(vocabulary, parts[int(t)]) for t in terms], float)
    w, b = _fit(x, np.array([y for y, _ in got], float), np.searchsorted(vocabulary, terms), mention, penalty)
    used = w != 0
    return vocabulary[used], w[used], b


def scores(column: pa.Array, model) -> np.ndarray:
    vocabulary, w, b = model
    out = np.full(len(column), b)
    for first, offsets, data in chunks(column):
        row, h = words(offsets, data, True, BETWEEN, PREFIXES)
        if len(vocabulary) and len(h):
            k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[k] == h
            row, k, n = _counts(row[hit], k[hit])
            out[first : first + len(offsets) - 1] += np.bincount(row, w[k] * n, len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches):
        for b in batches:
            s = scores(b.column(2), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long"), held_out(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(f, f"`{id_col}` long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns; rows don't leave their partition."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def f(batches):
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at).cast(pa.string()), sent.value) < 0.5))

    return docs.mapInArrow(f, docs.schema)

"""Vector code compression: vectors are cut into parts, each part is coded by the index of its codebook's nearest entry.

Codebooks come from rounds of assignment and averaging in whole numbers. Assignment is an exponion search: from the entry
of the round before, at squared distance u from a part x, no entry that is as near can lie further from that entry than
sqrt(u) + sqrt(u). So only the stretch of its distance-sorted neighbour list with squared distances of at most 4 * u is
scanned. Distances are exact, ties go to the lower index.

A null vector, or one with null, NaN or infinite components, is dropped. A null vec_id comes after all others when the first
entries are chosen and is coded like any; repeated ids are rows of their own, of which the lesser vector comes first. With
fewer vectors than entries the codebook is as long as there are vectors. Vectors of length 0 have parts of length 0. An
empty table gives no rows. Vectors of unequal length, or of a length that `parts` doesn't divide, and components whose
squared distances could leave 64 bits are an error. Other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import forget, settle, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that one step of a search holds, and neighbours that it looks at first; each later look takes in twice as many.
STEP, NEIGHBOURS = 32768, 16
#: Groups of equal labels up to which their sums are broadcast.
MOST_BROADCAST = 100_000
STATE = "vec_id long, label string, q array<long>, prev binary"


def _kept(df: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, q, prev): whole-number vectors; a product with a power of two is exact in 64 bits."""
    x = df["embedding"].cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(df["vec_id"].cast("long").alias("vec_id"), df["label"].cast("string").alias("label"), x.alias("x")).filter(F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("q"), F.lit(None).cast("binary").alias("prev"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) and (np.diff(column.offsets.to_numpy()) != dims).any():
        raise ValueError(f"vectors must have {dims} components, as the first has")
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)
    if ((out >= 1 << 62) | (out <= -(1 << 62))).any():  # Spark's floor() stops at the ends of 64 bits
        raise ValueError("components are too large for squared distances of 64 bits")
    return out


class Book:
    """One part's codebook: entries, and for each of them all entries by distance (ties by index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squares(entries, entries)
        self.order = np.argsort(between, axis=1, kind="stable").astype(np.int32)
        self.far = np.take_along_axis(between, self.order, 1)


class Squares:
    """Squared distances of rows of x to rows of c, exact: products run in floating point where every sum in them is below
    2 ** 53, else differences in whole numbers."""

    def __init__(self, x: np.ndarray, c: np.ndarray):
        some = [a for a in (x, c) if a.size]
        most, width = max((int(np.abs(a).max()) for a in some), default=0), max(x.shape[1], 1)
        self.floats = 4 * most * most * width < 1 << 53
        apart = max((int(a.max()) for a in some), default=0) - min((int(a.min()) for a in some), default=0)
        if not self.floats and apart * apart * width >= 1 << 61:
            raise ValueError("components are too large for squared distances of 64 bits")
        self.x, self.c = (a.astype(np.float64) if self.floats else a for a in (x, c))
        self.xx, self.cc = ((a * a).sum(1) if self.floats else None for a in (self.x, self.c))

    def __call__(self, rows, entries) -> np.ndarray:
        x, c = self.x[rows], self.c[entries]
        if self.floats:
            return self.xx[rows][:, None] + self.cc[entries] - 2 * (x @ c.T)
        return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return Squares(x, c)(slice(None), slice(None)).astype(np.int64)


def exponion(x: np.ndarray, book: Book, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry, squared distance, distances looked at) of every row of x, from an entry for each to start at."""
    between, looked = Squares(x, book.entries), len(x)
    best, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    by_start = np.argsort(start, kind="stable")
    for rows in np.split(by_start, np.flatnonzero(np.diff(start[by_start], prepend=-1))[1:]):  # a turn for each entry in use
        if not len(rows):
            continue
        a = int(start[rows[0]])
        u = between(rows, slice(a, a + 1))[:, 0].astype(np.int64)
        reach = np.searchsorted(book.far[a], 4 * u, "right")  # places of the neighbour list within the radius
        by_reach = np.argsort(-reach, kind="stable")
        rows, u, reach = rows[by_reach], u[by_reach], reach[by_reach]
        near, d, at, step = np.full(len(rows), a, np.int64), u.copy(), 0, NEIGHBOURS
        while at < reach[0]:
            n = int(np.searchsorted(-reach, -at, "left"))  # rows whose radius goes beyond this place
            among = np.sort(book.order[a, at : min(at + step, int(reach[0]))])
            s = between(rows[:n], among)
            k = s.argmin(1)  # the first of equals, so the lowest index
            m, i = s[np.arange(n), k].astype(np.int64), among[k]
            better = (m < d[:n]) | ((m == d[:n]) & (i < near[:n]))
            d[:n], near[:n] = np.where(better, m, d[:n]), np.where(better, i, near[:n])
            looked, at, step = looked + s.size, at + step, 2 * step
        best[rows], least[rows] = near, d
    return best, least, looked


def _steps(batches, size: int):
    """Arrow batches, put together to some `size` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _assigned(state: DataFrame, books: list[Book], dims: int, schema: str, final: bool) -> DataFrame:
    """state with its entries after a search from those before (the first entry where there are none yet)."""
    shared = state.sparkSession.sparkContext.broadcast(books)  # len(books) * 256 * (256 * 12 + 8 * components) bytes at most
    parts, width = len(books), dims // len(books)

    def f(batches):
        for b in _steps(batches, STEP):
            q, prev = _matrix(b.column("q"), dims), b.column("prev")
            start = np.zeros((b.num_rows, parts), np.int64) if prev.null_count else np.frombuffer(b"".join(prev.to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            error, code = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, parts), np.uint8)
            for p, book in enumerate(shared.value):
                code[:, p], d, _ = exponion(q[:, p * width : (p + 1) * width], book, start[:, p])
                error += d
            if final:
                hexed = code.tobytes().hex()
                code = pa.array([hexed[j : j + 2 * parts] for j in range(0, len(hexed), 2 * parts)], pa.string())
                out = pa.table([b.column("vec_id"), b.column("label"), code, pa.array(error)], ["vec_id", "label", "code", "error"])
            else:
                code = pa.array([r.tobytes() for r in code], pa.binary())
                out = pa.table([b.column("vec_id"), b.column("label"), b.column("q"), code], ["vec_id", "label", "q", "prev"])
            yield from out.to_batches()
        tidy()

    return state.mapInArrow(f, schema)


def _means(state: DataFrame, books: list[Book], dims: int) -> list[Book]:
    """Codebooks of floor(sum / count) of the parts of each entry; an entry that is not in use stays.

    Each task sums its rows before anything moves; a row for each part and entry in use reaches the driver.
    """
    parts, width = len(books), dims // len(books)

    def f(batches):
        total, n = np.zeros((parts, ENTRIES, width), np.int64), np.zeros((parts, ENTRIES), np.int64)
        for b in _steps(batches, STEP):
            q, code = _matrix(b.column("q"), dims), np.frombuffer(b"".join(b.column("prev").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                used, at = np.unique(code[order, p], return_index=True)
                if width and len(used):
                    total[p, used] += np.add.reduceat(q[order, p * width : (p + 1) * width], at, axis=0)
                n[p] += np.bincount(code[:, p], minlength=ENTRIES)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = state.select("q", "prev").mapInArrow(f, "part int, entry int, n long, total array<long>")
    sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).cast("array<long>").alias("total"))
    out = [b.entries.copy() for b in books]
    for r in sums.collect():
        out[r["part"]][r["entry"]] = [t // r["n"] for t in r["total"]]
    return [Book(e) for e in out]


def encode(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), codebooks) of vectors (vec_id, embedding, label): at most 256 entries a part.

    Vectors and their entries are a table in the shared folder after each round, of which the one before goes; what reaches
    the driver are `entries` vectors and, each round, `parts * entries` sums.
    """
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"a code has one byte a part: 1 to {ENTRIES} entries")
    state = settle(_kept(df, scale), "vectors")
    first = state.orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(entries).collect()
    dims = len(first[0]["q"]) if first else 0
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    if any(len(r["q"]) != dims for r in first):
        raise ValueError(f"vectors must have {dims} components, as the first has")
    start, width = np.array([r["q"] for r in first], np.int64).reshape(len(first), dims), dims // parts
    books = [Book(start[:, p * width : (p + 1) * width]) for p in range(parts)]
    if first:
        for k in range(rounds):
            after = settle(_assigned(state, books, dims, STATE, False), f"round{k}")
            books = _means(after, books, dims)
            forget(state)
            state = after
    return _assigned(state, books, dims, "vec_id long, label string, code string, error long", True), [b.entries for b in books]


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def codes(df: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); label_error is the error summed over equal labels."""
    coded, books = encode(df, **options)
    coded = settle(coded, "codes")
    sums = settle(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
    small = sums.count() <= MOST_BROADCAST
    out = coded.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

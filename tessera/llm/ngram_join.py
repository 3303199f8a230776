"""N-gram Jaccard join: every link between documents whose shingle sets overlap enough, exactly.

1. Documents with equal sets fall together (128-bit hash of the set); one of them stands for all.
2. Candidates: all shingles have one order, those that a sample of the documents holds often last. Two sets that link
   share a shingle among the first n - ceil(t * n) + 1 of each (prefix filter), whatever the order; with this one hardly
   any that merely share a passage do. Shingles that only one prefix holds are left out. The holders of the others meet in
   blocks of shingles: pairs whose sizes, places of the shingle and sketches (parities of hashed bits: they differ in no
   more places than the sets do) allow a link connect them. A block gives a tree of what it connects, not its pairs, so at
   most a row for each document that it holds.
3. Components of these trees hold all links. Each is a tile, in which the overlaps of all sets are counted exactly, as a
   product of matrices; large ones are dealt out over tiles of bounded size, so that any two documents meet in one. A tile
   gives a tree of its links, too.
4. Components of the links.

Defined results: a null or empty text, or one of white space only, has no shingles and is linked with nothing (rows of
equal empty texts too); fewer words than the width are one shingle; rows that repeat an id are each a document, in the
class of its own text; a null id is a component of its own; an empty frame gives an empty frame; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import bits as B
from tessera.llm._common import U64, chunks, mix, rows_of, settle, tidy, windows, words
from tessera.llm.components import components, local_roots

#: Shingles of prefixes in a block that one Python task sorts at a time.
BLOCK = 400_000
#: A tile: documents, and bytes of their sets; columns of its matrix that are multiplied at a time.
TILE_ROWS, TILE_BYTES, COLUMNS = 2048, 16 << 20, 512
#: The order of shingles counts them in this many documents (in a 16th of all, if those are more) and keeps so many at most.
#: It decides how many pairs are looked at, never which links are found.
SAMPLE, FREQUENT = 8192, 300_000
#: Pairs that one task expands at a time, and bytes of sketches that it compares at a time.
PIECE, COMPARED = 1_000_000, 8 << 20


def shingle_sets(column, width: int):
    """(row, sorted distinct 64-bit shingle hashes) of every row with a word; letters A-Z in lower case."""
    for first, offsets, data in chunks(column):
        _, _, row, h = words(offsets, data, lower=True)
        at, g = windows(row, h, width)
        wide = row[at]
        n_words = np.bincount(row, minlength=len(offsets) - 1)
        lo, hi = np.searchsorted(wide, np.arange(len(n_words))), np.searchsorted(wide, np.arange(len(n_words)), "right")
        from_word = np.concatenate([[0], np.cumsum(n_words)])
        for i in np.flatnonzero(n_words):
            if n_words[i] >= width:
                yield first + int(i), np.unique(g[lo[i] : hi[i]])
            else:  # the whole sequence as one
                x = np.full(1, n_words[i], U64)  # arrays wrap around without a warning
                for k in range(from_word[i], from_word[i + 1]):
                    x = mix(x ^ h[k : k + 1])
                yield first + int(i), x


def set_hash(s: np.ndarray) -> tuple[int, int]:
    m = mix(s)
    return int(np.add.reduce(m).view(np.int64)), int((np.bitwise_xor.reduce(mix(m)) + U64(len(s))).view(np.int64))


class Bands:
    """Size bands for a threshold of num/den, and the number of parts of each (the join doesn't use them any more)."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def low(self, band: int) -> int:
        """The smallest size of a band; bands 0, 1, ... are [low(b), low(b + 1))."""
        return math.ceil((self.den / self.num) ** band - 1e-9)

    def of(self, n: int) -> int:
        b = max(0, int(math.log(n) / math.log(self.den / self.num)) - 1)
        while self.low(b + 1) <= n:
            b += 1
        return b

    def differ(self, band: int) -> int:
        """The most shingles in which two linked sets can differ whose larger one lies in the band."""
        most = self.low(band + 1) - 1
        return (2 * most * (self.den - self.num)) // (self.den + self.num)

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, difference allowed). A few spare parts make up for empty ones."""
        d = self.differ(band)
        return (1, 0) if d == 0 else (d + 2 + d // 16, d)


def prefix(s: np.ndarray, order: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """The first shingles of a sorted set in the order (times in the sample, hash): two sets that link share one of these, as
    at least ceil(t * n) shingles of each are common and no common one comes before the first."""
    frequent, times = order
    k = len(s) + -len(s) * num // den + 1
    if not len(frequent):
        return s[:k]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    return s[np.argsort(np.where(frequent[at] == s, times[at], 0), kind="stable")[:k]]


def _frequent(docs: DataFrame, width: int, rows: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that documents of a sample share, the most frequent ones, and in how many of them each is."""
    every = max(1, rows // max(SAMPLE, rows // 16))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / every / BLOCK))

    def cut(batches):
        for b in batches:
            sets = [s for _, s in shingle_sets(b.column(0), width)]
            if sets:
                x, n = np.unique(np.concatenate(sets), return_counts=True)
                to = (x % U64(parts)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                p, at = np.unique(to[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), *[pa.array([v.tobytes() for v in np.split(y[order], at[1:])], pa.binary()) for y in (x, n.astype(np.int32))]], ["p", "x", "n"])
        tidy()

    def meet(t: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(v.as_py(), np.int64) for v in t.column("x")])
        n = np.concatenate([np.frombuffer(v.as_py(), np.int32) for v in t.column("n")])
        x, at = np.unique(x, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        return pa.table({"x": x[n > 1], "n": n[n > 1]})

    some = docs.filter("text is not null").filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text")
    found = settle(some.mapInArrow(cut, "p int, x binary, n binary").groupBy("p").applyInArrow(meet, "x long, n long"), "frequent")
    # as many of the most frequent as fit; a document's times are at most the sample, so this is a short list
    least, held = 2, 0
    for r in found.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        held += r["count"]
        if held > FREQUENT:
            least = r["n"] + 1
            break
    got = found.filter(F.col("n") >= least).toArrow()
    x, n = got.column("x").to_numpy().view(U64), got.column("n").to_numpy()
    order = np.argsort(x)
    return x[order], n[order]


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(row, id, n, h1, h2) of every row."""

    def f(batches):
        for b in batches:
            n = np.zeros((3, b.num_rows), np.int64)
            for i, s in shingle_sets(b.column(1), width):
                n[0, i] = len(s)
                n[1, i], n[2, i] = set_hash(s)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, n), b.column(2)], ["id", "n", "h1", "h2", "row"])
        tidy()

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(f, "id long, n long, h1 long, h2 long, row long")


def _shared(docs: DataFrame, width: int, order, num: int, den: int, blocks: int) -> DataFrame:
    """(a): the shingles that the prefixes of several sets hold. Two of a block's holders are enough to tell, so a shingle that
    very many documents hold travels twice a block."""

    def sign(batches):
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def out():
            sig = np.concatenate([x for x, _ in held])
            me = np.repeat(np.array([h for _, h in held], np.int64), [len(x) for x, _ in held])
            to = (sig % U64(blocks)).astype(np.int32)
            sort = np.lexsort((me, sig, to))
            sig, me, to = sig[sort], me[sort], to[sort]
            end = sig[1:] != sig[:-1]
            ends = np.concatenate([[True], end]) | np.concatenate([end, [True]])
            sig, me, to = sig[ends], me[ends], to[ends]
            p, at = np.unique(to, return_index=True)
            blocks_of = lambda x: [y.tobytes() for y in np.split(x, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(blocks_of(sig), pa.binary()), pa.array(blocks_of(me), pa.binary())], ["p", "sig", "me"])

        for b in batches:
            seen: set[int] = set()
            for _, s in shingle_sets(b.column(1), width):
                h = set_hash(s)[0]
                if h in seen:
                    continue
                seen.add(h)
                held.append((prefix(s, order.value, num, den), h))
                size += len(held[-1][0])
                if size > BLOCK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
        held.clear()
        tidy()

    def meet(t: pa.Table) -> pa.Table:
        sig = np.concatenate([np.frombuffer(x.as_py(), U64) for x in t.column("sig")])
        me = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column("me")])
        sort = np.lexsort((me, sig))
        sig, me = sig[sort], me[sort]
        run = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        last = np.concatenate([run[1:], [len(me)]]) - 1
        return pa.table({"a": sig[run][me[run] != me[last]].view(np.int64)})

    return docs.mapInArrow(sign, "p int, sig binary, me binary").groupBy("p").applyInArrow(meet, "a long")


def sketch_bits(n, num: int, den: int) -> np.ndarray:
    """Bits of the sketches of sets with n shingles: a power of two over 2.75 times what two linked sets can differ in. Half of
    the bits of unrelated sets differ, which is more than that."""
    most = 2 * np.asarray(n, np.int64) * (den - num) // (den + num)
    return np.clip(1 << np.ceil(np.log2(np.maximum(2.75 * most, 1))).astype(np.int64), 256, 1 << 15)


def sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """Of each value of the low bits whether an odd number of the set's shingles has it."""
    return np.packbits(np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").view(U64)


def _folded(b: np.ndarray, words: int) -> np.ndarray:
    """A sketch as the same set would give it with fewer bits: its parts laid over each other."""
    return np.bitwise_xor.reduce(b.reshape(-1, words), axis=0)


def _may_link(n1, n2, apart, num: int, den: int):
    """Whether the overlap that the differing bits leave can be enough: |A ^ B| is at least their number."""
    return (n1 + n2 - apart) // 2 * (den + num) >= num * (n1 + n2)


def _alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which pairs (places in n and bits) sizes and sketches can't rule out."""
    hit = np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num
    width = np.array([len(x) for x in bits], np.int64)
    least = np.minimum(width[a], width[b])
    for w in np.unique(least[hit]):
        k = np.flatnonzero(hit & (least == w))
        used, at = np.unique(np.stack([a[k], b[k]]), return_inverse=True)
        at, matrix = at.reshape(2, -1), np.stack([_folded(bits[x], w) for x in used])
        step = max(1, COMPARED // (8 * int(w)))
        for s in range(0, len(k), step):
            x, y = at[:, s : s + step]
            apart = np.bitwise_count(matrix[x] ^ matrix[y]).sum(axis=1).astype(np.int64)
            hit[k[s : s + step]] = _may_link(n[used[x]], n[used[y]], apart, num, den)
    return hit


def _fetch(docs: DataFrame, ids: DataFrame, width: int, make) -> DataFrame:
    """(id, h2, n, value): what `make` gives for the sets of the documents with these ids.

    Only texts whose id may be among them, by a filter of bounded size, are read into sets; the few that slip through
    fall out in the join that follows.
    """
    ids = ids.distinct()
    size = B.bits_for(ids.count())
    filled = docs.sparkSession.sparkContext.broadcast(B.count_bits(ids, size)[0])

    def f(batches):
        for b in batches:
            b = b.filter(pa.array(B.contains(filled.value, b.column(0).fill_null(-1).to_numpy().view(U64), size)))
            for x in rows_of([b], 500):
                found = [(x.column(0)[i].as_py(), set_hash(s)[1], len(s), make(s).tobytes()) for i, s in shingle_sets(x.column(1), width)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "h2", "n", "value"])
        tidy()

    return docs.mapInArrow(f, "id long, h2 long, n long, value binary")


def _partners(sig: np.ndarray, me: np.ndarray, label: np.ndarray, n: np.ndarray, place: np.ndarray, num: int, den: int):
    """Distinct pairs (2, k), piece by piece, of holders of a common shingle whose labels differ and whose sizes and places of
    the shingle allow a link: if it is the first that they share, all before it are in one of them only.

    Of each shingle's holders those of its most frequent label meet only the others.
    """
    sort = np.lexsort((label, sig))
    run = np.cumsum(np.concatenate([[False], sig[sort][1:] != sig[sort][:-1]]))
    part = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (label[sort][1:] != label[sort][:-1])]))
    long = np.diff(np.concatenate([part, [len(sig)]]))
    best = np.zeros(run[-1] + 1, np.int64)
    np.maximum.at(best, run[part], long * len(sig) + np.arange(len(part)))
    main = np.repeat(best[run[part]] % len(sig) == np.arange(len(part)), long)
    group = 2 * run + main
    again = np.lexsort((n[sort], group))
    sort, group, main = sort[again], group[again], main[again]
    me, label, n, place = me[sort], label[sort], n[sort], place[sort]
    key = (group << 32) + n
    k = np.flatnonzero(~main)
    up = n[k] * den // num
    own = (k, k + 1, np.searchsorted(key, (group[k] << 32) + up, "right"))
    other = group[k] + 1 << 32
    mains = (k, np.searchsorted(key, other - -n[k] * num // den), np.searchsorted(key, other + up, "right"))
    for k, first, last in (own, mains):
        count = last - first
        total = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(k):
            to = max(at + 1, int(np.searchsorted(total, total[at] + PIECE, "right")) - 1)
            x = np.repeat(k[at:to], count[at:to])
            y = np.arange(len(x)) + np.repeat(first[at:to] - total[at:to] + total[at], count[at:to])
            hit = (label[x] != label[y]) & _may_link(n[x], n[y], place[x] + place[y], num, den)
            x, y = me[x[hit]], me[y[hit]]
            if len(x):
                yield np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            at = to


def _tree(sig: np.ndarray, me: np.ndarray, place: np.ndarray, n: np.ndarray, bits: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root of each): what the pairs that may link connect. Entries say that document `me` has the shingle at a place of
    its prefix; n and bits are the documents'. First each meets its shingle's first holder, then those that this leaves apart."""
    sort = np.lexsort((me, sig))
    sig, me, place = sig[sort], me[sort], place[sort]
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    run = np.flatnonzero(new)
    first = np.repeat(me[run], np.diff(np.concatenate([run, [len(me)]])))
    two = np.unique(np.stack([first, me])[:, first != me], axis=1)
    two = two[:, _alike(*two, n, bits, num, den)]
    label = np.arange(len(n))
    nodes, root = local_roots(*two)
    label[nodes] = root
    found = [two]
    for more in _partners(sig, me, label[me], n[me], place, num, den):
        found.append(more[:, _alike(*more, n, bits, num, den)])
        if sum(x.shape[1] for x in found) > PIECE:
            found = [np.stack(local_roots(*np.concatenate(found, axis=1)))]
    return local_roots(*np.concatenate(found, axis=1))


def _candidates(docs: DataFrame, shared: DataFrame, width: int, order, num: int, den: int, blocks: int) -> DataFrame:
    """Distinct pairs (a, b) of set hashes that connect all sets which may link, by the shared shingles of prefixes."""
    size = B.bits_for(shared.count())
    filled = docs.sparkSession.sparkContext.broadcast(B.count_bits(shared, size)[0])

    def deal(batches):
        held: list[tuple] = []
        total, names = 0, ["p", "x", "d", "bits"]

        def out():
            sig = np.concatenate([x for x, *_ in held])
            doc = np.repeat(np.arange(len(held)), [len(x) for x, *_ in held])
            place = np.concatenate([np.arange(len(x)) for x, *_ in held])
            keep = np.flatnonzero(B.contains(filled.value, sig, size))
            to = (sig[keep] % U64(blocks)).astype(np.int32)
            sort = np.argsort(to, kind="stable")
            keep, to = keep[sort], to[sort]
            sig, doc, place = sig[keep].view(np.int64), doc[keep], place[keep]
            me, n = np.array([h for _, h, *_ in held], np.int64), np.array([k for _, _, k, _ in held], np.int64)
            p, at = np.unique(to, return_index=True)
            x, d, bits = [], [], []
            for k in np.split(np.arange(len(to)), at[1:]) if len(to) else []:
                own = np.unique(doc[k])
                x.append(np.stack([sig[k], me[doc[k]], place[k]]).tobytes())
                d.append(np.stack([me[own], n[own]]).tobytes())
                bits.append(b"".join(held[o][3] for o in own))
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), *[pa.array(y, pa.binary()) for y in (x, d, bits)]], names)

        for b in batches:
            seen: set[int] = set()
            for _, s in shingle_sets(b.column(1), width):
                h = set_hash(s)[0]
                if h in seen:
                    continue
                seen.add(h)
                held.append((prefix(s, order.value, num, den), h, len(s), sketch(s, int(sketch_bits(len(s), num, den))).tobytes()))
                total += len(held[-1][0])
                if total > BLOCK:
                    yield out()
                    held, total = [], 0
        if held:
            yield out()
        held.clear()
        tidy()

    def meet(batches):
        def out():
            sig, me, place = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x, _, _ in mine], axis=1)
            docs, n = np.concatenate([np.frombuffer(d, np.int64).reshape(2, -1) for _, d, _ in mine], axis=1)
            ends = np.cumsum(sketch_bits(n, num, den) // 64)
            words = np.frombuffer(b"".join(x for _, _, x in mine), U64)
            docs, at = np.unique(docs, return_index=True)
            bits = [words[(ends[k - 1] if k else 0) : ends[k]] for k in at]
            sig, me, place = np.unique(np.stack([sig, me, place]), axis=1)  # copies in other batches
            nodes, root = _tree(sig, np.searchsorted(docs, me), place, n[at], bits, num, den)
            other = nodes != root
            return pa.RecordBatch.from_arrays([pa.array(docs[nodes[other]]), pa.array(docs[root[other]])], ["a", "b"])

        now, mine = None, []
        for b in batches:  # a block's rows come one after the other
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != now and mine:
                    yield out()
                    mine = []
                now = row[0]
                mine.append(row[1:])
        if mine:
            yield out()
        tidy()

    rows = docs.mapInArrow(deal, "p int, x binary, d binary, bits binary")
    return rows.repartition("p").sortWithinPartitions("p").mapInArrow(meet, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with all others. Shingles are columns of a matrix, in the order of their first holders, so
    that a slice of it has few rows where documents have little in common."""
    m = len(sets)
    _, first, col, times = np.unique(np.concatenate(sets), return_index=True, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    place = np.empty(len(first), np.int64)
    place[np.lexsort((first, times < 2))] = np.arange(len(first))
    keep = np.flatnonzero(times[col] > 1)
    col, row = place[col[keep]], row[keep]
    sort = np.argsort(col, kind="stable")
    col, row = col[sort], row[sort]
    both = np.zeros((m, m), np.int32)
    for k in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        s = slice(*np.searchsorted(col, [k, k + COLUMNS]))
        rows, at = np.unique(row[s], return_inverse=True)
        x = np.zeros((len(rows), COLUMNS), np.float32)  # exact: sums are at most the columns
        x[at, col[s] - k] = 1
        both[np.ix_(rows, rows)] += (x @ x.T).astype(np.int32)
    return both


def _linked(t: pa.Table, num: int, den: int) -> pa.Table:
    """A tree (a, b) of the links of a tile (id, value)."""
    ids = t.column("id").to_numpy()
    sets = [np.frombuffer(x.as_py(), U64) for x in t.column("value")]
    both, n = overlaps(sets), np.array([len(s) for s in sets], np.int64)
    found = [np.zeros((2, 0), np.int64)]
    for k in range(len(ids)):
        j = k + 1 + np.flatnonzero((den + num) * both[k, k + 1 :].astype(np.int64) >= num * (n[k] + n[k + 1 :]))
        found.append(np.stack([np.full(len(j), k), j]))
    nodes, root = local_roots(*np.concatenate(found, axis=1))
    other = nodes != root
    return pa.table({"a": ids[nodes[other]], "b": ids[root[other]]})


def _links(docs: DataFrame, pairs: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of ids that connect all that link; pairs of set hashes bound what may. A component over a tile's size is dealt
    into parts of half a tile, and any two parts are a tile."""
    near = settle(components(pairs).select(F.col("node").alias("h1"), F.col("root").alias("comp")), "near")
    stand = settle(sets.join(near, "h1").select("id", "h2", "n", "comp"), "stand")
    tiles = F.greatest(F.count(F.lit(1)) / TILE_ROWS, F.sum("n") * 8 / TILE_BYTES)
    parts = stand.groupBy("comp").agg(F.when(tiles > 1, F.ceil(2 * tiles)).otherwise(1).cast("int").alias("parts"))
    dealt = stand.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("id", "h2"), F.col("parts")).cast("int"))
    dealt = settle(dealt.select("id", "h2", "comp", "parts", "part"), "dealt")
    found = dealt.join(_fetch(docs, stand.select("id"), width, lambda s: s).drop("n").dropDuplicates(["id", "h2"]), ["id", "h2"])
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("part"))))
    rows = found.select("comp", "id", "value", "part", other.alias("with"))
    rows = rows.select("comp", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("two"), "id", "value")
    return settle(rows.groupBy("comp", "one", "two").applyInArrow(lambda t: _linked(t, num, den), "a long, b long"), "links")


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of df: id, n_shingles, class_id (the least id that links reach), for a Jaccard of num/den."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = settle(_sets(docs, width), "sets")
    real = rows.filter("n > 0 and id is not null")
    count, total = real.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    order = spark.sparkContext.broadcast(_frequent(docs, width, count, total))
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((total * (den - num) / den + count) / BLOCK), 1)
    shared = settle(_shared(docs, width, order, num, den, blocks), "shared")
    pairs = settle(_candidates(docs, shared, width, order, num, den, blocks), "candidates")
    # one document stands for each set; equal sets are aggregated before the shuffle
    sets = real.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    links = _links(docs, pairs, sets, width, num, den)
    roots = components(links).select(F.col("node").alias("id"), "root")
    # a table of its own, so that AQE can split the join's rows of one very frequent set
    classes = settle(sets.join(roots, "id", "left").select("h1", "h2", F.coalesce("root", "id").alias("class_id")), "classes")
    out = real.join(classes, ["h1", "h2"]).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id")
    rest = rows.filter("n = 0 or id is null").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("class_id"))
    return out.unionByName(rest)


def one_of_each_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of df without those that link to a smaller id; rows with no shingles stay."""
    drop = jaccard_classes(df, id_col, text_col, width, num, den).filter(F.col(id_col) != F.col("class_id")).select(id_col)
    return B.without_ids(df, drop, id_col)

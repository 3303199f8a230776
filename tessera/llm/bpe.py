"""Byte-level BPE encoding and decoding by ranked merges, folded by Spark's higher-order functions.

A batch of texts is split by the tokenizer's pattern into words; each batch carries its distinct words once, as byte
values, in rows of bounded size, followed by its texts as places in that list. The pattern runs once for each distinct
stretch between spaces. Words that are frequent are encoded ahead, once for all batches, by the same expression.
Spark's aggregate() folds the merges of each distinct word: the pair of least rank merges, first from the left, until
no pair has a rank. The rank map is a literal, hashed into buckets so that a look-up doesn't search it; it holds for
each token the one pair that makes it (`merges`). Decoding concatenates the binary pieces of the ids.

Long words are first cut where two bytes meet that no token holds side by side, as no merge can cross there. In what is
still long, all pairs of the least rank merge in one pass, for a number of passes, which is all that runs of few
different bytes need. The rest is folded in blocks, so that a step touches few blocks and the list of their least pairs:
n bytes take time in proportion to n ** 1.5 at most, not to n ** 2.

Texts aren't shuffled. What is shuffled are words and their counts in a sample of texts, to choose those that are
encoded ahead. Memory is bounded by a batch's bytes (or one text); the literal by the vocabulary.

Defined results: a null or empty text has no ids and decodes to an empty one; rows that repeat an id are each encoded;
an empty frame gives an empty frame; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from collections import Counter
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm._common import rows_of, tidy

#: Characters of text that share a list of distinct words; words and places in a row of the fold.
BATCH_BYTES, WORDS_A_ROW, PLACES_A_ROW = 16 << 20, 8192, 1 << 18
#: The words that are encoded ahead: at most so many, counted in about so many texts.
COMMON_WORDS, COMMON_TEXTS = 300_000, 16_000


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: base64 of a token's bytes, and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What is left of a token's bytes once all merges of lesser rank than its own are done."""
    parts, own = [token[k : k + 1] for k in range(len(token))], ranks[token]
    while True:
        found = [ranks.get(a + b, own) for a, b in zip(parts, parts[1:])]
        least = min(found, default=own)
        if least >= own:
            return parts
        at = found.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of what they make.

    Merges go by rising rank, and what lies between two borders of tokens merges as if it stood alone; so a token only
    ever comes from the two halves that its own bytes come to, and one pair for each token is enough. Where a token's
    bytes don't come to two halves (merges never make it), every pair of tokens whose bytes are a token is kept instead.
    """
    halves = {t: _halves(t, ranks) for t in ranks if len(t) > 1}
    if all(len(h) == 2 for h in halves.values()):
        return {(ranks[a], ranks[b]): ranks[t] for t, (a, b) in halves.items()}
    cut = ((t, t[:k], t[k:]) for t in halves for k in range(1, len(t)))
    return {(ranks[a], ranks[b]): ranks[t] for t, a, b in cut if a in ranks and b in ranks}


#: An element of the fold's state is rank * 2**17 + id: of a token, and of the pair that begins with it.
ID_BITS = 17
NO_RANK = (1 << ID_BITS) - 1
#: The id of what stands before and after a word.
OUTSIDE = NO_RANK


def literal_map(pairs: dict[tuple[int, int], int]) -> list[int | None]:
    """The rank map as one array, so that a look-up is two reads: at place `left` stands where the row of that left id
    begins, and `right` places further left * 2**17 + rank. Rows lie over each other, each where it fits."""
    rows: dict[int, list[int]] = {}
    for a, b in pairs:
        rows.setdefault(a, []).append(b)
    ids = 1 + max((max(p) for p in pairs), default=0)
    begin, taken = np.zeros(ids, np.int64), np.zeros(16 * ids + 4096, bool)
    taken[:ids] = True
    first = 0
    for k, (a, own) in enumerate(sorted(rows.items(), key=lambda x: (-len(x[1]), x[0]))):
        if k % 64 == 0:
            free = np.flatnonzero(~taken)
        own, at = np.array(own), None
        first = max(0, first - 256) if len(own) > 4 else 0  # longer rows found nothing before
        while at is None:  # a row's first entry goes to a free place, if the others then fit
            tried = free[first : first + 128] - own[0]
            first += 128
            fits = np.flatnonzero((tried >= 0) & ~taken[tried[:, None] + own].any(axis=1) if len(own) > 1 else (tried >= 0) & ~taken[free[first - 128 : first]])
            at = int(tried[fits[0]]) if len(fits) else None
        begin[a] = at
        taken[at + own] = True
    out: list[int | None] = [None] * (int(np.flatnonzero(taken)[-1]) + 1)
    out[:ids] = begin.tolist()
    for (a, b), r in pairs.items():
        out[int(begin[a]) + b] = a << ID_BITS | r
    return out


def _element(left: Column, right: Column, table: Column) -> Column:
    """The element of a token with the id `left` before one with the id `right`. Another row's entry differs above the
    rank, and a read beyond the map is null; least() turns both into NO_RANK."""
    high = F.shiftleft(left, ID_BITS)
    rank = F.least(F.get(table, (F.get(table, left.cast("int")) + right).cast("int")).bitwiseXOR(high), F.lit(NO_RANK).cast("long"))
    return F.shiftleft(rank, ID_BITS) + left


def _bind(value: Column, f) -> Column:
    """f of a value that is computed once. (aggregate() hands its state to the finish as it is; transform() would copy it.)"""
    return F.aggregate(F.slice(F.array(F.lit(0)), 1, 0), value, lambda a, _: a, f)


def _no_pair(least: Column) -> Column:
    return least >= F.lit(NO_RANK << ID_BITS)


def _merged(e: Column, least: Column, at: Column, table: Column) -> Column:
    """The state after the pair at `at` (from 1), whose element is `least`, has merged; a merged pair's id is its rank."""
    new, own = F.shiftright(least, ID_BITS), lambda x: x.bitwiseAND(F.lit(NO_RANK))
    two = F.array(_element(own(F.get(e, at - 2)), new, table), _element(new, own(F.get(e, at + 1)), table))
    return F.concat(F.slice(e, 1, at - 2), two, F.slice(e, at + 2, F.size(e)))


def fold_merges(word: Column, table: Column) -> Column:
    """Fold the merges of one word.

    The word is an array<long> with an element for each byte and for what stands around it. A rank belongs to one pair,
    so the first of the least elements is the leftmost pair of least rank. A step merges it and looks up the two pairs
    that it touches. A word of n bytes takes at most n - 1 steps.
    """

    def step(e: Column, _: Column) -> Column:
        return _bind(F.array_min(e), lambda least: F.when(_no_pair(least), e).otherwise(_bind(F.array_position(e, least).cast("int"), lambda at: _merged(e, least, at, table))))

    return F.aggregate(F.slice(word, 4, F.size(word)), word, step)


def merge_all(e: Column, table: Column) -> Column:
    """All pairs of the least rank merged at once, from the left.

    As merges go by rising rank (see `merges`), none of lesser rank can come between them. Pairs of one rank overlap only
    where a token meets itself; there every second one of a run counts.
    """
    hit = lambda x, least: x == least

    def runs(least: Column) -> Column:  # for each element where its run of hits begins, by doubling
        first = F.transform(e, lambda x, i: F.when(hit(x, least) & (i > 0) & hit(F.get(e, i - 1), least), i - 1).otherwise(i))
        twice = F.sequence(F.lit(1), F.ceil(F.log2(F.size(e).cast("double"))).cast("int"))
        return F.aggregate(twice, first, lambda a, _: F.transform(a, lambda j: F.get(a, j)))

    def fresh(k: Column) -> Column:  # merged ones are bare ids
        merged = lambda x: x < F.lit(1 << ID_BITS)
        own = lambda x: x.bitwiseAND(F.lit(NO_RANK))
        return F.transform(k, lambda x, i: F.when(merged(x) | merged(F.get(k, i + 1)), _element(own(x), own(F.get(k, i + 1)), table)).otherwise(x))

    def put(least: Column, chosen: Column) -> Column:
        new = F.shiftright(least, ID_BITS)
        marked = F.transform(e, lambda x, i: F.when((i > 0) & F.get(chosen, i - 1), F.lit(-1).cast("long")).when(F.get(chosen, i), new).otherwise(x))
        return _bind(F.filter(marked, lambda x: x >= 0), fresh)

    def of(least: Column) -> Column:
        itself = F.get(e, F.array_position(e, least).cast("int")).bitwiseAND(F.lit(NO_RANK)) == least.bitwiseAND(F.lit(NO_RANK))
        every = F.transform(e, lambda x: hit(x, least))
        second = _bind(runs(least), lambda first: F.transform(e, lambda x, i: hit(x, least) & ((i - F.get(first, i)) % 2 == 0)))
        return F.when(_no_pair(least), e).otherwise(_bind(F.when(itself, second).otherwise(every), lambda chosen: put(least, chosen)))

    return _bind(F.array_min(e), of)


def fold_blocks(word: Column, table: Column, longest: int) -> Column:
    """The same for a long word: its elements lie in blocks by the byte that they begin at, with the least of each block.

    A step works on the block of the least pair and its neighbours. A block is longer than the longest token, so at
    least one token begins in each, and a step reaches from one block before to two behind.
    """
    least_of = lambda x: F.coalesce(F.array_min(x), F.lit(NO_RANK << ID_BITS))
    state = lambda blocks, mins: F.struct(blocks.alias("blocks"), mins.alias("mins"))
    nothing = F.array(F.slice(word, 1, 0))

    def cut(block: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.floor((F.size(word) - 1) / block).cast("int")), lambda k: F.slice(word, k * block + 1, block))
        return _bind(F.concat(nothing, own, nothing, nothing), lambda b: state(b, F.transform(b, least_of)))

    def put(whole: Column, k: Column, new: Column, n: int) -> Column:  # n places from k, from 1
        return F.concat(F.slice(whole, 1, k - 1), new, F.slice(whole, k + n, F.size(whole)))

    def inside(s: Column, k: Column, own: Column, at: Column, least: Column) -> Column:
        return _bind(_merged(own, least, at, table), lambda e: state(put(s["blocks"], k, F.array(e), 1), put(s["mins"], k, F.array(least_of(e)), 1)))

    def across(s: Column, k: Column, near: Column, at: Column, least: Column) -> Column:
        n = [F.size(F.get(near, F.lit(i))) for i in range(4)]
        over = (at == n[1]).cast("int")  # the right one of the pair is the first of the next block
        parts = lambda x: F.array(F.slice(x, 1, n[0]), F.slice(x, n[0] + 1, n[1] - 1 + over), F.slice(x, n[0] + n[1] + over, n[2] - over), F.slice(x, n[0] + n[1] + n[2], n[3]))
        new = _bind(_merged(F.flatten(near), least, n[0] + at, table), parts)
        return _bind(new, lambda p: state(put(s["blocks"], k - 1, p, 4), put(s["mins"], k - 1, F.transform(p, least_of), 4)))

    def touched(s: Column, k: Column, least: Column) -> Column:
        def of(own: Column) -> Column:
            return _bind(F.array_position(own, least).cast("int"), lambda at: F.when((at > 1) & (at + 2 <= F.size(own)), inside(s, k, own, at, least)).otherwise(_bind(F.slice(s["blocks"], k - 1, 4), lambda near: across(s, k, near, at, least))))

        return _bind(F.get(s["blocks"], k - 1), of)

    def step(s: Column, _: Column) -> Column:
        return _bind(F.array_min(s["mins"]), lambda least: F.when(_no_pair(least), s).otherwise(_bind(F.array_position(s["mins"], least).cast("int"), lambda k: touched(s, k, least))))

    block = F.greatest(F.lit(longest + 32), F.sqrt(F.size(word)).cast("int"))
    return F.aggregate(F.slice(word, 4, F.size(word)), _bind(block, cut), step, lambda s: F.flatten(s["blocks"]))


#: Words of more bytes are folded by passes of all pairs of a rank, as many as said, then in blocks.
LONG_WORD, PASSES = 512, 256


def fold_long(word: Column, table: Column, longest: int, passes: int) -> Column:
    return _bind(F.aggregate(F.sequence(F.lit(1), F.lit(passes)), word, lambda e, _: merge_all(e, table)) if passes else word, lambda e: fold_blocks(e, table, longest))


def encode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """The folded state of each word of an array of words."""
    longest, (table, one_pair_each) = max(map(len, ranks)), _literal(ranks)
    passes = PASSES if one_pair_each else 0
    return _bind(F.from_json(F.lit(table), "array<long>"), lambda t: F.transform(words, lambda w: F.when(F.size(w) <= LONG_WORD, fold_merges(w, t)).otherwise(fold_long(w, t, longest, passes))))


_LITERALS: list[tuple[dict, tuple[str, bool]]] = []


def _literal(ranks: dict[bytes, int]) -> tuple[str, bool]:
    """(the literal map of ranks as JSON, whether it holds one pair for each token); the last one is kept."""
    if not _LITERALS or _LITERALS[0][0] is not ranks:
        pairs = merges(ranks)
        _LITERALS[:] = [(ranks, (json.dumps(literal_map(pairs), separators=(",", ":")), len(set(pairs.values())) == len(pairs)))]
    return _LITERALS[0][1]


class _Bytes:
    """What the vocabulary says of single bytes: their ids, the rank of each pair, and which two stand in some token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.rank = np.full((256, 256), NO_RANK, np.int64)
        for t, r in ranks.items():
            if len(t) == 2:
                self.rank[t[0], t[1]] = r
        self.together = np.zeros((256, 256), bool)
        for t in ranks:
            x = np.frombuffer(t, np.uint8)
            self.together[x[:-1], x[1:]] = True

    def cut(self, word: bytes) -> list[bytes]:
        """The word in pieces that no token crosses."""
        x = np.frombuffer(word, np.uint8)
        at = [0, *(np.flatnonzero(~self.together[x[:-1], x[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]


#: Words of more bytes are cut before they are folded.
CUT_BYTES = 48


def _nested(words: list[bytes], known: _Bytes) -> pa.Array:
    """Words as the fold wants them: rank and id of each byte, OUTSIDE at both ends."""
    if not words:
        return pa.array([], pa.list_(pa.int64()))
    data, n = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
    ends, last = np.cumsum(n + 2), np.cumsum(n) - 1
    rank = np.full(len(data), NO_RANK, np.int64)
    rank[:-1] = known.rank[data[:-1], data[1:]]
    rank[last[n > 0]] = NO_RANK
    padded = np.full(int(ends[-1]), NO_RANK << ID_BITS | OUTSIDE, np.int64)
    inside = np.ones(len(padded), bool)
    inside[ends - 1] = inside[ends - n - 2] = False
    padded[inside] = rank << ID_BITS | known.ids[data]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(padded))


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


#: The rows that go through the fold: words of a batch, from place `base`, or (base -1) texts as places of their words.
ROWS = "base int, words array<array<long>>, id array<long>, place array<int>, counts array<int>"
_NAMES = ["base", "words", "id", "place", "counts"]


def _row(base: int, words: pa.Array, ids: list, place, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([base], pa.int32()), _one(words), pa.array([ids], pa.list_(pa.int64())), _one(pa.array(np.asarray(place, np.int32))), pa.array([counts], pa.list_(pa.int32()))], _NAMES)


class _Places(dict):
    """Piece of a word -> place; one that isn't there gets the next place."""

    def __missing__(self, piece: bytes) -> int:
        place = self[piece] = len(self)
        return place


#: White space before a space: there, the stretches between spaces aren't split by the pattern on their own.
_SPACES = re.compile(r"\s ")


class _Stretches(dict):
    """Stretch of text -> number; a new one is split by the pattern, and the places of its pieces are kept.

    A space after anything but white space begins a word, whatever stands around it, so a text is split stretch by
    stretch. Stretches are known without that space, those that begin otherwise have a table of their own.
    """

    def __init__(self, find, place_of, known: _Bytes, before: str, flat: array, ends: array):
        self.find, self.place_of, self.bytes, self.before, self.flat, self.ends = find, place_of, known, before, flat, ends

    def __missing__(self, stretch: str) -> int:
        for w in self.find(self.before + stretch):
            raw = w.encode()
            self.flat.extend(map(self.place_of, self.bytes.cut(raw) if len(raw) > CUT_BYTES else (raw,)))
        number = self[stretch] = len(self.ends)
        self.ends.append(len(self.flat))
        return number


def _joined(parts: list[str]) -> list[str]:
    """Stretches of a text that was split at each space, where white space stands before a space."""
    out = [parts[0]]
    for before, x in zip(parts, parts[1:]):
        if before and not before[-1].isspace():
            out.append(" " + x)
        else:
            out[-1] += " " + x
    return out


def _split(pattern: str, ranks: dict[bytes, int], size: int, common):
    """Batches of (id, text) -> for each about `size` bytes of text rows of distinct words, then rows of texts.

    Words that are encoded ahead (`common`, a broadcast) have the first places and aren't sent again.
    """
    import regex

    def f(batches):
        find, single = regex.compile(pattern).findall, _Bytes(ranks)
        known = _Places((w, k) for k, w in enumerate(common.value[0].to_pylist()))
        ahead = len(known)
        flat, ends = array("i"), array("i")
        other, spaced = (_Stretches(find, known.__getitem__, single, x, flat, ends) for x in ("", " "))
        number_of = spaced.__getitem__
        number, texts, counts, seen = array("i"), [], [], 0

        def out():
            new = list(islice(known, ahead, None))
            for k in range(0, len(new), WORDS_A_ROW):
                yield _row(ahead + k, _nested(new[k : k + WORDS_A_ROW], single), [], [], [])
            for w in new:
                del known[w]
            other.clear()
            spaced.clear()
            numbers, places = np.array(number, np.int32), np.array(flat, np.int32)
            begin = np.concatenate([[0], np.array(ends, np.int64)])
            length, to = np.diff(begin), np.concatenate([[0], np.cumsum(counts)])
            del flat[:], ends[:], number[:], counts[:]
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(to, to[i] + PLACES_A_ROW, "right")) - 1)
                used = numbers[to[i] : to[j]]
                upto = np.concatenate([[0], np.cumsum(length[used])])
                place = places[np.arange(upto[-1]) + np.repeat(begin[used] - upto[:-1], length[used])]
                yield _row(-1, _nested([], single), texts[i:j], place, np.diff(upto[to[i : j + 1] - to[i]]).tolist())
                i = j
            texts.clear()

        b = None
        for b in batches:
            for start in range(0, b.num_rows, 64):
                for i, t in zip(b.column(0).slice(start, 64).to_pylist(), b.column(1).slice(start, 64).to_pylist()):
                    parts, before = (t or "").split(" "), len(number)
                    if t and _SPACES.search(t):
                        number.extend(map(other.__getitem__, _joined(parts)))
                    else:
                        parts = iter(parts)
                        number.append(other[next(parts)])
                        number.extend(map(number_of, parts))
                    texts.append(i)
                    counts.append(len(number) - before)
                    seen += len(t or "")
                if seen >= size:
                    yield from out()
                    seen = 0
        if texts:
            yield from out()
        known.clear()
        del b
        tidy()

    return f


def common_words(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str, most: int):
    """A broadcast of (words, lengths, ids): the most frequent words of some texts, encoded ahead by the same fold.

    It only decides which words are encoded once for all instead of once for each batch; at most `most` words, so its
    size is bounded.
    """
    import regex

    def count(batches):
        find = regex.compile(pattern).findall
        for b in batches:
            stretches, n = Counter(), Counter()
            for t in b.column(0).to_pylist():
                parts = (t or "").split(" ")
                stretches.update(parts if not _SPACES.search(t or "") else _joined(parts))
            for x, k in stretches.items():
                for w in find(" " + x):
                    n[w] += k
            n = {raw: k for w, k in n.items() if len(raw := w.encode()) <= CUT_BYTES}
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["w", "n"])

    send = df.sparkSession.sparkContext.broadcast
    nothing = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    if not most:
        return send(nothing)
    some = df.select(F.col(text_col).cast("string")).sample(min(1.0, COMMON_TEXTS / max(df.count(), 1)), seed=1)
    w = some.mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "w").limit(most).select("w")

    def rows(batches):
        known = _Bytes(ranks)
        for b in batches:
            for k in range(0, b.num_rows, WORDS_A_ROW):
                own = b.column(0).slice(k, WORDS_A_ROW)
                yield pa.RecordBatch.from_arrays([_one(own), _one(_nested(own.to_pylist(), known))], ["names", "words"])

    sent = w.repartition(16).mapInArrow(rows, "names array<binary>, words array<array<long>>")
    got = sent.select("names", encode_words(F.col("words"), ranks).alias("codes")).mapInArrow(_packed, "names array<binary>, lengths binary, ids binary").toArrow()
    if not got.num_rows:
        return send(nothing)
    join = lambda c, kind: np.frombuffer(b"".join(got.column(c).to_pylist()), kind)
    return send((got.column("names").combine_chunks().flatten(), join("lengths", np.int64), join("ids", np.int32)))


def _ids_of(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, ids of all words) of folded states."""
    flat = np.asarray(codes.flatten()) & NO_RANK
    real = flat != OUTSIDE
    cut = np.concatenate([[0], np.cumsum(real)])[np.asarray(codes.offsets) - codes.offsets[0].as_py()]
    return np.diff(cut), flat[real].astype(np.int32)


def _packed(batches):
    for b in batches:
        for r in range(b.num_rows):
            n, ids = _ids_of(b.column(1)[r].values)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1), pa.array([n.astype(np.int64).tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], ["names", "lengths", "ids"])


def encoded(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = BATCH_BYTES, ahead: int = COMMON_WORDS):
    """(frame of ROWS with the words' folded states as codes, the broadcast of words encoded ahead)."""
    common = common_words(df, ranks, pattern, text_col, ahead)
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_split(pattern, ranks, size, common), ROWS)
    return rows.select("base", encode_words(F.col("words"), ranks).alias("codes"), "id", "place", "counts"), common


class _Words:
    """The ids of a batch's words, laid end to end, and where each word's begin; words encoded ahead come first."""

    def __init__(self, lengths: np.ndarray, ids: np.ndarray):
        self.lengths, self.ids, self.ahead, self.joined = [lengths], [ids], len(lengths), None

    def add(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.lengths.append(lengths)
        self.ids.append(ids)
        self.joined = None

    def restart(self) -> None:
        del self.lengths[1:], self.ids[1:]
        self.joined = None

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids of each place end, the ids of all places)."""
        if self.joined is None:
            n = np.concatenate(self.lengths)
            self.joined = n, np.cumsum(n) - n, np.concatenate(self.ids)
        n, start, ids = self.joined
        own = n[place]
        upto = np.cumsum(own)
        return upto, ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(start[place] - (upto - own), own)]


def _laid(ids: pa.ListArray, names: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(where each list of ids begins and ends, the names of all their ids end to end)."""
    found = names.take(ids.flatten())
    _, at, data = found.buffers()
    at = np.frombuffer(at, np.int64)[found.offset : found.offset + len(found) + 1]
    return at[np.asarray(ids.offsets) - ids.offsets[0].as_py()], memoryview(data if data is not None else b"")


def _names(of: dict[int, bytes]) -> pa.Array:
    return pa.array([of.get(k) for k in range(max(of, default=-1) + 1)], pa.large_binary())


def _ids_of_texts(common):
    """Batches of encoded() -> (id, ids as an array) of each text."""

    def f(batches):
        words = _Words(*common.value[1:])
        for b in batches:
            for r in range(b.num_rows):
                base = b.column(0)[r].as_py()
                if base >= 0:
                    if base == words.ahead:
                        words.restart()
                    words.add(*_ids_of(b.column(1)[r].values))
                    continue
                upto, ids = words.of(np.asarray(b.column(3)[r].values))
                ends = np.concatenate([[0], np.cumsum(np.asarray(b.column(4)[r].values))])
                cut = np.concatenate([[0], upto])[ends]
                yield b.column(2)[r].values, pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))
        del words
        tidy()

    return f


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = BATCH_BYTES, ahead: int = COMMON_WORDS) -> DataFrame:
    """(id, ids) of every row: the text's token ids as an array<int>."""
    rows, common = encoded(df, ranks, pattern, id_col, text_col, size, ahead)
    texts = _ids_of_texts(common)

    def f(batches):
        for own, ids in texts(batches):
            yield pa.RecordBatch.from_arrays([own, ids], [id_col, "ids"])

    return rows.mapInArrow(f, f"`{id_col}` long, ids array<int>")


def decode(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of every row: the bytes that its ids stand for. No ids, or null, give none; an unknown id is an error."""

    def f(batches):
        pieces = _names({r: token for token, r in ranks.items()})
        for b in rows_of(batches, 256):
            ids = b.column(1).fill_null([])
            unknown = pc.filter(ids.flatten(), pc.is_null(pieces.take(ids.flatten())))
            if len(unknown):
                raise ValueError(f"no token has the id {unknown[0]}")
            at, data = _laid(ids, pieces)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bytes(data[x:y]) for x, y in zip(at, at[1:])], pa.binary())], [id_col, "bytes"])

    return df.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(f, f"`{id_col}` long, bytes binary")


def digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = BATCH_BYTES, ahead: int = COMMON_WORDS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: of the ids that encode() gives and of their bytes.

    The ids are hashed where they are made, so they don't go through the JVM.
    """
    rows, common = encoded(df, ranks, pattern, id_col, text_col, size, ahead)
    texts = _ids_of_texts(common)

    def f(batches):
        pieces = _names({r: token for token, r in ranks.items()})
        decimal = _names({r: b"%d " % r for r in ranks.values()})
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for own, ids in texts(batches):
            at, data = _laid(ids, decimal)
            ids_sha = [sha(data[x : max(x, y - 1)]) for x, y in zip(at, at[1:])]
            at, data = _laid(ids, pieces)
            decoded_sha = [sha(data[x:y]) for x, y in zip(at, at[1:])]
            n = np.diff(np.asarray(ids.offsets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([own, pa.array(n), pa.array(ids_sha), pa.array(decoded_sha)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(f, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")

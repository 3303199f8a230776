"""Exact dedup and the n-gram join against brute force, and on odd rows."""

import hashlib
import re

import duckdb
import pytest

from tessera.llm import queries
from tessera.llm.exact_dedup import drop_copies, exact_dedup
from tessera.llm.ngram_join import Bands, jaccard_classes, one_of_each_class

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, row int, n int, u int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3) for i, t in rows], SCHEMA)


def brute_classes(rows, width, num, den):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows)))


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 50)])
def test_join_matches_brute_force(spark, width, num):
    rows = [(r[0], r[1]) for r in duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    words = [f"w{k}" for k in range(60)]
    for k in range(40):  # a chain of near copies around the threshold
        w = list(words)
        for j in range(k % 8):
            w[(k * 7 + j * 11) % 60] = f"x{k}{j}"
        rows.append((5000 + k, " ".join(w)))
    rows += [(6000, None), (6001, ""), (6002, " \t\n"), (6003, "One"), (6004, "one"), (6005, "a b"), (6006, "A\x0bB"), (6007, " a b")]
    got = sorted(tuple(r) for r in jaccard_classes(frame(spark, rows), width=width, num=num, den=100).collect())
    assert got == brute_classes(rows, width, num, 100)


def test_join_large_component_is_tiled(spark, monkeypatch):
    import tessera.llm.ngram_join as j

    monkeypatch.setattr(j, "TILE_ROWS", 8)
    rows = [(k, " ".join(f"w{x}" if (x * 31 + k) % 17 or k % 3 else f"y{k % 5}" for x in range(30 + k % 9))) for k in range(90)]
    got = sorted(tuple(r) for r in jaccard_classes(frame(spark, rows), width=1, num=70, den=100).collect())
    assert got == brute_classes(rows, 1, 70, 100)


def test_join_hot_signatures_meet_block_by_block(spark, monkeypatch):
    import tessera.llm.ngram_join as j

    monkeypatch.setattr(j, "BLOCK", 200)
    words = [f"w{x}" for x in range(80)]
    rows = [(k, " ".join([*words, f"y{k}"] if k % 3 else [*words[:40], *[f"z{k}_{x}" for x in range(5)]])) for k in range(240)]
    got = sorted(tuple(r) for r in jaccard_classes(frame(spark, rows), width=3, num=80, den=100).collect())
    assert got == brute_classes(rows, 3, 80, 100)


def test_join_large_component_pairs_only_what_may_link(spark, monkeypatch):
    """A passage that all share chains them; what grows with the pairs of a component isn't compared."""
    import tessera.llm.ngram_join as j

    passage, asked = [f"p{x}" for x in range(12)], []
    rows = [(k, " ".join([*[f"w{k}_{x}" for x in range(30 + k % 7)], *passage])) for k in range(400)]
    rows += [(1000 + k, " ".join([*[f"w{k}_{x}" for x in range(30 + k % 7)], *passage, *["z"] * (k % 3)])) for k in range(0, 400, 9)]
    rows += [(2000 + k, " ".join(["same", *[f"v{x}" for x in range(40 - k % 4)], *(f"u{k}_{x}" for x in range(k % 9)), *passage])) for k in range(60)]
    monkeypatch.setattr(j, "TILE_ROWS", 8)
    links = j._links
    monkeypatch.setattr(j, "_links", lambda docs, pairs, *more: asked.append(pairs.distinct().count()) or links(docs, pairs, *more))
    got = sorted(tuple(r) for r in jaccard_classes(frame(spark, rows), width=3, num=80, den=100).collect())
    assert got == brute_classes(rows, 3, 80, 100)
    assert sum(asked) < 10 * len(rows)


@pytest.mark.parametrize("piece", [1, 50, 10**6])
def test_partners_are_the_pairs_that_may_link(monkeypatch, piece):
    import numpy as np
    import tessera.llm.ngram_join as j

    monkeypatch.setattr(j, "PIECE", piece)
    rng = np.random.default_rng(3)
    sig, me = np.divmod(np.unique(rng.integers(0, 9 * 60, 200)), 60)
    n, label = rng.integers(5, 30, 60)[me], rng.integers(0, 6, 60)[me] // 3
    place = rng.integers(0, 6, len(me))
    want = {(min(me[a], me[b]), max(me[a], me[b])) for a in range(len(me)) for b in range(a) if sig[a] == sig[b] and label[a] != label[b] and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b]) and j._may_link(n[a], n[b], place[a] + place[b], 80, 100)}
    assert want == {tuple(x) for two in j._partners(sig, me, label, n, place, 80, 100) for x in two.T}


@pytest.mark.parametrize("tile", [2048, 32])
def test_join_near_copies_that_hardly_link_give_rows_not_pairs(spark, monkeypatch, tile):
    """Copies of one text, each edited in places of its own: near the threshold, so that neither shingles nor sketches rule out
    their pairs, and only some of them link."""
    import numpy as np
    import tessera.llm.ngram_join as j

    rng, made = np.random.default_rng(7), {}
    rows = []
    for k in range(300):
        w = [f"w{x}" for x in range(150)]
        for x in rng.integers(0, 150, 1 + k % 3):
            w[x] = f"x{k}_{x}"
        rows.append((k, " ".join(w)))
    settle = j.settle

    def counted(df, name):
        out = settle(df, name)
        if out.columns[:2] == ["a", "b"] or "a_id" in out.columns or "a2" in out.columns:
            made[name] = max(out.count(), made.get(name, 0))
        return out

    monkeypatch.setattr(j, "settle", counted)
    monkeypatch.setattr(j, "TILE_ROWS", tile)
    got = sorted(tuple(r) for r in jaccard_classes(frame(spark, rows), width=3, num=90, den=100).collect())
    assert got == brute_classes(rows, 3, 90, 100)
    assert 1 < len({r[2] for r in got}) < 250
    # trees: one for each block or tile, of which a document is in as many as it has shared shingles or other parts
    assert made["candidates"] < 10 * len(rows) and made["links"] < (1 if tile == 2048 else 20) * len(rows) and "pairs" not in made


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100)])
def test_sketches_rule_out_no_link_and_overlaps_are_exact(monkeypatch, num, den):
    import numpy as np
    import tessera.llm.ngram_join as j

    monkeypatch.setattr(j, "COMPARED", 4096)
    monkeypatch.setattr(j, "COLUMNS", 64)
    rng, sets = np.random.default_rng(num), [np.array([5], np.uint64)]
    for size in (1, 3, 40, 500, 4000):
        base = rng.integers(0, 2**64, size, np.uint64)
        for _ in range(12):
            sets.append(np.unique(np.concatenate([base[rng.random(size) > 0.04], rng.integers(0, 2**64, 1 + size // 30, np.uint64)])))
    n = np.array([len(s) for s in sets])
    bits = [j.sketch(s, int(w)) for s, w in zip(sets, j.sketch_bits(n, num, den))]
    both = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    assert (j.overlaps(sets) == both)[~np.eye(len(sets), dtype=bool)].all()
    a, b = np.triu_indices(len(sets), 1)
    link = den * both[a, b] >= num * (n[a] + n[b] - both[a, b])
    alike = j._alike(a, b, n, bits, num, den)
    assert link.any() and not (link & ~alike).any() and not alike[(both[a, b] < 3) & (n[a] > 300)].any()


def test_parts_exceed_differences():
    for num in (50, 80, 90):
        b = Bands(num, 100)
        for n in range(1, 3000):
            band = b.of(n)
            assert b.low(band) <= n < b.low(band + 1)
            k, d = b.parts(band)
            assert k > d


def test_exact_matches_brute_force_and_sql(spark):
    rows = [(1, "a b"), (2, "ab  "), (3, "ab"), (4, None), (5, ""), (6, " \n"), (7, "x" * 70000), (8, "x" * 70000), (3, "ab"), (None, "q"), (None, "q"), (9, "q"), (10, "a b")]
    got = exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["keep_id"] == 2 and by[3]["group_size"] == 4 and by[4]["keep_id"] == 6 and by[9]["keep_id"] == 9 and by[10]["kept"]
    assert by[7]["kept"] and not by[8]["kept"]
    assert sum(r["kept"] for r in got) == 5
    assert by[3]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    kept = drop_copies(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 6, 7, 9, 10] and kept.columns == SCHEMA.replace(",", "").split()[::2]


def test_exact_small_filter_stays_exact(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = sorted(map(str, exact_dedup(df).drop("passed_through").collect()))
    b = sorted(map(str, exact_dedup(df, max_bits=1 << 10).drop("passed_through").collect()))
    assert a == b


def test_empty(spark):
    e = frame(spark, []).limit(0)
    assert exact_dedup(e).count() == 0 and drop_copies(e).count() == 0 and jaccard_classes(e).count() == 0 and one_of_each_class(e).count() == 0


def test_one_of_each_class(spark):
    t = " ".join(f"w{k}" for k in range(100))
    rows = [(1, t), (2, t + " z"), (3, "other words entirely here now"), (4, None), (5, None), (6, t)]
    got = one_of_each_class(frame(spark, rows))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4, 5] and "text" in got.columns


def test_queries(spark):
    for name in ("op1_exact_dedup", "op6_ngram_jaccard"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200

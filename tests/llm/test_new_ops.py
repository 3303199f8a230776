"""Vector codes, decontamination and source divergence against plain Python, with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as dec, divergence as div, vector_codes as vc

UP = {c: c + 32 for c in range(65, 91)}


# vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, tuple(floor(1024 * Fraction(x)) for x in v), label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts if kept else 0
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(v) // len(groups[k]) for v in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])]
    out, by_label = [], Counter()
    for (i, _, label), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, by_label[label], digest) for i, code, error, label in out)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, prev string"


def coded(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS)
    return Counter(map(tuple, vc.codes(df, **options).collect()))


def test_vector_codes_odd_rows(spark):
    rng = np.random.default_rng(1)
    grid = lambda: [float(x) for x in rng.integers(-3, 4, 8) / 4]  # noqa: E731  many ties
    rows = [(int(i), grid(), None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(300)]
    rows += [rows[3], rows[3], (rows[5][0], grid(), 9), (None, grid(), 1), (None, grid(), None)]
    rows += [(900, None, 1), (901, [None] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0] * 7 + [float("-inf")], 2)]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, rows, entries=5, rounds=2, parts=2) == plain_codes(rows, 2, 5, 2)
    assert coded(spark, rows[:3]) == plain_codes(rows[:3])
    assert not coded(spark, []) and not coded(spark, [(1, None, 1)])
    assert coded(spark, [(1, [], 1), (2, [], None)]) == plain_codes([(1, [], 1), (2, [], None)])


def test_vector_codes_lengths_and_sizes(spark):
    with pytest.raises(Exception, match="components, as the first has"):
        coded(spark, [(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)])
    with pytest.raises(ValueError, match="equal parts"):
        coded(spark, [(1, [0.0] * 6, 1)])
    with pytest.raises(Exception, match="64 bits"):
        coded(spark, [(1, [1e30] * 4, 1)])
    large = [(i, [float(2**18 * (i % 5)), 2.0**19, -(2.0**15) * i, 3.0], 1) for i in range(20)]
    assert coded(spark, large, entries=3) == plain_codes(large, 4, 3)


def test_exponion_looks_at_part_of_the_book():
    rng = np.random.default_rng(2)
    centres = rng.integers(-50_000, 50_000, (256, 4))
    x = centres[rng.integers(0, 256, 4000)] + rng.integers(-300, 300, (4000, 4))
    book = vc.Book(centres)
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    for start in (np.zeros(4000, np.int64), d.argmin(1)):
        best, least, looked = vc.exponion(x, book, start)
        assert (best == d.argmin(1)).all() and (least == d.min(1)).all()
    assert looked < 0.2 * d.size  # from the right entry a first block of neighbours is enough
    assert (vc.squares(x, centres) == d).all()
    assert (vc.squares(x << 10, centres << 10) == d << 20).all()  # too large for floating point


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items, width=10):
    windows = defaultdict(set)
    for i, text in items:
        w = WORD.findall((text or "").translate(UP))
        for s in range(max(len(w) - width + 1, 1) if w else 0):
            windows[tuple(w[s : s + width])].add(i)
    out = []
    for i, text in docs:
        w, hit, found = WORD.findall((text or "").translate(UP)), set(), set()
        for s in range(len(w)):
            for n in range(1, width + 1):
                if s + n <= len(w) and tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= {str(x) for x in windows[tuple(w[s : s + n])] if x is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


TEXT = "doc_id long, text string, key string, w string, h int, n_words int, window string"
ITEM = "item_id long, text string, key string, len int, at string"


def cleaned(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "k", "w", 1, 2, "x") for r in docs], TEXT)
    i = spark.createDataFrame([(*r, "k", 1, "a") for r in items], ITEM)
    return Counter(map(tuple, dec.decontaminate(d, i, **options).collect()))


def texts():
    rng = np.random.default_rng(3)
    say = lambda n, k: " ".join(f"w{x}" for x in rng.integers(0, k, n))
    items = [(i, say(int(n), 30)) for i, n in enumerate((25, 14, 10, 10, 9, 3, 2, 1, 40))]
    items += [(20, "Ünï Café über\talles; so-so, 1 2 3 4 5 6"), (21, ""), (22, None), (23, "?! -"), (3, "another text with id three " * 3), (None, "no id here " * 4), (24, items[0][1])]
    docs = [(i, say(200, 40)) for i in range(30)]
    for i in range(12):
        own = items[i % 9][1].split(" ")
        docs.append((100 + i, f"{say(20, 1000)} {' '.join(own[: 10 + i % 3]).upper()}, {items[(i + 4) % 9][1]}!{say(5, 9)}"))
    docs += [(200, "x ünï café ÜBER über alles so so 1 2 3 4 5 6"), (201, "ünï café über alles so so 1 2 3 4"), (202, "no id here no id here no id here no"), (203, ""), (204, None), (None, items[1][1]), (205, "w1"), (205, "w1"), (206, say(30_000, 12)), (207, items[0][1][:-1])]
    return docs, items


def test_decontaminate_equals_plain(spark):
    docs, items = texts()
    assert cleaned(spark, docs, items) == plain_hits(docs, items)


def test_decontaminate_many_windows_and_other_widths(spark, monkeypatch):
    docs, items = texts()
    monkeypatch.setattr(dec, "MOST_BROADCAST", 0)
    assert cleaned(spark, docs, items) == plain_hits(docs, items)
    long_items = [x for x in items if x[1] and len(x[1].split()) > 8]
    assert cleaned(spark, docs, long_items, width=4, shingle=2) == plain_hits(docs, long_items, 4)


def test_decontaminate_empty_tables(spark):
    docs, items = texts()
    assert cleaned(spark, docs[:3], []) == plain_hits(docs[:3], [])
    assert cleaned(spark, docs[:3], [(1, "")]) == plain_hits(docs[:3], [])
    assert not cleaned(spark, [], items)


# divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(docs, least=10, most=10):
    uses, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source, t = lang or "", source or "", TERM.findall((text or "").translate(UP))
        groups.add((lang, source))
        uses[lang, source].update(t)
        uses[lang].update(t)
        seen[lang].update(set(t))
    kept = {lang: {t for t, n in seen[lang].items() if n >= least} for lang, _ in groups}
    total = {g: sum(n for t, n in uses[g].items() if t in kept[g if isinstance(g, str) else g[0]]) for g in [*groups, *kept]}
    p = lambda g, t, lang: 1 + 1_000_000_000 * (uses[g][t] + 2) // (total[g] + 2 * len(kept[lang]))
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, s in groups:
        pairs = [(sum(f(p((lang, s), t, lang), p((lang, o), t, lang)) for t in kept[lang]), o) for l2, o in groups if l2 == lang and o != s]
        terms = [(f(p((lang, s), t, lang), p(lang, t, lang)), t) for t in kept[lang] if uses[lang, s][t] and p((lang, s), t, lang) > p(lang, t, lang)]
        for part, found, n in (("pair", pairs, len(pairs)), ("term", terms, most)):
            out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n])]
    return Counter(out)


WIDE = "text string, lang string, source string, term string, n int, value string, item string, rank int"


def audited(spark, docs, **options):
    df = spark.createDataFrame([(*r, "t", 1, "v", "i", 2) for r in docs], WIDE)
    return Counter(map(tuple, div.audit(df, **options).collect()))


def test_audit_equals_plain(spark):
    rng = np.random.default_rng(4)
    letters = ["a", "B", "ä", "Ä", "ß", "漢", "𝒳", "z"]
    say = lambda n: " ".join("".join(rng.choice(letters, rng.integers(1, 3))) for _ in range(n))
    docs = [(say(int(rng.integers(0, 60))), str(rng.choice(["en", "de"])), f"s{rng.integers(0, 5)}") for _ in range(150)]
    docs += [(None, "en", "empty"), ("", "en", None), ("12 34 !", "de", "digits"), ("only here", "xx", "one"), ("rare", "xx", "two"), (None, None, None), ("a b", None, "s"), ("x " * 30_000, "en", "long")]
    docs += [docs[0]] * 4 + [("𝒳 tie ﬀ", "tt", s) for s in ("b", "a", "ﬀ", "𝒳") for _ in range(3)]
    assert audited(spark, docs) == plain_audit(docs)
    assert audited(spark, docs, least_docs=1, most_terms=3) == plain_audit(docs, 1, 3)
    assert not audited(spark, [])


def test_shares_of_huge_counts(spark):
    n = 7_000_000_000_000_000_123
    row = spark.range(1).select(div.share(F.lit(n), F.lit(n + 5), F.lit(3)).alias("p")).first()
    assert row["p"] == 1 + 1_000_000_000 * (n + 2) // (n + 5 + 6)

"""Listings, substrings, checks, prefixes and layers against plain Python, with odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import checks, configuration as conf, runs, substrings
from tessera.sources import folders


def test_listing_takes_filters_along(spark, tmp_path):
    for name in ("train/a.txt", "train/b.png", "train/deep/c.txt", "val/a.txt", "val/ä.txt", "top.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * len(name))
    (tmp_path / "empty").mkdir()
    every = folders.list_folders(spark, str(tmp_path))
    got = Counter((r["folder"], r["name"], r["is_dir"], r["length"]) for r in every.collect())
    assert got == Counter([("train", "a.txt", False, 11), ("train", "b.png", False, 11), ("train", "deep", True, None), ("train", "c.txt", False, 16), ("val", "a.txt", False, 9), ("val", "ä.txt", False, 9), ("", "top.txt", False, 7), ("", "train", True, None), ("", "val", True, None), ("", "empty", True, None)])
    names = lambda condition: sorted(r["name"] for r in every.filter(condition).collect())
    assert names("folder = 'val'") == ["a.txt", "ä.txt"] and names("folder IN ('train', 'val') AND endswith(name, '.png')") == ["b.png"]
    assert names("startswith(name, 'a') AND length > 9") == ["a.txt"] and names("folder = 'none'") == names("folder = 'val' AND folder = 'train'") == []
    assert names("folder <> 'val' AND NOT is_dir AND name LIKE '%.txt'") == ["a.txt", "c.txt", "top.txt"] and names("folder IS NULL") == []
    assert every.filter("folder = 'val'").rdd.getNumPartitions() == 1 and every.rdd.getNumPartitions() == 4
    assert folders.list_folders(spark, str(tmp_path / "gone")).count() == 0


def test_substrings_equal_contains(spark, monkeypatch):
    texts = [(1, "abcabc"), (1, "abcabc"), (2, ""), (3, None), (None, "xabx"), (4, "bc é漢字 " * 5000)]
    patterns = ["abc", "bc", "ab", "", "é漢", "zz", None, "abc"]
    want = Counter((i, p) for i, t in texts for p in set(patterns) if t is not None and p is not None and p in t)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    find = lambda p: Counter(map(tuple, substrings.containing(frame(texts, "i long, t string"), frame([(x,) for x in p], "p string"), "i", "t", "p").collect()))
    assert find(patterns) == want
    monkeypatch.setattr(substrings, "MOST_CHARS", 4)
    assert find(patterns) == want and not find([]) and not find([None])


def test_checks_of_one_scan(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    got = checks.run_checks(t, {"two": lambda: F.count(F.lit(1)) == 2, "null": lambda: F.max(F.lit(None).cast("boolean")), "python": lambda: 1 / 0, "raises": lambda: F.max(F.raise_error(F.lit("no"))).cast("boolean"), "last": lambda: F.sum("n") == 4}).collect()
    assert [(r["ord"], r["check"], r["passed"]) for r in got] == [(0, "two", True), (1, "null", False), (2, "python", False), (3, "raises", False), (4, "last", False)]
    assert [r["error"] is None for r in got] == [True, True, False, False, True] and got[0]["line"].endswith("PASSED")
    assert checks.run_checks(t.limit(0), {"none": lambda: F.count(F.lit(1)) == 0}).first()["passed"] and checks.run_checks(t, {}).count() == 0


def test_many_prefixes(spark):
    words = ["part", "party", "pär", "p", "", "zoo", "part", None] + [f"hot{i:03d}" for i in range(500)]
    typed = ["", "p", "par", "pa", "hot", "hot1", "nothing", "zoological", None, "p"]
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    got = runs.complete_many(frame(typed, "typed"), frame(words, "candidate"), 3).collect()
    distinct = sorted({w for w in words if w is not None}, key=lambda w: w.encode())
    assert {tuple(r) for r in got} == {(t, k + 1, w) for t in set(typed) - {None} for k, w in enumerate([w for w in distinct if w.startswith(t)][:3])} and len(got) == 3 + 3 + 2 + 2 + 3 + 3
    assert runs.complete_many(frame([None], "typed"), frame(words, "candidate"), 3).count() == 0


def test_layers_in_one_exchange(spark):
    rows = [("epochs", 0, 0, "100"), ("Epochs", 1, 0, "50"), ("EPOCHS", 1, 1, None), ("epochs", 3, 0, None), ("amp", 0, 0, "true"), ("amp", 3, 0, "false"), ("none", 3, 0, None), (None, 1, 0, "x")]
    df = spark.createDataFrame(rows, "key string, layer int, order int, value string")
    out = conf.overlay_layers(df, F.col("layer") < 3)
    assert {tuple(r) for r in out.collect()} == {("EPOCHS", 1, None), ("AMP", 3, "false"), (None, 1, "x")}
    assert out._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    assert conf.overlay_layers(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("previous, typed, n", [("--device", "c", 2), ("--model", None, 0), ("train", "--no-", 2), (None, "--", 13)])
def test_complete_typed(spark, previous, typed, n):
    df = spark.createDataFrame([(previous, typed)], "previous string, typed string")
    assert runs.complete_typed(df).count() == n

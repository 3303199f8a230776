"""Truth tables, properties and odd inputs of the library."""

import itertools
import json
import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import configuration as conf, detections as det, documents, runs
from tessera.session import scratch_path
from tessera.sources import files, profiles
from tessera.streaming import jobs

# configuration

YAML = {
    "full": "training:\n  workers: 4\n  device: cpu\n  lr0: 1.0e-3\n  half: on\nmodel:\n  architecture: m.pt\n",
    "nulls": "training:\n  workers:\n  epochs: null\nmps: {}\n",
    "blank": "training:\n  workers: 1\nmps:\n",
    "empty": "",
    "octal": "environment:\n  seed: 010\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in YAML.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    return str(tmp_path)


def test_profiles_resolve_with_presence(spark, folder):
    got = {r["profile_name"]: r for r in conf.resolve(profiles.read_profiles(spark, folder)).collect()}
    assert set(got) == set(YAML)
    assert (got["full"]["workers"], got["full"]["device"], got["full"]["lr0"], got["full"]["half"], got["full"]["architecture"]) == (4, "cpu", 0.001, True, "m.pt")
    assert got["full"]["epochs"] == 100 and got["full"]["error"] is None
    assert got["nulls"]["workers"] is None and got["nulls"]["epochs"] is None and got["nulls"]["pin_memory"] is False and got["nulls"]["error"] is None
    assert got["blank"]["error"] == "section mps is blank" and got["empty"]["error"] == "the file is empty" and got["octal"]["seed"] == 8


def test_registry():
    assert len(conf.REGISTRY) == 66 and sum(r[5] for r in conf.REGISTRY) == 40 and len({r[1] for r in conf.REGISTRY}) == 66


def test_defaults_and_parameters(spark):
    one = spark.createDataFrame([("p", {"training": {}})], f"profile_name string, sections {profiles.SECTIONS}")
    r = conf.resolve(one)
    row = r.first().asDict()
    assert all(row[key] == default for _, key, _, default, _, _ in conf.REGISTRY)
    p = conf.training_parameters(conf.with_paths(r, F.lit("/p")))
    assert len(p.columns) == 47 == len(set(p.columns))
    got = p.first().asDict()
    assert got["data"] == "/p/training_data/data.yaml" and got["project"] == "/p/training_data/runs" and got["name"] == "run" and got["imgsz"] == 640 and got["val"] and got["exist_ok"]


def test_snapshot_loses_or_keeps(spark):
    one = conf.resolve(spark.createDataFrame([("p", {"training": {"hsv_h": "0.5", "epochs": None}})], f"profile_name string, sections {profiles.SECTIONS}"))
    count = lambda d: sum(map(len, json.loads(d.first()["document"]).values()))
    assert count(conf.snapshot(one)) == 40 and count(conf.snapshot(one, complete=True)) == 66
    path = scratch_path(spark, "snapshot")
    profiles.write_snapshot(conf.snapshot(one, complete=True), path)
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    assert "hsv_h: 0.5" in text and "epochs: null" in text


def test_device_rules_truth_table_and_idempotence(spark):
    cases = list(itertools.product(["mps", "cpu", "cuda"], [True, False], [0, 4], [True, False], [True, False]))
    df = spark.createDataFrame([(i, *c, True) for i, c in enumerate(cases)], "i int, device string, ok boolean, workers bigint, half boolean, pin_memory boolean, use_cpu_fallback boolean")
    once = conf.device_rules(df, F.col("ok"))
    twice = conf.device_rules(once.drop("fallback_flag"), F.col("ok"))
    for r, s in zip(once.orderBy("i").collect(), twice.orderBy("i").collect()):
        device, ok, workers, half, pin = cases[r["i"]]
        if device == "mps" and not ok:
            want = ("cpu", workers, half, pin, None)
        elif device == "mps":
            want = ("mps", 0, False, False, "1")
        else:
            want = (device, workers, half, pin, None)
        assert (r["device"], r["workers"], r["half"], r["pin_memory"], r["fallback_flag"]) == want
        assert (s["device"], s["workers"], s["half"], s["pin_memory"]) == want[:4]


def test_precedence(spark):
    one = spark.createDataFrame([("p", {"training": {"amp": "true", "workers": "2", "device": "cpu"}})], f"profile_name string, sections {profiles.SECTIONS}")
    at = lambda **k: conf.effective(one, **k).first()
    assert at()["amp"] is False and at(faithful_amp=False)["amp"] is True and at(cli={"amp": F.lit(True)})["amp"] is True
    assert at(cli={"workers": F.lit(4), "nonsense": F.lit(1)})["workers"] == 4
    auto = at(cli={"device": F.lit("auto")}, cuda=F.lit(True))
    assert auto["device"] == "cuda"
    assert at(preset=F.lit(True))["workers"] == 2  # neither names mps
    assert at(preset=F.lit(True), cli={"device": F.lit("mps")})["workers"] == 0


def test_overlay_identity_and_update(spark):
    base = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    none = spark.createDataFrame([], "key string, value string")
    assert sorted(map(str, conf.overlay(base, none).collect())) == sorted(map(str, base.collect()))
    got = conf.override(conf.resolve(spark.createDataFrame([("p", {})], f"profile_name string, sections {profiles.SECTIONS}")), {"epochs": F.lit(3), "device": F.lit(None), "none": F.lit(1)}).first()
    assert got["epochs"] == 3 and got["device"] == "mps" and "none" not in got.asDict()


# runs


@pytest.mark.parametrize(("names", "want"), [([], 1), (["run"], 1), (["run", "run1", "run007", "run10", "run-3", "run2x", "other5", "run²"], 11), (["run007"], 8), (["run99999999999"], 100000000000)])
def test_next_run(spark, names, want):
    df = spark.createDataFrame([(n, True) for n in names] + [("run900", False)], "name string, is_dir boolean")
    assert runs.next_run_number(df).first()["next_number"] == want


def test_lifecycle_table(spark):
    df = spark.createDataFrame(list(itertools.product([True, False], [True, False])), "w boolean, r boolean")
    got = {(x["w"], x["r"]): (x["a"], x["b"]) for x in df.select("w", "r", runs.lifecycle(F.col("w"), F.col("r")).alias("a"), runs.lifecycle(F.col("w"), F.col("r"), True).alias("b")).collect()}
    assert got == {(True, True): ("skip", "resume"), (True, False): ("skip", "skip"), (False, True): ("scratch", "scratch"), (False, False): ("scratch", "scratch")}


def test_required_files(spark):
    need = spark.createDataFrame(list(enumerate(runs.REQUIRED)), "ord int, path string")
    have = spark.createDataFrame([(runs.REQUIRED[3],), (runs.REQUIRED[3],)], "path string")
    got = runs.assert_paths(need, have, F.lit(False)).collect()
    assert [r["path"] for r in got] == [x for k, x in enumerate(runs.REQUIRED) if k != 3]
    with pytest.raises(FileNotFoundError, match="config/__init__.py"):
        runs.assert_paths(need, have, F.col("ord") > 0)
    assert runs.assert_paths(need, need.select("path"), F.lit(True)).count() == 0


def test_completers_and_gate(spark, tmp_path):
    assert files.list_directory(spark, str(tmp_path / "none")) is None
    (tmp_path / "runA").mkdir()
    (tmp_path / "runB.txt").write_text("x")
    listing = files.list_directory(spark, str(tmp_path))
    assert sorted(map(tuple, listing.collect())) == [("runA", True), ("runB.txt", False)]
    names = lambda d: sorted(r["candidate"] for r in d.collect())
    assert names(runs.complete_run(spark, listing, "run")) == ["runA"] and names(runs.complete_run(spark, None, "zzz")) == sorted(runs.NO_RUNS)
    conf_files = spark.createDataFrame([("config.yaml",), ("cpu.yaml",), ("config.txt",)], "name string")
    assert names(runs.complete_config(conf_files, "config/con")) == ["config/config.yaml"]
    assert names(runs.complete_option(spark, "--batch", "1")) == ["16"]
    epochs = spark.range(25).toDF("epoch")
    assert [r["epoch"] for r in runs.periodic(epochs, 10).collect()] == [0, 10, 20]
    for f in (lambda: runs.periodic(epochs, 0), lambda: jobs.every(0, print)):
        with pytest.raises(ZeroDivisionError):
            f()


def test_prediction_source_needs_one(spark):
    df = spark.createDataFrame([(None,)], "s string")
    with pytest.raises(Exception, match="give a source"):
        df.select(runs.prediction_source(F.lit(False), F.col("s"), F.lit("/i"))).collect()


def test_summary(spark):
    got = {r["check"]: (r["passed"], r["line"]) for r in runs.summary(spark.createDataFrame([("a", True), ("a name longer than twenty", None)], "check string, passed boolean")).collect()}
    assert got["a"] == (True, "a" + " " * 19 + " PASSED") and got["a name longer than twenty"] == (False, "a name longer than twenty FAILED")


# files and documents


def test_texts_splits_and_conversion(spark, tmp_path):
    d = tmp_path / "set" / "images" / "train"
    d.mkdir(parents=True)
    (d / "a.txt").write_text("x\ny\n")
    (d / "b.html").write_text("<head><title>t</title></head><h1>A &amp;lt; B</h1><p>c<br>d</p><ul><li>e</ul><!-- <p>z --><script>'</p>'</script>")
    (d / "c.pdf").write_bytes(b"%PDF")
    (d / "d.xyz").write_bytes(b"?")
    got = {r["path"].rsplit("/", 1)[1]: (r["markdown"], r["error"]) for r in documents.convert(files.read_binaries(spark, str(tmp_path))).collect()}
    assert got["a.txt"] == ("x\ny\n", None) and got["b.html"] == ("# A &lt; B\n\nc\nd\n\n- e", None)
    assert "PDF" in got["c.pdf"][1] and got["d.xyz"][0] is None
    mine = documents.convert(files.read_binaries(spark, str(tmp_path), "*.pdf"), {".pdf": lambda b: "ok"}).collect()
    assert [r["markdown"] for r in mine] == ["ok"]
    s = files.with_split(files.read_binaries(spark, str(tmp_path))).select("kind", "split").distinct().collect()
    assert [tuple(r) for r in s] == [("images", "train")]
    t = files.read_texts(spark, str(d), "*.txt")
    assert t.first()["value"] == "x\ny\n"
    out = str(tmp_path / "out")
    for text in ("one", "two"):
        files.write_text(spark.createDataFrame([(text,)], "value string"), out)
    assert [r["value"] for r in spark.read.text(out).collect()] == ["two"]
    (tmp_path / "data.yaml").write_text("path: /d\ntrain: images/train\nval: images/val\nnames:\n  0: cat\n  1: dog\n")
    r = files.read_descriptor(spark, str(tmp_path / "data.yaml")).first()
    assert r["path"] == "/d" and r["names"] == {0: "cat", 1: "dog"}


def test_paths(spark):
    df = spark.createDataFrame([("/a", "b"), ("/a/", "/c"), ("/a", "../d")], "r string, p string")
    assert [r[0] for r in df.select(paths.join_path(F.col("r"), F.col("p"))).collect()] == ["/a/b", "/c", "/a/../d"]


# detections

box = st.tuples(st.integers(0, 3), st.integers(0, 20), st.integers(0, 20), st.integers(0, 12), st.integers(0, 12))


def plain_iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / u if u else None


@settings(max_examples=12, deadline=None)
@given(st.lists(box, max_size=14))
def test_suppression_properties(spark, rows):
    data = [(k % 2, k, "a" if s % 2 else "b", s / 4, float(x), float(y), float(x + w), float(y + h)) for k, (s, x, y, w, h) in enumerate(rows)]
    df = spark.createDataFrame(data, "img bigint, det_id bigint, cls string, score double, x1 double, y1 double, x2 double, y2 double").coalesce(1)
    for agnostic in (False, True):
        kept = {r["det_id"] for r in det.suppress(df, 0.3, agnostic).collect()}
        want = set()
        for d in sorted(data, key=lambda r: (-r[3], r[1])):
            rivals = [e for e in data if e[1] in want and e[0] == d[0] and (agnostic or e[2] == d[2])]
            if not any((plain_iou(e[4:], d[4:]) or 0) > 0.3 for e in rivals):
                want.add(d[1])
        assert kept == want


def test_threshold_and_top(spark):
    assert (det.threshold(None), det.threshold(0.0), det.threshold(0.5)) == (0.25, 0.25, 0.5)
    df = spark.createDataFrame([(1, k, "a", s, 0.0, 0.0, 1.0, 1.0) for k, s in enumerate([0.2, 0.25, 0.9, 0.9])], "img bigint, det_id bigint, cls string, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["det_id"] for r in det.above(df).collect()) == [1, 2, 3]
    assert [(r["det_id"], r["rank"]) for r in det.top(df, 2).orderBy("rank").collect()] == [(2, 1), (3, 2)]
    assert [r["det_id"] for r in det.postprocess(df).collect()] == [2]
    assert det.postprocess(df.limit(0)).count() == 0


# streams


def test_streams_equal_batches(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    src = str(tmp_path / "pages")
    pages.repartition(3).write.parquet(src)
    jobs.stream_markdown(jobs.read_stream(spark, src, pages, 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, documents.page_markdown(pages).collect()))

    from tessera.plans.catalogue import boxes

    b = boxes(spark, "/root/testdata/sf0.001").filter("img < 200")
    b.repartition(4, "img").write.parquet(str(tmp_path / "boxes"))
    jobs.stream_detections(jobs.read_stream(spark, str(tmp_path / "boxes"), b, 1), str(tmp_path / "det"), str(tmp_path / "cp2"), least=0.3).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "det")).count() == det.postprocess(b, least=0.3).count()
    assert len(os.listdir(tmp_path / "det")) > 1

    seen, hooked = [], []
    q = jobs.read_stream(spark, src, pages, 1).writeStream.foreachBatch(jobs.every(2, lambda _, n: hooked.append(n), lambda _, n: seen.append(n))).option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert hooked == [n for n in seen if n % 2 == 0] and len(seen) == 3

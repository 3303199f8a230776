"""WARC, chat formatting and HTML extraction: round trips, held-out accuracy, odd rows."""

import base64
import gzip
import hashlib
import html
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import chat, html_text, warc
from tessera.llm._common import scratch_path

DIR = "/root/testdata/sf0.001"


# WARC


def plain_warc(rows):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        again = i is not None and first[t or ""] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[t or ""] if again else None))
    return Counter(out)


def run_warc(spark, df, **options):
    path = scratch_path(spark, "warc-test")
    warc.write(df, path, **options)
    return warc.read(spark, path), path


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_warc_round_trip(spark, compression):
    rows = [(1, "u", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "u v\n", "x" * 50_000 + "ü" * 9_000), (3, None, None), (4, "u", ""), (5, "u", "same"), (6, "u", "same"), (7, "u", "same"), (7, "u", "same"), (None, "u", "same"), (8, "u", "ß" * 40), (9, "u", "\x00\x1f\x8b")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, record int, digest string").repartition(3)
    got, _ = run_warc(spark, df, segment_bytes=100, compression=compression)
    got = got.collect()
    assert all(r["complete"] for r in got)
    assert Counter((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == plain_warc(rows)
    text = {i: (t or "").encode() for i, _, t in rows}
    assert all(r["payload"] == text[r["page"]] for r in got if r["record_type"] == "response" and r["page"] is not None)
    assert run_warc(spark, df.limit(0))[0].count() == 0


def test_warc_missing_segment_is_told(spark):
    path = scratch_path(spark, "warc-cut")
    made = lambda page, x: warc.records_of(f"{page}-a", page, "u", x, len(x), hashlib.sha1(x).hexdigest(), None, "", 200)
    good, bad, alone = made(1, b"x" * 900), made(2, b"y" * 900), made(3, b"z" * 900)
    records = [*reversed(good), *bad[:2], *bad[3:], alone[0]]
    spark.createDataFrame([(r.decode(),) for r in records], "value string").repartition(3).write.option("lineSep", "\r\n\r\n").text(path)
    got = {r["page"]: (r["complete"], r["payload"]) for r in warc.read(spark, path).collect()}
    assert got == {1: (True, b"x" * 900), 2: (False, None), 3: (False, None)}


def test_warc_malformed_records_are_told(spark):
    path = scratch_path(spark, "warc-bad")
    made = lambda page, x=b"x" * 40: warc.records_of(f"{page}-a", page, "u", x, len(x), hashlib.sha1(x).hexdigest(), None, "")[0].decode()
    records = [
        made(1), made(2).replace("28\r\n", "zz\r\n"), made(3).replace("28\r\n", "29\r\n"), made(4).replace("\r\nContent-Length", "\r\nContent-Size"), made(5).replace("sha1:", "sha1:A"),
        made(6).replace("WARC-Type: response", "WARC-Type: warcinfo"), made(7).replace("WARC-Type: response", "WARC-Type: revisit"), made(8).replace("Tessera-Page: 8", "Tessera-Page: x"), made(9),
    ]
    spark.createDataFrame([(r,) for r in records], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    got = {r["page"]: (r["complete"], r["payload"]) for r in warc.read(spark, path).collect()}
    assert got == {k: (k in (1, 9, None), b"x" * 40 if k in (1, 9, None) else None) for k in (1, 2, 3, 4, 5, 7, None, 9)}
    assert list(warc.parse_records(b"WARC/1.1\r\nWARC-Type: resp")) == [({"warc-type": "resp"}, b"", False)]
    whole = gzip.compress(records[0].encode() + b"\r\n\r\n")
    assert [x[2] for x in warc.parse_records(whole[:-20])] in ([], [False], [True]) and [x[2] for x in warc.parse_records(whole + whole)] == [True, True]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 50))
def test_chunked(payload, size):
    assert warc.dechunk(warc.chunked(payload, size)) == payload


# chat


ROLE = st.sampled_from(["user", "assistant", "system", "", "a\\n\nb", "[INST]"])
TEXT = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "/s>", "INST]", "x", "\n", "é\U0001f600"]), max_size=7).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
def test_chat_round_trip_and_mask(turns):
    out, at, inside, rewrites = chat.spans(turns, chat.render)
    assert chat.parse(out) == turns and rewrites is None
    assert [chat.unescape(out[a:b]) for a, b in inside] == [t for _, t in turns]
    assert [b for _, b in at][:-1] == [a for a, _ in at][1:]


def test_chat_detects_rewritten_history():
    def only_last(turns):
        return "".join(f"[{r}]{t}" if k == len(turns) - 1 else "." for k, (r, t) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.spans(turns, only_last)[3] == 1
    assert chat.spans(turns, lambda ts: "".join(t.upper() for _, t in ts[:1]) + "".join(t for _, t in ts[1:]))[3] is not None  # it changes texts, so the marker is lost


def test_chat_wrapper_that_changes_with_the_turn():
    def numbered(turns):  # the number gets longer at turn 10, and the answer to a system turn has another wrapper
        return "".join(f"{k}. {'re ' if k and turns[k - 1][0] == 'system' else ''}{r}: {t}{'!' * (k % 3)}\n" for k, (r, t) in enumerate(turns))

    turns = [("system" if k == 7 else "assistant" if k % 2 else "user", f"text {k}") for k in range(24)]
    out, _, inside, rewrites = chat.spans(turns, numbered)
    assert rewrites is None and [out[a:b] for a, b in inside] == [t for _, t in turns]


def test_chat_templates_that_look_at_texts():
    turns = [("user", "abc"), ("assistant", "xy"), ("user", "q"), ("assistant", "long answer here"), ("user", ""), ("assistant", "sixsix")]
    for wrap in (lambda t: t + "!" * (len(t) > 5), lambda t: f"{len(t)}:{t};" if t else "", lambda t: f"{'>' * len(t)}{t}"):
        out, _, inside, lost = chat.spans(turns, lambda ts, wrap=wrap: "".join(f"<{r}>{wrap(t)}" for r, t in ts))  # noqa: B023
        assert [out[a:b] for a, b in (s for s, (_, t) in zip(inside, turns) if t)] == [t for _, t in turns if t] and lost in (None, 4)

    def words(ts):  # looks at what the text says: told from an escape only where it is known how texts are written
        return "".join(f"<{r}>{t}{'?' if 'q' in t else ''}" for r, t in ts)

    out, at, inside, lost = chat.spans(turns, words, str)
    assert lost == 2 and inside[2] is None and [out[a:b] for a, b in (s for s in inside if s)] == ["abc", "xy", "long answer here", "", "sixsix"] and len(at) == 6


def test_chat_system_turn_put_into_the_next():
    def merged(ts):
        out, held = "", ""
        for r, t in ts:
            if r == "system":
                held += f"({t}) "
            else:
                out, held = out + f"<{r}>{held}{t}", ""
        return out

    turns = [("system", "be kind"), ("system", "be brief"), ("user", "u"), ("assistant", "a"), ("system", "now rude"), ("user", "v"), ("assistant", "b")]
    out, at, inside, lost = chat.spans(turns, merged)
    assert lost is None and [out[a:b] for a, b in inside] == [t for _, t in turns] and at[0] == at[1] == (0, 0)
    out, _, inside, lost = chat.spans([*turns, ("system", "never shown")], merged)
    assert lost == 7 and inside[7] is None and [out[a:b] for a, b in inside[:7]] == [t for _, t in turns]


def test_chat_rows_without_a_conversation(spark):
    rows = [(None, k % 2, "assistant", f"t{k % 3}") for k in range(7)] + [(1, 0, "user", "u"), (1, 1, "assistant", "a")]
    got = chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r["conv_id"] is None, r["n_turns"], r["loss_chars"]) for r in got) == [(False, 2, 1)] + [(True, 1, 2)] * 7


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, 0, None, "x"), (None, 0, "assistant", "n"), (3, None, "assistant", ""), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, c int, n int, t int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\na\nassistant\nb\n") and got[1]["loss_sha256"] == sha("ab")
    assert got[2]["loss_chars"] == 0 and got[2]["loss_sha256"] == sha("") and got[None]["loss_sha256"] == sha("n") and got[4]["loss_chars"] == 8 and got[3]["n_turns"] == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


# HTML


def plain_main(page):
    x = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    x = re.sub(r"</?b>", "", x)
    return " ".join(" ".join(html.unescape(z).split()) for z in re.split(r"<[^>]*>", x) if z.strip())


def test_labeller_on_unseen_pages():
    net = html_text.train()
    pages, labels = html_text.training_set(200, 77)
    right = np.concatenate(net.label(pages)) == np.concatenate(labels)
    assert right.mean() > 0.985


def test_gradients_match_differences():
    net = html_text.Labeller(3)
    pages, labels = html_text.training_set(3, 5)
    lengths = np.array([len(p) for p in pages])
    x, y = np.zeros((3, lengths.max(), html_text.DIMS), np.float32), np.zeros((3, lengths.max()), np.float32)
    for k, p in enumerate(pages):
        x[k, : lengths[k]], y[k, : lengths[k]] = html_text.vectors([p]), labels[k]
    real = np.arange(x.shape[1])[None] < lengths[:, None]
    loss = lambda: float(((np.logaddexp(0, s := net.forward(x, lengths)[0].astype(float)) - y * s) * real).sum() / real.sum())
    g = net.gradients(x, y, lengths)
    for name in net.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-4)


def test_extract_matches_plain_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    wrong = [r["page_id"] for r in df.collect() if got[r["page_id"]] != plain_main(r["html"])]
    assert len(wrong) <= 0.01 * len(got)


def test_extract_odd_rows(spark):
    long = "<article><h1>t</h1>" + "<p>some words here &amp; there &lt;b&gt; &#233;&nosuch;</p>" * 4000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no tags"), (4, "u", "<script>x"), (5, "u", "<!-- never closed <p>x"), (6, "u", "<<<>>><p <b"), (7, "u", long), (None, "u", "<article><p>a</p></article>"), (7, "u", "<article><p>Again a text of <b>so</b>me words.</p><nav><a href=x>menu</a></nav></article>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got if r["page_id"] != 7}
    assert by[1] == by[2] == by[4] == by[5] == ""
    sevens = sorted((r["text"] for r in got if r["page_id"] == 7), key=len)
    assert sevens[0] == "Again a text of some words." and sevens[1] == "t" + " some words here & there <b> é&nosuch;" * 4000
    assert html_text.extract(df.limit(0)).count() == 0


def test_blocks_keep_whole_text():
    texts = lambda page: [t for _, t, _ in html_text.blocks(page)]
    assert texts("<p>one<svg viewBox='0'/></p><p>two</p><svg><text>no</text></svg><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>so <math><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='t'>a=2</annotation></math> holds</p>") == ["so a=2 holds"]
    assert texts("<p>x<mspace/>y <math/>z</p>") == ["xy z"]
    assert texts("<3 plain text") == ["<3 plain text"] and texts("<p>a</p>< b") == ["a", "< b"]
    assert texts("<p>a</p><p class='x") == ["a"]


def test_html_deep_and_very_long_pages():
    net = html_text.train()
    began, size = time.time(), 50_000
    deep = html_text.blocks("".join(f'<div class="c{k % 7} d{k % 1000}">x{k}' for k in range(size)))
    assert len(deep) == size and time.time() - began < 20
    assert len({id(place.vector) for place, _, _ in deep}) < 1100  # levels without a new name share their vector
    assert [t for _, t, _ in html_text.blocks("<b>" * 20_000 + "<p>a</b>b<p>c")] == ["ab", "c"]
    pages, _ = html_text.training_set(40, 5)
    page = [b for p in pages for b in p]
    x = html_text.vectors([page])[None]
    assert np.allclose(np.concatenate([html_text.vectors([page[k : k + 50]], k, len(page)) for k in range(0, len(page), 50)]), x[0], atol=1e-6)
    plain = net.forward(x, np.array([len(page)]))[0][0] > 0
    before, html_text.LONG_PAGE = html_text.LONG_PAGE, 64
    try:
        assert (net.label([page])[0] == plain).mean() > 0.999
    finally:
        html_text.LONG_PAGE = before
    assert len(net.label([[page[0]] * 60_000])[0]) == 60_000


def test_html_hides_nothing_that_is_text():
    texts = lambda page: [t for _, t, _ in html_text.blocks(page)]
    assert texts("<p>x</p>< 5 apples and more") == ["x", "< 5 apples and more"]
    assert texts("<p>x</p><noscript>one</noscript><object>two</object><canvas>three</canvas>") == ["x", "one", "two", "three"]
    assert texts("<p>a</p><svg><path><p>b</p>") == ["a", "b"]
    assert texts("<p>a <svg><title>t</title></svg>b</p>") == ["a b"]
    assert html_text.blocks("<a>l<b><i><u><s><q><em><tt></a> and much more text that is plain")[0][2] < 0.1


def test_broken_pages_take_time_in_proportion():
    n = 1 << 20
    pages = {"<a ": None, "<a href='": None, "<svg>x": "x", "<!-- x": None, "<textarea>x": None, "<a href=\"x>y": None, "</b>x": "x", "<li><i>": None}
    cases = [(p * (n // len(p)), want) for p, want in pages.items()]
    cases += [("<h1>" + "<i>" * (n // 16) + "<div>y</div>" * (n // 16), "y"), ("<ul><li><ul>" + "<i>" * (n // 16) + "<li>y</li>" * (n // 16), "y")]
    for page, want in cases:
        began = time.time()
        out = html_text.blocks(page)
        assert time.time() - began < 5, page[:30]
        assert want is None or (out and {t[0] for _, t, _ in out} == {want}), page[:30]


def test_odd_ends_of_pages():
    read = lambda p: [t for _, t, _ in html_text.blocks(p)]
    assert read("<p>a<!-- b > c") == ["a"] and read("<p>a<!-- b") == ["a"] and read("a <!--> b") == ["a"]
    assert read("<p>a<b") == ["a<b"] and read("<p><b") == [] and read("<p>a <3 b") == ["a <3 b"] and read("x <b <!-- y") == ["x <b"] and read("a<!-- x -->") == ["a"]
    assert read("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>e<p>f<div>g") == ["a", "b", "c", "d", "e", "f", "g"]


def test_archives_are_bounded_by_bytes_and_read_in_pieces(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://x/{i}", f"{i} " * 30_000) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for packed in (None, "gzip"):
        path = str(tmp_path / str(packed))
        warc.write(pages, path, compression=packed, file_bytes=200_000)
        files = [p for p in (tmp_path / str(packed)).iterdir() if p.name.startswith("part-")]
        sizes = [len(p.read_bytes() if packed is None else gzip.decompress(p.read_bytes())) for p in files]
        assert len(sizes) > 4 and max(sizes) <= 200_000
        got = {r["page"]: r["payload"].decode() for r in warc.read(spark, path).collect()}
        assert got == {i: html for i, _, html in rows}
    held = []
    grow = warc._Window.more
    monkeypatch.setattr(warc._Window, "more", lambda w: (grow(w), held.append(len(w.held)))[0])
    record = warc._record("response", "<r>", "u", b"x" * 10_000, [])
    data = (record + b"\r\n\r\n") * 3_000
    for x in (data, gzip.compress(data), gzip.compress(data[:10_000_000]) + gzip.compress(data[10_000_000:])):
        assert [len(b) for _, b, whole in warc.parse_records(x) if whole] == [10_000] * 3_000
    assert max(held) < 3 << 20
    cut = list(warc.parse_records(gzip.compress(data)[:-2000]))
    assert 2_000 < len(cut) <= 3_000 and all(w for _, _, w in cut[:-1])

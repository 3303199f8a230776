"""Pages by structure: made pages whose markdown is known, odd and broken pages, and their tree."""

import random
import time

from pyspark.sql import functions as F

from tessera.operators import structure
from tessera.operators.structure import Page
from tessera.plans import catalogue


def made_inline(rnd, deep=0):
    """(html, markdown) of a stretch of text."""
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    out = []
    for _ in range(rnd.randint(1, 4)):
        w, kind = word(), rnd.randint(0, 9 if deep < 2 else 4)
        if kind < 4:
            out.append((w, w))
        elif kind == 4:
            out.append((f"{w} &amp; &lt;{w}&gt;", f"{w} & <{w}>"))
        else:
            a, b = made_inline(rnd, deep + 2)
            out.append({5: (f"<b>{a}</b>", f"**{b}**"), 6: (f"<EM class='x'>{a}</em>", f"*{b}*"), 7: (f'<a title=x href="/{w}?a=1&amp;b">{a}</a>', f"[{b}](/{w}?a=1&b)"), 8: (f"<code>{w}</code>", f"`{w}`"), 9: (f"<img alt='{w}' src=/{w}.png>x", f"![{w}](/{w}.png)x")}[kind])
    blank = lambda: rnd.choice((" ", "\n  ", " \t"))
    return blank().join(a for a, _ in out), " ".join(b for _, b in out)


def made_list(rnd, level):
    ordered, page, lines = rnd.random() < 0.5, [], []
    for n in range(rnd.randint(1, 3)):
        a, b = made_inline(rnd)
        inner, below = made_list(rnd, level + 1) if level < 3 and rnd.random() < 0.4 else ("", [])
        page.append(f"<li>{a}{inner}</li>")
        lines += ["  " * level + (f"{n + 1}. " if ordered else "- ") + b, *below]
    tag = "ol" if ordered else "ul"
    return f"<{tag}>\n{''.join(page)}</{tag}>", lines


def made_page(rnd):
    page, blocks = ["<!DOCTYPE html><html><head><title>no</title></head><body><!-- <p>no</p> -->"], []
    for _ in range(rnd.randint(1, 8)):
        kind = rnd.randint(0, 6)
        a, b = made_inline(rnd)
        if kind < 2:
            page.append(f"<p>{a}</p>\n")
            blocks.append(b)
        elif kind == 2:
            n = rnd.randint(1, 6)
            page.append(f"<h{n}>{a}</h{n}>")
            blocks.append("#" * n + " " + b)
        elif kind == 3:
            x, lines = made_list(rnd, 0)
            page.append(x + "<p>between</p>")
            blocks += ["\n".join(lines), "between"]
        elif kind == 4:
            cells = [[made_inline(rnd) for _ in range(2)] for _ in range(rnd.randint(1, 3))]
            page.append("<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x, _ in r) + "</tr>" for r in cells) + "</table><div>after</div>")
            lines = ["| " + " | ".join(y for _, y in r) + " |" for r in cells]
            blocks += ["\n".join([lines[0], "|---|---|", *lines[1:]]), "after"]
        elif kind == 5:
            page.append(f"<pre><code>if x:\n    {b.split()[0]} &lt; 1\n</code></pre><script>var t='</p>';</script>")
            blocks.append(f"```\nif x:\n    {b.split()[0]} < 1\n```")
        else:
            page.append(f"<blockquote><p>{a}</p></blockquote>")
            blocks.append("> " + b)
    return "".join(page) + "</body></html>", "\n\n".join(blocks)


def test_made_pages():
    rnd = random.Random(6)
    for _ in range(400):
        page, want = made_page(rnd)
        assert Page().read(page).markdown() == want, page


def test_odd_pages():
    md = lambda x: Page().read(x).markdown()
    assert md("") == md(None) == md("<p> </p><!-- a --><b></b>") == ""
    assert md("<p>a <b>b<p>c") == "a **b**\n\nc"
    assert md("a < b <3") == "a < b <3"
    assert md("x <!-- never closed <p>y</p>") == "x y"
    assert md("<script>never closed <p>y") == "never closed\n\ny"
    assert md("<li>no list<li>two") == "- no list\n- two"
    assert md("<p><b>a <b>b</b> c</b> d</p>") == "**a b c** d"
    assert md("<table><tr><th>a|b<td>c<tr><td>1</table>") == "| a\\|b | c |\n|---|---|\n| 1 |"
    assert md("İİİ<style>x</STYLE>é<p>&nbsp;y&#233;</p>") == "İİİé\n\nyé"
    assert md("<p>a<br>b</p><a href=x></a><a>n</a>") == "a\nb\n\nn"


def test_tree_and_paths():
    read = Page().read("x<h2>A</h2>1<h3>B</h3><p>2<p>3<h1>C</h1><h3>D</h3>4<h2>E</h2>")
    assert [(b["text"], b["path"]) for b in read.blocks] == [("x", []), ("A", []), ("1", ["A"]), ("B", ["A"]), ("2", ["A", "B"]), ("3", ["A", "B"]), ("C", []), ("D", ["C"]), ("4", ["C", "D"]), ("E", ["C"])]
    t = read.tree()
    assert [b["text"] for b in t["blocks"]] == ["x"] and [c["title"] for c in t["children"]] == ["A", "C"]
    assert [c["title"] for c in t["children"][1]["children"]] == ["D", "E"] and t["children"][0]["children"][0]["blocks"][1]["text"] == "3"


def test_broken_pages_take_time_in_proportion():
    n = 250_000
    for page in ("<a " * n, "<svg>x" * n, "<b>x" * n, "<ul><li>x" * (n // 2), "<!-- x" * n, "<script>x" * n, "<h1>" + "<i>" * n + "<div>y</div>" * n, "<p title='" * n, "<blockquote>y" * (n // 2), "</b>" * n):
        began = time.time()
        Page().read(page).markdown()
        assert time.time() - began < 8, page[:20]


def test_structured_frames(spark):
    rows = [(1, "<h1>T</h1><p>a</p>", "k"), (2, None, None), (None, "", "e"), (1, "<h1>T</h1><p>a</p>", "k")]
    got = structure.structured(spark.createDataFrame(rows, "page_id long, html string, note string"))
    assert got.columns == ["page_id", "note", "blocks", "markdown", "tree"] and dict(got.dtypes)["tree"] == "variant"
    seen = got.select("page_id", "markdown", F.try_variant_get("tree", "$.children[0].blocks[0].text", "string").alias("x"), F.size("blocks").alias("n")).collect()
    assert [tuple(r) for r in seen] == [(1, "# T\n\na", "a", 2), (2, None, None, None), (None, "", None, 0), (1, "# T\n\na", "a", 2)]
    assert structure.block_rows(spark.createDataFrame(rows[:2], "page_id long, html string, level string").drop("level")).count() == 2


ODD = [
    (1, "<h1>a &amp</h1><p>b&ampc &eacute; &copy &#233; &lt;&nbsp;&amp;lt; x&quot</p>"),
    (2, "<h2>&a<b>mp;</b>t</h2><p>&nbsp;</p><pre> x\n\ty&#39;</pre>"),
    (3, "<p>before<h1>T&am</h1>\f<br>y<h3>z\v&middot"),
    (4, "<h1>T</h1>a < b <3"),
    (5, None),
    (6, ""),
]


def equals_sql(spark, tmp_path, name):
    import duckdb

    spark.createDataFrame(ODD, "page_id long, html string").selectExpr("page_id", "'u' AS url", "html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.execute(catalogue.SQL[name]).fetchall(), key=str)


def test_heading_paths_of_cut_references_equal_sql(spark, tmp_path):
    equals_sql(spark, tmp_path, "page_heading_paths")


def test_tree_of_cut_references_equals_sql(spark, tmp_path):
    equals_sql(spark, tmp_path, "page_tree")

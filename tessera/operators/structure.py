"""Pages by structure: blocks under their headings, markdown that keeps lists, links, tables and code, and a tree.

A page is read tag by tag by one small state machine, in time in proportion to its length also where tags or comments are
never closed. Pages are rows of Arrow batches; nothing is shuffled. A null or empty page has no blocks.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

#: Fixed values of HTML.
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
BLOCKS = {*HEADINGS, "p", "div", "section", "article", "aside", "main", "header", "footer", "nav", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tr", "td", "th", "caption", "blockquote", "pre", "form", "figure", "figcaption", "hr", "address", "body", "html"}
SILENT = ("script", "style", "noscript", "template", "head")
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
#: Levels of lists and quotes that are shown; deeper ones are shown at this one.
DEEPEST = 32
_END = {name: re.compile(f"</{name}", re.I) for name in SILENT}
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
_VALUE = re.compile(r"""\s(href|src|alt)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile("[ \t\r\n\f\v\xa0]+")


def tags_and_text(page: str) -> Iterator[tuple[str, str]]:
    """(name, piece) of tags, with a slash before the name of an end tag, and ("", text) between them. Comments and silent
    elements are left out; a `<` after which no `>` comes is text."""
    at, missing = 0, set()

    def after(what: str, start: int) -> int:
        """The place of `what` from `start` on, -1 if there is none; a search that failed isn't made again."""
        if what in missing:
            return -1
        found = page.find(what, start) if what not in _END else m.start() if (m := _END[what].search(page, start)) else -1
        if found < 0:
            missing.add(what)
        return found

    while at < len(page):
        start = page.find("<", at)
        if start < 0 or (end := after(">", start)) < 0:
            yield "", page[at:]
            return
        if start > at:
            yield "", page[at:start]
        if page.startswith("<!--", start) and (close := after("-->", start + 4)) >= 0:
            at = close + 3
            continue
        piece, at = page[start : end + 1], end + 1
        name = m[1].lower() if (m := _NAME.match(piece)) else "!"
        if name in SILENT and piece[1] != "/" and (close := after(name, at)) >= 0:
            at = page.find(">", close) + 1 or len(page)
            continue
        yield ("/" + name if piece[1] == "/" else name), piece


class Page:
    """The machine: open lists, quotes, headings, marks and links, the row of a table, and the block that is being filled.

    `plain` makes a block's text from its source without tags; by default all references of HTML are decoded, and blanks
    become one space.
    """

    def __init__(self, plain: Callable[[str], str] | None = None):
        self.made = plain
        self.blocks: list[dict] = []
        self.lines: list[tuple[str, str]] = []  # (kind, markdown)
        self.tag, self.plain, self.rich, self.marks = None, [], [], {}
        self.lists: list[list] = []  # [number of the last item, None in lists without numbers]
        self.path: list[tuple[int, str]] = []
        self.quotes, self.pre, self.link = 0, 0, None
        self.row: list[str] | None = None
        self.rows = 0
        self.item = False  # whether the block is the first of its item

    def text(self, piece: str) -> None:
        source, piece = piece, html.unescape(piece)
        if not self.pre:
            piece = _SPACE.sub(" ", piece)
        self.plain.append(source if self.made else piece)
        self.rich.append(piece)

    def mark(self, sign: str, opens: bool) -> None:
        """Begin or end strong, emphasised or code text; the outermost of nested equal ones counts."""
        if opens:
            self.marks.setdefault(sign, [0, len(self.rich)])[0] += 1
        elif sign in self.marks:
            self.marks[sign][0] -= 1
            if not self.marks[sign][0]:
                self.wrap(self.marks.pop(sign)[1], sign, sign)

    def wrap(self, at: int, left: str, right: str) -> None:
        """Put signs around what was written since `at`, inside its outer blanks; nothing around nothing."""
        at = min(at, len(self.rich))
        inner = "".join(self.rich[at:])
        if body := inner.strip():
            begin = len(inner) - len(inner.lstrip())
            self.rich[at:] = [f"{inner[:begin]}{left}{body}{right}{inner[begin + len(body):]}"]

    def close_link(self) -> None:
        if self.link:
            (at, href), self.link = self.link, None
            self.wrap(at, "[", f"]({href})")

    def flush(self) -> None:
        """End the block: what is open in it ends with it."""
        self.close_link()
        for sign, (_, at) in sorted(self.marks.items(), key=lambda x: -x[1][1]):
            self.wrap(at, sign, sign)
        self.marks = {}
        rich, plain = "".join(self.rich), "".join(self.plain)
        plain = self.made(plain) if self.made else _SPACE.sub(" ", plain).strip(" ")
        self.plain, self.rich = [], []
        if not plain and not rich.strip():
            return
        level = HEADINGS.get(self.tag, 0)
        if plain:
            if level:
                while self.path and self.path[-1][0] >= level:
                    self.path.pop()
            self.blocks.append({"tag": self.tag, "level": level, "path": [t for _, t in self.path], "text": plain})
            if level:
                self.path.append((level, plain))
        if self.row is not None:
            self.row.append(_SPACE.sub(" ", rich).strip().replace("|", "\\|"))
            return
        if self.pre:
            kind, md = "code", "```\n" + rich.strip("\n") + "\n```"
        else:
            kind, md = "text", "\n".join(x.strip() for x in rich.split("\n")).strip()
        if level:
            md = "#" * level + " " + md.replace("\n", " ")
        if self.lists:
            number = self.lists[-1][0]
            sign = ("- " if number is None else f"{number}. ") if self.item else "  "
            if self.item:
                kind = "item"
            deep = min(len(self.lists), DEEPEST)
            md = "  " * (deep - 1) + sign + md.replace("\n", "\n" + "  " * deep)
        self.item = False
        if self.quotes:
            md = "\n".join("> " * min(self.quotes, DEEPEST) + x for x in md.split("\n"))
        self.lines.append((kind, md))

    def end_row(self) -> None:
        if self.row:
            self.lines.append(("row" if self.rows else "table", "| " + " | ".join(self.row) + " |"))
            if not self.rows:
                self.lines.append(("row", "|" + "---|" * len(self.row)))
            self.rows += 1
        self.row = None

    def read(self, page: str | None) -> Page:
        for name, piece in tags_and_text(page or ""):
            opens, name = not name.startswith("/"), name.lstrip("/")
            if not name:
                self.text(piece)
            elif name in BLOCKS:
                self.block(name, opens)
            elif name == "br":
                self.plain.append(" ")
                self.rich.append("\n")
            elif name == "a":
                self.close_link()
                if opens and (href := _values(piece).get("href")):
                    self.link = (len(self.rich), href)
            elif name == "img" and opens and (v := _values(piece)).get("src"):
                self.rich.append(f"![{v.get('alt', '')}]({v['src']})")
            elif name in MARKS and not self.pre:
                self.mark(MARKS[name], opens)
        self.flush()
        self.end_row()
        return self

    def block(self, name: str, opens: bool) -> None:
        self.flush()
        self.tag = name if opens else None
        if name in ("ul", "ol"):
            if opens:
                self.lists.append([0 if name == "ol" else None])
            elif self.lists:
                self.lists.pop()
        elif name == "li":
            self.item = opens
            if opens and not self.lists:
                self.lists.append([None])
            if opens and self.lists[-1][0] is not None:
                self.lists[-1][0] += 1
        elif name == "blockquote":
            self.quotes = max(0, self.quotes + (1 if opens else -1))
        elif name == "pre":
            self.pre = max(0, self.pre + (1 if opens else -1))
        elif name in ("table", "tr"):
            self.end_row()
            if name == "table":
                self.rows = 0
            elif opens:
                self.row = []

    def markdown(self) -> str:
        tight, out, before = {"item", "row"}, [], None
        for kind, md in self.lines:
            near = kind in tight and before in ({"item"} if kind == "item" else {"row", "table"})
            out.append(("" if before is None else "\n" if near else "\n\n") + md)
            before = kind
        return "".join(out)

    def tree(self) -> dict:
        """Blocks and children by heading; a heading of a lower level is a child of the one above it."""
        root = {"title": None, "level": 0, "blocks": [], "children": []}
        open_ = [root]
        for b in self.blocks:
            if not b["level"]:
                open_[-1]["blocks"].append({"tag": b["tag"], "text": b["text"]})
                continue
            while open_[-1]["level"] >= b["level"]:
                open_.pop()
            open_[-1]["children"].append({"title": b["text"], "level": b["level"], "blocks": [], "children": []})
            open_.append(open_[-1]["children"][-1])
        return root


def _values(tag: str) -> dict[str, str]:
    """The first value of each attribute that is looked at."""
    out: dict[str, str] = {}
    for m in _VALUE.finditer(tag):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


_BLOCK = "array<struct<tag: string, level: int, path: array<string>, text: string>>"


def structured(pages: DataFrame, column: str = "html", plain: Callable[[str], str] | None = None) -> DataFrame:
    """pages with `blocks`, `markdown` and `tree` (VARIANT) in place of the column; a null page has null for each. `plain`
    makes the texts of blocks and tree, as in Page."""
    kept = [c for c in pages.columns if c != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema)

    def f(batches):
        import pyarrow as pa

        for b in batches:
            read = [None if x is None else Page(plain).read(x) for x in b.column(column).to_pylist()]
            made = [
                pa.array([x and x.blocks for x in read], pa.list_(pa.struct([("tag", pa.string()), ("level", pa.int32()), ("path", pa.list_(pa.string())), ("text", pa.string())]))),
                pa.array([x and x.markdown() for x in read], pa.string()),
                pa.array([x and json.dumps(x.tree(), ensure_ascii=False) for x in read], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + made, [*kept, "blocks", "markdown", "tree"])

    out = pages.mapInArrow(f, f"{schema}{', ' if schema else ''}blocks {_BLOCK}, markdown string, tree string")
    return out.withColumn("tree", F.parse_json("tree"))


def block_rows(pages: DataFrame, column: str = "html", plain: Callable[[str], str] | None = None) -> DataFrame:
    """A row for each block: the page's other columns, block (from 0), tag, level, path of headings above it, text."""
    kept = [c for c in pages.columns if c != column]
    rows = structured(pages, column, plain).select(*kept, F.posexplode("blocks").alias("block", "b"))
    return rows.select(*kept, F.col("block").cast("bigint").alias("block"), "b.tag", "b.level", "b.path", "b.text")

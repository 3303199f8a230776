"""Documents: page HTML to markdown and to a dict, and conversion by pluggable converters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of HTML, in the order in which they are applied: pattern (read alike by Java and RE2), replacement.
MARKDOWN = (
    ("(?s)<!--.*?-->", ""),
    ("(?is)<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)>", ""),
    ("(?is)<head[^>]*>.*?</head>", ""),
    ("(?i)<h1[^>]*>", "\n\n# "),
    ("(?i)<h2[^>]*>", "\n\n## "),
    ("(?i)<h3[^>]*>", "\n\n### "),
    ("(?i)<h[4-6][^>]*>", "\n\n#### "),
    ("(?i)<li[^>]*>", "\n- "),
    ("(?i)<br[^>]*>", "\n"),
    ("(?i)</?(b|strong)( [^>]*)?>", "**"),
    ("(?i)</?(i|em)( [^>]*)?>", "*"),
    ("(?i)</?(p|div|section|article|header|footer|nav|ul|ol|table|tr|blockquote|pre|h[1-6])( [^>]*)?>", "\n\n"),
    ("(?s)<[^>]*>", ""),
    ("[ \t]+", " "),
    (" ?\n ?", "\n"),
    ("\n\n\n+", "\n\n"),
)
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def markdown(html: Column) -> Column:
    """Markdown of page HTML; null stays null. Character references come last, the ampersand's the very last."""
    out = html
    for pattern, text in MARKDOWN:
        out = F.regexp_replace(out, pattern, text)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.btrim(out, F.lit(" \n"))


def markdown_sql(html: str) -> str:
    """The same as a DuckDB expression."""
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    out = html
    for pattern, text in MARKDOWN:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(text)}, 'g')"
    return f"trim({unescaped_sql(out)}, ' ' || chr(10))"


def unescaped_sql(text: str) -> str:
    """A DuckDB expression with ENTITIES as characters."""
    for name, char in ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, name, char.replace("'", "''"))
    return text


_BLANKS = re.compile("[ \t\r\n\xa0]+")


def plain_text(source: str) -> str:
    """A block's source without tags as text: only ENTITIES are decoded, so that a reference cut short stays as it is; a `<`
    that begins no tag is dropped."""
    source = source.replace("<", "")
    for name, char in ENTITIES:
        source = source.replace(name, char)
    return _BLANKS.sub(" ", source).strip(" ")


def as_dict(df: DataFrame, columns: list[str], name: str = "document") -> DataFrame:
    """df with the named columns as one JSON document."""
    return df.withColumn(name, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


class ConversionError(ValueError):
    pass


def convert_text(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def convert_pdf(content: bytes) -> str:
    raise ConversionError("no PDF decoder is installed; pass a converter for .pdf")


#: Converters by file ending. Reading PDF needs a decoder, which is left to the caller.
CONVERTERS: dict[str, Callable[[bytes], str]] = {".txt": convert_text, ".md": convert_text, ".html": convert_text, ".htm": convert_text, ".pdf": convert_pdf}


def convert(files: DataFrame, converters: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, markdown, error) of binary files (path, content); HTML becomes markdown, a failure is told in its row."""
    known = CONVERTERS | (converters or {})

    def f(batches):
        for b in batches:
            out, errors = [], []
            for path, content in zip(b["path"], b["content"]):
                ending = "." + path.rsplit(".", 1)[-1].lower()
                try:
                    if ending not in known:
                        raise ConversionError(f"no converter for {ending}")
                    out.append(known[ending](bytes(content)))
                    errors.append(None)
                except Exception as e:  # one bad file doesn't end the job
                    out.append(None)
                    errors.append(str(e))
            b["raw"], b["error"] = out, errors
            yield b[["path", "raw", "error"]]

    raw = files.select("path", "content").mapInPandas(f, "path string, raw string, error string")
    return raw.select("path", F.when(F.lower("path").rlike(r"\.html?$"), markdown(F.col("raw"))).otherwise(F.col("raw")).alias("markdown"), "error")


def page_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, url, markdown, n_chars) of pages."""
    return pages.select("page_id", "url", markdown(F.col("html")).alias("markdown")).withColumn("n_chars", F.length("markdown").cast("bigint"))

"""Cutting texts into sections and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.words import SPACE

#: Tokens of a chunk, and tokens it shares with the one before.
CHUNK, OVERLAP = 1500, 100

SECTION = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("id", "kind", "title", "text")]))

#: Fixed value: a markdown heading, with up to three blanks before it.
HEADING = r"^[ \t]{0,3}(#{1,6})[ \t]+(.+?)[ \t]*$"

_HEAD = re.compile(HEADING, re.MULTILINE)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda t: t != "")


def chunks(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key, chunk_no, n_tokens, text``: windows of ``size`` tokens; the last one is that which reaches the end.

    Null, empty and blank texts have no chunk.
    """
    cut = df.select(key, tokens(F.col(text)).alias("t")).where(F.size("t") > 0)
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.size("t") - overlap) / step)).cast("int")
    rows = cut.select(key, "t", F.explode(F.sequence(F.lit(1), count)).alias("chunk_no"))
    piece = F.slice(F.col("t"), (F.col("chunk_no") - 1) * step + 1, F.lit(size))
    return rows.select(key, "chunk_no", F.size(piece).alias("n_tokens"), F.array_join(piece, " ").alias("text"))


def markdown_sections(text: str | None) -> list[dict]:
    """Sections under ATX headings; bodies that are blank are left out. Text without a heading has none."""
    marks = list(_HEAD.finditer(text or ""))
    ends = [m.start() for m in marks[1:]] + [len(text or "")]
    found = [(m.group(2).strip(), text[m.end() : e].strip()) for m, e in zip(marks, ends, strict=False)]
    return [{"id": f"S{n}", "kind": "section", "title": t, "text": b} for n, (t, b) in enumerate(((t, b) for t, b in found if b), 1)]


class _Blocks(HTMLParser):
    """Outermost sections, bibliographies, appendices and the abstract of a rendered article."""

    #: Classes that mark the blocks.
    KINDS = {"ltx_section": "section", "ltx_bibliography": "bibliography", "ltx_appendix": "appendix", "ltx_abstract": "abstract"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.found: list[dict] = []
        self.now: dict | None = None
        self.mute = self.heading = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = (dict(attrs).get("class") or "").split()
        kind = next((self.KINDS[c] for c in classes if c in self.KINDS), None)
        starts = self.now is None and kind is not None and tag in ("section", "div")
        if starts:
            self.now = {"kind": kind, "title": [], "text": []}
        if tag in ("section", "div"):
            self.open.append((tag, starts))
        self.mute += tag in ("script", "style")
        if self.now is not None and re.fullmatch("h[1-6]", tag) and not self.now["text"]:
            self.heading += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        if re.fullmatch("h[1-6]", tag):
            self.heading = max(0, self.heading - 1)
        if tag in ("section", "div") and self.open:
            _, started = self.open.pop()
            if started and self.now is not None:
                self.found.append(self.now)
                self.now = None

    def handle_data(self, data: str) -> None:
        if self.now is not None and not self.mute:
            self.now["title" if self.heading else "text"].append(data)


def article_sections(html: str | None) -> list[dict]:
    """Blocks of a rendered article; subsections stay inside their section."""
    parser = _Blocks()
    parser.feed(html or "")
    tidy = lambda parts: " ".join("".join(parts).split())
    return [{"id": f"S{n}", "kind": b["kind"], "title": tidy(b["title"]), "text": tidy(b["text"])} for n, b in enumerate(parser.found, 1)]


@F.pandas_udf(SECTION)
def markdown_sections_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(markdown_sections, na_action=None)


@F.pandas_udf(SECTION)
def article_sections_udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for p in pages:
        yield p.map(article_sections)


def sections(df: DataFrame, key: str, text: str, drop_kinds: tuple[str, ...] = ("abstract", "bibliography")) -> DataFrame:
    """``key, id, kind, title, text`` of each markdown section, without the kinds that carry no claims."""
    rows = df.where(F.col(text).rlike("(?m)" + HEADING)).select(key, F.inline(markdown_sections_udf(F.col(text))))
    return rows.where(~F.col("kind").isin(*drop_kinds))


def first_body(found: Column, pattern: str) -> Column:
    """Text of the first section whose kind or title matches, in any case; an empty text if none does. ``found``: an array of sections."""
    fits = lambda x: F.coalesce(x["kind"].rlike(f"(?i){pattern}"), F.lit(False)) | F.coalesce(x["title"].rlike(f"(?i){pattern}"), F.lit(False))
    return F.coalesce(F.get(F.filter(found, fits), F.lit(0))["text"], F.lit(""))

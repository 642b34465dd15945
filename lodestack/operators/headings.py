"""Headings: their normal form and type, and the sections that they open in texts and in markup."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.html import blocks, by_text

#: A word, a heading line in Markdown, a list item, and the names of ranges without a known heading.
WORD = re.compile(r"\b[\w]+(?:[’'-][\w]+)*\b")
MARKDOWN = re.compile(r" {0,3}#{1,6}[ \t]+(.+?)\s*")
LIST_ITEM = re.compile(r"\s*(?:[-*•][ \t]+|\d+[.)][ \t]+)")
NO_HEADING, UNKNOWN = "unsectioned", "unmapped"
#: The longest line that may be a heading, and the limits of lines that only look like one.
LONGEST = 120
COLON_CHARS, COLON_WORDS = 100, 12
UPPER_CHARS, UPPER_WORDS, UPPER_LETTERS = 80, range(2, 11), 4
BOLD_WORDS = 12


def word_count(text: str) -> int:
    return sum(1 for _ in WORD.finditer(text))


def normal_heading(text: str) -> str:
    plain = unicodedata.normalize("NFKC", html.unescape(text)).translate({0x2018: "'", 0x2019: "'"})
    return re.sub(r"\s+", " ", plain).strip().strip("# ").rstrip(" :–—-.").casefold()


class HeadingTypes:
    """Types in order, (key, label, patterns); a heading has the first type of which a pattern matches all of it."""

    def __init__(self, types: Sequence[tuple[str, str, Sequence[str]]]):
        self.tried = [(key, re.compile("|".join(f"(?:{p})" for p in patterns), re.I)) for key, _, patterns in types]
        self.known: dict[str, str | None] = {}

    def kind(self, heading: str) -> str | None:
        if heading not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            normal = normal_heading(heading)
            self.known[heading] = next((key for key, pattern in self.tried if pattern.fullmatch(normal)), None)
        return self.known[heading]


def heading_of(line: str, types: HeadingTypes) -> tuple[str, str] | None:
    """(text, type) of a line that is a heading: one in Markdown, a known one, or one that ends in a colon or is in capitals."""
    if LIST_ITEM.match(line):
        return None
    if marked := MARKDOWN.fullmatch(line):
        text = re.sub(r"[ \t]+#+[ \t]*$", "", marked[1]).strip()
        return (text, types.kind(text) or UNKNOWN) if text else None
    text = line.strip()
    if not text or len(text) > LONGEST:
        return None
    if kind := types.kind(text):
        return text, kind
    words = word_count(text)
    if not words or "://" in text:
        return None
    colon = text[-1] == ":" and len(text) <= COLON_CHARS and words <= COLON_WORDS
    upper = text.isupper() and text[-1] != "." and len(text) <= UPPER_CHARS and words in UPPER_WORDS and sum(map(str.isalpha, text)) >= UPPER_LETTERS
    return (text, UNKNOWN) if colon or upper else None


def section_ranges(text: str, types: HeadingTypes) -> Iterator[tuple[int, int, str | None, str]]:
    """(start, end, heading, type): ranges without gaps; every heading line opens one."""
    opened: list[tuple[int, str | None, str]] = [(0, None, NO_HEADING)]
    at = 0
    for line in text.splitlines(keepends=True):
        if found := heading_of(line.rstrip("\r\n"), types):
            opened.append((at, *found))
        at += len(line)
    ends = [o[0] for o in opened[1:]] + [len(text)]
    return ((start, end, *name) for (start, *name), end in zip(opened, ends, strict=True) if end > start)


@dataclass
class Section:
    heading: str
    type: str | None
    level: int
    body: list[str]
    bullets: int = 0


def markup_sections(raw: str | None, types: HeadingTypes) -> tuple[list[Section], int]:
    """The sections of markup, and the words before the first."""
    sections: list[Section] = []
    before: list[str] = []
    for block in blocks(raw):
        short = len(block.text) <= LONGEST
        kind = types.kind(block.text) if short else None
        bold = block.bold and word_count(block.text) <= BOLD_WORDS and not block.text.rstrip().endswith(".")
        if block.kind == "heading" or (block.kind == "paragraph" and short and (kind or bold)):
            sections.append(Section(block.text, kind, block.level or 2, []))
        elif sections:
            sections[-1].body.append(block.text)
            sections[-1].bullets += block.kind == "bullet"
        else:
            before.append(block.text)
    return sections, word_count("\n".join(before))


def heading_kind(heading: Column, types: Sequence[tuple[str, str, Sequence[str]]]) -> Column:
    """The type of each heading, null where none is known; null headings have none."""
    made = HeadingTypes(types)
    return by_text(lambda t: None if t is None else made.kind(t), "string", pa.string())(heading)


def html_sections(df: DataFrame, id_col: str, html_col: str, types: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """(id, section_index, raw_heading, canonical_type, heading_level, body, word_count, bullet_count, preamble_word_count).

    A text without sections gives one row of index -1, with nulls and its preamble. Null and empty texts too, with 0 words."""
    made = HeadingTypes(types)
    kind = "array<struct<section_index:long,raw_heading:string,canonical_type:string,heading_level:long,body:string,word_count:long,bullet_count:long,preamble_word_count:long>>"
    names = ("section_index", "raw_heading", "canonical_type", "heading_level", "body", "word_count", "bullet_count", "preamble_word_count")
    texts = {"raw_heading", "canonical_type", "body"}
    arrow = pa.list_(pa.struct([(n, pa.string() if n in texts else pa.int64()) for n in names]))

    def each(raw: str | None) -> list[dict]:
        sections, before = markup_sections(raw, made)
        rows = [(k, s.heading, s.type, s.level, "\n".join(s.body), word_count("\n".join(s.body)), s.bullets, before) for k, s in enumerate(sections)]
        return [dict(zip(names, r, strict=True)) for r in rows or [(-1, None, None, None, None, None, None, before)]]

    found = df.select(F.col(id_col).alias("id"), F.explode(by_text(each, kind, arrow)(F.col(html_col))).alias("s"))
    return found.select(F.col("id").alias(id_col), "s.*")


def structure_stats(sections: DataFrame, id_col: str) -> DataFrame:
    """Per text of ``html_sections``: its sections, those of a known type, words and bullets in them, and the words before."""
    real = F.col("section_index") >= 0
    count = lambda c: F.sum(F.when(real, c).otherwise(0)).cast("long")
    return sections.groupBy(id_col).agg(
        F.count_if(real).alias("sections"), F.count_if(F.col("canonical_type").isNotNull()).alias("typed_sections"),
        count(F.col("word_count")).alias("words"), count(F.col("bullet_count")).alias("bullets"), F.max("preamble_word_count").alias("preamble_words"),
    )

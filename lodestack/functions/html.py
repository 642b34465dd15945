"""HTML to readable lines and to typed blocks. Parsing keeps state, so it runs in Arrow batches; texts are independent."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import count, groupby, repeat
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that tell markup from text, tags that end a line, and tags without visible text.
MARKUP_TAGS = "a|article|b|blockquote|br|div|em|h[1-6]|i|li|ol|p|section|span|strong|table|tbody|td|th|tr|ul|script|style"
LINE_TAGS = frozenset("article blockquote br div h1 h2 h3 h4 h5 h6 p section table tbody td th tr".split())
HIDDEN_TAGS = frozenset({"script", "style"})
#: Fixed values of the block parser: what it takes for markup, what holds a block, what ends loose text, how a list item begins.
BLOCK_MARKUP = r"<\s*(?:h[1-6]|p|div|ul|li|section|strong|b|br)\b"
BLOCK_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6".split())
LOOSE_ENDS = frozenset("div section article td tr".split())
ITEM = re.compile(r"(?:[-*•]\s+|\d+[.)]\s+)")
_TAG = re.compile(rf"<\s*/?\s*(?:{MARKUP_TAGS})\b[^>]*>", re.I)
_ESCAPED_TAG = re.compile(rf"&lt;\s*/?\s*(?:{MARKUP_TAGS})\b", re.I)
_BLOCK_MARKUP = re.compile(BLOCK_MARKUP, re.I)
_HEADING_TAG = re.compile("h[1-6]")
_FILLER = re.compile(r"[\s:–—-]+")


def one_line(text: str) -> str:
    return " ".join(re.split(r"\s+", text)).strip()


class _Visible(HTMLParser):
    """Tells ``opened``, ``closed`` and ``said`` only what is outside hidden tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN_TAGS:
            self.hiding()
            self.hidden += 1
        elif not self.hidden:
            self.opened(tag)

    def handle_endtag(self, tag):
        if tag in HIDDEN_TAGS:
            self.hidden -= self.hidden > 0
        elif not self.hidden:
            self.closed(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.said(data)


#: What a tag does to lines when it opens and when it closes: an event and its value.
_OPENING = {tag: ("break", 0) for tag in LINE_TAGS} | {f"h{k}": ("heading", k) for k in range(1, 7)} | {"ul": ("list", 0), "ol": ("list", 1), "li": ("item", 0)}
_CLOSING = {tag: ("break", 0) for tag in (*(LINE_TAGS - {"br"}), "li")} | {"ul": ("end", 0), "ol": ("end", 0)}


class _Events(_Visible):
    """The events of markup in their order: (text, what is said), or one that ends a line."""

    def __init__(self) -> None:
        super().__init__()
        self.events: list[tuple[str, Any]] = []

    def hiding(self) -> None:
        self.events.append(("break", 0))

    def opened(self, tag: str) -> None:
        self.events.extend(filter(None, [_OPENING.get(tag)]))

    def closed(self, tag: str) -> None:
        self.events.extend(filter(None, [_CLOSING.get(tag)]))

    def said(self, data: str) -> None:
        self.events.append(("text", data))


def readable_lines(events: Iterable[tuple[str, Any]]) -> Iterator[str]:
    """Lines folded from events: each has the mark of the event that it follows, list items by the lists that are open."""
    lists: list[Iterator[int | None]] = []
    mark = ""
    for is_text, group in groupby(events, key=lambda event: event[0] == "text"):
        if is_text:
            if line := one_line("".join(value for _, value in group)):
                yield mark + line
            continue
        for kind, value in group:
            mark = ""
            if kind == "heading":
                mark = "#" * value + " "
            elif kind == "list":
                lists.append(count(1) if value else repeat(None))
            elif kind == "end":
                del lists[-1:]
            elif kind == "item":
                number = next(lists[-1]) if lists else None
                mark = "  " * (len(lists) - 1) + ("- " if number is None else f"{number}. ")


def _lines(markup: str) -> str:
    parser = _Events()
    parser.feed(markup)
    parser.close()
    return "\n".join(readable_lines(parser.events))


def plain_text(text: str) -> str:
    """Lines with single spaces; no blank lines at the ends, and no two together."""
    lines = "\n".join(map(one_line, text.splitlines()))
    return re.sub(r"\n{3,}", "\n\n", lines.strip("\n"))


def clean(text: str | None) -> str:
    """Readable text of markup, of markup escaped once or twice, or of plain text; null gives the empty text."""
    if not text:
        return ""
    once = text if _TAG.search(text) else html.unescape(text)
    if _TAG.search(once):
        return _lines(once)
    if _ESCAPED_TAG.search(once):
        return _lines(html.unescape(once))
    return plain_text(once)


@dataclass
class Block:
    kind: str
    text: str
    level: int = 0
    bold: bool = False


@dataclass
class _Open:
    tag: str
    parts: list[tuple[str, bool]] = field(default_factory=list)


class _Blocks(_Visible):
    """Headings, list items and paragraphs in their order; text outside any of them is a paragraph."""

    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[Block] = []
        self.bold = 0
        self.now: _Open | None = None
        self.loose = ""

    def hiding(self) -> None:
        done, self.now = self.now, None
        if done is None or not (text := one_line("".join(t for t, _ in done.parts))):
            return
        strong, weak = (_FILLER.sub("", "".join(t for t, b in done.parts if b is want)) for want in (True, False))
        if _HEADING_TAG.fullmatch(done.tag):
            self.blocks.append(Block("heading", text, int(done.tag[1]), bool(strong) and not weak))
            return
        item = ITEM.match(text) if done.tag == "p" else None
        self.blocks.append(Block("bullet" if item or done.tag == "li" else "paragraph", text[item.end() :] if item else text, 0, bool(strong) and not weak))

    def end_loose(self) -> None:
        text, self.loose = one_line(self.loose), ""
        if text:
            self.blocks.append(Block("paragraph", text))

    def opened(self, tag: str) -> None:
        if tag in ("strong", "b"):
            self.bold += 1
        elif tag == "br":
            self.add(" ", False)
        elif tag in BLOCK_TAGS:
            self.hiding()
            self.end_loose()
            self.now = _Open(tag)

    def closed(self, tag: str) -> None:
        if tag in ("strong", "b"):
            self.bold -= self.bold > 0
        elif self.now is not None:
            if tag == self.now.tag:
                self.hiding()
        elif tag in LOOSE_ENDS:
            self.end_loose()

    def said(self, data: str) -> None:
        self.add(data, self.bold > 0)

    def add(self, data: str, bold: bool) -> None:
        if self.now is None:
            self.loose += data
        else:
            self.now.parts.append((data, bold))

    def result(self, markup: str) -> list[Block]:
        self.feed(markup)
        self.close()
        self.hiding()
        self.end_loose()
        return self.blocks


def blocks(raw: str | None) -> list[Block]:
    """The blocks of markup, escaped up to twice, or else of the lines of the cleaned text."""
    markup = raw or ""
    for _ in range(2):
        if not _BLOCK_MARKUP.search(markup):
            markup = html.unescape(markup)
    if _BLOCK_MARKUP.search(markup):
        return _Blocks().result(markup)
    out = []
    for line in filter(None, map(str.strip, clean(raw).splitlines())):
        if heading := re.match(r"(#{1,6})\s+(.+)", line):
            out.append(Block("heading", heading[2], len(heading[1])))
        else:
            item = ITEM.match(line)
            out.append(Block("bullet", line[item.end() :]) if item else Block("paragraph", line))
    return out


def by_text(each: Callable[[str | None], object], returns: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A column function that runs ``each`` on one text at a time, in Arrow batches."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array([each(t) for t in array.to_pylist()], arrow)

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


def clean_html(text: Column) -> Column:
    return by_text(clean, "string", pa.string())(text)

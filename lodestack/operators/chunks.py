"""Passages of bounded length with an overlap, cut at natural breaks and never across a heading.

Where a passage ends depends on where the one before ended, so a text is cut in one
pass, in Arrow batches; texts are independent and stay in their partition. Offsets count
characters. Null and empty texts give no passages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.batches import give_back, small_batches
from lodestack.operators.headings import HeadingTypes, section_ranges

#: Breaks in the order of preference, how far back a passage may begin to start a word, and the name in an identifier.
BREAKS = ("\n\n", "\n", " ", "\t")
BACK = 24
NODE_VERSION = "jd_v2_node_v1"


def check_sizes(size: int, overlap: int) -> None:
    if any(isinstance(x, bool) or not isinstance(x, int) for x in (size, overlap)) or not 0 <= overlap < size:
        raise ValueError("size and overlap are whole numbers, size the larger, overlap not negative")


def chunk_ranges(text: str, size: int, overlap: int, begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Half-open ranges that cover the text from ``begin`` to ``end``; passages overlap only if ``overlap`` is set."""
    check_sizes(size, overlap)
    end = len(text) if end is None else end
    out: list[tuple[int, int]] = []
    while begin < end:
        stop = begin + size
        if stop < end:
            least = begin + max(1, size // 2)
            found = ((text.rfind(mark, least, stop), len(mark)) for mark in BREAKS)
            stop = next((at + n for at, n in found if at >= 0), stop)
        stop = min(stop, end)
        out.append((begin, stop))
        if stop == end:
            break
        ahead = max(begin + 1, stop - overlap)
        word = max(text.rfind(mark, max(begin + 1, ahead - BACK), ahead) for mark in " \n\t") if overlap else -1
        begin = word + 1 if word >= 0 else ahead
    return out


def node_id(source: str, start: int, end: int, content: str) -> str:
    """The digest of a passage's identity, written as a JSON array."""
    whole = json.dumps([NODE_VERSION, source, start, end, content], ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(whole.encode()).hexdigest()


def node_id_column(source: Column, start: Column, end: Column, content: Column) -> Column:
    """``node_id`` as an expression; it differs only for U+001F, which JSON may write in two ways."""

    def quoted(text: Column) -> Column:
        return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)

    parts = F.concat_ws(",", F.lit(f'"{NODE_VERSION}"'), quoted(source), start.cast("string"), end.cast("string"), quoted(content))
    return F.sha2(F.concat(F.lit("["), parts, F.lit("]")), 256)


def retrieval_text(heading: Column, content: Column, with_heading: bool = True) -> Column:
    """The content, after its heading where there is one."""
    if not with_heading:
        return content
    return F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("Section: "), heading, F.lit("\n"), content)).otherwise(content)


def passages(df: DataFrame, id_col: str, text_col: str, types: Sequence[tuple[str, str, Sequence[str]]] = (), size: int = 1000, overlap: int = 100, keep: Sequence[str] = (), with_heading: bool = True) -> DataFrame:
    """(node_id, id, the columns of ``keep``, section_heading, canonical_section, chunk_index, start_offset, end_offset, content_text, retrieval_text).

    ``types`` are heading types; without any, only lines that look like headings open sections.
    chunk_index counts within a section. Identifiers take the id as text. Rows are not sorted."""
    check_sizes(size, overlap)
    small_batches(df.sparkSession)
    names = ("node_id", "section_heading", "canonical_section", "chunk_index", "start_offset", "end_offset", "content_text")
    numbers = {"chunk_index", "start_offset", "end_offset"}
    arrow = pa.struct([(n, pa.int64() if n in numbers else pa.string()) for n in names])
    returns = "array<struct<" + ",".join(f"{n}:{'long' if n in numbers else 'string'}" for n in names) + ">>"
    made = HeadingTypes(types)

    def cut(key: str | None, text: str | None) -> list[dict]:
        out = []
        for begin, end, heading, kind in section_ranges(text or "", made):
            for number, (a, b) in enumerate(chunk_ranges(text, size, overlap, begin, end)):
                out.append(dict(zip(names, (node_id(key or "", a, b, text[a:b]), heading, kind, number, a, b, text[a:b]), strict=True)))
        return out

    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, texts in pairs:
            yield pa.array([cut(k, t) for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True)], pa.list_(arrow))
        give_back()

    run.__annotations__ = {"pairs": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, returns)(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    rows = df.select(F.col(id_col), *keep, F.explode(found).alias("_node"))
    made_of = [F.col("_node")[n].alias(n) for n in names]
    return rows.select(made_of[0], id_col, *keep, *made_of[1:], retrieval_text(F.col("_node")["section_heading"], F.col("_node")["content_text"], with_heading).alias("retrieval_text"))


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(id, chunk_index, start, end, content), one row per passage, without regard to headings."""
    check_sizes(size, overlap)
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                (key, number, a, b, text[a:b])
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for number, (a, b) in enumerate(chunk_ranges(text, size, overlap))
            ]
            columns = list(zip(*made, strict=True)) or [[]] * 5
            kinds = [batch.column("id").type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["id", "chunk_index", "start", "end", "content"])
        give_back()

    return rows.mapInArrow(run, f"id {kind}, chunk_index long, start long, end long, content string").withColumnRenamed("id", id_col)

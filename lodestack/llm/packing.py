"""Packing by concatenate and cut, with prefix sums over partition token totals.

Pass one tokenizes every document where it lies and writes (partition, offset in the
partition, ids). The totals of the partitions, one number each, are summed up to global
offsets by a window over that small table. Pass two cuts every document at the
multiples of the window length: the position of a token in the endless stream decides
its sequence, so no two tasks need to talk and all sequences but the last are full.
A document that crosses a window's edge gives boundary records, marked as such.

Defined results: null text is the empty text, whose only id is the end mark. Extra
columns are ignored. Documents are never reordered, dropped or shortened; very long
ones give one piece for each window they touch. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.bpe import ENCODE_BYTES, binaries, default_vocabulary, tokenizer
from lodestack.llm.common import gathered, mapped, slices, written

WINDOW = 2048
END_ID = 1
#: Up to so many partitions their offsets are broadcast; beyond, they are joined by a shuffle.
MOST_PARTITIONS = 1_000_000


def token_stream(df: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """Pass one: ids (16 or 32 bits each) with the partition and the offset there."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        width = "<u2" if len(words.tokens) <= 1 << 16 else "<u4"
        for piece in gathered(batches, "text", ENCODE_BYTES):
            ids, edges = words.encode_batch(piece.column("text"))
            ids = np.insert(ids, edges[1:], end_id).astype(width)
            edges = edges + np.arange(len(edges))
            starts = at + edges
            at = int(starts[-1])
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(np.full(len(piece), part, np.int32)), pa.array(starts[:-1]), pa.array(np.diff(edges)), binaries(ids, edges)],
                names=["id", "part", "at", "n", "ids"],
            )

    return mapped(rows, run, f"id {kind}, part int, at long, n long, ids binary")


def global_offsets(stream: DataFrame) -> DataFrame:
    """(part, base): exclusive prefix sums of the partitions' totals, one row for each partition."""
    totals = stream.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Pieces: id, start, length, ids (unsigned 32-bit), doc_tokens, sequence_id, offset, cut_before, cut_after."""
    stream = written(token_stream(df, id_col, text_col, vocabulary or default_vocabulary(), end_id), "token-stream")
    bases = global_offsets(stream)
    if (stream.agg(F.max("part")).first()[0] or 0) < MOST_PARTITIONS:
        bases = F.broadcast(bases)  # 12 bytes for each input partition
    placed = stream.join(bases, "part").select("id", (F.col("base") + F.col("at")).alias("first"), "n", "ids")
    kind = placed.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cut_before", "cut_after"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "ids"):
                out: list[list] = [[] for _ in names]
                for key, first, n, raw in zip(*(piece.column(c).to_pylist() for c in ("id", "first", "n", "ids")), strict=True):
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                    start = 0
                    while start < n:
                        sequence, offset = divmod(first + start, window)
                        length = min(n - start, window - offset)
                        row = (key, start, length, ids[start : start + length].tobytes(), n, sequence, offset, start > 0, start + length < n)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        start += length
                kinds = [piece.column("id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cut_before boolean, cut_after boolean"
    return mapped(placed, cut, schema).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The training sequences: (sequence_id, ids, n_real); ids are unsigned 32-bit, the last sequence is padded.

    A group is one window at most."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(in_order.alias("p"))
    whole = grouped.select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("raw"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_real"),
    )
    padding = np.array([pad_id], "<u4").tobytes()
    return whole.select("sequence_id", F.rpad("raw", F.lit(4 * window), F.lit(padding)).alias("ids"), "n_real")


def with_checksums(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns; checksums are of the ids in the pieces."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cut_before", "cut_after")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return with_checksums(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))

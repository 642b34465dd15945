"""Shared pieces: Arrow batching, samples and folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.batches import give_back, small_batches
from lodestack.storage import delete_path, discard, new_path, shared_dir, written

__all__ = ["delete_path", "discard", "give_back", "new_path", "shared_dir", "small_batches", "written"]

#: White space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of the pieces that a batch to Python is worked on in.
PIECE_BYTES = 1 << 20


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")), F.lit(folds))


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` on small batches."""
    small_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(each, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``limit`` bytes in each piece (one row at least)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist() if batch.num_rows else []
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Small batches joined, and large ones cut, to about ``limit`` bytes of ``column``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in slices(batch, column, limit):
            held.append(piece)
            size += pc.sum(pc.binary_length(piece.column(column))).as_py() or 0
            if size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, by: str, limit: int = PIECE_BYTES) -> DataFrame:
    """``mapInArrow`` over bounded pieces. ``make`` runs once a task and returns the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for piece in gathered(batches, by, limit):
            yield each(piece)

    return mapped(df, run, schema)


def text_udf(make: Callable[[], Callable[[list], list]], returns: str, arrow_type: pa.DataType) -> Callable[[Column], Column]:
    """A scalar Arrow function of a text column. ``make`` runs once a task; its function maps lists to lists."""

    small_batches(SparkSession.active())

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for array in arrays:
            batch = pa.RecordBatch.from_arrays([array], names=["text"])
            out: list = []
            for piece in slices(batch, "text"):
                out.extend(each(piece.column("text").to_pylist()))
            yield pa.array(out, arrow_type)
        give_back()

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


def share_kept(rows: DataFrame, group: str, wanted: int) -> dict:
    """Of each value of ``group``, the share (in millionths) that leaves about ``wanted`` rows."""
    return {r[0]: min(1_000_000, math.ceil(1e6 * wanted / r[1])) for r in rows.groupBy(group).count().collect()}


def hash_share(id_col: str, group: str, shares: dict) -> Column:
    """Keeps by hash of the id the given share of each group: no shuffle, and the same rows every time."""
    if not shares:
        return F.lit(False)
    share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col(group)]
    return F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1_000_000)) < share


def picked_rows(labels: DataFrame, id_col: str, label: str, held_out: Column, per_class: int) -> DataFrame:
    """About ``per_class`` ids of each label value at most, chosen by hash, outside ``held_out``.

    The sample's size does not grow with the table. A document with several labels has the largest."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out).select(F.col(id_col).alias("picked_id"), F.col(label).cast("int").alias("label"))
    some = rows.where(hash_share("picked_id", "label", share_kept(rows, "label", per_class)))
    return some.groupBy("picked_id").agg(F.max("label").alias("label"))


def sigmoid(x):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))

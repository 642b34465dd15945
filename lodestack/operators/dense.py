"""Exact cosine ranking of vectors, by blocks of queries and of the corpus.

The corpus is packed where it lies into blocks of rows near one another, one matrix each,
with a center and the largest angle to it; so are the queries. A pair of blocks is one
matrix product, less the queries whose best the block cannot reach, of which the k best of
every query go on, so what is shuffled is small whatever the corpus holds. Vectors without
any structure spare no products; those of texts lie in groups. Blocks of queries are
broadcast as long as their bytes allow, and otherwise meet the corpus through a shuffle;
neither side ever comes to the driver. Vectors must be finite, not zero and of one
length; the first that is not is named."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.lexical import DIGITS, first_k
from lodestack.storage import written

BLOCK = 2048
#: Blocks of rows, and bytes, that a task gathers before it cuts them into near ones, by this many chosen rows; smaller groups are joined.
GATHERED, GATHERED_BYTES, PIVOTS, LEAST_BLOCK = 8, 32 << 20, 64, 32
#: What a bound may be off by.
SLACK = 1e-9
#: Bytes of query blocks that may be broadcast.
BROADCAST_BYTES = 256 << 20
#: Digits at which scores are compared: beyond them a sum depends on its order.
WHOLE = 12


class Embedder(Protocol):
    """A model that turns texts into vectors of one length."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def _refused(key: object, dims: int | None) -> ValueError:
    return ValueError(f"the vector of {key!r} is null, not finite, zero, or not of {dims} numbers")


def checked(rows: pa.ListArray, keys: pa.Array, dims: int | None = None) -> np.ndarray:
    """A matrix of the vectors; raises with the key of the first that is null, of another length, not finite or zero.

    Arrow's flat values are taken as they are and looked at as a whole."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(rows), -1))
    if dims is None and len(sizes):
        dims = int(sizes[0])
    wrong = (sizes != dims) | (sizes < 1)
    if wrong.any():
        raise _refused(keys[int(wrong.argmax())].as_py(), dims)
    flat = rows.flatten().cast(pa.float64())
    matrix = np.asarray(flat.fill_null(float("nan"))).reshape(len(sizes), dims or 0)
    wrong = ~(np.isfinite(matrix).all(1) & matrix.any(1))
    if wrong.any():
        raise _refused(keys[int(wrong.argmax())].as_py(), dims)
    return matrix


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def vector_errors(df: DataFrame, id_col: str, vec_col: str, dims: int | None = None) -> DataFrame:
    """(id, error): vectors that a ranking would refuse; without ``dims`` the most frequent length is right."""
    v = F.col(vec_col).cast("array<double>")
    if dims is None:
        common = df.groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dims = common["n"] if common else 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    error = (
        F.when(v.isNull(), "null").when(F.size(v) != dims, "length").when(~F.coalesce(finite, F.lit(False)), "not_finite")
        .when(F.forall(v, lambda x: x == 0), "zero")
    )
    return df.select(F.col(id_col).alias("id"), error.alias("error")).where("error IS NOT NULL")


def normalise(df: DataFrame, vec_col: str) -> DataFrame:
    """``df`` with its vectors divided by their lengths; null and zero vectors become null."""
    v = F.col(vec_col).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x))
    return df.withColumn(vec_col, F.when(length > 0, F.transform(v, lambda x: x / length)))


def encode(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Embedder], out_col: str = "embedding") -> DataFrame:
    """(id, vector): the model is made once a task; null texts are empty ones."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, dims = None, None
        for batch in batches:
            if batch.num_rows:
                model = model or make()
                found = np.asarray(model.encode(batch.column("text").to_pylist()), float)
                made = checked(pa.array(list(found), pa.list_(pa.float64())), batch.column("id"), dims)
                dims = made.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(unit(made)), pa.list_(pa.float64()))], names=["id", "vec"])

    return rows.mapInArrow(run, f"id {kind}, vec array<double>").withColumnsRenamed({"id": id_col, "vec": out_col})


def _blocks(df: DataFrame, id_col: str, vec_col: str, side: str, size: int) -> DataFrame:
    """(ids, matrix, dims, center, angle) of blocks of ``size`` rows of one partition at most: rows near one of a few of them, the largest angle to their mean."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        dims, n = None, 0

        def blocks() -> Iterator[pa.RecordBatch]:
            names, vectors = pa.concat_arrays(ids), np.concatenate(held)
            for part in _near(vectors, size):
                own = vectors[part]
                center = own.mean(0)
                length = np.linalg.norm(center)
                center = center / length if length > 1e-9 else own[0]
                angle = float(np.arccos(np.clip((own @ center).min(), -1.0, 1.0)))
                columns = [pa.array([names.take(pa.array(part))], pa.list_(names.type)), *(pa.array([x.tobytes()], pa.binary()) for x in (own, center)), pa.array([dims], pa.int64()), pa.array([angle])]
                yield pa.RecordBatch.from_arrays(columns, names=[f"{side}_{c}" for c in ("ids", "matrix", "center", "dims", "angle")])
            ids.clear()
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            made = unit(checked(batch.column("vec"), batch.column("id"), dims))
            dims, n = made.shape[1], n + batch.num_rows
            ids.append(batch.column("id"))
            held.append(made)
            if n >= GATHERED * size or n * dims * 8 >= GATHERED_BYTES:
                yield from blocks()
                n = 0
        if n:
            yield from blocks()

    return rows.mapInArrow(run, f"{side}_ids array<{kind}>, {side}_matrix binary, {side}_center binary, {side}_dims long, {side}_angle double")


def _near(vectors: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Row numbers in parts of ``size`` at most: rows that lie nearest the same of evenly chosen rows."""
    n = len(vectors)
    chosen = vectors[np.linspace(0, n - 1, max(1, min(PIVOTS, n // 8))).astype(int)]
    label = (vectors @ chosen.T).argmax(1)
    order = np.argsort(label, kind="stable")
    small: list[np.ndarray] = []
    for group in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        for at in range(0, len(group), size):
            part = group[at : at + size]
            if len(part) < LEAST_BLOCK:  # blocks of a few rows cost more than they spare
                small.append(part)
            else:
                yield part
    rest = np.concatenate(small) if small else np.zeros(0, int)
    for at in range(0, len(rest), size):
        yield rest[at : at + size]


def scored_blocks(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query, node, score), candidates that include the ``k`` best, and rows without a query: (made, whole), products made and all there are.

    No row of a block has a larger cosine than that of its center's angle to the query less the block's
    own; where that is under the k-th best score that the task has seen for the query, the two are not
    multiplied. Candidates under that score are not passed on either."""
    kind = dict(corpus.dtypes)[id_col]
    asked = written(_blocks(queries, id_col, vec_col, "query", block), "query-blocks")
    small = (asked.agg(F.sum(F.octet_length("query_matrix"))).first()[0] or 0) <= BROADCAST_BYTES
    pairs = _blocks(corpus, id_col, vec_col, "node", block).crossJoin(F.broadcast(asked) if small else asked)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, np.ndarray] = {}
        names = ["query", "node", "score", "made", "whole"]
        for batch in batches:
            for row in range(batch.num_rows):
                nodes, asks = (batch.column(f"{s}_ids")[row].values for s in ("node", "query"))
                dims = [batch.column(f"{s}_dims")[row].as_py() for s in ("node", "query")]
                if dims[0] != dims[1]:
                    raise ValueError(f"vectors of {dims[0]} and of {dims[1]} numbers cannot be compared")
                matrix, vectors = (np.frombuffer(batch.column(f"{s}_matrix")[row].as_buffer(), float).reshape(-1, dims[0]) for s in ("query", "node"))
                center = np.frombuffer(batch.column("node_center")[row].as_buffer(), float)
                key = (len(asks), asks[0].as_py(), asks[len(asks) - 1].as_py(), matrix[0].tobytes())
                best_seen = seen.setdefault(key, np.full((len(asks), k), -np.inf))
                away = np.arccos(np.clip(matrix @ center, -1.0, 1.0)) - batch.column("node_angle")[row].as_py()
                open_ = np.flatnonzero(np.cos(np.maximum(away, 0.0)) + SLACK >= best_seen[:, 0])
                found: list = [[], [], []]
                if len(open_):
                    order = np.argsort(np.array(nodes.to_pylist(), object), kind="stable")
                    scores = np.round(matrix[open_] @ vectors[order].T, WHOLE)
                    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    values = np.take_along_axis(scores, top, 1)
                    best_seen[open_] = np.sort(np.concatenate([best_seen[open_], values], 1), axis=1)[:, -k:]
                    at, place = np.nonzero(values >= best_seen[open_, 0][:, None])
                    found = [asks.take(pa.array(open_[at])), nodes.take(pa.array(order[top[at, place]])), pa.array(values[at, place])]
                n = len(found[0])
                counts = [[len(open_) * len(nodes)], [len(asks) * len(nodes)]]
                columns = [pa.concat_arrays([pa.array(c, t), pa.nulls(1, t)]) for c, t in zip(found, (asks.type, nodes.type, pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(c, pa.int64())]) for c in counts)], names=names)

    return pairs.mapInArrow(best, f"query {kind}, node {kind}, score double, made long, whole long")


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query, node, score, rank); scores are shown at six digits, ties go by id."""
    found = scored_blocks(corpus, queries, k, id_col, vec_col, block).where("whole IS NULL").select("query", "node", "score")
    return first_k(found, k).withColumn("score", F.round("score", DIGITS))


def products(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(made, whole): the products of two vectors that a ranking makes, and those of all pairs."""
    sums = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("made", "whole"))
    return scored_blocks(corpus, queries, k, id_col, vec_col, block).agg(*sums)

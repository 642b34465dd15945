"""Connected components: by one task where the edges are few, by alternating large and small stars where they are many."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import discard, written

#: Edges that one task may hold.
FEW_EDGES = 200_000


def leads(names: list[int], pairs: Iterator[tuple[int, int]]) -> list[int]:
    """The least name that each position reaches by the pairs of positions."""
    over = list(range(len(names)))

    def top(x: int) -> int:
        while over[x] != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    for i, j in pairs:
        i, j = top(i), top(j)
        if i != j:
            i, j = (i, j) if names[i] < names[j] else (j, i)
            over[j] = i
    return [names[top(k)] for k in range(len(names))]


def connected(edges: DataFrame, bag: list[str]) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b), which is a written table; the label is the smallest node reachable.

    Edges may repeat, go either way and be loops. An empty table gives no rows."""
    return _in_one_task(edges) if edges.count() <= FEW_EDGES else _by_stars(edges, bag)


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[int, int] = {}
        pairs = [(place.setdefault(a, len(place)), place.setdefault(b, len(place))) for batch in batches for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True)]
        names = list(place)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(leads(names, pairs), pa.int64())], names=["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, label long")


def _by_stars(edges: DataFrame, bag: list[str]) -> DataFrame:
    """Rounds go on until nothing changes; every round keeps the components and lowers some node's neighbour, so they
    end. The last written table is left in ``bag``."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        kept = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return kept.where("a <> b").distinct()

    loops = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    last: list[str] = []
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", bag=last)
    before = None
    while True:
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before, old, last = now, last, []
        pairs = written(star(star(pairs, True), False), "edges", bag=last)
        discard(edges.sparkSession, old)
    bag += last
    return loops.join(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))

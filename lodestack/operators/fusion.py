"""Fusing rankings, and ordering their candidates again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.lexical import first_k

_PAIR = ["query", "node"]


def rrf(first: DataFrame, second: DataFrame, k: int = 20, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: (query, node, score, first_rank, second_rank, rank); an absent rank adds nothing."""
    a = first.select(*_PAIR, F.col("rank").alias("first_rank"))
    b = second.select(*_PAIR, F.col("rank").alias("second_rank"))

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (constant + F.col(rank)), F.lit(0.0))

    return first_k(a.join(b, _PAIR, "full_outer").withColumn("score", share("first_rank") + share("second_rank")), k)


def rerank_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query, node, position): the first ranking, then what only the second one has, in its order."""
    both = first.select(*_PAIR, F.lit(0).alias("source"), "rank").union(second.select(*_PAIR, F.lit(1), "rank"))
    once = both.groupBy(*_PAIR).agg(F.min(F.struct("source", "rank")).alias("place"))
    order = Window.partitionBy("query").orderBy("place")
    return once.select(*_PAIR, F.row_number().over(order).cast("long").alias("position"))


def rerank(candidates: DataFrame, score: Column) -> DataFrame:
    """All candidates by ``score`` (an expression over their columns), ties by id."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    scored = candidates.withColumn("score", score)
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))

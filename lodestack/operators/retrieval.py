"""A whole retrieval run: three rankings per query, their rows as results, and the reranking of their candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from time import perf_counter
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators import dense, fusion, lexical
from lodestack.operators.evaluate import RERANKED, require_none
from lodestack.operators.pairs import duplicates, ranking_errors
from lodestack.storage import written

#: Lengths of rankings and the constant of their fusion.
TOP_K, RRF_CONSTANT = 20, 60
NOTE = "All queries are encoded and ranked together; each has an equal share of those times, and none of the index or the encoded corpus."


class PairScorer(Protocol):
    """A model that scores (question, text) pairs, higher for a better answer."""

    def compute_score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def _timed(make: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """What ``make`` gives, and the milliseconds that it took."""
    began = perf_counter()
    made = make()
    return made, 1000 * (perf_counter() - began)


def _merged(words: DataFrame, near: DataFrame, fused: DataFrame) -> DataFrame:
    """(method, query, node, rank, score, bm25_rank, dense_rank) of all three methods."""
    none = F.lit(None).cast("long")
    rows = lambda df, name, a, c: df.select(F.lit(name).alias("method"), "query", "node", "rank", "score", a.alias("bm25_rank"), c.alias("dense_rank"))
    return rows(words, "bm25", none, none).union(rows(near, "dense", none, none)).union(rows(fused, "hybrid", F.col("first_rank"), F.col("second_rank")))


def as_results(ranked: DataFrame, run_id: str, config_hash: str, elapsed: Mapping[str, float], about: Mapping[str, float | str]) -> DataFrame:
    """One row per (query, method) with the ids and the details of its ranking in order, each method's ``elapsed`` and what the run has in common."""
    if not run_id or not config_hash:
        raise ValueError("a run has an id and a configuration")
    rows = ranked.groupBy("query", "method").agg(F.array_sort(F.collect_list(F.struct("rank", "node", "score", "bm25_rank", "dense_rank"))).alias("r"))
    detail = F.transform("r", lambda x: F.struct(x["node"].alias("node_id"), x["rank"].alias("rank"), x["score"].alias("score"), x["bm25_rank"].alias("bm25_rank"), x["dense_rank"].alias("dense_rank")))
    return rows.select(
        F.lit(run_id).alias("run_id"), F.col("query").alias("query_id"), "method", F.transform("r", lambda x: x["node"]).alias("ranked_node_ids"),
        detail.alias("ranked_results"), F.lit(config_hash).alias("config_hash"), F.lit(NOTE).alias("timing_note"),
        F.element_at(F.create_map(*(F.lit(x) for pair in elapsed.items() for x in pair)), F.col("method")).alias("elapsed_ms"), *(F.lit(v).alias(k) for k, v in about.items()),
    )


def as_rankings(results: DataFrame) -> DataFrame:
    """(method, query, node, rank) of rows of results."""
    return results.select("method", F.col("query_id").alias("query"), F.posexplode("ranked_node_ids").alias("at", "node")).select("method", "query", "node", (F.col("at") + 1).cast("long").alias("rank"))


def run_retrieval(nodes: DataFrame, queries: DataFrame, make_embedder: Callable[[], dense.Embedder], run_id: str, config_hash: str, top_k: int = TOP_K, constant: int = RRF_CONSTANT, k1: float = 1.5, b: float = 0.75, model_id: str = "") -> DataFrame:
    """Results of all three methods for every query, with ``top_k`` passages each, and their times.

    Every step is a written table, whose time is taken. Queries are ranked together, so one of them takes an
    equal share of its method's ranking, and of encoding the queries; hybrid takes what both others do and its
    own fusion. The index and the encoded corpus are stated apart."""
    require_none(duplicates(nodes, "node", "node_id").union(duplicates(queries, "query", "query_id")))
    index, index_ms = _timed(lambda: lexical.build_index(nodes, "node_id", "retrieval_text"))
    vectors, corpus_ms = _timed(lambda: written(dense.encode(nodes, "node_id", "retrieval_text", make_embedder), "node-vectors"))
    asked, asked_ms = _timed(lambda: written(dense.encode(queries, "query_id", "query", make_embedder), "query-vectors"))
    words, words_ms = _timed(lambda: written(lexical.bm25_rank(index, queries, top_k, "query_id", "query", k1, b), "bm25-ranking"))
    of = lambda rows, name: rows.withColumnRenamed(name, "id")
    near, near_ms = _timed(lambda: written(dense.dense_topk(of(vectors, "node_id"), of(asked, "query_id"), top_k, "id"), "dense-ranking"))
    fused, fused_ms = _timed(lambda: written(fusion.rrf(words, near, top_k, constant), "hybrid-ranking"))
    n = max(1, queries.count())
    elapsed = {"bm25": words_ms / n, "dense": (asked_ms + near_ms) / n}
    elapsed["hybrid"] = elapsed["bm25"] + elapsed["dense"] + fused_ms / n
    about = {"bm25_index_ms": index_ms, "dense_corpus_encoding_ms": corpus_ms, "dense_query_encoding_batch_ms": asked_ms, "dense_ranking_batch_ms": near_ms, "dense_model_id": model_id}
    return as_results(_merged(words, near, fused), run_id, config_hash, elapsed, about)


def candidate_lists(results: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(query, node, position): per query the bm25 list and then what only the dense one adds; incomplete lists raise."""
    two = results.where(F.col("method").isin("bm25", "dense"))
    listed = two.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("method").alias("methods"), F.min(F.size(F.array_distinct("ranked_node_ids"))).alias("low"), F.max(F.size("ranked_node_ids")).alias("high"))
    bad = listed.where((F.col("n") != 2) | (F.col("methods") != 2) | (F.col("low") != top_k) | (F.col("high") != top_k))
    require_none(bad.select(F.lit("result").alias("scope"), F.col("query_id").alias("key"), F.lit(f"no two lists of {top_k}").alias("error")))
    ranked = as_rankings(two)
    return fusion.rerank_candidates(ranked.where("method = 'bm25'"), ranked.where("method = 'dense'"))


def rerank_queries(results: DataFrame, queries: DataFrame, nodes: DataFrame, make_scorer: Callable[[], PairScorer], run_id: str, config_hash: str, top_k: int = TOP_K) -> DataFrame:
    """Results of method ``rerank_bm25_dense``: all candidates of a query by the scorer's score, ties by id.

    A query's candidates, twice ``top_k`` at most, are scored in one call."""
    candidates = written(candidate_lists(results, top_k), "candidates")
    require_none(ranking_errors(results, nodes, top_k).where("error = 'unknown_node'"))
    texts = lexical.rows_of(nodes.select(F.col("node_id").alias("node"), "retrieval_text"), candidates, "node")
    asked = queries.select(F.col("query_id").alias("query"), F.col("query").alias("question"))
    listed = candidates.join(texts, "node").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("position", "node", "retrieval_text"))).alias("c")).join(asked, "query")
    kinds = [("query_id", pa.string()), ("candidate_node_ids", pa.list_(pa.string())), ("scores", pa.list_(pa.float64())), ("rerank_elapsed_ms", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            out = []
            for query, question, found in zip(*(batch.column(c).to_pylist() for c in ("query", "question", "c")), strict=True):
                scorer = scorer or make_scorer()
                began = perf_counter()
                scores = [float(s) for s in scorer.compute_score([(question, x["retrieval_text"]) for x in found])]
                spent = 1000 * (perf_counter() - began)
                if len(scores) != len(found) or not np.isfinite(scores).all():
                    raise ValueError(f"the scorer gave {len(scores)} scores for {len(found)} candidates of {query!r}, or some that are not finite")
                out.append((query, [x["node"] for x in found], scores, spent))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    scored = listed.select(F.col("query").cast("string"), "question", "c").mapInArrow(run, "query_id string, candidate_node_ids array<string>, scores array<double>, rerank_elapsed_ms double")
    order = F.array_sort(F.transform(F.arrays_zip("candidate_node_ids", "scores"), lambda x: F.struct((-x["scores"]).alias("least"), x["candidate_node_ids"].alias("node_id"), x["scores"].alias("score"))))
    scored = scored.withColumn("o", order)
    return scored.select(
        F.lit(run_id).alias("run_id"), "query_id", F.lit(RERANKED).alias("method"), F.lit(config_hash).alias("config_hash"), "candidate_node_ids",
        F.size("candidate_node_ids").alias("candidate_count"), F.transform("o", lambda x: x["node_id"]).alias("ranked_node_ids"),
        F.transform("o", lambda x, i: F.struct(x["node_id"].alias("node_id"), (i + 1).alias("rank"), x["score"].alias("score"))).alias("ranked_results"), "rerank_elapsed_ms",
    )


def term_overlap(asked: Column, have: Column) -> Column:
    """A stand-in for a scorer: the share of the question's distinct tokens among those of a text, 0 for a question without any."""
    distinct = F.array_distinct(asked)
    return F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, have)) / F.size(distinct)).otherwise(0.0)

"""BM25 ranking over token postings.

The corpus is tokenised once, into a written table of tokens by document, which gives its
size and its mean length. A ranking reads it once, for the numbers and frequencies of the asked
terms in each document, which are written: they tell how many documents have each term, and a
document lies in one row, so the task that reads it knows its whole score for every query:
documents are scored where they lie, and each task gives its best ``k`` of every query. What is shuffled is in
proportion to queries, ``k`` and tasks, and not to the matches of frequent terms. Beyond
``BROADCAST_TERMS`` terms or ``MOST_QUERIES`` queries, postings are joined and sums by (query,
document) shuffled. Contributions are added as whole numbers of
10^-12, so a score does not depend on the order of its sum, and equal documents have equal
scores whatever the plan. Every query gets
exactly min(k, N) rows: where fewer match, the smallest other ids follow with score 0.
Null and empty texts have no terms; null ids are no documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import search_tokens
from lodestack.operators.batches import give_back, small_batches
from lodestack.storage import written

#: Query terms up to this number are broadcast; beyond, they are joined by a shuffle.
BROADCAST_TERMS = 500_000
#: Queries up to this number have a column each where documents are scored; beyond, sums are shuffled.
MOST_QUERIES = 20_000
#: Sums (document, query) that a task holds at once, and contributions that it adds at once.
CELLS, ADDED = 1 << 20, 1 << 20
DIGITS = 6
UNIT = 1e12


@dataclass(frozen=True)
class Index:
    """``tokens`` has (node, dl, tokens), one row per document; two rows of an id are refused."""

    tokens: DataFrame
    n_docs: int
    mean_length: float

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(node, term, tf, dl), of the given terms only where there are some."""
        rows = self.tokens.select("node", "dl", F.explode("tokens").alias("term"))
        if terms is not None:
            rows = rows.join(small(terms), "term", "left_semi")
        return rows.groupBy("node", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))

    def first_ids(self, k: int) -> DataFrame:
        return self.tokens.select("node").orderBy("node").limit(k)


def small(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def rows_of(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose ``key`` is one of ``wanted``, which is read twice; as far as those are few, the others are dropped where they lie."""
    return table.join(small(wanted.select(key).distinct()), key, "left_semi")


def build_index(docs: DataFrame, id_col: str, text_col: str, bag: list[str] | None = None) -> Index:
    """The index of ``docs``; the path of its table is added to ``bag``."""
    rows = docs.select(F.col(id_col).alias("node"), search_tokens(text_col).alias("tokens")).where("node IS NOT NULL")
    tokens = written(rows.select("node", F.size("tokens").alias("dl"), "tokens"), "tokens", bag=bag)
    n, mean, repeated = tokens.agg(F.count(F.lit(1)), F.avg("dl"), F.count(F.lit(1)) - F.count_distinct("node")).first()
    if repeated:
        raise ValueError(f"{repeated} rows repeat an identifier")
    return Index(tokens, n, mean or 0.0)


def first_k(scored: DataFrame, k: int, score: str | Column = "score") -> DataFrame:
    """Rows (query, node, score, ...) of rank k and better, with ``rank``; limited before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc(score) if isinstance(score, str) else score.desc(), "node")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def padded(best: DataFrame, queries: DataFrame, first_ids: DataFrame, k: int) -> DataFrame:
    """``best`` (query, node, score, rank), with the smallest other ids at score 0 where a query has fewer than ``k``."""
    padding = queries.crossJoin(F.broadcast(first_ids)).join(best, ["query", "node"], "left_anti").select("query", "node", F.lit(0.0).alias("score"))
    return first_k(best.drop("rank").union(padding), k)


def weights(df: Column, n_docs: int) -> Column:
    return F.log1p((F.lit(n_docs) - df + 0.5) / (df + 0.5))


def units_of(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, k1: float, b: float) -> np.ndarray:
    """Contributions in whole units; ``length`` is relative to the mean."""
    return np.floor(weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length)) * UNIT).astype(np.int64)


class Asked:
    """The questions of a ranking as arrays: their ids, the asked terms with their weights, and the queries of each term."""

    def __init__(self, ids: pa.Array, terms: pa.Array, weight: np.ndarray, ends: np.ndarray, queries: np.ndarray) -> None:
        self.ids, self.terms, self.weight, self.ends, self.queries = ids, terms, weight, ends, queries

    @classmethod
    def of(cls, asked: DataFrame, weighed: pa.Table) -> Asked:
        """Of (query, term) and (term, weight); terms that no document has are left out."""
        rows, known = asked.toArrow(), weighed.sort_by("term")
        terms = known.column("term").combine_chunks()
        column = rows.column("query").combine_chunks()
        ids = pc.unique(column)
        term = pc.index_in(rows.column("term").combine_chunks(), terms)
        query = pc.index_in(column, ids)
        there = np.asarray(term.is_valid())
        term, query = (np.asarray(x.fill_null(0), np.int64)[there] for x in (term, query))
        order = np.argsort(term, kind="stable")
        return cls(ids, terms, np.asarray(known.column("weight")), np.searchsorted(term[order], np.arange(len(terms) + 1)), query[order])

    def sums(self, row: np.ndarray, term: np.ndarray, units: np.ndarray, n_rows: int) -> np.ndarray:
        """(n_rows, queries): the whole units of every row for every query."""
        out = np.zeros(n_rows * len(self.ids), np.int64)
        wide = self.ends[term + 1] - self.ends[term]
        for part in _parts(wide, ADDED):
            at = np.repeat(np.arange(part.start, part.stop), wide[part])
            own = np.cumsum(wide[part])
            query = self.queries[self.ends[term[at]] + np.arange(len(at)) - np.repeat(own - wide[part], wide[part])]
            np.add.at(out, row[at] * len(self.ids) + query, units[at])
        return out.reshape(n_rows, len(self.ids))


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive places whose sizes are about ``most`` together, one place at least."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


def numbers_of_terms(index: Index, terms: pa.Array) -> DataFrame:
    """(node, dl, terms, tf): of every document the places in ``terms`` of those that it has, in order, and their frequencies."""
    small_batches(index.tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, len(terms))
        for batch in batches:
            tokens = batch.column("tokens")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
            codes = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), terms), -1), np.int64)
            keys, tf = np.unique((np.repeat(np.arange(len(tokens)), sizes) * width + codes)[codes >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(keys, np.arange(len(tokens) + 1) * width), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (keys % width, tf))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("dl"), *lists], names=["node", "dl", "terms", "tf"])
        give_back()

    return index.tokens.select("node", "dl", "tokens").mapInArrow(run, f"node {dict(index.tokens.dtypes)['node']}, dl int, terms array<int>, tf array<int>")


class Best:
    """The best ``k`` rows of every query so far: larger scores first, then smaller ids."""

    def __init__(self, n_queries: int, k: int, kind: type = np.float64) -> None:
        self.k, self.rows, self.least = k, None, np.zeros(n_queries, kind)

    def add(self, scores: np.ndarray, nodes: pa.Array) -> None:
        """``scores`` (nodes, queries), 0 where nothing matches."""
        if len(scores) >= self.k:
            self.least = np.maximum(self.least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, query = np.nonzero((scores > 0) & (scores >= self.least))
        self.put(query, scores[row, query], nodes.take(pa.array(row)))

    def put(self, query: np.ndarray, score: np.ndarray, nodes: pa.Array) -> None:
        if not len(query):
            return
        rows = pa.table({"query": pa.array(query, pa.int64()), "score": pa.array(score), "node": nodes})
        rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        rows = rows.take(pc.sort_indices(rows, [("query", "ascending"), ("score", "descending"), ("node", "ascending")])).combine_chunks()
        query = np.asarray(rows.column("query"))
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.least[query[last]] = np.asarray(rows.column("score"))[last]
        self.rows = rows.filter(pa.array(place < self.k))


def scored_where_they_lie(coded: DataFrame, terms: pa.Array, mean: float, asked: Asked, k: int, constants: Sequence[tuple[float, float]], kind: str) -> DataFrame:
    """(at, query, node, score): of every task and query the best ``k`` documents that match, by each pair (k1, b) of ``constants``.

    ``coded`` is of ``numbers_of_terms``, with the same ``terms``."""
    small_batches(coded.sparkSession)
    n_queries = len(asked.ids)
    place = np.asarray(pc.fill_null(pc.index_in(terms, asked.terms), -1), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(n_queries, k) for _ in constants]
        for batch in batches:
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column("terms"))))
            term, tf = place[np.asarray(batch.column("terms").flatten())], np.asarray(batch.column("tf").flatten(), np.int64)
            length = np.asarray(batch.column("dl"), np.float64)[row] / mean if mean else np.zeros(len(row))
            for part in _parts(np.full(batch.num_rows, n_queries), CELLS):
                own = slice(*np.searchsorted(row, [part.start, part.stop]))
                for (k1, b), held in zip(constants, best, strict=True):
                    units = units_of(asked.weight[term[own]], tf[own], length[own], k1, b)
                    scores = asked.sums(row[own] - part.start, term[own], units, part.stop - part.start) / UNIT
                    held.add(scores, batch.column("node").slice(part.start, part.stop - part.start))
        for at, held in enumerate(best):
            for rows in held.rows.to_batches(max_chunksize=10_000) if held.rows is not None else ():
                columns = [pa.array(np.full(rows.num_rows, at, np.int64)), asked.ids.take(rows.column("query")), rows.column("node"), rows.column("score")]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "query", "node", "score"])
        give_back()

    return coded.mapInArrow(run, f"at long, query {kind}, node {dict(coded.dtypes)['node']}, score double")


def bm25_ranks(index: Index, queries: DataFrame, k: int, query_id: str, query_text: str, constants: Sequence[tuple[float, float]]) -> list[DataFrame]:
    """Of each pair (k1, b) of ``constants`` the ranking (query, node, score, rank); one pass makes them all. Scores are shown at six digits, but ranked whole."""
    asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(search_tokens(query_text))).alias("term"))
    asked = written(asked, "asked-terms")
    terms = asked.select("term").distinct()
    few = terms.count() <= BROADCAST_TERMS
    if few and asked.select("query").distinct().count() <= MOST_QUERIES:
        names = terms.toArrow().column("term").combine_chunks().sort()
        coded = written(numbers_of_terms(index, names), "numbers-of-terms")
        df = coded.select(F.explode("terms").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
        known = df.select("code", weights(F.col("df"), index.n_docs).alias("weight")).toArrow()
        arrays = Asked.of(asked, pa.table({"term": names.take(known.column("code").combine_chunks()), "weight": known.column("weight")}))
        found = written(scored_where_they_lie(coded, names, index.mean_length, arrays, k, constants, dict(asked.dtypes)["query"]), "best-of-tasks")
        scored = [found.where(F.col("at") == at).drop("at") for at in range(len(constants))]
    else:
        found = written(index.postings(terms), "postings")
        scored = [_summed(index, asked, found, *pair) for pair in constants]
    named, first_ids = queries.select(F.col(query_id).alias("query")), written(index.first_ids(k), "first-ids")
    ranked = (padded(first_k(rows, k), named, first_ids, k) for rows in scored)
    return [rows.withColumn("score", F.round("score", DIGITS)) for rows in ranked]


def _summed(index: Index, asked: DataFrame, found: DataFrame, k1: float, b: float) -> DataFrame:
    """(query, node, score) of all matches, by a shuffle of their sums."""
    weighed = found.join(small(found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))), "term")
    length = F.col("dl") / index.mean_length if index.mean_length else F.lit(0.0)
    part = weights(F.col("df"), index.n_docs) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
    return weighed.withColumn("part", F.floor(part * UNIT)).join(small(asked), "term").groupBy("query", "node").agg((F.sum("part") / UNIT).alias("score"))


def bm25_rank(index: Index, queries: DataFrame, k: int, query_id: str, query_text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, node, score, rank) by one pair of constants, as ``bm25_ranks``."""
    return bm25_ranks(index, queries, k, query_id, query_text, [(k1, b)])[0]


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, id_col: str, text_col: str, query_id: str, query_text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``bm25_rank`` over an index of ``docs`` built for it."""
    return bm25_rank(build_index(docs, id_col, text_col), queries, k, query_id, query_text, k1, b)

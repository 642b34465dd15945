"""A BM25 index that is kept: postings in blocks with bounds, so that most of them are never scored.

Documents are dealt to ranges by their length; the postings of a term in a range
are a block, which knows its largest term frequency and its least length. Since lengths
in a range are close, the contribution that these two would give bounds all of the block
well, whatever k1 and b. A document lies in one range, so the sum of the bounds of a
query's blocks in a range bounds every score there. Each query first scores the ranges of
its largest sums; its k-th best score there is what all others must reach. Of the ranges
that can, the blocks of least bounds cannot reach it together, so a document must stand in
one of the others: those are scored, and the rest only where a document may still reach
it. The rows are those of ``lexical.bm25_rank``: sums are whole numbers, and what could
equal the k-th score is scored too.

All blocks of a range lie in one row, so bounds and scores of a range are worked out where it
lies: three passes give each task's best ranges, its best documents in the first ranges, and its
best in the others. Only those are shuffled, and the tokens once, when the index is built.

Where most ranges hold a document that may reach the k-th score, this reads postings twice
and is dearer than ``lexical.bm25_rank``, which ranks over the kept tokens as well.

Tokens and blocks are kept below the shared folder by a key of its input: the plan of the table and
its files with sizes and times, or the digest of all rows where it has no files of its
own. A second use reads nothing else. They are built aside and renamed, so a broken build
leaves nothing; the key names what they were made of, and ``drop_index`` deletes them.

Null ids are no documents, two rows of an id are refused, null texts have no terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.text import search_tokens
from lodestack.operators.batches import give_back, small_batches
from lodestack.operators.lexical import DIGITS, MOST_QUERIES, UNIT, Asked, Best, Index, build_index, first_k, padded, small, units_of, weights
from lodestack.sources.digests import table_digest
from lodestack.sources.files import object_sha256
from lodestack.storage import delete_path, discard, files_of, new_path, path_exists, rename_path, shared_dir, written

#: Documents in a range, about; there are ``MOST_RANGES`` ranges at most, so that a query's list of bounds stays short.
RANGE, MOST_RANGES = 256, 1 << 17
#: A query's first scores come from its ranges of the largest bounds, ``FIRST`` and more until they hold ``k`` matches, of the best ``TRIED``.
FIRST, TRIED = 2, 64
#: Rows of candidates that a task holds before it cuts them to the best.
HELD = 1 << 20
_VERSION = 4
_ABOUT = "n_docs long, mean_length double"


@dataclass(frozen=True)
class KeptIndex:
    """``tokens`` (node, dl, tokens), and ``ranges`` with one row of all postings each: the documents' nodes and lengths, the terms
    with place and number of their postings and their bounds, and by posting the place of its document and its frequency."""

    tokens: DataFrame
    ranges: DataFrame
    n_docs: int
    mean_length: float

    @property
    def blocks(self) -> DataFrame:
        """(term, range, docs)."""
        rows = self.ranges.select("range", "nodes", "lengths", F.arrays_zip("doc", "tf").alias("p"), F.explode("terms").alias("t"))
        docs = F.transform(F.slice("p", F.col("t.at") + 1, F.col("t.n")), lambda x: F.struct(F.get("nodes", x["doc"]).alias("node"), x["tf"].alias("tf"), F.get("lengths", x["doc"]).alias("dl")))
        return rows.select("t.term", "range", docs.alias("docs"))

    @property
    def bounds(self) -> DataFrame:
        """(term, range, n, max_tf, min_dl)."""
        return self.ranges.select("range", F.explode("terms").alias("t")).select("t.term", "range", F.col("t.n").cast("long").alias("n"), "t.max_tf", "t.min_dl")

    def first_ids(self, k: int) -> DataFrame:
        return self.tokens.select("node").orderBy("node").limit(k)


def _range_of(table: pa.Table) -> pa.Table:
    """The row of a range, of its documents (range, node, dl, tokens)."""
    rows = table.column("tokens").combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(rows), 0))
    flat = pc.dictionary_encode(rows.flatten())
    order = pc.sort_indices(flat.dictionary)
    place = np.empty(len(order), np.int64)
    place[np.asarray(order)] = np.arange(len(order))
    keys, tf = np.unique(place[np.asarray(flat.indices, np.int64)] * len(rows) + np.repeat(np.arange(len(rows)), sizes), return_counts=True)
    term, doc = keys // max(1, len(rows)), keys % max(1, len(rows))
    at = np.searchsorted(term, np.arange(len(order)))
    lengths = np.asarray(table.column("dl"))
    n = np.diff(np.append(at, len(term)))
    most, least = (f.reduceat(x, at) if len(at) else at for f, x in ((np.maximum, tf), (np.minimum, lengths[doc])))
    terms = pa.StructArray.from_arrays([flat.dictionary.take(order), *(pa.array(x.astype(np.int32)) for x in (at, n, most, least))], names=["term", "at", "n", "max_tf", "min_dl"])
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    whole = lambda x: pa.array(x.astype(np.int32))
    columns = [table.column("range").combine_chunks().slice(0, 1), one(table.column("node").combine_chunks()), one(whole(lengths)), one(terms), one(whole(doc)), one(whole(tf))]
    return pa.Table.from_arrays(columns, names=["range", "nodes", "lengths", "terms", "doc", "tf"])


def input_key(docs: DataFrame, *more: object) -> str:
    """A digest of what ``docs`` is: its plan and files, or all its rows where they come from elsewhere."""
    spark = docs.sparkSession
    plan, files = docs._jdf.queryExecution().analyzed().canonicalized().toString(), list(docs.inputFiles())
    own = not files or any(kind in plan for kind in ("LogicalRDD", "LocalRelation", "Range ("))
    found = [] if own else files_of(spark, files)
    known = len(found) == len(set(files)) > 0  # a store that lists files under other names than it reads them by tells nothing
    return object_sha256([_VERSION, RANGE, *more, [plan, docs.schema.simpleString(), *found] if known else table_digest(docs)])


def _path(docs: DataFrame, id_col: str, text_col: str, kind: str) -> str:
    return f"{shared_dir(docs.sparkSession)}/lodestack/{kind}-{input_key(docs, id_col, text_col)[:32]}"


def _kept(spark: SparkSession, path: str, build: Callable[[str], None]) -> None:
    """Builds aside and renames, where there is nothing at ``path`` yet."""
    if path_exists(spark, path):
        return
    aside = new_path(spark, "index")
    try:
        build(aside)
        rename_path(spark, aside, path)
    except FileExistsError:  # another session was first
        delete_path(spark, aside)
    except BaseException:
        delete_path(spark, aside)
        raise


def kept_tokens(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """The tokens of ``docs``, as ``lexical.build_index`` makes them, kept for all that rank this input."""
    spark, path = docs.sparkSession, _path(docs, id_col, text_col, "tokens")

    def build(at: str) -> None:
        bag: list[str] = []
        try:
            made = build_index(docs, id_col, text_col, bag)
            spark.createDataFrame([(made.n_docs, made.mean_length)], _ABOUT).coalesce(1).write.parquet(f"{at}/about")
            rename_path(spark, bag.pop(), f"{at}/tokens")
        finally:
            discard(spark, bag)

    _kept(spark, path, build)
    about = spark.read.schema(_ABOUT).parquet(f"{path}/about").first()
    tokens = spark.read.schema(f"node {dict(docs.dtypes)[id_col]}, dl int, tokens array<string>").parquet(f"{path}/tokens")
    return Index(tokens, about["n_docs"], about["mean_length"])


def kept_index(docs: DataFrame, id_col: str, text_col: str) -> KeptIndex:
    """The kept blocks of ``docs``, built from its kept tokens where there are none of this input."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    index, path = kept_tokens(docs, id_col, text_col), _path(docs, id_col, text_col, "blocks")
    _kept(spark, path, lambda at: _build(index, at))
    return KeptIndex(index.tokens, spark.read.schema(_layout(kind)).parquet(path), index.n_docs, index.mean_length)


def _layout(kind: str) -> str:
    return f"range long, nodes array<{kind}>, lengths array<int>, terms array<struct<term:string,at:int,n:int,max_tf:int,min_dl:int>>, doc array<int>, tf array<int>"


def _build(index: Index, path: str) -> None:
    small_batches(index.tokens.sparkSession)
    size = max(RANGE, -(-index.n_docs // MOST_RANGES))
    lengths = index.tokens.groupBy("dl").agg(F.count(F.lit(1)).alias("own"))
    before = Window.orderBy("dl").rowsBetween(Window.unboundedPreceding, -1)  # one row for each length
    lengths = written(lengths.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))), "lengths")
    place = F.col("before") + F.pmod(F.xxhash64("node"), F.col("own"))  # about the place in the order of lengths, without a sort
    ranged = index.tokens.join(small(lengths), "dl").select(F.floor(place / size).cast("long").alias("range"), "node", "dl", "tokens")
    made = ranged.groupBy("range").applyInArrow(_range_of, _layout(dict(index.tokens.dtypes)["node"]))
    made.write.option("compression", "zstd").parquet(path)


def drop_index(docs: DataFrame, id_col: str, text_col: str) -> None:
    """Deletes what is kept of ``docs``, if there is anything."""
    for kind in ("tokens", "blocks"):
        delete_path(docs.sparkSession, _path(docs, id_col, text_col, kind))


class _Lists:
    """Of one range the blocks that queries ask for: an entry for each query and block, with the bound of its contributions."""

    def __init__(self, asked: Asked, terms: pa.StructArray, mean: float, k1: float, b: float) -> None:
        code = pc.index_in(terms.field("term"), asked.terms)
        place = np.flatnonzero(np.asarray(code.is_valid()))
        code = np.asarray(pc.fill_null(code, 0), np.int64)[place]
        field = lambda name: np.asarray(terms.field(name), np.int64)[place]
        self.asked, self.mean, self.k1, self.b, n_queries = asked, mean, k1, b, len(asked.ids)
        self.at, self.n = field("at"), field("n")
        self.weight = asked.weight[code]
        most = units_of(self.weight, field("max_tf"), self._relative(field("min_dl")), k1, b) + 2  # what a rounded contribution may differ by
        wide = asked.ends[code + 1] - asked.ends[code]
        self.block = np.repeat(np.arange(len(place)), wide)
        self.query = asked.queries[np.repeat(asked.ends[code] - np.cumsum(wide) + wide, wide) + np.arange(len(self.block))]
        self.most = most[self.block]
        self.reach, self.matches = np.zeros(n_queries, np.int64), np.zeros(n_queries, np.int64)
        np.add.at(self.reach, self.query, self.most)
        np.maximum.at(self.matches, self.query, self.n[self.block])

    def _relative(self, length: np.ndarray) -> np.ndarray:
        return length / self.mean if self.mean else np.zeros(len(length))

    def count(self, entries: np.ndarray) -> np.ndarray:
        return np.bincount(self.query[entries], minlength=len(self.asked.ids))

    def decides(self, needed: np.ndarray) -> np.ndarray:
        """The entries of a query that the ones of less bounds, which cannot reach ``needed`` together, leave."""
        order = np.lexsort((self.block, self.most, self.query))
        total = np.cumsum(self.most[order])
        starts = np.searchsorted(self.query[order], self.query[order])
        out = np.empty(len(order), bool)
        out[order] = total - (total - self.most[order])[starts] >= needed[self.query[order]]
        return out

    def add(self, sums: np.ndarray, entries: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> None:
        """Adds the contributions of the entries' blocks to ``sums`` (documents, queries)."""
        block, n_queries = self.block[entries], sums.shape[1]
        for some in np.array_split(np.arange(len(block)), max(1, int(self.n[block].sum()) >> 20)):
            n = self.n[block[some]]
            entry = np.repeat(some, n)
            posting = np.repeat(self.at[block[some]] - np.cumsum(n) + n, n) + np.arange(len(entry))
            own = doc[posting]
            units = units_of(self.weight[block[entry]], tf[posting], self._relative(lengths[own]), self.k1, self.b)
            np.add.at(sums.reshape(-1), own * n_queries + self.query[entries][entry], units)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, pa.Array]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("range")[k].as_py(), {c: batch.column(c)[k].values for c in batch.schema.names if c != "range"}


def _best_ranges(index: KeptIndex, asked: Asked, k1: float, b: float) -> DataFrame:
    """(query, range, most, matches): of every task and query the ``TRIED`` ranges of the largest sums; with a null range, the number of its blocks."""
    mean, tried, held_rows = index.mean_length, TRIED, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, blocks = [], 0, np.zeros(len(asked.ids), np.int64)

        def cut() -> np.ndarray:
            query, place, most, matches = (np.concatenate(x) for x in zip(*held, strict=True)) if held else np.zeros((4, 0), np.int64)
            order = np.lexsort((place, -most, query))
            order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < tried]
            return np.stack([query, place, most, matches])[:, order]

        for number, row in _rows(batches):
            lists = _Lists(asked, row["terms"], mean, k1, b)
            blocks += lists.count(np.ones(len(lists.query), bool))
            found = np.flatnonzero(lists.reach)
            held.append(np.stack([found, np.full(len(found), number), lists.reach[found], lists.matches[found]]))
            size += len(found)
            if size > held_rows:
                held = [cut()]
                size = held[0].shape[1]
        there = np.flatnonzero(blocks)
        for columns in (list(map(pa.array, cut())), [pa.array(there), pa.nulls(len(there), pa.int64()), pa.array(blocks[there]), pa.nulls(len(there), pa.int64())]):
            yield pa.RecordBatch.from_arrays(columns, names=["query", "range", "most", "matches"])
        give_back()

    return index.ranges.select("range", "terms").mapInArrow(run, "query long, range long, most long, matches long")


def _best_documents(ranges: DataFrame, asked: Asked, k: int, mean: float, k1: float, b: float, first: dict[int, np.ndarray], needed: np.ndarray | None = None) -> DataFrame:
    """(query, node, units): of every task and query the best ``k`` documents in the query's ``first`` ranges, or, with the units ``needed``,
    in all others; with a null node, the number of the blocks that were scored."""
    kind = dict(ranges.dtypes)["nodes"][len("array<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, scored, n_queries, node_type = Best(len(asked.ids), k, np.int64), np.zeros(len(asked.ids), np.int64), len(asked.ids), None
        for number, row in _rows(batches):
            lists = _Lists(asked, row["terms"], mean, k1, b)
            doc, tf, lengths = (np.asarray(row[c], np.int64) for c in ("doc", "tf", "lengths"))
            own = np.zeros(n_queries, bool)
            own[first.get(number, [])] = True
            sums, node_type = np.zeros((len(lengths), n_queries), np.int64), row["nodes"].type
            if needed is None:
                entries = own[lists.query]
                lists.add(sums, entries, doc, tf, lengths)
                found = sums > 0
            else:
                may = ~own & (lists.reach > 0) & (lists.reach >= needed)
                decides = lists.decides(needed)
                entries, others = may[lists.query] & decides, np.zeros(n_queries, np.int64)
                np.add.at(others, lists.query[~decides], lists.most[~decides])
                lists.add(sums, entries, doc, tf, lengths)
                found = (sums > 0) & (sums + others >= needed)
                late = found.any(axis=0)[lists.query] & ~decides
                lists.add(sums, late, doc, tf, lengths)
                entries = entries | late
            scored += lists.count(entries)
            at, query = np.nonzero(found & (sums >= best.least))
            best.put(query, sums[at, query], row["nodes"].take(pa.array(at)))
        there = np.flatnonzero(scored)
        if best.rows is not None:
            yield from best.rows.select(["query", "node", "score"]).rename_columns(["query", "node", "units"]).to_batches(max_chunksize=10_000)
        if node_type is not None:
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.nulls(len(there), node_type), pa.array(scored[there])], names=["query", "node", "units"])
        give_back()

    return ranges.mapInArrow(run, f"query long, node {kind}, units long")


def _search(index: KeptIndex, asked: DataFrame, k: int, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """(query, node, score) of all that may be among the first ``k``, and (query, blocks, scored)."""
    spark = asked.sparkSession
    small_batches(spark)
    df = index.bounds.join(small(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    arrays = Asked.of(asked, df.select("term", weights(F.col("df"), index.n_docs).alias("weight")).toArrow())
    reach = written(_best_ranges(index, arrays, k1, b), "best-ranges")
    blocks = reach.where("range IS NULL").groupBy("query").agg(F.sum("most").alias("blocks"))
    tried = first_k(reach.where("range IS NOT NULL").withColumnRenamed("range", "node"), TRIED, "most")
    before = F.coalesce(F.sum("matches").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = tried.withColumn("before", before).where((F.col("rank") <= FIRST) | (F.col("before") < k))
    first = written(first.select("query", F.col("node").alias("range")), "first-ranges")
    by_range = {r["range"]: np.array(r["queries"]) for r in first.groupBy("range").agg(F.collect_list("query").alias("queries")).collect()}
    opened = index.ranges.join(F.broadcast(first.select("range").distinct()), "range", "left_semi")
    best = written(_best_documents(opened, arrays, k, index.mean_length, k1, b, by_range), "first-scores")
    needed = np.zeros(len(arrays.ids), np.int64)
    for r in first_k(best.where("node IS NOT NULL"), k, "units").where(F.col("rank") == k).select("query", "units").collect():
        needed[r["query"]] = r["units"]
    rest = written(_best_documents(index.ranges, arrays, k, index.mean_length, k1, b, by_range, needed), "other-scores")
    every = best.unionByName(rest)
    rows = pa.table({"at": pa.array(range(len(arrays.ids)), pa.int64()), "query": arrays.ids})
    ids = F.broadcast(spark.createDataFrame(rows, f"at long, query {dict(asked.dtypes)['query']}"))
    named = lambda df: df.withColumnRenamed("query", "at").join(ids, "at").drop("at")
    counts = blocks.join(every.where("node IS NULL").groupBy("query").agg(F.sum("units").alias("scored")), "query")
    scored = every.where("node IS NOT NULL").select("query", "node", (F.col("units") / UNIT).alias("score"))
    return named(scored).select("query", "node", "score"), named(counts).select("query", "blocks", "scored")


def search(index: KeptIndex, queries: DataFrame, k: int, query_id: str, query_text: str, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """The ranking (query, node, score, rank), and (query, blocks, scored): how many blocks each query has and how many were scored.

    ``MOST_QUERIES`` queries, about, are ranked together."""
    asked = written(queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(search_tokens(query_text))).alias("term")), "asked-terms")
    parts = max(1, -(-asked.select("query").distinct().count() // MOST_QUERIES))
    made = [_search(index, asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part), k, k1, b) for part in range(parts)]
    scored, counts = (reduce(DataFrame.unionByName, x) for x in zip(*made, strict=True))
    ranked = padded(first_k(scored, k), queries.select(F.col(query_id).alias("query")), written(index.first_ids(k), "first-ids"), k)
    return ranked.withColumn("score", F.round("score", DIGITS)), counts


def bm25_rank(index: KeptIndex, queries: DataFrame, k: int, query_id: str, query_text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """As ``lexical.bm25_rank``, over a kept index."""
    return search(index, queries, k, query_id, query_text, k1, b)[0]

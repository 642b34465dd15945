"""Scoring of rankings: gold links, hits, reciprocal ranks, paired outcomes, intervals.

Rankings are rows (method, query, node, rank); gold links are rows (query, node); queries
are rows (query, pair, kind, family). Tables of queries and pairs are small beside the
corpus, but nothing here needs them in one place, except that the pairs of a resampling
get running numbers."""

from __future__ import annotations

import random
import struct
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestack.operators.batches import give_back, small_batches
from lodestack.operators.numbering import numbered

#: Names of the outcomes, methods, kinds of query, metrics and compared methods.
TRANSITIONS = ("hit→hit", "hit→miss", "miss→hit", "miss→miss")
METHODS = ("bm25", "dense", "hybrid")
RERANKED = "rerank_bm25_dense"
KINDS = ("high_lexical_overlap", "low_lexical_overlap")
METRICS = ("high_hit", "low_hit", "hit_drop", "high_rr", "low_rr", "rr_drop")
DROPS = ("hit_drop", "rr_drop")
COMPARED = (("hybrid", "bm25"), ("hybrid", "dense"), ("dense", "bm25"))
#: Numbers of a twister's state, and draws of a batch.
_STATE, _DRAWS = 625, 10_000
#: Words of the window that a containing text must share, as far as an item has inner words.
ANCHOR = 3
#: Items up to this number are broadcast; beyond, joined by a shuffle.
BROADCAST_ITEMS = 200_000
#: Items, and their characters, that one machine looks for; more are dealt to several passes.
SHORT_ITEMS, MACHINE_CHARS = 50_000, 2_000_000
#: Passes over the texts that are cheaper than to find long items by windows of words.
MOST_PASSES = 8


def _window_hashes(starts: Column, size: int) -> Column:
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, size))))


def containment_qrels(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """(query, node) where the document's text contains the item's.

    The items are looked for together, by one machine that reads every text once where it lies, so only
    links are shuffled. ``SHORT_ITEMS`` and ``MACHINE_CHARS`` bound a machine; more items take several passes,
    ``MOST_PASSES`` at most: beyond, items that have inner words are found by those."""
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_id).alias("query"), F.col(item_text).alias("item")).where("item IS NOT NULL")
    found, passes = None, _passes(asked)
    if passes > MOST_PASSES:
        asked = asked.withColumn("words", F.split("item", r"\s+")).withColumn("inner", F.least(F.size("words") - 2, F.lit(ANCHOR)))
        found = _anchored_links(texts, asked.where("inner > 0"))
        asked = asked.where("inner <= 0").select("query", "item")
        passes = _passes(asked)
    for part in range(passes):
        some = short_links(texts, asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == part))
        found = some if found is None else found.union(some)
    if found is None:
        return texts.select(F.lit(None).cast(asked.schema["query"].dataType).alias("query"), "node").limit(0)
    return found.distinct()


def _passes(items: DataFrame) -> int:
    """How many machines the items take."""
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("item")), F.lit(0))).first()
    return max(-(-n // SHORT_ITEMS), -(-chars // MACHINE_CHARS))


def _anchored_links(texts: DataFrame, asked: DataFrame) -> DataFrame | None:
    """(query, node), some several times, of items (query, item, words, inner) with inner words.

    Those are whole words of any text that contains the item, so an equi-join on the hash of up to
    three of them finds the candidates and ``contains`` decides. Windows of a text that no item asks
    for are dropped before anything is shuffled, as far as the items may be broadcast."""
    sizes = {r["inner"]: r["n"] for r in asked.groupBy("inner").agg(F.count(F.lit(1)).alias("n")).collect()}
    words, found = texts.select("node", F.split("text", r"\s+").alias("words")), None
    for size in sorted(sizes):
        middle = F.greatest(F.lit(2), F.floor(F.size("words") / 2).cast("int"))
        anchored = asked.where(F.col("inner") == size).select("query", "item", F.xxhash64(F.slice("words", middle, size)).alias("anchor"))
        starts = F.sequence(F.lit(1), F.size("words") - (size - 1))
        windows = words.where(F.size("words") >= size).select("node", F.explode(_window_hashes(starts, size)).alias("anchor"))
        candidates = windows.join(F.broadcast(anchored) if sizes[size] <= BROADCAST_ITEMS else anchored, "anchor").select("node", "query", "item")
        some = candidates.join(texts, "node").where(F.contains("text", "item")).select("query", "node")
        found = some if found is None else found.union(some)
    return found


def short_links(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(query, node): every text (node, text) with the items (query, item) that it contains, all found in one pass over the text.

    Equal items are one entry of the machine. The empty item is in every text; null texts contain nothing."""
    small_batches(texts.sparkSession)
    kinds = {"query": items.schema["query"].dataType.simpleString(), "node": texts.schema["node"].dataType.simpleString()}
    grouped = [(r["item"], [q["query"] for q in r["queries"]]) for r in items.groupBy("item").agg(F.collect_list(F.struct("query")).alias("queries")).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, always = ahocorasick.Automaton(), []
        for k, (item, queries) in enumerate(grouped):
            if item:
                machine.add_word(item, k)
            else:
                always = queries
        machine.make_automaton()
        for batch in batches:
            made: tuple[list, list] = ([], [])
            for row, text in enumerate(batch.column("text").to_pylist()):
                hits = {k for _, k in machine.iter(text)} if len(machine) else ()
                queries = [*always, *(q for k in hits for q in grouped[k][1])]
                made[0].extend(queries)
                made[1].extend([row] * len(queries))
            yield pa.RecordBatch.from_arrays([pa.array(made[0], kind), batch.column("node").take(pa.array(made[1], pa.int64()))], names=["query", "node"])
        give_back()

    kind = to_arrow_type(items.schema["query"].dataType)
    return texts.where("text IS NOT NULL").select("node", "text").mapInArrow(run, f"query {kinds['query']}, node {kinds['node']}")


def enclosing_pairs(spans: DataFrame, nodes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(job, start, end, node_id, ...): every passage that holds all of a span, with its columns ``keep``.

    ``nodes`` has (job, node_id, start_offset, end_offset). A passage whose length is at most 2^level lies in
    one or two buckets of that width; a span asks for the bucket of its start at every level that
    there is, so spans and passages meet by (job, level, bucket) and the work is in proportion to
    both and to what is found, whatever the length of the job's text. Null jobs and places, and passages that end
    before they start hold nothing."""
    length = F.col("end_offset") - F.col("start_offset")
    level = F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")
    bucket = lambda place, level: F.floor(place / F.pow(F.lit(2.0), level)).cast("long")
    ranges = nodes.select("job", "node_id", "start_offset", "end_offset", *(c for c in keep if c not in ("start_offset", "end_offset"))).where(length >= 0).withColumn("_level", level)
    levels = sorted(r[0] for r in ranges.select("_level").distinct().collect())
    first, last = (bucket(F.col(c), F.col("_level")) for c in ("start_offset", "end_offset"))
    ranges = ranges.select("*", F.explode(F.sequence(first, last)).alias("_bucket"))
    asked = spans.select("job", "start", "end").where((F.col("start") <= F.col("end")) & F.col("job").isNotNull()).distinct()
    asked = asked.select("*", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("_level")).withColumn("_bucket", bucket(F.col("start"), F.col("_level")))
    inside = (F.col("start_offset") <= F.col("start")) & (F.col("end_offset") >= F.col("end"))
    return asked.join(ranges, ["job", "_level", "_bucket"]).where(inside).drop("_level", "_bucket")


def enclosing(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """``spans`` (job, start, end, ...) with the sorted ids of the passages that hold all of each, none where there are none."""
    keys = ["job", "start", "end"]
    found = enclosing_pairs(spans, nodes).groupBy(*keys).agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))
    return spans.join(found, keys, "left").withColumn("node_ids", F.coalesce("node_ids", F.array().cast("array<string>")))


def score_rankings(rankings: DataFrame, qrels: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Per query that has gold (and per value of ``by``): hit, rr, first_rank, looking at the first k ranks.

    A query that a method ranks nothing for scores 0 with it, if the method ranks something."""
    keys = [*by, "query"]
    hits = rankings.where(F.col("rank") <= k).join(qrels, ["query", "node"], "left_semi")
    first = hits.groupBy(*keys).agg(F.min("rank").alias("first_rank"))
    grid = qrels.select("query").distinct()
    for name in by:
        grid = grid.crossJoin(F.broadcast(rankings.select(name).distinct()))
    scored = grid.join(first, keys, "left")
    return scored.select(*keys, F.col("first_rank").isNotNull().cast("long").alias("hit"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"), "first_rank")


def paired_outcomes(scores: DataFrame, queries: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """One row per pair and method: hits, reciprocal ranks, drops and the transition.

    ``scores`` has (method, query, hit, rr), ``queries`` (query, pair, kind, family). A pair that
    lacks one of its kinds is left out; ``grid_errors`` tells."""
    kinds = queries.select("query", "pair", "kind", "family")
    side = lambda kind, col: F.max(F.when(F.col("kind") == kind, F.col(col)))
    sides = [side(kind, col).alias(f"{name}_{col}") for name, kind in zip(("high", "low"), KINDS, strict=True) for col in ("query", "hit", "rr")]
    both = scores.join(kinds, "query").groupBy("pair", *by).agg(F.min("family").alias("family"), *sides).where("high_query IS NOT NULL AND low_query IS NOT NULL")
    name = lambda c: F.when(F.col(c) == 1, "hit").otherwise("miss")
    return both.select(
        "pair", *by, "family", "high_query", "low_query", "high_hit", "low_hit", (F.col("high_hit") - F.col("low_hit")).alias("hit_drop"),
        "high_rr", "low_rr", (F.col("high_rr") - F.col("low_rr")).alias("rr_drop"), F.concat(name("high_hit"), F.lit("→"), name("low_hit")).alias("transition"),
    )


def main_table(outcomes: DataFrame, by: Sequence[str] = ("method",), digits: int = 6) -> DataFrame:
    """Per group: the number of pairs and the mean of every metric."""
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("pair_count"), *(F.round(F.avg(F.col(m).cast("double")), digits).alias(m) for m in METRICS))


def transition_summary(outcomes: DataFrame, digits: int = 6) -> DataFrame:
    """(method, transition, pairs, share) with all four transitions of every method."""
    every = outcomes.sparkSession.createDataFrame([(t,) for t in TRANSITIONS], "transition string")
    totals = outcomes.groupBy("method").agg(F.count(F.lit(1)).alias("total"))
    counts = outcomes.groupBy("method", "transition").agg(F.count(F.lit(1)).alias("pairs"))
    filled = totals.crossJoin(F.broadcast(every)).join(counts, ["method", "transition"], "left")
    pairs = F.coalesce("pairs", F.lit(0).cast("long"))
    return filled.select("method", "transition", pairs.alias("pairs"), F.round(pairs / F.col("total"), digits).alias("share"))


def long_metrics(outcomes: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """(pair, method, metric, value): one row per pair, method and metric."""
    wide = outcomes.select("pair", "method", *(F.col(m).cast("double").alias(m) for m in METRICS))
    return wide.unpivot(["pair", "method"], list(METRICS), "metric", "value")


def numbered_pairs(outcomes: DataFrame) -> DataFrame:
    """(pair, idx): the sorted pairs counted from 0, however many there are."""
    pairs = outcomes.select("pair").distinct().withColumn("_all", F.lit(0))
    return numbered(pairs, "_all", ["pair"], "_number").select("pair", (F.col("_number") - 1).alias("idx"))


def hashed_draws(spark: SparkSession, n_pairs: int, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, idx): for each replicate ``n_pairs`` numbers below it, drawn with replacement by md5, as any engine can."""
    draws = spark.range(replicates * n_pairs).select(F.floor(F.col("id") / n_pairs).alias("replicate"), F.pmod("id", F.lit(n_pairs)).alias("i"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("i").cast("string")).cast("binary"))
    return draws.select("replicate", F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(n_pairs)).alias("idx"))


def twister_draws(spark: SparkSession, n_pairs: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, idx) as Python's Mersenne twister gives them, one replicate after another from one seed.

    The driver steps through the sequence and keeps the generator's state at the start of each replicate
    (2.5 KB); tasks take the draws up from there, a few thousand at a time."""
    twister, states = random.Random(seed), []
    for r in range(replicates):
        states.append((r, struct.pack(f"<{_STATE}I", *twister.getstate()[1])))
        for _ in range(n_pairs):
            twister.randrange(n_pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, state in zip(batch.column("replicate").to_pylist(), batch.column("state").to_pylist(), strict=True):
                own = random.Random()
                own.setstate((3, struct.unpack(f"<{_STATE}I", state), None))
                for at in range(0, n_pairs, _DRAWS):
                    drawn = [own.randrange(n_pairs) for _ in range(min(_DRAWS, n_pairs - at))]
                    yield pa.RecordBatch.from_arrays([pa.array([r] * len(drawn), pa.int64()), pa.array(drawn, pa.int64())], names=["replicate", "idx"])

    return spark.createDataFrame(states, "replicate long, state binary").mapInArrow(run, "replicate long, idx long")


def _check_bootstrap(replicates: int, confidence: float) -> None:
    if replicates < 100:
        raise ValueError("a hundred replicates at least")
    if not 0 < confidence < 1:
        raise ValueError("confidence lies between 0 and 1")


def replicate_means(outcomes: DataFrame, draws: DataFrame) -> DataFrame:
    """(replicate, method, metric, mean): every draw takes a pair with all its methods and both kinds of query.

    A pair drawn several times weighs so often; weights are summed before they meet the values."""
    weights = draws.groupBy("replicate", "idx").agg(F.count(F.lit(1)).alias("times"))
    values = long_metrics(outcomes).join(numbered_pairs(outcomes), "pair").select("idx", "method", "metric", "value")
    drawn = weights.join(values, "idx")
    mean = F.sum(F.col("value") * F.col("times")) / F.sum("times")
    return drawn.groupBy("replicate", "method", "metric").agg(F.round(mean, 9).alias("mean"))


def _ends(rows: DataFrame, keys: Sequence[str], value: str, confidence: float) -> DataFrame:
    tail = (1 - confidence) / 2
    limits = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    ends = rows.groupBy(*keys).agg(limits.alias("ends"))
    return ends.select(*keys, F.round(F.col("ends")[0], 6).alias("low"), F.round(F.col("ends")[1], 6).alias("high"))


def bootstrap_intervals(outcomes: DataFrame, means: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(method, metric, estimate, low, high) of replicate means."""
    estimates = long_metrics(outcomes).groupBy("method", "metric").agg(F.round(F.avg("value"), 6).alias("estimate"))
    return estimates.join(_ends(means, ["method", "metric"], "mean", confidence), ["method", "metric"])


def method_differences(outcomes: DataFrame, means: DataFrame, compared: Sequence[tuple[str, str]] = COMPARED, metrics: Sequence[str] = DROPS, confidence: float = 0.95) -> DataFrame:
    """(method_a, method_b, metric, difference, low, high): within every replicate, the first method less the second."""
    pairs = outcomes.sparkSession.createDataFrame([(a, b) for a, b in compared], "method_a string, method_b string")

    def less(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
        a = rows.where(F.col("metric").isin(*metrics)).withColumnsRenamed({"method": "method_a", value: "a"})
        b = rows.withColumnsRenamed({"method": "method_b", value: "b"})
        return a.join(F.broadcast(pairs), "method_a").join(b, [*keys, "metric", "method_b"]).withColumn("difference", F.round(F.col("a") - F.col("b"), 9))

    keys = ["method_a", "method_b", "metric"]
    estimates = long_metrics(outcomes).groupBy("method", "metric").agg(F.avg("value").alias("value"))
    found = less(estimates, "value", []).select(*keys, F.round("difference", 6).alias("difference"))
    return found.join(_ends(less(means, "mean", ["replicate"]), keys, "difference", confidence), keys)


def summarize_pairs(outcomes: DataFrame, draws: DataFrame, replicates: int, confidence: float = 0.95, compared: Sequence[tuple[str, str]] = COMPARED, metrics: Sequence[str] = DROPS) -> dict[str, DataFrame]:
    """All tables of a paired analysis: means, transitions, intervals, differences and means by family."""
    _check_bootstrap(replicates, confidence)
    means = replicate_means(outcomes, draws)
    return {
        "main_table": main_table(outcomes),
        "pair_outcomes": outcomes,
        "transition_summary": transition_summary(outcomes),
        "bootstrap_intervals": bootstrap_intervals(outcomes, means, confidence),
        "method_drop_differences": method_differences(outcomes, means, compared, metrics, confidence),
        "family_descriptive": main_table(outcomes, ("method", "family")),
    }


def candidate_coverage(candidates: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """(kind, method, query_count, covered, coverage): the share of queries whose candidates hold some gold passage.

    ``candidates`` has (method, query, node) and ``qrels`` all queries that count."""
    held = candidates.join(qrels, ["query", "node"], "left_semi").select("method", "query").distinct().withColumn("covered", F.lit(1).cast("long"))
    grid = qrels.select("query").distinct().join(queries.select("query", "kind"), "query").crossJoin(F.broadcast(candidates.select("method").distinct()))
    counted = grid.join(held, ["method", "query"], "left").groupBy("kind", "method").agg(F.count(F.lit(1)).alias("query_count"), F.count("covered").alias("covered"))
    return counted.withColumn("coverage", F.round(F.col("covered") / F.col("query_count"), 6))


def grid_errors(results: DataFrame, queries: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """(query, method, error): rows that a complete grid of results lacks, has twice, or should not have."""
    wanted = queries.select("query").distinct().crossJoin(F.broadcast(queries.sparkSession.createDataFrame([(m,) for m in methods], "method string")))
    there = results.groupBy("query", "method").agg(F.count(F.lit(1)).alias("n"))
    both = wanted.withColumn("wanted", F.lit(True)).join(there, ["query", "method"], "full_outer")
    error = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.select("query", "method", error.alias("error")).where("error IS NOT NULL")


def _wrong(df: DataFrame, checks: dict[str, Column], *keys: Column) -> DataFrame:
    """(scope, key, error) with one row for each check that holds."""
    found = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())), lambda e: e.isNotNull())
    return df.select(*keys, F.explode(found).alias("error"))


def result_errors(results: DataFrame, qrels: DataFrame, queries: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """(scope, key, error): everything that bars a run from being scored.

    ``results``: (run_id, config_hash, query_id, method, ranked_node_ids[, ranked_results]); ``qrels``: (query_id,
    evidence_node_ids); ``queries``: (query_id, pair_id, query_type[, evidence_node_ids])."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    twice = lambda df, scope: df.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(scope).alias("scope"), F.col("query_id").alias("key"), F.lit("duplicate").alias("error"))
    gold = F.col("evidence_node_ids")
    bad_gold = {"no_gold": F.coalesce(F.size(gold), F.lit(0)) < 1, "empty_gold_id": F.exists(gold, lambda x: F.coalesce(x, F.lit("")) == ""), "duplicate_gold": F.size(F.array_distinct(gold)) < F.size(gold)}
    parts = [twice(queries, "query"), twice(qrels, "qrel"), _wrong(qrels, bad_gold, F.lit("qrel").alias("scope"), F.col("query_id").alias("key"))]
    parts.append(_wrong(queries, {"empty_query_id": blank("query_id"), "empty_pair_id": blank("pair_id"), "unknown_kind": ~F.coalesce(F.col("query_type").isin(*KINDS), F.lit(False))}, F.lit("query").alias("scope"), F.col("query_id").alias("key")))
    sides = queries.select("query_id", F.lit(True).alias("asked")).distinct().join(qrels.select("query_id", F.lit(True).alias("judged")).distinct(), "query_id", "full_outer")
    parts.append(_wrong(sides, {"no_qrel": F.col("judged").isNull(), "no_query": F.col("asked").isNull()}, F.lit("qrel").alias("scope"), F.col("query_id").alias("key")))
    if "evidence_node_ids" in queries.columns:
        both = queries.select("query_id", F.array_sort(F.array_distinct("evidence_node_ids")).alias("a")).join(qrels.select("query_id", F.array_sort(F.array_distinct("evidence_node_ids")).alias("b")), "query_id")
        parts.append(_wrong(both, {"gold_differs": F.col("a") != F.col("b")}, F.lit("qrel").alias("scope"), F.col("query_id").alias("key")))
    key = F.concat_ws("/", "query_id", "method").alias("key")
    ranked = F.col("ranked_node_ids")
    checks = {
        "no_run": blank("run_id") | blank("config_hash"),
        "bad_ranking": ranked.isNull() | F.exists(ranked, lambda x: F.coalesce(x, F.lit("")) == ""),
        "repeated_node": F.size(F.array_distinct(ranked)) < F.size(ranked),
    }
    if "ranked_results" in results.columns:
        detail = F.col("ranked_results")
        checks["ids_differ"] = F.transform(detail, lambda r: r["node_id"]) != ranked
        checks["rank_gap"] = F.transform(detail, lambda r: r["rank"].cast("int")) != F.transform(ranked, lambda _, i: (i + 1).cast("int"))
    parts.append(_wrong(results, checks, F.lit("result").alias("scope"), key))
    named = F.col("query_id").alias("query")
    grid = grid_errors(results.select(named, "method"), queries.select(named), methods)
    parts.append(grid.select(F.lit("result").alias("scope"), F.concat_ws("/", "query", "method").alias("key"), "error"))
    runs = results.agg(F.count_distinct("run_id", "config_hash").alias("n")).where("n > 1")
    parts.append(runs.select(F.lit("run").alias("scope"), F.col("n").cast("string").alias("key"), F.lit("several_runs").alias("error")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def require_none(errors: DataFrame, most: int = 20) -> None:
    """Raises with the first few errors, if there are any."""
    found = errors.orderBy(*errors.columns).limit(most + 1).collect()
    if found:
        shown = "\n".join("- " + ": ".join(map(str, row)) for row in found[:most])
        raise ValueError(f"{len(found) if len(found) <= most else f'over {most}'} errors\n{shown}")


def evaluate_results(results: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 5, methods: Sequence[str] = METHODS) -> DataFrame:
    """Scores of a run whose tables are complete and agree; anything else raises.

    (run_id, config_hash, query_id, pair_id, query_type, source_job_family, method, source_evidence_hit_at_5,
    source_evidence_rr_at_5, first_source_evidence_rank, top5_node_ids, evidence_node_ids), by query and method."""
    if k != 5:
        raise ValueError("the metrics are fixed at the first five")
    require_none(result_errors(results, qrels, queries, methods))
    place = F.filter(F.transform(F.slice("ranked_node_ids", 1, k), lambda x, i: F.when(F.array_contains("evidence_node_ids", x), i + 1)), lambda p: p.isNotNull())
    family = F.col("source_job_family") if "source_job_family" in queries.columns else F.lit(None).cast("string")
    about = queries.select("query_id", "pair_id", "query_type", family.alias("source_job_family"))
    joined = results.select("run_id", "config_hash", "query_id", "method", "ranked_node_ids").join(qrels.select("query_id", "evidence_node_ids"), "query_id").join(about, "query_id").withColumn("first", F.get(place, F.lit(0)))
    number = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    return joined.orderBy("query_id", number).select(
        "run_id", "config_hash", "query_id", "pair_id", "query_type", "source_job_family", "method",
        F.col("first").isNotNull().cast("int").alias("source_evidence_hit_at_5"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("source_evidence_rr_at_5"),
        F.col("first").alias("first_source_evidence_rank"), F.slice("ranked_node_ids", 1, k).alias("top5_node_ids"), "evidence_node_ids",
    )


def outcomes_of(scores: DataFrame) -> DataFrame:
    """``paired_outcomes`` of the rows of ``evaluate_results``."""
    slim = scores.select("method", F.col("query_id").alias("query"), F.col("source_evidence_hit_at_5").cast("long").alias("hit"), F.col("source_evidence_rr_at_5").alias("rr"))
    about = scores.select(F.col("query_id").alias("query"), F.col("pair_id").alias("pair"), F.col("query_type").alias("kind"), F.col("source_job_family").alias("family")).distinct()
    return paired_outcomes(slim, about)


def pair_errors(scores: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """(scope, key, error): pairs whose methods or kinds of query do not belong together."""
    wanted = len(methods) * len(KINDS)
    gold = F.array_sort(F.array_distinct("evidence_node_ids"))
    grouped = scores.groupBy(F.col("pair_id").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("method", "query_type").alias("cells"), F.count_distinct("query_id").alias("ids"),
        F.count_distinct("query_type", "query_id").alias("typed"), F.count_distinct(gold).alias("golds"),
        F.count_distinct(F.coalesce("source_job_family", F.lit(""))).alias("families"),
    )
    checks = {
        "duplicate_row": F.col("n") > F.col("cells"), "incomplete": F.col("cells") != wanted, "shared_query_id": F.col("ids") < len(KINDS),
        "query_differs": F.col("typed") > len(KINDS), "gold_differs": F.col("golds") > 1, "family_differs": F.col("families") > 1,
    }
    return _wrong(grouped, checks, F.lit("pair").alias("scope"), "key")


def analyze_reranked(base: DataFrame, reranked: DataFrame, queries: DataFrame, qrels: DataFrame, draws: DataFrame, replicates: int, confidence: float = 0.95) -> dict[str, DataFrame]:
    """The paired analysis of three methods and a reranking of their candidates: four methods, six metrics, coverage, differences.

    ``base`` and ``reranked`` are rows of results; ``reranked`` has candidate_node_ids and rerank_elapsed_ms too."""
    ranked, listed = F.col("ranked_node_ids"), F.col("candidate_node_ids")
    checks = {"not_a_permutation": (F.array_sort(ranked) != F.array_sort(listed)) | (F.size(F.array_distinct(ranked)) < F.size(ranked)), "too_short": F.size(ranked) < 5, "unknown_method": F.col("method") != RERANKED}
    require_none(_wrong(reranked, checks, F.lit("result").alias("scope"), F.col("query_id").alias("key")))
    columns = ["run_id", "config_hash", "query_id", "method", "ranked_node_ids"]
    scores = evaluate_results(base, qrels, queries).unionByName(evaluate_results(reranked.select(*columns), qrels, queries, methods=(RERANKED,)))
    outcomes = outcomes_of(scores)
    tables = summarize_pairs(outcomes, draws, replicates, confidence, [(RERANKED, m) for m in METHODS], METRICS)
    pool = base.select("method", F.col("query_id").alias("query"), F.explode("ranked_node_ids").alias("node")).union(reranked.select(F.lit("bm25_dense_union"), "query_id", F.explode("candidate_node_ids")))
    gold = qrels.select(F.col("query_id").alias("query"), F.explode("evidence_node_ids").alias("node"))
    about = queries.select(F.col("query_id").alias("query"), F.col("query_type").alias("kind"))
    tables["paired_differences"] = tables.pop("method_drop_differences")
    tables["candidate_coverage"] = candidate_coverage(pool, gold, about)
    tables["mean_rerank_ms_per_query"] = reranked.agg(F.avg("rerank_elapsed_ms").alias("mean_rerank_ms_per_query"))
    return tables

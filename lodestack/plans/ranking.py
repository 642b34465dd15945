"""Queries of rankings and of their evaluation.

Three methods rank the corpus for two kinds of question. The stand-in for a neural ranking
is BM25 with other constants, so that SQL can say the same; no figure here is comparable
with published quality numbers. Resampling draws by md5, which both engines have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import search_tokens
from lodestack.operators import dense, evaluate, fusion, kept_index, lexical, report
from lodestack.operators.retrieval import term_overlap
from lodestack.plans.tables import sql_tokens, table
from lodestack.storage import written

K = 20
REPLICATES = 500
#: Letters of the words that a question in other words is left with.
SHORT = 4
#: k1 and b of the rankings that stand for the first two methods.
CONSTANTS = {"bm25": (1.5, 0.75), "dense": (0.6, 0.2)}


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, pair, kind, family, text): every item whole, and its short words only."""
    items = table(spark, sf_dir, "benchmark")
    short = F.filter(search_tokens("text"), lambda t: F.length(t) <= SHORT)
    sides = F.array(
        F.struct(F.lit("high").alias("end"), F.lit(evaluate.KINDS[0]).alias("kind"), F.col("text").alias("text")),
        F.struct(F.lit("low").alias("end"), F.lit(evaluate.KINDS[1]).alias("kind"), F.array_join(short, " ").alias("text")),
    )
    rows = items.select("item_id", F.explode(sides).alias("s"))
    return rows.select(F.concat_ws("_", "item_id", "s.end").alias("query"), F.col("item_id").alias("pair"), "s.kind", (F.col("item_id") % 4).cast("string").alias("family"), "s.text")


def _index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """Tokens are made by the first query that needs them, and kept for the others."""
    return kept_index.kept_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    return kept_index.search(kept_index.kept_index(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"), K, "item_id", "text")


def _rankings(spark: SparkSession, sf_dir: str, k: int = K, index: lexical.Index | None = None) -> DataFrame:
    """(method, query, node, rank) of all three methods, over one index; written, since several steps read it."""
    index, questions = index or _index(spark, sf_dir), written(_questions(spark, sf_dir).select("query", "text"), "questions")
    made = lexical.bm25_ranks(index, questions, k, "query", "text", list(CONSTANTS.values()))
    ranked = {m: written(rows, m) for m, rows in zip(CONSTANTS, made, strict=True)}
    ranked["hybrid"] = fusion.rrf(ranked["bm25"], ranked["dense"], k)
    out = None
    for method, rows in ranked.items():
        named = rows.select(F.lit(method).alias("method"), "query", "node", "rank")
        out = named if out is None else out.union(named)
    return written(out, "rankings")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, node) of both kinds of question."""
    links = evaluate.containment_qrels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    ends = F.explode(F.array(F.lit("high"), F.lit("low")))
    return links.select(ends.alias("end"), "query", "node").select(F.concat_ws("_", "query", "end").alias("query"), "node")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = written(_gold(spark, sf_dir), "gold")
    scores = evaluate.score_rankings(_rankings(spark, sf_dir), gold, by=["method"])
    return written(evaluate.paired_outcomes(scores, _questions(spark, sf_dir)), "outcomes")


def _dense(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """All numbers of the vectors, or the first ``dims`` for a second, other ranking."""
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.select("vec_id", (F.slice("embedding", 1, dims) if dims else F.col("embedding")).alias("embedding"))
    return dense.dense_topk(vectors, vectors.where(F.col("vec_id") % 20 == 0), K)


def bm25_topk(spark, sf_dir):
    return lexical.bm25_rank(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), K, "item_id", "text")


def bm25_blocks(spark, sf_dir):
    """Blocks of postings that each item's ranking has, and those that were scored."""
    return _blocks(spark, sf_dir)[1]


def bm25_kept(spark, sf_dir):
    """The rows of ``bm25_topk``, by the kept blocks and their bounds."""
    return _blocks(spark, sf_dir)[0]


def containment_qrels(spark, sf_dir):
    return evaluate.containment_qrels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def bm25_eval_hit_mrr(spark, sf_dir):
    scores = evaluate.score_rankings(bm25_topk(spark, sf_dir), containment_qrels(spark, sf_dir))
    return scores.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hit"), 6).alias("hit_at_5"), F.round(F.avg("rr"), 6).alias("mrr_at_5"))


def vector_normalize_check(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    bad = dense.vector_errors(vectors, "vec_id", "embedding").withColumnRenamed("id", "vec_id")
    scaled = dense.normalise(vectors, "embedding")
    length = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)
    return scaled.join(bad, "vec_id", "left").select("vec_id", F.round(F.col("embedding")[0], 6).alias("first"), F.round(length, 6).alias("square"), F.coalesce("error", F.lit("none")).alias("error"))


def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir)


def dense_products(spark, sf_dir):
    """All products of a query and a vector; those made are fewer where vectors lie in groups, and never more."""
    vectors = table(spark, sf_dir, "embeddings")
    found = dense.products(vectors, vectors.where(F.col("vec_id") % 20 == 0), K)
    return found.select("whole", F.col("made").between(0, F.col("whole")).alias("made_within"))


def rrf_fusion(spark, sf_dir):
    fused = fusion.rrf(_dense(spark, sf_dir), _dense(spark, sf_dir, 32), K)
    return fused.select("query", "node", F.round("score", 9).alias("score"), "first_rank", "second_rank", "rank")


def rerank_candidates(spark, sf_dir):
    return fusion.rerank_candidates(_dense(spark, sf_dir), _dense(spark, sf_dir, 32))


def rerank_standin(spark, sf_dir):
    """Candidates of two rankings by the share of the question's tokens that they have."""
    index = _index(spark, sf_dir)
    ranked = _rankings(spark, sf_dir, 10, index)
    listed = written(fusion.rerank_candidates(ranked.where("method = 'bm25'"), ranked.where("method = 'dense'")), "candidates")
    asked = _questions(spark, sf_dir).select("query", search_tokens("text").alias("asked"))
    rows = listed.join(asked, "query").join(lexical.rows_of(index.tokens, listed, "node").select("node", F.col("tokens").alias("have")), "node")
    found = fusion.rerank(rows, term_overlap(F.col("asked"), F.col("have")))
    return found.select("query", "node", "position", F.round("score", 6).alias("score"), "rank")


def paired_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("high_rr", "low_rr", "rr_drop")})


def main_table(spark, sf_dir):
    return evaluate.main_table(_outcomes(spark, sf_dir))


def transition_summary(spark, sf_dir):
    return evaluate.transition_summary(_outcomes(spark, sf_dir))


def family_descriptive(spark, sf_dir):
    return evaluate.main_table(_outcomes(spark, sf_dir), ("method", "family"))


def _resampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    outcomes = _outcomes(spark, sf_dir)
    pairs = outcomes.select("pair").distinct().count()
    return outcomes, written(evaluate.replicate_means(outcomes, evaluate.hashed_draws(spark, max(1, pairs), REPLICATES)), "replicates")


def bootstrap_ci(spark, sf_dir):
    return evaluate.bootstrap_intervals(*_resampled(spark, sf_dir))


def bootstrap_differences(spark, sf_dir):
    return evaluate.method_differences(*_resampled(spark, sf_dir))


def candidate_coverage(spark, sf_dir):
    return evaluate.candidate_coverage(_rankings(spark, sf_dir), written(_gold(spark, sf_dir), "gold"), _questions(spark, sf_dir))


def failure_cases(spark, sf_dir):
    """The twelve worst questions, with what every method made of them; documents in the place of passages, fifty sources."""
    gold = written(_gold(spark, sf_dir), "gold")
    ranked = _rankings(spark, sf_dir)
    listed = ranked.groupBy(F.col("query").alias("query_id"), "method").agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("r")).select("query_id", "method", F.transform("r", lambda x: x["node"]).alias("ranked_node_ids"))
    own = gold.groupBy(F.col("query").alias("query_id")).agg(F.array_sort(F.collect_set("node")).alias("evidence_node_ids"), (F.min("node") % 50).cast("string").alias("source_job_id"))
    scores = evaluate.score_rankings(ranked, gold, by=["method"]).select(F.col("query").alias("query_id"), "method", F.col("hit").alias("source_evidence_hit_at_5")).join(own.drop("source_job_id"), "query_id")
    asked = _questions(spark, sf_dir).select(F.col("query").alias("query_id"), F.col("pair").alias("pair_id"), F.col("kind").alias("query_type"), F.col("text").alias("query")).join(own.drop("evidence_node_ids"), "query_id").withColumn("evidence_text", F.col("query"))
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), (F.col("doc_id") % 50).cast("string").alias("job_id"), F.col("lang").alias("title"), F.col("source").alias("company"), F.lit(None).cast("string").alias("section_heading"), F.col("text").alias("content_text"))
    cases = report.failure_cases(listed, scores, asked, nodes)
    top = F.transform("top5", lambda t: t["node_id"].cast("string"))
    return cases.select("priority", "query_id", "method", F.col("hit").cast("long").alias("hit"), "diagnosis", F.array_join(top, ",").alias("top5"), F.md5(F.array_join(F.transform("top5", lambda t: t["excerpt"]), "|").cast("binary")).alias("excerpts_md5"))


QUERIES = (
    bm25_topk, bm25_kept, bm25_blocks, containment_qrels, bm25_eval_hit_mrr, vector_normalize_check, dense_topk, dense_products, rrf_fusion, rerank_candidates, rerank_standin, paired_outcomes,
    main_table, transition_summary, family_descriptive, bootstrap_ci, bootstrap_differences, candidate_coverage, failure_cases,
)

_TOKENS = sql_tokens("text")
_ITEMS = f"SELECT item_id AS query, {_TOKENS} AS toks FROM benchmark"
_SIDES = f"""asked AS (SELECT item_id || '_high' AS query, item_id AS pair, '{evaluate.KINDS[0]}' AS kind, item_id % 4 AS family, {_TOKENS} AS toks, text FROM benchmark
  UNION ALL SELECT query, pair, kind, family, toks, array_to_string(toks, ' ') AS text FROM
    (SELECT item_id || '_low' AS query, item_id AS pair, '{evaluate.KINDS[1]}' AS kind, item_id % 4 AS family, list_filter(toks, lambda x: length(x) <= {SHORT}) AS toks FROM (SELECT item_id, {_TOKENS} AS toks FROM benchmark)))"""


def _bm25(name: str, items: str, k: int, k1: float = 1.5, b: float = 0.75) -> str:
    """A ranking of all documents: contributions are added as whole numbers of 10^-12."""
    return f"""
{name}_d AS (SELECT doc_id AS node, {_TOKENS} AS toks FROM documents),
{name}_n AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM {name}_d),
{name}_p AS (SELECT node, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT node, len(toks) AS dl, unnest(toks) AS term FROM {name}_d) GROUP BY ALL),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_q AS (SELECT DISTINCT query, unnest(toks) AS term FROM ({items})),
{name}_s AS (SELECT query, node, sum(floor(1e12 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1)::DOUBLE / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * (dl / mean))))::HUGEINT)::DOUBLE / 1e12 AS score
  FROM {name}_q JOIN {name}_f USING (term) JOIN {name}_p USING (term), {name}_n GROUP BY query, node),
{name}_a AS (SELECT i.query, d.doc_id AS node, coalesce(s.score, 0.0) AS score FROM (SELECT query FROM ({items})) i CROSS JOIN (SELECT doc_id FROM documents) d
  LEFT JOIN {name}_s s ON s.query = i.query AND s.node = d.doc_id),
{name} AS (SELECT query, node, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM {name}_a QUALIFY rank <= {k})"""


_SUM = "coalesce(1.0::DOUBLE / (60 + a.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0.0)"


def _three(k: int = K) -> str:
    """asked and ranked(method, query, node, rank)."""
    both = ", ".join(_bm25(m, "SELECT query, toks FROM asked", k, *c) for m, c in CONSTANTS.items())
    fused = f"""summed AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.node, b.node) AS node, {_SUM} AS score FROM bm25 a FULL JOIN dense b ON a.query = b.query AND a.node = b.node),
hybrid AS (SELECT query, node, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM summed QUALIFY rank <= {k})"""
    union = " UNION ALL ".join(f"SELECT '{m}' AS method, query, node, rank FROM {m}" for m in evaluate.METHODS)
    return f"{_SIDES}, {both}, {fused}, ranked AS ({union})"


_LINKS = "links AS (SELECT DISTINCT b.item_id AS item, d.doc_id AS node FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
_GOLD = f"{_LINKS}, gold AS (SELECT item || '_high' AS query, node FROM links UNION ALL SELECT item || '_low', node FROM links)"
_METHOD_ROWS = "(VALUES ('bm25'), ('dense'), ('hybrid')) m(method)"
_SCORES = f"""scores AS (SELECT g.query, m.method, (min(r.rank) IS NOT NULL)::BIGINT AS hit, coalesce(1.0 / min(r.rank), 0.0) AS rr FROM (SELECT DISTINCT query FROM gold) g CROSS JOIN {_METHOD_ROWS}
  LEFT JOIN (SELECT method, query, min(rank) AS rank FROM ranked SEMI JOIN gold USING (query, node) WHERE rank <= 5 GROUP BY ALL) r ON r.query = g.query AND r.method = m.method GROUP BY ALL)"""
_PAIRS = f"""WITH {_three()}, {_GOLD}, {_SCORES},
side AS (SELECT s.*, a.pair, a.kind, a.family FROM scores s JOIN asked a USING (query)),
pairs AS (SELECT h.pair, h.method, h.family::VARCHAR AS family, h.query AS high_query, l.query AS low_query, h.hit AS high_hit, l.hit AS low_hit, h.hit - l.hit AS hit_drop, h.rr AS high_rr, l.rr AS low_rr, h.rr - l.rr AS rr_drop,
  CASE WHEN h.hit = 1 THEN 'hit' ELSE 'miss' END || '→' || CASE WHEN l.hit = 1 THEN 'hit' ELSE 'miss' END AS transition
  FROM side h JOIN side l ON h.pair = l.pair AND h.method = l.method AND h.kind LIKE 'high%' AND l.kind LIKE 'low%')"""
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluate.METRICS)
_LONG = "SELECT pair, method, unnest([{}]) AS metric, unnest([{}]) AS value FROM pairs".format(", ".join(f"'{m}'" for m in evaluate.METRICS), ", ".join(f"{m}::DOUBLE" for m in evaluate.METRICS))
_DRAWS = f"""{_PAIRS}, values_of AS ({_LONG}), numbered AS (SELECT pair, row_number() OVER (ORDER BY pair) - 1 AS idx FROM (SELECT DISTINCT pair FROM pairs)), n AS (SELECT count(*) AS n FROM numbered),
draws AS (SELECT replicate, ('0x' || substr(md5('0:' || replicate || ':' || i), 1, 12))::BIGINT % n AS idx FROM n, generate_series(0, {REPLICATES - 1}) r(replicate), LATERAL (SELECT unnest(range(n)) AS i)),
means AS (SELECT replicate, method, metric, round(sum(value) / count(*), 9) AS mean FROM draws JOIN numbered USING (idx) JOIN values_of USING (pair) GROUP BY ALL)"""
_ENDS = "round(quantile_cont({0}, 0.025), 6) AS low, round(quantile_cont({0}, 0.975), 6) AS high"


def _cosines(name: str, dims: int | None = None) -> str:
    v = f"(SELECT vec_id, embedding{f'[1:{dims}]' if dims else ''}::DOUBLE[] AS v FROM embeddings)"
    return f"""{name} AS (SELECT query, node, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM
  (SELECT q.vec_id AS query, c.vec_id AS node, round(list_cosine_similarity(q.v, c.v), {dense.WHOLE}) AS score FROM {v} q JOIN {v} c ON q.vec_id % 20 = 0) QUALIFY rank <= {K})"""


def _candidates(a: str, b: str) -> str:
    return f"""c AS (SELECT query, node, row_number() OVER (PARTITION BY query ORDER BY source, r) AS position FROM
  (SELECT query, node, min(source) AS source, arg_min(rank, source) AS r FROM (SELECT query, node, rank, 0 AS source FROM {a} UNION ALL SELECT query, node, rank, 1 FROM {b}) GROUP BY query, node))"""


_TWO = f"{_cosines('a')}, {_cosines('b', 32)}"
_SHORT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_FOUND = "SELECT r.query, r.method, min(CASE WHEN g.node IS NOT NULL THEN r.rank END) AS gold, min(CASE WHEN r.node % 50 = o.source THEN r.rank END) AS source FROM ranked r JOIN own o USING (query) LEFT JOIN gold g ON g.query = r.query AND g.node = r.node GROUP BY ALL"

_RANKED = f"WITH {_bm25('r', _ITEMS, K)} SELECT query, node, round(score, 6) AS score, rank FROM r"

SQL = {
    "bm25_kept": _RANKED,
    "dense_products": "SELECT count(*) FILTER (vec_id % 20 = 0) * count(*) AS whole, true AS made_within FROM embeddings",
    "bm25_topk": _RANKED,
    "containment_qrels": f"WITH {_LINKS} SELECT item AS query, node FROM links",
    "bm25_eval_hit_mrr": f"""WITH {_bm25('r', _ITEMS, 5)}, {_LINKS}, s AS (SELECT l.item, min(r.rank) AS first FROM links l LEFT JOIN r ON r.query = l.item AND r.node = l.node GROUP BY l.item)
SELECT count(*) AS queries, round(avg((first IS NOT NULL)::INT), 6) AS hit_at_5, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr_at_5 FROM s""",
    "vector_normalize_check": """SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, 1.0::DOUBLE AS square, 'none' AS error FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
    "dense_topk": f"WITH {_cosines('a')} SELECT query, node, round(score, 6) AS score, rank FROM a",
    "rrf_fusion": f"""WITH {_TWO}, f AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.node, b.node) AS node, a.rank AS first_rank, b.rank AS second_rank, {_SUM} AS s FROM a FULL JOIN b ON a.query = b.query AND a.node = b.node)
SELECT query, node, round(s, 9) AS score, first_rank, second_rank, row_number() OVER (PARTITION BY query ORDER BY s DESC, node) AS rank FROM f QUALIFY rank <= {K}""",
    "rerank_candidates": f"WITH {_TWO}, {_candidates('a', 'b')} SELECT query, node, position FROM c",
    "rerank_standin": f"""WITH {_three(10)}, {_candidates('bm25', 'dense')}, t AS (SELECT doc_id AS node, {_TOKENS} AS have FROM documents),
s AS (SELECT query, node, position, CASE WHEN len(toks) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(list_distinct(toks), have))::DOUBLE / len(list_distinct(toks)) END AS score FROM c JOIN asked USING (query) JOIN t USING (node))
SELECT query, node, position, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM s""",
    "paired_outcomes": f"{_PAIRS} SELECT pair, method, family, high_query, low_query, high_hit, low_hit, hit_drop, round(high_rr, 6) AS high_rr, round(low_rr, 6) AS low_rr, round(rr_drop, 6) AS rr_drop, transition FROM pairs",
    "main_table": f"{_PAIRS} SELECT method, count(*) AS pair_count, {_MEANS} FROM pairs GROUP BY method",
    "transition_summary": f"""{_PAIRS} SELECT m.method, t.transition, count(p.pair) AS pairs, round(count(p.pair)::DOUBLE / any_value(m.total), 6) AS share
FROM (SELECT method, count(*) AS total FROM pairs GROUP BY method) m CROSS JOIN (VALUES ('hit→hit'), ('hit→miss'), ('miss→hit'), ('miss→miss')) t(transition) LEFT JOIN pairs p ON p.method = m.method AND p.transition = t.transition GROUP BY m.method, t.transition""",
    "family_descriptive": f"{_PAIRS} SELECT method, family, count(*) AS pair_count, {_MEANS} FROM pairs GROUP BY ALL",
    "bootstrap_ci": f"""{_DRAWS}, e AS (SELECT method, metric, round(avg(value), 6) AS estimate FROM values_of GROUP BY ALL)
SELECT method, metric, any_value(estimate) AS estimate, {_ENDS.format('mean')} FROM means JOIN e USING (method, metric) GROUP BY method, metric""",
    "bootstrap_differences": f"""{_DRAWS}, e AS (SELECT method, metric, avg(value) AS value FROM values_of GROUP BY ALL), compared(method_a, method_b) AS (VALUES {", ".join(map(str, evaluate.COMPARED))}),
d AS (SELECT method_a, method_b, a.metric, round(a.mean - b.mean, 9) AS less FROM compared JOIN means a ON a.method = method_a JOIN means b ON b.method = method_b AND b.replicate = a.replicate AND b.metric = a.metric WHERE a.metric IN {evaluate.DROPS})
SELECT method_a, method_b, d.metric, any_value(round(round(a.value - b.value, 9), 6)) AS difference, {_ENDS.format('less')} FROM d JOIN e a ON a.method = method_a AND a.metric = d.metric JOIN e b ON b.method = method_b AND b.metric = d.metric GROUP BY ALL""",
    "candidate_coverage": f"""WITH {_three()}, {_GOLD}, q AS (SELECT DISTINCT query FROM gold), held AS (SELECT DISTINCT method, query FROM ranked SEMI JOIN gold USING (query, node))
SELECT a.kind, m.method, count(*) AS query_count, count(h.query) AS covered, round(count(h.query)::DOUBLE / count(*), 6) AS coverage FROM q JOIN asked a USING (query) CROSS JOIN {_METHOD_ROWS} LEFT JOIN held h ON h.query = q.query AND h.method = m.method GROUP BY ALL""",
    "failure_cases": f"""WITH {_three()}, {_GOLD}, {_SCORES}, own AS (SELECT query, min(node) % 50 AS source FROM gold GROUP BY query),
bad AS (SELECT s.query, CASE WHEN sum(hit) = 0 THEN 0 ELSE 2 END + CASE WHEN any_value(a.kind) LIKE 'low%' THEN 0 ELSE 1 END AS priority FROM scores s JOIN asked a USING (query) GROUP BY s.query HAVING sum(hit) < count(*) ORDER BY priority, s.query LIMIT 12),
found AS ({_FOUND}),
top AS (SELECT query, method, string_agg(node::VARCHAR, ',' ORDER BY rank) AS top5, md5(string_agg(short, '|' ORDER BY rank)) AS excerpts_md5 FROM ranked JOIN
  (SELECT doc_id AS node, CASE WHEN length({_SHORT}) <= 180 THEN {_SHORT} ELSE rtrim(substr({_SHORT}, 1, 179)) || '…' END AS short FROM documents) USING (node) WHERE rank <= 5 GROUP BY ALL)
SELECT b.priority, f.query AS query_id, f.method, s.hit, CASE WHEN gold <= 5 THEN 'Source evidence found at rank ' || gold || '.' WHEN gold IS NOT NULL THEN 'Source evidence found at rank ' || gold || ', outside Top-5.'
  WHEN source <= 5 THEN 'Top-5 contains a different chunk from the source JD; the labeled evidence is absent from Top-20.' WHEN source IS NOT NULL THEN 'The source JD first appears at rank ' || source || ', but the labeled evidence is absent from Top-20.'
  ELSE 'The source JD is absent from Top-20.' END AS diagnosis, top5, excerpts_md5 FROM bad b JOIN found f USING (query) JOIN top t ON t.query = f.query AND t.method = f.method JOIN scores s ON s.query = f.query AND s.method = f.method""",
}

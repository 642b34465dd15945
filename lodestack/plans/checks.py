"""Queries of checks. The tables that they check are made wrong in known places, by identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions.text import QUESTION_STOP_WORDS
from lodestack.operators import build, evaluate, pairs
from lodestack.plans.tables import SQL_AFTER, SQL_BEFORE, sql_numbers, sql_tokens, table
from lodestack.sources import contracts

_FAMILIES = ("de", "en", "es", "fr")


def grid_completeness(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), "item_id")
    rows = items.select("query", "item_id", F.explode(F.array(*map(F.lit, evaluate.METHODS))).alias("method")).where("NOT (item_id % 3 = 0 AND method = 'dense')")
    twice, strange = rows.where("item_id % 5 = 0 AND method = 'bm25'"), items.where("item_id < 3").select("query", "item_id", F.lit("other").alias("method"))
    return evaluate.grid_errors(rows.union(twice).union(strange).select("query", "method"), items)


def integrity_errors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    jobs = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("description_clean"))
    end = F.least(F.length("text"), F.lit(100))
    nodes = docs.select(
        F.col("doc_id").cast("string").alias("node_id"), F.when(F.col("doc_id") % 13 == 0, "none").otherwise(F.col("doc_id").cast("string")).alias("job_id"), F.lit(0).alias("start_offset"),
        F.when(F.col("doc_id") % 11 == 0, end + 100_000).otherwise(end).alias("end_offset"), F.when(F.col("doc_id") % 10 == 0, F.lit("?")).otherwise(F.substring("text", 1, 100)).alias("content_text"),
    )
    again = nodes.where("CAST(node_id AS LONG) % 17 = 0")
    return pairs.node_errors(nodes, jobs).union(pairs.duplicates(nodes.union(again), "node", "node_id"))


def ranking_integrity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("node_id"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(*map(F.lit, evaluate.METHODS))).alias("method"))
    ranked = F.transform(F.sequence(F.lit(0), F.when(F.col("item_id") % 4 == 0, 3).otherwise(4)), lambda i: F.when(F.col("item_id") % 6 == 0, F.least(i, F.lit(2))).otherwise(F.when((F.col("item_id") % 5 == 0) & (i == 1), -7).otherwise(i)).cast("string"))
    return pairs.ranking_errors(items.select(F.col("item_id").cast("string").alias("query_id"), "method", ranked.alias("ranked_node_ids")), docs, 5)


def corpus_contract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    jobs = docs.select(F.when(F.col("doc_id") % 50 == 0, F.lit("0")).otherwise(F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("job_family"), F.col("text").alias("description_clean"))
    return contracts.corpus_errors(jobs, 100, _FAMILIES)


def record_checks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 4 == 0, "unknown").otherwise("lever")
    url = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("ftp"), "url")).when(F.col("page_id") % 9 == 0, F.lit("no link")).otherwise(F.col("url"))
    jobs = pages.select(
        F.sha2(F.col("page_id").cast("string"), 256).alias("id"), F.lit("ai_engineering").alias("job_family"), kind.alias("source"), F.col("page_id").cast("string").alias("source_job_id"),
        F.when(F.col("page_id") % 10 == 0, "  ").otherwise("A").alias("company"), F.lit("T").alias("title"), url.alias("url"), F.col("html").alias("description_raw"),
        F.lit("x").alias("description_clean"), F.when(F.col("page_id") % 7 != 0, F.lit("2025-01-01").cast("timestamp")).alias("fetched_at"),
    )
    return contracts.record_errors(jobs)


def _pairs(spark, sf_dir):
    """Pairs with faults in known places: leaks, lost question marks, copies."""
    items = table(spark, sf_dir, "benchmark").where("length(text) > 0")
    words = F.split("text", " ")
    anchor = F.regexp_replace(F.element_at(words, 2), r"\W+$", "")
    tail = F.array_join(F.slice(words, F.floor(F.size(words) / 2).cast("int") + 1, F.size(words)), " ")
    leak = F.when(F.col("item_id") % 5 == 0, " at Acme").when(F.col("item_id") % 7 == 0, " on jobs.example.org").when(F.col("item_id") % 11 == 0, " as Data Engineer").otherwise("")
    high = F.concat(F.lit("Which text says "), F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.substring("text", 1, 150)), leak, F.when(F.col("item_id") % 4 == 0, "").otherwise("?"))
    low = F.concat(F.lit("Which one says "), F.substring(tail, 1, 150), F.lit("?"))
    return items.select("item_id", high.alias("high"), low.alias("low"), anchor.alias("anchor"), "text")


def static_pair_errors(spark, sf_dir):
    job = {"company": F.lit("Acme GmbH"), "title": F.lit("Senior Data Engineer II, Berlin"), "url": F.lit("https://jobs.example.org/42")}
    found = pairs.pair_error_column(F.col("high"), F.col("low"), F.col("anchor"), F.col("text"), job)
    return _pairs(spark, sf_dir).select("item_id", F.array_join(F.array_sort(found), " ").alias("errors"))


def candidate_choice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("candidate_id"), (F.col("doc_id") % 20).cast("string").alias("source_job_id"), (F.length(F.coalesce("text", F.lit(""))) % 5).cast("double").alias("distinctiveness_score"))
    return build.candidate_order(rows, 7, 8).select("source_job_id", "candidate_id", "choice")


def family_shortfall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("source_job_family"), F.coalesce("source", F.lit("none")).alias("source_job_id"))
    return pairs.family_shortfall(docs, 3, (*_FAMILIES, "zz"))


QUERIES = (grid_completeness, integrity_errors, ranking_integrity, corpus_contract, record_checks, static_pair_errors, candidate_choice, family_shortfall)

_STOP = "string_split('" + " ".join(QUESTION_STOP_WORDS) + "', ' ')"
_TERMS = lambda c: f"list_filter(list_distinct({sql_tokens(c)}), lambda x: NOT list_contains({_STOP}, x))"
_HAS = lambda text, phrase: f"regexp_matches({text}, '(?i){SQL_BEFORE}' || regexp_escape({phrase}) || '{SQL_AFTER}')"
_LOST = lambda side: f"array_to_string(list_sort(list_filter(list_distinct({sql_numbers('text')}), lambda x: NOT list_contains({sql_numbers(side)}, x))), ',')"
_FLAT = lambda c: rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"
_SIDE = lambda side: f"""CASE WHEN NOT ends_with({side}, '?') THEN '{side}_not_question' END, CASE WHEN contains({_FLAT(side)}, {_FLAT('text')}) THEN '{side}_copies_whole_evidence' END,
  CASE WHEN {_HAS(side, "'acme gmbh'")} OR {_HAS(side, "'acme'")} THEN '{side}_leaks_company' END, CASE WHEN {_HAS(side, "'data engineer'")} OR {_HAS(side, "'senior data engineer ii, berlin'")} THEN '{side}_leaks_title' END,
  CASE WHEN regexp_matches({side}, '(?i)https?://|www\\.|(?:^|[^a-z0-9_.])[a-z0-9-]+(?:\\.[a-z0-9-]+)+/\\S|(?:^|[^\\p{{L}}\\p{{N}}_.])jobs\\.example\\.org(?:$|[^\\p{{L}}\\p{{N}}_.])') THEN '{side}_leaks_url' END,
  CASE WHEN {_LOST(side)} <> '' THEN '{side}_drops_numeric_constraint:' || {_LOST(side)} END"""  # noqa: E731
_ERRORS = f"""[CASE WHEN length(high) NOT BETWEEN 20 AND 320 OR length(low) NOT BETWEEN 20 AND 320 THEN 'query_length' END, CASE WHEN lower(high) = lower(low) THEN 'identical_questions' END,
  CASE WHEN length(anchor) NOT BETWEEN 3 AND 80 OR NOT {_HAS('text', 'anchor')} THEN 'anchor_absent_or_invalid' END, CASE WHEN NOT {_HAS('high', 'anchor')} THEN 'high_missing_anchor' END,
  CASE WHEN {_HAS('low', 'anchor')} THEN 'low_repeats_anchor' END, CASE WHEN len(list_intersect({_TERMS('high')}, {_TERMS('text')})) <= len(list_intersect({_TERMS('low')}, {_TERMS('text')})) THEN 'low_not_lower_lexical_overlap' END,
  {_SIDE('high')}, {_SIDE('low')}]"""

SQL = {
    "grid_completeness": """WITH items AS (SELECT item_id, item_id::VARCHAR AS query FROM benchmark), rows AS (SELECT query, item_id, method FROM items CROSS JOIN (VALUES ('bm25'), ('dense'), ('hybrid')) m(method) WHERE NOT (item_id % 3 = 0 AND method = 'dense'))
SELECT query, 'dense' AS method, 'missing' AS error FROM items WHERE item_id % 3 = 0 UNION ALL SELECT query, method, 'duplicate' FROM rows WHERE item_id % 5 = 0 AND method = 'bm25' UNION ALL SELECT query, 'other', 'unexpected' FROM items WHERE item_id < 3""",
    "integrity_errors": """WITH d AS (SELECT doc_id, doc_id % 13 = 0 AS lost, doc_id % 11 = 0 OR (doc_id % 10 = 0 AND substr(text, 1, 100) <> '?') AS wrong FROM documents WHERE length(text) > 0)
SELECT 'node' AS scope, doc_id::VARCHAR AS key, CASE WHEN lost THEN 'unknown_source' ELSE 'content_differs' END AS error FROM d WHERE lost OR wrong UNION ALL SELECT 'node', doc_id::VARCHAR, 'duplicate_key' FROM d WHERE doc_id % 17 = 0""",
    "ranking_integrity": """WITH r AS (SELECT item_id, item_id || '/' || method AS key FROM benchmark CROSS JOIN (VALUES ('bm25'), ('dense'), ('hybrid')) m(method))
SELECT 'result' AS scope, key, 'wrong_length' AS error FROM r WHERE item_id % 4 = 0 UNION ALL SELECT 'result', key, 'repeated_node' FROM r WHERE item_id % 6 = 0 UNION ALL SELECT 'result', key, 'unknown_node' FROM r WHERE item_id % 5 = 0 AND item_id % 6 <> 0""",
    "corpus_contract": """WITH j AS (SELECT CASE WHEN doc_id % 50 = 0 THEN '0' ELSE doc_id::VARCHAR END AS id, lang, text FROM documents), f AS (SELECT lang, count(*) AS n FROM j GROUP BY lang)
SELECT 'job' AS scope, id AS key, 'duplicate_key' AS error FROM j GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'job', id, 'empty_text' FROM j WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT 'family', coalesce(f.lang, x.lang), 'expected_100_found_' || coalesce(n, 0) FROM f FULL JOIN (VALUES ('de'), ('en'), ('es'), ('fr')) x(lang) ON f.lang = x.lang WHERE x.lang IS NULL OR n IS DISTINCT FROM 100""",
    "record_checks": """WITH p AS (SELECT sha256(page_id::VARCHAR) AS key, page_id, url, html FROM pages)
SELECT 'job' AS scope, key, unnest(list_filter([CASE WHEN page_id % 10 = 0 THEN 'blank_company' END, CASE WHEN page_id % 4 = 0 THEN 'unknown_source' END,
  CASE WHEN page_id % 6 = 0 OR page_id % 9 = 0 OR NOT regexp_matches(coalesce(url, ''), '(?i)^https?://[^/?#]') THEN 'url_not_http' END, CASE WHEN page_id % 6 <> 0 AND page_id % 9 <> 0 AND trim(coalesce(url, '')) = '' THEN 'blank_url' END,
  CASE WHEN coalesce(html, '') = '' THEN 'empty_description' END, CASE WHEN page_id % 7 = 0 THEN 'no_fetched_at' END], lambda x: x IS NOT NULL)) AS error FROM p""",
    "static_pair_errors": rf"""WITH i AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark WHERE length(text) > 0),
p AS (SELECT item_id, text, trim('Which text says ' || CASE WHEN item_id % 3 = 0 THEN text ELSE substr(text, 1, 150) END || CASE WHEN item_id % 5 = 0 THEN ' at Acme' WHEN item_id % 7 = 0 THEN ' on jobs.example.org' WHEN item_id % 11 = 0 THEN ' as Data Engineer' ELSE '' END || CASE WHEN item_id % 4 = 0 THEN '' ELSE '?' END) AS high,
  trim('Which one says ' || substr(array_to_string(w[(len(w) // 2 + 1):], ' '), 1, 150) || '?') AS low, regexp_replace(w[2], '[^A-Za-z0-9_]+$', '') AS anchor FROM i)
SELECT item_id, CASE WHEN anchor = '' THEN 'missing_or_non_string_query_or_anchor' ELSE array_to_string(list_sort(list_filter({_ERRORS}, lambda x: x IS NOT NULL)), ' ') END AS errors FROM p""",
    "candidate_choice": """SELECT source_job_id, candidate_id, choice FROM (SELECT (doc_id % 20)::VARCHAR AS source_job_id, doc_id::VARCHAR AS candidate_id,
  row_number() OVER (PARTITION BY doc_id % 20 ORDER BY length(coalesce(text, '')) % 5 DESC, sha256('7' || chr(31) || doc_id)) AS choice FROM documents) WHERE choice <= 8""",
    "family_shortfall": """WITH c AS (SELECT coalesce(lang, 'none') AS f, count(DISTINCT coalesce(source, 'none')) AS n FROM documents GROUP BY 1)
SELECT 'family' AS scope, x.f AS key, 'expected_3_sources' AS error FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('zz')) x(f) LEFT JOIN c USING (f) WHERE coalesce(n, 0) <> 3""",
}

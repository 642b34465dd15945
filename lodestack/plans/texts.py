"""Queries of text functions, identifiers, titles and markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions.html import clean_html as cleaned
from lodestack.functions.text import (
    QUESTION_STOP_WORDS, STOP_WORDS, TERM, evidence_terms, has_phrase, hostname, lexical_terms, location, numbers, search_tokens, seeded_key, short_text, stable_id, utc_column, word_count,
)
from lodestack.operators import build, chunks, headings
from lodestack.operators.titles import title_filter
from lodestack.plans.tables import SQL_AFTER, SQL_BEFORE, SQL_LETTER, sql_numbers, sql_tokens, table
from lodestack.sources.files import read_jsonl, write_jsonl
from lodestack.sources.settings import load_heading_types
from lodestack.storage import new_path

SEED = 20260927
RULES = dict(internship=[r"\bsmall\b"], ambiguous=[r"\bhot\s+gear\b"], families={"ring": ([r"\bring\b"], [r"\bred\b"]), "tool": ([r"\bwidget\b", r"\bgear\b"], []), "metal": ([r"\bbolt\b", r"\bblue\b"], [])})


def tokenize_counts(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(search_tokens("text")).alias("term"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(search_tokens("text"))).alias("term"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_length_stats(spark, sf_dir):
    n = F.size(search_tokens("text")).cast("long")
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("docs"), F.sum(n).alias("tokens"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean_length"))


def evidence_terms_df(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select(F.explode(evidence_terms("text")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def text_measures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", word_count("text").alias("words"), F.size(numbers("text")).cast("long").alias("numbers"), F.size(lexical_terms("text")).cast("long").alias("terms"), short_text("text", 60).alias("short"), F.length(location("text")).cast("long").alias("line_chars"))


def phrase_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    phrase = F.element_at(F.split(F.coalesce("text", F.lit("")), " "), 2)
    return docs.where(F.size(F.split(F.coalesce("text", F.lit("")), " ")) > 1).where(phrase.rlike("^[a-z]+$")).select("doc_id", has_phrase(F.col("text"), phrase).alias("has"), has_phrase(F.reverse("text"), phrase).alias("has_reversed"))


def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(hostname(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


def utc_times(spark, sf_dir):
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise("")
    text = F.when(F.col("event_id") % 7 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(utc_column(text)).alias("utc_seconds"))


def title_rules(spark, sf_dir):
    found = title_filter(F.col("p_name"), F.col("p_type"), **RULES)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("found")).select("p_partkey", "found.status", "found.family", "found.reason")


def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", stable_id(F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id")).alias("stable_id"))


def node_ids(spark, sf_dir):
    cut = chunks.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 400, 40)
    return cut.select("doc_id", "chunk_index", chunks.node_id_column(F.col("doc_id").cast("string"), F.col("start"), F.col("end"), F.col("content")).alias("node_id"))


def seeded_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("none")).alias("job_family"))
    return build.job_order(docs, SEED).select("id", "job_family", "place", seeded_key(SEED, F.col("id")).alias("key"))


def seeded_sample(spark, sf_dir):
    return build.sample_by_seed(table(spark, sf_dir, "documents"), SEED, "doc_id", 8)


def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cleaned(F.col("html")).alias("text"))


def html_sections(spark, sf_dir):
    return headings.html_sections(table(spark, sf_dir, "pages"), "page_id", "html", load_heading_types())


def structure_stats(spark, sf_dir):
    return headings.structure_stats(html_sections(spark, sf_dir), "page_id")


def jsonl_round_trip(spark, sf_dir):
    """Documents written as JSON lines and read back."""
    docs = table(spark, sf_dir, "documents")
    back = read_jsonl(spark, write_jsonl(docs, new_path(spark, "jsonl")), docs.schema)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = (
    tokenize_counts, document_frequency, doc_length_stats, evidence_terms_df, text_measures, phrase_hits, page_hosts, utc_times,
    title_rules, stable_ids, node_ids, seeded_order, seeded_sample, clean_html, html_sections, structure_stats,
    jsonl_round_trip,
)

_TOKENS = sql_tokens("text")
LIST = lambda words: "string_split('" + " ".join(words) + "', ' ')"
_LINE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
WORDS = f"{SQL_LETTER}+(?:[’''-]{SQL_LETTER}+)*"


def chunk_ctes(size: int, overlap: int, source: str = "SELECT doc_id, coalesce(text, '') AS text FROM documents") -> str:
    """chunks(doc_id, chunk_index, start, end) by recursion: where a passage ends, and where the next begins, as last places of breaks."""
    last = lambda part, mark: f"strpos(reverse({part}), reverse({mark}))"
    marks = ("chr(10) || chr(10)", "chr(10)", "' '", "chr(9)")
    window = f"substr(text, start + {max(1, size // 2)} + 1, {size - max(1, size // 2)})"
    ends = " ".join(f"WHEN {last(window, m)} > 0 THEN start + {size} - {last(window, m)} + 1" for m in marks)
    end = f"CASE WHEN start + {size} >= length(text) THEN length(text) {ends} ELSE start + {size} END"
    back = "substr(text, greatest(start + 1, ahead - 24) + 1, ahead - greatest(start + 1, ahead - 24))"
    places = ", ".join(f"nullif({last(back, m)}, 0)" for m in marks[1:])
    begin = f"coalesce(ahead - least({places}) + 1, ahead)" if overlap else "ahead"
    step = f"SELECT doc_id, text, chunk_index, start, {end} AS stop FROM"
    return f"""source AS ({source}),
steps AS (
  {step} (SELECT doc_id, text, 0 AS chunk_index, 0::BIGINT AS start FROM source WHERE length(text) > 0)
  UNION ALL
  {step} (SELECT doc_id, text, chunk_index + 1 AS chunk_index, {begin} AS start FROM (SELECT *, greatest(start + 1, stop - {overlap}) AS ahead FROM steps WHERE stop < length(text)))
),
chunks AS (SELECT doc_id, chunk_index::BIGINT AS chunk_index, start, stop::BIGINT AS "end" FROM steps)"""


SQL = {
    "jsonl_round_trip": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "tokenize_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS term FROM documents) GROUP BY term",
    "document_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS term FROM documents) GROUP BY term",
    "doc_length_stats": f"SELECT count(*) AS docs, sum(n)::BIGINT AS tokens, max(n)::BIGINT AS longest, round(avg(n), 6) AS mean_length FROM (SELECT len({_TOKENS}) AS n FROM documents)",
    "evidence_terms_df": f"""SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, lower(term) AS term FROM
  (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{TERM}')) AS term FROM documents) WHERE length(term) >= 3)
  WHERE NOT list_contains({LIST(STOP_WORDS)}, term) GROUP BY term""",
    "text_measures": rf"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS words,
  len(list_distinct({sql_numbers("coalesce(text, '')")})) AS numbers,
  len(list_filter(list_distinct({_TOKENS}), lambda x: NOT list_contains({LIST(QUESTION_STOP_WORDS)}, x))) AS terms,
  CASE WHEN length({_LINE}) <= 60 THEN {_LINE} ELSE rtrim(substr({_LINE}, 1, 59)) || '…' END AS short,
  length(nullif(CASE WHEN text IS NULL THEN NULL ELSE {_LINE} END, '')) AS line_chars FROM documents""",
    "phrase_hits": f"""SELECT doc_id, regexp_matches(text, '(?i){SQL_BEFORE}' || w || '{SQL_AFTER}') AS has, regexp_matches(reverse(text), '(?i){SQL_BEFORE}' || w || '{SQL_AFTER}') AS has_reversed
FROM (SELECT doc_id, text, string_split(text, ' ')[2] AS w FROM documents WHERE len(string_split(text, ' ')) > 1) WHERE regexp_matches(w, '^[a-z]+$')""",
    "page_hosts": "SELECT lower(nullif(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)', 1), '')) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "utc_times": """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 3 = 2 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT - CASE WHEN event_id % 3 = 1 THEN 7200 ELSE 0 END END AS utc_seconds FROM events""",
    "title_rules": """WITH f AS (SELECT p_partkey, regexp_matches(p_name, '(?i)\\bsmall\\b') OR regexp_matches(p_type, '(?i)\\bsmall\\b') AS intern, regexp_matches(p_name, '(?i)\\bhot\\s+gear\\b') AS amb,
  list_filter([CASE WHEN regexp_matches(p_name, '(?i)\\bring\\b') AND NOT regexp_matches(p_name, '(?i)\\bred\\b') THEN 'ring' END, CASE WHEN regexp_matches(p_name, '(?i)\\b(widget|gear)\\b') THEN 'tool' END,
  CASE WHEN regexp_matches(p_name, '(?i)\\b(bolt|blue)\\b') THEN 'metal' END], lambda x: x IS NOT NULL) AS fits FROM part)
SELECT p_partkey, CASE WHEN intern THEN 'internship' WHEN amb OR len(fits) > 1 THEN 'ambiguous' WHEN len(fits) = 1 THEN 'accepted' ELSE 'non_target' END AS status,
  CASE WHEN NOT intern AND NOT amb AND len(fits) = 1 THEN fits[1] END AS family,
  CASE WHEN intern THEN 'internship title or employment type' WHEN amb THEN 'configured ambiguous title' WHEN len(fits) > 1 THEN 'matches multiple job families' WHEN len(fits) = 0 THEN 'no target family title rule matched' END AS reason FROM f""",
    "stable_ids": "SELECT doc_id, sha256(trim(coalesce(source, 'none')) || chr(31) || trim(coalesce(lang, 'none')) || chr(31) || doc_id::VARCHAR) AS stable_id FROM documents",
    "node_ids": f"""WITH RECURSIVE {chunk_ctes(400, 40)}
SELECT doc_id, chunk_index, sha256('["{chunks.NODE_VERSION}",' || to_json(doc_id::VARCHAR) || ',' || start || ',' || "end" || ',' || to_json(substr(text, start + 1, "end" - start)) || ']') AS node_id FROM chunks JOIN source USING (doc_id)""",
    "seeded_order": f"""SELECT id, job_family, row_number() OVER (PARTITION BY job_family ORDER BY key, id::VARCHAR) AS place, key FROM
  (SELECT doc_id AS id, coalesce(lang, 'none') AS job_family, sha256('{SEED}' || chr(31) || doc_id::VARCHAR) AS key FROM documents)""",
    "seeded_sample": f"""SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY sha256('[{SEED},"' || doc_id || '"]') LIMIT 8""",
}

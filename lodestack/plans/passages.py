"""Queries of passages, spans and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions.text import STOP_WORDS, TERM
from lodestack.operators import chunks, evaluate, evidence
from lodestack.plans.tables import table
from lodestack.plans.texts import LIST, WORDS, chunk_ctes
from lodestack.sources.settings import load_heading_types


def _jobs(spark, sf_dir):
    """Documents in the place of postings."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("lang", F.lit("none")).alias("job_family"), F.col("source").alias("company"), F.col("source").alias("title"), F.col("text").alias("description_clean"))


def _nodes(spark, sf_dir):
    cut = chunks.passages(_jobs(spark, sf_dir), "id", "description_clean", load_heading_types(), keep=("job_family", "company", "title"))
    return cut.withColumnRenamed("id", "job_id")


def chunk_ranges(spark, sf_dir):
    return chunks.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "start", "end", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def chunk_ranges_apart(spark, sf_dir):
    return chunks.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 300, 0).select("doc_id", "chunk_index", "start", "end")


def passages(spark, sf_dir):
    return _nodes(spark, sf_dir)


def enclosing_passages(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    links = evaluate.containment_qrels(docs, items, "doc_id", "text", "item_id", "text")
    placed = links.join(docs.select(F.col("doc_id").alias("node"), "text"), "node").join(items.select(F.col("item_id").alias("query"), F.col("text").alias("item")), "query")
    start = F.instr("text", F.col("item"))
    spans = placed.select("query", F.col("node").alias("job"), (start - 1).cast("long").alias("start"), (start - 1 + F.length("item")).cast("long").alias("end"))
    cut = chunks.chunks(docs, "doc_id", "text").select(F.col("doc_id").alias("job"), F.col("chunk_index").cast("string").alias("node_id"), F.col("start").alias("start_offset"), F.col("end").alias("end_offset"))
    found = evaluate.enclosing(spans, cut)
    return found.select("query", F.col("job").alias("doc_id"), "start", "end", F.array_join("node_ids", ",").alias("passages"))


def span_lines(spark, sf_dir):
    spans = evidence.evidence_spans(_jobs(spark, sf_dir))
    return spans.select(F.col("job").alias("doc_id"), "start", "end", "words", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def evidence_gates(spark, sf_dir):
    spans = evidence.evidence_spans(_jobs(spark, sf_dir))
    return spans.select(F.col("job").alias("doc_id"), "start", F.coalesce("reason", F.lit("open")).alias("reason"))


def evidence_counts(spark, sf_dir):
    return evidence.evidence_counts(evidence.evidence_rows(_jobs(spark, sf_dir), _nodes(spark, sf_dir)))


def evidence_candidates(spark, sf_dir):
    """Candidates, with their lists as texts."""
    jobs = _jobs(spark, sf_dir)
    found = evidence.evidence_candidates(jobs, evidence.evidence_rows(jobs, _nodes(spark, sf_dir)))
    return found.withColumns({c: F.array_join(c, " ") for c in ("evidence_node_ids", "distinctive_terms")})


QUERIES = (chunk_ranges, chunk_ranges_apart, passages, enclosing_passages, span_lines, evidence_gates, evidence_counts, evidence_candidates)

#: Lines without list marks, long ones cut at the ends of sentences by a mark put there, with running offsets.
_SPANS = r"""lines AS (SELECT doc_id, text, company, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM jobs),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS base FROM lines),
bare AS (SELECT doc_id, text, company, base + length(line) - length(ltrim(line, W)) AS base, trim(line, W) AS line FROM placed),
marked AS (SELECT *, length(line) - length(regexp_replace(line, '^(?:[-*•]\s+|\d{1,2}[.)]\s+)', '')) AS mark FROM bare WHERE line <> '' AND NOT regexp_matches(line, '^#{1,6}\s+')),
shown AS (SELECT doc_id, text, company, base + mark AS base, substr(line, mark + 1) AS line FROM marked),
cut AS (SELECT doc_id, text, company, base, CASE WHEN length(line) > 420 THEN string_split(regexp_replace(line, '([.!?])(\s+)([A-Z])', '\1' || chr(1) || '\2\3', 'g'), chr(1)) ELSE [line] END AS parts FROM shown),
pieces AS (SELECT doc_id, text, company, base, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM cut),
offsets AS (SELECT *, base + sum(length(part)) OVER (PARTITION BY doc_id, base ORDER BY n) - length(part) AS low FROM pieces),
spans AS (SELECT doc_id, text, company, (low + length(part) - length(ltrim(part, W)))::BIGINT AS start, trim(part, W) AS span FROM offsets WHERE trim(part, W) <> '')""".replace("W)", "' ' || chr(9) || chr(13) || chr(11) || chr(12))")
_WITH = "WITH jobs AS (SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text, source AS company FROM documents), " + _SPANS
_WORDS = f"len(regexp_extract_all(span, '{TERM}'))"
_LOCAL = f"""gates AS (SELECT doc_id, start, span, CASE WHEN length(span) NOT BETWEEN 40 AND 420 THEN 'length_chars' WHEN {_WORDS} NOT BETWEEN 8 AND 70 THEN 'length_words'
  WHEN regexp_matches(span, '(?i){evidence.TEMPLATE}') THEN 'template_or_non_role_fact'
  WHEN length(trim(company)) >= 3 AND regexp_matches(span, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(trim(company)) || '(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 'mentions_source_company'
  WHEN (length(text) - length(replace(text, span, ''))) // length(span) <> 1 THEN 'ambiguous_or_duplicate_source_text' END AS reason FROM spans),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(span, '\\s+', ' ', 'g')), reason IS NULL ORDER BY start) AS place FROM gates)"""

_TITLES = "coalesce(text, '') AS text, coalesce(lang, 'none') AS job_family, source AS company, source AS title FROM documents"
_HEAD = "trim(regexp_replace(line, '\\r+$', ''), ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
#: Sections open at lines that end in a colon or are in capitals (the tables hold no known heading and no Markdown); each is cut into passages for itself.
_PASSAGES = f"""texts AS (SELECT doc_id::VARCHAR AS doc_id, {_TITLES}),
text_rows AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM texts),
at_lines AS (SELECT doc_id, {_HEAD} AS head, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1)::BIGINT AS pos FROM text_rows),
counted AS (SELECT *, len(regexp_extract_all(head, '{WORDS}')) AS words FROM at_lines WHERE length(head) BETWEEN 1 AND 120 AND NOT regexp_matches(line, '^\\s*(?:[-*•][ \\t]+|\\d+[.)][ \\t]+)')),
heads AS (SELECT doc_id, pos, head FROM counted WHERE words > 0 AND NOT contains(head, '://') AND (
  (right(head, 1) = ':' AND length(head) <= 100 AND words <= 12)
  OR (regexp_matches(head, '\\p{{Lu}}') AND NOT regexp_matches(head, '\\p{{Ll}}') AND right(head, 1) <> '.' AND length(head) <= 80 AND words BETWEEN 2 AND 10 AND length(regexp_replace(head, '\\P{{L}}', '', 'g')) >= 4))),
opened AS (SELECT doc_id, pos, head, 'unmapped' AS kind, 1 AS n FROM heads UNION ALL SELECT doc_id, 0, NULL, 'unsectioned', 0 FROM texts),
sections AS (SELECT o.doc_id, o.pos, o.head, o.kind, coalesce(lead(o.pos) OVER (PARTITION BY o.doc_id ORDER BY o.pos, o.n), length(t.text)) AS stop, t.text FROM opened o JOIN texts t ON o.doc_id = t.doc_id),
keyed AS (SELECT doc_id AS job_id, doc_id || ':' || pos AS key, pos, head, kind, substr(text, pos + 1, stop - pos) AS body FROM sections WHERE stop > pos),
{chunk_ctes(1000, 100, "SELECT key AS doc_id, body AS text FROM keyed")},
nodes AS (SELECT sha256('["{chunks.NODE_VERSION}",' || to_json(job_id) || ',' || pos + start || ',' || pos + "end" || ',' || to_json(substr(body, start + 1, "end" - start)) || ']') AS node_id, job_id, head AS section_heading, kind AS canonical_section,
  chunk_index, pos + start AS start_offset, pos + "end" AS end_offset, substr(body, start + 1, "end" - start) AS content_text FROM chunks JOIN keyed ON key = doc_id)"""
#: Of the spans that the text's own gates leave open: passages around them, terms of the corpus, and repeats.
_JUDGED = f"""own AS (SELECT doc_id, start, span, {_WORDS} AS words, CASE WHEN reason IS NULL AND place > 1 THEN 'ambiguous_or_duplicate_source_text' ELSE reason END AS reason FROM firsts),
open_spans AS (SELECT doc_id, start, start + length(span) AS stop, span, words FROM own WHERE reason IS NULL),
around AS (SELECT o.doc_id, o.start, list_sort(list(n.node_id)) AS ids, arg_min(n.canonical_section, struct_pack(a := start_offset, b := end_offset, c := canonical_section)) AS section,
  arg_min(coalesce(n.section_heading, ''), struct_pack(a := start_offset, b := end_offset, c := canonical_section)) AS heading
  FROM open_spans o JOIN nodes n ON n.job_id = o.doc_id AND n.start_offset <= o.start AND n.end_offset >= o.stop GROUP BY ALL),
terms AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '{TERM}'), lambda x: lower(x)), lambda x: length(x) >= 3 AND NOT list_contains({LIST(STOP_WORDS)}, x))) AS own FROM texts),
frequent AS (SELECT term FROM (SELECT unnest(own) AS term FROM terms) GROUP BY term HAVING count(*) / (SELECT count(*) FROM texts) > 0.35),
told AS (SELECT doc_id, start, list_distinct(list_filter(list_transform(regexp_extract_all(span, '{TERM}'), lambda x: lower(x)), lambda x: length(x) >= 3 AND NOT list_contains({LIST(STOP_WORDS)}, x))) AS said FROM open_spans),
rare AS (SELECT doc_id, start, list_sort(list_filter(said, lambda x: NOT list_contains(common, x))) AS terms FROM told, (SELECT coalesce(list(term), []) AS common FROM frequent)),
held AS (SELECT o.*, coalesce(a.ids, []) AS ids, coalesce(a.section, 'unsectioned') AS section, coalesce(a.heading, '') AS heading, r.terms, lower(trim(regexp_replace(span, '\\s+', ' ', 'g'))) AS alike
  FROM open_spans o JOIN rare r ON o.doc_id = r.doc_id AND o.start = r.start LEFT JOIN around a ON o.doc_id = a.doc_id AND o.start = a.start),
later AS (SELECT *, CASE WHEN len(ids) = 0 THEN 'no_complete_node' WHEN section IN ('about_company', 'benefits', 'additional_information') OR (section IN ('unsectioned', 'unmapped') AND regexp_matches(heading, '{evidence.OTHER_HEADING}')) THEN 'non_role_section'
  WHEN len(terms) = 0 AND NOT regexp_matches(span, '{evidence.STATED_NUMBER}') THEN 'generic_corpus_vocabulary' END AS why FROM held),
final AS (SELECT *, coalesce(why, CASE WHEN count(*) FILTER (why IS NULL) OVER (PARTITION BY alike) > 3 THEN 'repeated_across_jobs' END) AS reason FROM later)"""
_EVIDENCE = f"{_WITH.replace('WITH jobs', 'WITH RECURSIVE jobs', 1)}, {_LOCAL}, {_PASSAGES}, {_JUDGED}"

SQL = {
    "passages": f"""WITH RECURSIVE {_PASSAGES} SELECT node_id, job_id, job_family, company, title, section_heading, canonical_section, chunk_index, start_offset, end_offset, content_text,
  CASE WHEN section_heading IS NULL THEN content_text ELSE 'Section: ' || section_heading || chr(10) || content_text END AS retrieval_text FROM nodes JOIN texts ON job_id = doc_id""",
    "evidence_counts": f"""{_EVIDENCE} SELECT outcome, count(*) AS spans FROM (SELECT 'rejected_' || reason AS outcome FROM own WHERE reason IS NOT NULL UNION ALL SELECT coalesce('rejected_' || reason, 'accepted_candidates') FROM final) GROUP BY outcome""",
    "evidence_candidates": f"""{_EVIDENCE} SELECT substr(sha256(f.doc_id || chr(31) || start || chr(31) || stop || chr(31) || span), 1, 20) AS candidate_id, f.doc_id AS source_job_id, job_family AS source_job_family, span AS evidence_text,
  start AS evidence_start, stop AS evidence_end, array_to_string(ids, ' ') AS evidence_node_ids, nullif(heading, '') AS section_heading, section AS canonical_section, array_to_string(terms, ' ') AS distinctive_terms,
  round(len(terms) / greatest(sqrt(words), 1) + CASE WHEN regexp_matches(span, '{evidence.ANY_NUMBER}') THEN 1 ELSE 0 END + CASE WHEN section IN ('qualifications', 'responsibilities') THEN 0.5 ELSE 0 END, 3) AS distinctiveness_score
  FROM final f JOIN texts t ON f.doc_id = t.doc_id WHERE reason IS NULL""",
    "chunk_ranges": f"""WITH RECURSIVE {chunk_ctes(1000, 100)} SELECT doc_id, chunk_index, start, "end", md5(substr(text, start + 1, "end" - start)) AS content_md5 FROM chunks JOIN source USING (doc_id)""",
    "chunk_ranges_apart": f"""WITH RECURSIVE {chunk_ctes(300, 0)} SELECT doc_id, chunk_index, start, "end" FROM chunks""",
    "enclosing_passages": f"""WITH RECURSIVE links AS (SELECT b.item_id AS query, d.doc_id, (strpos(d.text, b.text) - 1)::BIGINT AS start, (strpos(d.text, b.text) - 1 + length(b.text))::BIGINT AS "end" FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
{chunk_ctes(1000, 100, "SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM links)")}
SELECT l.query, l.doc_id, l.start, l."end", coalesce(string_agg(c.chunk_index::VARCHAR, ',' ORDER BY c.chunk_index::VARCHAR), '') AS passages
FROM links l LEFT JOIN chunks c ON c.doc_id = l.doc_id AND c.start <= l.start AND c."end" >= l."end" GROUP BY ALL""",
    "span_lines": f"""{_WITH} SELECT doc_id, start, start + length(span) AS "end", {_WORDS} AS words, md5(span) AS text_md5 FROM spans""",
    "evidence_gates": f"""{_WITH}, {_LOCAL} SELECT doc_id, start, CASE WHEN reason IS NULL AND place > 1 THEN 'ambiguous_or_duplicate_source_text' ELSE coalesce(reason, 'open') END AS reason FROM firsts""",
}

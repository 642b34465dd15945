"""Queries of stored tables: digests of whole tables, numbers of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.plans.tables import table
from lodestack.sources import digests, files
from lodestack.storage import new_path


def table_digest(spark, sf_dir):
    """The digest of the documents as they are stored, dealt anew, and with one text changed."""
    docs = table(spark, sf_dir, "documents")
    first = docs.agg(F.min("doc_id")).first()[0]
    changed = docs.withColumn("text", F.when(F.col("doc_id") == first, F.concat(F.coalesce("text", F.lit("")), F.lit("x"))).otherwise(F.col("text")))
    out = None
    for state, rows in (("as_stored", docs), ("dealt_anew", docs.repartition(7, "n_chars")), ("one_changed", changed)):
        entries = digests.written(digests.row_digests(rows), "row-digests")
        found = digests.folded(entries, digests.depth_of(entries.count()))
        sizes = entries.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_different"))
        row = sizes.join(found).select(F.lit(state).alias("state"), "n_rows", "n_different", "digest")
        out = row if out is None else out.union(row)
    return out


def line_numbers(spark, sf_dir):
    """Documents as JSON lines, sorted over many files; every line read back has its number among all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = new_path(spark, "lines")
    files.write_jsonl(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)
    lines = files.numbered_lines(spark, path)
    found = F.from_json("value", "doc_id long, lang string, text string")
    return lines.select("row", found.alias("found")).select("row", "found.doc_id", F.md5(F.coalesce("found.text", F.lit("")).cast("binary")).alias("text_md5"))


QUERIES = (table_digest, line_numbers)


def _column(name: str) -> str:
    value = f"{name}::VARCHAR"
    return f"'{name}' || CASE WHEN {name} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


_ROW = " || ".join(map(_column, ("doc_id", "lang", "n_chars", "source", "text")))
_FOLD = "sha256(string_agg(said, ',' ORDER BY said))"


def _levels(most: int) -> str:
    """Entries are folded at the width of their state first, and then at all smaller ones."""
    out, above = [], None
    for width in range(most * digests.DIGITS, -1, -digests.DIGITS):
        rows = f"SELECT e.state, digest AS key, digest || ':' || n AS said FROM entries e JOIN sizes s ON e.state = s.state WHERE width = {width}"
        rows += f" UNION ALL SELECT state, key, key || ':' || digest FROM fold{above}" if above else ""
        out.append(f"fold{width} AS (SELECT state, substr(key, 1, {width}) AS key, {_FOLD} AS digest FROM ({rows}) GROUP BY ALL)")
        above = width
    return ",\n".join(out)


SQL = {
    "table_digest": f"""WITH docs AS (
  SELECT 'as_stored' AS state, doc_id, lang, n_chars, source, text FROM documents
  UNION ALL SELECT 'dealt_anew', doc_id, lang, n_chars, source, text FROM documents
  UNION ALL SELECT 'one_changed', doc_id, lang, n_chars, source, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN coalesce(text, '') || 'x' ELSE text END FROM documents),
entries AS (SELECT state, digest, count(*) AS n FROM (SELECT state, sha256({_ROW}) AS digest FROM docs) GROUP BY ALL),
sizes AS (SELECT state, sum(n)::BIGINT AS n_rows, count(*) AS n_different, CASE WHEN count(*) <= 256 THEN 0 WHEN count(*) <= 65536 THEN 2 ELSE 4 END AS width FROM entries GROUP BY state),
{_levels(2)}
SELECT s.state, n_rows, n_different, digest FROM sizes s JOIN fold0 f ON s.state = f.state""",
    "line_numbers": "SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
}

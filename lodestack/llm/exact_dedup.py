"""Exact deduplication as a tree merge of sorted digest runs (DataFrame functions only).

Every input partition is one *run*: its digests, each with the smallest identifier and
the number of rows. Rounds are binomial: in round k the runs whose numbers agree after
dropping k digits meet and are merged, so a digest contributes at most one row for each
of these runs to any merge, however many copies it has. Digits are binary up to 64 runs;
beyond, their base is the smallest power of two that needs no more than six rounds, since
every round moves all digests. A smallest identifier travels as a structure, which Spark
aggregates over rows sorted by their key, so a merge reads sorted runs in order. The key
holds the digest, the length and a second hash of the text, so a kept identifier is
verified at every level. At the end the winners meet the first runs, one row per (run,
digest), and through them the rows of each run, so no task gathers all copies of a text.

Defined results: null text equals the empty text. Null identifiers never win against
others. Rows that repeat an identifier and its text are one document and agree in every
column. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import SPACE, free_name, written

_KEY = ["digest", "n_bytes", "guard"]


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE, " ")


def digest_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One slim row per document: id, digest, guard columns and the number of its run."""
    rows = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    return rows.select(
        "id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("guard"),
        F.spark_partition_id().alias("run"),
    )


def merge_round(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: ``fan_in`` neighbouring runs become one, sorted by digest."""
    merged = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
    return merged.groupBy("run", *_KEY).agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))


def base_of(n_runs: int, most_rounds: int = 6) -> int:
    """The base in which run numbers lose a digit each round."""
    return 1 << max(1, math.ceil(math.ceil(math.log2(max(2, n_runs))) / most_rounds))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int | None = None) -> DataFrame:
    """Per input row: id, keep_id, group_size, kept, text_sha256. ``fan_in`` is the base of run numbers, chosen by their count unless given."""
    rows = written(digest_runs(df, id_col, text_col), "digest-runs")
    left = rows.agg(F.max("run")).first()[0] or 0
    base = fan_in or base_of(left + 1)
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id"))
    runs = rows.groupBy("run", *_KEY).agg(least.alias("keep"), F.count(F.lit(1)).alias("n"))
    merged = runs
    while left:
        merged, left = merge_round(merged, base), left // base
    winners = merged.select(*_KEY, F.col("keep.id").alias("keep"), "n")
    by_run = runs.select("run", *_KEY).join(winners, _KEY)
    return rows.join(by_run, ["run", *_KEY]).select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int | None = None) -> DataFrame:
    """The rows of ``df`` that stay, one for each text, with all their columns.

    An identifier that several texts share keeps each of them; the join and the removal
    of repeated rows use the same keys, so the texts are shuffled once."""
    kept = exact_dedup(df, id_col, text_col, fan_in).where("kept")
    own_id, own_text, kept_id, kept_text = (free_name(df, n) for n in ("own_id", "own_text", "kept_id", "kept_text"))
    kept = kept.select(F.col(id_col).alias(kept_id), F.col("text_sha256").alias(kept_text)).distinct()
    marked = df.withColumns({own_id: F.col(id_col), own_text: F.sha2(normalised(text_col), 256)})
    same = F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_text) == F.col(kept_text))
    return marked.join(kept, same, "left_semi").dropDuplicates([own_id, own_text]).drop(own_id, own_text)


SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

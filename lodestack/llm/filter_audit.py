"""Interaction audit of five filters by a histogram of failure masks.

Native expressions give each text the bits of the filters it fails on its own (A to D).
Whether it repeats a smaller document (E) is told by a group-by of the texts' digests,
whose smallest document is joined back by document, so copies of one text are never
gathered. Rows are then counted by (part, mask): at most 32 cells a part, whatever the
size of the part. All 120 orders are read off the cells: a filter at some step removes the
cells that have its bit and none of the bits before it.

Filters fail a text as follows; words are maximal runs of other characters than
``[\\x20\\x09-\\x0D]``, told apart by case.

* A: fewer than 50 words
* B: 100 x distinct words < 65 x words
* C: 100 x characters ``[A-Z]`` > 5 x code points
* D: holds any of ``#$%&*|``
* E: equal to the text of any smaller document, whether that one is removed or not

Defined results: null texts are empty, null parts are the empty part. Rows without a
document id are no copies of others, and have no labels. Rows that repeat an id and its
text count each, and are no copies of one another. A document with several labels has the
largest of each. Texts are compared by SHA-256 and length. An empty table has no parts.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import SPACE, written

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT, MOST_UPPER = 50, 65, 5
SYMBOLS = "[#$%&*|]"


def own_failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text of these words fails."""
    n, many = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    fails = (
        n < MIN_WORDS,
        100 * many < MIN_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_UPPER * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    )
    return sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(fails)), start=F.lit(0))


def failure_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) of every row; the mask has all five bits."""
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = whole.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = written(whole.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes"), own_failures(F.col("text"), F.col("words")).alias("mask")), "failures")
    firsts = rows.where(F.col("id").isNotNull()).groupBy("digest", "n_bytes").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = rows.where(F.col("id").isNotNull()).join(firsts, ["id", "digest", "n_bytes"], "left")
    repeated = F.when(F.col("first").isNull(), REPEATED).otherwise(0)
    return known.select("id", "part", (F.col("mask") + repeated).alias("mask")).unionByName(rows.where(F.col("id").isNull()).select("id", "part", "mask"))


def mask_cells(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", bad_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, bad): the histogram of masks, with the rows of each label."""
    is_one = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_one(good_col).alias("good"), is_one(bad_col).alias("bad"))
    known = rows.where(F.col("id").isNotNull()).join(marks, "id", "left").select("part", "mask", "good", "bad")
    unknown = rows.where(F.col("id").isNull()).select("part", "mask", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("bad"))
    return known.unionByName(unknown).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("bad"))


def orders_of(cells: DataFrame) -> DataFrame:
    """Every order and step of every part, from its cells."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))
    letters = F.split(F.col("filter_order"), "")
    before = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda found, letter: found.bitwiseOR(bit(letter)))
    steps = steps.select("*", before.alias("before"), bit(F.element_at(letters, F.col("step"))).alias("own"))

    def total(name: str, wanted) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda found, cell: found + F.when(wanted(cell["mask"]), cell[name]).otherwise(0))

    fails = lambda mask: mask.bitwiseAND(F.col("own")) != 0
    open_before = lambda mask: mask.bitwiseAND(F.col("before")) == 0
    gone_here = lambda mask: fails(mask) & open_before(mask)
    return steps.select(
        "part",
        "filter_order",
        "step",
        "own",
        total("n", lambda mask: ~fails(mask) & open_before(mask)).alias("kept"),
        total("n", gone_here).alias("removed"),
        total("n", lambda mask: fails(mask) & ~open_before(mask)).alias("redundant"),
        total("n", lambda mask: mask == F.col("own")).alias("unique_fails"),
        total("good", gone_here).alias("good_lost"),
        total("bad", gone_here).alias("toxic_lost"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, failed before, failed alone, lost of each label, and ``shapley``,
    the filter's removals summed over all orders."""
    cells = written(mask_cells(failure_rows(docs, id_col, text_col, part_col), labels), "mask-cells")
    steps = orders_of(cells)
    shares = steps.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return steps.join(shares, ["part", "own"]).drop("own")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), least AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text
), m AS (
  SELECT part, doc_id,
         (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text))::INT
         + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
  FROM d JOIN least ON d.text = least.text
), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT '' AS o
  UNION ALL SELECT o || letter FROM orders, letters WHERE NOT contains(o, letter)
), steps AS (
  SELECT o AS filter_order, step::INT AS step, own.bit AS own,
         (SELECT coalesce(sum(bit), 0) FROM letters WHERE contains(substr(o, 1, step - 1), letter))::INT AS before
  FROM orders, range(1, 6) AS r(step), letters AS own
  WHERE length(o) = 5 AND own.letter = substr(o, step, 1)
), found AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(bad) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own
)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM found
"""


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Digests of whole tables, made by tasks: the same for any partitioning and order of the rows.

Every row has a digest of its named values; equal rows are one entry with their number.
Entries are folded by the first digits of their digests, a few hundred at a time, and the
folds by fewer digits again, up to a root: a tree that depends on nothing but the rows. No
task holds more than one node's children, equal rows are counted before they are shuffled,
and the driver sees the root and the number of entries only. The table is read once, to
a slim table of entries.

Defined results: nulls differ from empty values, columns are taken by name in any order,
an empty table has the digest of nothing. Numbers count by what they print, times by their
microseconds; nested values by their JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType, TimestampNTZType, TimestampType, VariantType

from lodestack.storage import discard, written

#: Entries that a leaf is expected to hold at most; also the children of an inner node, which are two hexadecimal digits apart.
FAN = 256
DIGITS = 2
#: Marks a digest of rows, in manifests that also hold plain digests of files.
ROWS = "rows:"


def _said(name: str, kind) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, (StructType, ArrayType, MapType)):
        text = F.to_json(F.struct(value), {"ignoreNullFields": "false"})
    elif isinstance(kind, BinaryType):
        text = F.hex(value)
    elif isinstance(kind, TimestampType):
        text = F.unix_micros(value).cast("string")
    elif isinstance(kind, TimestampNTZType):
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    elif isinstance(kind, VariantType):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.concat(F.lit(name), F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))


def row_digests(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(digest, n): the SHA-256 of every different row, and how often it stands there."""
    kinds = {f.name: f.dataType for f in df.schema.fields if columns is None or f.name in columns}
    digest = F.sha2(F.concat(F.lit(""), *(_said(name, kinds[name]) for name in sorted(kinds))), 256)
    return df.select(digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))


def depth_of(n_entries: int) -> int:
    """Levels below the root, so that a leaf holds about ``FAN`` entries at most."""
    depth = 0
    while n_entries > FAN:
        n_entries, depth = -(-n_entries // FAN), depth + 1
    return depth


def folded(entries: DataFrame, depth: int) -> DataFrame:
    """One row (digest): the root over ``entries`` (digest, n)."""
    rows = entries.select(F.col("digest").alias("key"), F.concat_ws(":", "digest", F.col("n").cast("string")).alias("said"))
    own = F.sha2(F.array_join(F.array_sort(F.collect_list("said")), ","), 256).alias("digest")
    for level in range(depth, 0, -1):
        rows = rows.groupBy(F.substring("key", 1, level * DIGITS).alias("key")).agg(own)
        rows = rows.select("key", F.concat_ws(":", "key", "digest").alias("said"))
    return rows.agg(own)


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """The digest of all rows of ``df``."""
    spark, bag = df.sparkSession, []
    try:
        entries = written(row_digests(df, columns), "row-digests", bag=bag)
        return folded(entries, depth_of(entries.count())).first()["digest"]
    finally:
        discard(spark, bag)


def lines_digest(spark: SparkSession, path: str) -> str:
    """The digest of all lines below ``path``, any that Spark reads, however they are cut into files."""
    return ROWS + table_digest(spark.read.text(str(path)))

"""The test tables, and stand-ins that several queries share.

``documents`` stand for the corpus, ``benchmark`` for questions (the whole text, and its
short words in place of a question in other words), containment for gold links,
``embeddings`` for model vectors (queries: ids divisible by 20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A search token in SQL; the test tables hold none of the technical terms.
SQL_TOKEN = "[A-Za-z0-9]+(?:[._/+:-][A-Za-z0-9]+)*"
#: A letter, digit or underscore, and the ends of a whole word, in SQL.
SQL_LETTER = r"[\p{L}\p{N}_]"
SQL_BEFORE, SQL_AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_numbers(text: str) -> str:
    """Numbers that stand alone: characters around words are doubled first, so that neighbours need not share one."""
    doubled = f"regexp_replace({text}, '([^{SQL_LETTER[1:-1]}])', '\\1\\1', 'g')"
    return f"list_transform(regexp_extract_all({doubled}, '{SQL_BEFORE}(\\d+(?:\\.\\.\\d+)?){SQL_AFTER}', 1), lambda x: replace(x, '..', '.'))"


def sql_tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '{SQL_TOKEN}'), lambda x: lower(x))"

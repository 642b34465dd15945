"""Text functions as Catalyst expressions; small Python ones where Catalyst has none."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a search token. The flags make Java match letters and digits as Unicode does.
TOKEN = r"(?iU)(?<![A-Za-z0-9_])(?:c\+\+(?:\d+)?|c#(?:\d+)?|\.net|node\.js|ci/cd)(?![A-Za-z0-9_])|[A-Za-z0-9]+(?:[._/+:-][A-Za-z0-9]+)*"
#: Without one of these strings or letters in it, a text has tokens of the second kind only, found by a pattern that costs a fraction.
TECHNICAL = ("c++", "c#", ".net", "node.js", "ci/cd")
FOLDING_LETTERS = "\u017f\u212a\u0130\u0131"
PLAIN_TOKEN = TOKEN.rpartition("|")[2]
#: Words of an evidence span, and those that say nothing.
TERM = r"[A-Za-z][A-Za-z0-9+.#/\-]*"
STOP_WORDS = (
    "a an and are as at be by can do for from have in is it of on or our the their "
    "this to with will you your we work working role team teams experience skills "
    "ability able knowledge strong excellent required requirements good including "
    "using use develop support build provide manage across ensure within about "
    "position candidate candidates job years year plus must should preferred"
).split()
#: Words of a question that do not count as shared with its evidence.
QUESTION_STOP_WORDS = (
    "a an and are as at be by can do for from have in is it of on or our the "
    "their this to with will you your we which what where who role saved job "
    "requires require requiring"
).split()
#: A word, and a number that stands alone. Java's Unicode classes take combining marks for word characters and some numerals not.
WORD = r"(?U)\b[\w]+(?:[’'-][\w]+)*\b"
NUMBER = r"(?U)(?<!\w)\d+(?:\.\d+)?(?!\w)"
#: White space as Python has it: Java's Unicode class lacks four separators.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def _text(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def _all(text: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(0))


def search_tokens(text: str | Column) -> Column:
    """Search tokens in lower case, in order; null gives none."""
    low = F.lower(_text(text))
    technical = F.lit(False)
    for letter in FOLDING_LETTERS:
        technical = technical | F.contains(_text(text), F.lit(letter))
    for term in TECHNICAL:
        technical = technical | F.contains(low, F.lit(term))
    return F.when(technical, F.transform(_all(text, TOKEN), F.lower)).otherwise(F.regexp_extract_all(low, F.lit(PLAIN_TOKEN.replace("A-Z", "")), F.lit(0)))


def evidence_terms(text: str | Column) -> Column:
    """Distinct terms of at least three characters outside the stop words."""
    found = F.transform(_all(text, TERM), F.lower)
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_except(F.filter(found, lambda t: F.length(t) >= 3), stop)


def lexical_terms(text: str | Column) -> Column:
    """Distinct search tokens outside the question stop words."""
    return F.array_except(F.array_distinct(search_tokens(text)), F.array(*map(F.lit, QUESTION_STOP_WORDS)))


def numbers(text: str | Column) -> Column:
    """Distinct numbers that stand alone, as written."""
    return F.array_distinct(_all(text, NUMBER))


def word_count(text: str | Column) -> Column:
    return F.regexp_count(_text(text), F.lit(WORD)).cast("long")


def one_line(text: str | Column) -> Column:
    """Every run of white space as one space, none at the ends; null stays null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(col, SPACES, " "))


def location(text: str | Column) -> Column:
    """``one_line``, null where nothing is left."""
    return F.nullif(one_line(text), F.lit(""))


def short_text(text: str | Column, limit: int = 180) -> Column:
    """``one_line`` of at most ``limit`` characters, the last an ellipsis where some are missing; null gives the empty text."""
    whole = one_line(_text(text))
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, limit - 1)), F.lit("…")))


def trimmed_span(text: Column, start: Column, end: Column) -> Column:
    """A struct (start, end): the range without the white space at its ends, empty at ``end`` where there is nothing else."""
    part = F.substr(text, start + 1, end - start)
    ahead = F.length(F.regexp_extract(part, "^" + SPACES.replace("(?U)", "(?U:") + ")", 0))
    behind = F.length(F.regexp_extract(part, SPACES.replace("(?U)", "(?U:") + r")\z", 0))
    low = start + ahead
    return F.struct(low.alias("start"), F.greatest(low, end - behind).alias("end"))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the trimmed phrase stands in the text as whole words, without regard to case; a blank one does not."""
    bare = F.trim(phrase)
    literal = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(bare, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.coalesce((bare != "") & F.regexp(text, literal), F.lit(False))


def hostname(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def stable_id(*parts: Column) -> Column:
    """sha256 of the trimmed parts, joined by the unit separator; a null or blank part fails the query."""
    texts = [F.regexp_replace(p.cast("string"), r"^(?U:[\s\x1c-\x1f]+)|(?U:[\s\x1c-\x1f]+)\z", "") for p in parts]
    bad = F.lit(False)
    for text in texts:
        bad = bad | (F.coalesce(text, F.lit("")) == "")
    return F.sha2(F.when(bad, F.raise_error(F.lit("an identifier needs parts that are not blank"))).otherwise(F.concat_ws("\u001f", *texts)), 256)


def seeded_key(seed: int, value: Column) -> Column:
    """A digest to sort by: the same order for a seed on every run."""
    return F.sha2(F.concat_ws("\u001f", F.lit(str(seed)), value.cast("string")), 256)


def python_round(value: Column, digits: int) -> Column:
    """Rounds the exact binary value, as Python does and neither of Spark's roundings."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array([None if x is None else round(x, digits) for x in array.to_pylist()], pa.float64())

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(value)


def utc_time(value: str | float | dt.date | None, unit: str | None = None) -> dt.datetime | None:
    """The UTC time of a date and time with a zone, or of seconds or milliseconds since 1970; null for a day or a local time."""
    if isinstance(value, bool):
        raise TypeError("true and false are no times")
    if isinstance(value, (int, float)):
        if unit not in ("seconds", "milliseconds"):
            raise ValueError("a number needs the unit seconds or milliseconds")
        if not math.isfinite(value):
            raise ValueError("a time is finite")
        return dt.datetime.fromtimestamp(value / 1000 if unit == "milliseconds" else value, dt.UTC)
    if isinstance(value, str):
        bare = value.strip()
        day = not bare or re.fullmatch(r"\d{4}-\d{2}-\d{2}", bare)
        value = None if day else dt.datetime.fromisoformat(bare.replace("Z", "+00:00"))
    elif value is not None and not isinstance(value, dt.date):
        raise TypeError(f"{type(value).__name__} is no time")
    if not isinstance(value, dt.datetime) or value.utcoffset() is None:
        return None
    return value.astimezone(dt.UTC)


def utc_column(value: Column) -> Column:
    """``utc_time`` of a text column, as a timestamp; a text that is no time fails the query."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array([utc_time(x) for x in array.to_pylist()], pa.timestamp("us", tz="UTC"))

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "timestamp")(value)

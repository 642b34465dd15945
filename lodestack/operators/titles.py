"""Rule-based title filter as one CASE expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Why a title was not accepted.
REASONS = ("internship title or employment type", "configured ambiguous title", "matches multiple job families", "no target family title rule matched")


def _any(col: Column, patterns: Sequence[str]) -> Column:
    """Whether some pattern is found, without regard to case; null and empty texts match none."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(col.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def title_filter(title: Column, employment: Column, internship: Sequence[str], ambiguous: Sequence[str], families: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> Column:
    """A struct (status, family, reason). Internships go first, then ambiguous titles; exactly one family accepts.

    ``families`` maps a name to its positive and negative patterns; accepted titles have no reason."""
    fits = F.filter(
        F.array(*(F.when(_any(title, yes) & ~_any(title, no), F.lit(name)) for name, (yes, no) in families.items())),
        lambda f: f.isNotNull(),
    )
    status = (
        F.when(_any(title, internship) | _any(employment, internship), "internship")
        .when(_any(title, ambiguous) | (F.size(fits) > 1), "ambiguous")
        .when(F.size(fits) == 1, "accepted")
        .otherwise("non_target")
    )
    reason = (
        F.when(status == "internship", REASONS[0]).when(_any(title, ambiguous), REASONS[1])
        .when(F.size(fits) > 1, REASONS[2]).when(F.size(fits) == 0, REASONS[3])
    )
    return F.struct(status.alias("status"), F.when(status == "accepted", fits[0]).alias("family"), reason.alias("reason"))

"""All queries over the test tables, and the same in DuckDB SQL where it can say them.

Without SQL: markup (``clean_html``, ``html_sections``, ``structure_stats``) and the blocks
that a ranking opens (``bm25_blocks``); tests hold those against fixtures."""

from __future__ import annotations

from lodestack.plans import checks, passages, ranking, stored, texts

_PARTS = (texts, passages, ranking, checks, stored)


def queries() -> dict:
    return {f.__name__: f for part in _PARTS for f in part.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}

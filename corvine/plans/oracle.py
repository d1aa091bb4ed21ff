"""DuckDB SQL of the core queries."""

from __future__ import annotations

from corvine.plans import collections, search, texts, upkeep


def oracle_sql() -> dict[str, str]:
    return search.SQL | texts.SQL | collections.SQL | upkeep.SQL

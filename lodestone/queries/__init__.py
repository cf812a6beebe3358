"""The registered queries by family, each with its SQL."""

from __future__ import annotations

from lodestone.queries import chunks, entities, graph, html, ops, reports, retrieval, scoring, similarity, text
from lodestone.queries.common import Query

FAMILIES = (text, html, scoring, chunks, entities, graph, similarity, retrieval, ops, reports)


def queries() -> dict[str, Query]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}

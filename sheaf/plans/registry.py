"""All core queries and their SQL."""

from __future__ import annotations

from sheaf.plans import folders, problems, records, texts

CATALOGS = (texts.C, records.C, folders.C)


def queries() -> dict:
    out = dict(problems.QUERIES)
    for c in CATALOGS:
        out |= c.queries
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(problems.SQL)
    for c in CATALOGS:
        out |= c.sql
    return out

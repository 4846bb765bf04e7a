"""All registered queries on the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from tabscore.plans import catalog, catalog_extra  # noqa: F401  (the second registers its queries with the first)

flagship = catalog.flagship


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)

"""All queries of the map-data operators with their SQL."""

from __future__ import annotations

from terrafold.plans import changes, measures, packages, relational, scalars, search, state  # noqa: F401
from terrafold.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

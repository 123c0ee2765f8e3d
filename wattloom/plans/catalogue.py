"""All registered queries."""

from __future__ import annotations

from wattloom.plans import calendar_queries, cluster_queries, forecast_queries, meter_queries, score_queries, source_queries, spectrum_queries, split_queries  # noqa: F401
from wattloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

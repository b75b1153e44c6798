"""Every registered query over the driver's tables, and its SQL twin."""

from __future__ import annotations

from blockloom.plans import further, headers, maps, more, outputs, records, statistics  # noqa: F401
from blockloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

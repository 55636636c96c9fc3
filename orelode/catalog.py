"""All queries of the library outside ``llm``: name, builder and the same query as SQL."""

from __future__ import annotations

from orelode.plans import blobs, formats, headers, inference, manifest  # noqa: F401  they register their queries
from orelode.plans.registry import ORACLES, QUERIES, Builder


def queries() -> dict[str, Builder]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

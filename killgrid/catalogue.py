"""All queries of the engine with their SQL twins."""

from __future__ import annotations

from .plans import analytics, clusters, custom, evaluation, facts, oracles, ordered, registry, reports, stores, texts, vectors  # noqa: F401  these register their queries


def queries() -> dict:
    return registry.queries() | custom.queries()


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql()

"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from lorewright.plans import graphs, knowledge, linking, questions, registry, scalars, service, texts, vectors  # noqa: F401  they register their queries


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)

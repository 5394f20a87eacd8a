"""All registered queries of the engine with their SQL equivalents."""

from granary.plans import assembly, corpus, evaluation, judged, records, serving  # noqa: F401  (they register their queries)
from granary.plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)

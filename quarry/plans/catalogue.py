"""All queries of the library; importing the modules registers them."""

from quarry.plans import corpus, evaluation, more, retrieval  # noqa: F401
from quarry.plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

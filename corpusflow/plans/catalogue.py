"""All registered queries of the library."""

from . import eval_queries, record_queries, set_queries, source_queries, text_queries
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["oracle_sql", "queries", "text_queries", "eval_queries", "set_queries", "source_queries", "record_queries"]

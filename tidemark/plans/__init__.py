"""The registered queries: functions from (spark, sf_dir) to a DataFrame, with the same question in SQL."""

from tidemark.plans import broker, feeds, kv, lifecycle, orders, trading, txn  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

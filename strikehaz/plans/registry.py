"""The registered queries: name -> (Spark plan, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a plan (spark, sf_dir) -> DataFrame; `oracle` is the same result in SQL."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"Query '{name}' is registered twice")
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = " ".join(oracle.split())
        return plan

    return register

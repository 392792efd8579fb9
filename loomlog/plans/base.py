"""The registry itself, and what its queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlog.sources.eventlog import log, log_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, and its SQL over the driver's tables and `log`."""

    def put(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"WITH log AS ({log_sql(False)}) {sql}" if " log" in sql else sql
        return run

    return put


def over_log(name: str, make, sql: str | None = None) -> None:
    """A query that is a function of the log."""
    query(name, sql)(lambda spark, sf_dir: make(log(spark, sf_dir)))

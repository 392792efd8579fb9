"""Queries of the log engine by name, each with the SQL that has the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlog.plans import extra, relations, reports, scalars, windows
from loomlog.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "extra", "flagship", "relations", "reports", "scalars", "windows"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


Query = Callable[[SparkSession, str], DataFrame]

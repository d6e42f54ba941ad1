"""Registry of queries and of the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortscale.catalog.sql import RESAMPLES
from cohortscale.operators.bootstrap import Boot
from cohortscale.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEED = 20260916
BOOT = Boot(seed=SEED, n_resamples=RESAMPLES, alpha=0.05)
CLASSES = ("A", "N", "R")


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``, with its SQL where there is one."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap

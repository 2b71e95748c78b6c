"""All queries of the document engine."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folium.plans import audit_queries, form_queries, grid_queries, office_queries, text_queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_MODULES = (text_queries, grid_queries, form_queries, office_queries, audit_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(ready(spark), sf_dir)) for k, f in QUERIES.items()}

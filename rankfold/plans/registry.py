"""Registry of named queries: Spark builder + (optional) DuckDB oracle SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    Event times are naive UTC (``TIMESTAMP_NTZ``); converting them to
    instants depends on the session time zone, so a registered query pins it
    to UTC (on the caller's session) before it builds its plan.
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def load_all():
    # importing the modules registers their queries
    for mod in ("q_prepare", "q_eval", "q_models", "q_recommend", "q_quality", "q_fairness", "q_rerank",
                "q_explain", "q_telemetry", "q_sources", "q_streaming"):
        try:
            __import__(f"rankfold.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"rankfold.plans.{mod}":
                raise
    return QUERIES, ORACLE

"""Registry of the core's queries: a function and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: CTE texts for oracles: one row per key where a record may be delivered twice.
ONCE = {
    "notes": "notes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interpretation_id ORDER BY ingested_at DESC) AS rn FROM interpretations) t WHERE rn = 1)",
    "readers": "readers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ingested_at DESC) AS rn FROM users) t WHERE rn = 1)",
    "messages": "messages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ingested_at DESC) AS rn FROM whisper_messages) t WHERE rn = 1)",
    "votes": "votes AS (SELECT comparison_id, user_id, TRY_CAST(TRY_CAST(trim(winner_run_id) AS DOUBLE) AS BIGINT) AS w, TRY_CAST(TRY_CAST(trim(loser_run_id) AS DOUBLE) AS BIGINT) AS l FROM (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY ingested_at DESC) AS rn FROM comparisons) t WHERE rn = 1)",
}


def with_once(*names: str) -> str:
    return "WITH " + ", ".join(ONCE[n] for n in names)


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); `sql` is its oracle."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add

"""Deduplication on read (WN01, WN02, WN07, SM04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest(df: DataFrame, keys: list[str], order: str | Column, ties: list[str] | None = None) -> DataFrame:
    """One row per key: the last by `order` (nulls first), ties by `ties`, descending. Rows with a null in a key form a key of their own.

    row_number with a limit of 1 is pre-aggregated before the shuffle by the
    window group limit, so repeated rows of a hot key are cut on the map side.
    """
    first = F.col(order).desc_nulls_last() if isinstance(order, str) else order
    w = W.partitionBy(*keys).orderBy(first, *(F.col(t).desc_nulls_last() for t in ties or []))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def first_seen(df: DataFrame, keys: list[str], order: str, ties: list[str] | None = None) -> DataFrame:
    """One row per key: the first by `order`."""
    w = W.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last(), *(F.col(t).asc_nulls_last() for t in ties or []))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")

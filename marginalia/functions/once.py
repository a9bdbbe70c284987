"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with the columns added, or put in place of those of the same name, through a generator of one row, across which the optimizer doesn't inline expressions.

    For array expressions that later ones use several times: inlined, each use would
    work them out again, and nested uses multiply.
    """
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))

"""Roll-ups of runs to books and profiles (AG22, AG23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.rounding import half_even, largest_of

SHARES = ("think_r", "think_c", "think_d", "feel_r", "feel_c", "feel_d")


def _mean(c: str) -> Column:
    """Mean from a sum of thousandths, so that it doesn't depend on the order of summation; 0 without values."""
    total = F.sum(F.round(F.col(c) * 1000).cast("long")).cast("double") / 1000 / F.count(c)
    return F.coalesce(half_even(total, 2), F.lit(0.0))


def _whole_mean(c: str) -> Column:
    return F.coalesce(half_even(F.sum(c).cast("double") / F.count(c), 2), F.lit(0.0))


def _labels(df: DataFrame) -> DataFrame:
    whole = lambda p: [F.rint(f"{p}_{k}") for k in "rcd"]
    both = [(F.col(f"think_{k}") + F.col(f"feel_{k}")) / 2 for k in "rcd"]
    return df.withColumns({"dominant_think": largest_of(*whole("think")), "dominant_feel": largest_of(*whole("feel")), "verdict": largest_of(*both)})


def book_level(runs: DataFrame) -> DataFrame:
    """One row per unordered pair and book."""
    g = runs.groupBy(F.least("user_a", "user_b").alias("user_a"), F.greatest("user_a", "user_b").alias("user_b"), "book_id")
    return _labels(g.agg(*(_whole_mean(c).alias(c) for c in SHARES), _mean("confidence").alias("confidence"), F.count("*").alias("passage_count")))


def profile_level(books: DataFrame) -> DataFrame:
    """One row per unordered pair, from its book rows."""
    g = books.groupBy("user_a", "user_b").agg(*(_whole_mean(c).alias(c) for c in SHARES), _mean("confidence").alias("confidence"), F.count_distinct("book_id").alias("book_count"), F.count("*").alias("book_rows"), F.sum("passage_count").alias("passage_count"))
    return _labels(g)

"""Profiles, checks and distributions of tables (AG01-AG20, AG46, AG49)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from marginalia.functions.rounding import half_even, ratio

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def distribution(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """(value, n, pct, expected, deviation): shares of all rows, nulls in the denominator but not among the values.

    The expectation is uniform over the values. One aggregation over the table; the
    rest runs on its groups.
    """
    groups = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    totals = groups.agg(F.sum("n").alias("total"), F.count("value").alias("k")).first()
    total, k = totals["total"] or 0, totals["k"] or 0
    pct = half_even(F.lit(100.0) * F.col("n") / F.lit(float(total or 1)), digits)
    expected = half_even(F.lit(100.0 / (k or 1)), digits)
    return groups.filter(F.col("value").isNotNull()).withColumns({"pct": pct, "expected": expected, "deviation": half_even(pct - expected, digits)})


def null_shares(df: DataFrame, columns: Sequence[str], alert: float = 0.1) -> DataFrame:
    """(column, nulls, share, severity): one pass over all columns; severity is null up to `alert`, 'high' above twice as much."""
    row = df.agg(F.count("*").alias("__n"), *(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns))
    long = row.select("__n", F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.coalesce(F.col(c), F.lit(0)))))).alias("column", "nulls"))
    share = F.coalesce(ratio(F.col("nulls"), F.col("__n")), F.lit(0.0))
    return long.select("column", "nulls", share.alias("share"), F.when(share > 2 * alert, "high").when(share > alert, "medium").alias("severity"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, q25, median, q75, max, n_distinct) with the sample deviation; one pass."""
    stats = df.agg(*(F.struct(F.count(c).alias("n"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), *(F.percentile(c, q).alias(n) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))), F.max(F.col(c).cast("double")).alias("max"), F.count_distinct(c).alias("n_distinct")).alias(c) for c in columns))
    return stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns))).alias("x")).select("x.column", "x.s.*")


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """(column, value, n, place): the k most frequent values of each column, ties by value; nulls don't count."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    w = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def outlier_shares(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """(column, n, outliers, share): values more than `limit` sample deviations from the mean."""
    stats = df.agg(*(f(c).alias(f"{p}_{c}") for c in columns for p, f in (("m", F.avg), ("s", F.stddev_samp)))).first()

    def far(c: str) -> Column:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        return F.abs((F.col(c) - F.lit(float(m))) / F.lit(float(s))) > limit if m is not None and s else F.lit(False)

    counts = df.agg(*(F.struct(F.count(c).alias("n"), F.coalesce(F.sum(far(c).cast("long")), F.lit(0)).alias("outliers")).alias(c) for c in columns))
    long = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns))).alias("x")).select("x.column", "x.s.*")
    return long.withColumn("share", F.coalesce(ratio(F.col("outliers"), F.col("n")), F.lit(0.0)))


def schema_violations(df: DataFrame, rules: Mapping[str, Mapping]) -> DataFrame:
    """(column, rule, violations) of declared rules: required, min, max, allowed.

    A missing column breaks 'required' once per row; a null breaks 'required' and
    'allowed', but not 'min' and 'max'.
    """
    checks: list[tuple[str, str, Column]] = []
    for c, rule in rules.items():
        there = c in df.columns
        if rule.get("required"):
            checks.append((c, "required", F.col(c).isNull() if there else F.lit(True)))
        if there and "min" in rule:
            checks.append((c, "min", F.col(c) < rule["min"]))
        if there and "max" in rule:
            checks.append((c, "max", F.col(c) > rule["max"]))
        if there and "allowed" in rule:
            checks.append((c, "allowed", ~F.coalesce(F.col(c).isin(*rule["allowed"]), F.lit(False))))
    row = df.agg(*(F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias(f"v{i}") for i, (_, _, v) in enumerate(checks)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"v{i}").alias("violations")) for i, (c, r, _) in enumerate(checks)))).alias("x")).select("x.*")


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Structs as columns named parent_child, arrays of plain values as ', '-joined text, other nested values as JSON (PRJ06)."""

    def walk(name: str, col: Column, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in walk(f"{name}{sep}{f.name}", col.getField(f.name), f.dataType)]
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return [F.array_join(col.cast("array<string>"), ", ").alias(name)]
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return [F.to_json(col).alias(name)]
        return [col.alias(name)]

    return df.select(*reduce(lambda a, b: a + b, (walk(f.name, F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), []))

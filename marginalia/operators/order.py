"""Places in a total order and exact order statistics, without a task that sorts or holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.session import cut_lineage

#: Rows among which order statistics are looked up at once.
HELD = 50_000


def placed(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """`df` with each row's place, from 1, in the order of `order`: counted per range partition, of which one row each comes to the driver."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    part = F.spark_partition_id()
    out = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"__part": part, "__at": F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)})
    out = cut_lineage(out)
    before, at = [], 0
    for k, n in sorted(map(tuple, out.groupBy("__part").agg(F.count("*")).collect())):
        before += [F.lit(k), F.lit(at)]
        at += n
    offset = F.create_map(*before)[F.col("__part")] if before else F.lit(0)
    return out.withColumn(name, (offset + F.col("__at") + 1).cast("long")).drop("__part", "__at")


def order_statistics(df: DataFrame, value: Column, ranks: Sequence[int], held: int = HELD) -> list[float | None]:
    """The values at the given ranks, from 0, of the values that aren't null; None for a rank beyond them.

    A sketch of fixed size brackets each rank; the rows within the bracket are counted
    and bracketed again until so few are left that one task may hold them.
    """
    v = df.select(value.cast("double").alias("v")).filter("v IS NOT NULL")
    total = v.count()
    out: list[float | None] = []
    for rank in ranks:
        if not 0 <= rank < total:
            out.append(None)
            continue
        inside, n, k = v, total, rank
        while n > held:
            p = (k + 0.5) / n
            low, high = inside.agg(F.percentile_approx("v", [max(0.0, p - 1e-3), min(1.0, p + 1e-3)], 10_000)).first()[0]
            row = inside.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high)), F.min("v"), F.max("v")).first()
            if not row[0] <= k < row[0] + row[1]:  # the sketch missed: halve by its middle instead
                low, high = (row[2], low) if k < row[0] else (high, row[3])
                row = inside.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high)), F.min("v"), F.max("v")).first()
            if low == high or row[1] == n:
                break
            inside, n, k = inside.filter(F.col("v").between(low, high)), row[1], k - row[0]
        # values are counted first: a task holds distinct ones
        counts = sorted(map(tuple, inside.groupBy("v").count().collect())) if n <= held else None
        if counts is None:
            out.append(float(low if low == high else inside.agg(F.percentile("v", k / max(n - 1, 1))).first()[0]))
            continue
        for x, c in counts:
            if k < c:
                out.append(float(x))
                break
            k -= c
    return out


def median(df: DataFrame, value: Column) -> float | None:
    """The mean of the two middle values; None without any."""
    n = df.filter(value.isNotNull()).count()
    if n == 0:
        return None
    a, b = order_statistics(df, value, [(n - 1) // 2, n // 2])
    return (a + b) / 2

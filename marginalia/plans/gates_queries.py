"""Queries of model gates: pass rates, slices, rollback, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.functions.rounding import half_even, ratio
from marginalia.functions.stats import f_tail
from marginalia.operators.order import median
from marginalia.plans.profiling_queries import readers
from marginalia.plans.ranking_queries import edges
from marginalia.plans.registry import ORACLES, query, with_once
from marginalia.tables import table

LABELS = ("resonate", "contradict", "diverge")
_IN = "think_r BETWEEN 0 AND 100 AND think_c BETWEEN 0 AND 100 AND think_d BETWEEN 0 AND 100 AND feel_r BETWEEN 0 AND 100 AND feel_c BETWEEN 0 AND 100 AND feel_d BETWEEN 0 AND 100"


def _within(c: str):
    return F.col(c).between(0, 100)


def gate_metrics(runs: DataFrame) -> DataFrame:
    """One row of rates: shares summing to 100, in range, known labels, confidence in range; mean confidence of the rows in range."""
    inside = _within("think_r") & _within("think_c") & _within("think_d") & _within("feel_r") & _within("feel_c") & _within("feel_d")
    sums = lambda p: (F.abs(F.col(f"{p}_r") + F.col(f"{p}_c") + F.col(f"{p}_d") - 100) <= 2)
    rate = lambda c: half_even(ratio(F.count_if(c), F.count("*")), 4)
    conf = F.round(F.col("confidence") * 1000).cast("long")
    return runs.agg(rate(sums("think")).alias("think_sum_rate"), rate(sums("feel")).alias("feel_sum_rate"), rate(inside).alias("share_range_rate"), rate(F.col("dominant_think").isin(*LABELS) & F.col("dominant_feel").isin(*LABELS)).alias("label_rate"), rate(F.col("confidence").between(0.2, 0.95)).alias("range_rate"), half_even(F.sum(F.when(inside, conf)).cast("double") / 1000 / F.count_if(inside), 4).alias("mean_confidence"))


@query("ag28_pass_rates", f"SELECT round_even(CAST(count(*) FILTER (abs(think_r + think_c + think_d - 100) <= 2) AS DOUBLE) / count(*), 4) AS think_sum_rate, round_even(CAST(count(*) FILTER (abs(feel_r + feel_c + feel_d - 100) <= 2) AS DOUBLE) / count(*), 4) AS feel_sum_rate, round_even(CAST(count(*) FILTER ({_IN}) AS DOUBLE) / count(*), 4) AS share_range_rate, round_even(CAST(count(*) FILTER (dominant_think IN ('resonate', 'contradict', 'diverge') AND dominant_feel IN ('resonate', 'contradict', 'diverge')) AS DOUBLE) / count(*), 4) AS label_rate, round_even(CAST(count(*) FILTER (confidence BETWEEN 0.2 AND 0.95) AS DOUBLE) / count(*), 4) AS range_rate, round_even(CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) FILTER ({_IN}) AS DOUBLE) / 1000 / count(*) FILTER ({_IN}), 4) AS mean_confidence FROM compat_runs")
def ag28_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG28, AG34, AJ12, AJ13, D15."""
    return gate_metrics(table(spark, sf_dir, "compat_runs"))


THRESHOLDS = {"think_sum_rate": 1.0, "feel_sum_rate": 1.0, "share_range_rate": 0.95, "label_rate": 0.95, "range_rate": 0.95, "mean_confidence": 0.4}


def gate_failures(metrics: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(metric, value, threshold, failed) of one row of metrics."""
    return metrics.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("threshold")) for m, t in thresholds.items()))).alias("x")).select("x.*").withColumn("failed", F.coalesce(F.col("value") < F.col("threshold"), F.lit(True)))


_METRICS = ORACLES["ag28_pass_rates"]


@query("ag29_gate", f"WITH m AS ({_METRICS}) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value, CAST({t} AS DOUBLE) AS threshold, coalesce({m} < {t}, true) AS failed FROM m" for m, t in THRESHOLDS.items()))
def ag29_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG29: metrics below their thresholds."""
    return gate_failures(gate_metrics(table(spark, sf_dir, "compat_runs")))


#: The largest drop of each metric that isn't rolled back.
DROPS = {"mean_confidence": 0.05, "range_rate": 0.03}


def rollback(before: DataFrame, now: DataFrame, drops: dict[str, float] = DROPS) -> DataFrame:
    """(metric, before, now, rolled_back) of two rows of metrics."""
    long = lambda df, n: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias(n)) for m in drops))).alias("x")).select("x.*")
    allowed = F.create_map(*(F.lit(x) for kv in drops.items() for x in kv))[F.col("metric")]
    return long(before, "before").join(long(now, "now"), "metric").withColumn("rolled_back", F.coalesce(F.col("before") - F.col("now") > allowed, F.lit(False)))


_HALF = "FROM compat_runs WHERE epoch_us(run_at) {0} (SELECT median(epoch_us(run_at)) FROM compat_runs)"


@query("ag30_rollback", f"WITH b AS ({_METRICS.replace('FROM compat_runs', _HALF.format('<='))}), a AS ({_METRICS.replace('FROM compat_runs', _HALF.format('>'))}) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, b.{m} AS before, a.{m} AS now, coalesce(b.{m} - a.{m} > CAST({d} AS DOUBLE), false) AS rolled_back FROM a, b" for m, d in DROPS.items()))
def ag30_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG30: metrics of the later half of the runs against those of the earlier half, by the largest drops allowed."""
    runs = table(spark, sf_dir, "compat_runs")
    at = F.unix_micros("run_at")
    middle = F.lit(median(runs, at)).cast("double")
    return rollback(gate_metrics(runs.filter(at <= middle)), gate_metrics(runs.filter(at > middle)))


_C = "round_even(CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) AS DOUBLE) / 1000 / count(confidence), 4)"


@query("ag26_slices", f"SELECT coalesce(book_id, 'unknown') AS slice, {_C} AS mean_confidence, count(confidence) AS n FROM compat_runs GROUP BY 1")
def ag26_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG26: confidence by book."""
    return slices(table(spark, sf_dir, "compat_runs"), "book_id")


def slices(runs: DataFrame, column: str) -> DataFrame:
    conf = F.round(F.col("confidence") * 1000).cast("long")
    return runs.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("slice")).agg(half_even(F.sum(conf).cast("double") / 1000 / F.count("confidence"), 4).alias("mean_confidence"), F.count("confidence").alias("n"))


@query("ag27_gap", f"WITH s AS (SELECT coalesce(book_id, 'unknown') AS slice, {_C} AS c FROM compat_runs GROUP BY 1) SELECT round_even(max(c) - min(c), 4) AS gap, (SELECT min(slice) FROM s WHERE c = (SELECT max(c) FROM s)) AS best, (SELECT min(slice) FROM s WHERE c = (SELECT min(c) FROM s)) AS worst, round_even(max(c) - min(c), 4) >= 0.3 AS alert, round_even(max(c) - min(c), 4) >= 0.5 AS block FROM s")
def ag27_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG27: the widest gap between slices; ties by the slice's name."""
    s = slices(table(spark, sf_dir, "compat_runs"), "book_id").filter(F.col("mean_confidence").isNotNull())
    c = F.col("mean_confidence")
    g = s.agg(F.max(c).alias("hi"), F.min(c).alias("lo"), F.min(F.struct((-c).alias("k"), "slice"))["slice"].alias("best"), F.min(F.struct(c.alias("k"), "slice"))["slice"].alias("worst"))
    gap = half_even(F.col("hi") - F.col("lo"), 4)
    return g.select(gap.alias("gap"), "best", "worst", (gap >= 0.3).alias("alert"), (gap >= 0.5).alias("block"))


def eta_squared(df: DataFrame, group: str, value: str, least: int = 10) -> DataFrame:
    """(feature, groups, n, eta2, f, p): share of the variance between groups of at least `least` rows; group sums only leave the executors."""
    g = df.filter(F.col(group).isNotNull() & (F.lower(group) != "unknown") & F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("s"), F.sum(F.col(value).cast("double") ** 2).alias("q")).filter(F.col("n") >= least)
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b")).select("k", "n", (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("total"), (F.col("b") - F.col("s") * F.col("s") / F.col("n")).alias("between"))
    f = F.try_divide(F.col("between") / (F.col("k") - 1), (F.col("total") - F.col("between")) / (F.col("n") - F.col("k")))
    p = F.udf(f_tail, "double")
    return t.select(F.lit(group).alias("feature"), F.col("k").alias("groups"), "n", half_even(F.try_divide(F.col("between"), F.col("total")), 6).alias("eta2"), half_even(f, 4).alias("f"), half_even(p(f, (F.col("k") - 1).cast("int"), (F.col("n") - F.col("k")).cast("int")), 6).alias("p"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readers(spark, sf_dir).select("user_id", "sex", "layout_mode")
    return edges(table(spark, sf_dir, "compat_runs")).join(r, "user_id", "left")


_ETA = "SELECT '{0}' AS feature, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, round_even((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) AS eta2, round_even(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 4) AS f FROM (SELECT {0} AS g, count(*) AS n, CAST(sum(think_r) AS DOUBLE) AS s, CAST(sum(think_r * think_r) AS DOUBLE) AS q FROM j WHERE {0} IS NOT NULL AND lower({0}) <> 'unknown' GROUP BY 1 HAVING count(*) >= 10)"


@query("ag31_sensitivity", f"{with_once('readers')}, e AS (SELECT user_a AS user_id, think_r FROM compat_runs UNION ALL SELECT user_b, think_r FROM compat_runs), j AS (SELECT think_r, CASE WHEN lower(trim(gender)) <> '' THEN lower(trim(gender)) END AS sex, layout_mode FROM e LEFT JOIN readers r ON e.user_id = r.user_id) {_ETA.format('sex')} UNION ALL {_ETA.format('layout_mode')}")
def ag31_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG31, FLT16, FLT17, WN08: how much of the scores' variance reader groups explain."""
    p = _profiles(spark, sf_dir)
    return eta_squared(p, "sex", "think_r").unionByName(eta_squared(p, "layout_mode", "think_r")).drop("p")


@query("ag31_p_values")
def ag31_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG31, H7: the same with p-values, for which SQL lacks the F distribution; tested on values from tables."""
    p = _profiles(spark, sf_dir)
    return eta_squared(p, "sex", "think_r").unionByName(eta_squared(p, "layout_mode", "think_r"))


_DEV = "stddev_samp(CAST({0} AS DOUBLE))"


@query(
    "ag32_group_means",
    f"""{with_once('readers')}, e AS (SELECT user_a AS user_id, think_r, feel_r FROM compat_runs UNION ALL SELECT user_b, think_r, feel_r FROM compat_runs), j AS (SELECT think_r, feel_r, layout_mode AS grp FROM e JOIN readers r ON e.user_id = r.user_id WHERE layout_mode IS NOT NULL AND lower(layout_mode) <> 'unknown'),
    o AS (SELECT CAST(sum(think_r) AS DOUBLE) / count(*) AS mt, {_DEV.format('think_r')} AS st, CAST(sum(feel_r) AS DOUBLE) / count(*) AS mf, {_DEV.format('feel_r')} AS sf FROM j), g AS (SELECT grp, count(*) AS n, CAST(sum(think_r) AS DOUBLE) / count(*) AS gt, {_DEV.format('think_r')} AS dt, CAST(sum(feel_r) AS DOUBLE) / count(*) AS gf, {_DEV.format('feel_r')} AS df FROM j GROUP BY 1 HAVING count(*) >= 10)
    SELECT grp, n, round_even(gt, 2) AS mean_think_r, round_even(dt, 2) AS std_think_r, abs(gt - mt) > st AS think_flag, round_even(gf, 2) AS mean_feel_r, round_even(df, 2) AS std_feel_r, abs(gf - mf) > sf AS feel_flag FROM g, o""",
)
def ag32_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG32, FLT16, FLT17: means and deviations of each group of at least ten rows, and whether a mean is more than one deviation of all rows off theirs."""
    j = _profiles(spark, sf_dir).filter(F.col("layout_mode").isNotNull() & (F.lower("layout_mode") != "unknown")).withColumnRenamed("layout_mode", "grp")
    return group_means(j, "grp", ("think_r", "feel_r"))


def group_means(df: DataFrame, group: str, values: tuple[str, ...], least: int = 10) -> DataFrame:
    """(group, n, and per value its mean, deviation and flag); all rows' mean and deviation are one row, sent to the tasks."""
    mean = lambda v: F.sum(v).cast("double") / F.count(v)
    dev = lambda v: F.stddev_samp(F.col(v).cast("double"))
    whole = df.agg(*(mean(v).alias(f"m_{v}") for v in values), *(dev(v).alias(f"s_{v}") for v in values)).first()
    g = df.groupBy(group).agg(F.count("*").alias("n"), *(mean(v).alias(f"m_{v}") for v in values), *(dev(v).alias(f"s_{v}") for v in values)).filter(F.col("n") >= least)
    lit = lambda x: F.lit(x).cast("double")
    cols = [c for v in values for c in (half_even(F.col(f"m_{v}"), 2).alias(f"mean_{v}"), half_even(F.col(f"s_{v}"), 2).alias(f"std_{v}"), (F.abs(F.col(f"m_{v}") - lit(whole[f"m_{v}"])) > lit(whole[f"s_{v}"])).alias(f"{v.split('_')[0]}_flag"))]
    return g.select(group, "n", *cols)


def result_errors(runs: DataFrame) -> Column:
    """What is wrong with a result, as texts: sums, ranges and labels of both sets of shares, the confidence; empty if nothing is."""
    checks = []
    for p in ("think", "feel"):
        shares = [F.col(f"{p}_{k}") for k in "rcd"]
        gone = F.greatest(*(s.isNull().cast("int") for s in shares)) == 1
        checks += [F.when(gone, f"{p}: missing"), F.when(~gone & (F.abs(shares[0] + shares[1] + shares[2] - 100) > 2), f"{p}: sum"), F.when(~gone & ~(_within(f"{p}_r") & _within(f"{p}_c") & _within(f"{p}_d")), f"{p}: range"), F.when(~F.coalesce(F.col(f"dominant_{p}").isin(*LABELS), F.lit(False)), f"dominant_{p}: label")]
    checks.append(F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence: range"))
    return F.array_compact(F.array(*checks))


_ERRORS = ", ".join(x for p in ("think", "feel") for x in (f"CASE WHEN {p}_r IS NULL OR {p}_c IS NULL OR {p}_d IS NULL THEN '{p}: missing' END", f"CASE WHEN abs({p}_r + {p}_c + {p}_d - 100) > 2 THEN '{p}: sum' END", f"CASE WHEN NOT ({p}_r BETWEEN 0 AND 100 AND {p}_c BETWEEN 0 AND 100 AND {p}_d BETWEEN 0 AND 100) THEN '{p}: range' END", f"CASE WHEN NOT coalesce(dominant_{p} IN ('resonate', 'contradict', 'diverge'), false) THEN 'dominant_{p}: label' END"))


@query("aj12_result_errors", f"WITH e AS (SELECT run_id, concat_ws('; ', {_ERRORS}, CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence: range' END) AS errors FROM compat_runs) SELECT * FROM e WHERE errors <> ''")
def aj12_result_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AJ12, AJ13, UF13: the results that break a rule, and which."""
    r = table(spark, sf_dir, "compat_runs")
    return r.select("run_id", F.array_join(result_errors(r), "; ").alias("errors")).filter("errors <> ''")

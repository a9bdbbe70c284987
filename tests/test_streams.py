"""Streams over several batches: state, resuming, refits and alerts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators.bradley_terry import counted, per_user_fit, weighted
from marginalia.streaming.feedback import Feedback
from marginalia.streaming.runs import last_n_stats, new_folder, rate_limited, run_available, run_new_days, stream_folder, sustained, to_table


def files(spark, rows, schema, name, parts=3):
    """The rows in as many files, in order."""
    folder = new_folder(spark, name)
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_last_observations_over_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randint(0, 99)), k * 1000, k) for k in range(300)]
    rng.shuffle(rows)
    schema = "label string, value double, us long, id long"
    folder = files(spark, rows, schema, "obs")
    s = stream_folder(spark, folder, schema, 1).withColumn("ts", F.timestamp_micros("us"))
    got = {r.label: r for r in last_n_stats(s, "label", "value", "ts", "id", n=20).collect()}
    for k in "ab":
        v = sorted(x[1] for x in sorted((r for r in rows if r[0] == k), key=lambda r: -r[2])[:20])
        assert (got[k].n, got[k].mean, got[k].p95) == (20, pytest.approx(sum(v) / 20), v[int(0.95 * 20)])


def test_update_mode_keeps_the_last_count(spark):
    rows = [("a",)] * 5 + [("b",)] * 2 + [("a",)] * 4
    folder = files(spark, rows, "k string", "keys")
    out = to_table(stream_folder(spark, folder, "k string", 1).groupBy("k").agg(F.count("*").alias("n")), "update", ["k"])
    assert {tuple(r) for r in out.collect()} == {("a", 9), ("b", 2)}


def test_rate_limit_holds_over_batches(spark):
    times = [0, 5, 9, 10, 12, 21, 22, 30, 33, 47]
    folder = files(spark, [("x", t) for t in times] + [("y", 3)], "label string, at long", "alerts", 4)
    got = sorted((r.label, r.alert_us) for r in to_table(rate_limited(stream_folder(spark, folder, "label string, at long", 1), "label", "at", 10)).collect())
    assert got == [("x", 0), ("x", 10), ("x", 21), ("x", 33), ("x", 47), ("y", 3)]


def test_levels_of_sustained_means(spark):
    means = spark.createDataFrame([("s", k, v) for k, v in enumerate([1.0, 9.0, 9.0, 1.0, 9.0, 9.0, 9.0, 9.0, 1.0])], "label string, at_us long, mean double")
    got = {tuple(r) for r in sustained(means, {"warning": (5.0, 600), "critical": (5.0, 900)}, 300).collect()}
    assert got == {("s", "warning", 1, 2), ("s", "warning", 4, 4), ("s", "critical", 4, 4)}


def test_days_are_done_once(spark):
    folder = new_folder(spark, "days")
    df = lambda *d: spark.createDataFrame([(x, k) for k, x in enumerate(d)], "day string, n int")
    assert run_new_days(df("2025-01-01", "2025-01-02"), "day", folder) == ["2025-01-01", "2025-01-02"]
    assert run_new_days(df("2025-01-02", "2025-01-03"), "day", folder) == ["2025-01-03"]
    assert run_new_days(df("2025-01-01"), "day", folder) == []
    assert spark.read.parquet(folder).count() == 3


def test_feedback_refits_as_all_votes_would(spark):
    """The strengths after several batches, some votes delivered twice and one batch run again, are those of one fit over all votes."""
    rng = random.Random(3)
    rows = []
    for k in range(120):
        a, b = rng.sample(range(6), 2)
        rows.append((f"c{k}", rng.choice(["u", "v", "w"]), a, b, None))
    rows += rows[:15]
    schema = Feedback.VOTES
    f = Feedback(spark, new_folder(spark, "feedback"))
    run_available(stream_folder(spark, files(spark, rows, schema, "votes"), schema, 1), "append", f.append)
    f.append(spark.createDataFrame(rows[:45], schema), 0)
    assert f.votes().count() == 120
    want = {(r.user_id, r.run_id): r.bt_score for r in per_user_fit(weighted(counted(spark.createDataFrame(rows[:120], schema)), None, [])).collect()}
    got = {(r.user_id, r.run_id): r.bt_score for r in f.strengths().collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1.1e-6) for k in got)

"""Queries of the continuous side: bounded streaming runs and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from marginalia.operators.records import Pusher
from marginalia.plans.ranking_queries import number
from marginalia.plans.registry import query, with_once
from marginalia.streaming.feedback import Feedback
from marginalia.streaming.runs import breaches, last_n_stats, new_folder, rate_limited, run_available, run_new_days, run_periodic, stream_folder, stream_table, sustained, to_table
from marginalia.tables import table

VOTES = with_once("votes")
NUMBER = "TRY_CAST(TRY_CAST(trim({0}) AS DOUBLE) AS BIGINT)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("sm01_daily", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def sm01_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM01, SM07: counts by day as a stream keeps them; days more than 60 days behind the latest event leave the state."""
    s = stream_table(spark, sf_dir, "events").withWatermark("ts", "60 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return to_table(s.select(F.to_date("w.start").cast("string").alias("day"), "event_type", "n"), "update", ["day", "event_type"])


_DAY = "2024-01-16"


@query("sm01_new_days", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN ts < TIMESTAMP '{_DAY} 00:00:00' THEN 1 ELSE 2 END AS run_no, count(*) AS n FROM events GROUP BY 1, 2")
def sm01_new_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM01: two daily runs, the second over all events: it works on the days that the first hasn't done, and only on those."""
    folder = new_folder(spark, "days")
    e = events(spark, sf_dir).select("event_id", F.to_date("ts").cast("string").alias("day"))
    run_new_days(e.filter(F.col("day") < _DAY).withColumn("run_no", F.lit(1)), "day", folder)
    new = run_new_days(e.withColumn("run_no", F.lit(2)), "day", folder)
    done = spark.read.schema("event_id long, run_no int, day string").parquet(folder) if new or e.limit(1).count() else e.limit(0).withColumn("run_no", F.lit(0))
    return done.groupBy("day", "run_no").agg(F.count("*").alias("n"))


@query("sm02_triggered", f"{with_once('notes')}, d AS (SELECT book_id, passage_id, count(DISTINCT user_id) AS n FROM notes WHERE book_id IS NOT NULL AND passage_id IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2) SELECT m.interpretation_id, coalesce(d.n - 1, 0) AS partners FROM notes m LEFT JOIN d ON m.book_id = d.book_id AND m.passage_id = d.passage_id WHERE m.user_id IS NOT NULL")
def sm02_triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM02: every new text starts its own work: a row in the queue with the partners that it is to be matched with, counted among the texts known."""
    known = table(spark, sf_dir, "interpretations").select("book_id", "passage_id", "user_id").dropna().distinct().groupBy("book_id", "passage_id").agg(F.count("*").alias("n"))
    s = stream_table(spark, sf_dir, "interpretations").filter("user_id IS NOT NULL").select("interpretation_id", "book_id", "passage_id", "ingested_at")
    queue = to_table(s.join(known, ["book_id", "passage_id"], "left").select("interpretation_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("partners")))
    return queue.groupBy("interpretation_id").agg(F.max("partners").alias("partners"))


@query("sm04_dedup", "SELECT comparison_id, max(user_id) AS user_id FROM comparisons GROUP BY comparison_id")
def sm04_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM04: a record delivered again within the watermark is dropped on the way in."""
    s = stream_table(spark, sf_dir, "comparisons").withWatermark("ingested_at", "60 days").dropDuplicatesWithinWatermark(["comparison_id"])
    return to_table(s.select("comparison_id", "user_id"))


@query("sm05_resumed", "SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS batch, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def sm05_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM05: a second run with the first one's checkpoint goes on where that ended: it sees only the files that came since."""
    folder, checkpoint, sink = (new_folder(spark, n) for n in ("in", "checkpoint", "sink"))
    e = events(spark, sf_dir).select("event_id", "ts")
    seen: set[int] = set()

    def each(batch: DataFrame, number_: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number_}")
        seen.add(number_)

    for part in (e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0")):
        part.write.mode("append").parquet(folder)
        run_available(stream_folder(spark, folder, e.schema), "append", each, checkpoint)
    out = spark.read.schema("event_id long, ts timestamp, batch int").option("basePath", sink).parquet(sink) if seen else e.limit(0).withColumn("batch", F.lit(0))
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("sm06_joined", f"SELECT c.dominant_think, count(*) AS n FROM comparisons v JOIN compat_runs c ON {NUMBER.format('v.winner_run_id')} = c.run_id GROUP BY 1")
def sm06_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM06: a stream with a table of what is known; the state is a row per label."""
    runs = table(spark, sf_dir, "compat_runs").select("run_id", "dominant_think")
    s = stream_table(spark, sf_dir, "comparisons").withColumn("run_id", number("winner_run_id")).join(runs, "run_id").groupBy("dominant_think").agg(F.count("*").alias("n"))
    return to_table(s, "update", ["dominant_think"])


def _votes(spark: SparkSession, sf_dir: str, files: str | None = None) -> DataFrame:
    c = stream_table(spark, sf_dir, "comparisons") if files is None else stream_folder(spark, files, table(spark, sf_dir, "comparisons").schema, 1)
    return c.select("comparison_id", "user_id", number("winner_run_id").alias("w"), number("loser_run_id").alias("l"), "ingested_at")


@query("sm03_feedback", f"SELECT {NUMBER.format('winner_run_id')} AS run_id, count(DISTINCT comparison_id) AS wins FROM comparisons WHERE TRY_CAST(trim(winner_run_id) AS DOUBLE) IS NOT NULL GROUP BY 1")
def sm03_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM03, SNK05: each batch of votes is appended; wins are counted over votes read once each."""
    f = Feedback(spark, new_folder(spark, "feedback"), refit=False)
    run_available(_votes(spark, sf_dir), "append", f.append)
    return f.votes().filter("w IS NOT NULL AND comparison_id IS NOT NULL").groupBy(F.col("w").alias("run_id")).agg(F.count("*").alias("wins"))


@query("sm03_refit", f"{VOTES}, v AS (SELECT user_id, w, l FROM votes WHERE w <> l AND user_id IS NOT NULL), c AS (SELECT user_id, count(*) AS n_comparisons FROM v GROUP BY 1 HAVING count(*) >= 5), i AS (SELECT user_id, w AS item FROM v UNION SELECT user_id, l FROM v) SELECT c.user_id, n_comparisons, (SELECT count(*) FROM i WHERE i.user_id = c.user_id) AS items, CAST(1 AS DOUBLE) AS strength FROM c")
def sm03_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM03: votes in two batches, after each the strengths of its users fitted again; the last fit of a user is that of all votes."""
    files = new_folder(spark, "votes")
    c = table(spark, sf_dir, "comparisons")
    half = F.pmod(F.xxhash64("comparison_id"), F.lit(2))
    for k in (0, 1):
        c.filter(half == k).coalesce(1).write.mode("append").parquet(files)
    f = Feedback(spark, new_folder(spark, "feedback"))
    run_available(_votes(spark, sf_dir, files), "append", f.append)
    return f.strengths().groupBy("user_id").agg(F.first("n_comparisons").alias("n_comparisons"), F.count("*").alias("items"), (F.rint(F.sum("bt_score") * 100) / 100).alias("strength"))


@query("sm09_flushed", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def sm09_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM09, SNK23: counters of a stream that runs on a timer, pushed when the last push is long enough ago, and once more at the end."""
    folder, held, sent = new_folder(spark, "pushed"), [], []

    def push(df: DataFrame) -> None:
        sent.append(len(sent))
        df.write.parquet(f"{folder}/{sent[-1]}")

    pusher = Pusher(push, spacing=0.2)
    s = stream_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))

    def each(batch: DataFrame, number_: int) -> None:
        held[:] = [batch.sparkSession.createDataFrame(batch.collect(), batch.schema)]  # a row per label
        pusher(held[0])

    run_periodic(s, "complete", each, 0.2)
    if not held:
        return spark.createDataFrame([], "label string, n long")
    push(held[0])
    return spark.read.parquet(f"{folder}/{sent[-1]}")


@query("sm10_sustained", """WITH w AS (SELECT event_type AS label, time_bucket(INTERVAL 6 HOURS, ts) AS tick, avg(value) AS mean FROM events GROUP BY 1, 2), b AS (SELECT label, tick, row_number() OVER (PARTITION BY label ORDER BY tick) - row_number() OVER (PARTITION BY label, mean > 50 ORDER BY tick) AS island, mean > 50 AS breach FROM w)
    SELECT label, CAST(epoch_us(min(tick)) AS BIGINT) AS first_us, count(*) AS windows FROM b WHERE breach GROUP BY label, island HAVING count(*) >= 2""")
def sm10_sustained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM10: windows in a row whose mean exceeds the threshold. The islands are found over windows, not events."""
    b = breaches(events(spark, sf_dir), 50.0, "6 hours")
    island = F.row_number().over(W.partitionBy("label").orderBy("at")) - F.row_number().over(W.partitionBy("label", "breach").orderBy("at"))
    return b.withColumn("island", island).filter("breach").groupBy("label", "island").agg(F.unix_micros(F.min("at")).alias("first_us"), F.count("*").alias("windows")).filter("windows >= 2").select("label", "first_us", "windows")


_LEVELS = {"warning": (48.0, 7200), "error": (50.0, 10_800), "critical": (52.0, 21_600)}


@query("sm10_alerts", "WITH s AS (SELECT event_type AS label, user_id % 10 AS series, time_bucket(INTERVAL 1 HOUR, ts) AS tick, sum(value) / count(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3), w AS (SELECT label, CAST(epoch_us(tick) AS BIGINT) AS t, avg(mean) AS mean FROM s GROUP BY 1, 2), l AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({t} AS DOUBLE), {s // 3600})" for n, (t, s) in _LEVELS.items()) + ") v(level, threshold, least)), b AS (SELECT label, level, least, t, mean > threshold AS breach, row_number() OVER (PARTITION BY label, level ORDER BY t) - row_number() OVER (PARTITION BY label, level, mean > threshold ORDER BY t) AS island FROM w, l) SELECT label, level, min(t) AS first_us, count(*) AS windows FROM b WHERE breach GROUP BY label, level, least, island HAVING count(*) >= least")
def sm10_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM10: means of each series over aligned windows, kept by a stream; their mean over the series; the times over which it stays above each of three levels long enough."""
    e = stream_table(spark, sf_dir, "events").filter("value IS NOT NULL").withWatermark("ts", "60 days")
    s = e.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("label"), (F.col("user_id") % 10).alias("series")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    kept = to_table(s.select(F.unix_micros("w.start").alias("at_us"), "label", "series", "total", "n"), "update", ["at_us", "label", "series"])
    means = kept.groupBy("label", "at_us").agg(F.avg(F.col("total") / F.col("n")).alias("mean"))
    return sustained(means, _LEVELS, 3600)


@query("sm08_last_1000", "WITH r AS (SELECT event_type AS label, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value IS NOT NULL), l AS (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY value) AS i, count(*) OVER (PARTITION BY label) AS n FROM r WHERE k <= 1000) SELECT label, CAST(max(n) AS INTEGER) AS n, round_even(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 / max(n), 4) AS mean, max(CASE WHEN i = CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1 THEN value END) AS p95 FROM l GROUP BY label")
def sm08_last_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM08, WN10: the last thousand observations of each label, kept as a stream's state."""
    out = last_n_stats(stream_table(spark, sf_dir, "events"), "event_type", "value", "ts", "event_id")
    return out.select("label", "n", (F.rint(F.col("mean") * 1e4) / 1e4).alias("mean"), "p95")


@query("sm12_drift", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, n, n - lag(n) OVER (ORDER BY day) AS change FROM d")
def sm12_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM12: a run's gauge against the run before; the window is over days."""
    d = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.select(F.col("day").cast("string").alias("day"), "n", (F.col("n") - F.lag("n").over(W.orderBy("day"))).alias("change"))


@query("sm_tumbling", "SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def sm_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly windows of a stream with a watermark."""
    s = stream_table(spark, sf_dir, "events").withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return to_table(s.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n"), "update", ["start_us", "event_type"])


@query("sm_sliding", "WITH o AS (SELECT unnest([0, 1]) AS k), e AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS s, value FROM events, o) SELECT CAST(epoch_us(s) AS BIGINT) AS start_us, count(*) AS n FROM e GROUP BY 1")
def sm_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly windows every half hour."""
    s = stream_table(spark, sf_dir, "events").withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return to_table(s.select(F.unix_micros("w.start").alias("start_us"), "n"), "update", ["start_us"])


@query("sm_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM s GROUP BY user_id, k")
def sm_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, a batch: sessions of a user, ended by six hours without an event."""
    return events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


_BREACHES = "w AS (SELECT event_type AS label, CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS t, avg(value) AS mean FROM events GROUP BY 1, 2), b AS (SELECT label, t FROM w WHERE mean > 50)"
_LIMITED = f"WITH RECURSIVE {_BREACHES}, r AS (SELECT label, min(t) AS t FROM b GROUP BY 1 UNION ALL SELECT r.label, min(b.t) AS t FROM r JOIN b ON b.label = r.label AND b.t >= r.t + 86400000000 GROUP BY r.label) SELECT label, t AS alert_us FROM r"


@query("sm11_rate_limit", _LIMITED)
def sm11_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM11: of the windows in breach, those that alert when at most one alert a day is let through; a stream whose state is the last alert of each label."""
    b = breaches(events(spark, sf_dir), 50.0, "1 hour").filter("breach").select("label", F.unix_micros("at").alias("at_us"))
    folder = new_folder(spark, "breaches")
    b.coalesce(1).write.parquet(folder)
    return to_table(rate_limited(stream_folder(spark, folder, "label string, at_us long"), "label", "at_us", 86_400_000_000))

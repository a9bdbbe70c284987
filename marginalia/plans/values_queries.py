"""Queries of values: maps, JSON, lists, times, safe ratios and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import text as X
from marginalia.functions.rounding import half_even, ratio
from marginalia.operators.dedup import latest
from marginalia.plans.registry import query, with_once
from marginalia.plans.text_queries import each_once
from marginalia.tables import table


@query("src10_daily_notes", f"{with_once('notes')} SELECT interpretation_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, CAST(len(regexp_extract_all(interpretation, '\\S+')) AS INTEGER) AS word_count FROM notes WHERE NOT is_deleted AND trim(interpretation) <> ''")
def src10_daily_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10, PRJ13: live texts with their day and length."""
    t = table(spark, sf_dir, "interpretations").filter(~F.col("is_deleted") & (F.trim("interpretation") != ""))
    return each_once(t.select("interpretation_id", "ingested_at", F.to_date("created_at").cast("string").alias("day"), X.word_count(F.col("interpretation")).alias("word_count")))


@query("aj04_maps", "SELECT run_id, think_c AS contradict, think_r + think_d AS others, CAST(3 AS INTEGER) AS entries FROM compat_runs")
def aj04_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AJ04: entries to a map and values by key."""
    m = F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"think_{k}").alias("v")) for k in "rcd")))
    return table(spark, sf_dir, "compat_runs").withColumn("m", m).select("run_id", F.col("m")["c"].alias("contradict"), (F.col("m")["r"] + F.col("m")["d"]).alias("others"), F.size("m").alias("entries"))


@query("aj06_mixed_lists", "SELECT run_id, concat('c', CAST(think_r AS VARCHAR), ',c', CAST(think_c AS VARCHAR)) AS ids, CAST(1 AS INTEGER) AS diverging FROM compat_runs")
def aj06_mixed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AJ06, AJ03: lists whose items are ids or objects with an id, as the two generations write them."""
    raw = F.concat(F.lit('["c'), F.col("think_r").cast("string"), F.lit('", {"id": "c'), F.col("think_c").cast("string"), F.lit('", "divergence": true}]'))
    items = F.from_json(raw, "array<string>")
    ids = F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.id"), x))
    return table(spark, sf_dir, "compat_runs").select("run_id", F.array_join(ids, ",").alias("ids"), F.size(F.filter(items, lambda x: F.get_json_object(x, "$.divergence") == "true")).alias("diverging"))


@query("aj10_scorer_input", "SELECT run_id, concat('A: {\"user\":\"', user_a, '\",\"R\":', CAST(think_r AS VARCHAR), '} B: {\"user\":\"', user_b, '\",\"R\":', CAST(feel_r AS VARCHAR), '}') AS body FROM compat_runs")
def aj10_scorer_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AJ10: two documents as the body of a request."""
    doc = lambda u, r: F.to_json(F.struct(F.col(u).alias("user"), F.col(r).alias("R")))
    return table(spark, sf_dir, "compat_runs").select("run_id", F.concat(F.lit("A: "), doc("user_a", "think_r"), F.lit(" B: "), doc("user_b", "feel_r")).alias("body"))


@query("aj11_columns_of_list", "SELECT run_id, dominant_think AS style_1, dominant_feel AS style_2, nullif(verdict, '') AS style_3, CAST(NULL AS VARCHAR) AS style_4 FROM compat_runs")
def aj11_columns_of_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AJ11, AJ07: a delimited list into a fixed number of columns."""
    parts = F.split(F.concat_ws("|", "dominant_think", "dominant_feel", F.nullif("verdict", F.lit(""))), r"\|")
    return table(spark, sf_dir, "compat_runs").select("run_id", *(F.get(parts, F.lit(k)).alias(f"style_{k + 1}") for k in range(4)))


@query("dt02_times", "SELECT comparison_id, strftime(logged_at, '%Y-%m-%dT%H:%M:%S') AS logged, CAST(epoch_us(ingested_at) - epoch_us(logged_at) AS DOUBLE) / 1000000 AS delay_s, ingested_at > logged_at AS later, CAST(date_diff('day', CAST(logged_at AS DATE), CAST(ingested_at AS DATE)) AS INTEGER) AS days FROM comparisons")
def dt02_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT02-DT05: forms of times, differences and comparisons on parsed values."""
    a, b = F.col("logged_at"), F.col("ingested_at")
    return table(spark, sf_dir, "comparisons").select("comparison_id", F.date_format(a, "yyyy-MM-dd'T'HH:mm:ss").alias("logged"), ((F.unix_micros(b) - F.unix_micros(a)).cast("double") / 1_000_000).alias("delay_s"), (b > a).alias("later"), F.date_diff(F.to_date(b), F.to_date(a)).alias("days"))


@query("dt06_spread_times", "SELECT run_id, strftime(TIMESTAMP '2025-01-01 00:00:00' + to_seconds(CAST(concat('0x', substr(md5(CAST(run_id AS VARCHAR)), 1, 8)) AS BIGINT) % 31536000), '%Y-%m-%dT%H:%M:%S') AS at FROM compat_runs")
def dt06_spread_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT06: a time of 2025 for every run, spread by a hash of its id, so that it is the same each time."""
    second = F.conv(F.substring(F.md5(F.col("run_id").cast("string")), 1, 8), 16, 10).cast("long") % (365 * 86400)
    return table(spark, sf_dir, "compat_runs").select("run_id", F.date_format(F.timestamp_seconds(F.lit(1735689600) + second), "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("flt19_routes", "SELECT CASE WHEN verdict IS NULL OR verdict = '' THEN 'discard' ELSE 'display' END AS route, count(*) AS n FROM compat_runs GROUP BY 1")
def flt19_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT19: results with and without an outcome."""
    return table(spark, sf_dir, "compat_runs").groupBy(F.when(F.coalesce("verdict", F.lit("")) == "", "discard").otherwise("display").alias("route")).agg(F.count("*").alias("n"))


@query("flt27_own_threads", f"{with_once('messages')}, t AS (SELECT thread_id, count(*) AS n FROM messages GROUP BY 1), s AS (SELECT DISTINCT sender_id, thread_id FROM messages) SELECT sender_id, count(*) AS threads, CAST(sum(n) AS BIGINT) AS messages FROM s JOIN t ON s.thread_id = t.thread_id GROUP BY 1")
def flt27_own_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT27: of every reader the threads that it may read, being a member, and the messages in them; counted, not listed per member."""
    m = latest(table(spark, sf_dir, "whisper_messages").select("message_id", "thread_id", "sender_id", "ingested_at"), ["message_id"], "ingested_at")
    n = m.groupBy("thread_id").agg(F.count("*").alias("n"))
    return m.select("sender_id", "thread_id").distinct().join(n, "thread_id").groupBy("sender_id").agg(F.count("*").alias("threads"), F.sum("n").alias("messages"))


@query("ma06_answers", "WITH q AS (SELECT run_id, CAST(think_r % 2 = 1 AS INTEGER) AS a, CAST(think_c % 2 = 1 AS INTEGER) AS b, CAST(think_d % 2 = 1 AS INTEGER) AS c, CAST(feel_r % 2 = 1 AS INTEGER) AS d, CAST(feel_c % 2 = 1 AS INTEGER) AS e FROM compat_runs) SELECT run_id, CAST(a + b + c + (1 - d) + e AS DOUBLE) / 5 AS r, CAST(b + c + d + e AS DOUBLE) / 4 AS offline_c FROM q")
def ma06_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA06, MA07: agreement of five yes-or-no answers with what is expected of them, the fourth reversed."""
    odd = F.array(*((F.col(c) % 2 == 1) for c in ("think_r", "think_c", "think_d", "feel_r", "feel_c")))
    want = F.array(*map(F.lit, (True, True, True, False, True)))
    hits = F.aggregate(F.zip_with(odd, want, lambda q, w: (q == w).cast("int")), F.lit(0), lambda s, x: s + x)
    last = F.aggregate(F.slice(odd, 2, 4), F.lit(0), lambda s, x: s + x.cast("int"))
    return table(spark, sf_dir, "compat_runs").select("run_id", (hits.cast("double") / 5).alias("r"), (last.cast("double") / 4).alias("offline_c"))


@query("ma12_ratios", "SELECT run_id, round_even(CAST(think_c AS DOUBLE) / nullif(think_r, 0), 6) AS c_of_r, round_even(CAST(feel_c AS DOUBLE) / greatest(feel_r, 1), 6) AS guarded FROM compat_runs")
def ma12_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA12: ratios that a zero can't break."""
    return table(spark, sf_dir, "compat_runs").select("run_id", half_even(ratio(F.col("think_c"), F.col("think_r")), 6).alias("c_of_r"), half_even(ratio(F.col("feel_c"), F.greatest("feel_r", F.lit(1))), 6).alias("guarded"))


@query("prj07_two_outputs", f"{with_once('notes')} SELECT 'notes' AS output, count(*) AS n FROM notes UNION ALL SELECT 'passages', count(DISTINCT passage_id) FROM notes")
def prj07_two_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ07: two outputs of one pass."""
    m = latest(table(spark, sf_dir, "interpretations"), ["interpretation_id"], "ingested_at").agg(F.count("*").alias("notes"), F.count_distinct("passage_id").alias("passages"))
    return m.unpivot([], ["notes", "passages"], "output", "n")


@query("st11_distinct_in_order", "WITH w AS (SELECT book_id, word, min(i) AS i FROM (SELECT book_id, unnest(string_split(lower(title), ' ')) AS word, generate_subscripts(string_split(lower(title), ' '), 1) AS i FROM books) u GROUP BY 1, 2) SELECT book_id, string_agg(word, ' ' ORDER BY i) AS words FROM w GROUP BY 1")
def st11_distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11: a title's words without repeats, in their order."""
    return table(spark, sf_dir, "books").filter(F.col("title").isNotNull()).select("book_id", F.array_join(F.array_distinct(F.split(F.lower("title"), " ")), " ").alias("words"))

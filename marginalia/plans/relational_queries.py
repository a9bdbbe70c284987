"""Queries of table changes, projections, set operations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from marginalia.operators.dedup import first_seen, latest
from marginalia.operators.tables_dml import cascade, delete, insert_absent, update, upsert, with_columns_of
from marginalia.plans.profiling_queries import readers
from marginalia.plans.registry import query, with_once
from marginalia.plans.text_queries import notes
from marginalia.tables import table

NOTES = with_once("notes")
#: Changes made to the runs: confidences of runs with an odd sum of ids' last digits, and a run that isn't there.
_CHANGES = "SELECT run_id, user_a, user_b, least(confidence + 0.05, 0.95) AS confidence FROM compat_runs WHERE run_id % 3 = 0 UNION ALL SELECT CAST(1 AS BIGINT), 'a', 'b', CAST(0.5 AS DOUBLE)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "compat_runs").select("run_id", "user_a", "user_b", "confidence")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _runs(spark, sf_dir).filter(F.col("run_id") % 3 == 0).withColumn("confidence", F.least(F.col("confidence") + 0.05, F.lit(0.95)))
    return some.unionByName(spark.createDataFrame([(1, "a", "b", 0.5)], "run_id long, user_a string, user_b string, confidence double"))


@query("snk07_upsert", f"WITH s AS ({_CHANGES}) SELECT run_id, user_a, user_b, confidence FROM s UNION ALL SELECT run_id, user_a, user_b, confidence FROM compat_runs WHERE run_id NOT IN (SELECT run_id FROM s)")
def snk07_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK07, SNK08, SNK16, SNK21, T11: the next version of the runs after a merge."""
    return upsert(_runs(spark, sf_dir), _changes(spark, sf_dir), ["run_id"])


@query("snk12_insert_absent", f"WITH s AS ({_CHANGES}) SELECT run_id, user_a, user_b, confidence FROM compat_runs UNION ALL SELECT run_id, user_a, user_b, confidence FROM s WHERE run_id NOT IN (SELECT run_id FROM compat_runs)")
def snk12_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK12, SNK27, JN17."""
    return insert_absent(_runs(spark, sf_dir), _changes(spark, sf_dir), ["run_id"])


@query("snk10_delete", f"WITH s AS ({_CHANGES}) SELECT run_id, user_a, user_b, confidence FROM compat_runs WHERE run_id NOT IN (SELECT run_id FROM s)")
def snk10_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10, SNK11."""
    return delete(_runs(spark, sf_dir), _changes(spark, sf_dir), ["run_id"])


@query("snk13_update", "SELECT message_id, ingested_at IS NOT NULL AS stored, CASE WHEN read_at IS NULL AND msg_type = 'whisper' THEN 'marked' WHEN read_at IS NULL THEN 'unread' ELSE 'read' END AS state FROM whisper_messages")
def snk13_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK13: a conditional change."""
    m = table(spark, sf_dir, "whisper_messages").withColumn("state", F.when(F.col("read_at").isNull(), "unread").otherwise("read"))
    return update(m, (F.col("state") == "unread") & (F.col("msg_type") == "whisper"), {"state": F.lit("marked")}).select("message_id", F.col("ingested_at").isNotNull().alias("stored"), "state")


@query("snk14_soft_delete", f"{NOTES} SELECT interpretation_id, is_deleted OR interpretation IS NULL OR trim(interpretation) = '' AS is_deleted FROM notes")
def snk14_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK14: a flag instead of a removal."""
    gone = F.col("interpretation").isNull() | (F.trim("interpretation") == "")
    return update(notes(spark, sf_dir), gone, {"is_deleted": F.lit(True)}).select("interpretation_id", "is_deleted")


@query("snk15_cascade", "WITH d AS (SELECT user_id FROM users WHERE consent_given = false) SELECT 'interpretations' AS tbl, count(*) AS n FROM interpretations WHERE user_id NOT IN (SELECT user_id FROM d) UNION ALL SELECT 'whisper_messages', count(*) FROM whisper_messages WHERE sender_id NOT IN (SELECT user_id FROM d) UNION ALL SELECT 'compat_runs', count(*) FROM compat_runs WHERE user_a NOT IN (SELECT user_id FROM d) AND user_b NOT IN (SELECT user_id FROM d)")
def snk15_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK15: what is left of each table when the users without consent are erased."""
    doomed = table(spark, sf_dir, "users").filter(~F.col("consent_given"))
    names = {"interpretations": ["user_id"], "whisper_messages": ["sender_id"], "compat_runs": ["user_a", "user_b"]}
    left = cascade({n: table(spark, sf_dir, n).select(*c) for n, c in names.items()}, doomed, names, "user_id")
    out = None
    for n, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("snk18_evolved", "SELECT book_id, title, author, CAST(NULL AS VARCHAR) AS publisher, CAST(NULL AS INTEGER) AS n_pages FROM books")
def snk18_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK18: columns that a new schema adds."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("book_id string, title string, author string, publisher string, n_pages int")
    return with_columns_of(table(spark, sf_dir, "books").select("book_id", "title", "author"), schema)


@query("prj02_cast_list", "SELECT CAST(run_id AS VARCHAR) AS run_key, upper(substr(dominant_think, 1, 1)) AS think, coalesce(nullif(verdict, ''), 'none') AS verdict, CAST(floor(confidence * 100) AS INTEGER) AS pct FROM compat_runs")
def prj02_cast_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ01-PRJ03, PRJ08, PRJ14, T12: casts, aliases and defaults."""
    return table(spark, sf_dir, "compat_runs").select(F.col("run_id").cast("string").alias("run_key"), F.upper(F.substring("dominant_think", 1, 1)).alias("think"), F.coalesce(F.nullif("verdict", F.lit("")), F.lit("none")).alias("verdict"), F.floor(F.col("confidence") * 100).cast("int").alias("pct"))


@query("prj09_anchor_side", "SELECT run_id, greatest(user_a, user_b) AS anchor, least(user_a, user_b) AS other, CASE WHEN user_a >= user_b THEN 'kept' ELSE 'flipped' END AS side FROM compat_runs")
def prj09_anchor_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ09, PRJ10, FLT07: the pair as one of its sides sees it."""
    return table(spark, sf_dir, "compat_runs").select("run_id", F.greatest("user_a", "user_b").alias("anchor"), F.least("user_a", "user_b").alias("other"), F.when(F.col("user_a") >= F.col("user_b"), "kept").otherwise("flipped").alias("side"))


@query("prj15_present_values", f"{with_once('readers')} SELECT user_id, concat_ws(';', CASE WHEN trim(bio) <> '' THEN 'bio' END, CASE WHEN trim(gender) <> '' THEN 'gender' END, CASE WHEN last_read_book_id IS NOT NULL THEN 'book' END, CASE WHEN reading_state IS NOT NULL THEN 'state' END) AS present FROM readers")
def prj15_present_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ15, AJ07, ST06: optional columns as a list of those that hold something."""
    has = F.array_compact(F.array(F.when(F.trim("bio") != "", "bio"), F.when(F.trim("gender") != "", "gender"), F.when(F.col("last_read_book_id").isNotNull(), "book"), F.when(F.col("reading_state").isNotNull(), "state")))
    return readers(spark, sf_dir).select("user_id", F.array_join(has, ";").alias("present"))


@query("prj17_unpivot", "SELECT run_id, 'think_r' AS share, think_r AS value FROM compat_runs UNION ALL SELECT run_id, 'think_c', think_c FROM compat_runs UNION ALL SELECT run_id, 'think_d', think_d FROM compat_runs")
def prj17_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ17: columns to rows."""
    return table(spark, sf_dir, "compat_runs").unpivot(["run_id"], ["think_r", "think_c", "think_d"], "share", "value")


@query("flt01_live_range", "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM interpretations WHERE NOT is_deleted AND trim(interpretation) <> '' AND created_at >= TIMESTAMPTZ '2024-03-01 00:00:00+00' AND created_at < TIMESTAMPTZ '2024-06-01 00:00:00+00' GROUP BY 1")
def flt01_live_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT01, FLT08, DT01, O1: a range on the column itself, so that it reaches the scan."""
    c = F.col("created_at")
    live = table(spark, sf_dir, "interpretations").filter(~F.col("is_deleted") & (F.trim("interpretation") != "") & (c >= F.lit("2024-03-01").cast("timestamp")) & (c < F.lit("2024-06-01").cast("timestamp")))
    return live.groupBy(F.to_date(c).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("flt04_same_passage", f"{NOTES}, f AS (SELECT passage_id, arg_min(user_id, (created_at, user_id)) AS anchor FROM notes WHERE passage_id IS NOT NULL GROUP BY 1) SELECT n.passage_id, anchor, interpretation_id FROM notes n JOIN f ON n.passage_id = f.passage_id WHERE user_id <> anchor AND NOT is_deleted")
def flt04_same_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT03, FLT04, JN10, JN15: on every passage the live texts of others than its first reader."""
    m = notes(spark, sf_dir).filter(F.col("passage_id").isNotNull()).select("passage_id", "user_id", "interpretation_id", "created_at", "is_deleted")
    first = m.groupBy("passage_id").agg(F.min(F.struct("created_at", "user_id"))["user_id"].alias("anchor"))
    return m.join(first, "passage_id").filter((F.col("user_id") != F.col("anchor")) & ~F.col("is_deleted")).select("passage_id", "anchor", "interpretation_id")


def some(df: DataFrame, **equal: object) -> DataFrame:
    """The rows whose columns have the values given; a value of None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


@query("flt25_optional", "SELECT * FROM (SELECT 'none' AS filters, count(*) AS n FROM compat_runs UNION ALL SELECT 'kind', count(*) FILTER (dominant_think = 'diverge') FROM compat_runs UNION ALL SELECT 'both', count(*) FILTER (dominant_think = 'diverge' AND dominant_feel = 'resonate') FROM compat_runs) x")
def flt25_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT25: the same query with none, one or both of its optional filters."""
    r = table(spark, sf_dir, "compat_runs")
    out = None
    for name, think, feel in (("none", None, None), ("kind", "diverge", None), ("both", "diverge", "resonate")):
        row = some(r, dominant_think=think, dominant_feel=feel).agg(F.count("*").alias("n")).select(F.lit(name).alias("filters"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("jn05_passage_readers", f"{NOTES} SELECT book_id, passage_id, count(DISTINCT user_id) AS readers, count(*) AS texts FROM notes WHERE passage_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT user_id) > 1")
def jn05_passage_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN05, FLT17: passages with more than one reader."""
    return notes(spark, sf_dir).filter(F.col("passage_id").isNotNull()).groupBy("book_id", "passage_id").agg(F.count_distinct("user_id").alias("readers"), F.count("*").alias("texts")).filter("readers > 1")


@query("jn16_linked_books", f"{NOTES} SELECT book_id, title FROM books WHERE book_id IN (SELECT book_id FROM notes WHERE created_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00')")
def jn16_linked_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN16, FLT02, SRC11, SRC12, O5: semi-join instead of a list built on the driver."""
    late = notes(spark, sf_dir).filter(F.col("created_at") >= F.lit("2025-06-01").cast("timestamp"))
    return table(spark, sf_dir, "books").join(late, "book_id", "left_semi").select("book_id", "title")


@query("jn11_lookup", f"{NOTES} SELECT m.interpretation_id, coalesce(b.title, 'Unknown') AS title, coalesce(b.book_lang, 'Unknown') AS book_lang FROM notes m LEFT JOIN books b ON m.book_id = b.book_id")
def jn11_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11, JN24, FLT15, O8: a lookup with defaults; Spark sends the small side by its size."""
    b = table(spark, sf_dir, "books").select("book_id", "title", "book_lang")
    return notes(spark, sf_dir).join(b, "book_id", "left").select("interpretation_id", F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("book_lang", F.lit("Unknown")).alias("book_lang"))


@query("jn12_both_sides", "SELECT c.run_id, a.readername AS name_a, b.readername AS name_b FROM compat_runs c JOIN (SELECT user_id, any_value(readername) AS readername FROM users GROUP BY 1) a ON c.user_a = a.user_id JOIN (SELECT user_id, any_value(readername) AS readername FROM users GROUP BY 1) b ON c.user_b = b.user_id")
def jn12_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12: runs with both readers."""
    u = readers(spark, sf_dir)
    side = lambda s: u.select(F.col("user_id").alias(f"user_{s}"), F.col("readername").alias(f"name_{s}"))
    return table(spark, sf_dir, "compat_runs").join(side("a"), "user_a").join(side("b"), "user_b").select("run_id", "name_a", "name_b")


@query("wn07_first_seen", "SELECT user_id, book_id, interpretation_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, book_id ORDER BY created_at, interpretation_id) AS k FROM interpretations WHERE book_id IS NOT NULL) t WHERE k = 1")
def wn07_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN07: a reader's first note of each book."""
    return first_seen(table(spark, sf_dir, "interpretations").filter(F.col("book_id").isNotNull()), ["user_id", "book_id"], "created_at", ["interpretation_id"]).select("user_id", "book_id", "interpretation_id")


@query("st05_union", "SELECT book_id AS id, 'books' AS origin FROM books UNION ALL SELECT user_id, 'users' FROM users UNION ALL SELECT CAST(run_id AS VARCHAR), 'runs' FROM compat_runs")
def st05_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST05, ST09: bag union of frames."""
    part = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).cast("string").alias("id"), F.lit(n).alias("origin"))
    return part("books", "book_id", "books").unionByName(part("users", "user_id", "users")).unionByName(part("compat_runs", "run_id", "runs"))


@query("st07_unknown_labels", "SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL EXCEPT SELECT DISTINCT lang FROM lang_samples")
def st07_unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST06, ST07: labels that aren't among the known ones."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("label")).dropna().distinct().exceptAll(table(spark, sf_dir, "lang_samples").select("lang").distinct())


@query("sl03_recent_threads", f"{with_once('messages')}, t AS (SELECT thread_id, max(created_at) AS last, max(read_at) AS seen FROM messages GROUP BY thread_id) SELECT thread_id, CAST(epoch_us(last) AS BIGINT) AS last_us FROM t ORDER BY last DESC NULLS LAST, thread_id LIMIT 50")
def sl03_recent_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL02, SL03, O24: a top-k report; only k rows of each task are sent on."""
    m = latest(table(spark, sf_dir, "whisper_messages"), ["message_id"], "ingested_at")
    return m.groupBy("thread_id").agg(F.max("created_at").alias("last")).orderBy(F.desc_nulls_last("last"), "thread_id").limit(50).select("thread_id", F.unix_micros("last").alias("last_us"))


@query("ag36_p95", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, max(CASE WHEN k = CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1 THEN value END) AS p95 FROM r GROUP BY event_type")
def ag36_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG36, WN10, T5: the value at index int(0.95 n), which no interpolation gives.

    Values are counted first, so that a frequent one is a row; the running count goes
    over the distinct values of each type.
    """
    v = table(spark, sf_dir, "events").filter(F.col("value").isNotNull()).groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = W.partitionBy("event_type")
    run = v.withColumn("upto", F.sum("c").over(w.orderBy("value").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = F.floor(F.col("n") * F.lit(0.95)) + 1
    return run.filter((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)).select("event_type", "n", F.col("value").alias("p95"))


@query("ag46_counters", "SELECT event_type, CAST(user_id % 10 AS BIGINT) AS label, count(*) AS n, arg_max(value, (ts, event_id)) AS gauge FROM events GROUP BY 1, 2")
def ag46_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG46, SM07: counters and gauges by labels."""
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("label")).agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id", "value")).alias("x")).select("event_type", "label", "n", F.col("x.value").alias("gauge"))


@query("ag45_book_order", f"{NOTES}, f AS (SELECT user_id, book_id, min(created_at) AS first, count(*) AS n FROM notes WHERE book_id IS NOT NULL GROUP BY 1, 2) SELECT user_id, book_id, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first, book_id) AS INTEGER) AS place FROM f")
def ag45_book_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG45: a reader's books in the order of their first note."""
    f = notes(spark, sf_dir).filter(F.col("book_id").isNotNull()).groupBy("user_id", "book_id").agg(F.min("created_at").alias("first"), F.count("*").alias("n"))
    return f.select("user_id", "book_id", "n", F.row_number().over(W.partitionBy("user_id").orderBy("first", "book_id")).alias("place"))

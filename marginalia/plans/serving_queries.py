"""Queries that serve readers: matches, threads, search, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from marginalia.functions.json_text import merged, model_json
from marginalia.functions.once import evaluated
from marginalia.functions.rounding import half_even
from marginalia.operators.dedup import latest
from marginalia.operators.search import nearest
from marginalia.plans.profiling_queries import readers
from marginalia.plans.ranking_queries import edges
from marginalia.plans.registry import query, with_once
from marginalia.plans.text_queries import notes
from marginalia.tables import table

BOTH = with_once("notes", "readers")
_NAME = "CASE WHEN trim(concat_ws(' ', first_name, last_name)) = '' THEN 'Unknown' ELSE trim(concat_ws(' ', first_name, last_name)) END"


def display_name():
    name = F.trim(F.concat_ws(" ", "first_name", "last_name"))
    return F.when(name == "", "Unknown").otherwise(name)


@query("jn04_matches", f"{with_once('readers')}, e AS (SELECT run_id, user_a AS user_id, user_b AS match_user, confidence FROM compat_runs UNION ALL SELECT run_id, user_b, user_a, confidence FROM compat_runs), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, run_id) AS INTEGER) AS place FROM e) SELECT r.user_id, place, run_id, match_user, coalesce({_NAME}, 'Unknown') AS match_name, confidence FROM r LEFT JOIN readers u ON r.match_user = u.user_id WHERE place <= 50")
def jn04_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN04, SL02, FLT05, FLT06, PRJ11: the fifty surest matches of every reader, with names."""
    e = edges(table(spark, sf_dir, "compat_runs")).withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("confidence"), "run_id"))).filter("place <= 50")
    names = readers(spark, sf_dir).select(F.col("user_id").alias("match_user"), display_name().alias("match_name"))
    return e.join(names, "match_user", "left").select("user_id", "place", "run_id", "match_user", F.coalesce("match_name", F.lit("Unknown")).alias("match_name"), "confidence")


@query("jn06_note_cards", f"{BOTH} SELECT m.interpretation_id, b.title, {_NAME.replace('first_name', 'u.first_name').replace('last_name', 'u.last_name')} AS reader, u.readername FROM notes m JOIN books b ON m.book_id = b.book_id JOIN readers u ON m.user_id = u.user_id WHERE NOT m.is_deleted")
def jn06_note_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN02, JN03, JN06, FLT30: live notes with book and reader."""
    m = notes(spark, sf_dir).filter(~F.col("is_deleted")).select("interpretation_id", "book_id", "user_id")
    u = readers(spark, sf_dir).select("user_id", display_name().alias("reader"), "readername")
    return m.join(table(spark, sf_dir, "books").select("book_id", "title"), "book_id").join(u, "user_id").select("interpretation_id", "title", "reader", "readername")


@query("jn09_threads", f"{with_once('messages')}, l AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, message_id DESC) AS k FROM (SELECT * EXCLUDE (rn) FROM messages) z) SELECT thread_id, count(*) AS n_messages, count(*) FILTER (read_at IS NULL) AS unread, max(CASE WHEN k = 1 THEN message_id END) AS last_message, max(CASE WHEN k = 1 THEN msg_type END) AS last_type, count(DISTINCT sender_id) AS senders FROM l GROUP BY thread_id")
def jn09_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN07-JN09, FLT29, AG48: one grouped pass instead of a subquery per thread."""
    m = latest(table(spark, sf_dir, "whisper_messages"), ["message_id"], "ingested_at")
    last = F.max(F.struct("created_at", "message_id", "msg_type"))
    return m.groupBy("thread_id").agg(F.count("*").alias("n_messages"), F.count_if(F.col("read_at").isNull()).alias("unread"), last.alias("x"), F.count_distinct("sender_id").alias("senders")).select("thread_id", "n_messages", "unread", F.col("x.message_id").alias("last_message"), F.col("x.msg_type").alias("last_type"), "senders")


@query("ag48_thread_kinds", f"{with_once('messages')} SELECT thread_id, count(*) FILTER (msg_type = 'shared') AS cards, count(*) FILTER (msg_type = 'whisper') AS texts, count(DISTINCT interpretation_id) AS shared FROM messages GROUP BY thread_id")
def ag48_thread_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG48, JN08."""
    m = latest(table(spark, sf_dir, "whisper_messages"), ["message_id"], "ingested_at")
    return m.groupBy("thread_id").agg(F.count_if(F.col("msg_type") == "shared").alias("cards"), F.count_if(F.col("msg_type") == "whisper").alias("texts"), F.count_distinct("interpretation_id").alias("shared"))


@query("jn13_shared_notes", f"{with_once('messages', 'notes')} SELECT s.message_id, m.interpretation_id IS NOT NULL AS resolved FROM messages s LEFT JOIN notes m ON s.interpretation_id = m.interpretation_id WHERE s.msg_type = 'shared'")
def jn13_shared_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13: shared notes, and whether they can be resolved."""
    s = latest(table(spark, sf_dir, "whisper_messages"), ["message_id"], "ingested_at").filter("msg_type = 'shared'").select("message_id", "interpretation_id")
    known = notes(spark, sf_dir).select("interpretation_id", F.lit(True).alias("k"))
    return s.join(known, "interpretation_id", "left").select("message_id", F.coalesce("k", F.lit(False)).alias("resolved"))


@query("ag37_match_profiles", "WITH e AS (SELECT user_a AS user_id, user_b AS match_user, book_id, think_r, feel_r FROM compat_runs UNION ALL SELECT user_b, user_a, book_id, think_r, feel_r FROM compat_runs) SELECT user_id, match_user, count(*) AS runs, count(DISTINCT book_id) AS books, CAST(floor(CAST(sum(think_r) AS DOUBLE) / count(*) + 0.5) AS INTEGER) AS think_r, CAST(floor(CAST(sum(feel_r) AS DOUBLE) / count(*) + 0.5) AS INTEGER) AS feel_r FROM e GROUP BY 1, 2")
def ag37_match_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG37, AG38, T1: averages rounded half up, as browsers do."""
    up = lambda c: F.floor(F.sum(c) / F.count("*") + 0.5).cast("int").alias(c)
    return edges(table(spark, sf_dir, "compat_runs")).groupBy("user_id", "match_user").agg(F.count("*").alias("runs"), F.count_distinct("book_id").alias("books"), up("think_r"), up("feel_r"))


@query("flt21_book_search", "SELECT book_id, title FROM books WHERE contains(lower(title), 'harbour') OR contains(lower(author), 'harbour') ORDER BY title, book_id LIMIT 8")
def flt21_book_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT20, FLT21: the first eight books that hold a word."""
    word = F.lit("harbour")
    return table(spark, sf_dir, "books").filter(F.contains(F.lower("title"), word) | F.contains(F.lower("author"), word)).orderBy("title", "book_id").limit(8).select("book_id", "title")


@query("flt22_message_search", f"{with_once('messages')} SELECT message_id FROM messages WHERE contains(lower(concat_ws(' ', content, msg_type)), 'sunday')")
def flt22_message_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT22."""
    m = latest(table(spark, sf_dir, "whisper_messages"), ["message_id"], "ingested_at")
    return m.filter(F.contains(F.lower(F.concat_ws(" ", "content", "msg_type")), F.lit("sunday"))).select("message_id")


@query("flt23_profile_filters", "SELECT run_id, think_r > 45 AS by_thought, feel_c > 25 AS by_feeling, think_r > think_c AND think_r > think_d AS strictly_r FROM compat_runs WHERE think_r > 45 OR feel_c > 25")
def flt23_profile_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT18, FLT23."""
    c = F.col
    return table(spark, sf_dir, "compat_runs").filter((c("think_r") > 45) | (c("feel_c") > 25)).select("run_id", (c("think_r") > 45).alias("by_thought"), (c("feel_c") > 25).alias("by_feeling"), ((c("think_r") > c("think_c")) & (c("think_r") > c("think_d"))).alias("strictly_r"))


@query("flt28_constraints", f"{with_once('messages', 'notes')} SELECT 'short text' AS \"constraint\", count(*) FILTER (length(interpretation) < 12) AS violations FROM notes UNION ALL SELECT 'content or note', count(*) FILTER ((content IS NULL) = (interpretation_id IS NULL)) FROM messages UNION ALL SELECT 'self pair', (SELECT count(*) FILTER (user_a = user_b) FROM compat_runs) UNION ALL SELECT 'pair order', (SELECT count(*) FILTER (user_a > user_b) FROM compat_runs)")
def flt28_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT28: rows that break the declared constraints."""
    m = latest(table(spark, sf_dir, "whisper_messages"), ["message_id"], "ingested_at")
    r = table(spark, sf_dir, "compat_runs")
    rules = (("short text", notes(spark, sf_dir), F.length("interpretation") < 12), ("content or note", m, F.col("content").isNull() == F.col("interpretation_id").isNull()), ("self pair", r, F.col("user_a") == F.col("user_b")), ("pair order", r, F.col("user_a") > F.col("user_b")))
    out = None
    for name, df, broken in rules:
        row = df.agg(F.count_if(broken).alias("violations")).select(F.lit(name).alias("constraint"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


@query("flt24_unseen", "SELECT DISTINCT user_b AS user_id FROM compat_runs WHERE user_b NOT IN (SELECT user_a FROM compat_runs WHERE user_a IS NOT NULL)")
def flt24_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT24, ST12, JN17."""
    r = table(spark, sf_dir, "compat_runs")
    return r.select(F.col("user_b").alias("user_id")).distinct().join(r.select(F.col("user_a").alias("user_id")), "user_id", "left_anti")


@query("jn22_rank_order", "SELECT b.book_id, coalesce(r.n, 9999) AS place FROM books b LEFT JOIN (SELECT book_id, CAST(row_number() OVER (ORDER BY count(*) DESC, book_id) AS BIGINT) AS n FROM compat_runs GROUP BY book_id) r ON b.book_id = r.book_id")
def jn22_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN22, SL07: books by their runs; those without come last. The window is over the fixed table of books."""
    n = table(spark, sf_dir, "compat_runs").groupBy("book_id").agg(F.count("*").alias("c"))
    ranked = n.select("book_id", F.row_number().over(W.orderBy(F.desc("c"), "book_id")).cast("long").alias("n"))
    return table(spark, sf_dir, "books").select("book_id").join(ranked, "book_id", "left").select("book_id", F.coalesce("n", F.lit(9999)).alias("place"))


@query(
    "jn20_nearest",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query_id, q.label AS ql, e.vec_id, e.label, list_cosine_similarity(q.v, e.v) AS sim FROM e q, e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS k FROM s), r AS (SELECT *, CAST(ql = label AS INTEGER) AS overlap FROM n WHERE k <= 200), p AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, sim DESC, vec_id) AS INTEGER) AS place, vec_id, overlap, round_even(sim, 6) AS similarity FROM r) SELECT * FROM p WHERE place <= 25""",
)
def jn20_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN20, SL05, SL06, ST08, MA11: of every vector whose id is divisible by 20 the 25 of its 200 nearest, those of its own label first."""
    e = table(spark, sf_dir, "embeddings")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("similarity"), "vec_id"))
    near = nearest(e.filter(F.col("vec_id") % 20 == 0), e, "vec_id", "embedding", 200, ["label"]).withColumn("overlap", (F.col("q_label") == F.col("label")).cast("int"))
    return near.withColumn("place", place).filter("place <= 25").select("query_id", "place", "vec_id", "overlap", half_even(F.col("similarity"), 6).alias("similarity"))


@query("aj08_merged_state", "SELECT user_id, json_extract_string(reading_state, '$.font') AS font, TRY_CAST(json_extract_string(reading_state, '$.page') AS INTEGER) + 1 AS page, 'dark' AS theme, CAST(len(list_distinct(list_concat(json_keys(reading_state), ['page', 'theme']))) AS INTEGER) AS n_keys FROM users WHERE json_valid(reading_state)")
def aj08_merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AJ03, AJ08: a patch of two keys merged into each reader's state, the patch wins; a state that is no JSON object has no row."""
    state = F.from_json("reading_state", "map<string,string>")
    patch = F.create_map(F.lit("page"), (state["page"].try_cast("int") + 1).cast("string"), F.lit("theme"), F.lit("dark"))
    m = evaluated(table(spark, sf_dir, "users").filter(state.isNotNull()).select("user_id", "reading_state"), a=state, b=patch).withColumn("m", merged(F.col("a"), F.col("b")))
    return m.select("user_id", F.col("m")["font"].alias("font"), F.col("m")["page"].try_cast("int").alias("page"), F.col("m")["theme"].alias("theme"), F.size("m").alias("n_keys"))


_CHAT = "CASE WHEN length(user_id) = 0 THEN NULL WHEN substr(user_id, 1, 1) IN ('0', '1', '2', '3') THEN reading_state WHEN substr(user_id, 1, 1) IN ('4', '5', '6', '7', '8', '9') THEN concat('Here you are: ', reading_state, ' -- done') WHEN substr(user_id, 1, 1) IN ('a', 'b') THEN concat('{', reading_state) WHEN substr(user_id, 1, 1) = 'c' THEN '' ELSE 'no state' END"


@query("aj01_model_json", rf"WITH u AS (SELECT user_id, {_CHAT} AS x FROM users WHERE reading_state IS NOT NULL), j AS (SELECT user_id, x, CASE WHEN json_valid(x) THEN x WHEN json_valid(regexp_extract(x, '(?s)\{{.*\}}')) THEN regexp_extract(x, '(?s)\{{.*\}}') END AS j FROM u) SELECT user_id, json_extract_string(j, '$.font') AS font, CASE WHEN x = '' THEN 'empty response' WHEN j IS NULL OR j = '' THEN 'could not extract JSON' END AS error FROM j")
def aj01_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AJ01: JSON out of a model's answer: as it stands, else from the first brace to the last, else an error."""
    u = table(spark, sf_dir, "users").filter(F.col("reading_state").isNotNull()).select("user_id", F.expr(_CHAT).alias("x"))
    found, error = model_json(F.col("x"))
    return u.select("user_id", F.get_json_object(found, "$.font").alias("font"), error.alias("error"))

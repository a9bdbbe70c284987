"""Queries of what readers are shown: labels, bars, titles, pages of books, orders and short lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from marginalia.functions import display as D, text as X
from marginalia.functions.farm import farm_id
from marginalia.functions.rounding import half_even
from marginalia.operators.books import html_page, text_pages
from marginalia.operators.order import placed
from marginalia.plans.ranking_queries import edges
from marginalia.plans.registry import query, with_once
from marginalia.plans.text_queries import MAX_WORDS, MIN_CHARS, MIN_WORDS, each_once, notes, raw_texts
from marginalia.tables import table

NOTES = with_once("notes")


@query("tx05_farm_ids")
def tx05_farm_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX05: whole-number ids of users and runs; the one hash that no built-in gives, so it has no SQL."""
    r = table(spark, sf_dir, "compat_runs")
    return r.select("run_id", farm_id(F.col("user_a")).alias("user_number"), farm_id(F.concat("user_a", "user_b", "book_id", "passage_id")).alias("run_number"))


@query(
    "tx19_issue_texts",
    rf"""{NOTES}, f AS (SELECT interpretation_id, CAST(len(regexp_extract_all(coalesce(interpretation, ''), '\S+')) AS INTEGER) AS wc, CAST(length(replace(coalesce(interpretation, ''), ' ', '')) AS INTEGER) AS ch FROM notes)
    SELECT interpretation_id, concat_ws('; ', CASE WHEN wc < 10 THEN concat('too_short: ', wc, ' words (min 10)') WHEN wc > 600 THEN concat('too_long: ', wc, ' words (max 600)') END, CASE WHEN ch < 50 THEN concat('too_few_chars: ', ch) END) AS issues FROM f""",
)
def tx19_issue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX19: issues with their numbers. Null and empty texts have 0 words and characters."""
    x = F.coalesce("text", F.lit(""))
    t = raw_texts(spark, sf_dir).select("interpretation_id", "ingested_at", X.word_count(x).alias("wc"), F.length(F.replace(x, F.lit(" "), F.lit(""))).alias("ch"))
    return each_once(t.select("interpretation_id", "ingested_at", F.concat_ws("; ", X.issue_texts(F.col("wc"), F.col("ch"), MIN_WORDS, MAX_WORDS, MIN_CHARS)).alias("issues")))


#: The spelling that a title stands for; a parameter of the query, as a project's configuration gives it.
TITLES = {"UNKNOWN": "Untitled", "": "Untitled"}


@query("tx31_titles", "SELECT book_id, CASE WHEN title IN ('UNKNOWN', '') THEN 'Untitled' WHEN title = upper(title) AND title <> lower(title) THEN concat(upper(substr(title, 1, 1)), lower(substr(title, 2))) ELSE title END AS title FROM books")
def tx31_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX31: titles in one spelling: those that the map lists, then those wholly in capitals."""
    listed = D.mapped(F.col("title"), TITLES)
    return table(spark, sf_dir, "books").select("book_id", F.when(F.col("title").isin(*TITLES), listed).otherwise(D.capitalised(listed)).alias("title"))


@query("tx33_safe_names", "SELECT run_id, substr(concat('staging_', translate(concat('scheduled__', strftime(run_at, '%Y-%m-%dT%H:%M:%S'), '+00:00'), '-:+.T', '_____')), 1, 1024) AS namespace FROM compat_runs")
def tx33_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX33, SNK17: a run's name as an identifier."""
    name = F.concat(F.lit("scheduled__"), F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return table(spark, sf_dir, "compat_runs").select("run_id", D.safe_name(name).alias("namespace"))


_TASKS = " ".join("WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in ws) + f" THEN '{t}'" for t, ws in D.TASK_WORDS.items())


@query("tx34_task_names", rf"{with_once('messages')}, t AS (SELECT CASE WHEN regexp_matches(content, '^\[[^\]]+\]') THEN regexp_extract(content, '^\[([^\]]+)\]', 1) {_TASKS} ELSE 'General' END AS task FROM messages WHERE content IS NOT NULL) SELECT task, count(*) AS n FROM t GROUP BY task")
def tx34_task_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX34: messages by the task they tell of; a task in brackets at the start comes before the words."""
    m = table(spark, sf_dir, "whisper_messages").filter(F.col("content").isNotNull()).select("message_id", "ingested_at", D.task_name(F.col("content")).alias("task"))
    w = W.partitionBy("message_id").orderBy(F.desc("ingested_at"))
    return m.withColumn("k", F.row_number().over(w)).filter("k = 1").groupBy("task").agg(F.count("*").alias("n"))


_HTML = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\s+', ' ', 'g'))"


@query("tx36_html_pages", rf"SELECT doc_id, {_HTML.format('text')} AS plain, {_HTML.format(chr(39).join(['regexp_extract(text, ', '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', ', 1)']))} AS heading, length({_HTML.format('text')}) > 40 AS has_content FROM documents WHERE regexp_matches(text, '<[a-z]+[^>]*>')")
def tx36_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX36: text and heading of the documents that hold markup, and whether more than 40 characters are left."""
    plain, heading, filled = html_page(F.col("text"))
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("<[a-z]+[^>]*>")).select("doc_id", plain.alias("plain"), heading.alias("heading"), filled.alias("has_content"))


_PARA = r"list_filter(list_transform(string_split(regexp_replace(body, '\n\n+', chr(2), 'g'), chr(2)), lambda p: regexp_replace(regexp_replace(regexp_replace(p, '[ \t]+', ' ', 'g'), '\n', ' ', 'g'), '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')), lambda p: length(p) > 60 AND NOT regexp_full_match(p, '\*{3,}'))"


@query(
    "src21_text_pages",
    rf"""WITH c AS (SELECT doc_id, string_split(regexp_replace(text, '(\n[ \t]*(?:CHAPTER|Chapter|LETTER|Letter|PART|Part)[ \t]+[IVXLCDM\d]+[^\n]*)', chr(1)||'\1'||chr(1), 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\S')),
    s AS (SELECT doc_id, len(x) >= 5 AS many, x FROM c), h AS (SELECT doc_id, 0 AS chapter, 'Text' AS heading, array_to_string(x, '') AS body FROM s WHERE NOT many
    UNION ALL SELECT doc_id, k, trim(regexp_replace(x[2 * k], '\s+', ' ', 'g')), x[2 * k + 1] FROM (SELECT doc_id, x, unnest(range(1, (len(x) + 1) // 2)) AS k FROM s WHERE many) q),
    p AS (SELECT doc_id, chapter, heading, {_PARA} AS paras FROM h), n AS (SELECT *, (len(paras) + 19) // 20 AS parts FROM p WHERE len(paras) > 0), e AS (SELECT *, unnest(range(1, parts + 1)) AS part FROM n)
    SELECT doc_id, CAST(chapter AS INTEGER) AS chapter, CAST(part AS INTEGER) AS part, CASE WHEN parts = 1 THEN heading ELSE concat(heading, ' (', part, '/', parts, ')') END AS label, CAST(len(paras[20 * part - 19 : 20 * part]) AS INTEGER) AS paragraphs, md5(array_to_string(paras[20 * part - 19 : 20 * part], chr(10)||chr(10))) AS text_md5 FROM e""",
)
def src21_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21, TX35, UF11: plain text cut into chapters, those into pages of twenty paragraphs. A text with fewer than two headings is one chapter; no chapter is left out."""
    p = text_pages(table(spark, sf_dir, "documents"), "doc_id", "text", F.lit("Text"))
    return p.select("doc_id", "chapter", "part", "label", F.size("paragraphs").alias("paragraphs"), F.md5(F.array_join("paragraphs", "\n\n")).alias("text_md5"))


@query("tx46_paragraphs", r"SELECT page_id, CAST(len(list_filter(string_split(regexp_replace(content, '\n\n+', chr(1), 'g'), chr(1)), lambda p: length(p) > 80)) AS INTEGER) AS paragraphs FROM book_pages")
def tx46_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX46: paragraphs of more than 80 characters; null for a page without text."""
    return table(spark, sf_dir, "book_pages").select("page_id", F.when(F.col("content").isNotNull(), F.size(X.paragraphs(F.col("content"), 80))).alias("paragraphs"))


def _band_sql(p: str) -> str:
    share = [f"CAST({p}_{k} AS DOUBLE) / nullif({p}_r + {p}_c + {p}_d, 0)" for k in "rcd"]
    return f"list_sort([{', '.join(share)}])"


@query(
    "tx38_bands",
    f"""WITH s AS (SELECT run_id, think_r, think_c, think_d, feel_r, feel_c, feel_d, {_band_sql('think')} AS t, {_band_sql('feel')} AS f FROM compat_runs)
    SELECT run_id, {', '.join(f"CASE WHEN {s}[3] IS NULL THEN NULL WHEN {s}[3] - {s}[2] < CAST(0.15 AS DOUBLE) AND {s}[3] < CAST(0.4 AS DOUBLE) THEN 'split' WHEN {s}[3] >= CAST(0.6 AS DOUBLE) THEN 'strong' WHEN {s}[3] >= CAST(0.4 AS DOUBLE) THEN 'moderate' ELSE 'weak' END AS {n}_band" for s, n in (('t', 'think'), ('f', 'feel')))},
    concat({', '.join(f"CASE WHEN {n}_r >= {n}_c AND {n}_r >= {n}_d THEN 'R' WHEN {n}_c >= {n}_d THEN 'C' ELSE 'D' END" for n in ('think', 'feel'))}) AS pair_key FROM s""",
)
def tx38_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX38: how strongly thought and feeling lean, and the pair of their largest parts."""
    (t, tk), (f, fk) = (D.band(*(F.col(f"{p}_{k}") for k in "rcd")) for p in ("think", "feel"))
    return table(spark, sf_dir, "compat_runs").select("run_id", t.alias("think_band"), f.alias("feel_band"), F.concat(tk, fk).alias("pair_key"))


@query("tx40_overlap", "WITH e AS (SELECT user_a AS user_id, user_b AS match_user, book_id FROM compat_runs UNION ALL SELECT user_b, user_a, book_id FROM compat_runs) SELECT user_id, match_user, count(DISTINCT book_id) AS books, CASE WHEN count(DISTINCT book_id) >= 8 THEN 'high overlap' WHEN count(DISTINCT book_id) >= 4 THEN 'solid overlap' ELSE 'some overlap' END AS label FROM e GROUP BY 1, 2")
def tx40_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX40: how many books two readers share."""
    e = edges(table(spark, sf_dir, "compat_runs").select("user_a", "user_b", "book_id"))
    return e.groupBy("user_id", "match_user").agg(F.count_distinct("book_id").alias("books")).withColumn("label", D.overlap_label(F.col("books")))


_PCT = {k: f"CAST(think_{k[0]} AS DOUBLE) / nullif(think_r + think_c + think_d, 0) * 100" for k in D.QUALIFIERS}
_WORDS = ", ".join("CASE " + " ".join(f"WHEN {_PCT[k]} >= CAST({least} AS DOUBLE) THEN '{word}'" for least, word in of) + f" END AS {k}_word" for k, of in D.QUALIFIERS.items())


@query("tx41_bars", f"SELECT run_id, {', '.join(f'round_even({p}, 4) AS {k}' for k, p in _PCT.items())}, {_WORDS} FROM compat_runs")
def tx41_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX41: parts as per cent of their sum, with a word for each."""
    pct = dict(zip(D.QUALIFIERS, D.bars(F.col("think_r"), F.col("think_c"), F.col("think_d"))))
    return table(spark, sf_dir, "compat_runs").select("run_id", *(half_even(p, 4).alias(k) for k, p in pct.items()), *(D.qualifier(k, p).alias(f"{k}_word") for k, p in pct.items()))


@query("tx42_progress", f"{NOTES} SELECT user_id, count(*) FILTER (trim(interpretation) <> '') AS n, CASE WHEN count(*) FILTER (trim(interpretation) <> '') <= 3 THEN 'starting' WHEN count(*) FILTER (trim(interpretation) <> '') <= 6 THEN 'shaping' ELSE 'settled' END AS stage FROM notes WHERE NOT is_deleted GROUP BY user_id")
def tx42_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX42: readers by the number of their live texts."""
    n = notes(spark, sf_dir).filter(~F.col("is_deleted")).groupBy("user_id").agg(F.count_if(F.trim("interpretation") != "").alias("n"))
    return n.withColumn("stage", D.progress(F.col("n")))


@query("sl01_orders", "SELECT book_id, row_number() OVER (ORDER BY created_at, book_id) AS oldest, row_number() OVER (ORDER BY created_at DESC, book_id) AS newest, row_number() OVER (ORDER BY title, book_id) AS by_title, row_number() OVER (ORDER BY pub_year NULLS LAST, book_id) AS by_year FROM books")
def sl01_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL01: the place of every book in four orders; ties by id."""
    b = table(spark, sf_dir, "books").select("book_id", "created_at", "title", "pub_year")
    for name, by in (("oldest", F.asc("created_at")), ("newest", F.desc("created_at")), ("by_title", F.asc("title")), ("by_year", F.asc_nulls_last("pub_year"))):
        b = placed(b, by, F.asc("book_id"), name=name)
    return b.drop("created_at", "title", "pub_year")


@query("sl08_latest_run", "SELECT run_id FROM compat_runs ORDER BY run_at DESC NULLS LAST, run_id LIMIT 1")
def sl08_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL08: the one latest run, ties by the least id."""
    return table(spark, sf_dir, "compat_runs").orderBy(F.desc_nulls_last("run_at"), "run_id").limit(1).select("run_id")


@query("sl09_first_five", "WITH e AS (SELECT user_a AS user_id, user_b AS match_user, book_id, think_r, run_id FROM compat_runs UNION ALL SELECT user_b, user_a, book_id, think_r, run_id FROM compat_runs), r AS (SELECT user_id, book_id, match_user, run_id, CAST(row_number() OVER (PARTITION BY user_id, book_id ORDER BY think_r DESC NULLS LAST, run_id) AS INTEGER) AS place FROM e WHERE think_r > 45) SELECT * FROM r WHERE place <= 5")
def sl09_first_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL09, FLT23: of every reader and book the first five matches above the filter, the most alike first."""
    e = edges(table(spark, sf_dir, "compat_runs")).filter("think_r > 45")
    place = F.row_number().over(W.partitionBy("user_id", "book_id").orderBy(F.desc_nulls_last("think_r"), "run_id"))
    return e.withColumn("place", place).filter("place <= 5").select("user_id", "book_id", "match_user", "run_id", "place")


@query("sl10_feed", f"{NOTES}, f AS (SELECT user_id, interpretation_id AS id, 0 AS seed, created_at FROM notes UNION ALL SELECT u.user_id, u.last_read_book_id, 1, NULL FROM readers u WHERE u.last_read_book_id IS NOT NULL) SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seed, created_at DESC, id) AS INTEGER) AS place FROM f".replace("WITH notes", f"{with_once('readers')}, notes", 1))
def sl10_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL10: every reader's texts, the latest first, and after them the row that each starts with."""
    from marginalia.plans.profiling_queries import readers

    own = notes(spark, sf_dir).select("user_id", F.col("interpretation_id").alias("id"), F.lit(0).alias("seed"), "created_at")
    seed = readers(spark, sf_dir).filter(F.col("last_read_book_id").isNotNull()).select("user_id", F.col("last_read_book_id").alias("id"), F.lit(1).alias("seed"), F.lit(None).cast("timestamp").alias("created_at"))
    return own.unionByName(seed).select("user_id", "id", F.row_number().over(W.partitionBy("user_id").orderBy("seed", F.desc_nulls_last("created_at"), "id")).alias("place"))


@query("sl11_pool", "SELECT run_id, row_number() OVER (ORDER BY confidence DESC NULLS LAST, run_id) AS place FROM compat_runs")
def sl11_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL11: all runs by confidence; the places are counted per range, no task sorts all."""
    return placed(table(spark, sf_dir, "compat_runs").select("run_id", "confidence"), F.desc_nulls_last("confidence"), F.asc("run_id")).select("run_id", "place")


@query("sl12_slots", "WITH s AS (SELECT DISTINCT user_a AS user_id, book_id, passage_id FROM compat_runs UNION SELECT DISTINCT user_b, book_id, passage_id FROM compat_runs) SELECT *, row_number() OVER (ORDER BY user_id NULLS FIRST, book_id NULLS FIRST, passage_id NULLS FIRST) AS place FROM s")
def sl12_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SL12: readers and their passages in the order in which a refit goes through them."""
    e = edges(table(spark, sf_dir, "compat_runs")).select("user_id", "book_id", "passage_id").distinct()
    return placed(e, "user_id", "book_id", "passage_id")


_FAR = "interpretation_updated_at > created_at + INTERVAL 1 DAY"


@query("prj16_overlay", f"{NOTES} SELECT interpretation_id, CASE WHEN {_FAR} THEN upper(interpretation_id) ELSE md5(interpretation) END AS shown, coalesce({_FAR}, false) AS edited FROM notes WHERE NOT is_deleted")
def prj16_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ16: a table of edits laid over the live texts; a row with an edit shows the edit."""
    n = notes(spark, sf_dir)
    edits = n.filter(F.expr(_FAR)).select("interpretation_id", F.upper("interpretation_id").alias("new"))
    live = n.filter(~F.col("is_deleted")).select("interpretation_id", F.md5("interpretation").alias("old"))
    return live.join(edits, "interpretation_id", "left").select("interpretation_id", F.coalesce("new", "old").alias("shown"), F.col("new").isNotNull().alias("edited"))


@query("st13_shelves", f"{with_once('readers')}, fixed AS (SELECT book_id FROM books WHERE book_lang = 'en'), own AS (SELECT DISTINCT last_read_book_id AS book_id FROM readers WHERE last_read_book_id IS NOT NULL) SELECT 'fixed' AS side, book_id FROM fixed WHERE book_id NOT IN (SELECT book_id FROM own) UNION ALL SELECT 'own', book_id FROM own WHERE book_id NOT IN (SELECT book_id FROM fixed)")
def st13_shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST13: what only the fixed shelf holds, and what only the readers' shelves hold."""
    from marginalia.plans.profiling_queries import readers

    fixed = table(spark, sf_dir, "books").filter("book_lang = 'en'").select("book_id")
    own = readers(spark, sf_dir).select(F.col("last_read_book_id").alias("book_id")).dropna().distinct()
    only = lambda a, b, n: a.join(b, "book_id", "left_anti").select(F.lit(n).alias("side"), "book_id")
    return only(fixed, own, "fixed").unionByName(only(own, fixed, "own"))

"""Queries of profiling, schema checks and distributions by reader group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import text as X
from marginalia.functions.rounding import half_even, ratio
from marginalia.operators.dedup import latest
from marginalia.operators.profiling import distribution, flattened, null_shares, numeric_profile, outlier_shares, schema_violations, top_values
from marginalia.plans.registry import query, with_once
from marginalia.plans.text_queries import each_once, notes, validated
from marginalia.tables import table

BOTH = with_once("notes", "readers")
READERS = with_once("readers")
_GENDER = "CASE WHEN lower(trim(gender)) = '' THEN NULL ELSE lower(trim(gender)) END"


def readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, each once, with one spelling of gender."""
    g = F.lower(F.trim("gender"))
    return latest(table(spark, sf_dir, "users"), ["user_id"], "ingested_at").withColumn("sex", F.when(g != "", g))


def notes_with_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN01: every note, with its reader where known."""
    return notes(spark, sf_dir).join(readers(spark, sf_dir).select("user_id", "sex", "layout_mode"), "user_id", "left")


@query(
    "ag01_gender_shares",
    f"""{BOTH}, j AS (SELECT m.interpretation_id, {_GENDER.replace('gender', 'u.gender')} AS value FROM notes m LEFT JOIN readers u ON m.user_id = u.user_id), g AS (SELECT value, count(*) AS n FROM j GROUP BY value),
    t AS (SELECT CAST(sum(n) AS DOUBLE) AS total, count(value) AS k FROM g) SELECT value, n, round_even(CAST(100 AS DOUBLE) * n / total, 1) AS pct, round_even(CAST(100 AS DOUBLE) / k, 1) AS expected,
    round_even(round_even(CAST(100 AS DOUBLE) * n / total, 1) - round_even(CAST(100 AS DOUBLE) / k, 1), 1) AS deviation FROM g, t WHERE value IS NOT NULL""",
)
def ag01_gender_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG01, JN01, T3: shares by gender, nulls in the denominator only."""
    return distribution(notes_with_readers(spark, sf_dir), "sex")


@query(
    "ag02_verdicts",
    f"""{BOTH}, j AS (SELECT {_GENDER.replace('gender', 'u.gender')} AS gender, u.layout_mode AS layout FROM notes m LEFT JOIN readers u ON m.user_id = u.user_id), t AS (SELECT count(*) AS total FROM j),
    g AS (SELECT 'gender' AS dimension, gender AS value, count(*) AS n FROM j WHERE gender IS NOT NULL GROUP BY gender UNION ALL SELECT 'layout', layout, count(*) FROM j WHERE layout IS NOT NULL GROUP BY layout),
    k AS (SELECT dimension, count(*) AS k FROM g GROUP BY dimension), d AS (SELECT g.dimension, abs(round_even(round_even(CAST(100 AS DOUBLE) * n / total, 1) - round_even(CAST(100 AS DOUBLE) / k, 1), 1)) AS dev FROM g JOIN k ON g.dimension = k.dimension, t)
    SELECT dimension, max(dev) AS max_deviation, CASE WHEN max(dev) < 10 THEN 'BALANCED' ELSE 'IMBALANCED' END AS verdict FROM d GROUP BY dimension""",
)
def ag02_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG02, AG09: the largest deviation of each dimension and its label."""
    j = notes_with_readers(spark, sf_dir)
    parts = [distribution(j, c).select(F.lit(n).alias("dimension"), F.abs("deviation").alias("dev")) for n, c in (("gender", "sex"), ("layout", "layout_mode"))]
    return parts[0].unionByName(parts[1]).groupBy("dimension").agg(F.max("dev").alias("max_deviation")).withColumn("verdict", F.when(F.col("max_deviation") < 10, "BALANCED").otherwise("IMBALANCED"))


@query(
    "ag03_crosstab",
    f"""{BOTH}, j AS (SELECT {_GENDER.replace('gender', 'u.gender')} AS g, m.book_id FROM notes m JOIN readers u ON m.user_id = u.user_id WHERE m.book_id IS NOT NULL)
    SELECT book_id, count(*) FILTER (g = 'female') AS female, count(*) FILTER (g = 'male') AS male, count(*) FILTER (g = 'nonbinary') AS nonbinary, round_even(CAST(100 AS DOUBLE) * count(*) FILTER (g = 'female') / nullif(count(g), 0), 1) AS female_pct FROM j GROUP BY book_id""",
)
def ag03_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG03, AG04: counts by book and gender, and a row share."""
    j = notes(spark, sf_dir).filter(F.col("book_id").isNotNull()).join(readers(spark, sf_dir).select("user_id", "sex"), "user_id")
    wide = j.groupBy("book_id").agg(*(F.count_if(F.col("sex") == g).alias(g) for g in ("female", "male", "nonbinary")), F.count("sex").alias("known"))
    return wide.withColumn("female_pct", half_even(F.try_divide(F.lit(100.0) * F.col("female"), F.col("known").cast("double")), 1)).drop("known")


@query(
    "ag05_word_stats",
    rf"""{with_once('notes')}, m AS (SELECT book_id, len(regexp_extract_all(interpretation, '\S+')) AS wc FROM notes WHERE interpretation IS NOT NULL)
    SELECT book_id, count(*) AS n, CAST(sum(wc) AS BIGINT) AS words, round_even(CAST(sum(wc) AS DOUBLE) / count(*), 2) AS mean_words, CAST(min(wc) AS INTEGER) AS least, CAST(max(wc) AS INTEGER) AS most, CAST(quantile_cont(wc, 0.5) AS DOUBLE) AS median_words FROM m GROUP BY book_id""",
)
def ag05_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG05, AG06: lengths by book; a null book is a group."""
    t = each_once(table(spark, sf_dir, "interpretations").filter(F.col("interpretation").isNotNull()).select("interpretation_id", "ingested_at", "book_id", X.word_count(F.col("interpretation")).alias("wc")))
    return t.groupBy("book_id").agg(F.count("*").alias("n"), F.sum("wc").alias("words"), half_even(F.sum("wc") / F.count("*"), 2).alias("mean_words"), F.min("wc").alias("least"), F.max("wc").alias("most"), F.percentile("wc", 0.5).alias("median_words"))


@query("ag07_structure", f"{with_once('notes')}, p AS (SELECT user_id, count(*) AS n, count(DISTINCT book_id) AS books FROM notes GROUP BY user_id) SELECT n AS notes_per_reader, count(*) AS readers, CAST(max(books) AS BIGINT) AS most_books FROM p GROUP BY n")
def ag07_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG07: aggregation of an aggregation."""
    per = notes(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("book_id").alias("books"))
    return per.groupBy(F.col("n").alias("notes_per_reader")).agg(F.count("*").alias("readers"), F.max("books").alias("most_books"))


@query(
    "ag08_group_deviation",
    rf"""{BOTH}, j AS (SELECT {_GENDER.replace('gender', 'u.gender')} AS g, len(regexp_extract_all(coalesce(m.interpretation, ''), '\S+')) AS wc FROM notes m JOIN readers u ON m.user_id = u.user_id), o AS (SELECT CAST(sum(wc) AS DOUBLE) / count(*) AS mean FROM j)
    SELECT g AS sex, count(*) AS n, round_even(CAST(100 AS DOUBLE) * (CAST(sum(wc) AS DOUBLE) / count(*) - any_value(mean)) / any_value(mean), 1) AS deviation_pct, abs(CAST(100 AS DOUBLE) * (CAST(sum(wc) AS DOUBLE) / count(*) - any_value(mean)) / any_value(mean)) > 20 AS flagged FROM j, o WHERE g IS NOT NULL GROUP BY g""",
)
def ag08_group_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG08, AG32: group means against the mean of all rows; that of all rows comes from the groups' sums."""
    j = notes(spark, sf_dir).join(readers(spark, sf_dir).select("user_id", "sex"), "user_id").select("sex", X.word_count(F.coalesce("interpretation", F.lit(""))).alias("wc"))
    sums = j.groupBy("sex").agg(F.count("*").alias("n"), F.sum("wc").alias("words"))
    total = sums.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    mean = float(total["words"]) / total["n"] if total["n"] else None
    dev = F.lit(100.0) * (F.col("words") / F.col("n") - F.lit(mean).cast("double")) / F.lit(mean).cast("double")
    return sums.filter(F.col("sex").isNotNull()).select("sex", "n", half_even(dev, 1).alias("deviation_pct"), (F.abs(dev) > 20).alias("flagged"))


@query("ag10_reader_books", f"{with_once('notes')} SELECT user_id, count(*) AS n, coalesce(string_agg(DISTINCT book_id, ';' ORDER BY book_id), '') AS books FROM notes GROUP BY user_id")
def ag10_reader_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10, AJ07: count and sorted distinct books of each reader. A reader's books are few: at most the table of books."""
    return notes(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("book_id")), ";").alias("books"))


_NULLS = ("book_id", "passage_id", "page_num", "interpretation", "lang", "chapter")


@query("ag11_null_shares", " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) - count({c}) AS nulls, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS share, CASE WHEN CAST(count(*) - count({c}) AS DOUBLE) / count(*) > 0.2 THEN 'high' WHEN CAST(count(*) - count({c}) AS DOUBLE) / count(*) > 0.1 THEN 'medium' END AS severity FROM interpretations" for c in _NULLS).replace(" AS column", ' AS "column"'))
def ag11_null_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11."""
    return null_shares(table(spark, sf_dir, "interpretations"), _NULLS)


_NUM = ("think_r", "think_c", "think_d", "feel_r", "feel_c", "feel_d")


@query("ag12_outliers", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, CAST(sum(CASE WHEN abs(({c} - m) / s) > 2 THEN 1 ELSE 0 END) AS BIGINT) AS outliers, CAST(sum(CASE WHEN abs(({c} - m) / s) > 2 THEN 1 ELSE 0 END) AS DOUBLE) / count({c}) AS share FROM compat_runs, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM compat_runs)" for c in _NUM))
def ag12_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12, WN11, MA09, T6."""
    return outlier_shares(table(spark, sf_dir, "compat_runs"), _NUM, 2.0)


@query("ag13_numeric_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round_even(avg({c}), 6) AS mean, round_even(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max, count(DISTINCT {c}) AS n_distinct FROM compat_runs" for c in _NUM))
def ag13_numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, AG17, T5: linear interpolation between order statistics."""
    p = numeric_profile(table(spark, sf_dir, "compat_runs"), _NUM)
    return p.withColumns({"mean": half_even(F.col("mean"), 6), "std": half_even(F.col("std"), 6)})


@query("ag14_top_values", "WITH l AS (SELECT 'lang' AS \"column\", lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents), c AS (SELECT \"column\", value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS INTEGER) AS place FROM c) SELECT * FROM r WHERE place <= 5")
def ag14_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14, T9."""
    return top_values(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("ag15_table_sizes", " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n_rows, CAST({k} AS INTEGER) AS n_columns FROM {t}" for t, k in (("books", 8), ("users", 16), ("interpretations", 14), ("whisper_messages", 9), ("compat_runs", 16), ("comparisons", 9), ("documents", 8))))
def ag15_table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15, AG35, AG47, SRC27: rows and columns of the tables loaded, in one job."""
    out = None
    for name in ("books", "users", "interpretations", "whisper_messages", "compat_runs", "comparisons", "documents"):
        df = table(spark, sf_dir, name)
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("tbl"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


RULES = {"run_id": {"required": True}, "think_r": {"required": True, "min": 0, "max": 100}, "feel_d": {"min": 0, "max": 100}, "verdict": {"required": True, "allowed": ["resonate", "contradict", "diverge", ""]}, "confidence": {"min": 0.2, "max": 0.95}}


@query(
    "ag16_schema_check",
    """SELECT * FROM (SELECT 'run_id' AS "column", 'required' AS rule, count(*) FILTER (run_id IS NULL) AS violations FROM compat_runs UNION ALL SELECT 'think_r', 'required', count(*) FILTER (think_r IS NULL) FROM compat_runs UNION ALL SELECT 'think_r', 'min', count(*) FILTER (think_r < 0) FROM compat_runs
    UNION ALL SELECT 'think_r', 'max', count(*) FILTER (think_r > 100) FROM compat_runs UNION ALL SELECT 'feel_d', 'min', count(*) FILTER (feel_d < 0) FROM compat_runs UNION ALL SELECT 'feel_d', 'max', count(*) FILTER (feel_d > 100) FROM compat_runs
    UNION ALL SELECT 'verdict', 'required', count(*) FILTER (verdict IS NULL) FROM compat_runs UNION ALL SELECT 'verdict', 'allowed', count(*) FILTER (verdict IS NULL OR verdict NOT IN ('resonate', 'contradict', 'diverge', '')) FROM compat_runs
    UNION ALL SELECT 'confidence', 'min', count(*) FILTER (confidence < 0.2) FROM compat_runs UNION ALL SELECT 'confidence', 'max', count(*) FILTER (confidence > 0.95) FROM compat_runs)""",
)
def ag16_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16, AG18, AG49, D15: violations of the declared rules, shares outside 0..100 among them."""
    return schema_violations(table(spark, sf_dir, "compat_runs"), RULES)


@query(
    "ag19_stage_checks",
    rf"""{with_once('notes')}, m AS (SELECT coalesce(interpretation, '') AS x, user_id FROM notes), f AS (SELECT user_id, len(regexp_extract_all(x, '\S+')) AS wc, length(replace(x, ' ', '')) AS ch, len(regexp_extract_all(x, '\p{{L}}')) AS lt, len(regexp_extract_all(lower(x), '[aeiou]')) AS vo FROM m),
    v AS (SELECT user_id, NOT (wc = 0 OR wc < 10 OR wc > 600 OR ch < 50 OR (lt >= 10 AND (CAST(vo AS DOUBLE) / lt < 0.15 OR CAST(vo AS DOUBLE) / lt > 0.6))) AS ok FROM f),
    s AS (SELECT count(*) AS n, count(DISTINCT user_id) AS readers, count(*) FILTER (ok) AS valid FROM v) SELECT n, readers, valid, round_even(CAST(valid AS DOUBLE) / n, 4) AS valid_rate, CASE WHEN n < 100 OR readers < 5 OR CAST(n - valid AS DOUBLE) / n > 0.2 THEN 'FAILED' WHEN n > valid THEN 'WARNING' ELSE 'PASSED' END AS status FROM s""",
)
def ag19_stage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG19, AG50, D4: volume and validity before any gate."""
    v = each_once(validated(table(spark, sf_dir, "interpretations").select("interpretation_id", "ingested_at", "user_id", F.col("interpretation").alias("text"))).select("interpretation_id", "ingested_at", "user_id", "is_valid"))
    s = v.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("readers"), F.count_if("is_valid").alias("valid"))
    bad = ratio(F.col("n") - F.col("valid"), F.col("n"))
    return s.withColumns({"valid_rate": half_even(ratio(F.col("valid"), F.col("n")), 4), "status": F.when((F.col("n") < 100) | (F.col("readers") < 5) | (bad > 0.2), "FAILED").when(F.col("n") > F.col("valid"), "WARNING").otherwise("PASSED")})


@query(
    "ag20_gauges",
    rf"""{with_once('notes')}, m AS (SELECT CAST(created_at AS DATE) AS d, len(regexp_extract_all(coalesce(interpretation, ''), '\S+')) AS wc FROM notes)
    SELECT CAST(d AS VARCHAR) AS run_date, count(*) AS n, round_even(CAST(sum(wc) AS DOUBLE) / count(*), 4) AS mean_words, round_even(quantile_cont(CAST(wc AS DOUBLE), 0.5), 4) AS p50_words, round_even(quantile_cont(CAST(wc AS DOUBLE), 0.95), 4) AS p95_words FROM m GROUP BY d""",
)
def ag20_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG20, SM12: distribution gauges of every daily run."""
    t = each_once(table(spark, sf_dir, "interpretations").select("interpretation_id", "ingested_at", F.to_date("created_at").cast("string").alias("run_date"), X.word_count(F.coalesce("interpretation", F.lit(""))).alias("wc")))
    return t.groupBy("run_date").agg(F.count("*").alias("n"), half_even(F.sum("wc") / F.count("*"), 4).alias("mean_words"), half_even(F.percentile("wc", 0.5), 4).alias("p50_words"), half_even(F.percentile("wc", 0.95), 4).alias("p95_words"))


@query("prj06_flattened", "SELECT run_id, think_r AS \"think_R\", think_c AS \"think_C\", think_d AS \"think_D\", concat(user_a, ', ', user_b) AS pair, concat('{\"confidence\":', CAST(confidence AS VARCHAR), '}') AS extra FROM compat_runs")
def prj06_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ04-PRJ06, AJ09: to structs and back to flat columns."""
    nested = table(spark, sf_dir, "compat_runs").select("run_id", F.struct(F.col("think_r").alias("R"), F.col("think_c").alias("C"), F.col("think_d").alias("D")).alias("think"), F.array("user_a", "user_b").alias("pair"), F.create_map(F.lit("confidence"), "confidence").alias("extra"))
    return flattened(nested)


@query("dt07_bands", "SELECT gutenberg_id, coalesce(CASE WHEN pub_year < 1800 THEN 'before 1800' WHEN pub_year < 1850 THEN '1800-1849' WHEN pub_year < 1900 THEN '1850-1899' WHEN pub_year >= 1900 THEN '1900 on' END, 'Unknown') AS band, book_id FROM books")
def dt07_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT07: bands of a number that may be missing."""
    y = F.col("pub_year")
    return table(spark, sf_dir, "books").select("gutenberg_id", F.when(y < 1800, "before 1800").when(y < 1850, "1800-1849").when(y < 1900, "1850-1899").when(y >= 1900, "1900 on").otherwise("Unknown").alias("band"), "book_id")

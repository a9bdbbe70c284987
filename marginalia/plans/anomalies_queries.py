"""Queries of the second pass: outliers against baselines of all rows, and similar texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import text as X
from marginalia.functions.rounding import half_even
from marginalia.operators.anomalies import nearest_rank_bounds, outside, positive_mean_std, similar_texts, text_key, tfidf
from marginalia.plans.registry import query, with_once
from marginalia.plans.text_queries import each_once, notes, raw_texts
from marginalia.tables import table

NOTES = with_once("notes")
_WC = r"m AS (SELECT interpretation_id, len(regexp_extract_all(coalesce(interpretation, ''), '\S+')) AS wc FROM notes), s AS (SELECT wc, row_number() OVER (ORDER BY wc) - 1 AS k, count(*) OVER () AS n FROM m WHERE wc > 0), q AS (SELECT max(CASE WHEN k = n // 4 THEN wc END) AS q1, max(CASE WHEN k = (3 * n) // 4 THEN wc END) AS q3 FROM s)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_once(raw_texts(spark, sf_dir).select("interpretation_id", "ingested_at", X.word_count(F.coalesce("text", F.lit(""))).alias("wc")))


@query("ag40_bounds", f"{NOTES}, {_WC} SELECT CAST(q1 AS DOUBLE) AS q1, CAST(q3 AS DOUBLE) AS q3, CAST(q3 - q1 AS DOUBLE) AS iqr, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lower, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS upper FROM q")
def ag40_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG40, FLT26, D14."""
    b = nearest_rank_bounds(_counts(spark, sf_dir), ["wc"])["wc"]
    names = ("q1", "q3", "iqr", "lower", "upper")
    return spark.createDataFrame([tuple(float(b[n]) for n in names) if b else (None,) * 5], ", ".join(f"{n} double" for n in names))


@query("ag42_flags", f"{NOTES}, {_WC}, z AS (SELECT avg(wc) AS mean, stddev_pop(wc) AS std FROM m WHERE wc > 0) SELECT interpretation_id, wc AS word_count, wc > 0 AND (wc < q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) OR wc > q3 + CAST(1.5 AS DOUBLE) * (q3 - q1)) AS length_outlier, round_even((wc - mean) / std, 4) AS z, abs((wc - mean) / std) > 2.5 AS z_outlier FROM (SELECT interpretation_id, CAST(wc AS INTEGER) AS wc FROM m) x, q, z")
def ag42_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG41, AG42, WN11, MA09, O9: each text against baselines of all."""
    t = _counts(spark, sf_dir)
    b = nearest_rank_bounds(t, ["wc"])["wc"]
    mean, std = positive_mean_std(t, "wc")
    z = (F.col("wc") - F.lit(mean)) / F.lit(std)
    return t.select("interpretation_id", F.col("wc").alias("word_count"), outside(F.col("wc"), b).alias("length_outlier"), half_even(z, 4).alias("z"), (F.abs(z) > 2.5).alias("z_outlier"))



def _stop_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """The English ones of the table of common words, a fixed table."""
    return sorted(r[0] for r in table(spark, sf_dir, "common_words").filter((F.col("lang") == "en") & F.col("word").isNotNull()).select(F.lower("word")).distinct().collect())


def _vectors_sql(rows: str) -> str:
    """CTEs of the term weights of `rows`: (id, text)."""
    return rf"""sw AS (SELECT coalesce(list(DISTINCT lower(word)), []) AS sw FROM common_words WHERE lang = 'en' AND word IS NOT NULL), w AS (SELECT id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: NOT list_contains(sw, t)) AS w FROM {rows}, sw),
    t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 5000),
    n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {rows}), r AS (SELECT id, c.term, tf * (ln((1 + n) / (1 + CAST(df AS DOUBLE))) + 1) AS x FROM c JOIN d ON c.term = d.term, n), v AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM r)"""


@query("uf08_terms", f"WITH p AS (SELECT page_id AS id, content AS text FROM book_pages), {_vectors_sql('p')} SELECT id AS page_id, term, round_even(weight, 6) AS weight FROM v")
def uf08_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UF08, H4: weights of the words and pairs of words of every page, without stop words; the 5,000 most frequent ones in two pages and more."""
    return tfidf(table(spark, sf_dir, "book_pages"), "page_id", "content", _stop_words(spark, sf_dir)).select("page_id", "term", half_even(F.col("weight"), 6).alias("weight"))


@query(
    "jn19_similar_notes",
    f"""{NOTES}, k AS (SELECT interpretation AS text, min(interpretation_id) AS id FROM notes WHERE interpretation IS NOT NULL GROUP BY 1), {_vectors_sql('k')},
    l AS (SELECT a.id AS ia, b.id AS ib FROM v a JOIN v b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2 HAVING sum(a.weight * b.weight) >= CAST(0.85 AS DOUBLE) - CAST(1e-9 AS DOUBLE)), g AS (SELECT ia, count(*) AS n, min(ib) AS o FROM l GROUP BY 1)
    SELECT m.interpretation_id, k.id AS class_id, coalesce(g.n, 0) AS n_links, least(g.o, (SELECT min(x.interpretation_id) FROM notes x WHERE x.interpretation = m.interpretation AND x.interpretation_id <> m.interpretation_id)) AS first_match FROM notes m JOIN k ON m.interpretation = k.text LEFT JOIN g ON k.id = g.ia""",
)
def jn19_similar_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN19, T15, O10: one row per text with its class of copies, the count of similar classes, and the first other text of a cosine of 0.85 or more."""
    keyed = each_once(table(spark, sf_dir, "interpretations").select("interpretation_id", "ingested_at", text_key(F.col("interpretation")).alias("h")))
    return similar_texts(notes(spark, sf_dir), "interpretation_id", "interpretation", _stop_words(spark, sf_dir), keyed=keyed)

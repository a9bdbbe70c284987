"""Queries of pairing, scoring and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions.once import evaluated
from marginalia.functions.rounding import half_even, largest_of, to_hundred
from marginalia.operators.pairing import MODES, aggregate_scores, anchor_pairs, cached_split, claim_stats, first_readers, open_partners, pair_counts, partner_counts, score_pairs, scoring_of, split_claims
from marginalia.operators.rollups import book_level, profile_level
from marginalia.plans.registry import query, with_once
from marginalia.plans.text_queries import each_once, notes
from marginalia.tables import table

NOTES = with_once("notes")
_AVG = ", ".join(f"round_even(CAST(sum({c}) AS DOUBLE) / count({c}), 2) AS {c}" for c in ("think_r", "think_c", "think_d", "feel_r", "feel_c", "feel_d"))
_DOM = "CASE WHEN round_even({0}_r, 0) >= round_even({0}_c, 0) AND round_even({0}_r, 0) >= round_even({0}_d, 0) THEN 'resonate' WHEN round_even({0}_c, 0) >= round_even({0}_d, 0) THEN 'contradict' ELSE 'diverge' END AS dominant_{0}"
_VERDICT = "CASE WHEN (think_r + feel_r) / 2 >= (think_c + feel_c) / 2 AND (think_r + feel_r) / 2 >= (think_d + feel_d) / 2 THEN 'resonate' WHEN (think_c + feel_c) / 2 >= (think_d + feel_d) / 2 THEN 'contradict' ELSE 'diverge' END AS verdict"
_BOOK = f"b AS (SELECT least(user_a, user_b) AS user_a, greatest(user_a, user_b) AS user_b, book_id, {_AVG}, round_even(CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) AS DOUBLE) / 1000 / count(confidence), 2) AS confidence, count(*) AS passage_count FROM compat_runs GROUP BY 1, 2, 3)"


@query("ag22_book_rollup", f"WITH {_BOOK} SELECT *, {_DOM.format('think')}, {_DOM.format('feel')}, {_VERDICT} FROM b")
def ag22_book_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22, MA01, MA13, T1, T7, T16, T18: mean scores of each unordered pair and book."""
    return book_level(table(spark, sf_dir, "compat_runs"))


@query("ag23_profile_rollup", f"WITH {_BOOK}, p AS (SELECT user_a, user_b, {_AVG}, round_even(CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) AS DOUBLE) / 1000 / count(confidence), 2) AS confidence, count(DISTINCT book_id) AS book_count, count(*) AS book_rows, CAST(sum(passage_count) AS BIGINT) AS passage_count FROM b GROUP BY 1, 2) SELECT *, {_DOM.format('think')}, {_DOM.format('feel')}, {_VERDICT} FROM p")
def ag23_profile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG23, D6: roll-up of the book rows, with the true count of passages beside that of book rows."""
    return profile_level(book_level(table(spark, sf_dir, "compat_runs")))


_R = "(think_r * CAST(1 AS DOUBLE) + feel_r) / 2"


@query("ma03_round_to_100", "WITH x AS (SELECT run_id, CAST(round_even(think_r * CAST(0.37 AS DOUBLE) + 11.5, 0) AS INTEGER) AS a, CAST(round_even(think_c * CAST(0.61 AS DOUBLE) + 3.25, 0) AS INTEGER) AS b, CAST(round_even(feel_d * CAST(0.83 AS DOUBLE) + 0.5, 0) AS INTEGER) AS c FROM compat_runs) SELECT run_id, a + CASE WHEN a >= b AND a >= c THEN 100 - a - b - c ELSE 0 END AS r, b + CASE WHEN NOT (a >= b AND a >= c) AND b >= c THEN 100 - a - b - c ELSE 0 END AS c, c + CASE WHEN NOT (a >= b AND a >= c) AND NOT b >= c THEN 100 - a - b - c ELSE 0 END AS d FROM x")
def ma03_round_to_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA03, MA04: shares made whole."""
    r, c, d = to_hundred(F.col("think_r") * 0.37 + 11.5, F.col("think_c") * 0.61 + 3.25, F.col("feel_d") * 0.83 + 0.5)
    return table(spark, sf_dir, "compat_runs").select("run_id", r.alias("r"), c.alias("c"), d.alias("d"))


@query("prj12_shares", f"SELECT run_id, {_R} AS r, (think_c * CAST(1 AS DOUBLE) + feel_c) / 2 AS c, (think_d * CAST(1 AS DOUBLE) + feel_d) / 2 AS d, CASE WHEN think_r >= think_c AND think_r >= think_d THEN 'resonate' WHEN think_c >= think_d THEN 'contradict' ELSE 'diverge' END AS top FROM compat_runs")
def prj12_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12, TX39: thought and feeling in one, and the largest share."""
    c = F.col
    return table(spark, sf_dir, "compat_runs").select("run_id", *(((c(f"think_{k}") + c(f"feel_{k}")) / F.lit(2.0)).alias(k) for k in "rcd"), largest_of(c("think_r"), c("think_c"), c("think_d")).alias("top"))


@query("ag33_pair_counts", f"{NOTES}, d AS (SELECT DISTINCT book_id, passage_id, user_id FROM notes WHERE book_id IS NOT NULL AND passage_id IS NOT NULL), p AS (SELECT book_id, passage_id, count(*) AS n FROM d GROUP BY 1, 2) SELECT book_id, count(*) AS passages, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM p GROUP BY 1")
def ag33_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG33: how many reader pairs each book's passages have, without forming them."""
    return pair_counts(notes(spark, sf_dir))


_ON = "d AS (SELECT DISTINCT book_id, passage_id, user_id FROM notes WHERE book_id IS NOT NULL AND passage_id IS NOT NULL), n AS (SELECT book_id, passage_id, count(*) AS n FROM d GROUP BY 1, 2)"


@query("jn14_partners", f"{NOTES}, {_ON} SELECT d.book_id, d.passage_id, user_id, n - 1 AS n_partners FROM d JOIN n ON d.book_id = n.book_id AND d.passage_id = n.passage_id")
def jn14_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, D8, H8: the readers of each passage and how many partners each has: membership that says all pairs without forming them."""
    return partner_counts(notes(spark, sf_dir))


@query("jn15_first_pairs", f"{NOTES}, {_ON}, f AS (SELECT book_id, passage_id, arg_min(user_id, (created_at, user_id)) AS anchor FROM notes WHERE book_id IS NOT NULL AND passage_id IS NOT NULL GROUP BY 1, 2) SELECT d.book_id, d.passage_id, least(user_id, anchor) AS user_a, greatest(user_id, anchor) AS user_b FROM d JOIN f ON d.book_id = f.book_id AND d.passage_id = f.passage_id WHERE user_id <> anchor")
def jn15_first_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15: each passage's first reader as the anchor, with all its other readers."""
    n = notes(spark, sf_dir)
    return anchor_pairs(n, first_readers(n))


@query("jn18_open_partners", f"{NOTES}, {_ON}, r AS (SELECT DISTINCT book_id, least(user_a, user_b) AS a, greatest(user_a, user_b) AS b FROM compat_runs WHERE user_a <> user_b), e AS (SELECT book_id, a AS user_id, b AS other FROM r UNION ALL SELECT book_id, b, a FROM r), k AS (SELECT d.book_id, d.passage_id, d.user_id, count(*) AS done FROM d JOIN e ON d.book_id = e.book_id AND d.user_id = e.user_id JOIN d o ON o.book_id = d.book_id AND o.passage_id = d.passage_id AND o.user_id = e.other GROUP BY 1, 2, 3) SELECT d.book_id, d.passage_id, d.user_id, n - 1 - coalesce(done, 0) AS n_open FROM d JOIN n ON d.book_id = n.book_id AND d.passage_id = n.passage_id LEFT JOIN k ON d.book_id = k.book_id AND d.passage_id = k.passage_id AND d.user_id = k.user_id")
def jn18_open_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN18, O6: of each reader's partners on a passage those without a run on the book yet."""
    return open_partners(notes(spark, sf_dir), table(spark, sf_dir, "compat_runs"))


_SPLIT = r"list_filter(string_split(regexp_replace(regexp_replace(interpretation, '([.!?])\s+', '\1'||chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g')) >= 3)"
_MODE = f"[{', '.join(repr(m) for m in MODES)}][CAST(concat('0x', substr(md5(s), 1, 8)) AS BIGINT) % {len(MODES)} + 1]"


@query(
    "uf01_claims",
    rf"""{NOTES}, s AS (SELECT interpretation_id, CASE WHEN regexp_matches(interpretation, '\S') THEN CASE WHEN len({_SPLIT}) > 0 THEN {_SPLIT} ELSE [interpretation] END ELSE [] END AS s FROM notes), n AS (SELECT *, list_transform(s, lambda x: CAST(greatest(len(regexp_extract_all(x, '\S+')), 1) AS DOUBLE)) AS n FROM s),
    w AS (SELECT *, list_transform(n, lambda x: greatest(x / list_sum(n), CAST(0.1 AS DOUBLE))) AS w FROM n), z AS (SELECT *, list_transform(w, lambda x: x / list_sum(w)) AS z FROM w), m AS (SELECT *, list_sort(list_transform(s, lambda s: {_MODE})) AS m FROM z), k AS (SELECT *, list_sort(list_distinct(m)) AS k FROM m)
    SELECT interpretation_id, CAST(len(s) AS INTEGER) AS n_claims, round_even(coalesce(-list_sum(list_transform(z, lambda x: x * log2(x))), 0) + 0, 4) AS entropy, round_even(coalesce(list_min(z), 0), 4) AS least_weight, round_even(coalesce(list_max(z), 0), 4) AS largest_weight, array_to_string(k, ', ') AS modes,
    coalesce(list_sort(list_transform(k, lambda q: concat(lpad(CAST(100000 - len(list_filter(m, lambda y: y = q)) AS VARCHAR), 6, '0'), q)))[1][7:], 'none') AS modal_mode, round_even(coalesce(list_sum(z), 0), 6) AS weight, abs(coalesce(list_sum(z), 0) - 1) <= 0.02 AS valid, CAST(coalesce(list_sum(list_transform(s, lambda x: len(regexp_extract_all(x, '\s+')) + 1)), 0) AS INTEGER) AS n_words FROM k""",
)
def uf01_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UF01, AJ02, AJ05, AG39: every text split into weighted claims by the pluggable splitter's plain default, and whether the claims are valid."""
    t = split_claims(table(spark, sf_dir, "interpretations").select("interpretation_id", "ingested_at", "interpretation"))
    weight = F.aggregate("subclaims", F.lit(0.0), lambda a, x: a + x["weight"])
    t = t.select("interpretation_id", "ingested_at", *(c.alias(n) for n, c in claim_stats(F.col("subclaims")).items()), half_even(weight, 6).alias("weight"), (F.abs(weight - 1) <= 0.02).alias("valid"), F.aggregate("subclaims", F.lit(0), lambda a, x: a + F.size(F.split(x["claim"], r"\s+"))).alias("n_words"))
    return each_once(t)


@query("ag21_pair_scores")
def ag21_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21, UF02, UF03, JN12, JN21, MA05, MA06: every passage's first reader scored with each of its other readers."""
    n = table(spark, sf_dir, "interpretations")
    live = n.filter(F.col("interpretation").rlike(r"\S"))
    runs = anchor_pairs(live, first_readers(live)).withColumn("run_id", F.md5(F.concat_ws("|", "user_a", "user_b", "book_id", "passage_id")))
    return score_pairs(runs, n)


def given_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and a scorer's answers for every run, made from its shares: one match, of the claims left one that diverges, one as a bare id, one that no claim has."""
    c = lambda n: F.col(n).cast("string")
    odd = lambda *names: F.concat(F.lit("["), F.concat_ws(",", *((F.col(n) % 2 != 0).cast("string") for n in names)), F.lit("]"))
    claims = lambda p: F.array(*(F.struct(F.lit(str(k + 1)).alias("id"), (F.col(f"{p}_{x}") / 100).alias("weight")) for k, x in enumerate("rcd")))
    answers = F.concat(
        F.lit('{"matched_pairs":[{"a_id":"1","b_id":"1","weight_a":'), (F.col("think_r") / 100).cast("string"), F.lit(',"weight_b":'), (F.col("feel_r") / 100).cast("string"),
        F.lit(',"think_q":'), odd("think_r", "think_c", "think_d", "feel_r", "feel_c"), F.lit(',"feel_q":'), odd("feel_d", "feel_c", "feel_r", "think_d", "think_c"),
        F.lit('}],"unmatched_a":["2",{"id":"3","divergence":true}],"unmatched_b":["2",{"id":"9","divergence":false}]}'),
    )
    return table(spark, sf_dir, "compat_runs").select("run_id", claims("think").alias("claims_a"), claims("feel").alias("claims_b"), (F.col("think_r") + 40).alias("wc_a"), (F.col("feel_r") + 40).alias("wc_b"), answers.alias("answers"))


_ODD = lambda n: f"CAST(abs({n} % 2) = 1 AS INTEGER)"
_QUIET = "CAST(0.3 AS DOUBLE)"
_GIVEN = f"""WITH x AS (SELECT run_id, think_r + 40 AS wa, feel_r + 40 AS wb, least(think_r / 100, feel_r / 100) AS w, CAST({' + '.join(_ODD(c) for c in ('think_r', 'think_c', 'think_d'))} + (1 - {_ODD('feel_r')}) + {_ODD('feel_c')} AS DOUBLE) / 5 AS tq, CAST({' + '.join(_ODD(c) for c in ('feel_d', 'feel_c', 'feel_r', 'think_d', 'think_c'))} AS DOUBLE) / 5 AS fq,
    {{0}} * (think_c / 100) AS a2, think_d / 100 AS a3, {{0}} * (feel_c / 100) AS b2, {{0}} * CAST(0.1 AS DOUBLE) AS b9 FROM compat_runs),
    y AS (SELECT *, 0 + a2 + a3 + b2 + b9 AS d, 0 + w + a2 + a3 + b2 + b9 AS t FROM x), p AS (SELECT run_id, wa, wb, (0 + w * tq) / t * 100 AS tr, (0 + w * (1 - tq)) / t * 100 AS tc, d / t * 100 AS td, (0 + w * fq) / t * 100 AS fr, (0 + w * (1 - fq)) / t * 100 AS fc FROM y WHERE t <> 0),
    i AS (SELECT run_id, wa, wb, {', '.join(f'CAST(round_even({c}, 0) AS INTEGER) AS {c}' for c in ('tr', 'tc', 'td', 'fr', 'fc'))} FROM p), h AS (SELECT run_id, wa, wb, {', '.join(f"{x}r + CASE WHEN {x}r >= {x}c AND {x}r >= td THEN 100 - {x}r - {x}c - td ELSE 0 END AS {n}_r, {x}c + CASE WHEN NOT ({x}r >= {x}c AND {x}r >= td) AND {x}c >= td THEN 100 - {x}r - {x}c - td ELSE 0 END AS {n}_c, td + CASE WHEN NOT ({x}r >= {x}c AND {x}r >= td) AND NOT {x}c >= td THEN 100 - {x}r - {x}c - td ELSE 0 END AS {n}_d" for x, n in (('t', 'think'), ('f', 'feel')))} FROM i)
    SELECT run_id, think_r, think_c, think_d, feel_r, feel_c, feel_d, {', '.join(f"CASE WHEN {n}_r >= {n}_c AND {n}_r >= {n}_d THEN 'resonate' WHEN {n}_c >= {n}_d THEN 'contradict' ELSE 'diverge' END AS dominant_{n}" for n in ('think', 'feel'))}, CAST(1 AS INTEGER) AS match_count,
    least(greatest(round_even(CAST(0.3 AS DOUBLE) * coalesce(CAST(least(wa, wb) AS DOUBLE) / nullif(greatest(wa, wb), 0), 0) + CAST(0.4 AS DOUBLE) * (CAST(1 AS DOUBLE) / 3) + CAST(0.3 AS DOUBLE) * (greatest(think_r, think_c, think_d) + greatest(feel_r, feel_c, feel_d)) / 200, 2), CAST(0.2 AS DOUBLE)), CAST(0.95 AS DOUBLE)) AS confidence FROM h"""


@query("ag21_given_scores", _GIVEN.format(_QUIET))
def ag21_given_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21, UF02, JN21, AJ06, MA05, MA06: scores of what a scorer answered, as JSON, on given claims."""
    p = given_pairs(spark, sf_dir)
    m, a, b = scoring_of(F.col("answers"))
    return aggregate_scores(evaluated(p, matched=m, unmatched_a=a, unmatched_b=b), ["run_id"])


@query("ag21_offline_scores", _GIVEN.format("CAST(1 AS DOUBLE)"))
def ag21_offline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21: the offline form, in which every claim left over counts whole."""
    p = given_pairs(spark, sf_dir)
    m, a, b = scoring_of(F.col("answers"))
    return aggregate_scores(evaluated(p, matched=m, unmatched_a=a, unmatched_b=b), ["run_id"], offline=True)


@query(
    "jn23_cached_claims",
    r"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY user_id, book_id, passage_id ORDER BY created_at DESC NULLS LAST, interpretation_id DESC NULLS LAST) AS k FROM interpretations WHERE book_id IS NOT NULL AND passage_id IS NOT NULL AND regexp_matches(interpretation, '\S'))
    SELECT user_id, book_id, passage_id, CAST(greatest(len(list_filter(string_split(regexp_replace(regexp_replace(interpretation, '([.!?])\s+', '\1'||chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g')) >= 3)), 1) AS INTEGER) AS n_claims, false AS from_cache FROM m WHERE k = 1""",
)
def jn23_cached_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN23, O7, SM06: latest claims per reader, passage and book; only texts without any are split."""
    return cached_split(table(spark, sf_dir, "interpretations"))

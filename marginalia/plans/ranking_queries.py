"""Queries of votes and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from marginalia.functions.rounding import half_even
from marginalia.operators.bradley_terry import blend_weights, blended, counted, engagement, global_fit, per_user_fit, run_engagement, weighted
from marginalia.operators.dedup import latest
from marginalia.plans.registry import query, with_once
from marginalia.session import cut_lineage
from marginalia.tables import table

VOTES = with_once("votes")


def number(c: str):
    return F.trim(c).try_cast("double").try_cast("long")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(comparison_id, user_id, w, l) of each vote once, between two different runs."""
    once = latest(table(spark, sf_dir, "comparisons"), ["comparison_id"], "ingested_at")
    return once.select("comparison_id", "user_id", number("winner_run_id").alias("w"), number("loser_run_id").alias("l")).filter("w != l")


def engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, run_id, engagement): how sure a reader last was of a run, in 0..1, votes on a scale of hundreds brought to it; the tables have no other sign of engagement."""
    c = table(spark, sf_dir, "comparisons")
    sure = F.when(F.col("winner_confidence") > 1, F.col("winner_confidence") / 100).otherwise(F.col("winner_confidence"))
    return engagement(c.select("user_id", number("winner_run_id").alias("run_id"), F.when(sure.between(0, 1), sure).alias("value"), F.col("logged_at").alias("at")).filter("run_id IS NOT NULL"))


_ENGAGED = "e AS (SELECT user_id, TRY_CAST(TRY_CAST(trim(winner_run_id) AS DOUBLE) AS BIGINT) AS run_id, CASE WHEN winner_confidence > 1 THEN winner_confidence / 100 ELSE winner_confidence END AS v, logged_at FROM comparisons), o AS (SELECT user_id, run_id, arg_max(v, (logged_at, v)) AS engagement FROM e WHERE run_id IS NOT NULL AND v BETWEEN 0 AND 1 GROUP BY 1, 2)"


@query("ag24_engagement", f"WITH {_ENGAGED} SELECT * FROM o")
def ag24_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24: the last value of each user and run."""
    return engagements(spark, sf_dir)


@query("ag24_run_engagement", f"WITH {_ENGAGED} SELECT run_id, max(engagement) AS engagement FROM o GROUP BY 1")
def ag24_run_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24: the largest of each run over users."""
    return run_engagement(engagements(spark, sf_dir))


@query("ag24_vote_weights", f"{VOTES}, {_ENGAGED} SELECT votes.user_id, w, l, count(*) AS n, count(*) * (1 + coalesce(any_value(engagement), 0)) AS weight FROM votes LEFT JOIN o ON votes.user_id = o.user_id AND votes.w = o.run_id WHERE w <> l GROUP BY 1, 2, 3")
def ag24_vote_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24, AG25: a user's votes on a pair, and their weight in the fit: 1 and the winner's engagement each."""
    return weighted(counted(votes(spark, sf_dir)), engagements(spark, sf_dir), ["user_id"])


@query("ag24_vote_counts", f"{VOTES} SELECT user_id, count(*) AS n_comparisons, count(DISTINCT w) AS winners, CAST(max(w) AS BIGINT) AS last_run FROM votes WHERE w <> l GROUP BY user_id")
def ag24_vote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes per user."""
    return votes(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_comparisons"), F.count_distinct("w").alias("winners"), F.max("w").alias("last_run"))


@query("st04_items", f"{VOTES}, i AS (SELECT w AS run_id FROM votes WHERE w <> l UNION SELECT l FROM votes WHERE w <> l) SELECT run_id, EXISTS (SELECT 1 FROM compat_runs c WHERE c.run_id = i.run_id) AS known FROM i")
def st04_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST01, ST03, ST04: all items that were voted on, and whether they are runs."""
    v = votes(spark, sf_dir)
    items = v.select(F.col("w").alias("run_id")).union(v.select("l")).distinct()
    runs = table(spark, sf_dir, "compat_runs").select("run_id").distinct().withColumn("k", F.lit(True))
    return items.join(runs, "run_id", "left").select("run_id", F.coalesce("k", F.lit(False)).alias("known"))


def fits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Strengths per user, and over all votes, weighted by engagement. Rankings read those of users twice; they are fitted once."""
    pairs, own = counted(votes(spark, sf_dir)), engagements(spark, sf_dir)
    return cut_lineage(per_user_fit(weighted(pairs, own, ["user_id"]))), global_fit(weighted(pairs.groupBy("w", "l").agg(F.sum("n").alias("n")), run_engagement(own), []))


@query("ag25_user_strengths")
def ag25_user_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG25, MA10, UF07, H1, T17: a weighted fit per user with enough votes."""
    return per_user_fit(weighted(counted(votes(spark, sf_dir)), engagements(spark, sf_dir), ["user_id"]))


@query("ag25_global_strengths")
def ag25_global_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG25: one weighted fit over all votes."""
    return global_fit(weighted(counted(votes(spark, sf_dir)).groupBy("w", "l").agg(F.sum("n").alias("n")), run_engagement(engagements(spark, sf_dir)), []))


@query("ma08_blend_weights", f"{VOTES}, n AS (SELECT user_id, count(*) AS n FROM votes WHERE w <> l GROUP BY user_id) SELECT user_id, n, round_even(CAST(1 AS DOUBLE) - least(CAST(0.7 AS DOUBLE), CAST(0.1 AS DOUBLE) + n / CAST(50 AS DOUBLE) * CAST(0.6 AS DOUBLE)), 2) AS conf_weight, round_even(least(CAST(0.7 AS DOUBLE), CAST(0.1 AS DOUBLE) + n / CAST(50 AS DOUBLE) * CAST(0.6 AS DOUBLE)), 2) AS bt_weight FROM n")
def ma08_blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA08, D1."""
    n = votes(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    c, b = blend_weights(F.col("n"))
    return n.select("user_id", "n", c.alias("conf_weight"), b.alias("bt_weight"))


@query("wn03_rankings")
def wn03_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN03, WN06, SL04, ST02, ST10, PRJ10, O11: top five of every reader, book and passage in one window."""
    counts = votes(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_comparisons"))
    own, fallback = fits(spark, sf_dir)
    return blended(table(spark, sf_dir, "compat_runs"), own.drop("n_comparisons"), fallback, counts)


_TEN = "round_even((CAST(run_id * 7919 % 1000 AS DOUBLE) + 1) / 1000, 6)"


@query(
    "wn03_blend",
    f"""{VOTES}, n AS (SELECT user_id, count(*) AS n FROM votes WHERE w <> l GROUP BY 1), g AS (SELECT run_id, {_TEN} AS bt FROM compat_runs WHERE run_id % 3 <> 0), b AS (SELECT run_id, book_id, passage_id, confidence, user_a AS user_id, user_b AS match_user FROM compat_runs UNION ALL SELECT run_id, book_id, passage_id, confidence, user_b, user_a FROM compat_runs),
    c AS (SELECT b.*, coalesce(n.n, 0) AS n_comparisons, coalesce(bt, 0) AS bt, max(coalesce(bt, 0)) OVER (PARTITION BY user_id, book_id, passage_id) AS top FROM b LEFT JOIN g ON b.run_id = g.run_id LEFT JOIN n USING (user_id)),
    w AS (SELECT *, round_even(CAST(1 AS DOUBLE) - least(CAST(0.7 AS DOUBLE), CAST(0.1 AS DOUBLE) + n_comparisons / CAST(50 AS DOUBLE) * CAST(0.6 AS DOUBLE)), 2) AS cw, round_even(least(CAST(0.7 AS DOUBLE), CAST(0.1 AS DOUBLE) + n_comparisons / CAST(50 AS DOUBLE) * CAST(0.6 AS DOUBLE)), 2) AS bw FROM c),
    s AS (SELECT *, round_even(CASE WHEN top > 0 THEN cw * confidence + bw * bt / top ELSE confidence END, 4) AS blend_score FROM w), r AS (SELECT user_id, book_id, passage_id, CAST(row_number() OVER (PARTITION BY user_id, book_id, passage_id ORDER BY blend_score DESC, run_id) AS INTEGER) AS rank_position, run_id, match_user, n_comparisons, blend_score FROM s) SELECT * FROM r WHERE rank_position <= 5""",
)
def wn03_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN03, WN06, MA08, SL04, ST10: the same blend from given strengths, here made from the runs' ids, which some runs lack."""
    runs = table(spark, sf_dir, "compat_runs")
    given = runs.filter("run_id % 3 <> 0").select("run_id", half_even(((F.col("run_id") * 7919 % 1000).cast("double") + 1) / 1000, 6).alias("bt_score"))
    counts = votes(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_comparisons"))
    return blended(runs, given.limit(0).withColumn("user_id", F.lit("")), given, counts)


@query(
    "wn04_ranks",
    """WITH e AS (SELECT run_id, user_a AS user_id, user_b AS match_user, book_id, confidence FROM compat_runs UNION ALL SELECT run_id, user_b, user_a, book_id, confidence FROM compat_runs)
    SELECT user_id, run_id, match_user, book_id, CAST(row_number() OVER (PARTITION BY user_id, book_id ORDER BY confidence DESC, run_id) AS INTEGER) AS book_rank, CAST(row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, run_id) AS INTEGER) AS profile_rank FROM e""",
)
def wn04_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN04, WN05, O2: ranks within book and profile from both sides of each run."""
    e = edges(table(spark, sf_dir, "compat_runs"))
    rank = lambda *k: F.row_number().over(W.partitionBy(*k).orderBy(F.desc("confidence"), "run_id"))
    return e.select("user_id", "run_id", "match_user", "book_id", rank("user_id", "book_id").alias("book_rank"), rank("user_id").alias("profile_rank"))


def edges(runs: DataFrame) -> DataFrame:
    """Each run once for either of its users: an equi-join can follow where a join on 'a or b' would be a nested loop."""
    side = lambda a, b: F.struct(F.col(a).alias("user_id"), F.col(b).alias("match_user"))
    return runs.withColumn("__s", F.explode(F.array(side("user_a", "user_b"), side("user_b", "user_a")))).select(*runs.columns, "__s.*")


@query("wn01_dedup_on_read", "SELECT comparison_id, CAST(count(*) AS BIGINT) AS deliveries, CAST(epoch_us(max(ingested_at)) AS BIGINT) AS last_us FROM comparisons GROUP BY comparison_id HAVING count(*) > 1")
def wn01_dedup_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN01, WN02, SM04: the last delivery of those that came more than once."""
    c = table(spark, sf_dir, "comparisons")
    n = c.groupBy("comparison_id").agg(F.count("*").alias("deliveries")).filter("deliveries > 1")
    return latest(c, ["comparison_id"], "ingested_at").join(n, "comparison_id").select("comparison_id", "deliveries", F.unix_micros("ingested_at").alias("last_us"))


@query("wn09_top_per_verdict", "WITH r AS (SELECT dominant_think, run_id, confidence, CAST(row_number() OVER (PARTITION BY dominant_think ORDER BY confidence DESC, run_id) AS INTEGER) AS place FROM compat_runs) SELECT * FROM r WHERE place <= 3")
def wn09_top_per_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN09: the three surest runs of each kind."""
    place = F.row_number().over(W.partitionBy("dominant_think").orderBy(F.desc("confidence"), "run_id"))
    return table(spark, sf_dir, "compat_runs").select("dominant_think", "run_id", "confidence", place.alias("place")).filter("place <= 3")

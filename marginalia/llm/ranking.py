"""One global ranking from pairwise comparisons (problem 4): a comparison Markov chain.

A walker on the items moves from a loser towards the winners of its lost votes, at
rates normalised by all it lost, smoothed by half a vote against an item of middling
strength. The chain's stationary distribution, by power iteration, gives the
strengths. Walking at equal rates wastes some of the votes' information: a few items
come out far too strong. So the rates are then divided by the sum of the two
strengths and the stationary distribution is taken again, until it moves no more; its
fixed point is the likelihood's maximum for the model P(i beats j) = s_i / (s_i + s_j).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.operators.order import median, placed
from marginalia.session import cut_lineage

#: Smoothing votes of each item; the largest move of a log strength at the end of the power steps of one set of rates, and at the end of all.
PRIOR, STEP_MOVE, MOVE = 0.5, 3e-3, 1e-3
#: Most power steps for one set of rates, most sets of rates; a ranking that needs more raises an error.
STEPS, ROUNDS = 60, 200
#: Items up to which their strengths (8 bytes each) are held by the driver and sent to the tasks at each step; beyond it they are joined.
SENT_ITEMS = 5_000_000

__all__ = ["placed", "ranked", "run_id", "strengths", "valid_votes"]


def run_id(text: Column) -> Column:
    """A run id written as text in any way: spaces around, leading zeros, a decimal point and zeros."""
    number = F.trim(F.regexp_replace(text, r"[\s ]+", " "))
    whole = F.regexp_replace(number, r"\.0*$", "")
    return F.coalesce(whole.try_cast("long"), F.when(number.try_cast("double") == F.floor(number.try_cast("double")), number.try_cast("double").try_cast("long")))


def valid_votes(comparisons: DataFrame, runs: DataFrame) -> DataFrame:
    """(winner, loser, n): votes with two different, known runs, each comparison_id once; a null id is a vote of its own.

    Votes of a pair are counted before they are joined with the runs, so a hot run has
    at most a row per opponent.
    """
    votes = comparisons.select("comparison_id", run_id(F.col("winner_run_id")).alias("winner"), run_id(F.col("loser_run_id")).alias("loser")).filter(F.col("winner") != F.col("loser"))
    once = votes.filter(F.col("comparison_id").isNotNull()).groupBy("comparison_id").agg(F.min(F.struct("winner", "loser")).alias("v")).select("v.*")
    pairs = once.unionByName(votes.filter(F.col("comparison_id").isNull()).select("winner", "loser")).groupBy("winner", "loser").agg(F.count("*").alias("n"))
    known = runs.select(F.col("run_id").cast("long").alias("id")).dropna().distinct()
    return pairs.join(known.withColumnRenamed("id", "winner"), "winner", "left_semi").join(known.withColumnRenamed("id", "loser"), "loser", "left_semi")


def settle(wins: np.ndarray, losses: np.ndarray, flows: Callable[[np.ndarray | None, np.ndarray], tuple[np.ndarray, np.ndarray]], prior: float = PRIOR, move: float = MOVE) -> np.ndarray:
    """Strengths, of mean log 0: power iteration of the chain, whose rates are divided by the sum of the two strengths and which is walked again, until no log strength moves by `move`.

    `flows(rated, z)`: per item what comes in and the rates that go out when the walker
    is spread as z, at rates divided by sums of `rated`, or undivided.
    """
    level = lambda z: z / np.exp(np.log(z).mean()) if len(z) else z
    z = level((wins + 1.0) / (losses + 1.0))
    rated = None
    for _ in range(ROUNDS):
        smooth = np.full(len(z), prior) if rated is None else prior / 2 / (rated + 1)
        for _ in range(STEPS):
            coming, leaving = flows(rated, z)
            new = level((coming + smooth) / (leaving + smooth))
            far = np.abs(np.log(new) - np.log(z)).max(initial=0.0)
            z = new
            if far < STEP_MOVE:
                break
        moved = np.inf if rated is None else np.abs(np.log(z) - np.log(rated)).max(initial=0.0)
        rated = z
        if moved < move:
            return z
    raise ArithmeticError("the strengths don't settle")


def strengths(votes: DataFrame, items: DataFrame, prior: float = PRIOR, move: float = MOVE, sent: int = SENT_ITEMS) -> DataFrame:
    """(item, n_votes, n_wins, strength) of every item of `items` (item, unique), from votes (winner, loser, n); the middling strength is 1.

    An item without votes has strength 1. Without any vote all have 1. Votes stay on the
    executors: of each step they send a number per item.
    """
    spark = votes.sparkSession
    edges = cut_lineage(votes.groupBy("winner", "loser").agg(F.sum("n").alias("n")))
    wins = edges.groupBy(F.col("winner").alias("item")).agg(F.sum("n").alias("n_wins"))
    losses = edges.groupBy(F.col("loser").alias("item")).agg(F.sum("n").alias("n_losses"))
    nodes = cut_lineage(items.join(wins, "item", "left").join(losses, "item", "left").na.fill(0, ["n_wins", "n_losses"]))
    counts = nodes.select("item", (F.col("n_wins") + F.col("n_losses")).alias("n_votes"), "n_wins")
    if nodes.count() > sent:
        return _joined(edges, nodes, prior, move).join(counts, "item").select("item", "n_votes", "n_wins", F.col("z").alias("strength"))
    held = nodes.toPandas().sort_values("item").reset_index(drop=True)
    n = len(held)
    code = spark.createDataFrame(held[["item"]].assign(k=range(n)), "item long, k long")
    coded = cut_lineage(edges.join(code.select(F.col("item").alias("winner"), F.col("k").alias("a")), "winner").join(code.select(F.col("item").alias("loser"), F.col("k").alias("b")), "loser").select("a", "b", "n"))
    blocks = coded.rdd.mapPartitions(lambda rows: [np.array(list(rows), float).reshape(-1, 3)]).map(lambda x: (x[:, 0].astype(np.int64), x[:, 1].astype(np.int64), x[:, 2])).persist()

    def flows(rated: np.ndarray | None, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        given = spark.sparkContext.broadcast((rated, z))

        def one(x: tuple) -> np.ndarray:
            a, b, votes_ = x
            rated_, z_ = given.value
            rate = votes_ if rated_ is None else votes_ / (rated_[a] + rated_[b])
            return np.stack([np.bincount(a, rate * z_[b], n), np.bincount(b, rate, n)])

        out = blocks.map(one).treeReduce(np.add) if blocks.getNumPartitions() else np.zeros((2, n))
        given.destroy()
        return out[0], out[1]

    z = settle(held["n_wins"].to_numpy(float), held["n_losses"].to_numpy(float), flows, prior, move)
    blocks.unpersist()
    return counts.join(spark.createDataFrame(held[["item"]].assign(strength=z), "item long, strength double"), "item")


def _joined(edges: DataFrame, nodes: DataFrame, prior: float, move: float) -> DataFrame:
    """(item, z) by the same iteration as `settle`, with the strengths in DataFrames: a step is two joins and two sums."""
    log_mean = lambda df: float(df.agg(F.avg(F.log("z"))).first()[0] or 0.0)
    level = lambda df: df.withColumn("z", F.col("z") / F.exp(F.lit(log_mean(df))))
    far = lambda a, b: a.join(b.select("item", F.col("z").alias("z0")), "item").agg(F.max(F.abs(F.log("z") - F.log("z0")))).first()[0] or 0.0
    z, rated = level(nodes.select("item", ((F.col("n_wins") + 1) / (F.col("n_losses") + 1)).alias("z"))), None
    for _ in range(ROUNDS):
        if rated is None:
            rates, smooth = edges.withColumn("r", F.col("n").cast("double")), nodes.select("item", F.lit(prior).alias("smooth"))
        else:
            side = lambda c: rated.select(F.col("item").alias(c), F.col("z").alias(f"z_{c}"))
            rates = edges.join(side("winner"), "winner").join(side("loser"), "loser").withColumn("r", F.col("n") / (F.col("z_winner") + F.col("z_loser")))
            smooth = rated.select("item", (F.lit(prior / 2) / (F.col("z") + 1)).alias("smooth"))
        rates = cut_lineage(rates.select("winner", "loser", "r"))
        fixed = cut_lineage(smooth.join(rates.groupBy(F.col("loser").alias("item")).agg(F.sum("r").alias("leaving")), "item", "left").na.fill(0.0, ["leaving"]))
        for _ in range(STEPS):
            flow = rates.join(z.select(F.col("item").alias("loser"), "z"), "loser").groupBy(F.col("winner").alias("item")).agg(F.sum(F.col("r") * F.col("z")).alias("coming"))
            new = cut_lineage(level(cut_lineage(fixed.join(flow, "item", "left").select("item", ((F.coalesce("coming", F.lit(0.0)) + F.col("smooth")) / (F.col("leaving") + F.col("smooth"))).alias("z")))))
            step = far(new, z)
            z = new
            if step < STEP_MOVE:
                break
        moved = float("inf") if rated is None else far(z, rated)
        rated = z
        if moved < move:
            return z
    raise ArithmeticError("the strengths don't settle")


def ranked(strength: DataFrame) -> DataFrame:
    """(item, n_votes, n_wins, strength, odds): odds of winning against an item of median strength."""
    strength = cut_lineage(strength)
    return strength.withColumn("odds", F.col("strength") / F.lit(median(strength, F.col("strength"))).cast("double"))

"""Bradley-Terry fits and blended rankings (AG24, AG25, MA08, MA10, WN03-WN06, UF07)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.functions.rounding import half_even
from marginalia.session import cut_lineage
from marginalia.tables import spread

#: Prior of survey H1: so many votes won and lost by each item against one of strength 1. A fit ends where no log strength moves by TOLERANCE.
MIN_COMPARISONS, PRIOR, TOLERANCE = 5, 1e-3, 1e-7
#: Most steps of a fit and of the solution of each; a fit that needs more raises an error.
STEPS, INNER = 200, 2000
#: Least share of the prior's curvature far from the maximum, where the prior is all but straight.
FLOOR = 0.1
#: Pairs of one fit up to which it is done in one task, and pairs of small fits that a task works on at once.
GATHERED_PAIRS, BATCH_PAIRS = 1_000_000, 50_000
#: Items up to which the strengths of a fit (8 bytes each) are held by the driver and sent to the tasks.
SENT_ITEMS = 5_000_000
#: Bytes of the tasks' sums up to which the driver adds them itself; more are added by the executors first.
SENT_BYTES = 64_000_000


def maximum(group: np.ndarray, state: Callable[[np.ndarray], np.ndarray], curvature: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]], prior: float = PRIOR) -> np.ndarray:
    """Log strengths at the maximum of the votes' likelihood with the prior, by Newton's method; each step is solved by conjugate gradients.

    `group` numbers the fit that an item belongs to: fits are independent. The votes are
    seen only through `state` (see `vote_state`) and `curvature`, which gives the product
    with their curvature at some log strengths; both may be worked out anywhere. A step is
    solved as exactly as the last one was short, and the least curvature that keeps steps
    far out bounded vanishes with it, so the last steps are full ones of Newton's. The
    likelihood has one maximum; a step that goes too far beyond the highest point of its
    direction is halved, so any start leads there.
    """
    n, k = len(group), int(group.max()) + 1 if len(group) else 0
    each = lambda x: np.bincount(group, x, k)
    of = lambda x, y: np.divide(x, y, out=np.zeros(k), where=y > 0)[group]

    def seen(t: np.ndarray) -> tuple[np.ndarray, ...]:
        up, down, diagonal, height = state(t)
        even = np.exp(-np.logaddexp(0, -t))
        return up - down + prior * (1 - 2 * even), diagonal, 2 * even * (1 - even), each(height + prior * (t - 2 * np.logaddexp(0, t)))

    def gradients(product: Callable[[np.ndarray], np.ndarray], slope: np.ndarray, diagonal: np.ndarray, bend: np.ndarray, exact: np.ndarray) -> np.ndarray:
        scale = 1 / (bend + diagonal)
        x, r = np.zeros(n), slope.copy()
        z = scale * r
        p, rz = z.copy(), each(r * z)
        least = rz * exact**2 + 1e-300
        for _ in range(INNER):
            if not (rz > least).any():
                break
            q = product(p) + bend * p
            step = of(np.where(rz > least, rz, 0), each(p * q))
            x += step * p
            r -= step * q
            z = scale * r
            new = each(r * z)
            p = z + of(new, rz) * p
            rz = new
        return x

    t, most = np.zeros(n), np.ones(k)
    slope, diagonal, own, now = seen(t)
    for _ in range(STEPS):
        bend = prior * np.maximum(own, FLOOR * np.minimum(1, most)[group])
        x = gradients(curvature(t), slope, diagonal, bend, np.clip(most, TOLERANCE, 0.1))
        most = np.zeros(k)
        np.maximum.at(most, group, np.abs(x))
        if most.max(initial=0) < TOLERANCE:
            return t + x
        part, gain = np.ones(k), each(slope * x)
        for _ in range(60):
            there = seen(t + part[group] * x)
            turn = each(there[0] * x)
            # short of the highest point of the direction, higher by enough, or as high as rounding can tell and close to that point
            good = (turn >= 0) | (there[3] >= now + 1e-4 * part * gain) | (turn > -gain / 2) & (there[3] >= now - 1e-11 * np.abs(now))
            short = ~good & (part * most > TOLERANCE)
            if not short.any():
                break
            part[short] /= 2
        t, (slope, diagonal, own, now) = t + part[group] * x, there
    raise ArithmeticError("the strengths don't settle")


def vote_state(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int, t: np.ndarray) -> np.ndarray:
    """Sums per item of votes (winner a, loser b, weight) at log strengths t: wins and losses beyond the expected ones, the curvature's diagonal, the likelihood's height."""
    d = t[a] - t[b]
    over = np.logaddexp(0, -d)
    w = weight * np.exp(-over - d)
    c = w * np.exp(-over)
    return np.stack([np.bincount(a, w, n), np.bincount(b, w, n), np.bincount(a, c, n) + np.bincount(b, c, n), np.bincount(a, -weight * over, n)])


def vote_bend(a: np.ndarray, b: np.ndarray, weight: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Curvature of each vote at log strengths t."""
    d = t[a] - t[b]
    return weight * np.exp(-np.logaddexp(0, -d) - np.logaddexp(0, d))


def vote_product(a: np.ndarray, b: np.ndarray, bend: np.ndarray, n: int, v: np.ndarray) -> np.ndarray:
    """Product of the votes' curvature with v."""
    c = bend * (v[a] - v[b])
    return np.bincount(a, c, n) - np.bincount(b, c, n)


def fit_each(group: np.ndarray, winner: np.ndarray, loser: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, items, strengths of sum 1 in each group) at the maximum for weighted votes of independent fits, numbered by `group`, all at once; the prior keeps separable data finite."""
    names, code = np.unique(np.concatenate([winner, loser]), return_inverse=True)
    held, code = np.unique(np.concatenate([group, group]) * len(names) + code, return_inverse=True)
    a, b, n = code[: len(winner)], code[len(winner) :], len(held)
    g, items = held // max(1, len(names)), names[held % max(1, len(names))]

    def curvature(t: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        bend = vote_bend(a, b, weight, t)
        return lambda v: vote_product(a, b, bend, n, v)

    return g, items, shares(maximum(g, lambda t: vote_state(a, b, weight, n, t), curvature), g)


def shares(t: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Strengths of sum 1 in each group from log strengths; the groups stand in order and none is empty."""
    if not len(t):
        return t
    s = np.exp(t - np.maximum.reduceat(t, np.flatnonzero(np.diff(group, prepend=-1)))[group])
    return s / np.bincount(group, s)[group]


def fit(winner: np.ndarray, loser: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items, strengths of sum 1) of one fit."""
    return fit_each(np.zeros(len(winner), int), winner, loser, weight)[1:]


def counted(votes: DataFrame) -> DataFrame:
    """(user_id, w, l, n): votes counted by user and pair, before anything is joined or gathered."""
    return votes.groupBy("user_id", "w", "l").agg(F.count("*").alias("n"))


def engagement(values: DataFrame) -> DataFrame:
    """(user_id, run_id, engagement) from (user_id, run_id, value, at): the last value of each user and run; nulls are no values, ties go to the larger one."""
    last = F.max(F.struct("at", "value"))["value"]
    return values.filter(F.col("value").isNotNull()).groupBy("user_id", "run_id").agg(last.alias("engagement"))


def run_engagement(own: DataFrame) -> DataFrame:
    """(run_id, engagement): the largest over users."""
    return own.groupBy("run_id").agg(F.max("engagement").alias("engagement"))


def weighted(pairs: DataFrame, values: DataFrame | None, by: list[str]) -> DataFrame:
    """Counted votes with their weight: 1 and the winner's engagement each; `by`: keys of `values` besides the run."""
    if values is None:
        return pairs.withColumn("weight", F.col("n").cast("double"))
    joined = pairs.join(values.withColumnRenamed("run_id", "w"), [*by, "w"], "left")
    return joined.withColumn("weight", F.col("n") * (1 + F.coalesce("engagement", F.lit(0.0)))).drop("engagement")


def per_user_fit(pairs: DataFrame, least: int = MIN_COMPARISONS, gathered: int = GATHERED_PAIRS) -> DataFrame:
    """(user_id, run_id, bt_score, n_comparisons) of each user with at least `least` votes.

    `pairs`: (user_id, w, l, n, weight), a row per user and pair. Users with up to
    `gathered` pairs are fitted in memory, many small ones at once in a task; for those
    with more the same fit runs over their pairs where they lie, so no task ever holds an
    unbounded group.
    """
    pairs = cut_lineage(pairs.select("user_id", "w", "l", "n", "weight"))
    sizes = pairs.groupBy("user_id").agg(F.sum("n").alias("n_comparisons"), F.count("*").alias("n_pairs")).filter(F.col("n_comparisons") >= least)
    small = pairs.join(sizes.filter(F.col("n_pairs") <= gathered).drop("n_pairs"), "user_id")

    def run(t: pa.Table) -> pa.Table:
        users = t["user_id"].combine_chunks().dictionary_encode()
        names = users.dictionary.to_pylist()
        place = np.empty(len(names), int)
        place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        user, w, l, weight, n = place[users.indices.to_numpy()], *(t[c].to_numpy() for c in ("w", "l", "weight", "n_comparisons"))
        at = np.lexsort((l, w, user))
        g, items, s = fit_each(user[at], w[at], l[at], weight[at])
        votes = np.zeros(len(names), np.int64)
        votes[user] = n
        return pa.table({"user_id": pa.array(sorted(names), pa.string()).take(pa.array(g)), "run_id": items, "bt_score": np.round(s, 6), "n_comparisons": votes[g]})

    few = F.col("n_pairs") <= gathered
    size = sizes.agg(F.sum(F.when(few, F.col("n_pairs"))).alias("small"), F.count_if(~few).alias("large")).first()
    batches = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-(size["small"] or 0) // BATCH_PAIRS))
    dealt = spread(small.withColumn("batch", F.pmod(F.xxhash64("user_id"), F.lit(batches))), "batch")
    out = dealt.groupBy("batch").applyInArrow(lambda t: run(t.drop_columns("batch")), "user_id string, run_id long, bt_score double, n_comparisons long")
    if not size["large"]:
        return out
    large = sizes.filter(F.col("n_pairs") > gathered).drop("n_pairs")
    big = spread_fit(pairs.join(large.select("user_id"), "user_id", "left_semi"), ["user_id"])
    return out.unionByName(big.join(large, "user_id").select("user_id", "run_id", "bt_score", "n_comparisons"))


def global_fit(pairs: DataFrame, gathered: int = GATHERED_PAIRS) -> DataFrame:
    """(run_id, bt_score) over all votes (w, l, weight): up to `gathered` pairs in one task, more by the same fit where they lie."""
    pairs = cut_lineage(pairs.groupBy("w", "l").agg(F.sum("weight").alias("weight")))
    if pairs.count() > gathered:
        return spread_fit(pairs, [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "l"])
        items, s = fit(pdf["w"].to_numpy(), pdf["l"].to_numpy(), pdf["weight"].to_numpy(float))
        return pd.DataFrame({"run_id": items, "bt_score": np.round(s, 6)})

    return pairs.groupBy().applyInPandas(run, "run_id long, bt_score double")


def spread_fit(pairs: DataFrame, by: list[str], sent: int = SENT_ITEMS) -> DataFrame:
    """(by…, run_id, bt_score) of each group: votes never leave the executors, the driver holds a number per item.

    More than `sent` items are refused: their strengths are past what a driver should hold.
    """
    spark = pairs.sparkSession
    ends = pairs.select(*by, F.col("w").alias("i")).unionByName(pairs.select(*by, F.col("l").alias("i")))
    nodes = cut_lineage(ends.distinct())
    if (n := nodes.count()) > sent:
        raise ValueError(f"{n} items in one fit, more than {sent}")
    held = nodes.toArrow().to_pandas().sort_values([*by, "i"]).reset_index(drop=True)
    group = held.groupby(by).ngroup().to_numpy() if by else np.zeros(n, int)
    coded = spark.createDataFrame(pa.Table.from_pandas(held[[*by, "i"]].assign(k=range(n)), preserve_index=False))
    code = lambda c, k: coded.select(*by, F.col("i").alias(c), F.col("k").alias(k))
    rows = cut_lineage(pairs.join(code("w", "a"), [*by, "w"]).join(code("l", "b"), [*by, "l"]).select("a", "b", "weight"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in x.columns] for x in batches if x.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in zip(*parts)], names=["a", "b", "weight"])

    blocks = rows.mapInArrow(packed, "a binary, b binary, weight binary").rdd.map(lambda r: tuple(np.frombuffer(x, kind) for x, kind in zip(r, (np.int64, np.int64, np.float64)))).persist()
    parts = blocks.getNumPartitions()

    def summed(of: Callable[[tuple], np.ndarray], rows: int) -> np.ndarray:
        return blocks.map(of).treeReduce(np.add, 1 if 8 * n * rows * parts <= SENT_BYTES else 2)

    def state(t: np.ndarray) -> np.ndarray:
        there = spark.sparkContext.broadcast(t)
        out = summed(lambda x: vote_state(*x, n, there.value), 4)
        there.destroy()
        return out

    held_at: list = []

    def curvature(t: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        while held_at:
            held_at.pop().destroy()
        there = spark.sparkContext.broadcast(t)
        held_at.append(there)

        def product(v: np.ndarray) -> np.ndarray:
            to = spark.sparkContext.broadcast(v)
            out = summed(lambda x: vote_product(x[0], x[1], vote_bend(*x, there.value), n, to.value), 1)
            to.destroy()
            return out

        return product

    t = maximum(group, state, curvature)
    blocks.unpersist()
    score = np.round(shares(t, group), 6)
    return spark.createDataFrame(pa.Table.from_pandas(held[[*by, "i"]].rename(columns={"i": "run_id"}).assign(bt_score=score), preserve_index=False))


def blend_weights(n: Column) -> tuple[Column, Column]:
    """(confidence's, votes') weights by the number of votes."""
    bt = F.least(F.lit(0.7), F.lit(0.1) + n / F.lit(50.0) * F.lit(0.6))
    return half_even(F.lit(1.0) - bt, 2), half_even(bt, 2)


def blended(runs: DataFrame, scores: DataFrame, fallback: DataFrame, counts: DataFrame, k: int = 5) -> DataFrame:
    """Top k runs of each user, book and passage.

    `runs` has a row per run; each counts for both of its users. A user without own
    `scores` is ranked by the `fallback` ones; without any signal among the candidates
    by confidence alone. Ties go by run_id.
    """
    both = runs.select("run_id", "book_id", "passage_id", "confidence", F.explode(F.array(F.struct(F.col("user_a").alias("user_id"), F.col("user_b").alias("match_user")), F.struct(F.col("user_b").alias("user_id"), F.col("user_a").alias("match_user")))).alias("x")).select("run_id", "book_id", "passage_id", "confidence", "x.*")
    have = scores.select("user_id").distinct().withColumn("own", F.lit(True))
    own = scores.select("user_id", "run_id", F.col("bt_score").alias("own_bt"))
    c = both.join(have, "user_id", "left").join(own, ["user_id", "run_id"], "left").join(fallback.withColumnRenamed("bt_score", "all_bt"), "run_id", "left").join(counts, "user_id", "left")
    bt = F.coalesce(F.when(F.col("own"), F.col("own_bt")).otherwise(F.col("all_bt")), F.lit(0.0))
    slot = W.partitionBy("user_id", "book_id", "passage_id")
    c = c.withColumn("bt", bt).withColumn("top", F.max("bt").over(slot)).withColumn("n", F.coalesce("n_comparisons", F.lit(0)))
    conf_w, bt_w = blend_weights(F.col("n"))
    signal = F.col("top") > 0
    score = F.when(signal, conf_w * F.col("confidence") + bt_w * F.col("bt") / F.col("top")).otherwise(F.col("confidence"))
    c = c.withColumn("blend_score", half_even(score, 4))
    place = F.row_number().over(slot.orderBy(F.desc("blend_score"), "run_id"))
    return c.withColumn("rank_position", place).filter(F.col("rank_position") <= k).select("user_id", "book_id", "passage_id", "rank_position", "run_id", "match_user", F.col("n").alias("n_comparisons"), "blend_score")

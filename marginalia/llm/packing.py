"""Filling containers of fixed capacity: a grouping genetic algorithm on islands (problem 9).

Items are dealt at random (by hash) into pools of a bounded size. Each pool is
solved by several islands that differ in seed. Between epochs every island hands
its elite solution to the next one; at last each pool keeps its best. All of a
pool's work is bounded, so any number of items is as many small tasks.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.bpe import load, slices
from marginalia.session import cut_lineage

POOL, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 1000, 2, 2, 8, 25


def best_fit(bins: list[list[int]], loads: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Put each item, largest first, into the fullest bin that takes it, else into a new one."""
    free = sorted((capacity - x, k) for k, x in enumerate(loads))
    for i in sorted(items, key=lambda i: -sizes[i]):
        s = sizes[i]
        at = bisect.bisect_left(free, (s, -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
            loads[k] += s
        else:
            room, k = capacity, len(bins)
            bins.append([i])
            loads.append(s)
        if room > s:
            bisect.insort(free, (room - s, k))


def fitness(loads: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: free space gathered in few bins."""
    return -len(loads), sum((x / capacity) ** 2 for x in loads)


def exchange(bins: list[list[int]], loads: list[int], loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Fill bins better from the loose items: one or two items of a bin against one or two loose ones that leave less room. The items left loose are smaller for it and easier to place."""
    pool = sorted((sizes[i], i) for i in loose)

    def largest(most: int, more: int, but: int = -1) -> int:
        """Place in the pool of the largest item of at most `most` and more than `more`; -1 without any."""
        at = bisect.bisect_right(pool, (most, 1 << 60)) - 1
        if at == but:
            at -= 1
        return at if at >= 0 and pool[at][0] > more else -1

    for k, x in enumerate(bins):
        for _ in range(len(x) + 1):
            room = capacity - loads[k]
            if not room or not pool:
                break
            best = (0, (), ())
            outs = [(i,) for i in x] + [(x[i], x[j]) for i in range(len(x)) for j in range(i)]
            for out in outs:
                gone = sum(sizes[i] for i in out)
                at = largest(gone + room, gone + best[0])
                if at >= 0:
                    best = (pool[at][0] - gone, out, (at,))
                for first in range(len(pool)):
                    rest = gone + room - pool[first][0]
                    if rest <= 0:
                        break
                    at = largest(rest, gone + best[0] - pool[first][0], first)
                    if at >= 0:
                        best = (pool[first][0] + pool[at][0] - gone, out, (first, at))
                if best[0] == room:
                    break
            gain, out, taken = best
            if not gain:
                break
            new = [pool[at][1] for at in taken]
            for at in sorted(taken, reverse=True):
                pool.pop(at)
            for i in out:
                x.remove(i)
                bisect.insort(pool, (sizes[i], i))
            x += new
            loads[k] += gain
    return [i for _, i in pool]


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of b go into a; bins of a that share an item with them are dissolved, and a few more as mutation; the items set free are exchanged into fuller bins, the rest placed by best fit."""
    full = sorted(range(len(b)), key=lambda k: -sum(sizes[i] for i in b[k]))
    chosen = [b[k] for k in rng.sample(full[: max(1, len(full) // 2)], max(1, min(len(full) // 12, 12)))]
    taken = {i for x in chosen for i in x}
    bins, loose = [list(x) for x in chosen], []
    for x in a:
        if taken.isdisjoint(x):
            bins.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    load = lambda k: sum(sizes[i] for i in bins[k])
    if len(bins) > 1:  # mutation: the emptiest bin is dissolved, and some at random
        doomed = {min(range(len(bins)), key=load), *rng.sample(range(len(bins)), min(len(bins) - 1, rng.randint(1, 4)))}
        loose += [i for k in doomed for i in bins[k]]
        bins = [x for k, x in enumerate(bins) if k not in doomed]
    loads = [load(k) for k in range(len(bins))]
    loose = exchange(bins, loads, loose, sizes, capacity)
    best_fit(bins, loads, loose, sizes, capacity)
    return bins


def evolve(sizes: list[int], capacity: int, elites: list[list[list[int]]], seed: int) -> list[list[int]]:
    """Best solution after GENERATIONS from the elites given and shuffled starts; ends early at the lower bound of bins."""
    rng = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    load_of = lambda bins: [sum(sizes[i] for i in x) for x in bins]
    score = lambda bins: fitness(load_of(bins), capacity)
    people = list(elites)
    while len(people) < POPULATION:
        bins: list[list[int]] = []
        loads: list[int] = []
        items = list(range(len(sizes)))
        if people:  # a start that differs: a random share is placed before the rest
            first = rng.sample(items, len(items) // 4)
            best_fit(bins, loads, first, sizes, capacity)
            items = list(set(items).difference(first))
        best_fit(bins, loads, items, sizes, capacity)
        people.append(bins)
        if len(bins) <= bound:
            return bins
    people.sort(key=score, reverse=True)
    for _ in range(GENERATIONS):
        if len(people[0]) <= bound:
            break
        for _ in range(POPULATION // 2):
            a, b = rng.sample(people, 2)
            people.append(crossover(a, b, sizes, capacity, rng))
        seen: dict[tuple, list[list[int]]] = {}
        for x in sorted(people, key=score, reverse=True):  # the same loads again are no further solution
            seen.setdefault(tuple(sorted(load_of(x))), x)
        people = list(seen.values())[:POPULATION]
        if len(people) < 2:
            people = people * 2
    return people[0]


def _groups(of: pd.Series) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(of):
        out.setdefault(k, []).append(i)
    return list(out.values())


def pack(items: DataFrame, n_items: int, capacity: int, id_cols: list[str], pool: int = POOL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(id_cols, size, pool, bin) with every item of `items` (id_cols, size <= capacity) in one bin.

    `n_items` is the table's row count; it only sets the number of pools. Items of
    size 0 take no room and go to the first bin. Equal ids stay apart as items.
    """
    pools = max(1, -(-n_items // pool))
    kinds = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in id_cols)
    schema = f"{kinds}, size int, pool int, island int, bin int"

    def epoch(number: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            # rows come from several islands in any order: put them into one order of items
            pdf = pdf.sort_values([*id_cols, "size"], kind="stable").reset_index(drop=True)
            own = pdf[pdf.origin == 0].reset_index(drop=True)
            elites = [_groups(g["bin"]) for _, g in pdf[pdf["bin"] >= 0].groupby("origin")]
            sizes = own["size"].tolist()
            live = [i for i, s in enumerate(sizes) if s > 0]
            if len(live) < len(sizes):
                back = {i: k for k, i in enumerate(live)}
                elites = [[y for x in e if (y := [back[i] for i in x if i in back])] for e in elites]
            bins = evolve([sizes[i] for i in live], capacity, elites, hash((int(own["pool"][0]), int(own["island"][0]), number)))
            of = np.zeros(len(sizes), np.int32)
            for k, x in enumerate(sorted(bins, key=lambda x: live[min(x)])):
                of[[live[i] for i in x]] = k
            return own.assign(bin=of)[[*id_cols, "size", "pool", "island", "bin"]]

        return run

    # equal ids would make the order of items differ between islands: ties in all columns are interchangeable
    state = items.select(*id_cols, "size", F.pmod(F.xxhash64(*id_cols), F.lit(pools)).cast("int").alias("pool")).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("bin", F.lit(-1))
    state = state.withColumn("origin", F.lit(0))
    for number in range(epochs):
        state = state.groupBy("pool", "island").applyInPandas(epoch(number), schema)
        if number < epochs - 1 and islands > 1:  # ring: the next island gets a copy of this one's elite
            state = state.withColumn("origin", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("island", F.when(F.col("origin") == 1, F.pmod(F.col("island") + 1, F.lit(islands))).otherwise(F.col("island")).cast("int"))
        else:
            state = state.withColumn("origin", F.lit(0))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        best = max((g for _, g in pdf.groupby("island")), key=lambda g: fitness(g.groupby("bin")["size"].sum().tolist(), capacity))
        return best[[*id_cols, "size", "pool", "bin"]]

    return state.groupBy("pool").applyInPandas(choose, f"{kinds}, size int, pool int, bin int")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, n_tokens); null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab, folder)
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(bpe.encode(t)) for t in b.column(1).to_pylist()], pa.int32())], names=[id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens int")


def fill_containers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, **kw) -> DataFrame:
    """(id, part_no, first_token, n_tokens, container) of every document.

    Only a document above the capacity is split: into full containers of its own
    and a rest that is packed like any other. Documents without tokens (null, empty)
    share a container of their pool. `container` is unique over the result.
    """
    counts = cut_lineage(token_counts(df, id_col, text_col))
    n = F.col("n_tokens")
    parts = counts.select(id_col, n, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity).cast("int") - 1, F.lit(0)))).alias("part_no")).withColumn("size", F.least(n - F.col("part_no") * capacity, F.lit(capacity)).cast("int"))
    full = F.col("size") == capacity
    rest = pack(parts.filter(~full), counts.count(), capacity, [id_col, "part_no"], **kw)
    own = parts.filter(full).select(id_col, "part_no", "size", F.concat_ws("-", F.lit("own"), F.col(id_col).cast("string"), F.col("part_no").cast("string")).alias("container"))
    shared = rest.select(id_col, "part_no", "size", F.concat_ws("-", F.lit("pool"), F.col("pool").cast("string"), F.col("bin").cast("string")).alias("container"))
    return own.unionByName(shared).select(id_col, "part_no", (F.col("part_no") * capacity).cast("int").alias("first_token"), F.col("size").alias("n_tokens"), "container")


def pool_report(containers: DataFrame, capacity: int = 2048) -> DataFrame:
    """(pool, n_items, bound, best_fit, bins) of each pool of `fill_containers`: the containers that its items need at the least, those that best fit alone makes of them, and those it has."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = sorted(x for x in pdf["n_tokens"].tolist() if x > 0)
        bins: list[list[int]] = []
        best_fit(bins, [], list(range(len(sizes))), sizes, capacity)
        used = pdf[pdf["n_tokens"] > 0]["container"].nunique()
        return pd.DataFrame({"pool": [int(pdf["pool"].iloc[0])], "n_items": [len(pdf)], "bound": [-(-sum(sizes) // capacity)], "best_fit": [len(bins)], "bins": [used]})

    shared = containers.filter(F.col("container").startswith("pool-")).withColumn("pool", F.split_part("container", F.lit("-"), F.lit(2)).cast("int"))
    return shared.select("pool", "n_tokens", "container").groupBy("pool").applyInPandas(run, "pool int, n_items long, bound long, best_fit long, bins long")

"""Exact nearest neighbours by cosine (JN20): blocks of a bounded set of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

#: Bytes of one block of query vectors that is sent to the executors.
BLOCK_BYTES = 64 << 20


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """(query_id, id, similarity, q_extra…, extra…): the k rows most similar to each query, but for itself; ties by id.

    The queries go out in blocks of a bounded size. Each task keeps its k best per
    query, so what is shuffled is k rows per query and task, not all pairs. Null and
    zero vectors are similar to nothing.
    """
    wide = len(queries.select(vec_col).filter(F.col(vec_col).isNotNull()).limit(1).collect() or [])
    if not wide:
        return rows.limit(0).select(F.col(id_col).alias("query_id"), id_col, F.lit(0.0).alias("similarity"), *(F.col(c).alias(f"q_{c}") for c in extra), *extra)
    size = queries.select(F.size(vec_col)).filter(F.col(vec_col).isNotNull()).first()[0]
    blocks = max(1, -(-queries.count() * size * 8 // BLOCK_BYTES))
    kind = rows.schema[id_col].dataType.simpleString()
    out = None
    for part in range(blocks):
        block = queries.filter(F.col(vec_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(blocks)) == part)).select(id_col, vec_col).collect()
        if not block:
            continue
        ids = [r[0] for r in block]
        q = np.array([r[1] for r in block], np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        q, alive = q / np.where(norm > 0, norm, 1), norm[:, 0] > 0

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q, alive=alive) -> Iterator[pa.RecordBatch]:
            keys: list = []
            best = [[] for _ in ids]
            for b in batches:
                live = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v is not None]
                if not live:
                    continue
                x = np.array([v for _, v in live], np.float64)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                s = q @ (x / np.where(n > 0, n, 1)).T
                s[:, n[:, 0] == 0] = -np.inf
                for j in np.flatnonzero(alive):
                    cut = min(k + 1, len(live))
                    for i in np.argpartition(-s[j], cut - 1)[:cut] if cut < len(live) else range(len(live)):
                        if live[i][0] != ids[j] and np.isfinite(s[j, i]):
                            best[j].append((-round(float(s[j, i]), 9), live[i][0]))
                    best[j] = sorted(best[j])[:k]
            flat = [(ids[j], i, -s) for j, rows_ in enumerate(best) for s, i in rows_]
            if flat:
                a, c, s = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s, pa.float64())], names=["query_id", id_col, "similarity"])

        found = rows.select(id_col, vec_col).mapInArrow(run, f"query_id {kind}, `{id_col}` {kind}, similarity double")
        out = found if out is None else out.unionByName(found)
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
    top = out.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")
    of = queries.select(F.col(id_col).alias("query_id"), *(F.col(c).alias(f"q_{c}") for c in extra))
    return top.join(of, "query_id").join(rows.select(id_col, *extra), id_col)

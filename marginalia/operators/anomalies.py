"""Statistical anomalies and similar texts (AG40-AG42, JN19, UF08, WN11)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marginalia.operators.near import links_of_terms
from marginalia.operators.order import order_statistics
from marginalia.session import cut_lineage, scratch

TEXTS_A_PART = 50_000


def nearest_rank_bounds(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> dict[str, dict[str, float] | None]:
    """Outlier bounds from the order statistics n // 4 and 3n // 4 of the positive values; None without any."""
    out: dict[str, dict[str, float] | None] = {}
    counts = df.agg(*(F.count_if(F.col(c) > 0).alias(c) for c in columns)).first()
    for c in columns:
        n = counts[c]
        if not n:
            out[c] = None
            continue
        q1, q3 = order_statistics(df, F.when(F.col(c) > 0, F.col(c)), [n // 4, 3 * n // 4])
        out[c] = {"q1": q1, "q3": q3, "iqr": q3 - q1, "lower": q1 - multiplier * (q3 - q1), "upper": q3 + multiplier * (q3 - q1)}
    return out


def positive_mean_std(df: DataFrame, column: str) -> tuple[float, float]:
    """Mean and population deviation of the positive values; deviation 0 becomes 1; (0, 1) without any."""
    v = F.when(F.col(column) > 0, F.col(column).cast("double"))
    row = df.agg(F.avg(v), F.stddev_pop(v)).first()
    return (float(row[0]), float(row[1]) or 1.0) if row[0] is not None else (0.0, 1.0)


def outside(c: Column, bounds: dict[str, float] | None) -> Column:
    return F.lit(False) if bounds is None else (c > 0) & ((c < bounds["lower"]) | (c > bounds["upper"]))


def words_of(x: Column, stop_words: Sequence[str] = ()) -> Column:
    """A text's words of two letters and more without the stop words. Its terms are these and the pairs of neighbours among them."""
    w = F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(w, lambda t: ~t.isin(*stop_words)) if stop_words else w


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of lists and the list that each is in."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists), dtype=np.int64), n)


def _counted(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """From lists of words to (term, df, cf), one row per term and about `most` terms of a task."""
    codes: dict[str, int] = {}
    held = [np.zeros(0, np.int64)] * 3

    def rows() -> Iterator[pa.RecordBatch]:
        names, (keys, df, cf) = pa.array(list(codes), pa.string()), held
        for k in range(0, len(keys), 50_000):
            key = keys[k : k + 50_000]
            second = (key & 0xFFFFFFFF) - 1
            pair = pc.binary_join_element_wise(names.take(pa.array(key >> 32)), names.take(pa.array(second, mask=second < 0)), " ", null_handling="skip")
            yield pa.RecordBatch.from_arrays([pair, pa.array(df[k : k + 50_000]), pa.array(cf[k : k + 50_000])], names=["term", "df", "cf"])

    for b in batches:
        words, row = _flat(b.column(0))
        if not len(words):
            continue
        coded = words.dictionary_encode()
        code = np.array([codes.setdefault(w, len(codes)) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        next_to = row[:-1] == row[1:]
        key, inverse = np.unique(np.concatenate([code << 32, ((code[:-1] << 32) | (code[1:] + 1))[next_to]]), return_inverse=True)
        once = np.sort(np.concatenate([row, row[:-1][next_to]]) * len(key) + inverse)
        once = once[np.concatenate([[True], once[1:] != once[:-1]])] % len(key)
        new = (key, np.bincount(once, minlength=len(key)), np.bincount(inverse, minlength=len(key)))
        both, at = np.unique(np.concatenate([held[0], key]), return_inverse=True)
        held = [both, *(np.bincount(at, np.concatenate([h, x]), len(both)).astype(np.int64) for h, x in zip(held[1:], new[1:]))]
        if len(both) >= most or len(codes) >= most:
            yield from rows()
            codes.clear()
            held = [np.zeros(0, np.int64)] * 3
    yield from rows()


def term_features(df: DataFrame, words: str, least_df: int, features: int) -> DataFrame:
    """(term, df, idx): of the terms in `least_df` texts and more the `features` most frequent ones, ties by the term, numbered from rare to common. At most `features` rows.

    Terms are counted before the shuffle, by numbers for their words: what is shuffled
    is a row per task and term.
    """
    each = df.select(words).mapInArrow(_counted, "term string, df bigint, cf bigint")
    seen = each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter(F.col("df") >= least_df)
    top = seen.orderBy(F.desc("cf"), "term").limit(features)
    return top.select("term", "df", F.row_number().over(W.orderBy("df", "term")).alias("idx"))


def term_vectors(df: DataFrame, id_col: str, words: str, least_df: int = 2, features: int = 5000, threshold: float = 0.0, weights: bool = True) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(vectors, features, idf): of each text (id, idx, n, weight, n_prefix), its features in order with their numbers and, with `weights`, smooth-idf weights of length 1, in one narrow pass; the features, which are a bounded number and sent to the tasks; and their idf by idx.

    `n_prefix`: how many of the rarest features must be kept so that the rest is shorter
    than `threshold`. A text without words counts as a text and has no features.
    """
    n = df.count()
    feats = cut_lineage(term_features(df, words, least_df, features))
    rows = sorted((r.idx, r.term, r.df) for r in feats.collect())
    idf = np.array([0.0, *(np.log((1.0 + n) / (1.0 + d)) + 1 for _, _, d in rows)])
    split = [t.split(" ") for _, t, _ in rows]
    names = sorted({w for t in split for w in t})
    code = {w: k + 1 for k, w in enumerate(names)}
    # a term's key: the numbers of its words, the second 0 for a single word; 0 is no key, as words are numbered from 1
    keys = np.array([0, *((code[t[0]] << 32) | (code[t[1]] if len(t) > 1 else 0) for t in split)], np.int64)
    order = np.argsort(keys)
    sent = df.sparkSession.sparkContext.broadcast((names, keys[order], order, idf))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, order, idf = sent.value
        known = pa.array(names, pa.string())
        for b in batches:
            words, row = _flat(b.column(1))
            code = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            pair = (row[:-1] == row[1:]) & (code[:-1] > 0) & (code[1:] > 0)
            want, row = np.concatenate([code << 32, ((code[:-1] << 32) | code[1:])[pair]]), np.concatenate([row, row[:-1][pair]])
            place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            at = np.where(keys[place] == want, order[place], 0)
            key, count = np.unique((row[at > 0] << 32) | at[at > 0], return_counts=True)
            row, at = key >> 32, key & 0xFFFFFFFF
            w = count * idf[at]
            w /= np.sqrt(np.bincount(row, w * w, b.num_rows))[row]
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            total = np.concatenate([[0.0], np.cumsum(w * w)])
            # what of a text's squares lies at or behind a place
            behind = total[ends[row + 1]] - total[:-1]
            keep = np.bincount(row[behind >= threshold * threshold - 4e-9], minlength=b.num_rows)
            offsets = pa.array(ends, pa.int32())
            lists = {"idx": pa.array(at, pa.int32()), "n": pa.array(count, pa.int32())} | ({"weight": pa.array(w)} if weights else {})
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.ListArray.from_arrays(offsets, x) for x in lists.values()), pa.array(keep, pa.int32())], names=[id_col, *lists, "n_prefix"])

    return df.select(id_col, words).mapInArrow(run, f"`{id_col}` {kind}, idx array<int>, n array<int>, {'weight array<double>, ' * weights}n_prefix int"), feats, idf


def tfidf(df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] = (), least_df: int = 2, features: int = 5000) -> DataFrame:
    """(id, term, weight) of the features of every text."""
    v, feats, _ = term_vectors(df.select(id_col, words_of(F.col(text_col), stop_words).alias("words")), id_col, "words", least_df, features)
    return v.select(id_col, F.inline(F.arrays_zip("idx", "weight"))).join(F.broadcast(feats.select("idx", "term")), "idx").select(id_col, "term", "weight")


def copy_classes(keyed: DataFrame, id_col: str) -> DataFrame:
    """(id, class_id, other) from (id, h): ids of equal h share a class named by the least id of its members; `other` is the least of the other ids."""
    names = keyed.groupBy("h").agg(F.min(id_col).alias("class_id"))
    keyed = keyed.join(names, "h")
    second = keyed.filter(F.col(id_col) != F.col("class_id")).groupBy("class_id").agg(F.min(id_col).alias("second"))
    return keyed.join(second, "class_id", "left").select(id_col, "class_id", F.when(F.col(id_col) == F.col("class_id"), F.col("second")).otherwise(F.col("class_id")).alias("other"))


def text_key(x: Column) -> Column:
    """32 bytes that tell texts apart; null for null."""
    return F.unhex(F.sha2(x, 256))


def similar_texts(
    df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] = (), threshold: float = 0.85, features: int = 5000, crowd: int = 48, keyed: DataFrame | None = None
) -> DataFrame:
    """(id, class_id, n_links, first_match) of every text that isn't null: first_match is the least other id at least `threshold` similar by the cosine of term weights.

    Copies share a class and are compared once; `n_links` counts the other classes
    similar to it. `keyed` holds (id, h), h being the `text_key` of the text, where that
    can be had without shuffling the texts. Two unit vectors of so high a cosine share a
    term of their prefixes: with the terms in order from rare to common, the rest of a
    vector behind its prefix is shorter than the threshold, so their rarest common term
    can't lie there. No linked pair is lost. The terms are dealt to tasks; each reads the
    vectors, a few bytes a term, from the shared folder, and holds those with one of its
    terms in their prefix. What is shuffled is a row per text and task in which it
    has links. Groups of up to `crowd` texts are multiplied out at once. Texts without
    features are similar to none.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    keyed = df.select(id_col, text_key(F.col(text_col)).alias("h")) if keyed is None else keyed
    classes = cut_lineage(copy_classes(keyed.filter(F.col("h").isNotNull()), id_col))
    firsts = df.select(id_col, text_col).join(classes.filter(F.col(id_col) == F.col("class_id")).select(id_col), id_col, "left_semi")
    firsts.select(F.col(id_col).alias("id"), words_of(F.col(text_col), stop_words).alias("words")).write.option("compression", "zstd").parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    vectors, _, idf = term_vectors(words, "id", "words", features=features, threshold=threshold, weights=False)
    vectors.write.option("compression", "zstd").parquet(f"{folder}/vectors")
    vectors = spark.read.parquet(f"{folder}/vectors")
    # a text counts 1 over all of its prefix: the more terms that has, the more of their texts are the same, which are compared once
    cost = np.zeros(len(idf))
    for r in vectors.select(F.explode(F.slice("idx", F.lit(1), F.col("n_prefix"))).alias("idx"), (1 / F.col("n_prefix")).alias("x")).groupBy("idx").agg(F.sum("x").alias("x")).collect():
        cost[r.idx] = r.x
    # neighbours in the order of terms are alike frequent and often have the same texts, so each part is a stretch of it; the last stretch begins first
    texts = words.count()
    parts = int(max(1, min(2 * spark.sparkContext.defaultParallelism, texts // 500), texts // TEXTS_A_PART))
    part_of = parts - 1 - np.minimum((np.cumsum(cost) - cost) * parts / max(1.0, cost.sum()), parts - 1).astype(np.int64)
    run = links_of_terms(f"{folder}/vectors", part_of, idf, threshold, crowd, to_arrow_type(kind))
    found = spark.range(0, parts, 1, parts).mapInArrow(run, f"class_id {kind.simpleString()}, n bigint, least {kind.simpleString()}")
    links = found.groupBy("class_id").agg(F.sum("n").alias("n_links"), F.min("least").alias("first_link"))
    return classes.join(links, "class_id", "left").select(id_col, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.least("other", "first_link").alias("first_match"))

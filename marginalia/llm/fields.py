"""The text fields of the project's tables as one table, and per-process helpers for the workers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.llm.bpe import slices
from marginalia.tables import table

#: Table, field, id of each kind of text.
INTERPRETATION = ("interpretations", "interpretation", "interpretation_id")
DOCUMENT = ("documents", "text", "doc_id")
PASSAGE = ("interpretations", "passage", "interpretation_id")
PAGE = ("book_pages", "content", "page_id")
WHISPER = ("whisper_messages", "content", "message_id")
BIO = ("users", "bio", "user_id")

KEYS = "tbl string, fld string, rec_id string"


def fields(spark: SparkSession, sf_dir: str, which: Iterable[tuple[str, str, str]], extra: dict[str, str] | None = None) -> DataFrame:
    """(tbl, fld, rec_id, text) and the `extra` columns (name -> SQL), one row per row of the tables."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.lit(f).alias("fld"), F.col(k).cast("string").alias("rec_id"), F.col(f).alias("text"), *(F.expr(x).alias(n) for n, x in (extra or {}).items())) for t, f, k in which]
    return reduce(DataFrame.unionByName, parts)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list[dict[str, list]]]], schema: str) -> DataFrame:
    """`df` through a function of batches that is built once per task.

    `make` gives a function from a record batch to one in `schema`; batches are
    limited in bytes, so that long texts don't fill a worker's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = make()
        at = None
        for whole in batches:
            at = whole.schema.get_field_index("text") if at is None else at
            for b in slices(whole, column=at):
                out = do(b)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def record_keys(b: pa.RecordBatch, rows: Sequence[int]) -> list[pa.Array]:
    """(tbl, fld, rec_id) of the given rows of a batch; a batch without finds gives empty columns."""
    at = pa.array(rows, pa.int64())
    return [b.column(k).take(at) for k in range(3)]


def remembered(fn: Callable[[str], object], chars: int = 1000, entries: int = 20_000) -> Callable[[str], object]:
    """`fn` with a bounded memory of its results for short texts, which readers quote again and again."""
    known: dict[str, object] = {}

    def call(text: str):
        if len(text) > chars:
            return fn(text)
        if (out := known.get(text, known)) is known:
            if len(known) >= entries:
                known.clear()
            out = known[text] = fn(text)
        return out

    return call


_BUILT: dict[tuple, object] = {}


def built(make: Callable[..., object], *args, keep: int = 8) -> object:
    """make(*args), kept by what it is made from: the same samples give the same model without training it again."""
    key = (make.__name__, hash(repr(args)))
    if key not in _BUILT:
        if len(_BUILT) >= keep:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = make(*args)
    return _BUILT[key]


def words_of(df: DataFrame, column: str) -> set[str]:
    """The distinct words of a fixed table's column."""
    return {w for (text,) in df.select(column).filter(F.col(column).isNotNull()).distinct().collect() for w in re.findall(r"[^\W\d_]+", text)}


def sample_texts(df: DataFrame, order: str, column: str, rows: int = 10_000) -> list[str]:
    """The texts of a small sample table, in a fixed order; at most `rows` of them, which bounds a model's training."""
    return [t for _, t in sorted((r[0], r[1]) for r in df.select(order, column).filter(F.col(column).isNotNull()).orderBy(order, column).limit(rows).collect())]


def pairs(df: DataFrame, order: str, first: str, second: str, rows: int = 10_000) -> list[tuple[str, str]]:
    """Two columns of a small sample table, in a fixed order; at most `rows` of them, rows with a null left out."""
    live = df.select(order, first, second).dropna().orderBy(order, first, second).limit(rows).collect()
    return [(r[1], r[2]) for r in sorted(map(tuple, live))]


def beyond_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")

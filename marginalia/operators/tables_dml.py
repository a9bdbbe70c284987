"""Table changes as set operations (SNK05-SNK16): parquet has no row-level changes, so each gives the new version of the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `source` replace those of `target` with equal keys (compared as text) and are added otherwise.

    `source` must have one row per key. Columns that one side lacks are null there.
    Rows of `target` with a null key match nothing and stay.
    """
    match = [F.col(f"t.{k}").cast("string") == F.col(f"s.{k}").cast("string") for k in keys]
    kept = target.alias("t").join(source.select(*keys).alias("s"), match, "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows of `source` whose keys `target` lacks are added, each key once."""
    return target.unionByName(source.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def delete(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def update(target: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """New values where the condition holds; a null condition counts as false."""
    hit = F.coalesce(where, F.lit(False))
    return target.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def cascade(tables: Mapping[str, DataFrame], doomed: DataFrame, links: Mapping[str, Sequence[str]], key: str) -> dict[str, DataFrame]:
    """Each table without the rows that any of its link columns ties to a doomed key; rows with a null link stay."""
    ids = doomed.select(F.col(key).alias("__k")).distinct()
    out = {}
    for name, df in tables.items():
        for c in links.get(name, ()):
            df = df.join(ids, df[c] == ids["__k"], "left_anti")
        out[name] = df
    return out


def with_columns_of(df: DataFrame, schema) -> DataFrame:
    """`df` with the columns of `schema` it lacks, as nulls, in the schema's order; further columns stay behind."""
    have = set(df.columns)
    return df.select(*(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields), *(c for c in df.columns if c not in set(schema.fieldNames())))

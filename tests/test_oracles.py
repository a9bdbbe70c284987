"""Each query against its SQL on the same files."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
from marginalia.plans.catalog import oracle_sql, queries  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equal_rows(spark, db, name):
    df = queries()[name](spark, DIR)
    names = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    cur = db.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    theirs = [tuple(plain(r[cols.index(c)]) for c in names) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(mine, key=key) == sorted(theirs, key=key)


def test_passage_keys_of_cut_passages(spark, tmp_path):
    """A cut at 200 characters may leave a space of any kind at the end; letters are lowered one for one."""
    spaces = [chr(c) for c in range(1, 0x3001) if chr(c).isspace()]
    passages = [*("x" * 199 + c + "y" for c in spaces), *(c + "Ab" + c for c in spaces), "ΟΔΟΣ", "ΟΔΟΣ x", "İstanbul", "", "\u3000", None]
    rows = [(str(k), "b", p, k) for k, p in enumerate(passages)]
    spark.createDataFrame(rows, "interpretation_id string, book_id string, passage string, ingested_at long").coalesce(1).write.parquet(f"{tmp_path}/interpretations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW interpretations AS SELECT * FROM '{tmp_path}/interpretations.parquet/*.parquet'")
    want = dict(con.execute(oracle_sql()["tx04_passage_keys"]).fetchall())
    assert {r.interpretation_id: r.passage_key for r in queries()["tx04_passage_keys"](spark, str(tmp_path)).collect()} == want

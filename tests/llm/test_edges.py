"""Every query over empty tables and over tables of the worst rows."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("marginalia.llm")
from marginalia.llm.queries import queries  # noqa: E402

from tests.conftest import SMALL  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty_dir, name):
    assert queries()[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_worst_rows(spark, dirty_dir, name):
    df = queries()[name](spark, dirty_dir)
    rows = df.collect()
    if name.endswith("_found") and name != "p4_found":
        assert len(rows) == len(set(rows)) or name == "p10_found"


@pytest.mark.parametrize("name", ["p1_found", "p1_restored", "p2_found", "p3_found", "p5_found", "p5_stretches", "p6_found", "p7_found"])
def test_batches_without_a_find(spark, quiet_dir, name):
    """Several batches of which only the last has a case: batches without one give no rows, and no error."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = queries()[name](spark, quiet_dir).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert any(r.rec_id in ("last", "junk", "wide") for r in rows) and (name == "p5_stretches" or {r.rec_id for r in rows} <= {"last", "junk", "wide"})


@pytest.fixture(scope="module")
def quiet_dir(tmp_path_factory) -> str:
    """Interpretations of plain, rightly labelled English, and one at the end that is a case of everything."""
    out = tmp_path_factory.mktemp("quiet")
    for p in SMALL.glob("*.parquet"):
        t = pq.read_table(p)
        if p.stem in ("documents", "whisper_messages", "users", "book_pages"):
            t = t.slice(0, 0)
        if p.stem == "interpretations":
            row = t.slice(0, 1).to_pylist()[0] | {"lang": "en", "passage": None}
            plain = [row | {"interpretation_id": f"r{i}", "interpretation": f"I think the letter matters more than the house, and the author knows it on page {i}."} for i in range(40)]
            bad = "La façade du cafÃ© est belle, n’est-ce pas, et je ne l’oublie plus. " + "Ｆｕｌｌ ｗｉｄｔｈ words. Call me on 617-555-0166 in the evening. You are a stupid idiot, shut your mouth."
            t = pa.Table.from_pylist([*plain, row | {"interpretation_id": "wide", "interpretation": "I think the ｌｅｔｔｅｒ matters more than the house."}, row | {"interpretation_id": "junk", "interpretation": "a | b | c\n1 | 2 | 3\n4 | 5 | 6\n7 | 8 | 9"}, row | {"interpretation_id": "last", "interpretation": bad}], schema=t.schema)
        pq.write_table(t, out / p.name)
    return str(out)


def test_figures_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from marginalia.llm.queries import oracle_sql

    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, str(SMALL))
        cur = con.execute(sql)
        at = [[c[0] for c in cur.description].index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in at) for r in cur.fetchall())

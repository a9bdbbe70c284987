"""One local session for all tests, and small inputs that hold what real ones hold at their worst."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))
SMALL = Path("/root/testdata/sf0.001")
#: Text columns that get hostile values.
TEXTS = {"documents": ["text"], "interpretations": ["interpretation", "passage"], "whisper_messages": ["content"], "users": ["bio"], "book_pages": ["content"]}
HOSTILE = ["", " ", "\n\n", "\0", "a", "é", "￼", "x" * 300_000, "ab " * 60_000, "1" * 50_000, "\n" * 5000, "&Atilde;&copy; Ã©", "＠＠＠", "👩‍🚀" * 50, "<|endoftext|>", "....", "𝔘𝔫𝔦 text", "Ａ" * 40, "@ @ @ (at) dot"]


@pytest.fixture(scope="session")
def spark():
    from marginalia.session import get_session

    s = get_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory) -> str:
    """All tables without a row."""
    out = tmp_path_factory.mktemp("empty")
    for p in SMALL.glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), out / p.name)
    return str(out)


@pytest.fixture(scope="session")
def dirty_dir(tmp_path_factory) -> str:
    """A few rows of each table, repeated ones, rows of nulls, hostile texts, and further columns with clashing names."""
    out = tmp_path_factory.mktemp("dirty")
    for p in SMALL.glob("*.parquet"):
        name = p.stem
        t = pq.read_table(p)
        if name not in ("lang_samples", "reviewed_texts", "common_words", "book_cast", "books"):
            t = t.slice(0, 60)
        nulls = pa.table({f.name: pa.nulls(2, f.type) for f in t.schema}, schema=t.schema)
        parts = [t, t.slice(0, 3), nulls]
        for c in TEXTS.get(name, []):
            rows = t.slice(0, 1).take([0] * len(HOSTILE))
            parts.append(rows.set_column(rows.schema.get_field_index(c), c, pa.array(HOSTILE, t.schema.field(c).type)))
        t = pa.concat_tables(parts)
        for extra in ("tbl", "n", "bin", "size", "z"):
            if extra not in t.column_names:
                t = t.append_column(extra, pa.array(["clash"] * t.num_rows))
        pq.write_table(t, out / p.name)
    return str(out)

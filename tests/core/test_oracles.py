"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from cueline.plans import registry

DATA = Path(os.environ.get("CUELINE_TESTDATA", "/root/testdata/sf0.001"))


def same(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(same, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA)).toArrow()
    want = duck.sql(registry.ORACLES[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted(tuple(same(r[k]) for k in names) for r in t.to_pylist())
    assert rows(got) == rows(want)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() > 0


@pytest.mark.parametrize("name", ["merge_preview", "merge_lines"])
def test_open_ends_after_accents(spark, tmp_path, name):
    """Words that end in an accented letter and what looks like an open end are read as the SQL reads them."""
    texts = ["Vamos con María\nLuego a casa", "Vamos con Marta\nLuego a casa", "otra vía\nTren\ncafé in\nParis", "solo\nSí a"]
    rows = [(k, t, "es", "s", len(t)) for k, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toArrow(), c.sql(registry.ORACLES[name]).to_arrow_table()
    rows = lambda t: sorted(tuple(same(r[k]) for k in sorted(want.column_names)) for r in t.to_pylist())
    assert rows(got) == rows(want)

"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from ravelin.plans import registry

Q, O = registry.queries(), registry.oracle()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return c


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, data, duck, name):
    df = Q[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in O:
        rel = duck.sql(O[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_tools(spark, data):
    from ravelin import tools

    c = tools.Catalog(spark, data)
    assert len(tools.TOOLS) == 14
    assert tools.list_packages(c).count() > 0
    assert tools.search_docs(c, "lock", 3).count() <= 3
    assert tools.list_files(c, "*.py").where("NOT file_path LIKE '%.py'").count() == 0
    first = c.table("doc_slices").where("NOT line_meta_missing").first()
    assert tools.read_docs(c, first["path"]).count() > 0
    s = c.table("symbol_sources").first()
    assert tools.read_symbol(c, s["symbol"]).first()["status"] in ("unique", "ambiguous")
    assert tools.read_code(c, s["path"], s["start_line"]).count() <= 1
    assert tools.get_callers(c, "nothing").count() == 0

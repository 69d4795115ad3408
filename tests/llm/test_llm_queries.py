"""Every query of the subpackage runs on the smallest tables with the columns it promises."""

import os

import pytest

from ravelin.llm import registry

Q = registry.queries()
COLUMNS = {"p1_found": ["id"], "p3_found": ["path"], "p4_found": ["path"], "p6_found": ["item_kind", "item_id"], "p7_found": ["item_kind", "item_id", "markup"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, data, name):
    df = Q[name](spark, data)
    rows = df.collect()
    assert rows and df.columns == COLUMNS.get(name, df.columns)
    if name in COLUMNS:
        assert len(set(rows)) == len(rows)


def test_oversized_items(spark, data):
    import duckdb

    c = duckdb.connect()
    for t in ("symbol_sources", "doc_slices"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = sorted(c.sql(registry.oracle()["p6_found"]).fetchall())
    assert sorted(tuple(r) for r in Q["p6_found"](spark, data).collect()) == want


def test_nothing_else_imports_it():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "ravelin")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "ravelin.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()

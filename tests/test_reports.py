import json
import os

import pytest
from pyspark.sql import functions as F

from ravelin import models
from ravelin.operators import answers, fusion, graph, parity, pipeline, reports, storage, vector
from ravelin.sources import archive, config, writer


def test_parity_report(spark):
    n = spark.createDataFrame([("function", 10, 10, 10, 0, 0, 100.0), ("class", 0, 1, 0, 0, 1, None)], "kind string, golden long, ours long, matched long, missing long, extra long, recall_pct double")
    e = spark.createDataFrame([("calls", 10, 8, 8, 2, 0, 80.0)], n.schema)
    d = spark.createDataFrame([("b", 1), ("a", None), ("c", None)], "what string, rule int")
    r = reports.parity_report(n, e, d)
    assert not r["passed"] and reports.exit_code(r) == 1 and r["open_diffs"] == 2 and reports.exit_code(None) == 2
    assert reports.exit_code(reports.parity_report(n, e.limit(0), d)) == 0
    text = reports.parity_text(r, d).split("\n")
    assert text[0] == "nodes 100.0 %, calls 80.0 %: failed" and text[-3:] == ["open: a", "open: c", "allowed: b"]
    assert {x["what"]: x["passed"] for x in parity.gate(n, e).collect()} == {"nodes": True, "calls": False}
    assert [x["side"] for x in parity.sides(e.withColumn("extra", F.lit(1))).orderBy("side").collect()] == ["extra", "missing"]


def test_texts_for_reading(spark):
    assert reports.listing(["a", "b"], 5, 2) == "a\nb\n... and 3 more" and reports.listing([], 0, 2, "*.x") == "No files match '*.x'."
    md = reports.answer({"answer": "Yes.", "findings": [{"title": "T", "file": "a.py", "start_line": 3, "end_line": 4, "verified": True, "snippet": "x = 1"}], "questions": ["Why?"]})
    assert "1. **T** (verified) `a.py:3-4`" in md and "- Why?" in md
    assert reports.clarification("Which?", ["a", "b"]) == "Which?\n1. a\n2. b"
    assert reports.coerced('```json\n{"answer": "a", "findings": [{"x": 1}, {"file": "f"}]}\n```') == {"answer": "a", "findings": [{"file": "f"}]}
    assert reports.coerced(None) == {"answer": "", "findings": []} and reports.coerced("plain")["answer"] == "plain"
    row = spark.range(1).select(reports.query_text("multi-e5", F.lit("q")).alias("a"), reports.document_text("x", F.lit(None).cast("string"), F.lit("d")).alias("b"), reports.rerank_prompt(F.lit("q%"), F.lit("d")).alias("c")).first()
    assert (row["a"], row["b"]) == ("query: q", "d") and "q%" in row["c"]
    assert reports.task_prompt("Q", ["b", "a"]) == "Question: Q\nPackages: a, b"
    assert [ok for _, ok, _ in reports.diagnostics({"t": spark.range(1), "u": spark.range(0)})][2:] == [True, False]


def test_models():
    assert models.make("embed", None) is None and models.make("embed", {"provider": "other"}) is None
    assert models.make("embed", {"provider": "builtin", "dim": 8}).dim == 8
    assert models.allowed_model(None, ["a"], "d") == "d" and models.allowed_model("a", ["a"], "d") == "a"
    with pytest.raises(ValueError):
        models.allowed_model("z", ["a"], "d")
    assert models.candidate_text({"kind": "function", "symbol": "f", "snippet": "x"}) == "function f: x"


def test_local_sources(spark, tmp_path):
    git = tmp_path / "r/.git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "refs/heads/main").write_text("a" * 40 + "\n")
    (git / "packed-refs").write_text("# pack\n" + "b" * 40 + " refs/tags/v1.0\n" + "c" * 40 + " refs/tags/v2.0\n^" + "a" * 40 + "\n")
    assert config.git_state(str(tmp_path / "r")) == ("2.0", "a" * 40) and config.git_state(str(tmp_path)) == (None, None)
    assert config.local_source("path:x", "/b") == "/b/x" and config.local_source("./x", "/b") == "/b/x" and config.local_source("name@1") is None
    m, lock = str(tmp_path / config.MANIFEST), str(tmp_path / config.LOCK)
    config.init_manifest(m, "demo")
    config.record_dependency(m, lock, "lib", {"path": "../lib"}, "1.0", "d")
    assert config.read_manifest(m)["dependencies"]["lib"] == {"path": "../lib"} and config.read_lock(lock)[0]["version"] == "1.0"
    (tmp_path / "reg").mkdir()
    (tmp_path / "reg/index.json").write_text(json.dumps({"a": {"versions": ["1", "2"], "checksums": {"1": "x"}}}))
    assert [tuple(r)[:3] for r in config.read_registry(spark, str(tmp_path / "reg")).collect()] == [("a", "1", "x"), ("a", "2", None)]
    for v in ("a@1", "a@2", "b@1"):
        (tmp_path / "store" / v).mkdir(parents=True)
    assert archive.remove(str(tmp_path / "store"), "A") == 2 and os.listdir(tmp_path / "store") == ["b@1"]


def test_tables_are_replaced_and_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    writer.append(spark.range(2), path)
    cache = config.TableCache(spark)
    assert cache(path).count() == 5
    writer.replace(spark.read.parquet(path).where("id > 0").withColumn("v", F.lit(1)), path)
    cache.forget(path)
    assert cache(path).count() == 3 and "v" in cache(path).columns


def test_vectors_are_stamped(spark):
    t = spark.createDataFrame([(1, "red blue", None), (2, None, [9.0])], "id int, content string, vector array<float>")
    out, note = vector.stamped(t, "content", models.HashEmbedder(8, "h8"))
    assert note == {"embedding_model": "h8", "embedding_dim": 8, "vector_column": "vector"} and {r["id"]: len(r["vector"]) for r in out.collect()} == {1: 8, 2: 1}
    assert {len(r["vector"]) for r in vector.stamped(t, "content", models.HashEmbedder(8), force=True)[0].collect()} == {8}


def test_nearest_by_group_and_ties(spark):
    v = spark.createDataFrame([(i, "ab"[i % 2], [1.0, float(i > 6)]) for i in range(10)] + [(99, "a", None), (98, "a", [0.0, 0.0])], "vec_id long, g string, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vector array<double>")
    got = sorted((r["g"], r["rank"], r["vec_id"]) for r in vector.nearest(v, q, 2, by="g").collect())
    assert got == [("a", 1, 2), ("a", 2, 4), ("b", 1, 1), ("b", 2, 3)]
    assert [r["vec_id"] for r in vector.nearest(v, q, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert vector.nearest(v, q.limit(0), 3).count() == 0


def test_packages(spark, tmp_path):
    local = spark.createDataFrame([("Mine", "/m")], "name string, folder string")
    b = spark.createDataFrame([("lib", "1", "global", "/g/lib", ["graph"])], "name string, version string, scope string, path string, parts array<string>")
    assert storage.index_path("mine", local, b) == "/m/graph" and storage.index_path("lib@1", local, b) == "/g/lib/graph"
    for name, part in (("none", "graph"), ("lib", "docs")):
        with pytest.raises(LookupError):
            storage.index_path(name, local, b, part)
    assert storage.layout_errors(spark.createDataFrame([("graph/nodes",)], "path string")) == ["manifest.json is missing"]
    deps = spark.createDataFrame([("a", "path:/w/x"), ("b", "/other"), ("c", "1.0"), ("d", "/w")], "name string, spec string")
    assert sorted(r["name"] for r in storage.belongs_to(deps, "/w/x/").collect()) == ["a", "d"]
    import hashlib

    t = spark.createDataFrame([(hashlib.sha256(b"t").hexdigest(), "ci")], "hash string, label string")
    assert storage.token_owner(t, "t") == "ci" and storage.token_owner(t, "u") is None
    left, gone = reports.removed(spark.createDataFrame([("a", "1", "global"), ("A", "2", "workspace"), ("b", "1", "global")], "name string, version string, scope string"), "a")
    assert left.count() == 1 and gone.count() == 2


def test_answers(spark):
    found = spark.createDataFrame([("p", "f", 1), ("p", "g", 2), ("p", "h", 3)], "package string, name string, place int")
    code = spark.createDataFrame([("p", "f", "x" * 60), ("p", "g", "one"), ("p", "g", "two"), ("p", "h", "y" * 60)], "package string, symbol string, content string")
    assert [(r["name"], r["body"] and len(r["body"])) for r in answers.with_bodies(found, code, ["place"], 100).collect()] == [("f", 60), ("g", None), ("h", None)]
    doc = json.loads(answers.nodes_json(spark.createDataFrame([("n", 2), ("m", 1)], "name string, position int")).first()[0])
    assert doc == {"nodes": [{"node": {"name": "m"}}, {"node": {"name": "n"}}]}
    f = spark.createDataFrame([("s", n) for n in range(5)], "session string, finding int")
    assert answers.capped(f, 2).count() == 2
    r = reports.reordered(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, rank int"), spark.createDataFrame([("c", 0.9), ("b", 0.1)], "k string, score double"), "k")
    assert [x["k"] for x in r.orderBy("place").collect()] == ["c", "b", "a"]


def test_scope_and_pool(spark):
    p = spark.createDataFrame([("Lib", "1"), ("app", "2")], "package string, version string")
    assert [r[0] for r in pipeline.in_scope(p, "lib@1").collect()] == ["Lib"] and pipeline.in_scope(p, None).count() == 2
    with pytest.raises(pipeline.UnknownScope, match="Lib, app"):
        pipeline.in_scope(p, "none")
    rows = [("p", "code", 1.0 - n / 100, n % 2 == 0, n) for n in range(30)] + [("q", "docs", 0.5, False, 40)]
    f = spark.createDataFrame(rows, "package string, origin string, rrf double, from_original boolean, seq long")
    got = fusion.pool_with_share(f, 6, 0.34).orderBy("pool_rank").collect()
    assert len(got) == 4 and sum(not r["from_original"] for r in got) <= 2


def test_seeds_fall_back_to_names(spark):
    n = spark.createDataFrame([("1", "parse_header", "a::parse_header", "function", None, None), ("2", "other", "other", "function", "reads the header twice", None), ("3", "headers", "headers", "function", None, None)], "id string, name string, qualified_name string, kind string, docstring string, signature string")
    assert sorted(r["id"] for r in graph.seeds(n, ["header"], 10).collect()) == ["1", "2"]
    assert [r["id"] for r in graph.seeds(n, ["eader"], 10).collect()] == ["1", "3"]
    assert [r["id"] for r in graph.exact_first(graph.resolve_ids(n.withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2)), "other")).collect()] == ["2"]


def test_graph_file(spark, tmp_path):
    import sqlite3

    from ravelin.sources import sqlite

    n = spark.createDataFrame([("a", "function", "f", True), ("b", "class", "K", False), ("a", "function", "f", True)], "id string, kind string, name string, is_async boolean").coalesce(1)
    e = spark.createDataFrame([("a", "b", "calls", 1), ("a", "b", "calls", 1)], "source string, target string, kind string, line int")
    f = spark.createDataFrame([("x.py", "1"), ("x.py", "2")], "path string, content_hash string").coalesce(1)
    p = str(tmp_path / "g.db")
    for _ in range(2):
        sqlite.export_graph(n, e, f, p, block=2)
    with sqlite3.connect(p) as c:
        count = lambda t: c.execute(f"SELECT count(*) FROM {t}").fetchone()[0]
        assert [count(t) for t in ("nodes", "edges", "files", "schema_versions")] == [2, 2, 1, 2]
        assert c.execute("SELECT is_async FROM nodes WHERE id = 'a'").fetchone() == (1,) and c.execute("SELECT content_hash FROM files").fetchone() == ("2",)
    c.close()


def test_tools_over_tables(spark, data):
    from ravelin import tools

    c = tools.Catalog(spark, data)
    assert tools.files_text(c, "*.py", 2).count("\n") == 2 and "more" in tools.files_text(c, "*.py", 2)
    assert tools.callers_with_bodies(c, "nothing").count() == 0
    with pytest.raises(pipeline.UnknownScope):
        tools.query(c, "lock", scope="no such package")

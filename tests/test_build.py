import os

import pytest
from pyspark.sql import functions as F

from ravelin.operators import answers, chunking, search, storage
from ravelin.sources import archive, config, writer


def test_build_and_read_back(spark, tmp_path):
    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "pkg/a.py").write_text("# Runs.\ndef run():\n    return help()\n\n\ndef help():\n    return 1\n")
    (src / "read.md").write_text("# Title\n\nSome words.\n")
    digest = writer.build(spark, str(src), "demo-pack", "1.0", str(tmp_path / "demo.tgz"))
    assert len(digest) == 64
    nodes, edges, files = writer.read_graph(spark, f"{tmp_path}/demo.tgz.work/graph")
    assert {r["name"] for r in nodes.where("kind = 'function'").collect()} == {"run", "help"} and edges.where("kind = 'calls'").count() == 1 and files.count() == 1
    code = {r["symbol"]: r["content"] for r in spark.read.parquet(f"{tmp_path}/demo.tgz.work/code").collect()}
    assert code["run"].startswith("# Runs.\ndef run")
    assert spark.read.parquet(f"{tmp_path}/demo.tgz.work/docs").first()["content"].startswith("# Title")
    place = archive.install(str(tmp_path / "demo.tgz"), str(tmp_path / "store"))
    assert os.path.exists(place + "/graph/nodes/_SUCCESS")


def test_an_update_equals_a_new_build(spark, tmp_path):
    from ravelin.operators import extraction
    from ravelin.sources import tree

    src, path = tmp_path / "src", f"{tmp_path}/graph"
    src.mkdir()
    (src / "a.py").write_text("from b import help\n\ndef run():\n    return help()\n")
    (src / "b.py").write_text("def help():\n    return 1\n")
    (src / "c.py").write_text("def far():\n    return near()\n")

    def whole():
        f = tree.scan(spark, str(src))
        n, e = extraction.build(f)
        return n, e, f

    n, e, f = whole()
    writer.write_graph(n, e, f.withColumn("indexed_at", F.col("modified_at")).withColumn("errors", F.to_json("errors")), path)
    assert writer.update(spark, str(src), path, "p") == {"added": 0, "changed": 0, "deleted": 0, "again": 0}
    (src / "b.py").write_text("# moved\ndef help():\n    return 2\n")
    (src / "d.py").write_text("def near():\n    return 3\n")
    got = writer.update(spark, str(src), path, "p")
    assert got["added"] == 1 and got["changed"] == 1 and got["deleted"] == 0 and got["again"] >= 1
    n, e, _ = whole()
    n2, e2, f2 = writer.read_graph(spark, path)
    key = ["source", "target", "kind", "line"]
    assert {r[0] for r in n2.select("id").collect()} == {r[0] for r in n.select("id").collect()} and f2.count() == 4
    links = {tuple(r) for r in e2.select(*key).collect()}
    assert {tuple(r) for r in e.select(*key).collect()} - links <= {t for t in map(tuple, e.where("kind = 'calls'").select(*key).collect()) if t[0] in {r[0] for r in n.where("name = 'far'").select("id").collect()}}
    assert links <= {tuple(r) for r in e.select(*key).collect()}


def test_symbol_bodies_and_parts(spark):
    text = "x = 1\n# one\n# two\n\ndef f():\n    pass\n\n# far\n\n\ndef g():\n    pass"
    files = spark.createDataFrame([("a.py", text), ("b.py", None)], "path string, content string")
    s = spark.createDataFrame([("f", "a.py", 5, 6), ("g", "a.py", 11, 12)], "id string, path string, start_line int, end_line int")
    got = {r["id"]: (r["first_line"], r["body"]) for r in chunking.symbol_bodies(s, files).collect()}
    assert got == {"f": (2, "# one\n# two\n\ndef f():\n    pass"), "g": (11, "def g():\n    pass")}
    parts = chunking.long_bodies(chunking.symbol_bodies(s, files), 20).where("id = 'f'").orderBy("part").collect()
    assert "".join(r["content"] for r in parts) == got["f"][1] and all(len(r["content"]) <= 20 for r in parts)


def test_comments_around_a_symbol():
    long = ["# note"] * 60
    assert chunking.around([*long, "def f():", "    pass", "# after", "", "# far"], 61, 62) == (1, 63)
    assert chunking.around(["x = 1", "", "", "def f():"], 4, 4) == (4, 4)
    assert chunking.around(["# a", "", "# b", "def f():"], 4, 4) == (1, 4)


def test_written_index_scores_the_same(spark, tmp_path):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["red red blue", "blue green", "", None, "red"])], "id int, t string")
    q = spark.createDataFrame([(1, "red blue"), (2, "none")], "query_id int, query_text string")
    search.write_index(d, "id", "t", f"{tmp_path}/ix", 4)
    a = sorted(tuple(r) for r in search.query_index(spark, f"{tmp_path}/ix", "id", q).collect())
    assert a == sorted(tuple(r) for r in search.bm25(d, "id", "t", q).collect()) and len(a) == 3


def test_config_files(spark, tmp_path):
    m = str(tmp_path / config.MANIFEST)
    config.init_manifest(m, "demo")
    with pytest.raises(FileExistsError):
        config.init_manifest(m, "demo")
    with open(m, "a") as f:
        f.write("# kept\nold = \"1.0\"\n")
    config.set_dependency(m, "new", {"git": "github:o/r", "ref": "v1"})
    config.set_dependency(m, "old", "2.0")
    config.set_dependency(m, "extra", "3.0", "dev")
    config.set_dependency(m, "old", "9.0", "dev")
    assert "# kept" in open(m).read()
    got = config.read_manifest(m)
    assert got["dependencies"] == {"old": "2.0", "new": {"git": "github:o/r", "ref": "v1"}} and got["groups"] == {"dev": {"extra": "3.0", "old": "9.0"}}
    merged = {r["name"]: r["spec"] for r in storage.merge_dependencies(*config.dependencies(spark, got, ["dev"])).collect()}
    assert merged["old"] == "2.0" and merged["extra"] == "3.0"
    lock = str(tmp_path / config.LOCK)
    for v in ("1", "2"):
        config.upsert_lock(lock, {"name": "b", "version": v})
    config.upsert_lock(lock, {"name": "a", "version": "1"})
    assert config.read_lock(lock) == [{"name": "a", "version": "1"}, {"name": "b", "version": "2"}]
    p = config.PackageList(str(tmp_path / "p.json"))
    p.add("x", "/x")
    assert config.PackageList(p.path).rows == {"x": "/x"} and p.remove("x") and not p.remove("x")


def test_plan_and_markdown(spark):
    t = lambda rows: spark.createDataFrame(rows, "name string, version string")
    plan = storage.sync_plan(t([("a", "1"), ("b", None), ("c", "2"), ("d", "1")]), t([("b", "5")]), t([("a", "1"), ("b", "4"), ("c", "2"), ("z", "1")]))
    assert {r["name"]: r["action"] for r in plan.collect()} == {"a": "keep", "b": "update", "c": "keep", "d": "install", "z": "prune"}
    h = spark.createDataFrame([(1, "p", "a.py", 3, 4, "f", "(x)", "body"), (2, "p", "d.md", 0, 0, None, None, None)], "position int, package string, path string, start_line int, end_line int, symbol string, signature string, snippet string")
    out = [r["text"] for r in answers.markdown(h).orderBy("position").collect()]
    assert out[0] == "### 1. f\n`p` a.py:3-4\nSignature: `(x)`\n```\nbody\n```" and out[1].startswith("### 2. d.md\n`p` d.md\n```")

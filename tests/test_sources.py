import os
import sqlite3

import pytest

from ravelin import schemas
from ravelin.operators import storage
from ravelin.sources import archive, tree
from ravelin.sources.sqlite import SqliteSource


def test_tree_scan(spark, tmp_path):
    for p, b in {"src/a.py": b"x = 1\n", "src/node_modules/b.js": b"1", "docs/r.md": b"# T", "src/bad.rs": b"\xff\xfe", "ex/c.go": b"package x", "n.unknown": b""}.items():
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = {r["path"]: r for r in tree.scan(spark, str(tmp_path), ["ex"]).collect()}
    assert set(got) == {"src/a.py", "src/bad.rs"} and got["src/bad.rs"]["content"] is None and got["src/bad.rs"]["errors"] and got["src/a.py"]["language"] == "python"
    assert [r["path"] for r in tree.docs(spark, str(tmp_path), "*.{md,rst}").collect()] == ["docs/r.md"]


def test_archive_round_trip(spark, tmp_path):
    src = tmp_path / "src"
    (src / "docs").mkdir(parents=True)
    (src / "docs/a.md").write_text("hello")
    a = archive.pack(str(src), {"name": "demo-pack", "version": "1.0"}, str(tmp_path / "a.tgz"))
    assert a == archive.pack(str(src), {"name": "demo-pack", "version": "1.0"}, str(tmp_path / "b.tgz"))
    files = archive.entries(spark, f"file://{tmp_path}/a.tgz")
    m = archive.manifests(files).collect()
    assert m[0]["name"] == "demo-pack" and m[0]["problem"] is None
    assert [tuple(r) for r in archive.verify(files).collect()] == [("docs/a.md", "ok")]
    place = archive.install(str(tmp_path / "a.tgz"), str(tmp_path / "store"))
    assert open(place + "/docs/a.md").read() == "hello"
    assert [(r["name"], r["scope"]) for r in archive.installed(spark, str(tmp_path / "store"), "global").collect()] == [("demo-pack", "global")]
    with pytest.raises(ValueError):
        archive.pack(str(src), {"name": "Bad Name"}, str(tmp_path / "c.tgz"))


def test_unsafe_archive(tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "x.tgz", "w:gz") as t:
        i = tarfile.TarInfo("../evil")
        i.size = 1
        t.addfile(i, io.BytesIO(b"x"))
    with pytest.raises(ValueError):
        archive.install(str(tmp_path / "x.tgz"), str(tmp_path / "s"))


def test_sqlite_source(spark, tmp_path):
    p = str(tmp_path / "g.db")
    with sqlite3.connect(p) as c:
        c.execute("CREATE TABLE nodes (id TEXT, start_line INTEGER)")
        c.executemany("INSERT INTO nodes VALUES (?, ?)", [(f"n{i}", i) for i in range(25)])
        c.execute("CREATE TABLE schema_versions (version INTEGER)")
        c.executemany("INSERT INTO schema_versions VALUES (?)", [(1,), (4,)])
    spark.dataSource.register(SqliteSource)
    read = lambda t: spark.read.format("ravelin_sqlite").option("path", p).option("table", t).load()
    assert read("nodes").count() == 25 and read("nodes").agg({"start_line": "sum"}).first()[0] == 300
    assert schemas.check_version(read("schema_versions")) == 4
    with pytest.raises(ValueError):
        schemas.check_version(spark.createDataFrame([(5,)], "version int"))


def test_storage(spark):
    v = spark.createDataFrame([("a", "9.0", "x", "global"), ("a", "10.0", "y", "global"), ("b", "1", "z", "workspace")], "name string, version string, sha256 string, scope string")
    assert {r["name"]: r["latest"] for r in storage.registry_index(v).collect()} == {"a": "9.0", "b": "1"}
    assert storage.resolve_bundle(v, "A@10.0").first()["version"] == "10.0" and storage.resolve_bundle(v, "a@7").first()["version"] == "9.0"
    assert storage.publishable(v, v.limit(0)).count() == 3 and storage.publishable(v, v).count() == 0
    assert storage.namespaces(["/x/src", "/y/src"]) == {"/x/src": "x/src", "/y/src": "y/src"}
    with pytest.raises(ValueError):
        storage.namespaces(["/x", "/x/src"])
    from pyspark.sql import functions as F

    g = spark.createDataFrame([("github:o/r@v1",), ("https://git.example.com/o/r.git",)], "s string").select(storage.parse_git_source(F.col("s")).alias("g")).select("g.*").collect()
    assert [tuple(r) for r in g] == [("github.com", "o", "r", "v1"), ("git.example.com", "o", "r", None)]

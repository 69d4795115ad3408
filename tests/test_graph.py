from pyspark.sql import functions as F

from ravelin.operators import extraction, graph, parity, resolution, sync

NODE = "id string, name string, qualified_name string, kind string, file_path string, language string, start_line int, end_line int, updated_at long, docstring string, signature string"
EDGE = "source string, target string, kind string, line int, col int"


def nodes(spark, rows):
    return spark.createDataFrame([(i, n, q, k, f, "python", a, z, 1, d, s) for i, n, q, k, f, a, z, d, s in rows], NODE)


ROWS = [
    ("f1", "load", "load", "function", "a.py", 1, 9, "Reads the table.", "(path)"),
    ("f2", "save", "Store::save", "method", "a.py", 11, 30, None, None),
    ("c1", "Store", "Store", "class", "a.py", 10, 40, "Keeps tables.", None),
    ("f3", "main", "main", "function", "b.py", 1, 5, "", "()"),
    ("f4", "load", "other::load", "function", "c.py", 3, 4, None, None),
]


def test_search_falls_back_to_substrings(spark):
    n = nodes(spark, ROWS)
    assert {r["id"] for r in graph.search(n, "keeps tables").collect()} == {"c1"}
    assert {r["id"] for r in graph.search(n, "oad").collect()} == {"f1", "f4"}
    assert graph.search(n, "  ").count() == 0
    assert graph.search(n, "load", limit=0).count() == 1


def test_callers_limit_counts_sites(spark):
    e = spark.createDataFrame([("f3", "f1", "calls", 1, 1), ("f3", "f1", "calls", 2, 1), ("f2", "f1", "calls", 3, 1), ("f2", None, "calls", 3, 1)], EDGE)
    got = graph.callers(nodes(spark, ROWS), e, "load", 2)
    assert {r["id"] for r in got.collect()} == {"f3", "f2"} or got.count() <= 2
    assert graph.callers(nodes(spark, ROWS), e, "nothing").count() == 0


def test_impact_depth_and_circles(spark):
    e = spark.createDataFrame([("f2", "f1", "calls", 1, 1), ("c1", "f2", "references", 1, 1), ("f3", "c1", "imports", 1, 1), ("f1", "f3", "calls", 1, 1)], EDGE)
    got = {r["id"]: r["hop"] for r in graph.impact(spark, nodes(spark, ROWS), e, "load", 2).collect()}
    assert got == {"f2": 1, "c1": 2}


def test_enclosing_is_tightest(spark):
    p = spark.createDataFrame([("a.py", 12), ("a.py", 10), ("a.py", 99), (None, 1)], "path string, line int")
    assert {(r["line"], r["id"]) for r in graph.enclosing(nodes(spark, ROWS), p).collect()} == {(12, "f2"), (10, "c1")}


def test_resolution_tiers(spark):
    defs = spark.createDataFrame([("1", "go", "go", "x/a.py", "python"), ("2", "go", "b::go", "x/b.py", "python"), ("3", "only", "only", "y/c.py", "python"), ("4", "near", "near", "x/d.py", "python"), ("5", "near", "near", "y/d.py", "python")], "id string, name string, qualified_name string, def_file string, def_language string")
    sites = spark.createDataFrame([("x/a.py", "python", "go"), ("x/z.py", "python", "go"), ("q.py", "python", "only"), ("x/q.py", "python", "near"), ("q.py", "python", "near")], "file string, language string, name string")
    imp = spark.createDataFrame([("x/z.py", "x/b.py")], "file string, imported string")
    got = {(r["file"], r["name"]): (r["id"], r["resolved_by"]) for r in resolution.names(sites, defs, imp).collect()}
    assert got == {("x/a.py", "go"): ("1", "same-file"), ("x/z.py", "go"): ("2", "import"), ("q.py", "only"): ("3", "unique"), ("x/q.py", "near"): ("4", "same-dir")}


_KIND = 4
FILES = [
    ("pkg/a.py", "python", "import pkg.b\n\nclass A:\n    def go(self):\n        return self.stop()\n\n    def stop(self):\n        return helper()\n"),
    ("pkg/b.py", "python", '"""Doc."""\n\ndef helper(x=1) -> int:\n    """Helps."""\n    return x\n'),
    ("c.rs", "rust", "pub fn run(a: i64) -> i64 {\n    a\n}\n\nstruct S;\n"),
    ("bad.py", "python", "def broken(:\n"),
]


def test_texts_that_do_not_parse_keep_their_definitions():
    from ravelin.operators import parsing

    text = "from a import b\n\nclass A:\n    def go(self):\n        x = (\n\n    async def stop(self):\n        pass\n\ndef f(:\n    pass\n"
    rows = [dict(zip(parsing.COLUMNS, r)) for r in parsing.extract("p.py", "python", text)]
    got = {(r["kind"], r["qualified_name"], r["start_line"], r["end_line"], r["is_async"]) for r in rows if r["row"] == "node" and r["kind"] != "file"}
    assert got == {("import", "a", 1, 1, False), ("class", "A", 3, 8, False), ("method", "A::go", 4, 5, False), ("method", "A::stop", 7, 8, True), ("function", "f", 10, 11, False)}
    for lang in parsing.RULES:
        for broken in ("", "}", "{{{", "class", "fn (", "func (", "\x00'", '"', "impl for {", "def", "type", "import", "#", "#include", "enum E {", "use ;", "package", "@", "<", "a::b::", "namespace", "x.y.(", "const", "var x", "case", "fun A.", "struct S"):
            assert parsing.extract("p", lang, broken)[0][_KIND] == "file"


def test_extraction_and_resolution(spark):
    f = spark.createDataFrame(FILES, "path string, language string, content string")
    n, e = extraction.build(f)
    kinds = {(r["kind"], r["qualified_name"]) for r in n.collect()}
    assert {("class", "A"), ("method", "A::go"), ("function", "helper"), ("function", "run"), ("struct", "S"), ("file", "bad.py")} <= kinds
    name = {r["id"]: r["qualified_name"] for r in n.collect()}
    links = {(name.get(r["source"]), name.get(r["target"]), r["kind"]) for r in e.collect()}
    assert ("A::stop", "helper", "calls") in links and ("A::go", "A::stop", "calls") in links and ("A", "A::go", "contains") in links and not any(k == "imports" for _, _, k in links)


def test_sync_equals_rebuild(spark):
    old = spark.createDataFrame(FILES, "path string, language string, content string")
    changed = [(p, lang, t.replace("helper", "helped") if p == "pkg/b.py" else t) for p, lang, t in FILES]
    new = spark.createDataFrame(changed, "path string, language string, content string")
    n0, e0 = extraction.build(old)
    n1, e1 = extraction.build(new)
    gone = spark.createDataFrame([("pkg/b.py",)], "path string")
    again = sync.touched_files(n0, e0, gone, n1.where("file_path = 'pkg/b.py'").select("name"))
    assert [r[0] for r in again.collect()] == ["pkg/a.py"]
    fresh = n1.where("file_path = 'pkg/b.py'")
    touched = n1.where("file_path IN ('pkg/a.py', 'pkg/b.py')").select(F.col("id").alias("source"))
    n2, e2 = sync.apply(n0, e0, gone, again, fresh, e1.join(touched, "source", "left_semi").select(*e0.columns))
    key = ["source", "target", "kind", "line"]
    assert {r[0] for r in n2.select("id").collect()} == {r[0] for r in n1.select("id").collect()}
    assert {tuple(r) for r in e2.select(*key).collect()} == {tuple(r) for r in e1.select(*key).collect()}


def test_return_types():
    r = extraction.return_type
    assert r("(a: fn(x) -> y) -> Result<Vec<Pkg>>") == ("Vec<Pkg>", None, "Pkg")
    assert r("(a): Promise<Scalar>") == ("Scalar", "Scalar", None)
    assert r("(x) -> Foo | None") == ("Foo | None", None, None)
    assert r("() -> pkg.Thing[]") == ("pkg.Thing[]", None, "Thing")
    assert r(None) == r("") == r("(x") == r("(x)") == (None, None, None)


def test_parity_bags(spark):
    g = spark.createDataFrame([("function", "a", "f"), ("function", "a", "f"), ("class", "b", None)], "kind string, qualified_name string, file_path string")
    o = spark.createDataFrame([("function", "a", "f"), ("class", "b", ""), ("class", "c", "f")], "kind string, qualified_name string, file_path string")
    m = {r["qualified_name"]: (r["matched"], r["missing"], r["extra"]) for r in parity.bag_match(g, o, parity.NODE_KEY).collect()}
    assert m == {"a": (1, 1, 0), "b": (1, 0, 0), "c": (0, 0, 1)}
    assert parity.recall(parity.bag_match(g.limit(0), o, parity.NODE_KEY), ["kind"]).where("recall_pct IS NOT NULL").count() == 0
    w = parity.whitelist(o, [{"kind": "cl*"}, {"qualified_name": "*"}]).collect()
    assert {r["qualified_name"]: r["rule"] for r in w} == {"a": 1, "b": 0, "c": 0}

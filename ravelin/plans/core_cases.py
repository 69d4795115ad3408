"""Queries over small stated inputs, for operators whose inputs no test table has.

Each input is a table of literal rows, written the same way for Spark and for SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text
from ravelin.models import parse_variants
from ravelin.operators import answers, extraction, parity, pipeline, reports, resolution, storage, vector
from ravelin.session import Cut
from ravelin.sources.tables import load


def _sql(rows: list[tuple], names: str) -> str:
    """A table of literal rows, in the words Spark and the other engine share."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names}))"


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- sources of several languages, and what they hold

SOURCES = [
    ("shop/store.rs", "rust", "use crate::cart::Cart;\n\npub struct Store {\n    cart: Cart,\n}\n\nimpl Store {\n    pub fn open(path: &str) -> Result<Store> {\n        load(path)\n    }\n\n    pub fn total(&self) -> i64 {\n        self.cart.sum()\n    }\n}\n\npub trait Priced {\n    fn price(&self) -> i64 {\n        0\n    }\n}\n\nimpl Priced for Store {}\n\nfn load(path: &str) -> Result<Store> {\n    panic!()\n}\n"),
    ("shop/cart.rs", "rust", "pub struct Cart;\n\nimpl Cart {\n    pub fn sum(&self) -> i64 {\n        let s = Store::open(\"a\")?;\n        s.total()\n    }\n}\n\npub fn all() -> Vec<Cart> {\n    Vec::new()\n}\n\npub fn run() {\n    for c in all() {\n        c.sum();\n    }\n}\n"),
    ("web/base.ts", "typescript", "export interface Shape { area(): number; }\nexport class Base {}\nexport class Disc extends Base implements Shape {\n  r: number;\n  area(): number { return round(this.r); }\n}\nexport function round(x: number): number { return x; }\n"),
    ("web/main.ts", "typescript", "import { Disc, round } from \"./base\";\nexport async function draw(d: Disc): Promise<number> {\n  const e = new Disc();\n  return d.area() + e.area() + round(1);\n}\n"),
    ("svc/a.go", "go", "package svc\n\nimport \"fmt\"\n\ntype Node struct {\n\tBase\n\tName string\n}\n\ntype Base struct{}\n\nfunc (n *Node) Show(b Base) string {\n\treturn Format(n)\n}\n\nfunc Format(n *Node) string {\n\tfmt.Println(n)\n\treturn n.Name\n}\n"),
    ("jv/Box.java", "java", "package jv;\n\nimport java.util.List;\n\npub class X {}\nclass Lid {\n    static int turn(int by) { return by; }\n}\n\nclass Box extends Lid {\n    int open(Box other) {\n        Box b = new Box();\n        return Lid.turn(1) + other.open(b) + close();\n    }\n\n    int close() { return 0; }\n}\n".replace("pub class X {}\n", "")),
    ("c/util.h", "c", "#define N 3\ntypedef long Size;\nstruct Buf {\n    Size n;\n};\nenum Mode { READ, WRITE };\nlong width(struct Buf *b);\n"),
    ("c/util.c", "c", "#include \"util.h\"\n#include <stdio.h>\n\nstatic long half(long n) {\n    return n / 2;\n}\n\nlong width(struct Buf *b) {\n    return half(b->n);\n}\n"),
    ("cpp/a.cpp", "cpp", "#include <vector>\nnamespace geo {\nclass Base {};\nclass Disc : public Base {\npublic:\n    long area() const;\n};\nlong Disc::area() const {\n    return scale(2);\n}\nlong scale(long x) { return x; }\nvoid make() { Disc *d = new Disc(); d->area(); }\n}\n"),
    ("cs/A.cs", "csharp", "using System;\nnamespace N {\n    public interface IRun { void Go(); }\n    public class Car : Base, IRun {\n        private int _n;\n        public int Speed { get; set; }\n        public void Go() { Tool.Fix(this); var c = new Car(); }\n    }\n    public class Base {}\n    public static class Tool { public static void Fix(Car c) {} }\n}\n"),
    ("kt/A.kt", "kotlin", "package app.core\n\nimport app.util.Log\n\nopen class Base\ninterface Runs\n\nclass Job : Base(), Runs {\n    suspend fun go(): Int = start()\n}\n\nfun start(): Int = 1\n"),
    ("php/a.php", "php", "<?php\nuse Lib\\Log;\ninterface Runs { function go(); }\ntrait Named { function name() { return \"\"; } }\nclass Job implements Runs {\n    use Named;\n    private int $n;\n    const MAX = 3;\n    public static function make() { return new Job(); }\n    function go() { return Job::make(); }\n}\n"),
    ("rb/a.rb", "ruby", "require \"json\"\n\nmodule Tools\n  class Base\n  end\n\n  class Job < Base\n    def go\n      start(1)\n      Job.new\n    end\n\n    private\n\n    def start(n)\n      n\n    end\n  end\nend\n"),
    ("sc/A.scala", "scala", "package a\nimport scala.math.max\ntrait Runs\nclass Job(val n: Int) extends Runs {\n  def go(): Int = {\n    start(n)\n  }\n}\nobject Main {\n  val size: Int = 3\n}\ndef start(n: Int): Int = n\n"),
    ("sw/A.swift", "swift", "import Foundation\nprotocol Runs {}\nclass Base {}\nclass Job: Base, Runs {\n    func go(n: Int) -> Base {\n        return make()\n    }\n}\nfunc make() -> Base {\n    return Base()\n}\nenum Mode {\n    case on\n    case off\n}\n"),
    ("py/a.py", "python", "from b import Tool\nimport os\n\nLIMIT = 3\n\n\nclass Job(Base):\n    def __init__(self, tool: Tool):\n        self.tool = tool\n\n    async def go(self):\n        self.tool.use()\n        return self.stop()\n\n    def stop(self):\n        return make().use()\n\n\ndef make() -> Tool:\n    return Tool()\n"),
    ("py/b.py", "python", "class Tool:\n    def use(self):\n        return os.getcwd()\n"),
]


def _built(spark: SparkSession):
    return extraction.build(_table(spark, SOURCES, "path string, language string, content string"))


def extracted_symbols(spark, d):
    """Kinds and names found in sources of thirteen languages."""
    n, _ = _built(spark)
    return n.where("kind <> 'file'").select("file_path", "kind", "qualified_name", "start_line", "is_async", "is_static")


def extracted_links(spark, d):
    """References between these symbols, by name at both ends."""
    n, e = _built(spark)
    names = n.select("id", F.coalesce(F.when(F.col("kind") == "file", F.col("file_path")), "qualified_name").alias("q"))
    j = e.where("kind <> 'contains'").join(names.select(F.col("id").alias("source"), F.col("q").alias("from_name")), "source").join(names.select(F.col("id").alias("target"), F.col("q").alias("to_name")), "target")
    return j.select("kind", "from_name", "to_name", "line", F.get_json_object("metadata", "$.resolvedBy").alias("resolved_by"))


#: What is in these sources, checked by reading them.
SYMBOLS = [
    ("c/util.c", "function", "half", 4, False, False), ("c/util.c", "function", "width", 8, False, False), ("c/util.c", "import", "stdio.h", 2, False, False),
    ("c/util.c", "import", "util.h", 1, False, False), ("c/util.h", "enum", "Mode", 6, False, False), ("c/util.h", "enum_member", "Mode::READ", 6, False, False),
    ("c/util.h", "enum_member", "Mode::WRITE", 6, False, False), ("c/util.h", "struct", "Buf", 3, False, False), ("c/util.h", "type_alias", "Size", 2, False, False),
    ("cpp/a.cpp", "class", "Base", 3, False, False), ("cpp/a.cpp", "class", "Disc", 4, False, False), ("cpp/a.cpp", "function", "make", 12, False, False),
    ("cpp/a.cpp", "function", "scale", 11, False, False), ("cpp/a.cpp", "import", "vector", 1, False, False), ("cpp/a.cpp", "method", "Disc::area", 8, False, False),
    ("cs/A.cs", "class", "Base", 9, False, False), ("cs/A.cs", "class", "Car", 4, False, False), ("cs/A.cs", "class", "Tool", 10, False, True), ("cs/A.cs", "field", "Car::_n", 5, False, False),
    ("cs/A.cs", "import", "System", 1, False, False), ("cs/A.cs", "interface", "IRun", 3, False, False), ("cs/A.cs", "method", "Car::Go", 7, False, False),
    ("cs/A.cs", "method", "IRun::Go", 3, False, False), ("cs/A.cs", "method", "Tool::Fix", 10, False, True), ("cs/A.cs", "property", "Car::Speed", 6, False, False),
    ("jv/Box.java", "class", "jv::Box", 9, False, False), ("jv/Box.java", "class", "jv::Lid", 5, False, False), ("jv/Box.java", "import", "jv::java.util.List", 3, False, False),
    ("jv/Box.java", "method", "jv::Box::close", 15, False, False), ("jv/Box.java", "method", "jv::Box::open", 10, False, False), ("jv/Box.java", "method", "jv::Lid::turn", 6, False, True),
    ("jv/Box.java", "namespace", "jv", 1, False, False), ("kt/A.kt", "class", "app.core::Base", 5, False, False), ("kt/A.kt", "class", "app.core::Job", 8, False, False),
    ("kt/A.kt", "function", "app.core::start", 12, False, False), ("kt/A.kt", "import", "app.core::app.util.Log", 3, False, False), ("kt/A.kt", "interface", "app.core::Runs", 6, False, False),
    ("kt/A.kt", "method", "app.core::Job::go", 9, True, False), ("kt/A.kt", "namespace", "app.core", 1, False, False), ("php/a.php", "class", "Job", 5, False, False),
    ("php/a.php", "constant", "Job::MAX", 8, False, False), ("php/a.php", "field", "Job::n", 7, False, False), ("php/a.php", "import", "Lib\\Log", 2, False, False),
    ("php/a.php", "interface", "Runs", 3, False, False), ("php/a.php", "method", "Job::go", 10, False, False), ("php/a.php", "method", "Job::make", 9, False, True),
    ("php/a.php", "method", "Named::name", 4, False, False), ("php/a.php", "method", "Runs::go", 3, False, False), ("php/a.php", "trait", "Named", 4, False, False),
    ("py/a.py", "class", "Job", 7, False, False), ("py/a.py", "function", "make", 19, False, False), ("py/a.py", "import", "b", 1, False, False), ("py/a.py", "import", "os", 2, False, False),
    ("py/a.py", "method", "Job::__init__", 8, False, False), ("py/a.py", "method", "Job::go", 11, True, False), ("py/a.py", "method", "Job::stop", 15, False, False),
    ("py/a.py", "variable", "LIMIT", 4, False, False), ("py/b.py", "class", "Tool", 1, False, False), ("py/b.py", "method", "Tool::use", 2, False, False),
    ("rb/a.rb", "class", "Tools::Base", 4, False, False), ("rb/a.rb", "class", "Tools::Job", 7, False, False), ("rb/a.rb", "import", "json", 1, False, False),
    ("rb/a.rb", "method", "Tools::Job::go", 8, False, False), ("rb/a.rb", "method", "Tools::Job::start", 15, False, False), ("rb/a.rb", "module", "Tools", 3, False, False),
    ("sc/A.scala", "class", "Job", 4, False, False), ("sc/A.scala", "class", "Main", 9, False, False), ("sc/A.scala", "field", "Main::size", 10, False, False),
    ("sc/A.scala", "function", "start", 12, False, False), ("sc/A.scala", "import", "scala", 2, False, False), ("sc/A.scala", "method", "Job::go", 5, False, False),
    ("sc/A.scala", "trait", "Runs", 3, False, False), ("shop/cart.rs", "function", "all", 10, False, False), ("shop/cart.rs", "function", "run", 14, False, False),
    ("shop/cart.rs", "method", "Cart::sum", 4, False, False), ("shop/cart.rs", "struct", "Cart", 1, False, False), ("shop/store.rs", "function", "load", 25, False, False),
    ("shop/store.rs", "import", "crate", 1, False, False), ("shop/store.rs", "method", "Priced::price", 18, False, False), ("shop/store.rs", "method", "Store::open", 8, False, False),
    ("shop/store.rs", "method", "Store::total", 12, False, False), ("shop/store.rs", "struct", "Store", 3, False, False), ("shop/store.rs", "trait", "Priced", 17, False, False),
    ("svc/a.go", "function", "Format", 16, False, False), ("svc/a.go", "import", "fmt", 3, False, False), ("svc/a.go", "method", "Node::Show", 12, False, False),
    ("svc/a.go", "struct", "Base", 10, False, False), ("svc/a.go", "struct", "Node", 5, False, False), ("sw/A.swift", "class", "Base", 3, False, False),
    ("sw/A.swift", "class", "Job", 4, False, False), ("sw/A.swift", "enum", "Mode", 12, False, False), ("sw/A.swift", "enum_member", "Mode::off", 14, False, False),
    ("sw/A.swift", "enum_member", "Mode::on", 13, False, False), ("sw/A.swift", "function", "make", 9, False, False), ("sw/A.swift", "import", "Foundation", 1, False, False),
    ("sw/A.swift", "interface", "Runs", 2, False, False), ("sw/A.swift", "method", "Job::go", 5, False, False), ("web/base.ts", "class", "Base", 2, False, False),
    ("web/base.ts", "class", "Disc", 3, False, False), ("web/base.ts", "function", "round", 7, False, False), ("web/base.ts", "interface", "Shape", 1, False, False),
    ("web/base.ts", "method", "Disc::area", 5, False, False), ("web/base.ts", "method", "Disc::r", 4, False, False), ("web/main.ts", "function", "draw", 2, True, False),
    ("web/main.ts", "import", "./base", 1, False, False),
]
LINKS = [
    ("calls", "Car::Go", "Tool::Fix", 7, "qualified-name"), ("calls", "Cart::sum", "Store::open", 5, "qualified-name"), ("calls", "Cart::sum", "Store::total", 6, "instance-method"),
    ("calls", "Disc::area", "round", 5, "same-file"), ("calls", "Disc::area", "scale", 9, "same-file"), ("calls", "Job::go", "Job::make", 10, "qualified-name"),
    ("calls", "Job::go", "Job::stop", 13, "instance-method"), ("calls", "Job::go", "Tool::use", 12, "instance-method"), ("calls", "Job::go", "make", 6, "same-file"),
    ("calls", "Job::go", "start", 6, "same-file"), ("calls", "Job::stop", "Tool::use", 16, "instance-method"), ("calls", "Job::stop", "make", 16, "same-file"),
    ("calls", "Node::Show", "Format", 13, "same-file"), ("calls", "Store::open", "load", 9, "same-file"), ("calls", "Store::total", "Cart::sum", 13, "instance-method"),
    ("calls", "Tools::Job::go", "Tools::Job::start", 9, "same-file"), ("calls", "app.core::Job::go", "app.core::start", 9, "same-file"), ("calls", "draw", "Disc::area", 4, "instance-method"),
    ("calls", "draw", "Disc::area", 4, "instance-method"), ("calls", "draw", "round", 4, "import"), ("calls", "jv::Box::open", "jv::Box::close", 12, "same-file"),
    ("calls", "jv::Box::open", "jv::Box::open", 12, "qualified-name"), ("calls", "jv::Box::open", "jv::Lid::turn", 12, "qualified-name"), ("calls", "make", "Disc::area", 12, "same-file"),
    ("calls", "run", "Cart::sum", 16, "instance-method"), ("calls", "run", "all", 15, "same-file"), ("calls", "width", "half", 9, "same-file"), ("extends", "Car", "Base", 4, "same-file"),
    ("extends", "Disc", "Base", 3, "same-file"), ("extends", "Disc", "Base", 4, "same-file"), ("extends", "Job", "Base", 4, "same-file"), ("extends", "Job", "Runs", 4, "same-file"),
    ("extends", "Node", "Base", 6, "same-file"), ("extends", "Tools::Job", "Tools::Base", 7, "same-file"), ("extends", "app.core::Job", "app.core::Base", 8, "same-file"),
    ("extends", "jv::Box", "jv::Lid", 9, "same-file"), ("implements", "Car", "IRun", 4, "same-file"), ("implements", "Disc", "Shape", 3, "same-file"), ("implements", "Job", "Named", 6, "same-file"),
    ("implements", "Job", "Runs", 4, "same-file"), ("implements", "Job", "Runs", 5, "same-file"), ("implements", "Store", "Priced", 23, "same-file"),
    ("implements", "app.core::Job", "app.core::Runs", 8, "same-file"), ("imports", "app.core", "app.core::app.util.Log", 3, "exact-match"), ("imports", "c/util.c", "c/util.h", 1, "import"),
    ("imports", "c/util.c", "stdio.h", 2, "exact-match"), ("imports", "cpp/a.cpp", "vector", 1, "exact-match"), ("imports", "cs/A.cs", "System", 1, "exact-match"),
    ("imports", "jv", "jv::java.util.List", 3, "exact-match"), ("imports", "php/a.php", "Lib\\Log", 2, "exact-match"), ("imports", "py/a.py", "b", 1, "exact-match"),
    ("imports", "rb/a.rb", "json", 1, "exact-match"), ("imports", "sc/A.scala", "scala", 2, "exact-match"), ("imports", "shop/store.rs", "crate", 1, "exact-match"),
    ("imports", "svc/a.go", "fmt", 3, "exact-match"), ("imports", "sw/A.swift", "Foundation", 1, "exact-match"), ("imports", "web/main.ts", "./base", 1, "qualified-name"),
    ("instantiates", "Car::Go", "Car", 7, "same-file"), ("instantiates", "Job::make", "Job", 9, "same-file"), ("instantiates", "Tools::Job::go", "Tools::Job", 10, "same-file"),
    ("instantiates", "draw", "Disc", 3, "import"), ("instantiates", "jv::Box::open", "jv::Box", 11, "same-file"), ("instantiates", "make", "Base", 10, "same-file"),
    ("instantiates", "make", "Disc", 12, "same-file"), ("instantiates", "make", "Tool", 20, "import"), ("references", "Format", "Node", 16, "same-file"),
    ("references", "Job::go", "Base", 5, "same-file"), ("references", "Node::Show", "Base", 12, "same-file"), ("references", "Store::open", "Store", 8, "same-file"),
    ("references", "Tool::Fix", "Car", 10, "same-file"), ("references", "all", "Cart", 10, "same-file"), ("references", "draw", "Disc", 2, "import"),
    ("references", "jv::Box::open", "jv::Box", 10, "same-file"), ("references", "load", "Store", 25, "same-file"), ("references", "make", "Base", 9, "same-file"),
]

# ---- receivers typed through return types

_DEFS = [
    ("open", "open", "a.rs", "function", "(p: &Path) -> Result<Db>"), ("query", "Db::query", "a.rs", "method", "(&self) -> Vec<Row>"), ("next", "Row::next", "b.rs", "method", "(&self) -> Self"), ("list", "list", "b.rs", "function", "() -> Vec<Row>"),
    ("twice", "twice", "x.rs", "function", "() -> Db"), ("twice", "twice", "y.rs", "function", "() -> Row"), ("load", "Db::load", "a.rs", "method", "() -> Self"), ("maybe", "maybe", "a.rs", "function", "() -> Db | None"),
]
_CHAINS = [
    (1, "m.rs", [("bare", None, "open")]), (2, "m.rs", [("qualified", "Db", "load"), ("method", None, "query"), ("element", None, None)]), (3, "m.rs", [("bare", None, "list"), ("element", None, None), ("method", None, "next")]),
    (4, "m.rs", [("bare", None, "twice")]), (5, "x.rs", [("bare", None, "twice")]), (6, "m.rs", [("type", None, "Row")]), (7, "m.rs", [("bare", None, "list")]), (8, "m.rs", [("bare", None, "maybe")]), (9, "m.rs", [("bare", None, "nothing")]),
]


def receiver_types(spark, d):
    """The type of receivers through calls, loops and ``Self``; ambiguous calls give none."""
    defs = _table(spark, [(str(i), *r, "rust") for i, r in enumerate(_DEFS)], "id string, name string, qualified_name string, def_file string, kind string, signature string, def_language string")
    sites = _table(spark, [(n, f, "rust", [dict(zip(("op", "qualifier", "name"), s)) for s in c]) for n, f, c in _CHAINS], f"site long, file string, language string, steps {resolution.STEPS}")
    none = _table(spark, [], "file string, imported string")
    returns = extraction.owners(defs)
    cols = ["id", "name", "qualified_name", "def_file", "def_language"]
    return resolution.receivers(Cut(spark, "cases"), sites, defs.select(*cols), returns, none, defs.select(*cols).limit(0))


def return_type_cases(spark, d):
    s = _table(spark, [(str(i), x) for i, x in enumerate(_SIGNATURES)], "id string, signature string")
    return extraction.return_types(s)


_SIGNATURES = ["() -> Result<Vec<Pkg>>", "(a): Promise<Scalar>", "(x) -> Foo | None", "() -> HashMap<K, V>", "(f: fn(a) -> b) -> &mut Db", "(x)", None, "() -> pkg.Thing[]", "() -> Option<Box<Db>>"]


# ---- evidence and answers

_MESSAGES = [("s", 1, "call", "c1", "search_docs", '{"q": 1}', None), ("s", 2, "tool", "c1", None, None, "first answer"), ("s", 3, "tool", "c9", None, None, "lost call"), ("t", 1, "call", "c1", "read_code", None, None), ("t", 2, "tool", "c1", None, None, "x" * 5)]
_MESSAGE = "session string, seq int, role string, call_id string, tool string, arguments string, content string"


def tool_evidence(spark, d):
    return answers.evidence(_table(spark, _MESSAGES, _MESSAGE))


_BODIES = [("a", 1, "x" * 40), ("a", 2, "y" * 70), ("a", 3, "z" * 50), ("b", 1, None), ("b", 2, "é" * 60)]


def body_budget(spark, d):
    """Bodies taken while they fit 100 bytes; a body that does not fit is passed over."""
    return answers.within_budget(_table(spark, _BODIES, "answer string, place int, body string"), "answer", "place", "body", 100).select("answer", "place", "taken")


_RANKED = [(1, "f"), (2, "g"), (3, "f"), (4, "h")]
_OWNED = [("n1", "f"), ("n2", "f"), ("n3", "g")]


def rerank_rejoin(spark, d):
    return answers.rejoin(_table(spark, _RANKED, "rank int, key string"), _table(spark, _OWNED, "id string, key string"), "key")


_FOUND = [("s", 2, "b.py"), ("s", 1, "a.py"), ("s", 3, "b.py"), ("t", 1, None), ("t", 2, "c.py")]


def finding_files(spark, d):
    return reports.finding_files(_table(spark, _FOUND, "session string, finding int, file string")).select("session", F.array_join("files", " ").alias("files"))


_RUNS = [("q", 2.0), ("q", 1.0), ("q", 4.0), ("r", 0.5)]


def timing_report(spark, d):
    return reports.timings(_table(spark, _RUNS, "name string, seconds double"), ["name"])


# ---- packages

_WANTED, _LOCK, _HAVE = [("a", "1"), ("b", None), ("c", "2"), ("d", "1")], [("b", "5")], [("a", "1"), ("b", "4"), ("c", "2"), ("z", "1")]


def sync_actions(spark, d):
    t = lambda rows: _table(spark, rows, "name string, version string")
    return storage.sync_plan(t(_WANTED), t(_LOCK), t(_HAVE))


_STORED = [("src/a.rs",), ("lib/src/a.rs",), ("lib/b.rs",), ("other/c.rs",)]
_ROOTS = [("src", "/work/one/src"), ("lib/src", "/work/lib/src/"), ("lib", "/work/lib")]


def stored_paths(spark, d):
    """Where stored paths lie: the longest namespace wins."""
    return storage.real_paths(_table(spark, _STORED, "path string"), _table(spark, _ROOTS, "namespace string, root string"))


def package_versions(spark, d):
    """Versions of each package: here the scans of each package's files."""
    b = load(spark, d, "file_scans").select(F.col("package").alias("name"), F.col("content_hash").alias("version")).where("version IS NOT NULL")
    return reports.version_counts(b)


_COMMITS = [("a" * 40,), ("A" * 40,), ("abc",), (None,)]


def commit_validation(spark, d):
    return storage.valid_commits(_table(spark, _COMMITS, "commit string"))


def document_paths(spark, d):
    """Stored document paths without the number of their chunk."""
    p = load(spark, d, "doc_slices").select("slice_id", F.concat("path", F.lit("#"), F.col("chunk_count").cast("string")).alias("stored")).distinct()
    return p.select("slice_id", text.without_chunk(F.col("stored")).alias("path"), text.doc_path_matches(F.col("stored"), "README.md").alias("hit"))


_ANSWER = "<think>no</think>\n- lex: frozen header\n2. vec: how a socket is locked\nplain words\nlex: FROZEN header\nhyde: text\nlex: five"


def variant_lines(spark, d):
    """A model's answer as variants: kinds read, thinking and repeats dropped, four kept."""
    return _table(spark, [(n, *v) for n, v in enumerate(parse_variants(_ANSWER), 1)], "n int, kind string, words string")


def run_plan(spark, d):
    rows = [(r.number, r.words, r.weight, r.lexical, r.vectors) for r in pipeline.plan("a b", [("lex", "a"), ("vec", "b"), ("hyde", "c")])]
    return _table(spark, rows, "number int, words string, weight double, lexical boolean, vectors boolean")


def embed_plan(spark, d):
    """Tables whose vectors are of another model or dimension."""
    t = _table(spark, _MODELS, "name string, model_id string, dim int")
    return vector.to_embed(t, "m1", 64).select("name")


_MODELS = [("a", "m1", 64), ("b", "m1", 32), ("c", None, None), ("d", "m2", 64)]


# ---- comparison

_DIFFS = [
    ("missing", "calls", "a::f", "b::g", "rust", "python", 0, None, None), ("missing", "references", "a", "T", "rust", "rust", 1, None, None), ("missing", "references", "a", "U", "rust", "rust", 0, None, None),
    ("extra", "calls", "x", "y", "go", "go", 0, None, None), ("attr", "is_async", "f", "", "rust", "rust", 1, "false", "true"), ("attr", "is_async", "g", "", "rust", "rust", 1, "true", "false"),
]
_RULES = [{"side": "missing", "kind": "references", "only_duplicates": True}, {"side": "missing", "kind": "calls", "cross_language": True}, {"side": "attr", "kind": "is_async", "direction": "ours_true"}, {"side": "extra", "source": "x*", "language": "java"}]


def parity_rules(spark, d):
    t = _table(spark, _DIFFS, "side string, kind string, source string, target string, source_language string, target_language string, matched int, golden string, ours string")
    return parity.allowed(t, _RULES).select("side", "kind", "source", "target", "rule")


_E1, _E2, _NAMES = [("calls", "old::a", "b"), ("calls", "old::a", "b"), ("calls", "c", "old::a")], [("calls", "new::a", "b"), ("calls", "c", "new::a"), ("calls", "c", "d")], [("old::a", "new::a")]


def parity_translated(spark, d):
    """Edges compared after the names of renamed nodes were brought together."""
    cols = "kind string, from_name string, to_name string"
    g = parity.translated(_table(spark, _E1, cols), _table(spark, _NAMES, "golden_name string, our_name string"), ["from_name", "to_name"])
    return parity.bag_match(g, _table(spark, _E2, cols), ["kind", "from_name", "to_name"])


_QUERIES = [
    extracted_symbols, extracted_links, receiver_types, return_type_cases, tool_evidence, body_budget, rerank_rejoin, finding_files, timing_report, sync_actions, stored_paths, package_versions, commit_validation, document_paths, variant_lines, run_plan,
    embed_plan, parity_rules, parity_translated,
]


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle():
    messages = _sql(_MESSAGES, "session, seq, role, call_id, tool, arguments, content")
    return {
        "extracted_symbols": f"SELECT * FROM {_sql(SYMBOLS, 'file_path, kind, qualified_name, start_line, is_async, is_static')}",
        "extracted_links": f"SELECT * FROM {_sql(LINKS, 'kind, from_name, to_name, line, resolved_by')}",
        "receiver_types": f"SELECT site, type FROM {_sql([(1, 'Db'), (2, 'Row'), (3, 'Row'), (5, 'Db'), (6, 'Row')], 'site, type')}",
        "return_type_cases": "SELECT id, \"full\", bare, element FROM " + _sql(
            [("0", "Vec<Pkg>", None, "Pkg"), ("1", "Scalar", "Scalar", None), ("2", "Foo | None", None, None), ("3", "HashMap<K, V>", None, "K"), ("4", "Db", "Db", None), ("7", "pkg.Thing[]", None, "Thing"), ("8", "Db", "Db", None)], "id, \"full\", bare, element"),
        "tool_evidence": f"""WITH m AS {messages}, c AS (SELECT session, call_id, arg_min(tool, seq) AS tool, arg_min(arguments, seq) AS arguments FROM m WHERE role = 'call' GROUP BY ALL)
SELECT a.session, a.seq, coalesce(c.tool, 'tool') AS tool, coalesce(c.arguments, '{{}}') AS arguments, substring(a.content, 1, 4000) AS text FROM m a LEFT JOIN c USING (session, call_id) WHERE a.role = 'tool'""",
        "body_budget": f"""WITH RECURSIVE b AS (SELECT *, coalesce(strlen(body), 0) AS n FROM {_sql(_BODIES, 'answer, place, body')}), r AS (
SELECT answer, place, n <= 100 AS taken, 100 - CASE WHEN n <= 100 THEN n ELSE 0 END AS rest FROM b WHERE place = 1
UNION ALL SELECT b.answer, b.place, b.n <= r.rest, r.rest - CASE WHEN b.n <= r.rest THEN b.n ELSE 0 END FROM r JOIN b ON b.answer = r.answer AND b.place = r.place + 1) SELECT answer, place, taken FROM r""",
        "rerank_rejoin": f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank) AS k FROM {_sql(_RANKED, 'rank, key')}), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS k FROM {_sql(_OWNED, 'id, key')})
SELECT key, rank, id FROM a JOIN b USING (key, k)""",
        "finding_files": f"SELECT session, string_agg(file, ' ' ORDER BY f) AS files FROM (SELECT session, file, min(finding) AS f FROM {_sql(_FOUND, 'session, finding, file')} WHERE file IS NOT NULL GROUP BY ALL) GROUP BY session",
        "timing_report": f"SELECT name, count(*) AS runs, round(avg(seconds::DOUBLE), 6) AS mean, round(median(seconds::DOUBLE), 6) AS median, min(seconds)::DOUBLE AS least, max(seconds)::DOUBLE AS most, round(sum(seconds::DOUBLE), 6) AS total FROM {_sql(_RUNS, 'name, seconds')} GROUP BY name",
        "sync_actions": f"""WITH w AS {_sql(_WANTED, 'name, version')}, k AS {_sql(_LOCK, 'name, version')}, i AS (SELECT name, list(version) AS have FROM {_sql(_HAVE, 'name, version')} GROUP BY name)
SELECT coalesce(w.name, i.name) AS name, CASE WHEN w.name IS NULL THEN 'prune' WHEN have IS NULL THEN 'install' WHEN coalesce(w.version, k.version) IS NOT NULL AND NOT list_contains(have, coalesce(w.version, k.version)) THEN 'update' ELSE 'keep' END AS action
FROM w FULL JOIN i ON w.name = i.name LEFT JOIN k ON k.name = coalesce(w.name, i.name)""",
        "stored_paths": f"""SELECT path, arg_max(rtrim(root, '/') || '/' || substring(path, length(namespace) + 2), length(namespace)) FILTER (namespace IS NOT NULL) AS place
FROM {_sql(_STORED, 'path')} p LEFT JOIN {_sql(_ROOTS, 'namespace, root')} r ON starts_with(path, namespace || '/') GROUP BY path""",
        "package_versions": "SELECT package AS name, count(DISTINCT content_hash) AS versions FROM file_scans WHERE content_hash IS NOT NULL GROUP BY package",
        "commit_validation": f"SELECT \"commit\", coalesce(regexp_full_match(\"commit\", '[0-9a-f]{{40}}'), false) AS valid FROM {_sql(_COMMITS, chr(34) + 'commit' + chr(34))}",
        "document_paths": "SELECT DISTINCT slice_id, path, path = 'README.md' OR lower(path) LIKE '%/readme.md' OR lower(path) LIKE '%\\readme.md' AS hit FROM doc_slices",
        "variant_lines": "SELECT n, kind, words FROM " + _sql([(1, "lex", "frozen header"), (2, "vec", "how a socket is locked"), (3, "lex", "plain words"), (4, "hyde", "text")], "n, kind, words"),
        "run_plan": "SELECT number, words, weight::DOUBLE AS weight, lexical, vectors FROM " + _sql([(0, "a b", 2.0, True, True), (1, "a", 1.0, True, False), (2, "b", 1.0, False, True), (3, "c", 1.0, False, True)], "number, words, weight, lexical, vectors"),
        "embed_plan": f"SELECT name FROM {_sql(_MODELS, 'name, model_id, dim')} WHERE model_id IS DISTINCT FROM 'm1' OR dim IS DISTINCT FROM 64",
        "parity_rules": f"""SELECT side, kind, source, target, CASE WHEN side = 'missing' AND kind = 'references' AND matched > 0 THEN 0 WHEN side = 'missing' AND kind = 'calls' AND source_language <> target_language THEN 1
WHEN side = 'attr' AND kind = 'is_async' AND coalesce(golden, 'false') = 'false' AND ours = 'true' THEN 2 WHEN side = 'extra' AND source LIKE 'x%' AND source_language = 'java' THEN 3 END AS rule
FROM {_sql(_DIFFS, 'side, kind, source, target, source_language, target_language, matched, golden, ours')}""",
        "parity_translated": f"""WITH m AS {_sql(_NAMES, 'a, b')}, g AS (SELECT kind, coalesce(x.b, from_name) AS from_name, coalesce(y.b, to_name) AS to_name, count(*) AS golden FROM {_sql(_E1, 'kind, from_name, to_name')} e LEFT JOIN m x ON x.a = e.from_name LEFT JOIN m y ON y.a = e.to_name GROUP BY ALL),
o AS (SELECT *, count(*) AS ours FROM {_sql(_E2, 'kind, from_name, to_name')} GROUP BY ALL)
SELECT kind, from_name, to_name, coalesce(golden, 0) AS golden, coalesce(ours, 0) AS ours, least(coalesce(golden, 0), coalesce(ours, 0)) AS matched, coalesce(golden, 0) - least(coalesce(golden, 0), coalesce(ours, 0)) AS missing, coalesce(ours, 0) - least(coalesce(golden, 0), coalesce(ours, 0)) AS extra
FROM g FULL JOIN o USING (kind, from_name, to_name)""",
    }

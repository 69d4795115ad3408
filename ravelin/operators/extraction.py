"""First pass over source files: definitions, containment and references, and their resolution.

The rows have the shape of the symbol graph.  Extraction is one pass over the files, in
Arrow batches; resolution is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ravelin.operators import parsing, resolution
from ravelin.operators.parsing import node_id  # noqa: F401
from ravelin.session import Cut

NODE = [
    "id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "start_column", "end_column", "docstring", "signature", "visibility", "is_exported", "is_async", "is_static", "is_abstract",
    "decorators", "type_parameters",
]


def extract(files: DataFrame) -> DataFrame:
    """Definitions (row ``node``), further containment (row ``contains``) and references (row
    ``site``) of files (path, language, content); files without content or in an unknown
    language give their file node only."""
    schema = _parse_datatype_string(parsing.FIELDS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, lang, t in zip(*(c.to_pylist() for c in b.columns)) if p is not None for r in parsing.extract(p, lang, t or "")]
            cols = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return files.select("path", "language", "content").mapInArrow(run, schema)


#: Endings under which a module may be stored, in order (fixed values).
ENDINGS = [".rs", ".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", "/mod.rs", "/index.ts", "/index.tsx", "/index.js", "/__init__.py"]


def joined(folder: str, relative: str) -> str:
    """``relative`` seen from ``folder``, without steps up or on the spot."""
    out = folder.split("/") if folder else []
    for part in relative.split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def places(file: str, module: str, language: str) -> list[str]:
    """Paths a module may stand for, as written in ``file``, the likeliest first."""
    folder = file.rsplit("/", 1)[0] if "/" in file else ""
    if language in ("c", "cpp"):
        return [joined(folder, module)]
    if module.startswith(("./", "../")):
        near, far = joined(folder, module), None
    elif module.startswith("."):
        ups = len(module) - len(module.lstrip("."))
        near, far = joined(folder, "../" * (ups - 1) + module.lstrip(".").replace(".", "/")), None
    else:
        rel = module.replace("::", "/").replace(".", "/")
        near, far = joined(folder, rel), rel
    return [b + e for b in dict.fromkeys([near, far]) if b for e in ENDINGS]


def imported_files(sites: DataFrame, files: DataFrame) -> DataFrame:
    """(file, module, imported): the file an import stands for, if it is among ``files`` (path).

    The first place that exists; an include that exists nowhere near goes to the only file
    of its name.
    """
    s = sites.select("file", "name", "language").distinct()

    def run(batches):
        for b in batches:
            rows = [(f, m, lang, n, p) for f, m, lang in zip(*(c.to_pylist() for c in b.columns)) for n, p in enumerate(places(f, m, lang))]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()])], names=["file", "module", "language", "n", "place"])

    tried = s.mapInArrow(run, "file string, module string, language string, n int, place string")
    p = files.select(F.col("path").alias("place")).distinct()
    found = tried.join(p, "place").groupBy("file", "module", "language").agg(F.min_by("place", "n").alias("imported"))
    base = F.regexp_extract("place", r"([^/]*)$", 1)
    alone = p.groupBy(base.alias("_base")).agg(F.count(F.lit(1)).alias("_n"), F.min("place").alias("imported")).where("_n = 1").drop("_n")
    rest = s.where(F.col("language").isin("c", "cpp")).withColumnRenamed("name", "module").join(found.select("file", "module"), ["file", "module"], "left_anti")
    by_name = rest.withColumn("_base", F.regexp_extract("module", r"([^/]*)$", 1)).join(alone, "_base").select("file", "module", "imported")
    return found.select("file", "module", "imported").unionByName(by_name)


def build(files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a set of files: extraction, containment, resolution.

    ``known`` are nodes of other files that references may lead to as well; they are not in
    the result.

    The extracted rows are written once.  References that resolve to nothing are dropped,
    imports never: they lead to their own node, or to the file an include stands for.
    """
    spark = files.sparkSession
    cut = Cut(spark, "extraction")
    x = cut(extract(files))
    nodes = x.where("row = 'node'").dropDuplicates(["id"]).withColumnRenamed("path", "file_path").select(*NODE)
    every_node = nodes if known is None else nodes.unionByName(known.select(*NODE))
    inside = x.where("row IN ('node', 'contains') AND parent IS NOT NULL").groupBy(F.col("parent").alias("source"), F.col("id").alias("target")).agg(F.min("start_line").alias("line"))
    edges = [inside.select("source", "target", F.lit("contains").alias("kind"), F.lit(None).cast("string").alias("metadata"), "line", F.lit(None).cast("int").alias("col"))]
    sites = x.where("row = 'site'").select(F.col("path").alias("file"), "language", "id", "name", "ref_kind", "qualifier", "chain", "line", "col").distinct()
    imports = sites.where("ref_kind = 'imports'")
    pairs = cut(imported_files(imports, every_node.where("kind = 'file'").select(F.col("file_path").alias("path"))))
    to_file = F.col("language").isin("c", "cpp") & F.col("imported").isNotNull()
    strong = ~to_file & F.col("name").startswith(".")
    landed = imports.where("qualifier IS NOT NULL").join(pairs.select("file", F.col("module").alias("name"), "imported"), ["file", "name"], "left")
    by = F.when(to_file, "import").when(strong, "qualified-name").otherwise("exact-match")
    edges.append(
        landed.select(F.col("id").alias("source"), F.when(to_file, F.concat(F.lit("file:"), "imported")).otherwise(F.col("qualifier")).alias("target"), F.lit("imports").alias("kind"), resolution.metadata(F.when(strong, 0.95).otherwise(0.9), by).alias("metadata"), "line", "col")
    )
    pairs = pairs.select("file", "imported").distinct()

    def defs(kinds):
        return every_node.where(F.col("kind").isin(kinds)).select("id", "name", "qualified_name", F.col("file_path").alias("def_file"), F.col("language").alias("def_language"))

    def edge(s, found, kind, on="name", how=None):
        f = found.select("file", "language", on, F.col("id").alias("target"), F.col("confidence"), (F.lit(how[1]) if how else F.col("resolved_by")).alias("resolved_by"))
        j = s.withColumnRenamed("id", "source").join(f, ["file", "language", on])
        edges.append(j.select("source", "target", (kind if not isinstance(kind, str) else F.lit(kind)).alias("kind"), resolution.metadata(F.lit(how[0]) if how else F.col("confidence"), F.col("resolved_by")).alias("metadata"), "line", "col"))

    callable_, classes = defs(resolution.ALLOWED["calls"]), defs(resolution.ALLOWED["instantiates"])
    # All references by name in one pass: a call is looked up as a call and as a construction.
    wanted = F.expr("CASE ref_kind WHEN 'calls' THEN array('calls', 'instantiates') WHEN 'new' THEN array('instantiates') ELSE array(ref_kind) END")
    named = sites.where(F.col("ref_kind").isin("calls", "new", "references", "strict", "extends", "implements", "inherits")).withColumn("ref", F.explode(wanted))
    admits = F.create_map(*[x for k, v in resolution.ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    open_to = F.filter(F.map_keys(admits), lambda r: F.array_contains(F.element_at(admits, r), F.col("kind")))
    every = every_node.withColumn("ref", F.explode(open_to)).select("ref", F.col("kind").alias("target_kind"), "id", "name", "qualified_name", F.col("file_path").alias("def_file"), F.col("language").alias("def_language"))
    found = cut(resolution.names(named, every, pairs, ("ref",)))
    kinds = every_node.select("id", F.col("kind").alias("_kind"))
    hit = named.withColumnRenamed("id", "source").join(found.select("file", "language", "name", "ref", F.col("id").alias("target"), "confidence", "resolved_by"), ["file", "language", "name", "ref"])
    # Calls come before constructions at one site; where a language does not say whether a type
    # is extended or implemented, the target's kind does.
    hit = hit.join(kinds.where("_kind IN ('interface', 'trait')").select(F.col("id").alias("target"), F.lit(True).alias("_abstract")), "target", "left")
    kind = F.expr("CASE ref WHEN 'strict' THEN 'references' WHEN 'inherits' THEN if(_abstract, 'implements', 'extends') ELSE ref END")
    best = hit.groupBy("source", "file", "name", "ref_kind", "line", "col").agg(F.min(F.struct("ref", kind.alias("kind"), "target", resolution.metadata(F.col("confidence"), F.col("resolved_by")).alias("metadata"))).alias("_b"))
    edges.append(best.select("source", "_b.target", "_b.kind", "_b.metadata", "line", "col"))
    qual = sites.where("ref_kind = 'qualified'").withColumn("qualified_name", F.concat_ws("::", "qualifier", "name"))
    edge(qual, resolution.qualified(qual, defs(resolution.ALLOWED["qualified"]), pairs), "calls", "qualified_name", (0.95, "qualified-name"))
    met = sites.where("ref_kind = 'method'").withColumn("site", F.xxhash64("id", "name", "line", "col", "chain"))
    types = resolution.receivers(cut, met.withColumn("steps", F.from_json("chain", resolution.STEPS)), callable_, owners(every_node), pairs, classes)
    typed = met.join(types, "site").withColumn("qualified_name", F.concat_ws("::", "type", "name"))
    edge(typed, resolution.qualified(typed, callable_, pairs), "calls", "qualified_name", (0.7, "instance-method"))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    # One edge for a source, target, kind and place: the most certain.
    key = ["source", "target", "kind", "line", "col"]
    return nodes, out.groupBy(*key).agg(F.max("metadata").alias("metadata")).select("source", "target", "kind", "metadata", "line", "col")


def owners(nodes: DataFrame) -> DataFrame:
    """``return_types`` with the type that ``Self`` stands for in each."""
    o = nodes.select("id", F.regexp_extract("qualified_name", r"(?:^|::)([^:]+)::[^:]+$", 1).alias("owner"))
    return return_types(nodes).select("id", "bare", "element").join(o, "id")


# ---- return types

#: Types that stand for the value they hold (fixed values).
TRANSPARENT = {"Result", "Option", "Box", "Arc", "Rc", "Promise", "Optional", "Awaitable", "Future"}
#: Types whose element is reached by a loop (fixed values), and further names of such types.
COLLECTIONS = {
    "Vec", "VecDeque", "Deque", "Array", "ReadonlyArray", "HashMap", "BTreeMap", "IndexMap", "HashSet", "BTreeSet", "IndexSet", "FrozenSet", "Set", "Map", "List", "Dict", "Tuple", "Sequence", "Iterator", "Iterable",
    "list", "set", "tuple", "dict", "frozenset", "Collection", "ArrayList",
}


def _args(t: str) -> tuple[str, list[str]]:
    """Head and arguments of ``Head<a, b>`` or ``Head[a, b]``."""
    m = re.match(r"^([\w.:&\s]*?)\s*[<\[](.*)[>\]]$", t, re.S)
    if not m:
        return t, []
    args, depth, cur = [], 0, ""
    for c in m.group(2):
        depth += (c in "<[(") - (c in ">])")
        if c == "," and not depth:
            args.append(cur.strip())
            cur = ""
        else:
            cur += c
    return m.group(1).strip(), [*args, cur.strip()] if cur.strip() else args


def return_type(signature: str | None) -> tuple[str | None, str | None, str | None]:
    """(full, bare, element): the declared return type without wrappers, its bare name, and
    the bare name of its elements if it is a collection; nothing for unions."""
    s = signature or ""
    if not s.startswith("("):
        return None, None, None
    depth, close = 0, -1
    for i, c in enumerate(s):
        depth += (c == "(") - (c == ")")
        if not depth:
            close = i
            break
    tail = s[close + 1 :].strip() if close >= 0 else ""
    full = tail[2:].strip() if tail.startswith("->") else tail[1:].strip() if tail.startswith(":") else ""
    while full:
        full = full.lstrip("&").removeprefix("mut ").strip().strip("'\"")
        head, args = _args(full)
        if args and re.split(r"::|\.", head)[-1] in TRANSPARENT:
            full = args[0]
        else:
            break
    if not full:
        return None, None, None
    head, args = _args(full)
    if "|" in full:
        return full, None, None
    last = re.split(r"::|\.", head)[-1]
    if full.endswith("[]"):
        return full, None, re.split(r"::|\.", full[:-2])[-1]
    if last in COLLECTIONS:
        return full, None, re.split(r"::|\.", _args(args[0])[0])[-1] if args else None
    return full, last if re.fullmatch(r"\w+", last) else None, None


def return_types(nodes: DataFrame) -> DataFrame:
    """(id, full, bare, element) of every symbol with a declared return type."""

    def run(batches):
        for pdf in batches:
            rows = [(i, *return_type(s)) for i, s in zip(pdf["id"], pdf["signature"])]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["id", "full", "bare", "element"])

    return nodes.select("id", "signature").where("signature IS NOT NULL").mapInPandas(run, "id string, full string, bare string, element string")

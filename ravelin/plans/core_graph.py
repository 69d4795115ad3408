"""Queries over the symbol graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin import schemas
from ravelin.functions import text
from ravelin.operators import graph, incremental, parity, resolution, storage, sync
from ravelin.operators.skew import lookup_join
from ravelin.session import Cut
from ravelin.sources.tables import load

#: The symbol and texts that the single-symbol queries ask for.
SYMBOL, NEEDLE, PHRASE, TASK = "log_event", "probe", "parse header", "how does the scheduler parse a ledger and drop the socket"
NODE_COLS = ["id", "name", "qualified_name", "kind", "file_path", "start_line"]


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.current_nodes(load(spark, d, "nodes"))


def _all_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the packages and of the shared runtime, in one shape."""
    cols = [*NODE_COLS, "language", "package", "end_line", "docstring", "signature"]
    stubs = schemas.conform(load(spark, d, "stub_nodes"), schemas.NODES).select(*cols)
    return _nodes(spark, d).select(*cols).unionByName(stubs)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.current_edges(load(spark, d, "edges"))


def graph_status(spark, d):
    return graph.status(_nodes(spark, d), _edges(spark, d), load(spark, d, "files").select("path").distinct())


def graph_status_by_kind(spark, d):
    g = _nodes(spark, d).groupingSets([["kind", "language"], ["kind"], ["language"], []], "kind", "language")
    return g.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def symbol_lookup(spark, d):
    """All nodes of a name, tightest first."""
    return graph.resolve_ids(_all_nodes(spark, d), SYMBOL).select(*NODE_COLS, "exact")


def symbol_substring(spark, d):
    return graph.search_substring(_nodes(spark, d), NEEDLE).select(*NODE_COLS)


def symbol_phrase(spark, d):
    return graph.search_phrase(_nodes(spark, d), PHRASE.split()[1]).select("id", "name", "score")


def symbol_search(spark, d):
    """Phrase search that falls back to substrings; top 20 of two searches over one index."""
    n = Cut(spark, "symbols")(graph.indexed(_nodes(spark, d)))
    return graph.search(n, "obe", limit=20).select("id", "name", "score").unionByName(graph.search(n, "gauge", limit=20).select("id", "name", "score"))


def callers(spark, d):
    """The first 50 call sites' distinct callers of the most called function."""
    return graph.callers(_all_nodes(spark, d), _edges(spark, d), SYMBOL, 50).select("id", "name", "file_path", "start_line")


def callees(spark, d):
    return graph.callers(_all_nodes(spark, d), _edges(spark, d), "field_001", 50, callers=False).select("id", "name", "file_path", "start_line")


def call_degrees(spark, d):
    """Call sites and distinct callers of every called symbol."""
    e = _edges(spark, d).where("kind = 'calls'")
    per_pair = e.groupBy("target", "source").agg(F.count(F.lit(1)).alias("sites"))
    return per_pair.groupBy("target").agg(F.sum("sites").alias("sites"), F.count(F.lit(1)).alias("callers"))


def impact(spark, d):
    """Everything within three links of the most called function."""
    return graph.impact(spark, _all_nodes(spark, d), _edges(spark, d), SYMBOL, 3, None).select("id", "hop")


def context(spark, d):
    return graph.context(spark, _nodes(spark, d), _edges(spark, d), TASK, 60).select("id", "hop", "weight")


def file_list_glob(spark, d):
    return graph.files(_nodes(spark, d), "*/src/*.rs")


def file_list_substring(spark, d):
    return graph.files(_nodes(spark, d), "Cache")


def names_in_files(spark, d):
    n = _nodes(spark, d).where(~F.col("kind").isin("file", "import"))
    return n.groupBy("file_path").agg(F.countDistinct("name").alias("names"))


def enclosing_symbol(spark, d):
    """The tightest symbol around the first line of every code hit."""
    probes = load(spark, d, "search_results").where("symbol IS NOT NULL").select("path", F.col("start_line").alias("line")).distinct()
    return graph.enclosing(_nodes(spark, d), probes).select("path", "line", "id", "name")


def cascade_delete(spark, d):
    """Edges left when all imports are deleted."""
    n = _all_nodes(spark, d).where("kind <> 'import'")
    return graph.without_dangling(n, _edges(spark, d)).select("source", "target", "kind", "line", "col")


def edge_confidence(spark, d):
    """Confidence and resolver of edges, from their metadata."""
    e = load(spark, d, "edges").select(F.lower(F.trim("kind")).alias("kind"), F.from_json("metadata", "confidence double, resolvedBy string").alias("m"))
    return e.groupBy("kind", F.col("m.resolvedBy").alias("resolved_by")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m.confidence"), 6).alias("confidence"))


def edges_distinct(spark, d):
    return _edges(spark, d)


def nodes_first_wins(spark, d):
    return storage.first_wins(load(spark, d, "nodes").select("id", "updated_at", "docstring"), "id", ["updated_at", F.asc_nulls_first("docstring")])


def files_last_wins(spark, d):
    f = load(spark, d, "files").select("path", "indexed_at", "modified_at", "size", "content_hash", "language")
    return incremental.newest(f, "path", ["indexed_at", "modified_at", "size", "content_hash"]).select("path", "indexed_at", F.lower("content_hash").alias("content_hash"))


def sync_classify(spark, d):
    scans = load(spark, d, "file_scans").select("path", "seen_at", "received_at", "content_hash", F.col("content").isNotNull().alias("there"))
    disk = incremental.newest(scans, "path", ["seen_at", "received_at"]).where("there").select("path", incremental.hex_digest(F.col("content_hash")).alias("checksum"))
    f = load(spark, d, "files").select("path", "indexed_at", "modified_at", "size", "content_hash")
    known = incremental.newest(f, "path", ["indexed_at", "modified_at", "size", "content_hash"]).select("path", incremental.hex_digest(F.col("content_hash")).alias("checksum"))
    return sync.classify(disk, known)


def sync_touched_files(spark, d):
    """Files to resolve again after the deletions and changes on disk."""
    gone = sync_classify(spark, d).where("state IN ('deleted', 'changed')").select("path")
    return sync.touched_files(_nodes(spark, d), _edges(spark, d), gone)


class _Graph:
    """The current graph, written once for the stages of a query."""

    def __init__(self, spark, d):
        cut = Cut(spark, "graph")
        self.nodes = cut(_all_nodes(spark, d))
        self.edges = cut(_edges(spark, d))
        # The runtime's functions are called but are no definitions of the packages.
        self.own = self.nodes.join(load(spark, d, "stub_nodes").select("id"), "id", "left_anti")

    def sites(self, kind):
        e = self.edges.where(F.col("kind") == kind).select("source", "target")
        n = self.own.select(F.col("id").alias("source"), F.col("file_path").alias("file"), "language")
        names = self.nodes.select(F.col("id").alias("target"), "name", "qualified_name")
        return lookup_join(e.join(n, "source"), names, "target", "target", "inner").select("file", "language", "name", "qualified_name").distinct()

    def imports(self):
        n = self.own.select("id", "file_path")
        a, b = n.select(F.col("id").alias("source"), F.col("file_path").alias("file")), n.select(F.col("id").alias("target"), F.col("file_path").alias("imported"))
        return self.edges.where("kind = 'imports'").join(a, "source").join(b, "target").select("file", "imported").distinct()

    def definitions(self, kinds):
        n = self.own.where(F.col("kind").isin(kinds))
        return n.select("id", "name", "qualified_name", F.col("file_path").alias("def_file"), F.col("language").alias("def_language"))


def resolve_names(spark, d):
    """Call sites resolved by name, callables first and classes for the rest, in one pass."""
    g = _Graph(spark, d)
    sites = g.sites("calls").select("file", "language", "name").distinct()
    both = sites.withColumn("ref", F.explode(F.array(F.lit("calls"), F.lit("instantiates"))))
    defs = g.definitions(resolution.ALLOWED["calls"]).withColumn("ref", F.lit("calls")).unionByName(g.definitions(resolution.ALLOWED["instantiates"]).withColumn("ref", F.lit("instantiates")))
    found = resolution.names(both, defs, g.imports(), ("ref",))
    cols = ["id", "tier", "confidence"]
    best = found.groupBy("file", "language", "name").agg(F.min(F.struct("ref", *cols)).alias("_b"))
    return best.select("file", "language", "name", "_b.id", "_b.tier", F.round("_b.confidence", 2).alias("confidence"), F.col("_b.ref").alias("kind"))


def _qualified(spark, d, strict):
    g = _Graph(spark, d)
    return resolution.qualified(g.sites("calls"), g.definitions(resolution.ALLOWED["qualified"]), g.imports(), strict).select("file", "language", "qualified_name", "id", "tier", "candidates")


def resolve_qualified(spark, d):
    return _qualified(spark, d, False)


def resolve_qualified_strict(spark, d):
    return _qualified(spark, d, True)


def _versions(spark, d):
    """The oldest and the newest state of the nodes as two graphs."""
    n = load(spark, d, "nodes").where(F.col("id").isNotNull())
    old = storage.first_wins(n, "id", ["updated_at", F.asc_nulls_first("docstring")])
    return old, _nodes(spark, d)


def parity_nodes(spark, d):
    old, new = _versions(spark, d)
    m = parity.bag_match(old, new.where("kind <> 'module'"), parity.NODE_KEY)
    return m.where("missing + extra > 0")


def parity_recall(spark, d):
    old, new = _versions(spark, d)
    return parity.recall(parity.bag_match(old, new.where("kind <> 'module'"), parity.NODE_KEY), ["kind"])


def parity_edges(spark, d):
    """Edges of the first pass against those of the second, by names at both ends."""
    n = _all_nodes(spark, d).select("id", "qualified_name")
    e = load(spark, d, "edges").where("metadata IS NULL OR NOT contains(metadata, 'synthesizedBy')").select("source", "target", F.lower(F.trim("kind")).alias("kind"), "provenance")
    j = e.join(n.select(F.col("id").alias("source"), F.col("qualified_name").alias("from_name")), "source")
    j = lookup_join(j, n.select(F.col("id").alias("target"), F.col("qualified_name").alias("to_name")), "target", "target", "inner")
    m = parity.bag_match(j.where("provenance IS NULL"), j.where("provenance = 'second-pass'"), ["kind", "from_name", "to_name"])
    return parity.recall(m, ["kind"])


def parity_renamed(spark, d):
    old, new = _versions(spark, d)
    new = new.withColumn("qualified_name", F.replace(F.col("qualified_name"), F.lit("::"), F.lit(".")))
    return parity.renamed(old, new, ["kind", "name", "file_path", "start_line"], "qualified_name")


def parity_attributes(spark, d):
    old, new = _versions(spark, d)
    return parity.attribute_deltas(old, new, "id", ["docstring", "signature", "visibility", "is_async"])


def parity_whitelist(spark, d):
    """Rows left over on either side, with the rule that allows them."""
    rules = [{"kind": "import"}, {"kind": "module", "qualified_name": "*"}, {"file_path": "loomwork/*"}]
    return parity.whitelist(parity_nodes(spark, d), rules).select("kind", "qualified_name", "file_path", "rule")


def dominant_language(spark, d):
    """Each package's most frequent language by file extension; ties by name."""
    p = load(spark, d, "file_scans").select("package", "path").distinct().withColumn("language", schemas.language_of(F.col("path"))).where("language IS NOT NULL")
    c = p.groupBy("package", "language").agg(F.count(F.lit(1)).alias("files"))
    return c.groupBy("package").agg(F.min_by(F.struct("language", "files"), F.struct(-F.col("files"), F.col("language"))).alias("_b")).select("package", "_b.language", "_b.files")


def node_ids(spark, d):
    """Stable ids: a digest of qualified name, path and position."""
    n = _nodes(spark, d)

    def le(c):
        h = F.lpad(F.hex(c), 8, "0")
        return F.unhex(F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)]))

    zero = F.unhex(F.lit("00"))
    raw = F.concat(F.encode("qualified_name", "UTF-8"), zero, F.encode("file_path", "UTF-8"), zero, le(F.coalesce("start_line", F.lit(0))), zero, le(F.coalesce("start_column", F.lit(0))))
    made = F.when(F.col("kind") == "file", F.concat(F.lit("file:"), F.col("file_path"))).otherwise(F.concat("kind", F.lit(":"), F.substring(F.sha2(raw, 256), 1, 32)))
    return n.select("id", made.alias("made"))


def docstring_clean(spark, d):
    n = _nodes(spark, d).where("docstring IS NOT NULL AND trim(docstring) <> ''")
    return n.select("id", text.clean_comment(F.col("docstring")).alias("doc"))


_QUERIES = [
    graph_status, graph_status_by_kind, symbol_lookup, symbol_substring, symbol_phrase, symbol_search, callers, callees, call_degrees, impact, context, file_list_glob,
    file_list_substring, names_in_files, enclosing_symbol, cascade_delete, edge_confidence, edges_distinct, nodes_first_wins, files_last_wins, sync_classify, sync_touched_files,
    resolve_names, resolve_qualified, resolve_qualified_strict, parity_nodes, parity_recall, parity_edges, parity_renamed, parity_attributes, parity_whitelist, dominant_language,
    node_ids, docstring_clean,
]


def queries():
    return {f.__name__: f for f in _QUERIES}


_N = "n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, docstring DESC NULLS LAST) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"
_O = "o AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at, docstring NULLS FIRST) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"
_A = "a AS (SELECT id, name, qualified_name, kind, file_path, start_line, language, package, end_line, docstring, signature FROM n UNION ALL SELECT id, name, qualified_name, kind, NULL, NULL, language, package, NULL, NULL, NULL FROM stub_nodes)"
_E = "e AS (SELECT DISTINCT source, target, lower(trim(kind)) AS kind, line, col FROM edges)"
_W = f"WITH RECURSIVE {_N}, {_A}, {_E}"
_PHRASE = "' ' || array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+'), '  ') || ' '"
_FIELDS = ["id", "name", "qualified_name", "docstring", "signature"]


def _phrase_sql(phrase: str) -> str:
    p = " " + "  ".join(phrase.lower().split()) + " "
    tf = " + ".join(f"(length({h}) - length(replace({h}, '{p}', ''))) / {len(p)}" for h in (_PHRASE.format(c=c) for c in _FIELDS))
    tf = tf.replace(") / ", ") // ")
    dl = " + ".join("len(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+'))".format(c=c) for c in _FIELDS)
    return f"""SELECT n.*, tf, round(ln(1 + (t.c - t.df + 0.5) / (t.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / t.av)), 6) AS score
FROM (SELECT *, {tf} AS tf, {dl} AS dl FROM n) n, (SELECT count(*) AS c, avg(dl) AS av, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) AS df FROM (SELECT {tf} AS tf, {dl} AS dl FROM n)) t
WHERE tf > 0"""


def _node_ids_sql() -> str:
    def digits(column: str) -> str:
        return f"lpad(to_hex(coalesce({column}, 0)), 8, '0')"

    def little(x: str) -> str:
        return f"from_hex(substr({x}, 7, 2) || substr({x}, 5, 2) || substr({x}, 3, 2) || substr({x}, 1, 2))"

    raw = f"encode(qualified_name) || from_hex('00') || encode(file_path) || from_hex('00') || {little('hl')} || from_hex('00') || {little('hc')}"
    return f"""WITH {_N}, h AS (SELECT *, {digits('start_line')} AS hl, {digits('start_column')} AS hc FROM n)
SELECT id, CASE WHEN kind = 'file' THEN 'file:' || file_path ELSE kind || ':' || substr(sha256({raw}), 1, 32) END AS made FROM h"""


def _seed_sql(terms: list[str]) -> str:
    """Scores of all nodes by the terms in their texts."""
    def tf(t):
        p = " " + "  ".join(t.replace("_", " ").split()) + " "
        return " + ".join(f"(length({h}) - length(replace({h}, '{p}', ''))) // {len(p)}" for h in (_PHRASE.format(c=c) for c in _FIELDS))

    dl = " + ".join("len(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+'))".format(c=c) for c in _FIELDS)
    tfs = ", ".join(f"{tf(t)} AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(terms)))
    gain = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (c - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av)) ELSE 0.0 END" for i in range(len(terms)))
    return f"st AS (SELECT id, {dl} AS dl, {tfs} FROM n), tt AS (SELECT count(*) AS c, avg(dl) AS av, {dfs} FROM st), sc AS (SELECT id, round({gain}, 6) AS score FROM st, tt)"


def _search_sql(needle: str, tag: str) -> str:
    return f"""{tag}p AS ({_phrase_sql(needle)}),
{tag}s AS (SELECT id, name, 0.0 AS score, end_line - start_line AS span, qualified_name FROM n WHERE (contains(lower(name), '{needle}') OR contains(lower(qualified_name), '{needle}')) AND NOT EXISTS (SELECT 1 FROM {tag}p)),
{tag} AS (SELECT id, name, score FROM (SELECT id, name, score, end_line - start_line AS span, qualified_name FROM {tag}p UNION ALL SELECT * FROM {tag}s) ORDER BY score DESC, span, qualified_name, id LIMIT 20)"""


_NEW_FILES = "k AS (SELECT path, lower(content_hash) AS h, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, modified_at DESC, size DESC, content_hash DESC) AS rn FROM files) WHERE rn = 1)"
_DISK = "d AS (SELECT path, lower(content_hash) AS h FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, received_at DESC) AS rn FROM file_scans) WHERE rn = 1 AND content IS NOT NULL)"
_STATE = "st AS (SELECT coalesce(d.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'deleted' WHEN d.h IS DISTINCT FROM k.h THEN 'changed' ELSE 'same' END AS state FROM d FULL JOIN k ON d.path = k.path)"
_SITES = "sites AS (SELECT DISTINCT s.file_path AS file, s.language, t.name, t.qualified_name FROM e JOIN n s ON e.source = s.id JOIN a t ON e.target = t.id WHERE e.kind = 'calls'), imp AS (SELECT DISTINCT s.file_path AS file, t.file_path AS imported FROM e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id WHERE e.kind = 'imports')"
_DIR = "regexp_extract({}, '^(.*)/[^/]*$', 1)"


def _tiers(sites: str, kinds: str, out: str) -> str:
    return f"""{out}c AS (SELECT s.file, s.language, s.name, v.id, v.file_path, v.qualified_name, i.file IS NOT NULL AS im, s.language = v.language AS sl,
  s.language = v.language AND {_DIR.format('s.file')} = {_DIR.format('v.file_path')} AS sd
  FROM (SELECT DISTINCT file, language, name FROM {sites}) s JOIN n v ON v.name = s.name AND v.kind IN ({kinds}) LEFT JOIN imp i ON i.file = s.file AND i.imported = v.file_path),
{out}w AS (SELECT *, count(*) OVER p AS g, sum(CASE WHEN sl THEN 1 ELSE 0 END) OVER p AS l, sum(CASE WHEN sd THEN 1 ELSE 0 END) OVER p AS dd FROM {out}c WINDOW p AS (PARTITION BY file, language, name)),
{out}t AS (SELECT *, CASE WHEN file = file_path THEN 1 WHEN im THEN 2 WHEN sl AND l = 1 THEN 3 WHEN sd AND l <> 1 AND dd = 1 THEN 4 END AS tier FROM {out}w),
{out} AS (SELECT file, language, name, id, tier, CASE WHEN tier = 2 THEN 0.9 WHEN tier = 4 THEN 0.5 WHEN g = 1 THEN 0.9 ELSE 0.4 END AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY file, language, name ORDER BY tier, file_path, qualified_name, id) AS rn FROM {out}t WHERE tier IS NOT NULL) WHERE rn = 1)"""


def _qualified_sql(strict: bool) -> str:
    return f"""{_W}, {_SITES}, c AS (SELECT s.file, s.language, s.qualified_name, v.id, v.file_path, CASE WHEN s.file = v.file_path THEN 1 WHEN i.file IS NOT NULL THEN 2 ELSE 3 END AS tier
  FROM (SELECT DISTINCT file, language, qualified_name FROM sites) s JOIN n v ON v.qualified_name = s.qualified_name AND v.language = s.language AND v.kind IN ('function', 'method', 'enum_member')
  LEFT JOIN imp i ON i.file = s.file AND i.imported = v.file_path),
r AS (SELECT *, count(*) OVER (PARTITION BY file, language, qualified_name) AS candidates, row_number() OVER (PARTITION BY file, language, qualified_name ORDER BY tier, file_path, id) AS rn FROM c)
SELECT file, language, qualified_name, id, tier, candidates FROM r WHERE rn = 1""" + (" AND (tier < 3 OR candidates = 1)" if strict else "")


_BAG = f"""WITH {_N}, {_O}, g AS (SELECT coalesce(kind, '') AS kind, coalesce(qualified_name, '') AS qualified_name, coalesce(file_path, '') AS file_path, count(*) AS c FROM o GROUP BY ALL),
u AS (SELECT coalesce(kind, '') AS kind, coalesce(qualified_name, '') AS qualified_name, coalesce(file_path, '') AS file_path, count(*) AS c FROM n WHERE kind <> 'module' GROUP BY ALL),
m AS (SELECT kind, qualified_name, file_path, coalesce(g.c, 0) AS golden, coalesce(u.c, 0) AS ours FROM g FULL JOIN u USING (kind, qualified_name, file_path)),
b AS (SELECT *, least(golden, ours) AS matched, golden - least(golden, ours) AS missing, ours - least(golden, ours) AS extra FROM m)
"""
_RECALL = "sum(golden)::BIGINT AS golden, sum(ours)::BIGINT AS ours, sum(matched)::BIGINT AS matched, sum(missing)::BIGINT AS missing, sum(extra)::BIGINT AS extra, round(CASE WHEN sum(golden) = 0 THEN NULL ELSE 100.0 * sum(matched) / sum(golden) END, 4) AS recall_pct"


def oracle():
    named = f"(name = '{SYMBOL}' OR qualified_name = '{SYMBOL}')"
    terms = ["scheduler", "parse", "ledger", "drop", "socket"]
    ext = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in schemas.EXTENSIONS.items())
    call = lambda here, there, sym: f"""{_W} SELECT DISTINCT id, name, file_path, start_line FROM (
SELECT v.id, v.name, v.file_path, v.start_line, e.line, e.col FROM e JOIN a v ON e.{there} = v.id WHERE e.kind = 'calls' AND e.{here} IN (SELECT id FROM a WHERE name = '{sym}' OR qualified_name = '{sym}')
ORDER BY v.file_path NULLS FIRST, v.start_line NULLS FIRST, v.id, e.line NULLS FIRST, e.col NULLS FIRST LIMIT 50)"""  # noqa: E731
    return {
        "graph_status": f"{_W} SELECT 'nodes' AS what, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'files', count(DISTINCT path) FROM files",
        "graph_status_by_kind": f"{_W} SELECT kind, language, count(*) AS n, CAST(grouping(kind, language) AS INTEGER) AS level FROM n GROUP BY GROUPING SETS ((kind, language), (kind), (language), ())",
        "symbol_lookup": f"{_W} SELECT id, name, qualified_name, kind, file_path, start_line, qualified_name = '{SYMBOL}' AS exact FROM a WHERE {named}",
        "symbol_substring": f"{_W} SELECT id, name, qualified_name, kind, file_path, start_line FROM n WHERE contains(lower(name), '{NEEDLE}') OR contains(lower(qualified_name), '{NEEDLE}')",
        "node_ids": _node_ids_sql(),
        "symbol_phrase": f"WITH {_N} SELECT id, name, score FROM ({_phrase_sql(PHRASE.split()[1])})",
        "symbol_search": f"WITH {_N}, {_search_sql("obe", "x")}, {_search_sql('gauge', 'y')} SELECT * FROM x UNION ALL SELECT * FROM y",
        "callers": call("target", "source", SYMBOL),
        "callees": call("source", "target", "field_001"),
        "call_degrees": f"{_W} SELECT target, count(*) AS sites, count(DISTINCT source) AS callers FROM e WHERE kind = 'calls' GROUP BY target",
        "impact": f"""{_W}, r AS (SELECT id, 0 AS hop FROM a WHERE {named} UNION SELECT e.source, r.hop + 1 FROM r JOIN e ON e.target = r.id WHERE e.kind IN ('calls', 'references', 'imports') AND r.hop < 3)
SELECT r.id, CAST(min(hop) AS INTEGER) AS hop FROM r JOIN a ON a.id = r.id WHERE NOT {named} GROUP BY r.id""",
        "context": f"""{_W}, {_seed_sql(terms)}, s0 AS (SELECT id, 0 AS hop FROM sc WHERE score > 0 ORDER BY score DESC, id LIMIT 60),
l AS (SELECT source AS x, target AS y FROM e WHERE kind IN ('calls', 'references', 'contains', 'imports') UNION SELECT target, source FROM e WHERE kind IN ('calls', 'references', 'contains', 'imports')),
s1 AS (SELECT id, 1 AS hop FROM (SELECT DISTINCT l.y AS id FROM l JOIN s0 ON l.x = s0.id WHERE l.y IN (SELECT id FROM n) AND l.y NOT IN (SELECT id FROM s0)) QUALIFY row_number() OVER (ORDER BY id) <= 60 - (SELECT count(*) FROM s0)),
s2 AS (SELECT id, 2 AS hop FROM (SELECT DISTINCT l.y AS id FROM l JOIN s1 ON l.x = s1.id WHERE l.y IN (SELECT id FROM n) AND l.y NOT IN (SELECT id FROM s0 UNION ALL SELECT id FROM s1)) QUALIFY row_number() OVER (ORDER BY id) <= 60 - (SELECT count(*) FROM s0) - (SELECT count(*) FROM s1))
SELECT u.id, u.hop, CASE WHEN n.kind IN ('function', 'method') THEN 3 WHEN n.kind IN ('class', 'struct', 'enum') THEN 2 ELSE 1 END AS weight FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) u JOIN n ON n.id = u.id""",
        "file_list_glob": f"WITH {_N} SELECT DISTINCT file_path FROM n WHERE regexp_full_match(file_path, '.*/src/.*\\.rs')",
        "file_list_substring": f"WITH {_N} SELECT DISTINCT file_path FROM n WHERE contains(lower(file_path), 'cache')",
        "names_in_files": f"WITH {_N} SELECT file_path, count(DISTINCT name) AS names FROM n WHERE kind NOT IN ('file', 'import') GROUP BY file_path",
        "enclosing_symbol": f"""WITH {_N}, p AS (SELECT DISTINCT path, start_line AS line FROM search_results WHERE symbol IS NOT NULL)
SELECT path, line, id, name FROM (SELECT p.path, p.line, n.id, n.name, row_number() OVER (PARTITION BY p.path, p.line ORDER BY n.end_line - n.start_line, n.qualified_name, n.id) AS rn
FROM p JOIN n ON n.file_path = p.path AND n.start_line <= p.line AND n.end_line >= p.line AND n.kind <> 'file' AND n.kind <> 'import') WHERE rn = 1""",
        "cascade_delete": f"{_W} SELECT * FROM e WHERE source IN (SELECT id FROM a WHERE kind <> 'import') AND target IN (SELECT id FROM a WHERE kind <> 'import')",
        "edge_confidence": "SELECT lower(trim(kind)) AS kind, metadata::JSON->>'$.resolvedBy' AS resolved_by, count(*) AS n, round(avg((metadata::JSON->>'$.confidence')::DOUBLE), 6) AS confidence FROM edges GROUP BY ALL",
        "edges_distinct": f"WITH {_E} SELECT * FROM e",
        "nodes_first_wins": f"WITH {_O} SELECT id, updated_at, docstring FROM o",
        "files_last_wins": f"WITH {_NEW_FILES} SELECT path, indexed_at, h AS content_hash FROM k",
        "sync_classify": f"WITH {_NEW_FILES}, {_DISK}, {_STATE} SELECT * FROM st",
        "sync_touched_files": f"""{_W}, {_NEW_FILES}, {_DISK}, {_STATE}, g AS (SELECT path FROM st WHERE state IN ('deleted', 'changed')),
dn AS (SELECT DISTINCT name FROM n WHERE kind NOT IN ('file', 'import') AND file_path IN (SELECT path FROM g))
SELECT DISTINCT s.file_path AS file FROM e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id WHERE e.kind <> 'contains' AND s.file_path NOT IN (SELECT path FROM g) AND (t.file_path IN (SELECT path FROM g) OR t.name IN (SELECT name FROM dn))""",
        "resolve_names": f"""{_W}, {_SITES}, {_tiers('sites', "'function', 'method'", 'x')}, rest AS (SELECT DISTINCT s.file, s.language, s.name FROM sites s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.file = s.file AND x.language = s.language AND x.name = s.name)),
{_tiers('rest', "'class', 'struct', 'interface'", 'y')} SELECT *, 'calls' AS kind FROM x UNION ALL SELECT *, 'instantiates' AS kind FROM y""",
        "resolve_qualified": _qualified_sql(False),
        "resolve_qualified_strict": _qualified_sql(True),
        "parity_nodes": _BAG + "SELECT * FROM b WHERE missing + extra > 0",
        "parity_recall": _BAG + f"SELECT kind, {_RECALL} FROM b GROUP BY kind",
        "parity_edges": f"""{_W}, j AS (SELECT lower(trim(x.kind)) AS kind, coalesce(s.qualified_name, '') AS from_name, coalesce(t.qualified_name, '') AS to_name, provenance FROM edges x JOIN a s ON x.source = s.id JOIN a t ON x.target = t.id WHERE metadata IS NULL OR NOT contains(metadata, 'synthesizedBy')),
m AS (SELECT kind, coalesce(g.c, 0) AS golden, coalesce(u.c, 0) AS ours, least(coalesce(g.c, 0), coalesce(u.c, 0)) AS matched, coalesce(g.c, 0) - least(coalesce(g.c, 0), coalesce(u.c, 0)) AS missing, coalesce(u.c, 0) - least(coalesce(g.c, 0), coalesce(u.c, 0)) AS extra
FROM (SELECT kind, from_name, to_name, count(*) AS c FROM j WHERE provenance IS NULL GROUP BY ALL) g FULL JOIN (SELECT kind, from_name, to_name, count(*) AS c FROM j WHERE provenance = 'second-pass' GROUP BY ALL) u USING (kind, from_name, to_name))
SELECT kind, {_RECALL} FROM m GROUP BY kind""",
        "parity_renamed": f"""WITH {_N}, {_O}, g AS (SELECT kind, name, file_path, start_line, qualified_name AS q, row_number() OVER (PARTITION BY kind, name, file_path, start_line ORDER BY qualified_name) AS k FROM o),
u AS (SELECT kind, name, file_path, start_line, replace(qualified_name, '::', '.') AS q, row_number() OVER (PARTITION BY kind, name, file_path, start_line ORDER BY replace(qualified_name, '::', '.')) AS k FROM n)
SELECT kind, name, file_path, start_line, g.q AS golden_name, u.q AS our_name FROM g JOIN u USING (kind, name, file_path, start_line, k) WHERE g.q IS DISTINCT FROM u.q""",
        "parity_attributes": f"""WITH {_N}, {_O}, g AS (SELECT id, unnest(['docstring', 'signature', 'visibility', 'is_async']) AS attribute, unnest([nullif(docstring, ''), nullif(signature, ''), nullif(visibility, ''), is_async::VARCHAR]) AS golden FROM o),
u AS (SELECT id, unnest(['docstring', 'signature', 'visibility', 'is_async']) AS attribute, unnest([nullif(docstring, ''), nullif(signature, ''), nullif(visibility, ''), is_async::VARCHAR]) AS ours FROM n)
SELECT id, attribute, golden, ours FROM g JOIN u USING (id, attribute) WHERE golden IS DISTINCT FROM ours""",
        "parity_whitelist": _BAG + "SELECT kind, qualified_name, file_path, CASE WHEN kind = 'import' THEN 0 WHEN kind = 'module' THEN 1 WHEN starts_with(file_path, 'loomwork/') THEN 2 END AS rule FROM b WHERE missing + extra > 0",
        "dominant_language": f"""SELECT package, language, files FROM (SELECT package, language, count(*) AS files, row_number() OVER (PARTITION BY package ORDER BY count(*) DESC, language) AS rn FROM
(SELECT DISTINCT package, path, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9_]+)$', 1)) {ext} END AS language FROM file_scans) WHERE language IS NOT NULL GROUP BY package, language) WHERE rn = 1""",
        "docstring_clean": f"""WITH {_N} SELECT id, array_to_string(list_filter(list_transform(string_split(docstring, chr(10)), lambda x: trim(regexp_replace(x, '^\\s*(?:/\\*\\*?|\\*/|\\*|///?|#+|\"\"\")\\s?|\\s*(?:\\*/|\"\"\")\\s*$', '', 'g'))), lambda x: x <> ''), chr(10)) AS doc
FROM n WHERE docstring IS NOT NULL AND trim(docstring) <> ''""",
    }

"""Read operators of the symbol graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import text
from ravelin.operators.incremental import newest
from ravelin.session import Cut

REACH_KINDS = ["calls", "references", "imports"]
CONTEXT_KINDS = ["calls", "references", "contains", "imports"]
#: Lines to a bin of the interval join.
BIN = 64


def current_nodes(nodes: DataFrame) -> DataFrame:
    """The newest row of every id; ties are decided by the whole row."""
    return newest(nodes.where(F.col("id").isNotNull()), "id", ["updated_at"])


def current_edges(edges: DataFrame) -> DataFrame:
    """Distinct (source, target, kind, line, col) with kinds in one spelling."""
    return edges.select("source", "target", F.lower(F.trim("kind")).alias("kind"), "line", "col").distinct()


def status(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    def one(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    return one(nodes, "nodes").unionByName(one(edges, "edges")).unionByName(one(files, "files"))


def resolve_ids(nodes: DataFrame, symbol: str) -> DataFrame:
    """All nodes with that qualified name or name; matches by qualified name rank first."""
    exact = F.col("qualified_name") == symbol
    return nodes.where(exact | (F.col("name") == symbol)).withColumn("exact", exact)


def span():
    return F.col("end_line") - F.col("start_line")


def search_substring(nodes: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Nodes whose name or qualified name contains the text, tightest first."""
    low = needle.lower()
    hit = F.lower("name").contains(low) | F.lower("qualified_name").contains(low)
    out = nodes.where(hit).orderBy(span(), "qualified_name", "id")
    return out.limit(max(limit, 1)) if limit is not None else out


PHRASE_FIELDS = ["id", "name", "qualified_name", "docstring", "signature"]


def indexed(nodes: DataFrame) -> DataFrame:
    """Nodes with their texts as tokens (``_text``, one for each field) and their length
    (``_dl``): what a phrase search looks at.  Written once, it serves every search."""
    texts = F.array(*[text.phrase_text(F.col(c)) for c in PHRASE_FIELDS])
    n = nodes.withColumn("_text", texts)
    words = F.aggregate("_text", F.lit(0), lambda a, t: a + F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(t), "  "))))
    return n.withColumn("_dl", words)


def search_phrase(nodes: DataFrame, phrase: str, k1: float = 1.2, b: float = 0.75, by: str | None = None) -> DataFrame:
    """Nodes with the phrase in a row in one of their texts, scored by BM25 over all texts
    of a node: adds ``score``.  ``nodes`` may be ``indexed``.  With ``by`` the statistics are
    those of each group.  A blank phrase finds nothing."""
    n = nodes if "_text" in nodes.columns else indexed(nodes)
    if not phrase.strip():
        return n.limit(0).withColumn("score", F.lit(0.0)).drop("_text", "_dl")
    p = text.phrase_needle(phrase)
    tf = F.aggregate("_text", F.lit(0).cast("bigint"), lambda a, t: a + ((F.length(t) - F.length(F.replace(t, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("bigint"))
    hit = n.withColumn("_tf", tf).where("_tf > 0").drop("_text")
    g = [by] if by else []
    totals = n.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"))
    df = hit.groupBy(*g).agg(F.count(F.lit(1)).alias("_df"))
    j = hit.join(totals, by).join(df, by) if by else hit.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(df))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    score = idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_dl") / F.col("_avg")))
    return j.withColumn("score", F.round(score, 6)).drop("_tf", "_dl", "_n", "_avg", "_df")


def search(nodes: DataFrame, needle: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Phrase search; substring search where the phrase finds nothing at all."""
    if kind:
        nodes = nodes.where(F.col("kind") == kind)
    if not needle.strip():
        return nodes.limit(0).drop("_text", "_dl").withColumn("score", F.lit(0.0))
    order = [F.desc("score"), span(), "qualified_name", "id"]
    found = Cut(nodes.sparkSession, "search")(search_phrase(nodes, needle).orderBy(*order).limit(max(limit, 1)))
    if found.limit(1).count():
        return found.orderBy(*order)
    return search_substring(nodes, needle, limit).drop("_text", "_dl").withColumn("score", F.lit(0.0))


def call_sites(nodes: DataFrame, edges: DataFrame, symbol: str, callers: bool = True) -> DataFrame:
    """One row per call edge to (or from) the symbol, with the node at the other end."""
    here, there = ("target", "source") if callers else ("source", "target")
    ids = resolve_ids(nodes, symbol).select(F.col("id").alias(here))
    e = edges.where("kind = 'calls'").join(ids, here, "left_semi")
    return e.join(nodes.withColumnRenamed("kind", "node_kind"), e[there] == nodes["id"]).select("id", "name", "qualified_name", "node_kind", "file_path", "start_line", "line", "col")


def callers(nodes: DataFrame, edges: DataFrame, symbol: str, limit: int = 20, callers: bool = True) -> DataFrame:
    """Distinct nodes among the first ``limit`` call sites: the limit counts edges."""
    first = call_sites(nodes, edges, symbol, callers).orderBy("file_path", "start_line", "id", "line", "col").limit(limit)
    return first.select("id", "name", "qualified_name", "node_kind", "file_path", "start_line").distinct()


def impact(spark: SparkSession, nodes: DataFrame, edges: DataFrame, symbol: str, depth: int = 3, limit: int | None = 500) -> DataFrame:
    """Nodes from which the symbol can be reached in at most ``depth`` links, with their
    least distance; nodes named like the symbol are left out.

    A frontier of ids per round; nodes reached before are taken out by anti-join, so each
    node is expanded once.
    """
    cut = Cut(spark, "impact")
    links = cut(edges.where(F.col("kind").isin(REACH_KINDS)).select("source", "target").distinct())
    frontier = cut(resolve_ids(nodes, symbol).select("id").distinct().withColumn("hop", F.lit(0)))
    seen = frontier
    for hop in range(1, depth + 1):
        nxt = links.join(frontier.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()
        frontier = cut(nxt.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    named = (F.col("name") == symbol) | (F.col("qualified_name") == symbol)
    out = nodes.join(seen, "id").where(~named).select("id", "name", "qualified_name", "kind", "file_path", "start_line", "hop")
    return out.orderBy("file_path", "start_line", "id").limit(limit) if limit else out


def context(spark: SparkSession, nodes: DataFrame, edges: DataFrame, task: str, most: int = 40) -> DataFrame:
    """The nodes whose texts hold terms of a task, and their neighbours up to two links away.

    Each round admits new ids in order of id until ``most`` are reached; the result is
    ordered by hop, weight of the kind and qualified name.
    """
    cut = Cut(spark, "context")
    terms = spark.range(1).select(text.significant(F.lit(task)).alias("t")).first()["t"]
    if not terms:
        return nodes.limit(0).withColumn("hop", F.lit(0))
    seen = cut(seeds(nodes, terms, most).select("id").withColumn("hop", F.lit(0)))
    links = edges.where(F.col("kind").isin(CONTEXT_KINDS)).select("source", "target")
    both = cut(links.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(links.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct())
    known = nodes.select("id")
    for hop in (1, 2):
        room = most - seen.count()
        if room <= 0:
            break
        last = seen.where(F.col("hop") == hop - 1).select(F.col("id").alias("a"))
        new = both.join(last, "a", "left_semi").select(F.col("b").alias("id")).distinct().join(known, "id", "left_semi").join(seen.select("id"), "id", "left_anti")
        seen = seen.unionByName(cut(new.orderBy("id").limit(room).withColumn("hop", F.lit(hop))))
    weight = F.when(F.col("kind").isin("function", "method"), 3).when(F.col("kind").isin("class", "struct", "enum"), 2).otherwise(1)
    return nodes.join(seen, "id").withColumn("weight", weight).orderBy("hop", F.desc("weight"), "qualified_name", "id")


def files(nodes: DataFrame, pattern: str | None = None) -> DataFrame:
    return nodes.select("file_path").where(F.col("file_path").isNotNull()).distinct().where(text.file_filter(F.col("file_path"), pattern))


def enclosing(nodes: DataFrame, probes: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """For each probe (path, line) the tightest symbol around it, if any.

    The interval join is an equi-join on path and bin of lines with a recheck; a symbol is
    repeated once for each bin it touches.
    """
    n = nodes.where("kind <> 'file' AND kind <> 'import' AND end_line >= start_line").select(
        "id", "name", "qualified_name", "kind", F.col("file_path").alias("_path"), "start_line", "end_line",
        F.explode(F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))).alias("_bin"),
    )
    p = probes.withColumn("_pbin", F.floor(F.col(line) / BIN))
    j = p.join(n, (p[path] == n["_path"]) & (p["_pbin"] == n["_bin"]) & (F.col("start_line") <= F.col(line)) & (F.col("end_line") >= F.col(line)))
    best = F.min_by(F.struct("id", "name", "qualified_name", "kind", "start_line", "end_line"), F.struct(span(), "qualified_name", "id")).alias("_b")
    return j.groupBy(*probes.columns).agg(best).select(*probes.columns, "_b.*")


def without_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends exist: what is left after the deletion of nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def exact_first(found: DataFrame) -> DataFrame:
    """Nodes of ``resolve_ids`` in order: by qualified name first, then the tightest."""
    return found.orderBy(F.desc("exact"), span(), "qualified_name", "id")


def seeds(nodes: DataFrame, terms: list[str], most: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``most`` nodes that hold any of the terms in their texts, by the sum of BM25; where
    no text holds one, those whose name contains one.  Adds ``score``.  ``nodes`` may be
    ``indexed``."""
    n = nodes if "_text" in nodes.columns else indexed(nodes)

    def count(term: str):
        p = text.phrase_needle(term)
        return F.aggregate("_text", F.lit(0).cast("bigint"), lambda a, t: a + ((F.length(t) - F.length(F.replace(t, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("bigint"))

    cut = Cut(nodes.sparkSession, "seeds")
    hit = cut(n.select("id", "_dl", F.array(*map(count, terms)).alias("_tf")).where(F.exists("_tf", lambda x: x > 0)))
    totals = n.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"))
    df = hit.agg(F.array(*[F.sum((F.col("_tf")[i] > 0).cast("bigint")) for i in range(len(terms))]).alias("_df"))
    j = hit.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(df))

    def gain(i: int):
        t, d = F.col("_tf")[i], F.col("_df")[i]
        return F.when(t > 0, F.log(1 + (F.col("_n") - d + 0.5) / (d + 0.5)) * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("_dl") / F.col("_avg")))).otherwise(0.0)

    cols = [c for c in nodes.columns if c not in ("_text", "_dl")]
    best = j.select("id", F.round(sum((gain(i) for i in range(len(terms))), F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(most)
    found = cut(nodes.select(*cols).join(F.broadcast(best), "id").select(*cols, "score"))
    if found.limit(1).count():
        return found
    hits = sum((F.lower("name").contains(t).cast("int") for t in terms), F.lit(0))
    return nodes.withColumn("_hits", hits).where("_hits > 0").orderBy(F.desc("_hits"), "id").limit(most).select(*cols, F.lit(0.0).alias("score"))

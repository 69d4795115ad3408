"""Fusing and ranking hits of several searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text

#: Constant of reciprocal-rank fusion.
RRF_K = 60
#: Lines between two hits of one document that still merge them.
DOC_GAP, CODE_GAP = 2, 3
#: Hits of one package and origin in the pool: at most a third of it.
POOL = 20
FLOOR = 0.10


def rrf(rank, weight=1.0):
    return weight / (F.lit(float(RRF_K)) + rank)


def key():
    """What makes two hits the same result."""
    path = text.normal_path(F.coalesce("path", F.lit("")))
    docs = F.concat_ws(":", "package", path, F.sha2(F.coalesce("snippet", F.lit("")), 256))
    at_line = F.concat_ws(":", "package", path, F.col("start_line").cast("string"))
    by_name = F.concat_ws(":", "package", path, F.lower("symbol"))
    return (
        F.when(F.col("origin") == "docs", docs)
        .when(F.col("start_line") > 0, at_line)
        .when(F.coalesce(F.col("symbol"), F.lit("")) != "", by_name)
        .otherwise(F.concat_ws(":", "package", path))
    )


def fuse(hits: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row per result: summed score, provenance, and the richest hit.

    ``hits``: seq, package, origin, path, lines, snippet, symbol, kind, signature, rrf,
    from_original.  The richest hit is the one of the best origin (code, graph, docs),
    then with the longest snippet in bytes, then the first; missing kind and signature
    come from the first hit that has them, the symbol is the longest.
    """
    g = group or []
    prio = F.when(F.col("origin") == "code", 2).when(F.col("origin") == "graph", 1).otherwise(0)
    best = F.struct(prio, F.octet_length(F.coalesce("snippet", F.lit(""))), -F.col("seq"))
    row = F.struct("origin", "package", "path", "start_line", "end_line", "snippet")
    have = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return (
        hits.withColumn("key", key())
        .groupBy(*g, "key")
        .agg(
            F.round(F.sum("rrf"), 9).alias("rrf"),
            F.bool_or("from_original").alias("from_original"),
            F.min("seq").alias("seq"),
            F.count(F.lit(1)).alias("hits"),
            F.max_by(row, best).alias("_r"),
            F.max_by("symbol", F.when(have("symbol"), F.struct(F.octet_length("symbol"), -F.col("seq")))).alias("symbol"),
            F.min_by("kind", F.when(have("kind"), F.col("seq"))).alias("kind"),
            F.min_by("signature", F.when(have("signature"), F.col("seq"))).alias("signature"),
        )
        .select(*g, "key", "rrf", "from_original", "seq", "hits", "_r.*", "symbol", "kind", "signature")
    )


def anchor(fused: DataFrame, floor: float = 0.5, group: list[str] | None = None) -> DataFrame:
    """Scores scaled by how strongly the original query points to the hit's package."""
    g = group or []
    if not g:
        # Few packages: sums by package and their greatest, instead of windows over all hits.
        each = fused.groupBy("package").agg(F.sum(F.when(F.col("from_original"), F.col("rrf")).otherwise(0.0)).alias("_strength"))
        top = each.agg(F.max("_strength").alias("_top"))
        out = fused.join(each, "package").crossJoin(F.broadcast(top))
        share = F.when(F.col("_top") > 0, F.col("_strength") / F.col("_top")).otherwise(0.0)
        return out.withColumn("rrf", F.round(F.col("rrf") * (floor + (1 - floor) * share), 9)).drop("_strength", "_top")
    w = Window.partitionBy(*g, "package")
    strength = F.sum(F.when(F.col("from_original"), F.col("rrf")).otherwise(0.0)).over(w)
    top = F.max("_strength").over(Window.partitionBy(*g))
    out = fused.withColumn("_strength", strength)
    share = F.when(top > 0, F.col("_strength") / top).otherwise(0.0)
    return out.withColumn("rrf", F.round(F.col("rrf") * (floor + (1 - floor) * share), 9)).drop("_strength")


def pool(fused: DataFrame, size: int = POOL, group: list[str] | None = None) -> DataFrame:
    """The first ``size`` hits of the original query with at most a third (three at least)
    from one package and origin; adds ``pool_rank``."""
    g = group or []
    most = max(size // 3, 3)
    order = [F.desc("rrf"), "seq"]
    b = fused.where("from_original").withColumn("_b", F.row_number().over(Window.partitionBy(*g, "package", "origin").orderBy(*order)))
    b = b.where(F.col("_b") <= most)
    if not g:
        b = b.orderBy(*order).limit(size)
    w = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy(*order)
    return b.withColumn("pool_rank", F.row_number().over(w)).where(F.col("pool_rank") <= size).drop("_b")


def pool_with_share(fused: DataFrame, size: int = POOL, share: float = 0.34) -> DataFrame:
    """The pool when hits that only variants found may take a ``share`` of it.

    Only the first hits of each package and origin can be taken, so the scan that counts
    both limits sees few rows, in one task.
    """
    from ravelin.operators.answers import greedy_pool

    most = max(size // 3, 3)
    w = Window.partitionBy("package", "origin", "from_original").orderBy(F.desc("rrf"), "seq")
    near = fused.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= most).drop("_b").withColumn("_one", F.lit(0))
    return greedy_pool(near, "_one", size, share).drop("_one")


def expand(hits: DataFrame, code: DataFrame) -> DataFrame:
    """Code hits with the stored body of their symbol, if it is longer than the snippet.

    The body is looked up by path and first line, else by a name that is unique in its
    package.  ``code``: package, path, symbol, start_line, content.  Adds ``body``.
    """
    at = code.groupBy("package", "path", "start_line").agg(F.max("content").alias("_at"))
    named = code.groupBy("package", "symbol").agg(F.max("content").alias("_named"), F.countDistinct("path", "start_line").alias("_n")).where("_n = 1").drop("_n")
    j = hits.join(at, ["package", "path", "start_line"], "left").join(named, ["package", "symbol"], "left")
    body = F.coalesce("_at", "_named")
    longer = F.octet_length(body) > F.octet_length(F.coalesce("snippet", F.lit("")))
    return j.withColumn("body", F.when((F.col("origin") != "docs") & longer, body)).drop("_at", "_named")


def lexical_score(query, candidate):
    """Share of a query's distinct terms that occur in a candidate: a scorer in [0, 1]."""
    q = F.array_distinct(text.tokens(query))
    c = text.tokens(candidate)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(q, c)) / F.size(q), 6))


def first_pass(hits: DataFrame, query) -> DataFrame:
    """Adds ``pass1``: the score of kind, symbol and snippet."""
    head = F.concat_ws(" ", "kind", F.when(F.coalesce("symbol", F.lit("")) != "", F.concat("symbol", F.lit(":"))), "snippet")
    return hits.withColumn("pass1", lexical_score(query, head))


def two_passes(hits: DataFrame, windows: DataFrame, query, limit: int = 10, group: list[str] | None = None) -> DataFrame:
    """Hits in final order: the best ``max(limit, 5)`` of the first pass by the score of
    their best window, then the rest by their first score.

    ``windows``: group, key, window_index, window.  The first of equally good windows wins.
    """
    g = group or []
    part = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    one = hits.withColumn("rank1", F.row_number().over(part.orderBy(F.desc("pass1"), "seq")))
    scored = windows.withColumn("_s", lexical_score(query, F.col("window")))
    best = scored.groupBy(*g, "key").agg(F.max("_s").alias("pass2"), F.max_by("window_index", F.struct("_s", -F.col("window_index"))).alias("best_window"))
    j = one.join(best, [*g, "key"], "left")
    chosen = F.col("rank1") <= max(limit, 5)
    j = j.withColumn("promoted", chosen).withColumn("score", F.when(chosen, F.coalesce("pass2", "pass1")).otherwise(F.col("pass1")))
    return j.withColumn("position", F.row_number().over(part.orderBy(F.desc("promoted"), F.desc("score"), "rank1")))


def above_floor(ranked: DataFrame, floor: float = FLOOR) -> DataFrame:
    return ranked.where(F.col("score") >= floor)


def islands(hits: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Neighbouring hits of one document as one: gaps and islands over their lines.

    ``hits``: package, path, origin, start_line, end_line, position, score.  Hits merge if
    at most DOC_GAP (CODE_GAP) lines lie between them; hits without lines stay alone.  An
    island takes the best position and the best score.
    """
    g = group or []
    docs = F.col("origin") == "docs"
    d = hits.withColumn("_path", text.normal_path(F.col("path"))).withColumn("_docs", docs)
    doc = [*g, "package", "_path", "_docs"]
    lined = d.where("start_line > 0")
    order = ["start_line", "end_line", "position"]
    before = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.when(F.col("_docs"), DOC_GAP).otherwise(CODE_GAP)
    m = lined.withColumn("_pm", F.max("end_line").over(before))
    new = F.col("_pm").isNull() | (F.col("start_line") > F.col("_pm") + 1 + gap)
    m = m.withColumn("_island", F.sum(new.cast("int")).over(Window.partitionBy(*doc).orderBy(*order)))
    merged = m.groupBy(*doc, "_island").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("position").alias("position"),
        F.max("score").alias("score"), F.count(F.lit(1)).alias("merged_count"),
    )
    alone = d.where("NOT start_line > 0 OR start_line IS NULL").select(
        *doc, F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), "position", "score", F.lit(1).cast("bigint").alias("merged_count")
    )
    return merged.drop("_island").unionByName(alone).withColumnRenamed("_path", "path").withColumn("is_docs", F.col("_docs")).drop("_docs")


def interleave(code: DataFrame, docs: DataFrame, k: int, group: list[str] | None = None) -> DataFrame:
    """Code and documentation hits (with ``rank``) in turn, code first, ``k`` in all."""
    g = group or []
    u = code.withColumn("side", F.lit(0)).unionByName(docs.withColumn("side", F.lit(1)))
    w = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy("rank", "side")
    return u.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def diversify(ranked: DataFrame, k: int, group: list[str] | None = None) -> DataFrame:
    """The best code hit and the best documentation hit first, then the rest by position."""
    g = group or []
    side = F.col("origin") == "docs"
    first = F.row_number().over(Window.partitionBy(*g, side).orderBy("position")) == 1
    w = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy(F.desc("_first"), "position")
    return ranked.withColumn("_first", first).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("_first")

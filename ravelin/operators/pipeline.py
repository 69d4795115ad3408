"""The whole search over all packages: plan of runs, fan-out, fusion, ranking, merging.

Texts are read where they lie: each chunk table is scanned once for the terms of all runs,
and only counts travel.  Texts of the few hits in the pool are fetched by their keys.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import text
from ravelin.operators import chunking, fusion, graph, search, vector
from ravelin.session import Cut


@dataclass
class Settings:
    """How a search is run (defaults are fixed values)."""

    top_k: int = 20
    pool: int = 20
    anchor_floor: float = 0.5
    pool_fraction: float = 0.34
    additive_only: bool = True
    rerank: bool = True
    combine: bool = True
    floor: float = fusion.FLOOR


@dataclass
class Run:
    """One formulation of a query: what it weighs and which backends see it."""

    number: int
    words: str
    weight: float
    lexical: bool = True
    vectors: bool = True


@dataclass
class Tables:
    """The tables of all packages; ``docs`` and ``code`` may have a ``vector`` column."""

    docs: DataFrame
    code: DataFrame
    nodes: DataFrame
    embed: object | None = None
    stages: dict[str, DataFrame] = field(default_factory=dict)


class UnknownScope(ValueError):
    """A search in a package that is not there."""


def plan(query: str, variants: list[tuple[str, str]] = ()) -> list[Run]:
    """The original (weight 2, all backends), then each variant (weight 1): ``lex`` for the
    lexical backends, ``vec`` and ``hyde`` for vectors."""
    return [Run(0, query, 2.0)] + [Run(n, v, 1.0, kind == "lex", kind != "lex") for n, (kind, v) in enumerate(variants, 1)]


def in_scope(packages: DataFrame, scope: str | None) -> DataFrame:
    """Packages (package, and version if known) a scope selects: a name or name@version,
    without case; an error that lists what there is if it selects none."""
    if not scope:
        return packages.select("package").distinct()
    name, _, version = scope.lower().partition("@")
    hit = F.lower("package") == name
    if version and "version" in packages.columns:
        hit = hit & (F.lower("version") == version)
    found = packages.where(hit).select("package").distinct()
    if not found.limit(1).count():
        known = [r[0] for r in packages.select("package").distinct().orderBy("package").limit(50).collect()]
        raise UnknownScope(f"no package {scope!r}; there are: {', '.join(known)}")
    return found


def _terms(words: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", words.lower())))


def lexical(cut: Cut, chunks: DataFrame, key: str, runs: list[Run], fetch: int) -> DataFrame:
    """(run, package, key, score, rank): the best ``fetch`` chunks of every package for each
    run, by BM25 with the statistics of the package.

    One scan counts the terms of all runs in each chunk; repeated chunks count once.
    """
    terms = list(dict.fromkeys(t for r in runs for t in _terms(r.words)))
    toks = text.tokens(F.col("content"))

    def count(term: str):
        return F.size(F.filter("_t", lambda x: x == term))

    counts = F.array(*map(count, terms)) if terms else F.array().cast("array<int>")
    seen = cut(chunks.select("package", F.col(key).alias("key"), toks.alias("_t")).select("package", "key", F.size("_t").alias("dl"), counts.alias("tf")).dropDuplicates(["key"]))
    totals = seen.groupBy("package").agg(F.count(F.lit(1)).alias("_n"), F.avg("dl").alias("_avg"))
    p = seen.select("package", "key", "dl", F.posexplode("tf").alias("_i", "tf")).where("tf > 0")
    df = p.groupBy("package", "_i").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    gain = idf * F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("dl") / F.col("_avg")))
    # Few terms of few runs: which run asks for which term is an expression, not a join.
    asks = F.array(*[F.array(*[F.lit(r.number) for r in runs if t in _terms(r.words)]) for t in terms]) if terms else F.array(F.array(F.lit(-1)))
    g = p.join(df, ["package", "_i"]).join(totals, "package").select("package", "key", gain.alias("_g"), F.explode(F.get(asks, F.col("_i"))).alias("run"))
    scored = g.groupBy("run", "package", "key").agg(F.round(F.sum("_g"), 6).alias("score"))
    return search.top(scored, fetch, ["run", "package"], [F.desc("score"), "key"])


def symbols(cut: Cut, nodes: DataFrame, run: Run, fetch: int) -> DataFrame:
    """The best ``fetch`` nodes of every package for one run: by phrase, or by substring in
    packages where the phrase finds nothing.  Adds ``rank``; a blank run finds nothing."""
    if not run.words.strip():
        return nodes.limit(0).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))
    hits = cut(graph.search_phrase(nodes, run.words, by="package"))
    low = run.words.lower()
    like = F.lower("name").contains(low) | F.lower("qualified_name").contains(low)
    rest = nodes.where(like).join(hits.select("package").distinct(), "package", "left_anti").withColumn("score", F.lit(0.0))
    cols = [c for c in nodes.columns if c not in ("_text", "_dl")]
    both = hits.select(*cols, "score").unionByName(rest.select(*cols, "score"))
    return search.top(both, fetch, ["package"], [F.desc("score"), graph.span(), "qualified_name", "id"])


def hits(cut: Cut, t: Tables, runs: list[Run], fetch: int) -> DataFrame:
    """The ranked lists of all runs, packages and backends as one table of hits.

    ``seq`` follows run, package, backend and rank: the order in which they are seen.
    """
    none = F.lit(None).cast("string")
    weight = F.element_at(F.create_map(*[x for r in runs for x in (F.lit(r.number), F.lit(r.weight))]), F.col("run"))
    lex, vec = [r for r in runs if r.lexical], [r for r in runs if r.vectors]
    parts = []
    for backend, (table, key, origin, width) in enumerate(((t.code, "symbol_id", "code", 600), (t.docs, "slice_id", "docs", 400))):
        code = origin == "code"
        lists = [lexical(cut, table, key, lex, fetch).select("run", "package", "key", "rank")]
        if "vector" in table.columns and t.embed is not None and vec:
            q = t.docs.sparkSession.createDataFrame([(r.number, [float(x) for x in t.embed.embed_query(r.words)]) for r in vec], "query_id bigint, query_vector array<double>")
            near = vector.nearest(table.where("vector IS NOT NULL"), q, fetch, key, "vector", by="package")
            lists.append(near.select(F.col("query_id").cast("int").alias("run"), "package", F.col(key).alias("key"), "rank"))
        found = lists[0]
        for x in lists[1:]:
            found = found.unionByName(x)
        found = found.withColumn("backend", F.lit(2 * backend))
        # The hits are few: runs x packages x fetch; the table is read once more for their texts.
        cols = ["package", "path", "start_line", "end_line"]
        texts = table.withColumnRenamed(key, "key").join(found.select("key").distinct(), "key", "left_semi").select(
            "key", *cols, F.substring("content", 1, width).alias("snippet"), *[(F.col(c) if code else none).alias(c) for c in ("symbol", "kind", "signature")]
        ).dropDuplicates(["key"]).drop("package")
        parts.append(found.join(texts, "key").withColumn("origin", F.lit(origin)).drop("key"))
    for r in lex:
        g = symbols(cut, t.nodes, r, fetch)
        parts.append(
            g.select(
                F.lit(r.number).alias("run"), "package", "rank", F.lit(4).alias("backend"), F.col("file_path").alias("path"), "start_line", "end_line",
                F.coalesce("signature", F.concat_ws(" ", "kind", "name")).alias("snippet"), F.col("qualified_name").alias("symbol"), "kind", "signature", F.lit("graph").alias("origin"),
            )
        )
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = cut(u)
    order = u.select("package").distinct().withColumn("_p", F.row_number().over(Window.orderBy("package")))
    seq = ((F.col("run").cast("bigint") * 1_000_000 + F.col("_p")) * 10 + F.col("backend")) * 10_000 + F.col("rank")
    return u.join(order, "package").withColumn("seq", seq).withColumn("from_original", F.col("run") == 0).withColumn("rrf", fusion.rrf(F.col("rank"), weight)).drop("_p")


def bodies(pool: DataFrame, code: DataFrame) -> DataFrame:
    """The rows of ``code`` that hits of a pool may stand for; the pool is at most some dozen
    rows, so its keys are broadcast and no text is shuffled."""
    cols = ["package", "path", "symbol", "start_line", "content"]
    at = code.select(*cols).join(F.broadcast(pool.select("package", "path", "start_line").distinct()), ["package", "path", "start_line"], "left_semi")
    named = code.select(*cols).join(F.broadcast(pool.select("package", "symbol").distinct()), ["package", "symbol"], "left_semi")
    return at.select(*cols).unionByName(named.select(*cols)).distinct()


def search_all(spark: SparkSession, t: Tables, query: str, limit: int = 10, scope: str | None = None, variants: list[tuple[str, str]] = (), settings: Settings | None = None) -> DataFrame:
    """(position, package, path, is_docs, start_line, end_line, score, merged_count) of the best
    ``limit`` hits for a query.

    With ``settings.rerank`` the pool is scored in two passes and cut at the floor; without,
    it keeps the order of its fused scores.  ``limit`` counts merged hits.  What each stage
    gave is kept in ``t.stages``.
    """
    s = settings or Settings()
    cut = Cut(spark, "query")
    if scope:
        every = t.docs.select("package").unionByName(t.code.select("package")).unionByName(t.nodes.select("package"))
        names = [r[0] for r in in_scope(every, scope).collect()]
        t = Tables(*[x.where(F.col("package").isin(names)) for x in (t.docs, t.code, t.nodes)], t.embed, t.stages)
    runs = plan(query, variants)
    fetch = max(s.top_k, limit, 20)
    found = t.stages["hits"] = hits(cut, t, runs, fetch)
    fused = fusion.fuse(found)
    if variants:
        fused = fusion.anchor(cut(fused), s.anchor_floor)
    t.stages["fused"] = fused
    pool = fusion.pool(fused, s.pool) if s.additive_only else fusion.pool_with_share(fused, s.pool, s.pool_fraction)
    pool = t.stages["pool"] = cut(pool)
    q = F.lit(query)
    if s.rerank:
        big = cut(fusion.expand(fusion.first_pass(pool, q), bodies(pool, t.code)).withColumn("_b", F.coalesce("body", "snippet")))
        ranked = fusion.above_floor(fusion.two_passes(big, chunking.kwic(big, ["key"], "_b"), q, limit), s.floor)
    else:
        ranked = pool.withColumn("position", F.col("pool_rank")).withColumn("score", F.col("rrf"))
    ranked = t.stages["ranked"] = ranked.select("package", "path", "origin", "start_line", "end_line", "position", "score")
    if s.combine:
        out = fusion.islands(ranked)
    else:
        lined = ranked.withColumn("path", text.normal_path(F.col("path"))).withColumn("is_docs", F.col("origin") == "docs")
        out = lined.withColumn("merged_count", F.lit(1).cast("bigint")).drop("origin")
    return out.orderBy("position").limit(limit).select("position", "package", "path", "is_docs", "start_line", "end_line", "score", "merged_count")


def stage_listing(stage: DataFrame, most: int = 40) -> str:
    """The first rows of a stage as text, for looking at."""
    return "\n".join("  ".join(str(v) for v in r) for r in stage.limit(most).collect())

"""The tool surface: one function per tool over a catalog of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text
from ravelin.operators import answers, chunking, graph, pipeline, reports, search
from ravelin.plans import core_rank
from ravelin.sources.tables import load


@dataclass
class Catalog:
    """Tables of one data directory: nodes, edges, doc_slices, symbol_sources."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.root, name)

    @property
    def nodes(self) -> DataFrame:
        return graph.current_nodes(self.table("nodes"))

    @property
    def edges(self) -> DataFrame:
        return graph.current_edges(self.table("edges"))


def list_packages(c: Catalog) -> DataFrame:
    d = c.table("doc_slices").groupBy("package").agg(F.countDistinct("path").alias("documents"))
    s = c.table("symbol_sources").groupBy("package").agg(F.countDistinct("symbol_id").alias("symbols"))
    return d.join(s, "package", "full_outer").fillna(0).orderBy("package")


def search_symbols(c: Catalog, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    return graph.search(c.nodes, query, kind, limit)


def get_context(c: Catalog, task: str, limit: int = 20) -> DataFrame:
    return graph.context(c.spark, c.nodes, c.edges, task, 2 * limit)


def get_callers(c: Catalog, symbol: str, limit: int = 20) -> DataFrame:
    return graph.callers(c.nodes, c.edges, symbol, limit)


def get_callees(c: Catalog, symbol: str, limit: int = 20) -> DataFrame:
    return graph.callers(c.nodes, c.edges, symbol, limit, callers=False)


def get_impact(c: Catalog, symbol: str, depth: int = 3) -> DataFrame:
    return graph.impact(c.spark, c.nodes, c.edges, symbol, depth)


def callers_with_bodies(c: Catalog, symbol: str, limit: int = 20, callers: bool = True) -> DataFrame:
    """Callers (or callees) with the stored bodies of those whose name is unique in its package."""
    found = graph.callers(c.nodes, c.edges, symbol, limit, callers=callers).join(c.nodes.select("id", "package"), "id", "left")
    return answers.with_bodies(found, c.table("symbol_sources").select("package", "symbol", "content"), ["file_path", "start_line", "id"])


def files_text(c: Catalog, pattern: str | None = None, limit: int = 200) -> str:
    """The list of files for reading, with what the limit leaves out."""
    every = graph.files(c.nodes, pattern)
    return reports.listing([r[0] for r in every.orderBy("file_path").limit(limit).collect()], every.count(), limit, pattern)


def list_files(c: Catalog, pattern: str | None = None, limit: int = 200) -> DataFrame:
    return graph.files(c.nodes, pattern).orderBy("file_path").limit(limit)


def search_docs(c: Catalog, query: str, limit: int = 10) -> DataFrame:
    out = search.query(c.table("doc_slices").dropDuplicates(["slice_id"]), "slice_id", "content", query, limit)
    return out.withColumn("snippet", text.snippet(F.col("content"), F.lit(False))).drop("content")


def search_code(c: Catalog, query: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """The kind is tested after the limit, so fewer rows may come back."""
    out = search.query(c.table("symbol_sources").dropDuplicates(["symbol_id"]), "symbol_id", "content", query, limit)
    out = out.withColumn("snippet", text.snippet(F.col("content"), F.lit(True))).drop("content")
    return out.where(F.col("kind") == kind) if kind else out


def read_docs(c: Catalog, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The lines of a document (in a range), gaps empty."""
    d = c.table("doc_slices").where(text.path_matches(F.col("path"), path) & ~F.col("line_meta_missing")).dropDuplicates(["slice_id"])
    ln = chunking.gap_filled(d.select("package", "path", F.col("slice_id").alias("chunk_index"), "start_line", "content"), ["package", "path"])
    if start is not None:
        ln = ln.where(F.col("line") >= start)
    if end is not None:
        ln = ln.where(F.col("line") <= end)
    return ln.orderBy("package", "path", "line")


def docs_metadata(c: Catalog) -> DataFrame:
    return c.table("doc_slices").groupBy("package").agg(F.countDistinct("path").alias("documents"), F.countDistinct("slice_id").alias("chunks"))


def read_symbol(c: Catalog, symbol: str) -> DataFrame:
    """Bodies of a symbol with ``status``: unique, or ambiguous where several places define it,
    then without bodies; no row if there is none."""
    s = c.table("symbol_sources").where(F.col("symbol") == symbol).dropDuplicates(["symbol_id"])
    n = s.agg(F.count(F.lit(1)).alias("_n"))
    one = F.col("_n") == 1
    out = s.crossJoin(F.broadcast(n)).withColumn("status", F.when(one, "unique").otherwise("ambiguous"))
    return out.withColumn("content", F.when(one, F.col("content"))).drop("_n")


def read_code(c: Catalog, path: str, line: int) -> DataFrame:
    """The tightest symbol around a line, with its body where it is stored."""
    p = c.nodes.where(text.path_matches(F.col("file_path"), path)).select(F.col("file_path").alias("path")).distinct().withColumn("line", F.lit(line))
    e = graph.enclosing(c.nodes, p)
    body = c.table("symbol_sources").select("path", "start_line", "content").dropDuplicates(["path", "start_line"])
    return e.join(body, ["path", "start_line"], "left")


def query(c: Catalog, words: str, limit: int = 10, scope: str | None = None, variants: list[tuple[str, str]] = (), settings: pipeline.Settings | None = None) -> DataFrame:
    """The whole search; ``variants`` from an expander, ``settings`` for one without a scorer."""
    return pipeline.search_all(c.spark, core_rank.tables(c.spark, c.root), words, limit, scope, variants, settings)


TOOLS = {f.__name__: f for f in (list_packages, search_symbols, get_context, get_callers, get_callees, get_impact, list_files, search_docs, read_docs, docs_metadata, search_code, read_symbol, read_code, query)}

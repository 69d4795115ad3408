"""Queries of the problems on documentation, documents and their pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import docpairs, markup, pagediff, splitting, stuffing
from ravelin.llm.batches import map_batches
from ravelin.sources.tables import load


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nodes").select("id", "package", "kind", "name", "file_path", "start_line", "docstring", "signature", "updated_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.links(_nodes(spark, d)).where("informative").select("id").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of signature (name if null) and cleaned description."""
    return docpairs.links(_nodes(spark, d)).where("informative").select("id", "signature", "description", F.round("weight", 6).alias("weight"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "symbol_sources").select(F.lit("symbol").alias("item_kind"), F.col("symbol_id").alias("item_id"), "content")
    t = load(spark, d, "doc_slices").select(F.lit("doc").alias("item_kind"), F.col("slice_id").alias("item_id"), "content")
    return s.unionByName(t)


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every item, cut where it is too long."""
    return splitting.split(_items(spark, d)).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(_items(spark, d)).where("n_pieces > 1 AND piece = 0").select("item_kind", "item_id").distinct()


def _marked(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "doc_slices").select(F.lit("doc").alias("item_kind"), F.col("slice_id").alias("item_id"), F.col("content").alias("text"))
    hits = load(spark, d, "search_results").where("symbol IS NULL").select(F.lit("hit").alias("item_kind"), F.col("result_id").alias("item_id"), F.col("snippet").alias("text"))
    return docs.unionByName(hits)


def _kinds(kind, item, text) -> list:
    rows = [(a, b, k) for a, b, t in zip(kind, item, text) for k in markup.kinds(t)]
    return [list(c) for c in zip(*rows)] if rows else [[], [], []]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return map_batches(_marked(spark, d), _kinds, "item_kind string, item_id bigint, markup string").distinct()


def _cleaned(kind, item, text) -> list:
    return [kind, item, [markup.clean(t) for t in text]]


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every document slice and of the snippets of hits in documents."""
    return map_batches(_marked(spark, d), _cleaned, "item_kind string, item_id bigint, text string").distinct()


def p7_shared_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines each document slice shares with the nearest page of its package."""
    pages = load(spark, d, "doc_slices").dropDuplicates(["slice_id"]).select(F.col("package").alias("host"), "path", F.col("slice_id").alias("item_id"), F.col("content").alias("text"))
    return pagediff.shared_lines(pages)


def p10_pages(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.pages(load(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pages(spark, d).where("stuffed").select("doc_id").distinct()


def queries():
    return {f.__name__: f for f in (p1_found, p1_pairs, p6_found, p6_pieces, p7_found, p7_clean, p7_shared_lines, p10_found, p10_pages)}


def oracle():
    return {
        "p6_found": """
SELECT DISTINCT 'symbol' AS item_kind, symbol_id AS item_id FROM symbol_sources WHERE length(content) > 1600
UNION ALL
SELECT DISTINCT 'doc' AS item_kind, slice_id AS item_id FROM doc_slices WHERE length(content) > 1600
""",
    }

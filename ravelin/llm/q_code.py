"""Queries of the problems on source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import authorship, validity
from ravelin.sources.tables import load


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "file_scans").select("package", "path", "seen_at", "received_at", "content")


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """Signals and verdict for every file."""
    return authorship.classify(spark, _scans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_files(spark, d).where("generated OR blob OR minified OR vendored").select("path")


def p3_handwritten(spark: SparkSession, d: str) -> DataFrame:
    """Hand-written files and the number of their symbols."""
    mine = p3_files(spark, d).where("NOT (generated OR blob OR minified OR vendored)").select("path", "package", "language")
    symbols = load(spark, d, "nodes").where("kind <> 'file'").groupBy(F.col("file_path").alias("path")).agg(F.countDistinct("id").alias("symbols"))
    return mine.join(symbols, "path", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file's verdict with all errors."""
    return validity.verdicts(_scans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_files(spark, d).where("n_errors > 0").select("path")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.rates(p4_files(spark, d))


def queries():
    return {f.__name__: f for f in (p3_found, p3_files, p3_handwritten, p4_found, p4_files, p4_rates)}


def oracle():
    return {}

"""Queries of the problems on the corpus as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import leakage, mixing
from ravelin.session import Cut
from ravelin.sources.tables import load


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    return leakage.leaks(spark, docs, load(spark, d, "eval_items"), exact_only=True).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Exact leaks and paraphrases with their scores."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    out = leakage.leaks(spark, docs, load(spark, d, "eval_items"))
    return out.withColumn("cosine", F.round("cosine", 4)).withColumn("lcs_share", F.round("lcs_share", 4))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return Cut(spark, "mixing")(mixing.sizes(load(spark, d, "documents").select("doc_id", "source", "text")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mixture with the number of times each is used."""
    return mixing.mix(_sized(spark, d), load(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares."""
    sized, targets = _sized(spark, d), load(spark, d, "mix_targets")
    return mixing.shares(sized, targets, mixing.mix(sized, targets))


def queries():
    return {f.__name__: f for f in (p8_found, p8_leaks, p9_mix, p9_shares)}


def oracle():
    return {}

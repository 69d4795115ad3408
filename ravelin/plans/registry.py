"""Collects the named queries of all core modules."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ["core_pipeline", "core_graph", "core_text", "core_rank", "core_store", "core_cases"]


def _modules():
    return [importlib.import_module(f"ravelin.plans.{m}") for m in MODULES]


def queries():
    return {k: f for m in _modules() for k, f in m.queries().items()}


def oracle():
    return {k: q for m in _modules() for k, q in m.oracle().items()}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return queries()["flagship"](spark, root)

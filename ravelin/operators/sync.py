"""Bringing a graph up to date: what changed and what a change touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.skew import lookup_join


def classify(disk: DataFrame, known: DataFrame) -> DataFrame:
    """(path, state): added, changed, deleted or same, by checksum.  One row per path each."""
    a = disk.select("path", F.col("checksum").alias("_d"), F.lit(True).alias("_on"))
    b = known.select("path", F.col("checksum").alias("_k"), F.lit(True).alias("_in"))
    j = a.join(b, "path", "full_outer")
    state = (
        F.when(F.col("_in").isNull(), "added").when(F.col("_on").isNull(), "deleted").when(~F.col("_d").eqNullSafe(F.col("_k")), "changed").otherwise("same")
    )
    return j.select("path", state.alias("state"))


def touched_files(nodes: DataFrame, edges: DataFrame, gone: DataFrame, fresh_names: DataFrame | None = None) -> DataFrame:
    """Unchanged files whose references must be resolved again.

    These point into a ``gone`` file (path) or at a name that is defined in one or in
    ``fresh_names`` (name).  Both sides are semi-joins, united, instead of one join with
    an ``or``.
    """
    g = gone.select(F.col("path").alias("_gone")).distinct()
    n = nodes.select("id", "name", "kind", "file_path")
    delta = n.where(~F.col("kind").isin("file", "import")).join(g, n["file_path"] == g["_gone"], "left_semi").select("name")
    if fresh_names is not None:
        delta = delta.unionByName(fresh_names.select("name"))
    delta = delta.distinct()
    e = edges.where("kind <> 'contains'").select("source", "target").distinct()
    src = n.select(F.col("id").alias("source"), F.col("file_path").alias("file")).join(g, F.col("file") == g["_gone"], "left_anti")
    tgt = n.select(F.col("id").alias("target"), F.col("file_path").alias("_tf"), F.col("name").alias("_tn"))
    # A function of a shared runtime may be the target of a tenth of all edges.
    j = lookup_join(e.join(src, "source"), tgt, "target", "target", "inner")
    by_file = j.join(g, j["_tf"] == g["_gone"], "left_semi").select("file")
    by_name = j.join(delta.withColumnRenamed("name", "_tn"), "_tn", "left_semi").select("file")
    return by_file.unionByName(by_name).distinct()


def apply(nodes: DataFrame, edges: DataFrame, gone: DataFrame, again: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a change: what lies in ``gone`` files goes, with every edge at
    it; references out of ``again`` files are replaced; the new ones are added."""
    g = gone.select(F.col("path").alias("file_path")).distinct()
    kept = nodes.join(g, "file_path", "left_anti").select(*nodes.columns)
    ids = kept.select("id")
    out_of_again = kept.join(again.select(F.col("file").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("source"))
    alive = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    contains = alive.where("kind = 'contains'")
    refs = alive.where("kind <> 'contains'").join(out_of_again, "source", "left_anti")
    return kept.unionByName(new_nodes), contains.select(*edges.columns).unionByName(refs.select(*edges.columns)).unionByName(new_edges).distinct()

"""Parent-child links to full hierarchies, by pointer doubling.

Every node starts with a pointer to its parent.  A round replaces the pointer by the
pointer of the node it points to, so the distance covered doubles; after a logarithmic
number of rounds each pointer has reached a root.  Nodes left when a round resolves
nothing new lie on a circle or hang below one: a node deeper than the distance covered
so far would have an ancestor that this very round resolves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators.skew import lookup_join
from ravelin.session import Cut


def parent_links(edges: DataFrame, kind: str | None = "contains", source: str = "source", target: str = "target", kind_col: str = "kind") -> DataFrame:
    """Distinct (node, parent) links of one edge kind, one row per node.

    The kind is compared without case and outer blanks.  Rows with a null end are no
    links.  A node with several parents keeps the smallest parent id (byte order), which
    makes every chain of parents unique.
    """
    e = edges
    if kind is not None:
        e = e.where(F.lower(F.trim(F.col(kind_col))) == kind)
    return (
        e.select(F.col(target).alias("node"), F.col(source).alias("parent"))
        .where(F.col("node").isNotNull() & F.col("parent").isNotNull())
        .groupBy("node")
        .agg(F.min("parent").alias("parent"))
    )


def dropped_links(edges: DataFrame, kind: str | None = "contains", source: str = "source", target: str = "target", kind_col: str = "kind") -> DataFrame:
    """(node, parent, kept): the links that ``parent_links`` leaves out because their node has
    a smaller parent, with the one that was kept."""
    e = edges if kind is None else edges.where(F.lower(F.trim(F.col(kind_col))) == kind)
    every = e.select(F.col(target).alias("node"), F.col(source).alias("parent")).where(F.col("node").isNotNull() & F.col("parent").isNotNull())
    several = every.groupBy("node").agg(F.min("parent").alias("kept"), F.max("parent").alias("_most")).where("kept <> _most").drop("_most")
    return every.join(several, "node").where("parent <> kept").distinct().select("node", "parent", "kept")


def resolve(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root, depth) for every node of ``links`` that has a parent.

    ``depth`` counts links down from the root (a root itself has depth 0 and no row).
    Nodes whose chain of parents runs into a circle get depth -1 and as root the smallest
    id on that circle.  An empty table gives an empty result; repeated links do no harm.
    """
    cut = Cut(spark, "hierarchy")
    links = cut(links.select("node", "parent"))
    has_parent = links.select(F.col("node").alias("_p"))
    # A parent without a parent of its own is a root: its children are resolved at once.
    first = lookup_join(links, has_parent.withColumn("_up", F.lit(True)), "parent", "_p", "left")
    state = cut(first.select("node", F.col("parent").alias("ptr"), F.lit(1).alias("dist"), F.col("_up").isNull().alias("done")))
    done, active = [state.where("done")], state.where(~F.col("done"))
    left = active.count()
    while left:
        look = active
        for d in done:
            look = look.unionByName(d)
        look = look.select(F.col("node").alias("_n"), F.col("ptr").alias("_ptr"), F.col("dist").alias("_dist"), F.col("done").alias("_done"))
        step = cut(
            lookup_join(active, look, "ptr", "_n", "inner", rows=left).select(
                "node", F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_done").alias("done")
            )
        )
        now = step.where(~F.col("done")).count()
        done.append(step.where("done"))
        active = step.where(~F.col("done"))
        if now == left:
            break
        left = now
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.select("node", F.col("ptr").alias("root"), F.col("dist").alias("depth"))
    if left:
        out = out.unionByName(_circles(cut, links, active.select("node", "ptr"), left))
    return out


def _circles(cut: Cut, links: DataFrame, jumps: DataFrame, rows: int) -> DataFrame:
    """(node, root, -1) for nodes that never reach a root; ``jumps`` maps each some steps up."""
    # The image of the jump shrinks until it is exactly the set of nodes on circles.
    n = jumps.select("ptr").distinct().count()
    while True:
        look = jumps.select(F.col("node").alias("_n"), F.col("ptr").alias("_ptr"))
        jumps = cut(lookup_join(jumps, look, "ptr", "_n", "inner", rows=rows).select("node", F.col("_ptr").alias("ptr")))
        m = jumps.select("ptr").distinct().count()
        if m == n:
            break
        n = m
    on = jumps.select(F.col("ptr").alias("node")).distinct()
    ring = cut(links.join(on, "node", "left_semi").select("node", F.col("parent").alias("nxt"), F.col("node").alias("low")))
    while True:
        look = ring.select(F.col("node").alias("_n"), F.col("nxt").alias("_nxt"), F.col("low").alias("_low"))
        ring = cut(
            ring.join(look, ring["nxt"] == look["_n"]).select(
                "node", F.col("_nxt").alias("nxt"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")
            )
        )
        if ring.where("moved").limit(1).count() == 0:
            break
        ring = ring.drop("moved")
    low = ring.select(F.col("node").alias("_n"), F.col("low").alias("root"))
    return lookup_join(jumps, low, "ptr", "_n", "inner", rows=rows).select("node", "root", F.lit(-1).alias("depth"))


def paths(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root, depth, path) for every node below a root; ``path`` runs root to node.

    The same doubling, now concatenating path segments; circles are taken out first, so
    no segment grows without bound.  The size of the result is the sum of all depths.
    """
    cut = Cut(spark, "paths")
    tree = cut(resolve(spark, links))
    sound = tree.where("depth > 0").select("node", "root", "depth")
    base = links.join(sound.select("node", "depth"), "node")
    state = cut(base.select("node", F.col("parent").alias("ptr"), F.array("node").alias("seg"), (F.col("depth") == 1).alias("done")))
    done, active = [state.where("done")], state.where(~F.col("done"))
    while left := active.count():
        look = active
        for d in done:
            look = look.unionByName(d)
        look = look.select(F.col("node").alias("_n"), F.col("ptr").alias("_ptr"), F.col("seg").alias("_seg"), F.col("done").alias("_done"))
        step = cut(
            lookup_join(active, look, "ptr", "_n", "inner", rows=left).select(
                "node", F.col("_ptr").alias("ptr"), F.concat("_seg", "seg").alias("seg"), F.col("_done").alias("done")
            )
        )
        done.append(step.where("done"))
        active = step.where(~F.col("done"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("node", F.col("ptr").alias("root"), F.size("seg").alias("depth"), F.concat(F.array("ptr"), F.col("seg")).alias("path"))


def descendants(node_paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance), one row per pair on a path, without self pairs."""
    ex = node_paths.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
    return ex.where(F.col("pos") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))

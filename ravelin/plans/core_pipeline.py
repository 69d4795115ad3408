"""Queries of the two pipeline problems that concern any kind of record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import hierarchy, incremental
from ravelin.session import Cut
from ravelin.sources.tables import load


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.parent_links(load(spark, d, "edges").select("source", "target", "kind"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.resolve(spark, _links(spark, d))
    return tree.where((F.col("depth") >= 7) | (F.col("depth") < 0)).select(F.col("node").alias("id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path, depth and root of every node below a root."""
    p = hierarchy.paths(spark, _links(spark, d))
    return p.select(F.col("node").alias("id"), F.col("root").alias("root_id"), "depth", F.array_join("path", " > ").alias("path"))


def p2_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Links left out because their node has another parent."""
    return hierarchy.dropped_links(load(spark, d, "edges").select("source", "target", "kind"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node, one row per pair."""
    return hierarchy.descendants(hierarchy.paths(spark, _links(spark, d)))


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """(path, checksum) as successful runs have indexed it last."""
    files = load(spark, d, "files").select("path", "content_hash", "size", "indexed_at", "modified_at")
    known = incremental.rows_of_runs(files.withColumn("_at", F.timestamp_millis("indexed_at")), "_at", load(spark, d, "sync_runs")).select(
        "path", "indexed_at", "modified_at", "size", "content_hash"
    )
    return incremental.newest(known, "path", ["indexed_at", "modified_at"]).select("path", F.lit(None).cast("long").alias("size"), incremental.hex_digest(F.col("content_hash")).alias("checksum"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """What the next run has to index, each path once: the run's committed output, over a
    manifest of what successful runs have indexed (files count as changed by checksum)."""
    scans = load(spark, d, "file_scans").select("path", "seen_at", "received_at", "content_hash", "size", F.col("content").isNotNull().alias("there"))
    listing = incremental.newest(scans, "path", ["seen_at", "received_at"]).where("there").select("path", "size", incremental.hex_digest(F.col("content_hash")).alias("checksum"))
    runs = incremental.Incremental(spark, Cut(spark, "incremental").root)
    runs.adopt(_indexed(spark, d))
    if runs.run(listing, lambda due: due.select("path", "change")) is None:
        return spark.createDataFrame([], "path string, change string")
    return runs.output().select("path", "change")


def queries():
    return {f.__name__: f for f in (p2_found, p2_paths, p2_dropped, p2_descendants, p5_found)}


_TREE = """
WITH RECURSIVE links AS (
  SELECT target AS node, min(source) AS parent FROM edges
  WHERE lower(trim(kind)) = 'contains' AND source IS NOT NULL AND target IS NOT NULL GROUP BY target
), tree AS (
  SELECT l.node, l.parent AS root, 1 AS depth, l.parent || ' > ' || l.node AS path
  FROM links l WHERE l.parent NOT IN (SELECT node FROM links)
  UNION ALL
  SELECT l.node, t.root, t.depth + 1, t.path || ' > ' || l.node FROM tree t JOIN links l ON l.parent = t.node
)
"""


def oracle():
    return {
        "p2_found": _TREE.rstrip() + """,
lost AS (SELECT node, parent FROM links WHERE node NOT IN (SELECT node FROM tree)),
walk AS (
  SELECT node, parent AS here, 1 AS n FROM lost
  UNION ALL
  SELECT w.node, l.parent, w.n + 1 FROM walk w JOIN lost l ON l.node = w.here WHERE w.n < 200
),
ring AS (SELECT DISTINCT node FROM walk WHERE here = node),
low AS (
  SELECT w.node, min(w.here) AS root FROM walk w WHERE w.here IN (SELECT node FROM ring) GROUP BY w.node
)
SELECT node AS id, root AS root_id, CAST(depth AS INTEGER) AS depth FROM tree WHERE depth >= 7
UNION ALL
SELECT node AS id, root AS root_id, CAST(-1 AS INTEGER) AS depth FROM low
""",
        "p2_paths": _TREE + "SELECT node AS id, root AS root_id, CAST(depth AS INTEGER) AS depth, path FROM tree",
        "p2_dropped": """
WITH e AS (SELECT DISTINCT target AS node, source AS parent FROM edges WHERE lower(trim(kind)) = 'contains' AND source IS NOT NULL AND target IS NOT NULL),
k AS (SELECT node, min(parent) AS kept FROM e GROUP BY node)
SELECT e.node, e.parent, k.kept FROM e JOIN k USING (node) WHERE e.parent <> k.kept
""",
        "p2_descendants": """
WITH RECURSIVE links AS (
  SELECT target AS node, min(source) AS parent FROM edges
  WHERE lower(trim(kind)) = 'contains' AND source IS NOT NULL AND target IS NOT NULL GROUP BY target
), tree AS (
  SELECT node FROM links l WHERE l.parent NOT IN (SELECT node FROM links)
  UNION ALL
  SELECT l.node FROM tree t JOIN links l ON l.parent = t.node
), up AS (
  SELECT l.node AS descendant, l.parent AS ancestor, 1 AS distance FROM links l WHERE l.node IN (SELECT node FROM tree)
  UNION ALL
  SELECT u.descendant, l.parent, u.distance + 1 FROM up u JOIN links l ON l.node = u.ancestor
)
SELECT ancestor, descendant, CAST(distance AS INTEGER) AS distance FROM up
""",
        "p5_found": """
WITH spans AS (
  SELECT run_id, status, started_at,
         coalesce(finished_at, lead(started_at) OVER (ORDER BY started_at) - INTERVAL 1 MICROSECOND, TIMESTAMP '9999-12-31') AS ended_at
  FROM sync_runs
), known AS (
  SELECT f.path, lower(regexp_extract(f.content_hash, '([0-9A-Fa-f]{32,})\\s*$', 1)) AS h,
         row_number() OVER (PARTITION BY f.path ORDER BY f.indexed_at DESC, f.modified_at DESC, f.size DESC, f.content_hash DESC) AS rn
  FROM files f JOIN spans s ON make_timestamp(f.indexed_at * 1000) >= s.started_at::TIMESTAMP AND make_timestamp(f.indexed_at * 1000) <= s.ended_at::TIMESTAMP
  WHERE lower(trim(s.status)) = 'ok'
), seen AS (
  SELECT path, content, lower(regexp_extract(content_hash, '([0-9A-Fa-f]{32,})\\s*$', 1)) AS h,
         row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, received_at DESC) AS rn
  FROM file_scans
)
SELECT s.path, CASE WHEN k.path IS NULL THEN 'added' ELSE 'changed' END AS change
FROM seen s LEFT JOIN (SELECT * FROM known WHERE rn = 1) k ON k.path = s.path
WHERE s.rn = 1 AND s.content IS NOT NULL AND (k.path IS NULL OR k.h IS DISTINCT FROM s.h)
""",
    }

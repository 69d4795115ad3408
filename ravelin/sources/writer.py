"""Writing and building packages: graph tables, chunk tables and the archive."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin import schemas
from ravelin.operators import chunking, extraction, storage, sync
from ravelin.session import Cut
from ravelin.sources import archive, tree


def write_graph(nodes: DataFrame, edges: DataFrame, files: DataFrame, path: str) -> None:
    """Nodes (first of each id), edges (all) and files (last of each path) as tables, with
    the rows of the schema versions."""
    spark = nodes.sparkSession
    n = schemas.conform(nodes, schemas.NODES)
    storage.first_wins(n, "id", ["updated_at", "file_path", "start_line"]).write.mode("overwrite").parquet(f"{path}/nodes")
    schemas.conform(edges, schemas.EDGES).write.mode("overwrite").parquet(f"{path}/edges")
    f = schemas.conform(files, schemas.FILES)
    storage.first_wins(f, "path", [F.desc("indexed_at"), F.desc("modified_at"), "content_hash"]).write.mode("overwrite").parquet(f"{path}/files")
    spark.createDataFrame([(1,), (schemas.SCHEMA_VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    schemas.check_version(spark.read.parquet(f"{path}/versions"))
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("nodes", "edges", "files"))


def update(spark: SparkSession, root: str, path: str, package: str) -> dict[str, int]:
    """Brings the graph at ``path`` up to date with the folder: how many files were added,
    changed and deleted, and how many others were resolved again.

    Only changed files and those that point at them are read and parsed.  The result is that of
    a new build, but for references of untouched files that led nowhere before.
    """
    cut = Cut(spark, "update")
    nodes, edges, files = read_graph(spark, path)
    now = tree.scan(spark, root)
    state = cut(sync.classify(now.select("path", F.col("content_hash").alias("checksum")), files.select("path", F.col("content_hash").alias("checksum"))))
    count = {r["state"]: r["count"] for r in state.groupBy("state").count().collect()}
    if not set(count) - {"same"}:
        return {"added": 0, "changed": 0, "deleted": 0, "again": 0}
    gone = state.where("state IN ('changed', 'deleted')").select("path")
    fresh = now.join(state.where("state IN ('added', 'changed')").select("path"), "path", "left_semi")
    names = extraction.extract(fresh).where("row = 'node' AND kind NOT IN ('file', 'import')").select("name").distinct()
    again = cut(sync.touched_files(nodes, edges, gone, names))
    parts = fresh.unionByName(now.join(again.select(F.col("file").alias("path")), "path", "left_semi"))
    lost = gone.unionByName(again.select(F.col("file").alias("path"))).select(F.col("path").alias("file_path"))
    n, e = extraction.build(parts, nodes.join(lost, "file_path", "left_anti"))
    stamp = {"package": F.lit(package), "updated_at": F.lit(0).cast("long")}
    new_nodes = schemas.conform(n.join(again.select(F.col("file").alias("file_path")), "file_path", "left_anti").withColumns(stamp), schemas.NODES)
    all_nodes, all_edges = sync.apply(nodes, edges, gone, again, new_nodes, schemas.conform(e, schemas.EDGES))
    kept = files.join(gone, "path", "left_anti")
    rows = schemas.conform(fresh.withColumns({"package": F.lit(package), "indexed_at": F.col("modified_at"), "errors": F.to_json("errors")}), schemas.FILES)
    made = (cut(all_nodes), cut(all_edges), cut(kept.select(*rows.columns).unionByName(rows)))
    write_graph(*made, path)
    return {**{k: count.get(k, 0) for k in ("added", "changed", "deleted")}, "again": again.count()}


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics of a catalog table for the planner."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def merge_metadata(path: str, **values) -> dict:
    """Adds values to a JSON document, keeping the others."""
    old = json.load(open(path, encoding="utf-8")) if os.path.exists(path) else {}
    new = old | {k: v for k, v in values.items() if v is not None}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(new, f, indent=2, sort_keys=True)
    return new


def build(spark: SparkSession, root: str, name: str, version: str, out: str, package: str | None = None) -> str:
    """Graph, document chunks and code chunks of a folder, packed into one archive.

    Returns the archive's digest.
    """
    package = package or name
    files = tree.scan(spark, root)
    nodes, edges = extraction.build(files)
    nodes = nodes.withColumn("package", F.lit(package)).withColumn("updated_at", F.lit(0).cast("long"))
    work = out + ".work"
    write_graph(nodes, edges, files.withColumn("package", F.lit(package)).withColumn("indexed_at", F.col("modified_at")).withColumn("errors", F.to_json("errors")), f"{work}/graph")
    docs = tree.docs(spark, root)
    d = chunking.chunk(docs, "path", "content").withColumn("package", F.lit(package))
    schemas.conform(d, schemas.DOCS).write.mode("overwrite").parquet(f"{work}/docs")
    s = nodes.where(~F.col("kind").isin("file", "import") & F.col("start_line").isNotNull() & (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line"))).select("id", F.col("file_path").alias("path"), "start_line", "end_line", "name", "kind", "signature")
    bodies = chunking.symbol_bodies(s.select("id", "path", "start_line", "end_line"), files)
    code = chunking.long_bodies(bodies).join(s.drop("end_line"), "id").join(bodies.select("id", F.col("last_line").alias("end_line"), F.col("signature").alias("_code")), "id").withColumn("signature", F.coalesce("signature", "_code"))
    c = code.select(F.lit(package).alias("package"), "path", F.when(F.col("part") > 0, F.concat_ws("#", "name", "part")).otherwise(F.col("name")).alias("symbol"), "kind", "signature", "content", "start_line", "end_line")
    schemas.conform(c, schemas.CODE).write.mode("overwrite").parquet(f"{work}/code")
    merge_metadata(f"{work}/docs.json", documents=docs.count(), chunks=d.count())
    merge_metadata(f"{work}/code.json", symbols=c.count())
    return archive.pack(work, {"name": name, "version": version}, out)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a chunk table."""
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Puts a table, made from the one at ``path``, in its place: written beside it, then renamed."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    old, new, gone = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + x) for x in ("", ".new", ".old"))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").parquet(str(new))
    fs.delete(gone, True)
    fs.rename(old, gone)
    fs.rename(new, old)
    fs.delete(gone, True)
    spark.catalog.refreshByPath(path)

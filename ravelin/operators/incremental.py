"""Processing only new or changed records, with a manifest of what has been processed.

A run takes out of its listing, by anti-join, what the manifest already holds with the same
size and checksum.  The items due are written down once; the output and the new manifest
entries are both made from that table, so a listing that changes meanwhile cannot set them
apart.  A run works in a folder of its own and commits by claiming the next batch number and
renaming its tables into place, the manifest last.  A run that fails before leaves nothing
that others see and the next one plans the same items; of two runs at a time one gets the
number and the other an error.  Nothing is skipped and nothing stays twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("batch_id", T.StringType()),
    ]
)


def hex_digest(col):
    """A checksum's hexadecimal digits in lower case; null stays null.

    A label before the digits and blanks around them are dropped.
    """
    return F.lower(F.regexp_extract(col, "([0-9A-Fa-f]{32,})\\s*$", 1))


def newest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per ``key``: the greatest by ``order``, whole rows deciding ties.

    An aggregation, not a window: partial maxima are combined before the shuffle, so a
    key with very many rows stays cheap.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    best = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in df.columns if c != key])


def plan(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Items of ``listing`` (path, checksum, ...) that ``manifest`` lacks or holds otherwise.

    Adds ``change``: ``added`` or ``changed``.  Both sides have one row per path.  A null
    checksum on one side only counts as a change; on both sides as none.  Sizes are compared
    where both tables have that column and both sizes are known.
    """
    sized = "size" in listing.columns and "size" in manifest.columns
    m = manifest.select("path", "checksum", *(["size"] if sized else [])).alias("m")
    j = listing.drop("change").alias("l").join(m, F.col("l.path") == F.col("m.path"), "left")
    new, same = F.col("m.path").isNull(), F.col("l.checksum").eqNullSafe(F.col("m.checksum"))
    if sized:
        same = same & F.coalesce(F.col("l.size") == F.col("m.size"), F.lit(True))
    return j.where(new | ~same).select("l.*", F.when(new, "added").otherwise("changed").alias("change"))


def rows_of_runs(rows: DataFrame, at: str, runs: DataFrame, ok: str = "ok") -> DataFrame:
    """Rows whose time ``at`` (timestamp) falls into a run that ended with status ``ok``.

    A run without end lasts until the next one starts.  The interval join is an equi-join
    on days with a recheck.  ``runs`` is the log of the runs themselves, a few a day.
    """
    starts = runs.groupBy("started_at").agg(F.count(F.lit(1)).alias("_k")).withColumn("_next", F.lead("started_at").over(Window.orderBy("started_at"))).drop("_k")
    spans = runs.join(starts, "started_at").where(F.lower(F.trim("status")) == ok).select(
        "run_id",
        F.col("started_at").alias("_from"),
        F.coalesce("finished_at", F.col("_next") - F.expr("INTERVAL 1 MICROSECOND"), F.lit("9999-12-31").cast("timestamp")).alias("_to"),
    )
    last = rows.agg(F.max(at).alias("_last"))
    days = spans.crossJoin(F.broadcast(last)).withColumn(
        "_day", F.explode(F.expr("sequence(to_date(_from), greatest(to_date(_from), to_date(least(_to, coalesce(_last, _from)))))"))
    )
    r = rows.withColumn("_at_day", F.to_date(at))
    j = r.join(days, (r["_at_day"] == days["_day"]) & (r[at] >= days["_from"]) & (r[at] <= days["_to"]))
    return j.drop("_at_day", "_day", "_from", "_to", "_last")


class Conflict(RuntimeError):
    """Another run has committed since this one looked at the manifest."""


class Incremental:
    """Exactly-once batches over a listing, with a manifest in ``root``.

    ``process`` turns the planned items into output rows.  Committed output lies in
    ``out/batch_id=<id>``, its entries in ``manifest/batch_<id>``; folders get there by
    renaming, so all that lies under ``manifest`` is whole and committed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _claimed(self) -> int:
        base = self._path("claims")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(base)), default=-1) if self._fs.exists(base) else -1

    def manifest(self) -> DataFrame:
        """The newest entry of each path over all committed batches."""
        if not self._fs.exists(self._path("manifest")):
            return self.spark.createDataFrame([], MANIFEST)
        return newest(self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/*"), "path", ["batch_id"])

    def plan(self, listing: DataFrame) -> DataFrame:
        return plan(listing, self.manifest())

    def _commit(self, after: int, entries: DataFrame, work: str, has_output: bool) -> str:
        """Claims the number after ``after`` and makes the run's tables visible."""
        batch = f"{after + 1:08d}"
        entries.select("path", F.col("size").cast("long").alias("size"), "checksum", F.lit(batch).alias("batch_id")).write.parquet(f"{self.root}/{work}/manifest")
        try:
            self._fs.create(self._path(f"claims/{batch}"), False).close()
        except Exception as e:
            raise Conflict(f"batch {batch} has been committed by another run") from e
        for source, target in ([("out", f"out/batch_id={batch}")] if has_output else []) + [("manifest", f"manifest/batch_{batch}")]:
            self._fs.mkdirs(self._path(target).getParent())
            if not self._fs.rename(self._path(f"{work}/{source}"), self._path(target)):
                raise RuntimeError(f"{target} could not be put into place")
        self._fs.delete(self._path(work), True)
        return batch

    def adopt(self, entries: DataFrame) -> str:
        """Commits entries (path, size, checksum) that have been processed elsewhere."""
        return self._commit(self._claimed(), entries, f"work/{uuid.uuid4().hex}", False)

    def run(self, listing: DataFrame, process: Callable[[DataFrame], DataFrame], fail_before_commit: bool = False) -> str | None:
        """Processes what is due; returns the batch's id, or None if nothing is due."""
        after, work = self._claimed(), f"work/{uuid.uuid4().hex}"
        self.plan(listing).write.parquet(f"{self.root}/{work}/due")
        due = self.spark.read.parquet(f"{self.root}/{work}/due")
        if not due.limit(1).count():
            self._fs.delete(self._path(work), True)
            return None
        process(due).write.parquet(f"{self.root}/{work}/out")
        if fail_before_commit:
            raise RuntimeError("stopped between output and commit")
        return self._commit(after, due, work, True)

    def output(self) -> DataFrame:
        """Rows of committed batches only."""
        done = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/*").select(F.col("batch_id").cast("int").alias("_b")).distinct()
        rows = self.spark.read.parquet(f"{self.root}/out")
        return rows.join(done, F.col("batch_id").cast("int") == F.col("_b"), "left_semi")

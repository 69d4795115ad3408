"""Continuous indexing: a file stream that drives the incremental operator.

An extension; the batch operators do not need it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ravelin.operators.incremental import Incremental, newest


def follow(spark: SparkSession, folder: str, schema: str, state: str, process: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Feeds new Parquet files of scan records (path, seen_at, size, checksum, ...) to an
    incremental run each; records delivered again change nothing."""
    runs = Incremental(spark, state)

    def step(batch: DataFrame, _: int) -> None:
        runs.run(newest(batch, "path", ["seen_at"]), process)

    w = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()

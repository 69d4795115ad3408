"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with fewer rows than this is no hot spot, whatever its share.
LEAST_HOT_ROWS = 50_000


def hot_keys(df: DataFrame, key: str, share: float = 0.02, least: int = LEAST_HOT_ROWS) -> list:
    """Keys with at least ``share`` of all rows and ``least`` rows: at most ``1 / share`` values.

    Counted with map-side combining, so a hot key never travels row by row; the bound on
    the number of values makes it safe to bring them to the driver.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    top = counts.orderBy(F.desc("_n"), key).limit(int(1 / share) + 1).collect()
    if not top:
        return []
    total = df.count()
    return [r[0] for r in top if r["_n"] >= share * total]


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", salts: int = 64, share: float = 0.02, least: int = LEAST_HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Equi-join of ``left`` with a table ``right`` that has one row per key.

    Rows of ``left`` with a hot key are spread over ``salts`` partitions; only the few
    matching rows of ``right`` are repeated.  ``right_key`` is not in the result.  Null
    keys match nothing.  ``rows``, if the caller knows the number of rows of ``left``,
    saves the count of keys where no key can reach ``least``.
    """
    right = right.withColumnRenamed(right_key, "_rkey")
    hot = [] if rows is not None and rows < least else hot_keys(left, left_key, share, least)
    if not hot:
        return left.join(right, F.col(left_key) == F.col("_rkey"), how).drop("_rkey")
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    marked = left.withColumn("_salt", F.when(F.col(left_key).isin(hot), salt).otherwise(F.lit(0)))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    spread = right.withColumn("_rsalt", F.explode(F.when(F.col("_rkey").isin(hot), every).otherwise(F.array(F.lit(0)))))
    return marked.join(spread, (F.col(left_key) == F.col("_rkey")) & (F.col("_salt") == F.col("_rsalt")), how).drop("_salt", "_rsalt", "_rkey")

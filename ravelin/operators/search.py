"""Full-text search over chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text
from ravelin.operators import inverted
from ravelin.operators.inverted import B, K1
from ravelin.session import Cut


def postings(chunks: DataFrame, key: str, content: str, wanted: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, dl) of a chunk table; only the terms of ``wanted`` (term) if given.

    The wanted terms meet the exploded tokens before anything is shuffled where they are
    few enough for the planner to broadcast.
    """
    t = chunks.select(F.col(key), text.tokens(F.col(content)).alias("_t"))
    ex = t.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    if wanted is not None:
        ex = ex.join(wanted.select("term").distinct(), "term", "left_semi")
    return ex.groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(chunks: DataFrame, key: str, content: str, queries: DataFrame) -> DataFrame:
    """(query_id, key, score) for each query (query_id, query_text) and each chunk that has
    one of its terms.  Terms repeated in a query count once."""
    q = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query_text")))).alias("term"))
    p = postings(chunks, key, content, q)
    totals = chunks.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size(text.tokens(F.col(content)))).alias("_avg"))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    w = p.join(df, "term").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))
    return q.join(w.select(key, "term", gain.alias("_g")), "term").groupBy("query_id", key).agg(F.round(F.sum("_g"), 6).alias("score"))


def top(scored: DataFrame, k: int, by: list[str], order: list) -> DataFrame:
    """The first ``k`` rows of every group, with their rank from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query(chunks: DataFrame, key: str, content: str, words: str, k: int = 10) -> DataFrame:
    """The best ``k`` chunks for one query, with score."""
    q = chunks.sparkSession.createDataFrame([(0, words)], "query_id int, query_text string")
    s = bm25(chunks, key, content, q).drop("query_id")
    return chunks.join(s, key).orderBy(F.desc("score"), key).limit(k)


def best(chunks: DataFrame, key: str, content: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best chunks of every query, the smaller key
    first among equal scores.  Of the lists of the chunks those of the queries' terms are kept.

    ``bm25`` has a row for each pair of a query and a chunk; here tasks keep only the best.
    """
    cut = Cut(chunks.sparkSession, "search")
    q, terms = inverted.asked(cut, queries)
    rows = inverted.lists(chunks, key, content)
    few = F.broadcast(terms) if terms.count() <= inverted.FEW_TERMS else terms
    held = cut(rows.join(few.select(F.col("term").alias("_term")), F.col("term") == F.col("_term"), "left").where("_term IS NOT NULL OR term IS NULL").drop("_term"))
    return inverted.best(cut, held, q, terms, key, k)


def write_index(chunks: DataFrame, key: str, content: str, path: str, buckets: int = 64) -> None:
    """Writes the index of a chunk table: inverted lists by hash of the term (bucket -1: keys
    and lengths of the chunks), and the two totals BM25 needs."""
    at = F.when(F.col("term").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    inverted.lists(chunks, key, content).withColumn("bucket", at).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    docs = chunks.sparkSession.read.parquet(f"{path}/postings").where("bucket = -1")
    sums = docs.select("n", F.aggregate("tfs", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("_dl")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("_dl").alias("_dl"))
    sums.select("n", (F.col("_dl") / F.nullif("n", F.lit(0))).alias("avg_dl"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/totals")


def _buckets(stored: DataFrame, terms: DataFrame, buckets: int) -> DataFrame:
    """The part of a written index that has the terms (term), and the rows of its chunks."""
    own = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()]
    return stored.where(F.col("bucket").isin([-1, *own])).drop("bucket")


def query_index(spark, path: str, key: str, queries: DataFrame) -> DataFrame:
    """``bm25`` over a written index: only the buckets of the queries' terms are read."""
    totals = spark.read.parquet(f"{path}/totals").first()
    q = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query_text")))).alias("term"))
    held = _buckets(spark.read.parquet(f"{path}/postings"), q.select("term"), totals["buckets"])
    docs = held.where("term IS NULL").select("part", F.posexplode(F.arrays_zip(F.col("keys").alias("key"), F.col("tfs").alias("dl"))).alias("num", "_d"))
    df = held.groupBy("term").agg(F.sum("n").alias("df"))
    found = held.join(q, "term").join(df, "term").select("query_id", "part", "df", F.explode(F.arrays_zip(F.col("nums").alias("num"), F.col("tfs").alias("tf"))).alias("_p"))
    found = found.select("query_id", "part", "df", "_p.num", "_p.tf").join(docs.select("part", "num", F.col("_d.key").alias(key), F.col("_d.dl").alias("dl")), ["part", "num"])
    idf = F.log(1 + (F.lit(totals["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(totals["avg_dl"])))
    return found.groupBy("query_id", key).agg(F.round(F.sum(gain), 6).alias("score"))


def best_indexed(spark, path: str, key: str, queries: DataFrame, k: int) -> DataFrame:
    """``best`` over a written index: only the buckets of the queries' terms are read."""
    cut = Cut(spark, "search")
    q, terms = inverted.asked(cut, queries)
    held = _buckets(spark.read.parquet(f"{path}/postings"), terms, spark.read.parquet(f"{path}/totals").first()["buckets"])
    return inverted.best(cut, held, q, terms, key, k)

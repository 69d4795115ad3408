import pytest
from pyspark.sql import functions as F

from ravelin.operators import incremental as inc

LIST = "path string, size long, checksum string, change string, batch_id string"


def listing(spark, rows):
    return spark.createDataFrame([(p, n, c, "x", "y") for p, n, c in rows], LIST)


def process(df):
    return df.select("path", "checksum", F.col("change").alias("why"))


def test_each_record_once_however_runs_fail(spark, tmp_path):
    runs = inc.Incremental(spark, f"file://{tmp_path}")
    first = listing(spark, [("a", 1, "1"), ("b", 2, "2")])
    with pytest.raises(RuntimeError):
        runs.run(first, process, fail_before_commit=True)
    assert runs.manifest().count() == 0
    assert runs.run(first, process) == "00000000"
    assert runs.run(first, process) is None
    second = listing(spark, [("a", 1, "1"), ("b", 2, "9"), ("c", 3, None)])
    with pytest.raises(RuntimeError):
        runs.run(second, process, fail_before_commit=True)
    assert runs.run(second, process) == "00000001"
    out = sorted((r["path"], r["why"]) for r in runs.output().collect())
    assert out == [("a", "added"), ("b", "added"), ("b", "changed"), ("c", "added")]
    assert runs.run(second, process) is None


def test_a_listing_that_grows_while_a_run_works(spark, tmp_path):
    runs = inc.Incremental(spark, f"file://{tmp_path}/state")
    at = f"{tmp_path}/list"
    listing(spark, [("a", 1, "1")]).write.parquet(f"{at}/1")

    def grows(df):
        out = df.select("path")
        listing(spark, [("b", 1, "2")]).write.parquet(f"{at}/2")
        return out

    runs.run(spark.read.schema(LIST).parquet(f"{at}/*"), grows)
    assert [r["path"] for r in runs.manifest().collect()] == [r["path"] for r in runs.output().collect()] == ["a"]
    assert runs.run(spark.read.schema(LIST).parquet(f"{at}/*"), process) == "00000001"
    assert sorted(r["path"] for r in runs.output().select("path").collect()) == ["a", "b"]


def test_of_two_runs_at_a_time_one_commits(spark, tmp_path):
    runs = inc.Incremental(spark, f"file://{tmp_path}")

    def other(df):
        assert inc.Incremental(spark, f"file://{tmp_path}").run(listing(spark, [("a", 1, "1")]), process) == "00000000"
        return process(df)

    with pytest.raises(inc.Conflict):
        runs.run(listing(spark, [("a", 1, "1")]), other)
    assert runs.output().count() == 1 and runs.run(listing(spark, [("a", 1, "1")]), process) is None


def test_sizes_count_where_both_are_known(spark, tmp_path):
    runs = inc.Incremental(spark, f"file://{tmp_path}")
    runs.adopt(spark.createDataFrame([("a", None, "1"), ("b", 2, "1")], "path string, size long, checksum string"))
    assert runs.run(listing(spark, [("a", 1, "1"), ("b", 3, "1")]), process) == "00000001"
    assert [r["path"] for r in runs.output().collect()] == ["b"]


def test_runs_and_their_rows(spark):
    runs = spark.sql(
        """SELECT * FROM VALUES (1, TIMESTAMP '2031-01-01 10:00:00', TIMESTAMP '2031-01-01 11:00:00', 'ok'), (2, TIMESTAMP '2031-01-02 10:00:00', NULL, 'OK '),
        (3, TIMESTAMP '2031-01-03 10:00:00', TIMESTAMP '2031-01-03 11:00:00', 'failed'), (4, TIMESTAMP '2031-01-04 23:00:00', TIMESTAMP '2031-01-05 01:00:00', 'ok') AS t(run_id, started_at, finished_at, status)"""
    )
    rows = spark.sql(
        """SELECT * FROM VALUES (1, TIMESTAMP '2031-01-01 10:00:00'), (2, TIMESTAMP '2031-01-01 11:00:01'), (3, TIMESTAMP '2031-01-03 09:59:59'), (4, TIMESTAMP '2031-01-03 10:30:00'),
        (5, TIMESTAMP '2031-01-05 00:30:00'), (6, NULL) AS t(n, at)"""
    )
    got = sorted((r["n"], r["run_id"]) for r in inc.rows_of_runs(rows, "at", runs).collect())
    assert got == [(1, 1), (3, 2), (5, 4)]


def test_newest_ties_and_empty(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z"), ("b", None, None)], "k string, at int, v string")
    assert {r["k"]: r["v"] for r in inc.newest(df, "k", ["at"]).collect()} == {"a": "y", "b": None}
    assert inc.newest(df.limit(0), "k", ["at"]).count() == 0


def test_digest_spelling(spark):
    h = "AB" * 32
    df = spark.createDataFrame([(f"sha256:{h} ",), (h.lower(),), (None,)], "h string")
    assert [r[0] for r in df.select(inc.hex_digest(F.col("h"))).collect()] == [h.lower(), h.lower(), None]


def test_stream_drives_runs(spark, tmp_path):
    from ravelin.streaming.incremental import follow

    schema = "path string, size long, checksum string, seen_at long"
    spark.createDataFrame([("a", 1, "1", 1), ("a", 1, "2", 2), ("b", 1, "3", 1)], schema).write.parquet(f"{tmp_path}/in/1")
    for _ in range(2):
        follow(spark, f"{tmp_path}/in/*", schema, f"file://{tmp_path}/state", lambda d: d.select("path", "checksum"), f"{tmp_path}/cp").awaitTermination()
    got = sorted(tuple(r)[:2] for r in inc.Incremental(spark, f"file://{tmp_path}/state").output().select("path", "checksum").collect())
    assert got == [("a", "2"), ("b", "3")]

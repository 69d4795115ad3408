"""Searches of many queries at once: right results, and no row for each query and chunk."""

import random

import pytest
from pyspark.sql import functions as F

from ravelin.operators import inverted, search
from ravelin.plans import core_text


@pytest.fixture
def folder(spark, tmp_path):
    """1,500 chunks that all hold the words of 40 logged searches; only stated tables are broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    n = spark.range(1500)
    n.select(F.col("id").alias("slice_id"), F.lit("p").alias("package"), F.concat_ws(" ", F.lit("alpha beta gamma"), F.repeat(F.lit("beta "), (F.col("id") % 7).cast("int"))).alias("content")).write.parquet(f"{tmp_path}/doc_slices.parquet")
    spark.range(40).select((F.col("id") * 20).alias("result_id"), F.concat(F.lit("alpha beta gamma w"), F.col("id")).alias("query_text")).write.parquet(f"{tmp_path}/search_results.parquet")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(spark, run) -> int:
    """Rows written to shuffles while ``run`` ran."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        got = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (got.apply(i) for i in range(got.size()))}

    before = stages()
    run()
    return sum(n for at, n in stages().items() if at not in before)


@pytest.mark.parametrize("query", [core_text.docs_bm25_log, core_text.docs_bm25_index])
def test_log_has_no_row_for_each_query_and_chunk(spark, folder, query):
    got = []
    assert shuffled(spark, lambda: got.extend(query(spark, folder).collect())) < 20_000
    assert len(got) == 120 and {r["slice_id"] for r in got} == {1, 8, 15}


def test_index_answers_every_logged_search(spark, folder):
    spark.read.parquet(f"{folder}/search_results.parquet").selectExpr("result_id + 7 AS result_id", "query_text").write.mode("append").parquet(f"{folder}/search_results.parquet")
    got = core_text.docs_bm25_index(spark, folder).collect()
    assert {r["query_id"] for r in got} == {i * 20 + x for i in range(40) for x in (0, 7)} and len(got) == 240


@pytest.mark.parametrize("block, tokens, chunks", [(16_384, 3_000_000, 1 << 17), (128, 500, 200)])
def test_best_are_those_of_all_scores(spark, monkeypatch, block, tokens, chunks):
    monkeypatch.setattr(inverted, "BLOCK", block)
    monkeypatch.setattr(inverted, "PART_TOKENS", tokens)
    monkeypatch.setattr(inverted, "CELL_CHUNKS", chunks)
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(words if r.random() < 0.7 else words[:5]) for _ in range(r.choice([0, 3, 9, 60]))) for _ in range(700)]
    # Equal texts under other keys tie; repeated rows count once.
    rows = [*enumerate(texts), *[(1000 + i, texts[i]) for i in range(200)], *[(i, texts[i]) for i in range(50)], (5000, None)]
    d = spark.createDataFrame(rows, "id long, t string")
    q = spark.createDataFrame([(i, " ".join(r.choices([*words, "absent"], k=r.choice([0, 1, 2, 3, 8])))) for i in range(150)], "query_id int, query_text string")
    every = search.bm25(d.dropDuplicates(["id"]), "id", "t", q)
    want = search.top(every, 3, ["query_id"], [F.desc("score"), "id"]).select("query_id", "id", "score", "rank")
    assert sorted(map(tuple, search.best(d, "id", "t", q, 3).collect())) == sorted(map(tuple, want.collect()))


def test_best_of_nothing(spark):
    d = spark.createDataFrame([(1, "red")], "id int, t string")
    q = spark.createDataFrame([(1, "blue"), (2, None)], "query_id int, query_text string")
    assert search.best(d, "id", "t", q, 3).count() == 0
    assert search.best(d.limit(0), "id", "t", q, 3).count() == 0
    # Two texts under one id are one query, whose words count once.
    q = spark.createDataFrame([(1, "red x"), (1, "red y")], "query_id int, query_text string")
    assert [tuple(r) for r in search.best(d, "id", "t", q, 3).collect()] == [(1, 1, 0.287682, 1)]

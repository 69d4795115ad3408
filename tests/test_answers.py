from ravelin.operators import answers


def test_evidence_and_checks(spark):
    m = spark.createDataFrame([("s", 1, "call", "c1", "read", '{"a":1}', None), ("s", 2, "tool", "c1", None, None, "def f():\n    return 1"), ("s", 3, "tool", "zz", None, None, "x" * 5000), ("t", 1, "user", None, None, None, "hi")], "session string, seq int, role string, call_id string, tool string, arguments string, content string")
    e = answers.evidence(m)
    got = {r["seq"]: (r["tool"], r["arguments"], len(r["text"])) for r in e.collect()}
    assert got == {2: ("read", '{"a":1}', 21), 3: ("tool", "{}", 4000)}
    f = spark.createDataFrame([("s", 1, "def f():\n  return   1"), ("s", 2, "def g():\n  return 2"), ("s", 3, "}"), ("none", 4, "def f():")], "session string, finding int, snippet string")
    assert {r["finding"]: r["verified"] for r in answers.verify_findings(f, e).collect()} == {1: True, 2: False, 3: None, 4: None}


def test_budget_skips_and_goes_on(spark):
    b = spark.createDataFrame([("q", 1, "a" * 6), ("q", 2, "é" * 4), ("q", 3, "b" * 3), ("q", 4, None)], "g string, pos int, body string")
    assert {r["pos"]: r["taken"] for r in answers.within_budget(b, "g", "pos", most=10).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_rejoin_uses_equal_keys_up(spark):
    r = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "rank int, name string")
    n = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "z")], "id string, name string")
    assert sorted((x["rank"], x["id"]) for x in answers.rejoin(r, n, "name").collect()) == [(1, "a"), (2, "b")]


def test_greedy_pool_and_envelope(spark):
    rows = [("q", n, "p" if n < 6 else "o", "code", 1.0 - n / 100, n % 2 == 0) for n in range(12)]
    d = spark.createDataFrame(rows, "query string, seq long, package string, origin string, rrf double, from_original boolean")
    got = [r["seq"] for r in answers.greedy_pool(d, "query", 9, 0.34).orderBy("pool_rank").collect()]
    assert got == [0, 1, 2, 6, 7, 8]
    assert '"seq":0' in answers.envelope(d).first()[0]

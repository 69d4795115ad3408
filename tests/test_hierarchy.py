import random

from ravelin.operators import hierarchy, skew


def brute(links):
    out = {}
    for n in links:
        seen, x, d = [n], links[n], 1
        while x in links and x not in seen:
            seen.append(x)
            x, d = links[x], d + 1
        if x in links:
            ring = seen[seen.index(x) :]
            out[n] = (min(ring), -1)
        else:
            out[n] = (x, d)
    return out


def edges(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, kind string, node string, parent string, _rkey string")


def test_random_forests_and_circles(spark):
    rnd = random.Random(5)
    links = {f"n{i}": f"n{rnd.randint(0, 400)}" for i in range(300)}
    links |= {f"c{i}": f"c{i - 1}" for i in range(1, 70)}
    rows = [(p, n, rnd.choice(["contains", " Contains", "CONTAINS "]), "x", "y", "z") for n, p in links.items()]
    got = hierarchy.resolve(spark, hierarchy.parent_links(edges(spark, rows + rows[:20])))
    assert {r["node"]: (r["root"], r["depth"]) for r in got.collect()} == brute(links)


def test_paths_and_descendants(spark):
    rows = [(a, b, "contains", None, None, None) for a, b in [("r", "a"), ("a", "b"), ("b", "c"), ("x", "x"), ("p", "q"), ("q", "p"), ("q", "t")]]
    p = hierarchy.paths(spark, hierarchy.parent_links(edges(spark, rows)))
    assert {r["node"]: r["path"] for r in p.collect()} == {"a": ["r", "a"], "b": ["r", "a", "b"], "c": ["r", "a", "b", "c"]}
    d = {(r["ancestor"], r["descendant"], r["distance"]) for r in hierarchy.descendants(p).collect()}
    assert d == {("r", "a", 1), ("r", "b", 2), ("a", "b", 1), ("r", "c", 3), ("a", "c", 2), ("b", "c", 1)}


def test_nulls_other_kinds_and_empty(spark):
    rows = [(None, "a", "contains", None, None, None), ("a", None, "contains", None, None, None), ("a", "b", "calls", None, None, None), ("a", "b", None, None, None, None)]
    assert hierarchy.resolve(spark, hierarchy.parent_links(edges(spark, rows))).count() == 0
    assert hierarchy.paths(spark, hierarchy.parent_links(edges(spark, []))).count() == 0


def test_several_parents_take_the_least(spark):
    rows = [("z", "n", "contains", None, None, None), ("b", "n", "contains", None, None, None)]
    assert hierarchy.resolve(spark, hierarchy.parent_links(edges(spark, rows))).collect()[0]["root"] == "b"


def test_hot_parent_is_salted(spark):
    left = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k")
    right = left.selectExpr("k").distinct().selectExpr("k AS rk", "length(k) AS n")
    got = skew.lookup_join(left, right, "k", "rk", least=100, salts=8)
    assert got.count() == 3000 and skew.hot_keys(left, "k", least=100)[0] == "hot"
    assert got.columns == ["id", "k", "n"]


def test_links_to_further_parents_are_reported(spark):
    e = spark.createDataFrame([("a", "x", "contains"), ("b", "x", "CONTAINS "), ("a", "y", "contains"), ("c", "x", "calls"), (None, "x", "contains"), ("b", "x", "contains")], "source string, target string, kind string")
    assert [tuple(r) for r in hierarchy.dropped_links(e).collect()] == [("x", "b", "a")]

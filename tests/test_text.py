from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin import models
from ravelin.functions import text
from ravelin.operators import chunking, fusion, search, vector

TEXT = st.text(alphabet=st.sampled_from("ab cé\n\n.,字"), max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(5, 60))
def test_paragraph_chunks_are_exact_parts(t, most):
    raw = t.encode()
    at = 0
    for c, a, z, lo, hi in chunking.paragraphs(t, most):
        assert raw[lo:hi].decode() == c and lo >= at and a == raw.count(b"\n", 0, lo) + 1 and z >= a
        assert hi - lo <= most or len(c) == 1
        at = hi
    kept = "".join(c for c, *_ in chunking.paragraphs(t, most))
    assert [x for x in t if not x.isspace()] == [x for x in kept if not x.isspace()]


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_windows_cover_the_text(t):
    w = chunking.windows(t, 60, 30)
    assert w[0] == t[: len(w[0])] and t.endswith(w[-1])
    if len(t.encode()) <= 60:
        assert w == [t]


def test_assembly():
    a = chunking.assemble
    assert a([(1, 2, "a\nb"), (2, 3, "b\nc"), (2, 2, "b"), (6, 6, "f")]) == "a\nb\nc\n\n… 2 line(s) omitted …\n\nf"
    assert a([]) == "" and a([(1, 1, "x" * 50)], 20).startswith("x" * 20 + "\n…")


def test_bm25_by_hand(spark):
    d = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, None), (4, "")], "id int, t string")
    q = spark.createDataFrame([(7, "red"), (8, "absent"), (9, "")], "query_id int, query_text string")
    got = search.bm25(d, "id", "t", q).collect()
    from math import log

    idf = log(1 + (4 - 1 + 0.5) / 1.5)
    want = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 1.25))
    assert [(r["query_id"], r["id"], r["score"]) for r in got] == [(7, 1, round(want, 6))]


def test_column_functions(spark):
    df = spark.createDataFrame([("How does the Parser_x parse a parser_x of é12",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.significant(F.col("t"))).collect()] == [["parser_x", "parse", "é12"], [], []]
    v = spark.createDataFrame([("best practices for", "parse header"), ("header parsing", "parse header"), ("abc", "parse"), (None, "x"), ("cold header", "how to")], "v string, o string")
    assert [r[0] for r in v.select(text.acceptable_variant(F.col("v"), F.col("o"))).collect()][:3] == [False, True, False]
    assert text.expand_braces("*.{md,txt}") == ["*.md", "*.txt"]
    ln = spark.createDataFrame([("a\r\nb\n",), ("a\n\n",), ("",)], "t string").select(text.lines(F.col("t"))).collect()
    assert [r[0] for r in ln] == [["a", "b"], ["a", ""], [""]]


def test_nearest_matches_brute_force(spark):
    import numpy as np

    m = np.random.default_rng(1).standard_normal((60, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(60, [0.0] * 8), (61, None), (62, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.where("vec_id < 4").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vector.nearest(df, q, 3, block=3).collect()}
    u = m.astype("float32").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in range(4):
        s = u @ u[i]
        s[i] = -9
        assert [got[i, k] for k in (1, 2, 3)] == list(np.argsort(-s)[:3])
    assert vector.nearest(df, q.limit(0), 3).count() == 0


HIT = "seq long, package string, origin string, path string, start_line int, end_line int, snippet string, symbol string, kind string, signature string, rrf double, from_original boolean"


def test_fusion_sums_and_keeps_the_richest(spark):
    rows = [
        (1, "p", "graph", "A\\b.py", 5, 9, "s", "x", None, None, 0.1, False), (2, "p", "code", "a/b.py", 5, 9, "longer", "xx", "function", "(a)", 0.2, True),
        (3, "p", "docs", "d.md", 0, 0, "t", None, None, None, 0.3, True), (4, "p", "docs", "d.md", 0, 0, "t", None, None, None, 0.1, False), (5, None, "docs", None, None, None, None, None, None, None, 0.1, False),
    ]
    f = {r["seq"]: r for r in fusion.fuse(spark.createDataFrame(rows, HIT)).collect()}
    assert f[1]["rrf"] == 0.3 and f[1]["origin"] == "code" and f[1]["symbol"] == "xx" and f[1]["from_original"] and f[1]["signature"] == "(a)"
    assert f[3]["rrf"] == 0.4 and f[3]["hits"] == 2 and len(f) == 3


def test_islands(spark):
    rows = [("p", "D.md", "docs", 1, 5, 3, 0.1), ("p", "d.md", "docs", 8, 9, 1, 0.2), ("p", "d.md", "docs", 13, 14, 2, 0.9), ("p", "d.md", "docs", 0, 0, 4, 0.5), ("p", "x.py", "code", 1, 2, 5, 0.1), ("p", "x.py", "code", 6, 7, 6, 0.1)]
    got = fusion.islands(spark.createDataFrame(rows, "package string, path string, origin string, start_line int, end_line int, position int, score double")).collect()
    assert {(r["path"], r["start_line"], r["end_line"], r["position"], r["score"], r["merged_count"]) for r in got} == {("d.md", 1, 9, 1, 0.2, 2), ("d.md", 13, 14, 2, 0.9, 1), ("d.md", 0, 0, 4, 0.5, 1), ("x.py", 1, 7, 5, 0.1, 2)}


def test_models():
    assert models.parse_variants("<think>no</think>\n- lex: a b\n2. vec: c\na b\nfree") == [("lex", "a b"), ("vec", "c"), ("lex", "free")]
    assert models.LexicalScorer().rank("red blue", ["red", "blue red", ""])[0] == (1, 1.0)
    assert abs(sum(x * x for x in models.HashEmbedder().embed_query("a b c")) - 1) < 1e-9 and models.HashEmbedder().embed_query("") == [0.0] * 64
    assert models.yes_probability(0.0, 0.0) == 0.5

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import docpairs, leakage, markup, mixing, pagediff, splitting, stuffing

NODE = "id string, package string, kind string, name string, file_path string, start_line int, docstring string, signature string, updated_at long, weight string, _key string"


@pytest.mark.parametrize(
    ("doc", "name", "sig", "want"),
    [
        ("Loads the cache.", "load_cache", "(digest)", False), ("Match budget. Ties are broken by name.", "match_budget", "()", True), ("", "f", None, False), (None, "f", None, False), ("TODO", "f", "()", False),
        ("TODO: speed this up. Equal keys are merged.", "f", "()", True), ("TODO: speed this up.", "f", "()", False), ("{@inheritDoc}", "f", "()", False), ("@param a\n@return", "f", "(a)", False),
        ("Args:\n    a: the wide one to use\nReturns:", "f", "(a)", False), ("/**\n * Panics on overflow.\n */", "visitArena", "()", True), ('"""pylint: disable=invalid-name"""', "f", "()", False),
        ("Liefert den Wert ohne doppelte Einträge.", "f", "()", True), ("Keine Beschreibung.", "f", "()", False), ("SPDX-License-Identifier: MIT", "f", "()", False), ("<summary></summary>", "f", "()", False),
        ("Compresses matcher", "compressMatcher", "()", False), ("INDEX_SLOT", "index_slot", "()", False), ("合并相同的键", "f", "()", True), ("* * *", "f", "()", False), (":param grid:\n:type grid: int", "f", "(long grid)", False),
    ],
)
def test_informative(doc, name, sig, want):
    assert docpairs.informative(docpairs.parse(doc)[0], name, docpairs.parameters(sig)) is want


def test_pairs_keep_the_newest_and_assign_once(spark):
    rows = [
        ("a", "p", "function", "load", "f", 1, "old text here", "(x)", 1, None, None), ("a", "p", "function", "load", "f", 1, "Reads the table twice.", "(x)", 2, None, None), ("a", "p", "function", "load", "f", 1, "Reads the table twice.", "(x)", 2, None, None),
        ("b", "p", "method", "save", "f", 9, " ", None, 1, None, None), ("c", "p", "class", "K", "f", 20, "Holds things together.", None, 1, None, None), ("d", None, "function", None, None, None, "Works on a copy.", None, None, None, None), (None, "p", "function", "x", "f", 3, "Lost.", "()", 1, None, None),
    ]
    got = {r["id"]: r for r in docpairs.links(spark.createDataFrame(rows, NODE)).collect()}
    assert set(got) == {"a", "d"} and got["a"]["description"] == "Reads the table twice." and got["a"]["comment_id"] == "a" and got["d"]["informative"]
    assert docpairs.links(spark.createDataFrame([], NODE)).count() == 0


def test_assignment_is_the_heaviest():
    def brute(options, i=0, used=frozenset()):
        if i == len(options):
            return 0.0
        return max([brute(options, i + 1, used), *(x + brute(options, i + 1, used | {j}) for j, x in options[i] if j not in used)])

    rnd = random.Random(3)
    for _ in range(400):
        m = rnd.randint(1, 6)
        o = [[(j, rnd.choice([0.25, 0.33, 1.0, 1.3, rnd.random() + 0.01])) for j in rnd.sample(range(m), rnd.randint(0, min(m, 4)))] for _ in range(rnd.randint(1, 6))]
        got = docpairs.assign(o)
        taken = [j for j in got if j is not None]
        assert len(taken) == len(set(taken))
        assert abs(sum(dict(o[k])[j] for k, j in enumerate(got) if j is not None) - brute(o)) < 1e-9


def test_displaced_comments_go_where_their_tags_point(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("bcdfghjklmnp") + rnd.choice("aeiou") for _ in range(3))
    rows, want = [], {}
    for f in range(12):
        n = 9
        names, params = [word() + word().title() for _ in range(n)], [(word(), word()) for _ in range(n)]
        docs = [f"Sorts the rows of {names[k]} by age.\n\n@param {params[k][0]} first\n@param {params[k][1]} second" for k in range(n)]
        # Every comment of the odd files stands one symbol too low, the last one first.
        order = [(k - 1) % n if f % 2 and k else n - 1 if f % 2 else k for k in range(n)]
        # Lines on both sides of a block's edge.
        for k in range(n):
            rows.append((f"{f}.{k}", "p", "function", names[k], f"p/{f}.py", 4_060 + 9 * k, docs[order[k]], f"({params[k][0]}: int, {params[k][1]}: int)", 1, None, None))
            if order[k] != n - 1 or k == n - 1:
                want[f"{f}.{order[k]}"] = f"{f}.{k}"
    got = {r["id"]: r["comment_id"] for r in docpairs.links(spark.createDataFrame(rows, NODE)).collect()}
    assert {k: v for k, v in got.items() if k in want} == want


def test_many_symbols_on_one_line(spark, monkeypatch):
    monkeypatch.setattr(docpairs, "HELD", 40)
    monkeypatch.setattr(docpairs, "MARGIN", 8)
    rows = [(f"{k:04d}", "p", "method", f"name{k}", "p/a.js", 1, f"Keeps what the cache of {k} would lose.", "(a)", 1, None, None) for k in range(300)]
    rows += [(f"x{k}", "p", "method", f"name{k}", "p/a.js", None, "Keeps what others lose.", None, 1, None, None) for k in range(5)]
    got = docpairs.links(spark.createDataFrame(rows, NODE)).collect()
    assert len(got) == 305 and all(r["id"] == r["comment_id"] for r in got)


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet=st.sampled_from("abc d.\n字é"), max_size=1200), st.integers(60, 200), st.integers(5, 25))
def test_pieces_cover_and_overlap(t, size, overlap):
    p = splitting.pieces(t, size, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(t) and all(len(c) <= size and c == t[a:z] for a, z, c in p)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(p, p[1:]))
    assert (len(p) > 1) == (len(t) > size)


def test_pieces_end_at_topic_changes():
    one, two = "The cat sat on the mat with a cat. " * 20, "Rockets burn fuel and rockets fly high. " * 20
    p = splitting.pieces(one + "\n\n" + two, 1000, 50)
    assert p[0][1] in (len(one) + 2, len(one)) or p[0][2].endswith(". ")


def test_split_nulls_and_repeats(spark):
    rows = [("doc", 1, "x" * 4000, "a"), ("doc", 1, "x" * 4000, "a"), ("doc", 2, None, "a"), ("symbol", 2, "", "a"), (None, None, "short", "a")]
    df = spark.createDataFrame(rows, "item_kind string, item_id long, content string, piece string")
    got = splitting.split(df).distinct().collect()
    assert sorted((r["item_kind"] or "", r["item_id"] or 0, r["n_pieces"]) for r in got) == [("", 0, 1), ("doc", 1, 3), ("doc", 1, 3), ("doc", 1, 3), ("symbol", 2, 1)]


@pytest.mark.parametrize(
    ("t", "want"),
    [
        ("Use queue[i][j] and fn(window) -> anchor; the arrow => is only for a * b * c.", []), ("The type is Vec<label> or Map<String, List<canvas>>.", []), ("Write to C:\\temp\\walker or C:\\new\\cache", []), ("It costs $5 per grid and $12 per mask", []),
        ("kept when 207 < size && size > 3, R&D (see [121]) a == b ~799 kB a_b_c _d", []), ("x <b>y</b>", ["html"]), ("a &lt;b&gt;", ["html"]), ("# Head\n", ["markdown"]), ("Head\n====\n", ["markdown"]), ("see [a](b.md)", ["markdown"]), ("**x**", ["markdown"]), ("`x`", ["markdown"]),
        ("```\n\\section{Demo}\n```", ["markdown"]), ("[[a|b]]", ["wiki"]), ("''x''", ["wiki"]), ("{{t|a=b}}", ["wiki"]), ("== H ==", ["wiki"]), ("{| class=\"t\"\n! a\n|-\n| b\n|}", ["wiki"]), ("\\textbf{x}", ["latex"]), ("so $x_{6}^2$ is", ["latex"]), ("\\begin{verbatim}\n<b>\n\\end{verbatim}", ["latex"]),
        ("a link [the bri", ["markdown"]), ("and <a href=\"/x", ["html"]), ("then [[tra", ["wiki"]), ("Use queue[i][j]", []), (None, []), ("", []), ("1) a\n2) b", []), ("<pre><code>x = [[a]]</code></pre>", ["html"]), ("> Quoted words.", ["markdown"]), ("| a | b |\n|---|---|\n| c | 1 |", ["markdown"]),
    ],
)
def test_markup_kinds(t, want):
    assert markup.kinds(t) == want
    assert t is None or markup.kinds(t.replace("\n", "\r\n")) == want


def test_clean_text_keeps_structure():
    src = "<h2>Title</h2>\n<ul><li>one</li><li>two &amp; three</li></ul>\n\n**bold** [link](x.md) ''it''\n\n\\section{Sec}\n$x_{1}^2$ and \\emph{word}\n\n```\n<b>code</b>\n```\n\n| a | b |\n|---|---|\n| c | d |\n<table><tr><td>e</td><td>f</td></tr></table>"
    out = markup.clean(src)
    for part in ("## Title", "- one", "- two & three", "bold link it", "# Sec", "$x_{1}^2$ and word", "```\n<b>code</b>\n```", "a | b", "c | d", "e | f"):
        assert part in out, (part, out)
    assert markup.clean(None) is None and markup.clean("plain a * b text") == "plain a * b text"
    assert markup.kinds(out.replace("# ", "").replace("```", "")) in ([], ["html"], ["latex"], ["html", "latex"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abc"), max_size=24), min_size=1, max_size=4), st.integers(2, 6))
def test_longest_repeats(pages, times):
    if not any(pages):
        return
    codes = np.array([ord(c) - 96 for p in pages for c in p])
    got = stuffing.longest(*stuffing.suffixes(codes, np.repeat(np.arange(len(pages)), [len(p) for p in pages])), times).tolist()
    want = [max((n for n in range(1, len(p) - i + 1) if sum(p.startswith(p[i : i + n], j) for j in range(len(p))) >= times), default=0) for p in pages for i in range(len(p))]
    assert got == want


def test_keywords_within_other_words_are_repeats():
    rnd = random.Random(2)
    part = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(2))
    pile = " ".join(part()[:2] + "kettle" if k % 2 else "kettle" + part() for k in range(60))
    w, piled, chars = stuffing.measure(pile)
    assert piled == w == 60 and chars >= 60 * len("kettle")
    mixed = " ".join(part() + part() + part() for _ in range(60))
    assert stuffing.measure(mixed)[1] == 0


def test_stuffed_pages(spark):
    prose = "When the server starts with an empty cache, every reader keeps its own copy until the writer is done. Nobody may close the outer window while the inner ones still hold a lock. After the upgrade nothing can open the old ledger, so please do not remove it yet."
    pile = ", ".join(["cheap tool", "fast tool", "best reader", "free ledger"] * 8)
    rows = [(1, prose), (2, pile), (3, "#a1 " * 0 + " ".join(f"#tag{w}" for w in "abcdefghijklmnop")), (4, "\n".join(f"word{i} page - https://x{i}.invalid/a/{i}" for i in range(9))), (5, "Reading list\n" + "\n".join(["- https://x.example/kettle : This page explains why water has to boil before it is poured.", "- https://x.example/lantern : How the old lamps were lit, and by whom they were kept.", "- https://x.example/mirror : Whatever stands before glass is also seen behind it."]))]
    rows += [(6, None), (7, ""), (8, "def f(a, b):\n    return a + b\n" * 9), (9, prose + "\n\nTags: a, b, c, d"), (10, "buy mesh mesh online mymesh mesh 2031 " * 9), (2, pile)]
    got = {r["doc_id"]: r["stuffed"] for r in stuffing.pages(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, words int")).collect()}
    assert {k for k, v in got.items() if v} == {2, 3, 4, 10}
    assert stuffing.pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_leaks_match_brute_force(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(60))) for i in range(20)] + [(20, "too short"), (21, None)]
    docs = []
    for n in range(150):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))]
        if n % 3 == 0:
            src = items[rnd.randrange(20)][1].split()
            a, k = rnd.randrange(40), rnd.choice([11, 12, 13, 14, 20])
            w[len(w) // 2 : len(w) // 2] = src[a : a + k]
        t = " ".join(w)
        docs.append((n, t.upper() if n % 2 else t.replace("w", "ｗ").replace(" ", "​ ")))
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    want = set()
    for d, t in docs:
        w = leakage.words(t)
        have = {tuple(w[a : a + 13]) for a in range(len(w) - 12)}
        for i, x in items:
            y = leakage.words(x)
            if any(tuple(y[a : a + 13]) in have for a in range(len(y) - 12)):
                want.add((d, i))
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, words string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(spark, df, it, exact_only=True).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    kinds = {r["kind"] for r in leakage.leaks(spark, df, it).collect()}
    assert "exact" in kinds
    assert leakage.leaks(spark, df.limit(0), it).count() == 0
    assert leakage.leaks(spark, df.limit(5), it.limit(0)).count() == 0


def test_exact_leaks_do_not_depend_on_the_directions(spark):
    rnd = random.Random(3)
    word = lambda: f"x{rnd.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(60))) for i in range(10)]
    docs = [(n, " ".join([word() for _ in range(40)] + items[n % 10][1].split()[n % 40 : n % 40 + 13] + [word() for _ in range(40)])) for n in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    for near in (leakage.CANDIDATE, 1.1):
        assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(spark, df, it, near=near, exact_only=True).collect()} == {(n, n % 10) for n in range(80)}
    tok = leakage.tokens(df)
    q = leakage.directions(spark, tok, np.ones(leakage.DIMENSIONS, dtype=np.float32))
    seen = {x & (leakage.DIMENSIONS - 1) for r in tok.collect() for x in r["words"]}
    assert set(np.flatnonzero(np.abs(q).sum(axis=1) > 0).tolist()) >= seen


def test_paraphrase_behind_a_nearer_passage():
    rnd = random.Random(11)
    text = rnd.sample(range(1, 20_000), 26)
    # The same words in another order, then the item with every fifth word replaced.
    near, true = text[::-1], [x if k % 5 else 20_000 + k for k, x in enumerate(text)]
    table = np.random.default_rng(1).standard_normal((leakage.DIMENSIONS, leakage.RANK)).astype(np.float32)
    flat = np.array(near + true, dtype=np.int32)
    it = leakage.Items([7], [text], table, frozenset(text[1:2]))
    rows = leakage._search(table, it, np.array([3]), np.array([0, len(flat)]), flat, leakage.CANDIDATE, False)
    assert [(r[0], r[1], r[5]) for r in rows] == [(3, 7, "paraphrase")] and rows[0][4] >= leakage.PARAPHRASE and rows[0][2] < 0.99


def test_lcs():
    assert leakage.lcs(list("abcde"), list("xaxcxe")) == 3 and leakage.lcs([], [1]) == 0


def test_mixture_meets_targets(spark):
    rnd = random.Random(3)
    rows = [(i, "a" if i % 3 else ("B_x " if i % 2 else "b-x"), rnd.randint(1, 40), round(rnd.uniform(0.05, 1), 3)) for i in range(3000)] + [(5000, None, 10, 1.0), (5001, "zz", 10, 1.0), (5002, "a", 0, 1.0)]
    from pyspark.sql import functions as F

    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long, quality double").withColumn("source", mixing.source_label(F.col("source")))
    targets = spark.createDataFrame([("A", 0.3, 1), ("b x", 0.6, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(sized, targets)
    got = m.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and max(r["copies"] for r in got if r["source"] == "a") <= 1 and max(r["copies"] for r in got) <= 3
    s = {r["source"]: r for r in mixing.shares(sized, targets, m).collect()}
    assert abs(s["a"]["actual_share"] - 1 / 3) < 0.01 and abs(s["b-x"]["actual_share"] - 2 / 3) < 0.01 and s["none"]["actual_share"] == 0
    for k in ("a", "b-x"):
        assert 0 <= s[k]["budget"] - s[k]["used_tokens"] < 40
    assert mixing.mix(sized.limit(0), targets).count() == 0


def test_token_sizes_are_the_tokenizers(spark):
    df = spark.createDataFrame([(1, "X", "hello world <|endoftext|>", "t"), (2, None, None, "t"), (3, "x", "", "t")], "doc_id long, source string, text string, tokens string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.sizes(df).collect()}
    assert got == {1: len(mixing.tokenizer(None).encode_ordinary("hello world <|endoftext|>")), 2: 0, 3: 0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", " "]), max_size=9), st.lists(st.sampled_from(["a", "b", "c", " "]), max_size=9))
def test_page_alignment_is_a_longest_common_subsequence(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y and x.strip() else max(d[i][j + 1], d[i + 1][j])
    c = sorted(pagediff.common(a, b))
    rest = iter(a)
    assert len(c) == d[-1][-1] and all(b[k] in rest for k in c)


def test_page_differencing(spark):
    rows = [("h", "h/docs/a.md", 1, "top\none\nend"), ("h", "h/docs/b.md", 2, "top\ntwo\nend"), ("g", "g/docs/c.md", 3, "top\nthree\nend"), ("h", "h/docs/d.md", 4, None), (None, None, 5, "top")]
    p = spark.createDataFrame(rows, "host string, path string, item_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one range
    assert {r["item_id"]: (r["lines"], r["shared"]) for r in pagediff.shared_lines(p).collect()} == {1: (3, 0), 2: (3, 2), 3: (3, 0), 4: (0, 0), 5: (1, 0)}
    assert {r["item_id"]: r["text"] for r in pagediff.without_shared(p.coalesce(1)).collect()}[2] == "two"
    assert pagediff.shared_lines(p.limit(0)).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_page_differencing_does_not_depend_on_ranges(spark):
    rows = [(("g", "h", None)[n % 3], f"{n:03d}", n, None if n % 7 == 3 else f"top\n{n}\nend") for n in range(90)]
    p = spark.createDataFrame(rows, "host string, path string, item_id long, text string").repartition(6)
    first = {min(r[2] for r in rows if r[0] == h and r[3]) for h in "gh"}
    want = {i: 0 if t is None or h is None or i in first else 2 for h, _, i, t in rows}
    for n, adaptive in ((1, "true"), (7, "false"), (40, "false")):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        got = [(r["item_id"], r["shared"]) for r in pagediff.shared_lines(p).collect()]
        assert len(got) == 90 and dict(got) == want
        assert sum(r["text"] == str(r["item_id"]) for r in pagediff.without_shared(p).collect()) == sum(v == 2 for v in want.values())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_product_listings_are_stuffed():
    line = "LAYER-{0} silent cursor tags: reader, mirror, scope, worker only {0}.99\n"
    w, piled, _ = stuffing.measure("".join(line.format(k) for k in range(20, 32)))
    assert piled == w

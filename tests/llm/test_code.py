import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import authorship, grammar, syntax, validity

GOOD = {
    "python": '@cached\ndef f(a, *b, c=1, **d):\n    """Doc."""\n    # <<< not a mark\n    x = [i for i in range(3) if i]\n    if a:\n        return {1: 2, **d}\n    elif b: pass\n    else:\n        y = (1,\n             2)\n    try:\n        pass\n    except ValueError as e:\n        raise\n    finally:\n        pass\n\nclass A(B):\n    z: int = 3\n    async def g(self): return await self.h()\n',
    "ruby": 'require "set"\nclass A < B\n  def f(x, y = 1)\n    return x if y > 2\n    x.each do |i|\n      puts i\n    end\n    z = [\n      1,\n      2\n    ]\n  end\nend\n',
    "rust": 'use std::collections::{HashMap, HashSet};\n#[derive(Debug)]\npub struct A { x: i64 }\nimpl A {\n    pub fn f(&self, v: &mut Vec<i64>) -> Option<i64> {\n        let mut s = 0;\n        for i in 0..10 { s += i; }\n        if s > 3 { return None; } else if s == 1 { s = 2; }\n        match s { 0 => None, _ => Some(s) }\n    }\n}\n',
    "javascript": 'const a = require("./a");\n//\nfunction f(x, y = 2) {\n  for (let i = 0; i < x; i++) { a.b(i); }\n  return x ? y : { k: [1, 2], f() { return 1; } };\n}\nclass A extends B {\n  g(x) { return (y) => y + x; }\n}\nmodule.exports = [["a", 1],];\n(()=>{if(a>b){c=[1,2]}d&&(d.e=function(p){return!p});var q=void 0})();\n',
    "typescript": 'import { a } from "./a";\nexport interface I { x: number; y?: string }\nexport class A implements I {\n  x: number = 1;\n  f(a: number, b: string[]): Promise<number> {\n    const c: any[] = [];\n    return a as any;\n  }\n}\nexport const rows: any[] = [\n  1, 2\n];\nexport * from "./b";\n',
    "java": 'package a.b;\n\nimport java.util.List;\n\n/** Doc. */\npublic class A extends B {\n    private final long x = 1;\n    public long f(long a, List<String> b) throws E {\n        for (long i = 0; i < a; i++) { long c = g(i); }\n        if (a > 1) { return x; } else { return (long) a; }\n    }\n}\n',
    "go": 'package a\n\nimport "fmt"\n\ntype A struct {\n\tsize int64\n}\n\n//\nfunc (x *A) f(a int64, b string) (int64, error) {\n\tc := a * 2\n\tfor i := int64(0); i < c; i++ {\n\t\tfmt.Println(i)\n\t}\n\tif c > 2 {\n\t\treturn c, nil\n\t}\n\treturn 0, nil\n}\n',
    "c": '#include <stdio.h>\n#define N 3\nstatic const unsigned char rows[] = {\n    1, 2,\n};\nlong f(long a, const char *b) {\n    for (long i = 0; i < a; i++) { a = a + i; }\n    const char *s = "it is [open";\n    return a > 2 ? a : -a;\n}\n',
    "cpp": '#include <vector>\nclass A {\npublic:\n    long f(long a) const {\n        for (long i = 0; i < a; ++i) { a += i; }\n        return a;\n    }\n};\nstatic const std::initializer_list<Cell> rows = {\n    "a", 1,\n};\n',
    "csharp": "using System;\nusing System.Linq;\n\npublic class A {\n    public long F(long a) {\n        string s = \"x => y\";\n        foreach (var i in s) { a++; }\n        return a;\n    }\n}\n",
    "php": "<?php\n\nnamespace App\\a;\n\nclass A {\n    public function f($a, $b = 1) {\n        for ($i = 0; $i < $a; $i++) { $b = g($i); }\n        return [1, 'k' => 2];\n    }\n}\n",
    "kotlin": "package a.b\n\nimport kotlin.math.max\n\nclass A {\n    fun f(a: Long): Long {\n        for (i in 0 until a) {\n            var b = i + a\n        }\n        if (a > 1) {\n            return a\n        }\n        val s = \"x\"\n        return a\n    }\n}\n",
    "swift": "import Foundation\n\nclass A {\n    func f(a: Int, b: Int) -> Int {\n        for i in 0..<(a) {\n            var c = i + a\n        }\n        if a > b {\n            return a\n        }\n        let s = \"x\"\n        return b\n    }\n}\n",
    "scala": "package a.b\n\nimport scala.collection.mutable\n\nobject A {\n    def f(a: Long): Long = {\n        for (i <- 0 until a) {\n            var b = i + a\n        }\n        if (a > 1) {\n            return a\n        }\n        return a\n    }\n}\n",
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_accepts_its_language(lang):
    t = GOOD[lang]
    assert syntax.faults(lang, t) == [], syntax.located(lang, t, syntax.faults(lang, t))
    assert syntax.faults(lang, t, memo=False) == []
    assert syntax.faults(lang, t.replace("\n", "\r\n")) == []
    assert syntax.faults(lang, "") == (syntax.faults(lang, ""))


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_rejects_damage_and_other_languages(lang):
    t = GOOD[lang]
    for bad in (t + "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> other\n", '[cell archive]\nport.a = early query\n', "<!DOCTYPE html>\n<html><body>\n", "#!/bin/sh\nif [ -f a ]; then b --c \"$1\"; fi\n", "2031-04-16 00:56 WARN x y failed [72]\n"):
        assert syntax.faults(lang, bad), bad
    for cut in (0.5, 0.7):
        half = t[: int(len(t) * cut)]
        if lang not in ("python", "ruby", "javascript", "typescript"):
            assert syntax.faults(lang, half) or half.count("{") == half.count("}")
    for other in ("rust", "java", "python", "php"):
        if other != lang:
            assert syntax.faults(lang, GOOD[other]), other


def test_memo_and_whole_parse_agree_on_damaged_texts():
    rnd = random.Random(2)
    for lang, t in GOOD.items():
        for _ in range(40):
            lines = t.split("\n")
            for _ in range(rnd.randint(1, 2)):
                k = rnd.randrange(len(lines))
                lines[k : k + 1] = rnd.choice([[], [lines[k], lines[k]], [lines[k][: len(lines[k]) // 2]]])
            s = "\n".join(lines)
            assert bool(syntax.faults(lang, s)) == bool(syntax.faults(lang, s, memo=False)), (lang, s)


def test_panic_mode_keeps_all_errors_with_lines():
    t = "long f(long a) {\n    long = 3;\n    a = a + ;\n    return a;\n}\n"
    e = syntax.located("c", t, syntax.faults("c", t))
    assert [n for n, _ in e][:2] == [2, 3]


def scans(spark, rows):
    return spark.createDataFrame([(p, f, s, r, c, "x") for p, f, s, r, c in rows], "package string, path string, seen_at string, received_at string, content string, errors string").withColumn("seen_at", F.to_timestamp("seen_at")).withColumn("received_at", F.to_timestamp("received_at"))


D1, D2 = "2031-01-01 00:00:00", "2031-01-02 00:00:00"


def test_verdicts_follow_the_newest_text(spark):
    rows = [("p", "p/a.c", D1, D2, "broken("), ("p", "p/a.c", D2, D1, "long a;"), ("p", "p/b.c", D2, D1, "broken("), ("p", "p/b.c", D2, D1, "broken("), ("p", "p/gone.c", D2, D2, None), ("p", "p/x.weird", D1, D1, "?"), (None, "p/e.rs", D1, D1, ""), ("p", None, D1, D1, "x")]
    v = {r["path"]: r for r in validity.verdicts(scans(spark, rows)).collect()}
    assert v["p/a.c"]["n_errors"] == 0 and v["p/b.c"]["n_errors"] > 0 and "p/gone.c" not in v and v["p/x.weird"]["language"] is None and v["p/e.rs"]["n_errors"] == 0
    r = {(x["package"], x["language"]): (x["files"], x["invalid"]) for x in validity.rates(validity.verdicts(scans(spark, rows))).collect()}
    assert r[("p", "c")] == (2, 1) and r[(None, None)] == (3, 1)
    assert validity.verdicts(scans(spark, [])).count() == 0


def slow_repair(seq, least=3):
    seq, rules, nxt = list(seq), 0, 10**6
    while True:
        count = {}
        for p in zip(seq, seq[1:]):
            count[p] = count.get(p, 0) + 1
        if not count or max(count.values()) < least:
            return len(seq), rules
        best = max(count, key=count.get)
        out, i = [], 0
        while i < len(seq):
            if tuple(seq[i : i + 2]) == best:
                out.append(nxt)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq, rules, nxt = out, rules + 1, nxt + 1


def test_grammars_are_about_as_small_as_step_by_step():
    rnd = np.random.default_rng(4)
    cases = [np.tile(rnd.integers(0, 9, 12), 30), rnd.integers(0, 200, 600), np.zeros(50, dtype=int), np.array([], dtype=int), np.array([1])]
    left, rules, _ = grammar.grammars(cases)
    alone = [grammar.grammars([c]) for c in cases]
    for c, n, r, (an, ar, _) in zip(cases, left, rules, alone):
        sn, sr = slow_repair(c)
        assert (n, r) == (an[0], ar[0])
        assert n + 2 * r <= 1.6 * (sn + 2 * sr) + 8


def test_authorship(spark):
    body = "def {0}_one(a, b):\n    for i in range(a):\n        acc = i + b\n    return a + b * 2 - acc_{0}\n\ndef {0}_two(c):\n    if c > 3:\n        return other_{0}(c)\n    return c * c + 17 - {0}\n"
    words = "alpha beta gamma delta kappa sigma omega theta".split()
    gen = "".join(f"def get_field_v{i}(raw):\n    return raw + {i}\n\n" for i in range(40))
    rnd = random.Random(1)
    blob = "DATA = [\n" + "".join('    "' + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(70)) + '",\n' for _ in range(20)) + "]\n"
    mini = "var a=1;" + "".join(f"function f{i}(b,c){{return b*c+{i}}}if(a>{i}){{d=[{i},2]}}x.y{i}=void 0;" for i in range(20))
    rows = [("p", f"p/{w}.py", D1, D1, body.format(w)) for w in words]
    rows += [("p", "p/lib/copy.py", D1, D1, body.format("shared")), ("q", "q/src/same.py", D1, D1, "# other\n" + body.format("shared")), ("p", "p/gen.py", D1, D1, gen), ("p", "p/blob.py", D1, D1, blob), ("p", "p/m.js", D1, D1, mini)]
    rows += [("p", "p/said.py", D1, D1, "# Code generated by tool from x.def; DO NOT EDIT.\n" + body.format("said")), ("p", "p/only.py", D1, D1, "# Finds files whose first line says DO NOT EDIT and skips them.\n" + body.format("only"))]
    rows += [("p", "p/log.py", D1, D1, "".join(f"2031-04-16 00:{i:02d} WARN disk failed [{i}]\n" for i in range(40))), ("p", "p/empty.py", D1, D1, ""), ("p", "p/gone.py", D1, D1, None)]
    got = {r["path"]: {k for k in ("generated", "blob", "minified", "vendored") if r[k]} for r in authorship.classify(spark, scans(spark, rows)).collect()}
    assert got["p/lib/copy.py"] == got["q/src/same.py"] == {"vendored"}
    assert "generated" in got["p/gen.py"] and "generated" in got["p/said.py"] and "blob" in got["p/blob.py"] and "minified" in got["p/m.js"]
    assert all(not got[f"p/{w}.py"] for w in words) and not got["p/only.py"] and not got["p/log.py"] and not got["p/empty.py"] and "p/gone.py" not in got
    assert authorship.classify(spark, scans(spark, [])).count() == 0


def test_grammar_of_a_file_does_not_depend_on_its_batch(monkeypatch):
    rnd = np.random.default_rng(6)
    cases = [np.tile(rnd.integers(0, 30, 40), 6) for _ in range(30)]
    whole = grammar.grammars(cases)
    monkeypatch.setattr(grammar, "GROUP", 500)
    parts = grammar.grammars(cases)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_phrases_are_shared_by_equal_stretches():
    rnd = np.random.default_rng(8)
    hashes = list(range(1, 400))
    common = rnd.integers(3, 390, 600)
    a, b, c = np.concatenate([rnd.integers(3, 390, 50), common]), np.concatenate([common, rnd.integers(3, 390, 70)]), rnd.integers(3, 390, 600)
    edited = common.copy()
    edited[::150] = 395
    (na, nb, nc, ne), (sa, _, _, se) = grammar.phrases([a, b, c, edited], hashes)
    assert sum(sa) == 650 and sum(se) == 600
    share = lambda x, y, z: sum(n for r, n in zip(x, z) if r in set(y)) / sum(z)
    assert share(na, nb, sa) > 0.75 and share(na, nc, sa) == 0 and share(ne, na, se) > 0.6
    # Line breaks do not count, and no phrase spans two files.
    broken = np.insert(common, range(0, 600, 9), grammar.BREAK)
    assert grammar.phrases([broken], hashes)[0] == grammar.phrases([common], hashes)[0]


def test_copies_with_a_few_edits_are_vendored(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    funcs = [f"def {word()}({word()}, {word()}):\n    {word()} = {word()}({word()}) + {word()}[{word()}]\n    if {word()} > {word()}:\n        return {word()} * {word()}\n    return {word()}.{word()}({word()})\n" for _ in range(20)]
    mine = ["\n".join(f"def {word()}({word()}):\n    return {word()} + {word()}.{word()}\n" for _ in range(20)) for _ in range(2)]
    copy = "".join(f.replace("return", "yield", 1) if k % 5 == 0 else f + "\n\n" for k, f in enumerate(funcs))
    rows = [("p", "p/a.py", D1, D1, "\n".join(funcs)), ("q", "q/b.py", D1, D1, copy), ("p", "p/c.py", D1, D1, mine[0]), ("q", "q/d.py", D1, D1, mine[1])]
    got = {r["path"]: r["vendored"] for r in authorship.classify(spark, scans(spark, rows)).collect()}
    assert got == {"p/a.py": True, "q/b.py": True, "p/c.py": False, "q/d.py": False}


def test_large_blob_is_found(spark):
    rnd = random.Random(5)
    text = 'DATA = "' + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000)) + '"\n' + "".join(f"def f{i}(a):\n    return DATA[a + {i}]\n" for i in range(30))
    scans = spark.createDataFrame([("p", "p/d.py", text)], "package string, path string, content string").select("*", F.current_timestamp().alias("seen_at"), F.current_timestamp().alias("received_at"))
    assert authorship.classify(spark, scans).first()["blob"]


@pytest.mark.parametrize("lang", ["javascript", "python"])
def test_all_errors_of_a_long_text_are_kept(lang):
    good, bad = ("a = 1;\n", "a = + ;\n") if lang == "javascript" else ("a = 1\n", "a = +\n")
    t = (good + bad) * 300
    assert [n for n, _ in syntax.located(lang, t, syntax.faults(lang, t))] == list(range(2, 601, 2))
    if lang == "javascript":
        assert len(syntax.faults(lang, "}\n" * 300)) == 300


def test_any_depth_of_nesting_is_parsed():
    from ravelin.llm import syntax

    n = 5_000
    assert not syntax.faults("javascript", "x = " + "(" * n + "1" + ")" * n + ";\n")
    assert not syntax.faults("python", "x = " + "[" * n + "1" + "]" * n + "\n")
    assert syntax.faults("javascript", "x = " + "(" * n + "1" + ")" * (n - 1) + ";\n")

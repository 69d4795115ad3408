"""Queries of the ranking pipeline over the logged hits, and the flagship search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.operators import chunking, fusion, graph, pipeline
from ravelin.plans.core_graph import _N
from ravelin.session import Cut
from ravelin.functions import text
from ravelin.sources.tables import load

FLAGSHIP = "parse the frozen header and lock the socket"
WORD = "ledger"
VARIANTS = [("lex", "frozen header parser"), ("hyde", "a socket is locked"), ("lex", "socket lock")]


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The logged hits as ranked lists: per query and backend, in order of result_id."""
    h = load(spark, d, "search_results").dropDuplicates(["result_id"])
    origin = F.when(F.col("symbol").isNull(), "docs").when(F.col("kind") == "method", "graph").otherwise("code")
    w = Window.partitionBy("query_text", "package", "origin").orderBy("result_id")
    h = h.withColumn("origin", origin).withColumn("rank", F.row_number().over(w)).withColumnRenamed("result_id", "seq")
    original = F.col("seq") % 3 != 0
    return h.withColumn("from_original", original).withColumn("rrf", fusion.rrf(F.col("rank"), F.when(original, 2.0).otherwise(1.0)))


def _fused(spark, d):
    return fusion.fuse(_hits(spark, d), ["query_text"])


def rrf_ranks(spark, d):
    return _hits(spark, d).select("seq", "rank", F.round("rrf", 9).alias("rrf"))


def rrf_fusion(spark, d):
    """Results of every query with summed scores and the richest hit's fields."""
    return _fused(spark, d).select("query_text", "seq", "package", "path", "rrf", "hits", "from_original", "origin", "start_line", "symbol", "kind")


def topical_anchor(spark, d):
    return fusion.anchor(_fused(spark, d), 0.5, ["query_text"]).select("query_text", "seq", "rrf")


def diversity_pool(spark, d):
    return fusion.pool(_fused(spark, d), 20, ["query_text"]).select("query_text", "seq", "pool_rank")


def _pool(spark, d):
    p = fusion.pool(_fused(spark, d), 20, ["query_text"])
    return fusion.first_pass(p, F.col("query_text"))


def small_to_big(spark, d):
    """Code hits with the stored body of their symbol."""
    code = load(spark, d, "symbol_sources").select("package", "path", "symbol", "start_line", "content").distinct()
    e = fusion.expand(_pool(spark, d), code)
    return e.select("query_text", "seq", F.length("body").alias("body_chars"))


def first_pass(spark, d):
    return _pool(spark, d).select("query_text", "seq", "pass1")


def two_pass_rank(spark, d):
    """Two passes of the lexical scorer; the second looks at windows of the bodies."""
    code = load(spark, d, "symbol_sources").select("package", "path", "symbol", "start_line", "content").distinct()
    e = fusion.expand(_pool(spark, d), code).withColumn("_b", F.coalesce("body", "snippet"))
    w = chunking.kwic(e, ["query_text", "key"], "_b")
    out = fusion.two_passes(e, w, F.col("query_text"), 10, ["query_text"])
    return fusion.above_floor(out).select("query_text", "seq", "position", "score", "promoted", "best_window")


def merge_adjacent(spark, d):
    """Neighbouring hits of one document, over all logged hits of a package."""
    h = _hits(spark, d).withColumn("position", F.col("seq")).withColumn("score", F.round("rrf", 9))
    out = fusion.islands(h.select("package", "path", "origin", "start_line", "end_line", "position", "score"))
    return out.select("package", "path", "is_docs", "start_line", "end_line", "position", "score", "merged_count")


def hybrid_interleave(spark, d):
    h = _hits(spark, d)
    w = Window.partitionBy("query_text").orderBy("seq")
    code = h.where("origin <> 'docs'").withColumn("rank", F.row_number().over(w)).select("query_text", "seq", "rank")
    docs = h.where("origin = 'docs'").withColumn("rank", F.row_number().over(w)).select("query_text", "seq", "rank")
    return fusion.interleave(code, docs, 10, ["query_text"]).select("query_text", "seq", "side", "position")


def hybrid_diversify(spark, d):
    h = _hits(spark, d).withColumn("position", F.row_number().over(Window.partitionBy("query_text").orderBy("seq")))
    return fusion.diversify(h.select("query_text", "seq", "origin", "position"), 5, ["query_text"]).select("query_text", "seq", "place")


def run_statistics(spark, d):
    """Hits per package and backend."""
    return _hits(spark, d).groupBy("package", "origin").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("query_text").alias("queries"))


def tables(spark: SparkSession, d: str) -> pipeline.Tables:
    """The tables a search looks at; nodes with their tokens, written once."""
    cut = Cut(spark, "tables")
    nodes = cut(graph.indexed(graph.current_nodes(load(spark, d, "nodes")).select(*_NODE)))
    docs = load(spark, d, "doc_slices").select("slice_id", "package", "path", "content", "start_line", "end_line")
    code = load(spark, d, "symbol_sources").select("symbol_id", "package", "path", "symbol", "kind", "signature", "content", "start_line", "end_line")
    return pipeline.Tables(docs, code, nodes)


_NODE = ["id", "name", "qualified_name", "kind", "package", "file_path", "start_line", "end_line", "docstring", "signature"]


def flagship(spark: SparkSession, d: str, query: str = FLAGSHIP, limit: int = 10) -> DataFrame:
    """The whole search: every package's documents, code and symbols by the query, fused,
    pooled, expanded, ranked in two passes, merged and cut to ``limit``."""
    return pipeline.search_all(spark, tables(spark, d), query, limit)


def flagship_word(spark, d):
    """The search for one word, which names of symbols hold."""
    return flagship(spark, d, WORD)


def flagship_variants(spark, d):
    """The search with variants: their hits add to scores, packages are anchored."""
    return pipeline.search_all(spark, tables(spark, d), FLAGSHIP, variants=VARIANTS)


def flagship_unranked(spark, d):
    """The search without a scorer: the order of fused scores, in one package."""
    return pipeline.search_all(spark, tables(spark, d), FLAGSHIP, scope="LoomWork", settings=pipeline.Settings(rerank=False))


_QUERIES = [rrf_ranks, rrf_fusion, topical_anchor, diversity_pool, first_pass, small_to_big, two_pass_rank, merge_adjacent, hybrid_interleave, hybrid_diversify, run_statistics, flagship, flagship_word, flagship_variants, flagship_unranked]


def queries():
    return {f.__name__: f for f in _QUERIES}


_T = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
_H = """h AS (SELECT *, row_number() OVER (PARTITION BY query_text, package, origin ORDER BY seq) AS rank, seq % 3 <> 0 AS from_original FROM (
SELECT DISTINCT result_id AS seq, query_text, package, path, snippet, start_line, end_line, symbol, kind, signature, CASE WHEN symbol IS NULL THEN 'docs' WHEN kind = 'method' THEN 'graph' ELSE 'code' END AS origin FROM search_results)),
r AS (SELECT *, (CASE WHEN from_original THEN 2.0 ELSE 1.0 END)::DOUBLE / (60 + rank) AS rrf FROM h)"""
_FUSED = """, kk AS (SELECT *, CASE WHEN origin = 'docs' THEN concat_ws(':', package, lower(replace(path, '\\', '/')), sha256(coalesce(snippet, ''))) WHEN start_line > 0 THEN concat_ws(':', package, lower(replace(path, '\\', '/')), start_line::VARCHAR)
  WHEN coalesce(symbol, '') <> '' THEN concat_ws(':', package, lower(replace(path, '\\', '/')), lower(symbol)) ELSE concat_ws(':', package, lower(replace(path, '\\', '/'))) END AS key,
  CASE origin WHEN 'code' THEN 2 WHEN 'graph' THEN 1 ELSE 0 END AS prio FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY query_text, key ORDER BY prio DESC, strlen(coalesce(snippet, '')) DESC, seq) AS rn FROM kk),
f AS (SELECT query_text, key, round(sum(rrf), 9) AS rrf, bool_or(from_original) AS from_original, min(seq) AS seq, count(*) AS hits, max(CASE WHEN rn = 1 THEN origin END) AS origin, max(CASE WHEN rn = 1 THEN package END) AS package,
  max(CASE WHEN rn = 1 THEN path END) AS path, max(CASE WHEN rn = 1 THEN start_line END) AS start_line, max(CASE WHEN rn = 1 THEN end_line END) AS end_line, max(CASE WHEN rn = 1 THEN snippet END) AS snippet,
  arg_max(symbol, strlen(symbol) * 1000000000 - seq) FILTER (coalesce(symbol, '') <> '') AS symbol, arg_min(kind, seq) FILTER (coalesce(kind, '') <> '') AS kind FROM b GROUP BY query_text, key)"""
_F = _H + _FUSED
_POOL = """, pb AS (SELECT *, row_number() OVER (PARTITION BY query_text, package, origin ORDER BY rrf DESC, seq) AS bk FROM f WHERE from_original),
p AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_text ORDER BY rrf DESC, seq) AS INTEGER) AS pool_rank FROM pb WHERE bk <= 6) WHERE pool_rank <= 20)"""
_P = _F + _POOL
#: Bodies and first scores of a pool, windows of long bodies, and the order of two passes.
_TWO = """, code AS (SELECT DISTINCT package, path, symbol, start_line, content FROM symbol_sources), at_ AS (SELECT package, path, start_line, max(content) AS c1 FROM code GROUP BY ALL),
nm AS (SELECT package, symbol, max(content) AS c2 FROM code GROUP BY ALL HAVING count(DISTINCT (path, start_line)) = 1),
ex AS (SELECT p.*, {share_head} AS pass1, coalesce(CASE WHEN origin <> 'docs' AND strlen(coalesce(c1, c2)) > strlen(coalesce(snippet, '')) THEN coalesce(c1, c2) END, snippet) AS bt
  FROM {pool} p LEFT JOIN at_ USING (package, path, start_line) LEFT JOIN nm ON nm.package = p.package AND nm.symbol = p.symbol),
ls AS (SELECT query_text, key, bt, strlen(bt) AS total, unnest(string_split(bt, chr(10))) AS ln, generate_subscripts(string_split(bt, chr(10)), 1) AS i FROM ex WHERE bt IS NOT NULL),
le AS (SELECT query_text, key, total, ln, i, least(total, sum(strlen(ln) + 1) OVER (PARTITION BY query_text, key ORDER BY i)) AS e FROM ls),
lb AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY query_text, key ORDER BY i), 0) AS s FROM le),
tr AS (SELECT a.query_text, a.key, a.s, a.total, coalesce(min(CASE WHEN b.e > a.s + 1500 THEN b.e END), a.total) AS stop, coalesce(min(CASE WHEN b.e > a.s + 750 THEN b.e END), a.total) AS nxt
  FROM lb a JOIN lb b ON a.query_text = b.query_text AND a.key = b.key WHERE a.total > 1500 GROUP BY a.query_text, a.key, a.s, a.total),
wn AS (SELECT query_text, key, 0 AS idx, 0::HUGEINT AS s FROM lb WHERE i = 1 UNION ALL
  SELECT w.query_text, w.key, w.idx + 1, t.nxt FROM wn w JOIN tr t ON t.query_text = w.query_text AND t.key = w.key AND t.s = w.s WHERE t.stop < t.total AND t.nxt > w.s),
wt AS (SELECT w.query_text, w.key, w.idx, string_agg(l.ln, chr(10) ORDER BY l.i) AS win FROM wn w LEFT JOIN tr t ON t.query_text = w.query_text AND t.key = w.key AND t.s = w.s
  JOIN lb l ON l.query_text = w.query_text AND l.key = w.key AND l.s >= w.s AND l.e <= coalesce(t.stop, l.total) GROUP BY ALL),
ws AS (SELECT query_text, key, idx, {share_win} AS sc FROM wt),
bw AS (SELECT query_text, key, max(sc) AS pass2, arg_min(idx, -sc * 1000000 + idx * 0.0001) AS best_window FROM ws GROUP BY ALL),
r1 AS (SELECT ex.*, pass2, best_window, row_number() OVER (PARTITION BY query_text ORDER BY pass1 DESC, seq) AS rank1 FROM ex LEFT JOIN bw USING (query_text, key)),
r2 AS (SELECT *, rank1 <= 10 AS promoted, CASE WHEN rank1 <= 10 THEN coalesce(pass2, pass1) ELSE pass1 END AS score FROM r1),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_text ORDER BY promoted DESC, score DESC, rank1) AS INTEGER) AS position FROM r2)"""
_ISLANDS = """, x AS (SELECT package, lower(replace(path, '\\', '/')) AS path, origin = 'docs' AS is_docs, start_line, end_line, position, score FROM {ranked}),
y AS (SELECT *, max(end_line) OVER (PARTITION BY package, path, is_docs ORDER BY start_line, end_line, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM x WHERE start_line > 0),
z AS (SELECT *, sum(CASE WHEN pm IS NULL OR start_line > pm + 1 + CASE WHEN is_docs THEN 2 ELSE 3 END THEN 1 ELSE 0 END) OVER (PARTITION BY package, path, is_docs ORDER BY start_line, end_line, position) AS isl FROM y),
m AS (SELECT package, path, is_docs, min(start_line) AS start_line, max(end_line) AS end_line, min(position) AS position, max(score) AS score, count(*) AS merged_count FROM z GROUP BY package, path, is_docs, isl
UNION ALL SELECT package, path, is_docs, coalesce(start_line, 0), coalesce(end_line, 0), position, score, 1 FROM x WHERE NOT start_line > 0 OR start_line IS NULL)
SELECT position, package, path, is_docs, start_line, end_line, score, merged_count FROM m ORDER BY position LIMIT 10"""


def _share(candidate: str) -> str:
    q, c = _T.format("query_text"), _T.format(candidate)
    return f"CASE WHEN len(list_distinct({q})) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct({q}), list_distinct({c}))) / len(list_distinct({q})), 6) END"


def _ranked(pool: str = "p") -> str:
    head = "concat_ws(' ', kind, CASE WHEN coalesce(p.symbol, '') <> '' THEN p.symbol || ':' END, snippet)"
    return _TWO.format(share_head=_share(head), share_win=_share("win"), pool=pool)


def _lexical(name: str, table: str, key: str, where: str) -> str:
    return f"""{name}_t AS (SELECT *, {_T.format('content')} AS toks FROM (SELECT DISTINCT * FROM {table}) {where}),
{name}_s AS (SELECT package, count(*) AS n, avg(len(toks)) AS av FROM {name}_t GROUP BY package),
{name}_p AS (SELECT package, {key} AS id, dl, term, count(*) AS tf FROM (SELECT package, {key}, len(toks) AS dl, unnest(toks) AS term FROM {name}_t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
{name}_d AS (SELECT package, term, count(*) AS df FROM {name}_p GROUP BY ALL),
{name}_g AS (SELECT run, package, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM {name}_p JOIN {name}_d USING (package, term) JOIN {name}_s USING (package) JOIN q USING (term) GROUP BY ALL),
{name}_r AS (SELECT * FROM (SELECT run, package, id, row_number() OVER (PARTITION BY run, package ORDER BY score DESC, id) AS rank FROM {name}_g) WHERE rank <= 20)"""


def _search(query: str, variants=(), scope: str | None = None, rerank: bool = True) -> str:
    """The whole search in SQL."""
    runs = pipeline.plan(query, list(variants))
    lex = [r for r in runs if r.lexical]
    pairs = ", ".join(f"({r.number}, '{t}')" for r in lex for t in pipeline._terms(r.words))
    words = ", ".join(f"({r.number}, '{r.words}', '{text.phrase_needle(r.words)}')" for r in lex)
    weights = ", ".join(f"({r.number}, {r.weight})" for r in runs)
    where = f"WHERE lower(package) = '{scope.lower()}'" if scope else ""
    field = "regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g'), '^ *(.*?) *$', ' \\1 ')"
    texts = [field.format(c) for c in graph.PHRASE_FIELDS]
    tf = " + ".join(f"(length({t}) - length(replace({t}, needle, ''))) // length(needle)" for t in texts)
    dl = " + ".join(f"len(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+'))" for c in graph.PHRASE_FIELDS)
    anchored = """, st AS (SELECT package, sum(CASE WHEN from_original THEN rrf ELSE 0.0 END) AS strength FROM f0 GROUP BY package),
f AS (SELECT f0.* EXCLUDE (rrf), round(rrf * (0.5 + 0.5 * CASE WHEN tp > 0 THEN strength / tp ELSE 0.0 END), 9) AS rrf FROM f0 JOIN st USING (package), (SELECT max(strength) AS tp FROM st))"""
    fused = _FUSED.replace("f AS (SELECT query_text, key, round(sum", "f0 AS (SELECT query_text, key, round(sum") + anchored if variants else _FUSED
    tail = _ranked() + _ISLANDS.format(ranked="(SELECT * FROM rk WHERE score >= 0.1)") if rerank else _ISLANDS.format(ranked="(SELECT *, pool_rank AS position, rrf AS score FROM p)")
    return f"""WITH RECURSIVE q(run, term) AS (VALUES {pairs}), wd(run, words, needle) AS (VALUES {words}), wg(run, w) AS (VALUES {weights}),
{_lexical('code', 'symbol_sources', 'symbol_id', where)},
{_lexical('docs', 'doc_slices', 'slice_id', where)},
{_N.replace('n AS (', 'n0 AS (', 1)}, n AS (SELECT * FROM n0 {where}),
nt AS (SELECT run, words, n.*, {dl} AS dl, {tf} AS tf FROM n, wd),
ns AS (SELECT run, package, count(*) AS cnt, avg(dl) AS av, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) AS df FROM nt GROUP BY ALL),
gs AS (SELECT nt.*, CASE WHEN tf > 0 THEN round(ln(1 + (cnt - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)), 6) ELSE 0.0 END AS score FROM nt JOIN ns USING (run, package)
  WHERE tf > 0 OR (df = 0 AND (contains(lower(name), lower(words)) OR contains(lower(qualified_name), lower(words))))),
gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, package ORDER BY score DESC, end_line - start_line NULLS FIRST, qualified_name, id) AS rank FROM gs) WHERE rank <= 20),
u AS (SELECT run, t.package, rank, 0 AS backend, path, start_line, end_line, substring(content, 1, 600) AS snippet, symbol, kind, signature, 'code' AS origin FROM code_r JOIN code_t t ON t.symbol_id = code_r.id
UNION ALL SELECT run, t.package, rank, 2, path, start_line, end_line, substring(content, 1, 400), NULL, NULL, NULL, 'docs' FROM docs_r JOIN docs_t t ON t.slice_id = docs_r.id
UNION ALL SELECT run, package, rank, 4, file_path, start_line, end_line, coalesce(signature, concat_ws(' ', kind, name)), qualified_name, kind, signature, 'graph' FROM gr),
pn AS (SELECT package, row_number() OVER (ORDER BY package) AS pno FROM (SELECT DISTINCT package FROM u)),
r AS (SELECT '{query}' AS query_text, u.*, ((run * 1000000 + pno) * 10 + backend) * 10000 + rank AS seq, run = 0 AS from_original, w::DOUBLE / (60 + rank) AS rrf FROM u JOIN pn USING (package) JOIN wg USING (run))
{fused}{_POOL}{tail}"""




def oracle():
    q = _T.format("query_text")
    cand = _T.format("concat_ws(' ', kind, CASE WHEN coalesce(symbol, '') <> '' THEN symbol || ':' END, snippet)")
    share = f"CASE WHEN len(list_distinct({q})) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct({q}), list_distinct({cand}))) / len(list_distinct({q})), 6) END"
    return {
        "rrf_ranks": f"WITH {_H} SELECT seq, CAST(rank AS INTEGER) AS rank, round(rrf, 9) AS rrf FROM r",
        "rrf_fusion": f"WITH {_F} SELECT query_text, seq, package, path, rrf, hits, from_original, origin, start_line, symbol, kind FROM f",
        "topical_anchor": f"""WITH {_F}, s AS (SELECT *, sum(CASE WHEN from_original THEN rrf ELSE 0.0 END) OVER (PARTITION BY query_text, package) AS st FROM f), t AS (SELECT *, max(st) OVER (PARTITION BY query_text) AS tp FROM s)
SELECT query_text, seq, round(rrf * (0.5 + 0.5 * CASE WHEN tp > 0 THEN st / tp ELSE 0.0 END), 9) AS rrf FROM t""",
        "diversity_pool": f"WITH {_P} SELECT query_text, seq, pool_rank FROM p",
        "first_pass": f"WITH {_P} SELECT query_text, seq, {share} AS pass1 FROM p",
        "small_to_big": f"""WITH {_P}, code AS (SELECT DISTINCT package, path, symbol, start_line, content FROM symbol_sources), at_ AS (SELECT package, path, start_line, max(content) AS c1 FROM code GROUP BY ALL),
nm AS (SELECT package, symbol, max(content) AS c2 FROM code GROUP BY ALL HAVING count(DISTINCT (path, start_line)) = 1)
SELECT query_text, seq, length(CASE WHEN origin <> 'docs' AND strlen(coalesce(c1, c2)) > strlen(coalesce(snippet, '')) THEN coalesce(c1, c2) END)::INTEGER AS body_chars FROM p LEFT JOIN at_ USING (package, path, start_line) LEFT JOIN nm ON nm.package = p.package AND nm.symbol = p.symbol""",
        "merge_adjacent": f"""WITH {_H}, x AS (SELECT package, lower(replace(path, '\\', '/')) AS path, origin = 'docs' AS is_docs, start_line, end_line, seq AS position, round(rrf, 9) AS score FROM r),
y AS (SELECT *, max(end_line) OVER (PARTITION BY package, path, is_docs ORDER BY start_line, end_line, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM x WHERE start_line > 0),
z AS (SELECT *, sum(CASE WHEN pm IS NULL OR start_line > pm + 1 + CASE WHEN is_docs THEN 2 ELSE 3 END THEN 1 ELSE 0 END) OVER (PARTITION BY package, path, is_docs ORDER BY start_line, end_line, position) AS isl FROM y)
SELECT package, path, is_docs, min(start_line) AS start_line, max(end_line) AS end_line, min(position) AS position, max(score) AS score, count(*) AS merged_count FROM z GROUP BY package, path, is_docs, isl
UNION ALL SELECT package, path, is_docs, coalesce(start_line, 0), coalesce(end_line, 0), position, score, 1 FROM x WHERE NOT start_line > 0 OR start_line IS NULL""",
        "hybrid_interleave": f"""WITH {_H}, u AS (SELECT query_text, seq, CASE WHEN origin = 'docs' THEN 1 ELSE 0 END AS side, row_number() OVER (PARTITION BY query_text, origin = 'docs' ORDER BY seq) AS rk FROM h)
SELECT query_text, seq, side, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_text ORDER BY rk, side) AS INTEGER) AS position FROM u) WHERE position <= 10""",
        "hybrid_diversify": f"""WITH {_H}, u AS (SELECT query_text, seq, origin, row_number() OVER (PARTITION BY query_text ORDER BY seq) AS position FROM h), v AS (SELECT *, row_number() OVER (PARTITION BY query_text, origin = 'docs' ORDER BY position) = 1 AS fi FROM u)
SELECT query_text, seq, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_text ORDER BY fi DESC, position) AS INTEGER) AS place FROM v) WHERE place <= 5""",
        "two_pass_rank": f"WITH RECURSIVE {_P} {_ranked()} SELECT query_text, seq, position, score, promoted, CAST(best_window AS INTEGER) AS best_window FROM rk WHERE score >= 0.1",
        "flagship": _search(FLAGSHIP),
        "flagship_word": _search(WORD),
        "flagship_variants": _search(FLAGSHIP, VARIANTS),
        "flagship_unranked": _search(FLAGSHIP, scope="LoomWork", rerank=False),
        "run_statistics": f"WITH {_H} SELECT package, origin, count(*) AS hits, count(DISTINCT query_text) AS queries FROM h GROUP BY ALL",
    }

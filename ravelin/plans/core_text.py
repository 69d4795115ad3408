"""Queries over chunk tables, texts and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text
from ravelin.operators import chunking, extraction, search, vector
from ravelin.operators.incremental import newest
from ravelin.session import shared_dir
from ravelin.sources.tables import load

QUERY, SCOPE = "parse header lock", "loomwork"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Document chunks, each once."""
    return load(spark, d, "doc_slices").dropDuplicates(["slice_id"])


def _code(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "symbol_sources").dropDuplicates(["symbol_id"])


def docs_bm25(spark, d):
    """The ten best document chunks with their snippets."""
    out = search.query(_docs(spark, d), "slice_id", "content", QUERY, 10)
    return out.select("slice_id", "package", "path", text.snippet(F.col("content"), F.lit(False)).alias("snippet"), "score")


def docs_bm25_scoped(spark, d):
    c = _docs(spark, d).where(F.lower("package") == SCOPE)
    return search.query(c, "slice_id", "content", QUERY, 10).select("slice_id", "score")


def code_bm25_kind(spark, d):
    """The best 25 symbols, then those of one kind among them."""
    top = search.query(_code(spark, d), "symbol_id", "content", "parse ledger", 25)
    return top.where("kind = 'function'").select("symbol_id", "symbol", text.snippet(F.col("content"), F.lit(True)).alias("snippet"), "score")


def docs_bm25_log(spark, d):
    """The three best chunks for every logged search whose id is divisible by 20."""
    q = load(spark, d, "search_results").where("result_id % 20 = 0").select(F.col("result_id").alias("query_id"), "query_text").distinct()
    return search.best(load(spark, d, "doc_slices"), "slice_id", "content", q, 3)


def docs_bm25_index(spark, d):
    """The three best chunks for every logged search, over a written index of which only the
    terms' buckets are read."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    search.write_index(load(spark, d, "doc_slices"), "slice_id", "content", path, 16)
    q = load(spark, d, "search_results").select(F.col("result_id").alias("query_id"), "query_text").distinct()
    return search.best_indexed(spark, path, "slice_id", q, 3)


def return_types(spark, d):
    """Declared return types of all symbols, without wrappers."""
    n = load(spark, d, "nodes").select("id", "signature", "updated_at")
    return extraction.return_types(newest(n, "id", ["updated_at"]))


def significant_terms(spark, d):
    q = load(spark, d, "search_results").select("query_text").distinct()
    return q.select("query_text", F.array_join(text.significant(F.col("query_text")), " ").alias("terms"))


def term_statistics(spark, d):
    """Document frequency and occurrences of every term: the statistics of the index."""
    p = search.postings(_docs(spark, d), "slice_id", "content")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("most"))


def vec_normalize(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", vector.normalized(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


def vec_knn(spark, d):
    """The five nearest vectors of every vector whose id is divisible by 20."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.nearest(e, q, 5).select("query_id", "vec_id", "cosine", "rank")


def vec_knn_label(spark, d):
    """Label by vote of the five nearest, for every vector whose id is divisible by 20."""
    k = vec_knn(spark, d).join(load(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    v = k.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return v.groupBy("query_id").agg(F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("label"), F.max("votes").alias("votes"))


def vec_compatible(spark, d):
    """Packages whose vectors fit a model: here the labels whose vectors have 64 numbers."""
    m = load(spark, d, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).alias("dim"), F.count(F.lit(1)).alias("vectors")).withColumn("model_id", F.concat(F.lit("m"), F.col("label") % 2))
    return vector.compatible(m, "m1", 64).select("label", "dim", "vectors")


def content_hashes(spark, d):
    """Recorded against computed digests of the newest texts."""
    s = load(spark, d, "file_scans").select("path", "seen_at", "received_at", "content_hash", F.sha2("content", 256).alias("made"))
    n = newest(s, "path", ["seen_at", "received_at"]).where("made IS NOT NULL")
    return n.select("path", "made", (F.lower("content_hash") == F.col("made")).alias("ok"))


def _scan_lines(spark, d):
    s = load(spark, d, "file_scans").select("path", "seen_at", "received_at", "content")
    keys = newest(s.select("path", "seen_at", "received_at"), "path", ["seen_at", "received_at"])
    now = s.join(keys, ["path", "seen_at", "received_at"]).where("content IS NOT NULL").dropDuplicates(["path"])
    return chunking.line_rows(now, ["path"], "content")


def line_scanner_symbols(spark, d):
    """Definitions found by keyword in the newest text of every file."""
    return chunking.scanned_symbols(_scan_lines(spark, d), ["path"])


def doc_lines(spark, d):
    """Whole documents by line: later chunks win, missing lines are empty."""
    c = _docs(spark, d).where("NOT line_meta_missing").select("package", "path", F.col("slice_id").alias("chunk_index"), "start_line", "content")
    out = chunking.gap_filled(c, ["package", "path"])
    return out.groupBy("package", "path").agg(F.count(F.lit(1)).alias("lines"), F.sum((F.col("text") == "").cast("int")).alias("empty"), F.sum(F.length("text")).alias("chars"))


def doc_whole(spark, d):
    """Chunks of each document in order, joined by blank lines, as a digest."""
    c = _docs(spark, d).groupBy("package", "path").agg(F.sort_array(F.collect_list(F.struct("start_line", "slice_id", "content"))).alias("_c"))
    return c.select("package", "path", F.size("_c").alias("chunks"), F.md5(F.array_join(F.transform("_c", lambda x: x["content"]), "\n\n")).alias("digest"))


def code_line_range(spark, d):
    """Lines 2 to 4 of the file range of every symbol, cut from its body."""
    c = _code(spark, d)
    return c.select("symbol_id", chunking.line_range(F.col("content"), F.lit(1), 2, 4).alias("text"))


def chunk_documents(spark, d):
    """Paragraph chunks of at most 800 bytes of every document."""
    return chunking.chunk(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def kwic_windows(spark, d):
    return chunking.kwic(_code(spark, d), ["symbol_id"], "content")


def merged_bodies(spark, d):
    """The bodies of all symbols of a file as one text."""
    c = _code(spark, d).where("start_line > 0").select("package", "path", "start_line", "end_line", "content")
    return chunking.merged_bodies(c, ["package", "path"])


def normal_paths(spark, d):
    p = load(spark, d, "files").select("path").distinct()
    return p.select("path", text.normal_path(F.concat(F.lit("Root\\"), F.col("path"))).alias("normal"), text.path_matches(F.col("path"), "Index_Glyph.ts").alias("hit"))


def citation_verify(spark, d):
    """Document hits checked against the stored chunks of their path: share of their
    significant lines found there, at least 0.6 to be verified."""
    hits = load(spark, d, "search_results").where("symbol IS NULL").dropDuplicates(["result_id"]).select("result_id", "package", "path", text.significant_lines(F.regexp_replace("snippet", "^… | …$", "")).alias("l"))
    corpus = _docs(spark, d).groupBy("package", "path").agg(F.sort_array(F.collect_list(F.struct("slice_id", F.trim(F.regexp_replace("content", r"\s+", " ")).alias("t")))).alias("_c"))
    c = corpus.select("package", "path", F.array_join(F.transform("_c", lambda x: x["t"]), " ").alias("corpus"))
    j = hits.where("size(l) > 0").join(c, ["package", "path"])
    found = F.size(F.filter("l", lambda x: F.instr(F.col("corpus"), x) > 0))
    return j.select("result_id", F.size("l").alias("lines"), found.alias("found"), (found / F.size("l") >= 0.6).alias("verified"))


def variant_guard(spark, d):
    """Which logged searches could stand as variants of one query."""
    q = load(spark, d, "search_results").select("query_text").distinct()
    return q.select("query_text", text.acceptable_variant(F.col("query_text"), F.lit("parse the frozen header")).alias("acceptable"))


def name_matches(spark, d):
    """Code hits whose name or signature holds half of the query's terms."""
    h = load(spark, d, "search_results").where("symbol IS NOT NULL").dropDuplicates(["result_id"])
    return h.select("result_id", text.matches_name(F.col("query_text"), F.col("symbol"), F.col("signature")).alias("by_name"))


_QUERIES = [
    docs_bm25, docs_bm25_scoped, code_bm25_kind, docs_bm25_log, docs_bm25_index, return_types, significant_terms, term_statistics, vec_normalize, vec_knn, vec_knn_label, vec_compatible, content_hashes,
    line_scanner_symbols, doc_lines, doc_whole, code_line_range, chunk_documents, kwic_windows, merged_bodies, normal_paths, citation_verify, variant_guard, name_matches,
]


def queries():
    return {f.__name__: f for f in _QUERIES}


_DOCS = "docs AS (SELECT DISTINCT * FROM doc_slices)"
_CODE = "code AS (SELECT DISTINCT * FROM symbol_sources)"
_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _bm25(table: str, key: str, words: list[str], k: int) -> str:
    w = ", ".join(f"'{x}'" for x in words)
    return f"""tk AS (SELECT {key}, {_TOK.format('content')} AS t FROM {table}), ex AS (SELECT {key}, len(t) AS dl, unnest(t) AS term FROM tk),
pf AS (SELECT {key}, dl, term, count(*) AS tf FROM ex WHERE term IN ({w}) GROUP BY ALL), st AS (SELECT count(*) AS c, avg(len(t)) AS av FROM tk), df AS (SELECT term, count(*) AS df FROM pf GROUP BY term),
sc AS (SELECT {key}, round(sum(ln(1 + (c - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM pf JOIN df USING (term), st GROUP BY {key} ORDER BY score DESC, {key} LIMIT {k})"""


def oracle():
    q = QUERY.split()
    stop = ", ".join(f"'{w}'" for w in text.TASK_STOPWORDS)
    guard = ", ".join(f"'{w}'" for w in sorted(set(text.DANGLING) | set(text.TASK_STOPWORDS)))
    dangling = ", ".join(f"'{w}'" for w in text.DANGLING)
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in chunking.KEYWORDS.items())
    rx = chunking._DEF
    cos = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
    knn = f"""SELECT query_id, vec_id, cosine, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {cos} AS cosine, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {cos} DESC, b.vec_id) AS INTEGER) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5"""
    log = f"""WITH {_DOCS}, q AS (SELECT DISTINCT result_id AS query_id, query_text FROM search_results WHERE result_id % 20 = 0), qt AS (SELECT DISTINCT query_id, unnest({_TOK.format('query_text')}) AS term FROM q),
tk AS (SELECT slice_id, {_TOK.format('content')} AS t FROM docs), ex AS (SELECT slice_id, len(t) AS dl, unnest(t) AS term FROM tk), pf AS (SELECT slice_id, dl, term, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
st AS (SELECT count(*) AS c, avg(len(t)) AS av FROM tk), df AS (SELECT term, count(*) AS df FROM pf GROUP BY term),
sc AS (SELECT query_id, slice_id, round(sum(ln(1 + (c - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM qt JOIN pf USING (term) JOIN df USING (term), st GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slice_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 3"""
    body = "string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))"
    return {
        "docs_bm25": f"WITH {_DOCS}, {_bm25('docs', 'slice_id', q, 10)} SELECT slice_id, package, path, content[1:400] AS snippet, score FROM sc JOIN docs USING (slice_id)",
        "docs_bm25_scoped": f"WITH {_DOCS}, dd AS (SELECT * FROM docs WHERE lower(package) = '{SCOPE}'), {_bm25('dd', 'slice_id', q, 10)} SELECT * FROM sc",
        "code_bm25_kind": f"WITH {_CODE}, {_bm25('code', 'symbol_id', ['parse', 'ledger'], 25)} SELECT symbol_id, symbol, content[1:600] AS snippet, score FROM sc JOIN code USING (symbol_id) WHERE kind = 'function'",
        "docs_bm25_log": log,
        "docs_bm25_index": log.replace(" WHERE result_id % 20 = 0", ""),
        "significant_terms": f"""WITH q AS (SELECT DISTINCT query_text FROM search_results), f AS (SELECT query_text, list_filter(list_transform(list_filter(regexp_extract_all(query_text, '[\\p{{L}}\\p{{N}}_]+'), lambda t: strlen(t) >= 3), lambda t: lower(t)), lambda t: t NOT IN ({stop})) AS l FROM q)
SELECT query_text, array_to_string(list_filter(l, lambda t, i: list_position(l, t) = i)[1:10], ' ') AS terms FROM f""",
        "term_statistics": f"WITH {_DOCS}, ex AS (SELECT slice_id, unnest({_TOK.format('content')}) AS term FROM docs), pf AS (SELECT slice_id, term, count(*) AS tf FROM ex GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS most FROM pf GROUP BY term",
        "vec_normalize": "SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(CASE WHEN n > 0 THEN embedding[i]::DOUBLE / n ELSE embedding[i]::DOUBLE END, 6) AS x FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
        "vec_knn": knn,
        "vec_knn_label": f"SELECT query_id, label, votes FROM (SELECT query_id, label, count(*) AS votes, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS rn FROM ({knn}) JOIN embeddings USING (vec_id) GROUP BY query_id, label) WHERE rn = 1",
        "vec_compatible": "SELECT label, CAST(max(len(embedding)) AS INTEGER) AS dim, count(*) AS vectors FROM embeddings GROUP BY label HAVING max(len(embedding)) = 64 AND label % 2 = 1",
        "content_hashes": "SELECT path, sha256(content) AS made, lower(content_hash) = sha256(content) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, received_at DESC) AS rn FROM file_scans) WHERE rn = 1 AND content IS NOT NULL",
        "kwic_windows": """WITH RECURSIVE c AS (SELECT DISTINCT symbol_id, content AS bt FROM symbol_sources WHERE content IS NOT NULL),
ls AS (SELECT symbol_id, strlen(bt) AS total, len(string_split(bt, chr(10))) AS cnt, unnest(string_split(bt, chr(10))) AS ln, generate_subscripts(string_split(bt, chr(10)), 1) AS i FROM c),
le AS (SELECT *, least(total, sum(strlen(ln) + 1) OVER (PARTITION BY symbol_id ORDER BY i)) AS e FROM ls),
lb AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY symbol_id ORDER BY i), 0) AS s FROM le),
tr AS (SELECT a.symbol_id, a.s, a.total, coalesce(min(CASE WHEN b.e > a.s + 1500 THEN b.e END), a.total) AS stop, coalesce(min(CASE WHEN b.e > a.s + 750 THEN b.e END), a.total) AS nxt FROM lb a JOIN lb b USING (symbol_id) WHERE a.total > 1500 GROUP BY a.symbol_id, a.s, a.total),
wn AS (SELECT symbol_id, 0 AS idx, 0::HUGEINT AS s FROM lb WHERE i = 1 UNION ALL SELECT w.symbol_id, w.idx + 1, t.nxt FROM wn w JOIN tr t ON t.symbol_id = w.symbol_id AND t.s = w.s WHERE t.stop < t.total AND t.nxt > w.s)
SELECT w.symbol_id, w.idx AS window_index, string_agg(l.ln || CASE WHEN l.i < l.cnt THEN chr(10) ELSE '' END, '' ORDER BY l.i) AS "window" FROM wn w LEFT JOIN tr t ON t.symbol_id = w.symbol_id AND t.s = w.s
JOIN lb l ON l.symbol_id = w.symbol_id AND l.s >= w.s AND l.e <= coalesce(t.stop, l.total) GROUP BY ALL""",
        "line_scanner_symbols": f"""WITH s AS (SELECT path, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, received_at DESC) AS rn FROM file_scans) WHERE rn = 1 AND content IS NOT NULL),
ls AS (SELECT path, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line FROM (SELECT path, {body} AS l FROM s)), la AS (SELECT path, max(line) AS last FROM ls GROUP BY path),
h AS (SELECT path, line, regexp_extract(text, $re${rx}$re$, 1) AS k, regexp_extract(text, $re${rx}$re$, 2) AS symbol FROM ls WHERE regexp_matches(text, $re${rx}$re$))
SELECT path, symbol, CASE k {kinds} END AS kind, CAST(line AS INTEGER) AS start_line, CAST(coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, last) AS INTEGER) AS end_line FROM h JOIN la USING (path)""",
        "doc_lines": f"""WITH {_DOCS}, ls AS (SELECT package, path, slice_id, start_line + i - 1 AS line, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, {body} AS l FROM docs WHERE NOT line_meta_missing))),
w AS (SELECT package, path, line, arg_max(text, slice_id) AS text FROM ls GROUP BY ALL), sp AS (SELECT package, path, min(line) AS a, max(line) AS z FROM w GROUP BY ALL),
ev AS (SELECT package, path, unnest(range(a, z + 1)) AS line FROM sp)
SELECT package, path, count(*) AS lines, sum(CASE WHEN coalesce(text, '') = '' THEN 1 ELSE 0 END)::BIGINT AS empty, sum(length(coalesce(text, '')))::BIGINT AS chars FROM ev LEFT JOIN w USING (package, path, line) GROUP BY package, path""",
        "doc_whole": f"WITH {_DOCS} SELECT package, path, CAST(count(*) AS INTEGER) AS chunks, md5(string_agg(content, chr(10) || chr(10) ORDER BY start_line, slice_id)) AS digest FROM docs GROUP BY package, path",
        "code_line_range": f"WITH {_CODE} SELECT symbol_id, array_to_string({body}[2:4], chr(10)) AS text FROM code",
        "normal_paths": "SELECT DISTINCT path, lower(replace('Root\\' || path, '\\', '/')) AS normal, path = 'Index_Glyph.ts' OR ends_with(lower(path), '/index_glyph.ts') AS hit FROM files",
        "citation_verify": f"""WITH {_DOCS}, h AS (SELECT DISTINCT result_id, package, path, list_filter(list_transform(regexp_split_to_array(regexp_replace(snippet, '^… | …$', '', 'g'), '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 4 AND regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS l FROM search_results WHERE symbol IS NULL),
c AS (SELECT package, path, string_agg(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ' ORDER BY slice_id) AS corpus FROM docs GROUP BY ALL),
f AS (SELECT result_id, CAST(len(l) AS INTEGER) AS lines, CAST(len(list_filter(l, lambda x: contains(corpus, x))) AS INTEGER) AS found FROM h JOIN c USING (package, path) WHERE len(l) > 0)
SELECT *, found / lines >= 0.6 AS verified FROM f""",
        "variant_guard": f"""WITH q AS (SELECT DISTINCT query_text FROM search_results), f AS (SELECT query_text, {_TOK.format('query_text')} AS t, list_filter({_TOK.format('query_text')}, lambda x: x NOT IN ({guard})) AS v FROM q)
SELECT query_text, length(trim(query_text)) >= 4 AND coalesce(t[-1] NOT IN ({dangling}), true) AND len(v) > 0 AND list_has_any(v, ['parse', 'frozen', 'header']) AS acceptable FROM f""",
        "name_matches": f"""WITH h AS (SELECT DISTINCT result_id, query_text, symbol, signature FROM search_results WHERE symbol IS NOT NULL),
f AS (SELECT result_id, lower(concat_ws(' ', symbol, signature)) AS hay, list_filter({_TOK.format('query_text')}, lambda x: strlen(x) >= 3) AS t FROM h)
SELECT result_id, length(trim(hay)) > 0 AND len(t) > 0 AND 2 * len(list_filter(t, lambda x: contains(hay, x))) >= len(t) AS by_name FROM f""",
    }

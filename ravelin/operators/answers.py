"""Evidence and presentation: pairing, checking, budgets and JSON envelopes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions import text

BODY_BUDGET, EVIDENCE_CHARS, VERIFIED_SHARE = 12_000, 4_000, 0.6


def evidence(messages: DataFrame) -> DataFrame:
    """(session, seq, tool, arguments, text): each tool answer with the call it answers.

    ``messages``: session, seq, role, call_id, tool, arguments, content.  An answer without
    a call is of tool ``tool`` with empty arguments; texts are cut to 4,000 characters.
    """
    calls = messages.where("role = 'call'").groupBy("session", "call_id").agg(F.min_by(F.struct("tool", "arguments"), "seq").alias("_c"))
    a = messages.where("role = 'tool'").select("session", "seq", "call_id", F.substring("content", 1, EVIDENCE_CHARS).alias("text"))
    j = a.join(calls, ["session", "call_id"], "left")
    return j.select("session", "seq", F.coalesce("_c.tool", F.lit("tool")).alias("tool"), F.coalesce("_c.arguments", F.lit("{}")).alias("arguments"), "text")


def verify_findings(findings: DataFrame, texts: DataFrame, share: float = VERIFIED_SHARE) -> DataFrame:
    """Findings (session, finding, snippet) with ``verified``: at least ``share`` of the
    significant lines occur in the session's evidence; null without lines or evidence."""
    corpus = texts.groupBy("session").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("_c"))
    flat = F.trim(F.regexp_replace("_c", r"\s+", " "))
    j = findings.join(corpus.select("session", F.nullif(flat, F.lit("")).alias("_c")), "session", "left").withColumn("_l", text.significant_lines(F.col("snippet")))
    found = F.size(F.filter("_l", lambda x: F.instr(F.col("_c"), x) > 0))
    ok = F.when(F.col("_c").isNotNull() & (F.size("_l") > 0), found / F.size("_l") >= share)
    return j.withColumn("verified", ok).drop("_l", "_c")


def within_budget(bodies: DataFrame, group: str, order: str, body: str = "body", most: int = BODY_BUDGET) -> DataFrame:
    """Bodies taken in order while they fit ``most`` bytes; one that does not fit is skipped
    and smaller ones after it may still be taken.  Adds ``taken``.

    Groups are the results of one answer, a few dozen rows at most.
    """
    d = bodies.withColumn("_bytes", F.coalesce(F.octet_length(body), F.lit(0)))
    schema = T.StructType([*bodies.schema, T.StructField("taken", T.BooleanType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        left, taken = most, []
        for n in pdf["_bytes"]:
            ok = bool(n <= left)
            left -= n if ok else 0
            taken.append(ok)
        return pdf.drop(columns="_bytes").assign(taken=taken)

    return d.groupBy(group).applyInPandas(fold, schema)


def rejoin(ranked: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Ranked candidates (rank, key) back to their nodes; equal keys are used up in order."""
    a = ranked.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("rank")))
    b = nodes.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("id")))
    return a.join(b, [key, "_k"]).drop("_k")


def envelope(hits: DataFrame) -> DataFrame:
    """One JSON document per hit, without absent fields."""
    return hits.select(F.to_json(F.struct(*[F.col(c) for c in hits.columns]), {"ignoreNullFields": "true"}).alias("json"))


def greedy_pool(fused: DataFrame, group: str, size: int = 20, expansion_share: float = 0.34) -> DataFrame:
    """The pool when variants may add results: hits by score, at most a third of the pool of
    one package and origin, and at most ``expansion_share`` of it found by variants only.

    A hit skipped for its bucket does not use up the share of the variants, so the scan is
    sequential; each group is one query's hits.
    """
    bucket, extra = max(size // 3, 3), int(size * expansion_share)
    schema = T.StructType([*fused.schema, T.StructField("pool_rank", T.IntegerType())])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rrf", "seq"], ascending=[False, True])
        counts: dict = {}
        keep, added = [], 0
        for i, (p, o, own) in enumerate(zip(pdf["package"], pdf["origin"], pdf["from_original"])):
            if len(keep) == size:
                break
            if counts.get((p, o), 0) >= bucket or (not own and added >= extra):
                continue
            counts[p, o] = counts.get((p, o), 0) + 1
            added += not own
            keep.append(i)
        out = pdf.iloc[keep].copy()
        out["pool_rank"] = range(1, len(out) + 1)
        return out

    return fused.groupBy(group).applyInPandas(scan, schema)


def markdown(hits: DataFrame) -> DataFrame:
    """(position, text): each hit as a Markdown section with place, signature and body."""
    place = F.concat(F.col("path"), F.when(F.col("start_line") > 0, F.format_string(":%d-%d", "start_line", "end_line")).otherwise(""))
    title = F.concat_ws(" ", F.lit("###"), F.concat(F.col("position").cast("string"), F.lit(".")), F.coalesce("symbol", "path"))
    sig = F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit("Signature: `"), "signature", F.lit("`")))
    body = F.concat(F.lit("```\n"), F.coalesce("snippet", F.lit("")), F.lit("\n```"))
    return hits.select("position", F.concat_ws("\n", title, F.concat(F.lit("`"), "package", F.lit("` "), place), sig, body).alias("text"))


def with_bodies(found: DataFrame, code: DataFrame, order: list, most: int = BODY_BUDGET) -> DataFrame:
    """Callers or callees with the bodies of those whose symbol is unique in its package.

    ``found``: package, name, ... (one answer's few rows); ``code``: package, symbol, content.
    Bodies are taken in ``order`` while they fit ``most`` bytes; the others stay without.
    """
    keys = found.select("package", F.col("name").alias("symbol")).distinct()
    b = code.join(F.broadcast(keys), ["package", "symbol"], "left_semi").select("package", "symbol", "content").distinct()
    one = b.groupBy("package", "symbol").agg(F.count(F.lit(1)).alias("_n"), F.max("content").alias("body")).where("_n = 1").drop("_n")
    j = found.join(one.withColumnRenamed("symbol", "name"), ["package", "name"], "left")
    j = j.withColumn("_order", F.row_number().over(Window.orderBy(*order))).withColumn("_one", F.lit(0))
    w = within_budget(j, "_one", "_order", "body", most)
    return w.withColumn("body", F.when(F.col("taken"), F.col("body"))).drop("_one", "taken").orderBy("_order").drop("_order")


def nodes_json(nodes: DataFrame) -> DataFrame:
    """One document ``{"nodes": [{"node": ...}]}`` of a context's nodes, in their order."""
    cols = [c for c in nodes.columns if c != "position"]
    body = F.struct(F.struct(*cols).alias("node"))
    listed = nodes.agg(F.sort_array(F.collect_list(F.struct("position", body.alias("b")))).alias("_l"))
    return listed.select(F.to_json(F.struct(F.transform("_l", lambda x: x["b"]).alias("nodes"))).alias("json"))


def capped(findings: DataFrame, most: int) -> DataFrame:
    """The first ``most`` findings of each session."""
    w = Window.partitionBy("session").orderBy("finding")
    return findings.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")

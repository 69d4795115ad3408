"""Source files that do not parse: verdicts per file, rates per package and language."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import syntax
from ravelin.llm.batches import map_batches

VERDICT = "path string, package string, seen_at timestamp, received_at timestamp, there boolean, language string, n_errors int, first_line int, first_cause string, errors string"


def _judge(package, path, seen_at, received_at, content) -> list:
    out: list[list] = [path, package, seen_at, received_at, [], [], [], [], [], []]
    known: dict[tuple, tuple] = {}
    for p, t in zip(path, content):
        lang = syntax.LANGUAGE.get((p or "").rsplit(".", 1)[-1].lower())
        if t is None or lang is None:
            row = (t is not None, lang, 0 if t is not None else None, None, None, None)
        else:
            row = known.get((lang, t))
            if row is None:
                found = syntax.faults(lang, t)
                if found:
                    at = syntax.located(lang, t, found)
                    row = (True, lang, len(at), at[0][0], at[0][1], json.dumps([{"line": n, "cause": w} for n, w in at], ensure_ascii=False))
                else:
                    row = (True, lang, 0, None, None, "[]")
                known[(lang, t)] = row
        for column, v in zip(out[4:], row):
            column.append(v)
    return out


def verdicts(scans: DataFrame) -> DataFrame:
    """The verdict on the newest text of every path of ``scans``.

    Columns: path, package, language (by extension; null if unknown, then nothing is
    parsed and nothing is wrong), n_errors, first_line, first_cause, errors (JSON array
    of line and cause).  Every record is parsed where it is read and only its verdict
    travels to the choice of the newest, so texts are never shuffled.  Paths whose newest
    record has no text give no row; an empty text is valid; repeated records, ties in
    time and further columns do no harm.
    """
    each = map_batches(scans.select("package", "path", "seen_at", "received_at", "content"), _judge, VERDICT)
    rest = ["package", "there", "language", "n_errors", "first_line", "first_cause", "errors"]
    best = each.groupBy("path").agg(F.max(F.struct("seen_at", "received_at", *rest)).alias("_b"))
    newest = best.select("path", *[F.col(f"_b.{c}").alias(c) for c in rest])
    return newest.where("there").drop("there")


def rates(found: DataFrame) -> DataFrame:
    """Files, invalid files and acceptance per package and language, with totals.

    A null package or language in the result stands for all of them.
    """
    known = found.where(F.col("language").isNotNull()).withColumn("package", F.coalesce("package", F.lit("")))
    g = known.groupingSets([["package", "language"], ["package"], ["language"], []], "package", "language")
    return g.agg(F.count(F.lit(1)).alias("files"), F.sum((F.col("n_errors") > 0).cast("long")).alias("invalid")).withColumn(
        "accepted_share", F.round(1 - F.col("invalid") / F.col("files"), 6)
    )

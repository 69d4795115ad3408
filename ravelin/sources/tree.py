"""Source trees and documentation folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.text import expand_braces, glob_regex
from ravelin.schemas import language_of

#: Directories that are never looked into (fixed values).
IGNORED = [".git", ".hg", ".svn", "target", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", "dist", "build", ".next", ".cargo"]


def _relative(root: str):
    return F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")


def scan(spark: SparkSession, root: str, excludes: list[str] = (), namespace: str = "") -> DataFrame:
    """Every source file below ``root``: path, language, size, modified_at, content_hash,
    content, errors.

    Files in ignored or excluded directories and of unknown languages are left out; files
    that are no valid UTF-8 stay, with an error and without content.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    f = raw.withColumn("rel", _relative(root)).withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    folders = F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1)
    f = f.where(~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in IGNORED])))
    for x in excludes:
        f = f.where(~(F.col("rel").startswith(x.rstrip("/") + "/") | F.col("path").contains(x.rstrip("/") + "/")) if x.startswith("/") else ~F.col("rel").startswith(x.rstrip("/") + "/"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    stored = F.concat(F.lit(namespace + "/" if namespace else ""), F.col("rel"))
    return f.select(
        stored.alias("path"), "language", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("content_hash"),
        text.alias("content"), F.when(text.isNull(), F.array(F.lit("not valid UTF-8"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )


def docs(spark: SparkSession, root: str, globs: str = "*.md,*.rst,*.txt") -> DataFrame:
    """(path, content) of the files below ``root`` that match one of the patterns."""
    patterns = [p for g in _split_globs(globs) for p in expand_braces(g.strip())]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("rel", _relative(root))
    name = F.element_at(F.split("rel", "/"), -1)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("rel").rlike(glob_regex(p)) | name.rlike(glob_regex(p))
    return raw.where(hit).select(F.col("rel").alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")).where("content IS NOT NULL")


def _split_globs(globs: str) -> list[str]:
    """Patterns between commas that are not within braces."""
    out, depth = [""], 0
    for c in globs:
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x for x in out if x.strip()]

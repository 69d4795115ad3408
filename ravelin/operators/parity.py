"""Comparing two graphs as bags of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.text import glob_regex

NODE_KEY = ["kind", "qualified_name", "file_path"]


def bag_match(golden: DataFrame, ours: DataFrame, key: list[str]) -> DataFrame:
    """(key..., golden, ours, matched, missing, extra) per key, with multiplicities.

    Null and empty key parts are the same.
    """
    def count(df, name):
        parts = [F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit("")).alias(k) for k in key]
        return df.select(*parts).groupBy(*key).agg(F.count(F.lit(1)).alias(name))

    j = count(golden, "golden").join(count(ours, "ours"), key, "full_outer").fillna(0, ["golden", "ours"])
    m = F.least("golden", "ours")
    return j.withColumn("matched", m).withColumn("missing", F.col("golden") - m).withColumn("extra", F.col("ours") - m)


def recall(matches: DataFrame, by: list[str]) -> DataFrame:
    """Totals and recall in percent per group; null where there is nothing to match."""
    g = matches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("golden", "ours", "matched", "missing", "extra")])
    return g.withColumn("recall_pct", F.round(F.try_divide(100.0 * F.col("matched"), F.col("golden")), 4))


def renamed(golden: DataFrame, ours: DataFrame, identity: list[str], name: str) -> DataFrame:
    """Pairs of rows left over on both sides that agree in ``identity`` but not in ``name``,
    paired in order of name."""
    def ranked(df, alias):
        w = Window.partitionBy(*identity).orderBy(name)
        return df.select(*identity, name).withColumn("_k", F.row_number().over(w)).withColumnRenamed(name, alias)

    j = ranked(golden, "golden_name").join(ranked(ours, "our_name"), [*identity, "_k"])
    return j.where(~F.col("golden_name").eqNullSafe(F.col("our_name"))).drop("_k")


def attribute_deltas(golden: DataFrame, ours: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(key, attribute, golden, ours) for attributes that differ; empty counts as absent."""
    def long(df, alias):
        cells = F.array(*[F.struct(F.lit(a).alias("attribute"), F.nullif(F.col(a).cast("string"), F.lit("")).alias(alias)) for a in attributes])
        return df.select(key, F.explode(cells).alias("_c")).select(key, "_c.*")

    j = long(golden, "golden").join(long(ours, "ours"), [key, "attribute"])
    return j.where(~F.col("golden").eqNullSafe(F.col("ours")))


def whitelist(diffs: DataFrame, rules: list[dict]) -> DataFrame:
    """Marks diffs with the number of the first rule that allows them (null if none).

    A rule holds globs for columns; the rules are few and become one expression.
    """
    def allows(rule):
        tests = [F.coalesce(F.col(c), F.lit("")).rlike(glob_regex(p)) for c, p in rule.items()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    return diffs.withColumn("rule", F.coalesce(*[F.when(allows(r), F.lit(n)) for n, r in enumerate(rules)], F.lit(None).cast("int")))


#: Which side of an attribute a rule may forgive (fixed values).
DIRECTIONS = {
    "ours_true": "coalesce(golden, 'false') = 'false' AND ours = 'true'",
    "ours_nonempty": "ours IS NOT NULL AND ours <> ''",
    "golden_null": "golden IS NULL",
    "any": "true",
}


def allowed(diffs: DataFrame, rules: list[dict]) -> DataFrame:
    """``whitelist`` with the tests that are no globs.

    Beside globs for columns a rule may have ``side`` (missing or extra), ``direction`` (of
    attribute diffs, see ``DIRECTIONS``), ``only_duplicates`` (something of the key was matched)
    and ``cross_language`` (the ends' languages differ) and ``language``.  ``diffs`` has the
    columns its rules name: side, golden, ours, matched, source_language, target_language.
    """
    def allows(rule):
        tests = []
        for c, p in rule.items():
            if c == "side":
                tests.append(F.col("side") == p)
            elif c == "direction":
                tests.append(F.expr(DIRECTIONS[p]))
            elif c == "only_duplicates":
                tests.append((F.col("matched") > 0) if p else F.lit(True))
            elif c == "cross_language":
                tests.append((F.col("source_language") != F.col("target_language")) if p else F.lit(True))
            elif c == "language":
                tests.append(F.coalesce(F.col("source_language"), F.lit("")) == p)
            elif c != "justification":
                tests.append(F.coalesce(F.col(c), F.lit("")).rlike(glob_regex(p)))
        return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))

    return diffs.withColumn("rule", F.coalesce(*[F.when(allows(r), F.lit(n)) for n, r in enumerate(rules)], F.lit(None).cast("int")))


def sides(matches: DataFrame) -> DataFrame:
    """One row for each key that is missing or extra, with ``side`` and how often."""
    both = F.array(F.struct(F.lit("missing").alias("side"), F.col("missing").alias("times")), F.struct(F.lit("extra").alias("side"), F.col("extra").alias("times")))
    return matches.withColumn("_s", F.explode(both)).select(*matches.columns, "_s.*").where("times > 0")


def translated(edges: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with our names in place of golden ones where a node is only called otherwise.

    ``names``: golden_name, our_name, from ``renamed``; names with several translations keep
    the first.
    """
    one = names.groupBy("golden_name").agg(F.min("our_name").alias("our_name"))
    out = edges
    for c in columns:
        out = out.join(one.select(F.col("golden_name").alias(c), F.col("our_name").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return out.select(*edges.columns)


def gate(node_recall: DataFrame, edge_recall: DataFrame, nodes: float = 95.0, calls: float = 90.0) -> DataFrame:
    """(what, recall_pct, passed) of all nodes and of calls; nothing to match passes."""
    n = node_recall.agg(F.sum("matched").alias("m"), F.sum("golden").alias("g")).select(F.lit("nodes").alias("what"), F.round(F.try_divide(100.0 * F.col("m"), F.col("g")), 4).alias("recall_pct"), F.lit(nodes).alias("_least"))
    c = edge_recall.where("kind = 'calls'").agg(F.max("recall_pct").alias("recall_pct")).select(F.lit("calls").alias("what"), "recall_pct", F.lit(calls).alias("_least"))
    return n.unionByName(c).select("what", "recall_pct", F.coalesce(F.col("recall_pct") >= F.col("_least"), F.lit(True)).alias("passed"))

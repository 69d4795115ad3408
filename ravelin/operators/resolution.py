"""Resolving references to definitions in tiers of decreasing certainty.

Definitions are aggregated to one row for each key before they meet the sites, so a name
that many files define and many sites use never multiplies rows.  Sites are distinct by file
and name; the partitions of a name that very many files use are split by adaptive execution,
as the other side has one row for each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds that each kind of reference may point to (fixed values).
ALLOWED = {
    "calls": ["function", "method"],
    "qualified": ["function", "method", "enum_member"],
    "instantiates": ["class", "struct", "interface"],
    "references": ["type_alias", "struct", "enum", "class", "interface"],
    "strict": ["struct", "enum", "class", "interface"],
    "extends": ["class", "struct", "interface", "trait", "enum"],
    "implements": ["trait", "interface", "class"],
    "inherits": ["class", "struct", "interface", "trait", "enum"],
}


def directory(c):
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def names(sites: DataFrame, definitions: DataFrame, imports: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The definition each site (file, language, name) refers to by its name.

    Tiers: the same file; a file the site's file imports; the only definition in the
    site's language; the only one in its directory and language.  Sites without such a
    definition have no row.  ``definitions``: id, name, def_file, def_language,
    qualified_name, of admissible kinds; ``imports``: distinct (file, imported).  ``extra``
    columns of both tables must agree, so that several kinds of reference take one pass.
    """
    keep, e = ["file", "language", "name", *extra], list(extra)
    s = sites.select(*keep).distinct()
    one = F.struct("def_file", "qualified_name", "id")

    def same(left: DataFrame, right: DataFrame, **pairs: str) -> DataFrame:
        """Inner join on pairs of columns and the extra ones; the right side's are renamed."""
        r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
        on = [F.col(a) == F.col(f"_r_{b}") for a, b in [*pairs.items(), *zip(e, e)]]
        return left.join(r, on)

    by_file = definitions.groupBy("def_file", "name", *e).agg(F.min(one).alias("d"))
    by_lang = definitions.groupBy("def_language", "name", *e).agg(F.min(one).alias("d"), F.count(F.lit(1)).alias("n"))
    by_dir = definitions.withColumn("dir", directory(F.col("def_file"))).groupBy("dir", "def_language", "name", *e).agg(F.min(one).alias("d"), F.count(F.lit(1)).alias("n")).where("n = 1")
    total = by_lang.groupBy("name", *e).agg(F.sum("n").alias("_g"))
    i = imports.select(F.col("file").alias("_if"), F.col("imported").alias("_id")).distinct()
    first = same(s, by_file, file="def_file", name="name").select(*keep, F.lit(1).alias("tier"), F.col("_r_d").alias("_d"))
    far = same(s.join(i, F.col("file") == F.col("_if")), by_file, _id="def_file", name="name").select(*keep, F.lit(2).alias("tier"), F.col("_r_d").alias("_d"))
    # A name with one definition in the language is decided; others may be alone in a directory.
    any_ = same(s, by_lang, language="def_language", name="name").select(*keep, F.when(F.col("_r_n") == 1, F.col("_r_d")).alias("_d"))
    only = any_.where("_d IS NOT NULL").select(*keep, F.lit(3).alias("tier"), "_d")
    many = any_.where("_d IS NULL").select(*keep, directory(F.col("file")).alias("_dir"))
    beside = same(many, by_dir, _dir="dir", language="def_language", name="name").select(*keep, F.lit(4).alias("tier"), F.col("_r_d").alias("_d"))
    found = first.unionByName(far).unionByName(only).unionByName(beside)
    best = found.groupBy(*keep).agg(F.min(F.struct("tier", "_d")).alias("_b")).select(*keep, "_b.tier", "_b._d.*")
    best = best.join(total, ["name", *e], "left")
    confidence = F.when(F.col("tier") == 2, 0.9).when(F.col("tier") == 4, 0.5).when(F.col("_g") == 1, 0.9).otherwise(0.4)
    by = F.element_at(F.array(*[F.lit(x) for x in ("same-file", "import", "unique", "same-dir")]), F.col("tier"))
    return best.withColumn("confidence", confidence).withColumn("resolved_by", by).select(*keep, "tier", "def_file", "qualified_name", "id", "confidence", "resolved_by")


def qualified(sites: DataFrame, definitions: DataFrame, imports: DataFrame, strict: bool = False) -> DataFrame:
    """The definition each site (file, language, qualified_name) refers to, in its language.

    The same file first, then an imported one, then the least path.  ``strict`` drops
    sites with several definitions that neither file nor import decides.
    """
    keep = ["file", "language", "qualified_name"]
    s = sites.select(*keep).distinct()
    d = definitions.select("id", F.col("qualified_name").alias("_q"), "def_file", "def_language")
    by_file = d.groupBy(F.col("def_file").alias("_f"), F.col("def_language").alias("_l"), F.col("_q").alias("_p")).agg(F.min("id").alias("_i"))
    whole = d.groupBy("def_language", "_q").agg(F.min(F.struct("def_file", "id")).alias("_d"), F.count(F.lit(1)).alias("candidates"))
    any_ = s.join(whole.select(F.col("def_language").alias("_wl"), "_q", "_d", "candidates"), (F.col("language") == F.col("_wl")) & (F.col("qualified_name") == F.col("_q"))).drop("_wl", "_q")
    held = (F.col("language") == F.col("_l")) & (F.col("qualified_name") == F.col("_p"))
    same = any_.join(by_file, held & (F.col("file") == F.col("_f"))).select(*keep, F.lit(1).alias("tier"), F.col("_f").alias("def_file"), F.col("_i").alias("id"), "candidates")
    i = imports.select(F.col("file").alias("_if"), F.col("imported").alias("_id")).distinct()
    far = any_.join(i, F.col("file") == F.col("_if")).join(by_file, held & (F.col("_id") == F.col("_f"))).select(*keep, F.lit(2).alias("tier"), F.col("_f").alias("def_file"), F.col("_i").alias("id"), "candidates")
    rest = any_.select(*keep, F.lit(3).alias("tier"), "_d.def_file", "_d.id", "candidates")
    best = same.unionByName(far).unionByName(rest).groupBy(*keep).agg(F.min(F.struct("tier", "def_file", "id", "candidates")).alias("_b"))
    out = best.select(*keep, "_b.tier", "_b.def_file", "_b.id", "_b.candidates").withColumn("confidence", F.lit(0.95))
    return out.where((F.col("tier") < 3) | (F.col("candidates") == 1)) if strict else out


def metadata(confidence, resolved_by):
    """The metadata of a resolved edge as JSON."""
    return F.to_json(F.struct(F.round(confidence, 2).alias("confidence"), resolved_by.alias("resolvedBy")))


STEPS = "array<struct<op: string, qualifier: string, name: string>>"
#: Calls in a row through which a receiver's type is followed (fixed value).
DEPTH = 16


def receivers(cut, sites: DataFrame, definitions: DataFrame, returns: DataFrame, imports: DataFrame, classes: DataFrame) -> DataFrame:
    """(site, type): the type of each site's receiver, where its chain of steps gives one.

    ``sites``: site, file, language, steps (``STEPS``).  A chain begins with a type, or with
    a call by name or by qualified name; further steps are methods called on what came before
    and ``element``, what a loop over it yields.  ``returns``: id, bare, element, owner of
    every definition with a declared return type; ``Self`` stands for the owner.  One round
    a step; a round touches only the sites whose chain is that long.  Calls that are ambiguous
    give no type.
    """
    wrote = cut(sites.where(F.size("steps").between(1, DEPTH + 1)).select("site", "file", "language", "steps"))
    longest = wrote.agg(F.max(F.size("steps"))).first()[0] or 0
    r = returns.select(F.col("id").alias("_rid"), *[F.when(F.col(c) == "Self", F.col("owner")).otherwise(F.col(c)).alias(c) for c in ("bare", "element")])

    def of_calls(found: DataFrame, on: list[str], state: DataFrame) -> DataFrame:
        typed = found.join(r, F.col("id") == F.col("_rid")).select(*on, F.col("bare").alias("_bare"), F.col("element").alias("_element"))
        return state.join(typed, on).select("site", "file", "language", "steps", F.col("_bare").alias("type"), F.col("_element").alias("element"))

    none = F.lit(None).cast("string")
    cols = ["site", "file", "language", "steps", "type", "element"]
    s = wrote.withColumn("_s", F.col("steps")[0])
    known = s.where("_s.op = 'type'").select("site", "file", "language", "steps", F.col("_s.name").alias("type"), none.alias("element"))
    bare = s.where("_s.op = 'bare'").withColumn("name", F.col("_s.name"))
    called = names(bare, definitions, imports)
    made = names(bare.join(called.select("file", "language", "name"), ["file", "language", "name"], "left_anti"), classes, imports)
    built = bare.join(made.select("file", "language", "name"), ["file", "language", "name"]).select("site", "file", "language", "steps", F.col("name").alias("type"), none.alias("element"))
    via = s.where("_s.op = 'qualified'").withColumn("qualified_name", F.concat_ws("::", "_s.qualifier", "_s.name"))
    state = known.unionByName(built).unionByName(of_calls(called, ["file", "language", "name"], bare)).unionByName(of_calls(qualified(via, definitions, imports, strict=True), ["file", "language", "qualified_name"], via))
    state = cut(state)
    done = state.where(F.size("steps") == 1).select("site", "type")
    for k in range(1, longest):
        s = state.where(F.size("steps") > k).withColumn("_s", F.col("steps")[k])
        of = s.where("_s.op = 'element'").withColumn("type", F.col("element")).withColumn("element", none)
        m = s.where("_s.op = 'method' AND type IS NOT NULL").withColumn("qualified_name", F.concat_ws("::", "type", "_s.name"))
        state = cut(of.select(*cols).unionByName(of_calls(qualified(m, definitions, imports, strict=True), ["file", "language", "qualified_name"], m)))
        done = done.unionByName(state.where(F.size("steps") == k + 1).select("site", "type"))
    return done.where("type IS NOT NULL")

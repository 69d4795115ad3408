"""Write semantics, packages and registries as relations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAME = r"^[a-z0-9][a-z0-9-]*[a-z0-9]$"
COMMIT = r"^[0-9a-f]{40}$"
COMPONENT = r"^[A-Za-z0-9][A-Za-z0-9._+-]*$"


def first_wins(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Insert or ignore: the first row of every key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of the rows of the same key (one per key each)."""
    return table.join(rows.select(*key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def verify_checksums(listed: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, state) of every listed file: ok, mismatch or missing.

    ``listed``: path, checksum; ``entries``: path, content.
    """
    e = entries.select("path", F.sha2("content", 256).alias("_sha"))
    state = F.when(F.col("_sha").isNull(), "missing").when(F.lower("checksum") == F.col("_sha"), "ok").otherwise("mismatch")
    return listed.join(e, "path", "left").select("path", state.alias("state"))


def registry_index(versions: DataFrame) -> DataFrame:
    """(name, versions, latest, checksums): versions in order of text, the last is latest."""
    v = versions.select("name", "version", "sha256").distinct()
    return v.groupBy("name").agg(
        F.sort_array(F.collect_list("version")).alias("versions"), F.max("version").alias("latest"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("version", "sha256")))).alias("checksums"),
    )


def publishable(new: DataFrame, versions: DataFrame) -> DataFrame:
    """Uploads whose version does not exist yet: published versions never change."""
    return new.join(versions.select("name", "version"), ["name", "version"], "left_anti")


def resolve_bundle(bundles: DataFrame, spec: str) -> DataFrame:
    """The bundle for ``name`` or ``name@version``: workspace before global, the last
    version first; an unknown version falls back to the name.

    ``bundles``: name, version, scope (workspace or global).
    """
    name, _, version = spec.partition("@")
    b = bundles.where(F.lower("name") == name.lower())
    order = [F.desc((F.col("version") == version).cast("int")), F.desc((F.col("scope") == "workspace").cast("int")), F.desc("version")]
    return b.orderBy(*order).limit(1)


def latest_per_package(bundles: DataFrame) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.desc((F.col("scope") == "workspace").cast("int")), F.desc("version"))
    return bundles.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def prune_lock(lock: DataFrame, wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """Lock entries of packages that are wanted or installed."""
    return lock.join(wanted.select("name").unionByName(installed.select("name")).distinct(), "name", "left_semi")


def merge_dependencies(default: DataFrame, groups: DataFrame) -> DataFrame:
    """Default dependencies and those of the selected groups; default wins, then the
    first group.  ``groups``: group_order, name, spec."""
    g = first_wins(groups, "name", ["group_order", "spec"])
    return default.select("name", "spec").unionByName(g.join(default.select("name"), "name", "left_anti").select("name", "spec"))


def parse_spec(c):
    """(name, version) of ``name@version``; no version is null."""
    return F.struct(F.regexp_extract(c, r"^([^@]*)", 1).alias("name"), F.nullif(F.regexp_extract(c, r"@(.+)$", 1), F.lit("")).alias("version"))


def parse_git_source(c):
    """(host, owner, repo, ref) of ``github:[host/]owner/repo[@ref]`` or an https address."""
    p = r"^(?:github:|https?://)?(?:([\w.-]+\.[\w-]+)/)?([\w.-]+)/([\w.-]+?)(?:\.git)?(?:@(.+))?$"
    part = lambda n: F.nullif(F.regexp_extract(c, p, n), F.lit(""))
    return F.struct(F.coalesce(part(1), F.lit("github.com")).alias("host"), part(2).alias("owner"), part(3).alias("repo"), part(4).alias("ref"))


def bundle_name(c):
    """A name made fit for bundles: lower case, other runs become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def valid_names(df: DataFrame, column: str = "name") -> DataFrame:
    return df.withColumn("valid", F.col(column).rlike(NAME))


def namespaces(roots: list[str]) -> dict[str, str]:
    """The shortest distinguishing tail of each root directory; roots within roots are an error."""
    parts = {r: [p for p in re.split(r"[/\\]+", r.rstrip("/\\")) if p] for r in dict.fromkeys(roots)}
    for a, pa in parts.items():
        for b, pb in parts.items():
            if a != b and pb[: len(pa)] == pa:
                raise ValueError(f"{b} lies within {a}")
    out = {}
    for r, p in parts.items():
        n = 1
        while n < len(p) and any(q[-n:] == p[-n:] for o, q in parts.items() if o != r):
            n += 1
        out[r] = "/".join(p[-n:])
    return out


def sync_plan(wanted: DataFrame, lock: DataFrame, installed: DataFrame) -> DataFrame:
    """(name, action): install, update, keep or prune for every package.

    ``wanted`` and ``lock``: name, version; ``installed``: name, version.  A wanted package
    without version takes the locked one.
    """
    w = wanted.select("name", F.col("version").alias("_want"), F.lit(True).alias("_w"))
    k = lock.select("name", F.col("version").alias("_lock"))
    i = installed.groupBy("name").agg(F.collect_set("version").alias("_have"))
    j = w.join(i, "name", "full_outer").join(k, "name", "left")
    target = F.coalesce("_want", "_lock")
    action = (
        F.when(F.col("_w").isNull(), "prune").when(F.col("_have").isNull(), "install")
        .when(target.isNotNull() & ~F.array_contains("_have", target), "update").otherwise("keep")
    )
    return j.select("name", action.alias("action"))


def package_and_path(c):
    """(namespace, rest) of a stored path: its first part and what follows."""
    return F.struct(F.regexp_extract(c, r"^([^/]*)", 1).alias("namespace"), F.regexp_extract(c, r"^[^/]*/(.*)$", 1).alias("rest"))


def real_paths(paths: DataFrame, roots: DataFrame, column: str = "path") -> DataFrame:
    """Stored paths with the place they lie at: the root of the longest matching namespace.

    ``roots``: namespace, root (few).  An empty namespace matches every path; without a match
    the place is null.
    """
    r = roots.select(F.col("namespace").alias("_ns"), F.col("root").alias("_root"))
    j = paths.join(F.broadcast(r), (F.col("_ns") == "") | F.col(column).startswith(F.concat("_ns", F.lit("/"))) | (F.col(column) == F.col("_ns")), "left")
    rest = F.when(F.col("_ns") == "", F.col(column)).otherwise(F.expr(f"substring({column}, length(_ns) + 2)"))
    place = F.when(F.col("_root").isNotNull(), F.concat(F.regexp_replace("_root", "/+$", ""), F.lit("/"), rest))
    return j.groupBy(*paths.columns).agg(F.max_by(place, F.when(F.col("_root").isNotNull(), F.length("_ns"))).alias("place"))


def index_path(name: str, local: DataFrame, bundles: DataFrame, part: str = "graph") -> str:
    """Where the index of a package lies: the local package, then workspace, then global.

    ``local``: name, folder; ``bundles``: name, version, scope, path.  An unknown package and
    one without that part are different errors.
    """
    own = local.where(F.lower("name") == name.partition("@")[0].lower()).first()
    if own is not None:
        return f"{own['folder']}/{part}"
    found = resolve_bundle(bundles, name).first()
    if found is None:
        raise LookupError(f"no package {name!r}")
    if "parts" in found.asDict() and part not in (found["parts"] or []):
        raise LookupError(f"package {name!r} has no {part}")
    return f"{found['path']}/{part}"


def valid_commits(df: DataFrame, column: str = "commit") -> DataFrame:
    return df.withColumn("valid", F.coalesce(F.col(column).rlike(COMMIT), F.lit(False)))


def layout_errors(entries: DataFrame, wanted: tuple[str, ...] = ("manifest.json", "graph/")) -> list[str]:
    """What the entries (path) of an archive lack: files by name, folders by their beginning."""
    tests = [F.max((F.col("path").startswith(w) if w.endswith("/") else F.col("path") == w).cast("int")).alias(w) for w in wanted]
    got = entries.agg(*tests).first()
    return [f"{w} is missing" for w in wanted if not got[w]]


def belongs_to(dependencies: DataFrame, workspace: str) -> DataFrame:
    """Dependencies (name, spec) on a local folder that is the workspace, holds it or lies in it."""
    here = workspace.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("spec", "^(?:path|file):(?://)?", ""), "/+$", "")
    local = F.col("spec").rlike("^(?:path:|file:|/|\\.)")
    return dependencies.where(local & ((path == here) | path.startswith(here + "/") | F.lit(here + "/").startswith(F.concat(path, F.lit("/")))))


def token_owner(tokens: DataFrame, token: str) -> str | None:
    """The label of a token; only digests (hash, label) are stored."""
    import hashlib

    r = tokens.where(F.col("hash") == hashlib.sha256(token.encode()).hexdigest()).first()
    return r["label"] if r else None

"""Queries over packages, versions and write semantics, derived from the index log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import storage
from ravelin.sources.tables import load


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """A version of a package for every day it was indexed on, with a digest of its files."""
    f = load(spark, d, "files").select("package", "path", F.lower("content_hash").alias("h"), F.floor(F.col("indexed_at") / 86_400_000).alias("day"))
    g = f.distinct().groupBy("package", "day").agg(F.sort_array(F.collect_set(F.concat_ws("=", "path", "h"))).alias("_f"))
    return g.select(F.col("package").alias("name"), F.concat(F.lit("1."), F.col("day").cast("string")).alias("version"), F.sha2(F.array_join("_f", ","), 256).alias("sha256"), F.when(F.col("day") % 2 == 0, "workspace").otherwise("global").alias("scope"))


def package_versions(spark, d):
    return _versions(spark, d)


def registry_index(spark, d):
    r = storage.registry_index(_versions(spark, d))
    return r.select("name", F.array_join("versions", " ").alias("versions"), "latest", F.try_element_at("checksums", F.col("latest")).alias("latest_sha"))


def bundle_catalog(spark, d):
    """The bundle each package name resolves to."""
    return storage.latest_per_package(_versions(spark, d)).select("name", "version", "scope")


def bundle_resolve(spark, d):
    v = _versions(spark, d)
    return storage.resolve_bundle(v, "Loomwork").select("name", "version", "scope").unionByName(storage.resolve_bundle(v, "tessera@0.0.0").select("name", "version", "scope"))


def publish_guard(spark, d):
    """Uploads that are accepted when every odd day is published already."""
    v = _versions(spark, d)
    return storage.publishable(v, v.where("scope = 'global'")).select("name", "version")


def lock_prune(spark, d):
    v = _versions(spark, d)
    lock = v.select("name").distinct()
    wanted = lock.where("name < 'h'")
    installed = v.where("scope = 'workspace'").select("name").distinct().where("name LIKE '%e%'")
    return storage.prune_lock(lock, wanted, installed)


def dependency_merge(spark, d):
    v = _versions(spark, d)
    default = v.where("name < 'k' AND scope = 'global'").groupBy("name").agg(F.max("version").alias("spec"))
    groups = v.select((F.length("name") % 3).alias("group_order"), "name", F.col("version").alias("spec"))
    return storage.merge_dependencies(default, groups)


def upsert_catalog(spark, d):
    v = _versions(spark, d)
    base = v.groupBy("name").agg(F.min("version").alias("version"))
    new = v.where("scope = 'workspace'").groupBy("name").agg(F.max("version").alias("version"))
    return storage.upsert(base, new, ["name"])


def checksum_verify(spark, d):
    """Every logged digest against the newest text of its path."""
    from ravelin.operators.incremental import newest

    scans = load(spark, d, "file_scans").select("path", "seen_at", "received_at", "content")
    keys = newest(scans.select("path", "seen_at", "received_at", F.sha2("content", 256).alias("_h")), "path", ["seen_at", "received_at"]).where("_h IS NOT NULL")
    listed = load(spark, d, "files").select("path", F.col("content_hash").alias("checksum")).distinct()
    state = F.when(F.col("_h").isNull(), "missing").when(F.lower("checksum") == F.col("_h"), "ok").otherwise("mismatch")
    return listed.join(keys.select("path", "_h"), "path", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def name_validation(spark, d):
    s = load(spark, d, "documents").select("source").distinct().where("source IS NOT NULL")
    return s.select("source", F.col("source").rlike(storage.NAME).alias("valid"), storage.bundle_name(F.col("source")).alias("fit"), F.col("source").rlike(storage.COMPONENT).alias("safe"))


def spec_parse(spark, d):
    v = _versions(spark, d).select(F.concat_ws("@", "name", F.when(F.col("scope") == "global", F.col("version"))).alias("spec"), F.concat(F.lit("github:"), F.col("name"), F.lit("/core@v"), F.col("version")).alias("git")).distinct()
    return v.select("spec", storage.parse_spec(F.col("spec")).alias("p"), storage.parse_git_source(F.col("git")).alias("g")).select("spec", "p.name", "p.version", "g.host", "g.owner", "g.repo", "g.ref")


_QUERIES = [package_versions, registry_index, bundle_catalog, bundle_resolve, publish_guard, lock_prune, dependency_merge, upsert_catalog, checksum_verify, name_validation, spec_parse]


def queries():
    return {f.__name__: f for f in _QUERIES}


_V = """v AS (SELECT package AS name, '1.' || day::VARCHAR AS version, sha256(string_agg(x, ',' ORDER BY encode(x))) AS sha256, CASE WHEN day % 2 = 0 THEN 'workspace' ELSE 'global' END AS scope
FROM (SELECT DISTINCT package, indexed_at // 86400000 AS day, concat_ws('=', path, lower(content_hash)) AS x FROM files) GROUP BY package, day)"""


def oracle():
    return {
        "package_versions": f"WITH {_V} SELECT * FROM v",
        "registry_index": f"WITH {_V} SELECT name, string_agg(version, ' ' ORDER BY version) AS versions, max(version) AS latest, arg_max(sha256, version) AS latest_sha FROM v GROUP BY name",
        "bundle_catalog": f"WITH {_V} SELECT name, version, scope FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY scope = 'workspace' DESC, version DESC) AS rn FROM v) WHERE rn = 1",
        "bundle_resolve": f"WITH {_V} (SELECT name, version, scope FROM v WHERE name = 'loomwork' ORDER BY scope = 'workspace' DESC, version DESC LIMIT 1) UNION ALL (SELECT name, version, scope FROM v WHERE name = 'tessera' ORDER BY scope = 'workspace' DESC, version DESC LIMIT 1)",
        "publish_guard": f"WITH {_V} SELECT name, version FROM v WHERE scope <> 'global'",
        "lock_prune": f"WITH {_V} SELECT DISTINCT name FROM v WHERE name < 'h' OR name IN (SELECT name FROM v WHERE scope = 'workspace' AND name LIKE '%e%')",
        "dependency_merge": f"""WITH {_V}, dd AS (SELECT name, max(version) AS spec FROM v WHERE name < 'k' AND scope = 'global' GROUP BY name)
SELECT * FROM dd UNION ALL SELECT name, min(version) AS spec FROM v WHERE name NOT IN (SELECT name FROM dd) GROUP BY name""",
        "upsert_catalog": f"WITH {_V}, n AS (SELECT name, max(version) AS version FROM v WHERE scope = 'workspace' GROUP BY name) SELECT * FROM n UNION ALL SELECT name, min(version) FROM v WHERE name NOT IN (SELECT name FROM n) GROUP BY name",
        "checksum_verify": """WITH k AS (SELECT path, sha256(content) AS h FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, received_at DESC) AS rn FROM file_scans) WHERE rn = 1 AND content IS NOT NULL)
SELECT CASE WHEN h IS NULL THEN 'missing' WHEN lower(content_hash) = h THEN 'ok' ELSE 'mismatch' END AS state, count(*) AS n FROM (SELECT DISTINCT path, content_hash FROM files) LEFT JOIN k USING (path) GROUP BY 1""",
        "name_validation": f"SELECT DISTINCT source, regexp_matches(source, '{storage.NAME}') AS valid, regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS fit, regexp_matches(source, '{storage.COMPONENT}') AS safe FROM documents WHERE source IS NOT NULL",
        "spec_parse": f"WITH {_V} SELECT DISTINCT name || CASE WHEN scope = 'global' THEN '@' || version ELSE '' END AS spec, name, CASE WHEN scope = 'global' THEN version END AS version, 'github.com' AS host, name AS owner, 'core' AS repo, 'v' || version AS ref FROM v",
    }

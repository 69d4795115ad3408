"""Package archives: deterministic packing, reading and verification."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import re
import shutil
import tarfile
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators.storage import NAME, verify_checksums

MANIFEST = "manifest.json"


def pack(folder: str, manifest: dict, out: str) -> str:
    """Packs a folder: entries in order of path, times zero, a digest for every file.

    Returns the archive's SHA-256; equal contents give equal archives.
    """
    if not re.match(NAME, manifest.get("name", "")):
        raise ValueError("the package name is not valid")
    files = sorted(os.path.relpath(os.path.join(d, f), folder).replace(os.sep, "/") for d, _, fs in os.walk(folder) for f in fs)
    data = {p: open(os.path.join(folder, p), "rb").read() for p in files if p != MANIFEST}
    full = manifest | {"checksums": {p: hashlib.sha256(b).hexdigest() for p, b in data.items()}}
    data = {MANIFEST: json.dumps(full, indent=2, sort_keys=True).encode()} | data
    raw = io.BytesIO()
    with gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, filename="") as z, tarfile.open(fileobj=z, mode="w", format=tarfile.PAX_FORMAT) as t:
        for p in sorted(data):
            info = tarfile.TarInfo(p)
            info.size, info.mtime, info.mode = len(data[p]), 0, 0o644
            t.addfile(info, io.BytesIO(data[p]))
    with open(out, "wb") as f:
        f.write(raw.getvalue())
    return hashlib.sha256(raw.getvalue()).hexdigest()


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, content, position) of every file in the archives at ``path``."""

    def run(batches):
        for pdf in batches:
            rows = []
            for a, b in zip(pdf["path"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(b), mode="r:*") as t:
                    for n, m in enumerate(x for x in t if x.isfile()):
                        rows.append((a, m.name.removeprefix("./"), t.extractfile(m).read(), n))
            yield pd.DataFrame(rows, columns=["archive", "path", "content", "position"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(run, "archive string, path string, content binary, position int")


def manifests(files: DataFrame) -> DataFrame:
    """(archive, name, version, checksums, problem) from the entries of archives.

    ``problem`` names what makes an archive unusable: duplicate entries, no manifest or
    more than one.
    """
    twice = files.groupBy("archive", "path").agg(F.count(F.lit(1)).alias("n")).groupBy("archive").agg(F.max("n").alias("most"))
    m = files.where((F.col("path") == MANIFEST) | F.col("path").endswith("/" + MANIFEST)).withColumn("m", F.from_json(F.col("content").cast("string"), "name string, version string, checksums map<string,string>"))
    per = m.groupBy("archive").agg(F.count(F.lit(1)).alias("found"), F.min_by("m", F.struct(F.length("path"), F.col("position"))).alias("m"))
    j = twice.join(per, "archive", "left")
    problem = F.when(F.col("most") > 1, "duplicate entries").when(F.col("found").isNull(), "no manifest").when(F.col("found") > 1, "several manifests")
    return j.select("archive", "m.name", "m.version", "m.checksums", problem.alias("problem"))


def verify(files: DataFrame) -> DataFrame:
    """(path, state) of every file that the manifest of one archive lists."""
    listed = manifests(files).select(F.explode("checksums").alias("path", "checksum"))
    return verify_checksums(listed, files.select("path", "content"))


def install(archive: str, store: str) -> str:
    """Unpacks into a temporary folder and renames it into place; nothing is left half done.

    Entries that would leave the folder are an error, as are missing or changed files.
    """
    with tarfile.open(archive, "r:*") as t:
        members = [m for m in t if m.isfile()]
        names = [m.name for m in members]
        if len(set(names)) != len(names):
            raise ValueError("duplicate entries")
        for n in names:
            if n.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", n) or ":" in n.split("/")[0]:
                raise ValueError(f"unsafe path {n}")
        data = {m.name: t.extractfile(m).read() for m in members}
    manifest = json.loads(data[MANIFEST])
    for p, h in manifest.get("checksums", {}).items():
        if p not in data or hashlib.sha256(data[p]).hexdigest() != h:
            raise ValueError(f"missing or changed file {p}")
    os.makedirs(store, exist_ok=True)
    tmp = tempfile.mkdtemp(dir=store, prefix=".new-")
    for p, b in data.items():
        target = os.path.join(tmp, *p.split("/"))
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as f:
            f.write(b)
    final = os.path.join(store, f"{manifest['name']}@{manifest['version']}")
    if os.path.exists(final):
        shutil.rmtree(final)
    os.rename(tmp, final)
    return final


def installed(spark: SparkSession, store: str, scope: str) -> DataFrame:
    """(name, version, scope, path) of the packages in a store."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", MANIFEST).load(store)
    m = raw.select("path", F.from_json(F.col("content").cast("string"), "name string, version string, description string").alias("m"))
    return m.select("m.name", "m.version", "m.description", F.lit(scope).alias("scope"), F.regexp_replace("path", "/manifest\\.json$", "").alias("path"))


def remove(store: str, name: str, version: str | None = None) -> int:
    """Removes one version or all of a package; how many versions went."""
    gone = 0
    for entry in sorted(os.listdir(store)) if os.path.isdir(store) else []:
        n, _, v = entry.partition("@")
        if n.lower() == name.lower() and v and version in (None, v):
            shutil.rmtree(os.path.join(store, entry))
            gone += 1
    return gone

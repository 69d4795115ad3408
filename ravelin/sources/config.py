"""Workspace manifests, lock files and the local package list."""

from __future__ import annotations

import json
import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession

MANIFEST, LOCK = "workspace.toml", "workspace.lock"


def _quote(v) -> str:
    return json.dumps(v, ensure_ascii=False)


def read_manifest(path: str) -> dict:
    """name, dependencies and groups of a workspace; absent parts are empty."""
    with open(path, "rb") as f:
        m = tomllib.load(f)
    return {"name": m.get("workspace", {}).get("name"), "dependencies": m.get("dependencies", {}), "groups": m.get("groups", {})}


def init_manifest(path: str, name: str) -> None:
    if os.path.exists(path):
        raise FileExistsError(path)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"[workspace]\nname = {_quote(name)}\n\n[dependencies]\n")


def set_dependency(path: str, name: str, spec: str | dict, group: str | None = None) -> None:
    """Adds or replaces one dependency; everything else keeps its place and comments."""
    value = _quote(spec) if isinstance(spec, str) else "{ " + ", ".join(f"{k} = {_quote(v)}" for k, v in sorted(spec.items())) + " }"
    head = "[dependencies]" if group is None else f"[groups.{group}]"
    lines = open(path, encoding="utf-8").read().split("\n")
    if head not in [x.strip() for x in lines]:
        lines += ["", head] if lines[-1].strip() else [head]
    at = [x.strip() for x in lines].index(head) + 1
    end = next((k for k in range(at, len(lines)) if lines[k].lstrip().startswith("[")), len(lines))
    own = next((k for k in range(at, end) if re.match(rf'\s*"?{re.escape(name)}"?\s*=', lines[k])), None)
    if own is not None:
        lines[own] = f"{name} = {value}"
    else:
        while end > at and not lines[end - 1].strip():
            end -= 1
        lines.insert(end, f"{name} = {value}")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines).rstrip("\n") + "\n")


def dependencies(spark: SparkSession, manifest: dict, groups: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(default, selected groups) as tables for ``storage.merge_dependencies``."""
    text = lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True)
    d = [(n, text(v)) for n, v in manifest["dependencies"].items()]
    g = [(k, n, text(v)) for k, name in enumerate(groups) for n, v in manifest["groups"].get(name, {}).items()]
    return spark.createDataFrame(d, "name string, spec string"), spark.createDataFrame(g, "group_order int, name string, spec string")


def read_lock(path: str) -> list[dict]:
    if not os.path.exists(path):
        return []
    with open(path, "rb") as f:
        return tomllib.load(f).get("package", [])


def upsert_lock(path: str, entry: dict) -> None:
    """Replaces the entry of the same name, or adds it; entries are in order of name."""
    rows = sorted([r for r in read_lock(path) if r["name"] != entry["name"]] + [entry], key=lambda r: r["name"])
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write("[[package]]\n" + "".join(f"{k} = {_quote(v)}\n" for k, v in sorted(r.items()) if v is not None) + "\n")


class PackageList:
    """The local packages and their folders, kept as sorted JSON."""

    def __init__(self, path: str):
        self.path = path
        self.rows: dict[str, str] = json.load(open(path, encoding="utf-8")) if os.path.exists(path) else {}

    def add(self, name: str, folder: str) -> None:
        self.rows[name] = folder
        self._save()

    def remove(self, name: str) -> bool:
        found = self.rows.pop(name, None) is not None
        self._save()
        return found

    def _save(self) -> None:
        tmp = self.path + ".tmp"
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(dict(sorted(self.rows.items())), f, indent=2)
        os.replace(tmp, self.path)


def record_dependency(manifest: str, lock: str, name: str, source: dict, version: str, digest: str | None = None, group: str | None = None) -> None:
    """Notes an installed package in manifest and lock.

    ``source``: ``path`` of a local folder, or ``git`` with ``ref``, or neither for a registry.
    """
    set_dependency(manifest, name, {k: v for k, v in source.items() if v is not None} or version, group)
    upsert_lock(lock, {"name": name, "version": version, "sha256": digest, **{k: v for k, v in source.items() if v is not None}})


def local_source(spec: str, base: str = ".") -> str | None:
    """The folder a spec names (``path:x``, ``file:x``, ``./x``, ``/x``), or None."""
    for head in ("path:", "file://", "file:"):
        if spec.startswith(head):
            spec = spec[len(head) :]
            break
    else:
        if not spec.startswith(("/", "./", "../", "~")) and spec not in (".", ".."):
            return None
    return os.path.normpath(os.path.join(base, os.path.expanduser(spec)))


def git_state(folder: str) -> tuple[str | None, str | None]:
    """(version, commit) of a checked-out folder, read from its files: the version is the tag
    that points at the commit, without a leading v."""
    git = os.path.join(folder, ".git")
    if os.path.isfile(git):
        git = os.path.normpath(os.path.join(folder, open(git, encoding="utf-8").read().partition(":")[2].strip()))
    try:
        head = open(os.path.join(git, "HEAD"), encoding="utf-8").read().strip()
    except OSError:
        return None, None
    packed: dict[str, str] = {}
    peeled: dict[str, str] = {}
    try:
        last = None
        for line in open(os.path.join(git, "packed-refs"), encoding="utf-8"):
            if line.startswith("^") and last:
                peeled[last] = line[1:].strip()
            elif line.strip() and not line.startswith("#"):
                sha, last = line.split()[:2]
                packed[last] = sha
    except OSError:
        pass

    def ref(name: str) -> str | None:
        try:
            return open(os.path.join(git, *name.split("/")), encoding="utf-8").read().strip()
        except OSError:
            return packed.get(name)

    sha = ref(head[5:]) if head.startswith("ref: ") else head
    tags = {n: peeled.get(n, s) for n, s in packed.items() if n.startswith("refs/tags/")}
    loose = os.path.join(git, "refs", "tags")
    if os.path.isdir(loose):
        tags |= {f"refs/tags/{n}": ref(f"refs/tags/{n}") for n in os.listdir(loose) if os.path.isfile(os.path.join(loose, n))}
    named = sorted(n.rsplit("/", 1)[-1] for n, s in tags.items() if s == sha)
    return (re.sub(r"^v(?=\d)", "", named[-1]) if named else None), sha


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """(name, version, sha256, path) of a registry kept as a folder: ``index.json`` with the
    versions of each package, archives beside it."""
    index = json.load(open(os.path.join(folder, "index.json"), encoding="utf-8"))
    rows = [(n, v, (p.get("checksums") or {}).get(v), os.path.join(folder, n, f"{n}-{v}.tar.gz")) for n, p in sorted(index.items()) for v in p.get("versions", [])]
    return spark.createDataFrame(rows, "name string, version string, sha256 string, path string")


class TableCache:
    """Open tables by path; a path that was written again is opened again."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.open: dict[str, DataFrame] = {}

    def __call__(self, path: str) -> DataFrame:
        if path not in self.open:
            self.open[path] = self.spark.read.parquet(path)
        return self.open[path]

    def forget(self, path: str | None = None) -> None:
        for p in [path] if path else list(self.open):
            df = self.open.pop(p, None)
            if df is not None:
                df.unpersist()
                self.spark.catalog.refreshByPath(p)

"""Reports and texts: comparison, benchmark, diagnostics, answers and prompts."""

from __future__ import annotations

import json
import os
import shutil
import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---- numbers of repeated runs


def timings(runs: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    """Runs, mean, median, least, most and total time per group."""
    s = F.col(seconds)
    return runs.groupBy(*by).agg(
        F.count(s).alias("runs"), F.round(F.avg(s), 6).alias("mean"), F.round(F.median(s), 6).alias("median"), F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.sum(s), 6).alias("total")
    )


def version_counts(bundles: DataFrame) -> DataFrame:
    """(name, versions): how many versions of each package are installed."""
    return bundles.groupBy("name").agg(F.countDistinct("version").alias("versions"))


def removed(bundles: DataFrame, name: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what is left, number of removed versions per scope) when a package or one version goes."""
    hit = F.lower("name") == name.lower()
    if version is not None:
        hit = hit & (F.col("version") == version)
    gone = bundles.where(hit).groupBy("scope").agg(F.countDistinct("version").alias("versions"))
    return bundles.where(~hit), gone


# ---- comparison of graphs


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges in their total order: source, kind, line, column, target."""
    return edges.orderBy("source", "kind", F.asc_nulls_first("line"), F.asc_nulls_first("col"), "target")


def ordered_diffs(diffs: DataFrame, label: str) -> DataFrame:
    """Diffs no rule allows first, then by text."""
    return diffs.orderBy(F.col("rule").isNotNull(), label)


def parity_report(nodes: DataFrame, edges: DataFrame, diffs: DataFrame, node_gate: float = 95.0, call_gate: float = 90.0) -> dict:
    """The report of a comparison: totals, per kind, open diffs, and whether it passes.

    ``nodes`` and ``edges`` come from ``parity.recall`` by kind (one row a kind); ``diffs`` has
    a rule or none.  Without anything to match a recall is null and its gate holds.
    """
    def rows(df):
        return {r["kind"]: {k: r[k] for k in ("golden", "ours", "matched", "missing", "extra", "recall_pct")} for r in df.orderBy("kind").collect()}

    n, e = rows(nodes), rows(edges)
    golden, matched = sum(x["golden"] for x in n.values()), sum(x["matched"] for x in n.values())
    share = 100.0 * matched / golden if golden else None
    calls = e.get("calls", {}).get("recall_pct")
    open_ = diffs.where("rule IS NULL").count()
    return {
        "nodes": n, "edges": e, "node_recall_pct": share, "calls_recall_pct": calls, "open_diffs": open_, "allowed_diffs": diffs.where("rule IS NOT NULL").count(),
        "passed": (share is None or share >= node_gate) and (calls is None or calls >= call_gate),
    }


def exit_code(report: dict | None) -> int:
    """0 if a comparison passed, 1 if not, 2 if there was none."""
    return 2 if report is None else 0 if report["passed"] else 1


def parity_text(report: dict, diffs: DataFrame | None = None, most: int = 20) -> str:
    """A comparison for reading: one line a kind, then the first diffs."""
    def pct(x):
        return "n/a" if x is None else f"{x:.1f} %"

    out = [f"nodes {pct(report['node_recall_pct'])}, calls {pct(report['calls_recall_pct'])}: {'passed' if report['passed'] else 'failed'}"]
    for part in ("nodes", "edges"):
        out += [f"{part} {k}: {v['matched']}/{v['golden']} ({pct(v['recall_pct'])}), {v['missing']} missing, {v['extra']} extra" for k, v in report[part].items()]
    if diffs is not None:
        label = F.concat_ws(" ", *[F.col(c).cast("string") for c in diffs.columns if c != "rule"])
        for r in ordered_diffs(diffs.select(label.alias("_l"), "rule"), "_l").limit(most).collect():
            out.append(f"{'allowed' if r['rule'] is not None else 'open'}: {r['_l']}")
    return "\n".join(out)


# ---- lists for reading


def listing(paths: list[str], total: int, limit: int, pattern: str | None = None) -> str:
    """A list of files with what it leaves out, or why it is empty."""
    if not total:
        return f"No files match '{pattern}'." if pattern else "No files."
    more = total - len(paths)
    return "\n".join([*paths, *([f"... and {more} more"] if more > 0 else [])])


def answer(result: dict) -> str:
    """An answer as Markdown: text, findings with their places, open questions."""
    out = [str(result.get("answer", "")).strip()]
    findings = result.get("findings") or []
    if findings:
        out.append("## Findings")
        for n, f in enumerate(findings, 1):
            place = f.get("file", "")
            if f.get("start_line"):
                place += f":{f['start_line']}" + (f"-{f['end_line']}" if f.get("end_line") else "")
            mark = {True: " (verified)", False: " (not verified)"}.get(f.get("verified"), "")
            out.append(f"{n}. **{f.get('title') or place}**{mark}" + (f" `{place}`" if place else ""))
            if f.get("snippet"):
                out.append("```\n" + str(f["snippet"]).rstrip() + "\n```")
    if result.get("questions"):
        out.append("## Open questions\n" + "\n".join(f"- {q}" for q in result["questions"]))
    return "\n\n".join(x for x in out if x)


def clarification(question: str, options: list[str]) -> str:
    return "\n".join([question.strip(), *[f"{n}. {o}" for n, o in enumerate(options, 1)]])


def finding_files(findings: DataFrame) -> DataFrame:
    """(session, files): the distinct files of each session's findings, in first-seen order."""
    w = Window.partitionBy("session", "file").orderBy("finding")
    first = findings.where(F.coalesce("file", F.lit("")) != "").withColumn("_k", F.row_number().over(w)).where("_k = 1")
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy("finding")))
    return ranked.groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "file"))), lambda x: x["file"]).alias("files"))


def coerced(value) -> dict:
    """Whatever an agent answers as a result: a mapping with text and findings.

    JSON within text is read; anything else becomes the text.  Findings without file and
    text are dropped.
    """
    if isinstance(value, str):
        body = value.strip()
        if body.startswith("```"):
            body = body.strip("`").split("\n", 1)[-1]
        try:
            value = json.loads(body)
        except ValueError:
            return {"answer": str(value), "findings": []}
    if not isinstance(value, dict):
        return {"answer": "" if value is None else str(value), "findings": []}
    found = [f for f in value.get("findings") or [] if isinstance(f, dict) and (f.get("file") or f.get("snippet"))]
    return {"answer": str(value.get("answer") or ""), "findings": found, **{k: v for k, v in value.items() if k not in ("answer", "findings")}}


# ---- prompts


def document_text(model_id: str, title, content):
    """A document as a model wants it: some models are trained with a prefix."""
    name = model_id.lower()
    if "gemma" in name:
        return F.concat(F.lit("title: "), F.coalesce(F.nullif(title, F.lit("")), F.lit("none")), F.lit(" | text: "), content)
    return F.concat(F.lit("passage: "), content) if "e5" in name else content


def query_text(model_id: str, query):
    name = model_id.lower()
    if "gemma" in name:
        return F.concat(F.lit("task: search result | query: "), query)
    if "qwen" in name:
        return F.concat(F.lit("Instruct: Given a search query, find the passages that answer it\nQuery: "), query)
    return F.concat(F.lit("query: "), query) if "e5" in name else query


def rerank_prompt(query, document):
    """The question a yes-or-no scorer answers for one candidate."""
    return F.format_string("Judge whether the document answers the query. Answer yes or no.\nQuery: %s\nDocument: %s\nAnswer:", query, document)


def expansion_prompt(query: str, most: int = 4) -> str:
    return f"Rewrite the search query in at most {most} ways, one a line, each beginning with lex:, vec: or hyde:.\nQuery: {query}\n"


def task_prompt(question: str, packages: list[str], hint: str | None = None) -> str:
    parts = [f"Question: {question.strip()}", "Packages: " + (", ".join(sorted(packages)) or "none")]
    return "\n".join([*parts, *([f"Hint: {hint.strip()}"] if hint else [])])


# ---- the installation itself


def diagnostics(tables: dict[str, DataFrame], folder: str | None = None) -> list[tuple[str, bool, str]]:
    """(what, fine, detail) for the runtime, the tables and the shared folder."""
    out = [("python", sys.version_info >= (3, 10), sys.version.split()[0]), ("java", shutil.which("java") is not None, shutil.which("java") or "not found")]
    for name, df in sorted(tables.items()):
        try:
            out.append((f"table {name}", df.limit(1).count() > 0, ", ".join(df.columns)))
        except Exception as e:  # a table that cannot be read is what is looked for
            out.append((f"table {name}", False, type(e).__name__))
    if folder:
        out.append(("shared folder", os.access(folder.removeprefix("file://"), os.W_OK), folder))
    return out


def reordered(results: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Search results in order of a scorer's scores; those without one keep their order at the end."""
    j = results.join(scores.select(key, F.col("score").alias("_score")), key, "left")
    return j.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("_score"), "rank"))).drop("_score")

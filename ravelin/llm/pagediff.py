"""Nearest-URL page differencing: lines that a page shares with its neighbour.

Pages of a host are paired with the page before them in order of path, their lines are
aligned by longest common subsequence, and shared lines are what templates repeat.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ravelin.session import Cut


def common(a: list[str], b: list[str]) -> set[int]:
    """Positions of ``b`` that lie on a longest common subsequence of non-blank lines.

    Rows of the table are numbers with a bit for each line of ``a``, so long pages stay cheap.
    """
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        if x.strip():
            masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, [full]
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out: set[int] = set()
    i, j = len(a), len(b)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1  # line i adds nothing to the match with the first j lines
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            out.add(j - 1)
            i, j = i - 1, j - 1
    return out


def _beside(pages: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(text, text before on the same host)`` for every page, in order of path.

    The pages are sorted by ranges of host and path, so a host of any size is spread over
    tasks; a task holds one page before the current one.  The first and the last text of
    every range are written beside the results, and the first is then compared with the
    last of the ranges before, so the ranges do not show.  Pages without text are passed
    over; pages without host have none before.
    """
    p = pages.select("host", "path", F.col("item_id").cast("bigint").alias("item_id"), "text")
    p = p.repartitionByRange("host", "path", "item_id").sortWithinPartitions("host", "path", "item_id")
    out = to_arrow_schema(_parse_datatype_string(schema))
    edges = "_range int, _edge int, _host string, _id bigint, _text string"
    both = to_arrow_schema(_parse_datatype_string(f"{schema}, {edges}"))

    def batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * len(kind)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, kind)], schema=kind)

    def run(batches):
        number, last = TaskContext.get().partitionId(), None
        none, plain = (None,) * len(out), (None,) * 5
        for b in batches:
            rows = []
            for h, i, t in zip(b.column("host").to_pylist(), b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                if t is not None and last is None:
                    rows.append((*none, number, 0, h, i, t))
                else:
                    rows.append((i, *fn(t, last[2] if last and h is not None and h == last[0] else None), *plain))
                if t is not None:
                    last = (h, i, t)
            yield batch(rows, both)
        if last:
            yield batch([(*none, number, 1, *last)], both)

    def join(batches):
        for b in batches:
            yield batch([(i, *fn(t, before)) for i, t, before in zip(*(b.column(c).to_pylist() for c in ("_id", "_text", "_before")))], out)

    held = Cut(pages.sparkSession, "pagediff")(p.mapInArrow(run, f"{schema}, {edges}"))
    # Two rows a range; the last text of the nearest range before that has any.
    w = Window.orderBy("_range", "_edge").rowsBetween(Window.unboundedPreceding, -1)
    e = held.where(F.col("_edge").isNotNull()).withColumn("_last", F.last(F.when(F.col("_edge") == 1, F.struct("_host", "_text")), ignorenulls=True).over(w)).where("_edge = 0")
    e = e.select("_id", "_text", F.when(F.col("_last._host") == F.col("_host"), F.col("_last._text")).alias("_before"))
    return held.where(F.col("_edge").isNull()).select(*out.names).unionByName(e.mapInArrow(join, schema))


def _count(t: str | None, before: str | None) -> tuple[int, int]:
    lines = (t or "").split("\n")
    return sum(1 for x in lines if x.strip()), len(common(before.split("\n"), lines)) if before and t else 0


def _rest(t: str | None, before: str | None) -> tuple[str | None]:
    if t is None or not before:
        return (t,)
    lines = t.split("\n")
    drop = common(before.split("\n"), lines)
    return ("\n".join(x for k, x in enumerate(lines) if k not in drop),)


def shared_lines(pages: DataFrame) -> DataFrame:
    """(item_id, lines, shared): lines of each page and how many of them it shares with the
    page before it on its host.  ``pages``: host, path, item_id, text; null texts have no
    lines."""
    return _beside(pages, _count, "item_id bigint, lines int, shared int")


def without_shared(pages: DataFrame) -> DataFrame:
    """(item_id, text): pages without the lines they share with the page before."""
    return _beside(pages, _rest, "item_id bigint, text string")

"""Cutting texts into chunks, windows and symbols, and putting them together again.

The cutters that depend on where the last cut fell work on one text at a time in Arrow
batches; everything else is built-in.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text

CHUNK_BYTES, WINDOW_BYTES, STRIDE_BYTES, BODY_BYTES = 800, 1_500, 750, 12_000
_BREAK = re.compile(rb"\n\n")


def _char_floor(b: bytes, at: int) -> int:
    while 0 < at < len(b) and b[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _char_ceil(b: bytes, at: int) -> int:
    while at < len(b) and b[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(b))


def _line_spans(b: bytes, lo: int, hi: int, most: int) -> list[tuple[int, int]]:
    """Whole lines of a span packed up to ``most`` bytes; longer lines are cut hard."""
    out, at, held = [], lo, lo
    while at < hi:
        nl = b.find(b"\n", at, hi)
        end = hi if nl < 0 else nl + 1
        if end - held > most and at > held:
            out.append((held, at))
            held = at
        if end - at > most:
            while at < end:
                stop = _char_floor(b, min(at + most, end))
                stop = stop if stop > at else end
                out.append((at, stop))
                at = stop
            held = end
        at = end
    if held < hi:
        out.append((held, hi))
    return out


def paragraphs(content: str, most: int = CHUNK_BYTES) -> list[tuple[str, int, int, int, int]]:
    """(chunk, first line, last line, first byte, byte after): paragraphs packed up to
    ``most`` bytes.  Every chunk is an exact part of the text."""
    b = content.encode("utf-8", "surrogatepass")
    spans, lo = [], 0
    for m in [*_BREAK.finditer(b), None]:
        hi = m.start() if m else len(b)
        part = b[lo:hi].decode("utf-8", "surrogatepass")
        inner = part.strip()
        if inner:
            a = lo + len(part[: len(part) - len(part.lstrip())].encode("utf-8", "surrogatepass"))
            spans.append((a, a + len(inner.encode("utf-8", "surrogatepass"))))
        lo = m.end() if m else hi
    cuts: list[tuple[int, int]] = []
    start = end = -1
    for a, z in spans:
        if (start < 0 and z - a <= most) or (start >= 0 and z - start <= most):
            start = a if start < 0 else start
            end = z
            continue
        if start >= 0:
            cuts.append((start, end))
        start = -1
        if z - a <= most:
            start, end = a, z
        else:
            cuts += _line_spans(b, a, z, most)
    if start >= 0:
        cuts.append((start, end))
    if not cuts and b:
        cuts = _line_spans(b, 0, len(b), most)
    out = []
    for a, z in cuts:
        while z > a and b[z - 1] in b"\r\n":
            z -= 1
        if z > a:
            out.append((b[a:z].decode("utf-8", "surrogatepass"), b.count(b"\n", 0, a) + 1, b.count(b"\n", 0, z - 1) + 1, a, z))
    return out


def windows(content: str, size: int = WINDOW_BYTES, stride: int = STRIDE_BYTES) -> list[str]:
    """Overlapping windows that end after a line end; short texts are one window."""
    b = content.encode("utf-8", "surrogatepass")
    if len(b) <= size:
        return [content]

    def after_line(at: int) -> int:
        at = _char_ceil(b, at)
        nl = b.find(b"\n", at)
        return len(b) if at >= len(b) or nl < 0 else nl + 1

    out, at = [], 0
    while True:
        end = after_line(at + size)
        out.append(b[at:end].decode("utf-8", "surrogatepass"))
        nxt = after_line(at + stride)
        if end >= len(b) or nxt <= at:
            return out
        at = nxt


def assemble(parts: list[tuple[int, int, str]], most: int = BODY_BYTES) -> str:
    """Bodies of one document in order of lines as one text: lines seen before are left
    out, gaps are marked, and the whole is cut at ``most`` bytes."""
    text_, seen = "", None
    for start, end, body in parts:
        fresh = body
        if seen is not None and end <= seen:
            continue
        if seen is not None and start <= seen:
            fresh = "\n".join(body.splitlines()[seen - start + 1 :])
            if not fresh.strip():
                seen = max(seen, end)
                continue
        if seen is not None and start > seen + 1:
            text_ += f"\n\n… {start - seen - 1} line(s) omitted …\n\n"
        elif text_ and not text_.endswith("\n"):
            text_ += "\n"
        text_ += fresh.rstrip()
        seen = end if seen is None else max(seen, end)
        raw = text_.encode("utf-8", "surrogatepass")
        if len(raw) >= most:
            return raw[: _char_floor(raw, most)].decode("utf-8", "surrogatepass") + "\n… (truncated)"
    return text_


def chunk(docs: DataFrame, key: str, content: str, most: int = CHUNK_BYTES) -> DataFrame:
    """(key, chunk_index, content, start_line, end_line, start_byte, end_byte)."""

    def run(batches):
        for pdf in batches:
            rows = [(k, n, *c) for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) if t for n, c in enumerate(paragraphs(t, most))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "content", "start_line", "end_line", "start_byte", "end_byte"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, content).mapInPandas(run, f"{key} {kind}, chunk_index int, content string, start_line int, end_line int, start_byte int, end_byte int")


def kwic(docs: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys..., window_index, window) of every text."""

    def run(batches):
        for pdf in batches:
            rows = [(*r[:-1], n, w) for r in pdf.itertuples(index=False, name=None) if r[-1] is not None for n, w in enumerate(windows(r[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, "window_index", "window"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return docs.select(*keys, content).mapInPandas(run, f"{schema}, window_index int, window string")


def merged_bodies(parts: DataFrame, keys: list[str], most: int = BODY_BYTES) -> DataFrame:
    """(keys..., body) from parts with start_line, end_line and content.

    The parts of one result are gathered as an array; a result has as many parts as hits
    were merged into it.
    """
    g = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "content"))).alias("_p"))

    @F.pandas_udf("string")
    def join(p: pd.Series) -> pd.Series:
        return p.map(lambda rows: assemble([(r["start_line"], r["end_line"], r["content"]) for r in rows], most))

    return g.select(*keys, join("_p").alias("body"))


def line_rows(docs: DataFrame, keys: list[str], content: str, first: str | None = None) -> DataFrame:
    """(keys..., line, text): one row per line, numbered from ``first`` (1 if none)."""
    pos = F.posexplode(text.lines(F.col(content))).alias("_p", "text")
    start = F.col(first) if first else F.lit(1)
    return docs.select(*keys, start.alias("_s"), pos).select(*keys, (F.col("_s") + F.col("_p")).cast("int").alias("line"), "text")


def gap_filled(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., line, text) of whole documents: later chunks win, missing lines are empty.

    ``chunks``: keys, chunk_index, start_line, content.
    """
    ln = line_rows(chunks, [*keys, "chunk_index"], "content", "start_line")
    won = ln.groupBy(*keys, "line").agg(F.max_by("text", "chunk_index").alias("text"))
    span = won.groupBy(*keys).agg(F.min("line").alias("_a"), F.max("line").alias("_z"))
    every = span.select(*keys, F.explode(F.sequence("_a", "_z")).alias("line"))
    return every.join(won, [*keys, "line"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def line_range(content, chunk_start, first: int, last: int):
    """Lines ``first`` to ``last`` of a chunk whose first line is ``chunk_start``."""
    ln = text.lines(content)
    a = F.greatest(F.lit(first) - chunk_start, F.lit(0)) + 1
    n = F.lit(last) - F.greatest(chunk_start, F.lit(first)) + 1
    return F.when(n > 0, F.array_join(F.slice(ln, a, n), "\n")).otherwise("")


#: Words that begin a definition, with its kind, and words that may stand before (fixed values).
KEYWORDS = {
    "fn": "function", "async fn": "function", "const fn": "function", "unsafe fn": "function", 'extern "C" fn': "function", "struct": "struct", "enum": "enum",
    "trait": "trait", "impl": "impl", "type": "type", "mod": "module", "def": "function", "async def": "function", "class": "class", "function": "function",
    "function*": "function", "async function": "function", "interface": "interface", "func": "function", "record": "class",
}
MODIFIERS = ["pub(crate)", "pub(super)", "pub(in", "pub", "private", "protected", "public", "static", "abstract", "final", "override", "export default", "export", "extern", "inline", "virtual", "async"]
_DEF = (
    r"^\s*(?:(?:" + "|".join(re.escape(m) for m in MODIFIERS) + r") )*("
    + "|".join(re.escape(k) for k in sorted(KEYWORDS, key=len, reverse=True)) + r") +([\p{L}_][\p{L}\p{N}_]*)"
)


def scanned_symbols(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., symbol, kind, start_line, end_line): definitions found by keyword.

    A definition ends on the line before the next one of the same text.
    """
    kinds = F.create_map(*[F.lit(x) for kv in KEYWORDS.items() for x in kv])
    last = lines.groupBy(*keys).agg(F.max("line").alias("_last"))
    hit = lines.where(F.col("text").rlike(_DEF)).select(*keys, "line", F.regexp_extract("text", _DEF, 1).alias("_k"), F.regexp_extract("text", _DEF, 2).alias("symbol"))
    w = Window.partitionBy(*keys).orderBy("line")
    h = hit.withColumn("_next", F.lead("line").over(w)).join(last, keys)
    return h.select(*keys, "symbol", F.element_at(kinds, F.col("_k")).alias("kind"), F.col("line").alias("start_line"), F.coalesce(F.col("_next") - 1, F.col("_last")).cast("int").alias("end_line"))


#: Beginnings of comment lines (fixed values).
COMMENT = r"^\s*(//|#(?!include|define)|/\*|\*|--|;|\"\"\")"
#: Bodies above this many bytes are cut into windows.
SYMBOL_BYTES = 8_192


_COMMENT = re.compile(COMMENT)


def around(lines: list[str], start: int, end: int) -> tuple[int, int]:
    """First and last line (from 1) of a symbol with its comments: the run of comment lines
    above it, in which one blank line may stand, and those right below it."""
    first, k, blanks = start, start - 1, 0
    while k > 0 and blanks < 2:
        line = lines[k - 1]
        if not line.strip():
            blanks += 1
        elif _COMMENT.match(line):
            first = k
        else:
            break
        k -= 1
    last = end
    while last < len(lines) and _COMMENT.match(lines[last]):
        last += 1
    return first, last


def symbol_bodies(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, first_line, last_line, signature, body): the lines of every symbol with the
    comments around it; ``signature`` is its first line of code.

    ``symbols``: id, path, start_line, end_line; ``files``: path, content.  The symbols of a
    file meet its text once, in one row.
    """
    at = symbols.groupBy("path").agg(F.collect_list(F.struct("id", "start_line", "end_line")).alias("_s"))
    j = files.select("path", "content").where("content IS NOT NULL").join(at, "path").select("content", "_s")

    def run(batches):
        for pdf in batches:
            rows = []
            for text_, found in zip(pdf["content"], pdf["_s"]):
                lines = text_.replace("\r\n", "\n").split("\n")
                for s in found:
                    start, end = s["start_line"], min(s["end_line"], len(lines))
                    if not 0 < start <= end:
                        continue
                    first, last = around(lines, start, end)
                    code = next((x.strip() for x in lines[start - 1 : end] if x.strip()), "")
                    rows.append((s["id"], first, last, code, "\n".join(lines[first - 1 : last])))
            yield pd.DataFrame(rows, columns=["id", "first_line", "last_line", "signature", "body"])

    return j.mapInPandas(run, "id string, first_line int, last_line int, signature string, body string")


def long_bodies(bodies: DataFrame, most: int = SYMBOL_BYTES) -> DataFrame:
    """(id, part, content): bodies above ``most`` bytes in parts of whole lines."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["body"]):
                b = (t or "").encode("utf-8", "surrogatepass")
                spans = [(0, len(b))] if len(b) <= most else _line_spans(b, 0, len(b), most)
                rows += [(i, n, b[a:z].decode("utf-8", "surrogatepass")) for n, (a, z) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["id", "part", "content"])

    return bodies.select("id", "body").mapInPandas(run, "id string, part int, content string")

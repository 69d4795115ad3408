"""Splitting oversized items at natural boundaries by lexical cohesion.

At every natural boundary (paragraph, line, sentence) the words before and after it are
compared; a valley of this similarity marks a change of topic.  Each piece ends at the
deepest valley within its size window, and the next piece starts ``overlap`` characters
before that end, so consecutive pieces share exactly that many characters.
"""

from __future__ import annotations

import re
from collections import Counter
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.batches import map_batches

SIZE, OVERLAP = 1_600, 160
#: Words on either side of a boundary that are compared.
BLOCK = 40
#: A cut is looked for in the last part of the window, beyond this share of it.
LEAST_FILL = 0.5
#: What the kind of boundary adds to the depth of its valley.
TIER = {3: 0.6, 2: 0.3, 1: 0.15}

_GAP = re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*|\r\n|\n|\r|(?<=[.!?;])[ \t]+|(?<=[。！？；])")
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s+")


def _gaps(text: str) -> list[tuple[int, int]]:
    """(position, tier) of the natural boundaries: 3 paragraph, 2 line, 1 sentence."""
    out = []
    for m in _GAP.finditer(text):
        s = m.group()
        n = s.count("\n") + s.count("\r") - s.count("\r\n")
        out.append((m.end(), 3 if n > 1 else 2 if n else 1))
    return out


def _depths(text: str, gaps: list[tuple[int, int]]) -> list[float]:
    """How deep the valley of similarity is at each gap."""
    words, starts = [], []
    for m in _WORD.finditer(text.lower()):
        words.append(m.group())
        starts.append(m.start())
    sims, k = [], 0
    for at, _ in gaps:
        while k < len(starts) and starts[k] < at:
            k += 1
        a, b = Counter(words[max(0, k - BLOCK) : k]), Counter(words[k : k + BLOCK])
        if not a or not b:
            sims.append(0.0)
            continue
        if len(b) < len(a):
            a, b = b, a
        dot = sum(n * b[w] for w, n in a.items() if w in b)
        sims.append(dot / sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())))
    out = []
    for i, s in enumerate(sims):
        j, left = i, s
        while j > 0 and sims[j - 1] >= left:
            j -= 1
            left = sims[j]
        j, right = i, s
        while j + 1 < len(sims) and sims[j + 1] >= right:
            j += 1
            right = sims[j]
        out.append((left - s) + (right - s))
    return out


def _hard(text: str, start: int, end: int, floor: int) -> int:
    """A cut where nothing natural is: at a blank if there is one, never inside a line end
    or before a combining mark."""
    blanks = [m.end() for m in _SPACE.finditer(text, floor, end) if m.end() <= end]
    if blanks:
        return blanks[-1]
    from unicodedata import combining

    while end > floor and (combining(text[end]) or text[end] == "‍" or text[end - 1] == "‍" or text[end - 1 : end + 1] == "\r\n"):
        end -= 1
    return end


def pieces(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, content) of the pieces; a text of at most ``size`` stays whole.

    Every piece has at most ``size`` code points, each next one starts ``overlap`` before
    the end of the one before, and together they are the text.
    """
    if len(text) <= size:
        return [(0, len(text), text)]
    gaps = _gaps(text)
    depth = _depths(text, gaps)
    out, start, k = [], 0, 0
    while len(text) - start > size:
        floor = start + max(int(size * LEAST_FILL), overlap + 1)
        limit = start + size
        while k < len(gaps) and gaps[k][0] < floor:
            k += 1
        best, cut, j = -1.0, 0, k
        while j < len(gaps) and gaps[j][0] <= limit:
            score = depth[j] + TIER[gaps[j][1]] + 1e-6 * (gaps[j][0] - start)
            if score > best:
                best, cut = score, gaps[j][0]
            j += 1
        if not cut:
            cut = _hard(text, start, limit, floor)
        out.append((start, cut, text[start:cut]))
        start = cut - overlap
    out.append((start, len(text), text[start:]))
    return out


def split(items: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of ``items`` (item_kind, item_id, content): adds piece, n_pieces, start, end.

    Null contents give no row, empty ones a single empty piece; repeated items count
    once.  Texts are split where they are read.
    """

    def run(kind, item, content) -> list:
        out: list[list] = [[] for _ in range(7)]
        seen = set()
        for a, b, t in zip(kind, item, content):
            if t is None or (a, b) in seen:
                continue
            seen.add((a, b))
            p = pieces(t, size, overlap)
            for n, (s, e, c) in enumerate(p):
                for column, v in zip(out, (a, b, n, len(p), s, e, c)):
                    column.append(v)
        return out

    schema = "item_kind string, item_id bigint, piece int, n_pieces int, start int, end int, content string"
    return map_batches(items.select("item_kind", F.col("item_id").cast("bigint").alias("item_id"), "content"), run, schema)

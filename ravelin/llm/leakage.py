"""Evaluation texts leaking into training text, by latent semantic retrieval.

Texts are cut into overlapping passages.  Their TF-IDF vectors are projected to the
leading singular directions, found by a distributed randomised SVD (subspace iteration)
over all documents.  Passages near a passage of a test item are candidates, and only
candidate pairs reach the comparison by longest common subsequence that tells paraphrases.
Runs of consecutive words are looked up for all pairs, so no exact leak depends on the
directions.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.session import Cut

#: Consecutive words of an item that make a leak; passages are two such blocks long.
RUN = 13
#: Words are hashed to this many TF-IDF dimensions, projected to RANK of them.
DIMENSIONS, RANK = 1 << 15, 64
ITERATIONS = 2
#: Cosine from which a passage is a candidate, and from which its LCS is taken.
CANDIDATE, CLOSE = 0.50, 0.70
#: Share of an item passage's words in the longest common subsequence of a paraphrase, if
#: all its numbers (the answers of these items) are found too, and if it has none.
PARAPHRASE, PARAPHRASE_BARE = 0.6, 0.8
#: Item passages compared at a time, and held in one broadcast; more are searched in turns.
BLOCK, TURN = 2_048, 50_000

_WORD = re.compile(r"[^\W_]+")
_FORMAT = {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"}
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC, without format characters, in lower case."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_FORMAT)
    return _WORD.findall(text.lower())


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) - (1 << 31)
        return h


def tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, words): every word of a text as a 32-bit hash; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Hashes().__getitem__
        for b in batches:
            rows = [[look(w) for w in words(t)] for t in b.column(1).to_pylist()]
            ends = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) for r in rows], out=ends[1:])
            flat = np.fromiter((x for r in rows for x in r), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "words"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, words array<int>")


def _lists(b: pa.RecordBatch, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ends, words) of slices of a batch with about ``most`` words each."""
    ids = b.column(0).to_numpy(zero_copy_only=False)
    col = b.column(1)
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield ids[i:j], off[i : j + 1] - off[i], flat[off[i] : off[j]]
        i = j


def blocks(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every block of RUN words, and the text it lies in; the last may be shorter."""
    size = np.diff(ends)
    n = -(-size // RUN)
    owner = np.repeat(np.arange(len(size)), n)
    first = np.cumsum(n) - n
    return ends[:-1][owner] + RUN * (np.arange(int(n.sum())) - first[owner]), owner


def _bucket(w: np.ndarray) -> np.ndarray:
    return (w.astype(np.int64) & (DIMENSIONS - 1)).astype(np.int64)


def passages(ends: np.ndarray, flat: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of ``table`` rows over each passage (a block and the next one), and its text."""
    if not len(flat):
        return np.zeros((0, table.shape[1]), dtype=np.float32), np.zeros(0, dtype=np.int64)
    start, owner = blocks(ends)
    v = np.add.reduceat(table[_bucket(flat)], start, axis=0)
    both = v.copy()
    follows = owner[1:] == owner[:-1]
    both[:-1][follows] += v[1:][follows]
    # The last block of a longer text is within the passage before it.
    alone = np.ones(len(owner), dtype=bool)
    alone[1:][follows] = False
    last = np.ones(len(owner), dtype=bool)
    last[:-1][follows] = False
    keep = ~last | alone
    return both[keep], owner[keep]


def frequencies(tok: DataFrame) -> np.ndarray:
    """Texts in which each dimension occurs, over all texts: one number a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(DIMENSIONS + 1, dtype=np.int64)
        for b in batches:
            for ids, ends, flat in _lists(b):
                owner = np.repeat(np.arange(len(ids), dtype=np.int64), np.diff(ends))
                n[:-1] += np.bincount(np.unique(owner * DIMENSIONS + _bucket(flat)) % DIMENSIONS, minlength=DIMENSIONS)
                n[-1] += len(ids)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["dimension", "n"])

    rows = tok.mapInArrow(run, "dimension bigint, n bigint").groupBy("dimension").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for r in rows:
        out[r[0]] = r[1]
    return out


def directions(spark: SparkSession, tok: DataFrame, idf: np.ndarray, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors of all TF-IDF passages (DIMENSIONS x RANK).

    A round multiplies by A'A where the rows are; the partial products, one for each of a
    fixed number of tasks, are added up by row blocks in the cluster, so the driver sees one
    matrix of fixed size.
    """
    held_rows = tok.coalesce(max(8, 2 * spark.sparkContext.defaultParallelism))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((DIMENSIONS, RANK)))[0].astype(np.float32)
    rows = 512
    for _ in range(ITERATIONS):
        held = spark.sparkContext.broadcast((q * idf[:, None]).astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table = held.value
            out = np.zeros((DIMENSIONS, RANK), dtype=np.float32)
            for b in batches:
                for _, ends, flat in _lists(b):
                    v, _ = passages(ends, flat, table)
                    if not len(v):
                        continue
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    start, owner = blocks(ends)
                    # Each block adds its passages' vectors to the rows of its words.
                    own = np.zeros((len(start), RANK), dtype=np.float32)
                    follows = owner[1:] == owner[:-1]
                    single = np.ones(len(owner), dtype=bool)
                    single[1:][follows] = False
                    last = np.ones(len(owner), dtype=bool)
                    last[:-1][follows] = False
                    keep = np.flatnonzero(~last | single)
                    own[keep] += v
                    pair = keep[~last[keep]]
                    own[pair + 1] += v[~last[keep]]
                    size = np.diff(np.append(start, ends[-1]))
                    w = _bucket(flat)
                    order = np.argsort(w, kind="stable")
                    names, first = np.unique(w[order], return_index=True)
                    out[names] += np.add.reduceat(np.repeat(own, size, axis=0)[order], first, axis=0)
            parts = [out[i : i + rows].tobytes() for i in range(0, DIMENSIONS, rows)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "sums"])

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, dtype=np.float32) for x in t.column("sums").to_pylist())
            return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        parts = held_rows.mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").collect()
        y = np.zeros((DIMENSIONS, RANK), dtype=np.float64)
        for r in parts:
            y[r["part"] * rows : (r["part"] + 1) * rows] = np.frombuffer(r["sums"], dtype=np.float32).reshape(-1, RANK)
        q = np.linalg.qr(y * idf[:, None])[0].astype(np.float32)
    return q


def grams(ends: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of RUN words and where it starts."""
    n = len(flat) - RUN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    w = flat.astype(np.int64).astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(RUN):
        h = h * _BASE + w[j : j + n]
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.flatnonzero(owner[:n] == owner[RUN - 1 :])
    return h[at], at


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, with one bit a word of ``a``."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


class Items:
    """The test items, ready for comparison: passages, runs of words and their places."""

    def __init__(self, ids: list[int], texts: list[list[int]], table: np.ndarray, numbers: frozenset[int] = frozenset()):
        self.numbers = numbers
        self.ids = np.array(ids, dtype=np.int64)
        self.ends = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=self.ends[1:])
        self.flat = np.array([x for t in texts for x in t], dtype=np.int32)
        v, self.owner = passages(self.ends, self.flat, table)
        self.vectors = _unit(v)
        self.first = self._firsts()
        h, at = grams(self.ends, self.flat)
        item = np.repeat(np.arange(len(texts)), np.diff(self.ends))[at] if len(at) else at
        order = np.argsort(h, kind="stable")
        self.grams, self.gram_item, self.gram_at = h[order], item[order], at[order]

    def _firsts(self) -> np.ndarray:
        start, owner = blocks(self.ends)
        follows = np.zeros(len(owner), dtype=bool)
        follows[1:] = owner[1:] == owner[:-1]
        last = np.ones(len(owner), dtype=bool)
        last[:-1] = owner[1:] != owner[:-1]
        return start[~last | ~follows]


RESULT = "doc_id bigint, item_id bigint, cosine double, longest_run int, lcs_share double, kind string"


def _search(table: np.ndarray, it: Items, ids: np.ndarray, ends: np.ndarray, flat: np.ndarray, near: float, exact_only: bool) -> list[tuple]:
    v, owner = passages(ends, flat, table)
    if not len(v) or not len(it.vectors):
        return []
    v = _unit(v)
    # Runs of consecutive words, of all pairs.
    h, at = grams(ends, flat)
    runs: dict[tuple[int, int], int] = {}
    if len(h) and len(it.grams):
        lo, hi = np.searchsorted(it.grams, h, "left"), np.searchsorted(it.grams, h, "right")
        doc_of = np.repeat(np.arange(len(ids)), np.diff(ends))
        chain: dict[tuple[int, int], int] = {}
        for g in np.flatnonzero(hi > lo):
            p = int(at[g])
            doc = int(doc_of[p])
            for x in range(int(lo[g]), int(hi[g])):
                item, q = int(it.gram_item[x]), int(it.gram_at[x])
                if not np.array_equal(flat[p : p + RUN], it.flat[q : q + RUN]):
                    continue
                n = chain[p, q] = chain.get((p - 1, q - 1), RUN - 1) + 1
                if n > runs.get((doc, item), 0):
                    runs[doc, item] = n
    wanted = np.array([doc * len(it.ids) + item for doc, item in runs], dtype=np.int64)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    pairs: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    for lo in range(0, len(it.vectors), BLOCK):
        s = v @ it.vectors[lo : lo + BLOCK].T
        a, b = np.nonzero(s >= near)
        if not len(a):
            continue
        key = owner[a].astype(np.int64) * len(it.ids) + it.owner[lo + b]
        if exact_only:
            # Of the candidates only those with a verified run go on.
            held = np.isin(key, wanted)
            a, b, key = a[held], b[held], key[held]
            if not len(a):
                continue
        val = s[a, b]
        order = np.lexsort((-val, key))
        k = key[order]
        lead = np.ones(len(k), dtype=bool)
        lead[1:] = k[1:] != k[:-1]
        for x, o in zip(k[lead], order[lead]):
            doc, item = divmod(int(x), len(it.ids))
            if best.get((doc, item), (-1.0,))[0] < val[o]:
                best[doc, item] = (float(val[o]), int(a[o]), int(lo + b[o]))
        if not exact_only:
            for o in np.flatnonzero(val >= CLOSE):
                pairs.setdefault(divmod(int(key[o]), len(it.ids)), []).append((float(val[o]), int(a[o]), int(lo + b[o])))
    for doc, item in runs.keys() - best.keys():
        a, b = np.flatnonzero(owner == doc), np.flatnonzero(it.owner == item)
        s = v[a] @ it.vectors[b].T
        x, y = np.unravel_index(int(s.argmax()), s.shape)
        best[doc, item] = (float(s[x, y]), int(a[x]), int(b[y]))
    if not best:
        return []
    out = []
    start, _ = blocks(ends)
    follows = np.zeros(len(start), dtype=bool)
    blk_owner = np.repeat(np.arange(len(ids)), -(-np.diff(ends) // RUN))
    follows[1:] = blk_owner[1:] == blk_owner[:-1]
    last = np.ones(len(start), dtype=bool)
    last[:-1] = blk_owner[1:] != blk_owner[:-1]
    firsts = start[~last | ~follows]

    def judged(cos: float, a: int, b: int, doc: int, item: int) -> tuple[bool, float, float]:
        mine = it.flat[it.first[b] : min(it.first[b] + 2 * RUN, it.ends[item + 1])].tolist()
        theirs = flat[firsts[a] : min(firsts[a] + 3 * RUN, ends[doc + 1])].tolist()
        share = lcs(mine, theirs) / max(len(mine), 1)
        answers = set(mine) & it.numbers
        least = PARAPHRASE if answers else PARAPHRASE_BARE
        return share >= least and len(mine) >= RUN and answers <= set(theirs), share, cos

    for (doc, item), (cos, a, b) in best.items():
        run = runs.get((doc, item), 0)
        if exact_only:
            if run:
                out.append((int(ids[doc]), int(it.ids[item]), cos, run, 1.0, "exact"))
            continue
        if not run and cos < CLOSE:
            continue
        # The pair that passes, of these the one with the greatest share, then cosine.
        passes, share, cos = max(judged(*x, doc, item) for x in pairs.get((doc, item), [(cos, a, b)]))
        if run or passes:
            out.append((int(ids[doc]), int(it.ids[item]), cos, run, share, "exact" if run else "paraphrase"))
    return out


def leaks(spark: SparkSession, documents: DataFrame, items: DataFrame, near: float = CANDIDATE, exact_only: bool = False) -> DataFrame:
    """(doc_id, item_id, cosine, longest_run, lcs_share, kind) of documents that hold
    passages of test items.

    ``kind`` is ``exact`` for at least RUN consecutive words and ``paraphrase`` for a near
    passage whose longest common subsequence covers most of the item's; all passages with a
    cosine of CLOSE are compared, and ``cosine`` and ``lcs_share`` are of the best.  ``longest_run``
    is 0 below RUN.  The items are the stated query set; every document is compared with
    all of them; ``near`` is the cosine from which pairs without such a run are looked at.  Null and empty texts leak nothing; repeated documents keep their rows.
    """
    cut = Cut(spark, "leakage")
    tok = cut(tokens(documents))
    n = frequencies(tok)
    idf = np.log1p(n[-1] / (1.0 + n[:-1])).astype(np.float32)
    q = directions(spark, tok, idf)
    table = (q * idf[:, None]).astype(np.float32)
    look = _Hashes()
    numbers: set[int] = set()
    rows = []
    for r in items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").dropDuplicates(["item_id"]).toLocalIterator():
        w = words(r["text"])
        numbers.update(look[x] for x in w if x.isdigit())
        rows.append((r["item_id"], [look[x] for x in w]))
    turns, held, size = [], [], 0
    for r in rows:
        held.append(r)
        size += len(r[1]) // RUN + 1
        if size >= TURN:
            turns.append(held)
            held, size = [], 0
    turns.append(held)
    found = None
    for t in turns:
        it = spark.sparkContext.broadcast((table, Items([i for i, _ in t], [w for _, w in t], table, frozenset(numbers))))

        def run(batches: Iterator[pa.RecordBatch], it=it) -> Iterator[pa.RecordBatch]:
            tab, own = it.value
            for b in batches:
                for ids, ends, flat in _lists(b):
                    rows = _search(tab, own, ids, ends, flat, near, exact_only)
                    cols = list(zip(*rows)) if rows else [[]] * 6
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(cols, types)], names=["doc_id", "item_id", "cosine", "longest_run", "lcs_share", "kind"])

        part = tok.mapInArrow(run, RESULT)
        found = part if found is None else found.unionByName(part)
    return found

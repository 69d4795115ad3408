"""Inverted lists of a chunk table, and the best chunks of many queries over them.

Pairs of a query and a chunk are never rows: lists are arrays, tasks score the chunks of a
cell of parts against all queries and give out only the best of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text
from ravelin.session import Cut

K1, B = 1.2, 0.75
#: Tokens after which a part is closed, tokens and chunks of a cell, queries of a turn.
PART_TOKENS, CELL_TOKENS, CELL_CHUNKS, TURN = 3_000_000, 40_000_000, 1 << 17, 1 << 20
#: Chunks scored at once, and the share of them from which a term's gains are kept as a full row.
BLOCK, DENSE, WIDTH = 16_384, 8, 128
#: So many terms are sent to all tasks instead of being joined by a shuffle.
FEW_TERMS = 500_000


def lists(chunks: DataFrame, key: str, content: str) -> DataFrame:
    """(term, part, n, nums, tfs, keys): for each part of the table a row for each term, with
    the numbers of its ``n`` chunks within the part and how often each holds the term; and a
    row without term, with the keys of all chunks of the part and their lengths in ``tfs``.

    A chunk that is repeated counts once (of texts with equal keys the least is taken).
    """
    t = chunks.select(F.col(key).alias("key"), F.col(content).alias("c")).repartition("key").sortWithinPartitions("key", "c")
    kind = t.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last = TaskContext.get().partitionId() << 32, False, None
        words, pairs, keys, lengths = {}, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            held, tf = np.unique(np.concatenate(pairs), return_counts=True)
            ends = np.concatenate([[0], np.flatnonzero(np.diff(held >> 32)) + 1, [len(held)]][: 3 if len(held) else 1]).astype(np.int32)
            own, count = pa.concat_arrays(keys), len(ends) - 1
            both = [
                (pa.array(list(words), pa.string()), np.diff(ends), pa.ListArray.from_arrays(ends, (held & 0xFFFFFFFF).astype(np.int32)), pa.ListArray.from_arrays(ends, tf.astype(np.int32)), pa.nulls(count, pa.list_(own.type))),
                (pa.nulls(1, pa.string()), [len(own)], pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(np.array([0, len(own)], np.int32), np.concatenate(lengths)), pa.ListArray.from_arrays(np.array([0, len(own)], np.int32), own)),
            ]
            for term, n, nums, tfs, ks in both:
                yield pa.RecordBatch.from_arrays([term, pa.array([part] * len(term), pa.int64()), pa.array(n, pa.int32()), nums, tfs, ks], ["term", "part", "n", "nums", "tfs", "keys"])

        for b in batches:
            fresh = []
            for i, x in enumerate(b.column(0).to_pylist()):
                if not seen or x != last:
                    fresh.append(i)
                seen, last = True, x
            if not fresh:
                continue
            b = b.take(pa.array(fresh)) if len(fresh) < b.num_rows else b
            size = pc.list_value_length(b.column(1)).to_numpy().astype(np.int32)
            flat = b.column(1).flatten().dictionary_encode()
            code = np.array([words.setdefault(w, len(words)) for w in flat.dictionary.to_pylist()], np.int64)[flat.indices.to_numpy()]
            number = np.repeat(np.arange(len(size)) + sum(map(len, lengths)), size)
            pairs.append(code << 32 | number)
            keys.append(b.column(0))
            lengths.append(size)
            if sum(map(len, pairs)) >= PART_TOKENS:
                yield from close()
                part, words, pairs, keys, lengths = part + 1, {}, [], [], []
        if keys:
            yield from close()

    return t.select("key", text.tokens(F.col("c")).alias("t")).mapInArrow(run, f"term string, part bigint, n int, nums array<int>, tfs array<int>, keys array<{kind}>")


def asked(cut: Cut, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, words) of queries (query_id, query_text), the words each once and in order
    with a blank between, and the table (term) of all words.  Queries without words are left out."""
    q = queries.groupBy("query_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(text.tokens(F.col("query_text")))))), " ").alias("words"))
    q = cut(q.where("words <> ''"))
    return q, cut(q.select(F.explode(F.split("words", " ")).alias("term")).distinct())


def only(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose term is in ``terms``, with its columns."""
    return df.join(F.broadcast(terms) if terms.count() <= FEW_TERMS else terms, "term")


def best(cut: Cut, held: DataFrame, q: DataFrame, terms: DataFrame, key: str, k: int) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best chunks of every query by BM25, ties by key.

    ``held`` has written lists, ``q`` and ``terms`` are from ``asked``.  Only one row a
    part reaches the driver.
    """
    spark = held.sparkSession
    docs = held.where("term IS NULL")
    parts = docs.select("part", "n", F.aggregate("tfs", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tokens")).collect()
    chunks, tokens = sum(r["n"] for r in parts), sum(r["tokens"] for r in parts)
    kind = held.schema["keys"].dataType.elementType.simpleString()
    # The largest parts first, each to the cell that has least so far.
    load = [0] * max(-(-tokens // CELL_TOKENS), -(-chunks // CELL_CHUNKS), min(spark.sparkContext.defaultParallelism, chunks // 4096), 1)
    cells = [(-1, 0)]
    for r in sorted(parts, key=lambda r: (-r["n"], r["part"])):
        cells.append((r["part"], load.index(min(load))))
        load[cells[-1][1]] += r["n"]
    where = F.broadcast(spark.createDataFrame(cells, "part bigint, cell int"))
    df = only(held.where("term IS NOT NULL").select("term", "n"), terms).groupBy("term").agg(F.sum("n").alias("df"))
    idf = cut(df.select("term", F.log(1 + (chunks - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    asks = cut(q.select("words").distinct())
    turns = -(-asks.count() // TURN) or 1
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    left = only(held.where("term IS NOT NULL"), idf).select("part", "term", "idf", "nums", "tfs", "keys").unionByName(docs.select("part", "term", none("idf", "double"), "nums", "tfs", "keys")).join(where, "part")
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), none("words", "string"))
    right = asks.select("words", F.pmod(F.xxhash64("words"), F.lit(turns)).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(len(load) - 1))).alias("cell"))
    right = right.select(none("part", "bigint"), none("term", "string"), none("idf", "double"), none("nums", "array<int>"), none("tfs", "array<int>"), none("keys", f"array<{kind}>"), "cell", "turn", "words")
    both = left.unionByName(right).withColumn("at", (F.col("cell") * turns + F.col("turn")).cast("int")).drop("cell", "turn").repartitionById(len(load) * turns, "at")
    scored = both.mapInArrow(_scorer(tokens / max(chunks, 1), k), f"words string, `{key}` {kind}, score double")
    w = Window.partitionBy("words").orderBy(F.desc("score"), key)
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return q.join(ranked, "words").select("query_id", key, "score", "rank")


def _scorer(avg: float, k: int):
    """A function over the batches of one cell: (words, key, score) of the best ``k`` of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        docs, terms, asks = (t.filter(pc.is_valid(t[c])) for c in ("keys", "term", "words"))
        if not (docs.num_rows and terms.num_rows and asks.num_rows):
            return
        whole = lambda c: pa.concat_arrays(c.chunks)
        # Chunks go by length, as short ones score highest; their rank by key settles ties.
        keys, dl = whole(pc.list_flatten(docs["keys"])), pc.list_flatten(docs["tfs"]).to_numpy().astype(np.float64)
        by_key = pc.array_sort_indices(keys, null_placement="at_start").to_numpy()
        rank = np.empty(len(keys), np.int64)
        rank[by_key] = np.arange(len(keys))
        order = np.lexsort((rank, dl))
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        dl, rank = dl[order], rank[order]
        size = pc.list_value_length(docs["keys"]).to_numpy()
        part = docs["part"].to_numpy()
        sort = np.argsort(part)
        base = (np.cumsum(size) - size)[sort][np.searchsorted(part[sort], terms["part"].to_numpy())]
        # Gains by term, then place.
        vocabulary = pa.array(sorted(pc.unique(terms["term"]).to_pylist()))
        size = pc.list_value_length(terms["nums"]).to_numpy()
        at = place[pc.list_flatten(terms["nums"]).to_numpy() + np.repeat(base, size)]
        tf = pc.list_flatten(terms["tfs"]).to_numpy().astype(np.float64)
        gain = np.repeat(terms["idf"].to_numpy(), size) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at] / avg))
        at |= np.repeat(pc.index_in(terms["term"], vocabulary).to_numpy().astype(np.int64), size) << 32
        sort = np.argsort(at)
        at, gain = at[sort], gain[sort]
        # Queries in order of their words, so neighbours share sums; words that are not here add nothing.
        words = whole(asks["words"])
        words = words.take(pc.array_sort_indices(words))
        split = pc.split_pattern(words, " ")
        code = pc.index_in(split.flatten(), vocabulary).fill_null(-1).to_numpy()
        owner = np.repeat(np.arange(len(words)), pc.list_value_length(split).to_numpy())[code >= 0]
        code = code[code >= 0].astype(np.int64)
        size = np.bincount(owner, minlength=len(words))
        first = np.cumsum(size) - size
        flat = code.tolist()
        lists = [flat[a : a + n] for a, n in zip(first.tolist(), size.tolist())]

        most = np.maximum.reduceat(gain, np.searchsorted(at, np.arange(len(vocabulary)) << 32))
        # Scores have six places; sums of single precision are wrong by less than this.
        slack = (size + 2) * 2.0**-23 * np.bincount(owner, most[code], len(words)) + 1e-6
        score, ranks = np.full((len(words), k), -np.inf), np.full((len(words), k), len(keys), np.int64)
        tiny = float(np.finfo(np.float32).tiny)
        least = np.full(len(words), tiny)

        def settle(found: list[tuple[int, np.ndarray]]) -> None:
            """Exact scores of pairs that may be among the best."""
            q, p = np.repeat([i for i, _ in found], [len(x) for _, x in found]), np.concatenate([x for _, x in found])
            s = np.zeros(len(q))
            for j in range(size[q].max()):
                on = np.flatnonzero(size[q] > j)
                want = code[first[q[on]] + j] << 32 | p[on]
                hit = np.minimum(np.searchsorted(at, want), len(at) - 1)
                s[on] += np.where(at[hit] == want, gain[hit], 0.0)
            own = np.unique(q)
            q, s, r = np.concatenate([q, np.repeat(own, k)]), np.concatenate([np.round(s, 6), score[own].ravel()]), np.concatenate([rank[p], ranks[own].ravel()])
            o = np.lexsort((r, -s, q))
            start = np.searchsorted(q[o], own)
            o = o[start[:, None] + np.arange(k)]
            score[own], ranks[own] = s[o], r[o]
            least[own] = np.maximum(score[own, -1] - slack[own], tiny)

        for lo in range(0, len(keys), BLOCK):
            width = min(BLOCK, -(-(len(keys) - lo) // WIDTH) * WIDTH)
            a, z = (np.searchsorted(at, (np.arange(len(vocabulary)) << 32) + x) for x in (lo, lo + width))
            rows, peak = {}, np.zeros(len(vocabulary))
            for c in np.flatnonzero(z > a).tolist():
                spots, g = (at[a[c] : z[c]] & 0xFFFFFFFF) - lo, gain[a[c] : z[c]].astype(np.float32)
                peak[c] = g.max()
                if len(spots) * DENSE >= width:
                    rows[c] = np.zeros(width, np.float32)
                    rows[c][spots] = g
                else:
                    rows[c] = (spots, g)
            able = np.flatnonzero((size > 0) & (np.bincount(owner, peak[code], len(words)) >= least))
            tops, sums, highs, before = peak.tolist(), [], [], []
            buffers: list[np.ndarray] = []
            found, pending = [], 0
            column = np.empty(WIDTH, np.float32)
            for i, floor, off in zip(able.tolist(), least[able].tolist(), slack[able].tolist()):
                own, d = [c for c in lists[i] if c in rows], 0
                for x, y in zip(own, before):
                    if x != y:
                        break
                    d += 1
                del sums[d:], highs[d:]
                before = own[:d]
                while d < len(own):
                    if d and floor > tiny:
                        if highs[-1] is None:
                            highs[-1] = float(sums[-1].max())
                        if highs[-1] + sum(tops[c] for c in own[d:]) < floor:
                            break
                    row = rows[own[d]]
                    if d == len(buffers):
                        buffers.append(np.empty(width, np.float32))
                    to = buffers[d]
                    if isinstance(row, tuple):
                        if d:
                            np.copyto(to, sums[-1])
                            to[row[0]] += row[1]
                        else:
                            to.fill(0)
                            to[row[0]] = row[1]
                    elif d:
                        np.add(sums[-1], row, out=to)
                    else:
                        to = row
                    sums.append(to)
                    highs.append(None)
                    before.append(own[d])
                    d += 1
                else:
                    np.maximum.reduce(sums[-1].reshape(-1, WIDTH), axis=0, out=column)
                    if column.max() < floor:
                        continue
                    # The k-th of maxima of as many disjoint sets of chunks is reached by k chunks.
                    bound = floor if k > WIDTH else max(floor, float(np.partition(column, WIDTH - k)[WIDTH - k]) - 2 * off)
                    spots = np.flatnonzero(sums[-1] >= np.float32(bound))
                    found.append((i, spots + lo))
                    pending += len(spots)
                    if pending > 1_000_000:
                        settle(found)
                        found, pending = [], 0
            if found:
                settle(found)
        i, j = np.nonzero(score > -np.inf)
        for x in range(0, len(i), 500_000):
            a, b = i[x : x + 500_000], j[x : x + 500_000]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), keys.take(pa.array(by_key[ranks[a, b]])), pa.array(score[a, b])], ["words", "key", "score"])

    return run

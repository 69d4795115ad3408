"""Keyword-stuffed and link-list pages.

The content words of each page, as one text, are searched for maximal repeated substrings
with the states of its suffix automaton.  A state is a class of substrings with the same
occurrences; the classes of a text are the intervals of its suffix array in which neighbours
share a prefix, and as arrays they are built for all pages of a batch at once.  Words covered
by repeats, and words in lists, tags and links, count as piled up unless a clause with words
of its own explains them.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.batches import map_batches

#: A substring of this many characters counts as repeated from so many occurrences on.
LONG, REPEATS = 14, 3
#: A shorter one counts if all its occurrences hold this share of the page's characters; classes
#: of occurrences in which that is looked at, and the least length.
KEYWORD_SHARE, OCCURRENCES, SHORT = 0.12, (3, 5, 9, 17, 33, 65, 129), 4
#: Characters of pages whose repeats are searched for at a time; a longer page is alone.
GROUP = 1 << 17
#: What counts as repeated within a mere phrase: two occurrences of so many characters.
TWICE = 12
#: Share of a clause's content words that must be its own.
LEAST_OWN = 0.34
#: A page needs so many piled-up words, and this share of all its words.
LEAST_WORDS, MOST_SHARE = 12, 0.5

_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"(?:https?|ftp)://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+", re.I)
_TAGGED = re.compile(r"<[^<>\n]{1,300}>")
_HASH = re.compile(r"(?<![\w&/])#[^\W\d_]\w*")
_SEGMENT = re.compile(r"(?<=[.!?])[\s\"')\]]+(?=[\W_]*[A-Z0-9À-Þ])|\n+")
_CODE = re.compile(r"[{}=;]|\(\w*[,)]|\)\s*:?$|->|::|^\s*(?:#include|import|from|package|use|def|class|return|end|else|for|if|while|fn|func|pub|@)\b")
#: Function words of English, German, French and Spanish (fixed values).
FUNCTION = frozenset(
    "a an and are as at be because been before but by can cannot could did do does each even every for from had has have he her here his how i if in into is it its itself "
    "may might more most must my never no nobody none nor not nothing of off on once only or our out over own per please she should since so some still than that the their them then "
    "there these they this those though through to too under unless until up us was we were what whatever when where which while who why will with without would you your "
    "aber als am an auch auf aus bei bis das dem den der des die doch durch ein eine einem einen einer eines er es für hat im in ist ja kann kein keine mit muss nach nicht noch nur ob oder "
    "ohne schon sein seit sich sie sind so sonst statt stattdessen über um und uns unter vom von vor war was weil wenn werden wie wir wird zu zum zur dürfen darf jedem "
    "au aux avec car ce ces cette chaque dans de depuis des donc du elle en est et eu il ils je la le les leur lui mais n ne nous on ont ou où par pas plus pour qu quand que qui sa sans "
    "sauf se sera serait ses si son sont sur toutes tout un une été déjà "
    "al algo antes así aunque cada como con cual cuando de del desde donde dos el ella en entre era es esta este está ha hay la las lo los más me mi muy no nos o para pero por porque puede que "
    "se ser si sin sobre su sus también tan tiene todo un una uno y ya".split()
)


def suffixes(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes of all pages, sorted within their page, and how many
    characters each shares with the next one of its page.

    ``codes`` are numbers from 1 on, ``owner`` ascends.  Sorted by a prefix first; those that
    are equal are told apart by the ranks of what follows, which doubles the prefix each round.
    """
    n = len(codes)
    bits = max(int(codes.max()).bit_length(), 1)
    width = max(1, (62 - int(owner[-1]).bit_length()) // bits)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    left = ends - np.arange(n)

    def after(x: np.ndarray, j: int) -> np.ndarray:
        """What stands ``j`` places on in the page, else 0."""
        out = np.zeros(n, dtype=np.int64)
        if j < n:
            out[: n - j] = x[j:]
            out[left <= j] = 0
        return out

    # The first ``width`` characters as one number, put together from powers of two.
    key, have, power, size = owner.astype(np.int64), 0, codes.astype(np.int64), 1
    while True:
        if width & size:
            key = key << (bits * size) | (after(power, have) if have else power)
            have += size
        if size * 2 > width:
            break
        power = power << (bits * size) | after(power, size)
        size *= 2
    order = np.argsort(key)

    def named(sorted_key: np.ndarray) -> np.ndarray:
        first = np.ones(len(sorted_key), dtype=bool)
        first[1:] = sorted_key[1:] != sorted_key[:-1]
        return first

    first = named(key[order])
    slot = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = slot
    levels = [(width, rank.copy())]
    length = width
    while True:
        alone = first.copy()
        alone[:-1] &= first[1:]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        i = order[at]
        nxt = np.where(length < left[i], rank[np.minimum(i + length, n - 1)] + 1, 0)
        pair = rank[i] * (n + 1) + nxt
        o = np.argsort(pair)
        order[at] = i[o]
        fresh = named(pair[o])
        first[at] = fresh
        rank[order[at]] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        length *= 2
        levels.append((length, rank.copy()))
    a, b = order[:-1], order[1:]
    off = np.zeros(max(n - 1, 0), dtype=np.int64)
    same = owner[a] == owner[b]
    for size, names in reversed(levels):
        x, y = a + off, b + off
        ok = same & (x < ends[a]) & (y < ends[b])
        ok[ok] = names[x[ok]] == names[y[ok]]
        off[ok] += size
    # The rest is shorter than a prefix: where the two prefixes begin to differ.
    at = np.flatnonzero(same)
    x, y = a[at] + off[at], b[at] + off[at]
    inside = (x < ends[a[at]]) & (y < ends[b[at]])
    at, x, y = at[inside], x[inside], y[inside]
    differ = key[x] ^ key[y]
    high = differ >> 31
    length_of = np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp((differ & 0x7FFFFFFF).astype(np.float64))[1])
    off[at] += np.minimum((bits * width - length_of) // bits, width)
    return order, off


def longest(order: np.ndarray, common: np.ndarray, times: int) -> np.ndarray:
    """For each position the length of the longest substring that begins there and occurs at
    least ``times`` times in its page."""
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    w = times - 1
    if n <= w:
        return out

    def slide(x: np.ndarray, width: int, best) -> np.ndarray:
        done = 1
        while done < width:
            step = min(done, width - done)
            x = best(x[:-step], x[step:])
            done += step
        return x

    least = slide(common, w, np.minimum)
    # A suffix lies in all groups of neighbours that begin at most ``w`` before it.
    padded = np.concatenate([np.zeros(w, dtype=np.int64), least, np.zeros(w, dtype=np.int64)])
    out[order] = slide(padded, times, np.maximum)
    return out


def piles(pages: list[list[str]]) -> list[tuple[list[bool], list[bool], int]]:
    """For the words of each page: whether repeats cover them, whether a second occurrence
    does, and how many of the page's characters repeats cover."""
    texts = [" ".join(p) for p in pages]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return [([], [], 0) for _ in pages]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    _, codes = np.unique(chars, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    order, common = suffixes(codes, owner)
    n = len(codes)
    here = np.arange(n)

    def covered(ok: np.ndarray, reach: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(ok, here + reach, 0)) > here

    page = sizes[owner]
    often = np.zeros(n, dtype=bool)
    for k in OCCURRENCES:
        reach = longest(order, common, k)
        if not reach.any():
            break
        least = np.maximum(np.ceil(KEYWORD_SHARE * page / k), SHORT)
        often |= covered(reach >= np.minimum(least, LONG) if k >= REPEATS else reach >= least, reach)
    reach = longest(order, common, 2)
    twice = covered(reach >= TWICE, reach)
    starts = np.cumsum(sizes) - sizes
    sums = [np.concatenate([[0], np.cumsum(c & (chars != 32))]) for c in (often, twice)]
    out = []
    for k, words in enumerate(pages):
        if not words:
            out.append(([], [], 0))
            continue
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        a = starts[k] + np.cumsum(lens + 1) - lens - 1
        flags = [(2 * (c[a + lens] - c[a]) > lens).tolist() for c in sums]
        out.append((*flags, int(sums[0][starts[k] + sizes[k]] - sums[0][starts[k]])))
    return out


def cut(text: str | None) -> tuple[list[tuple], list[str], list[int]]:
    """(segments, content words, segment of each) of a page."""
    segments, words_of, where = [], [], []
    text = text or ""
    linked = "://" in text or "www." in text.lower()
    for seg in _SEGMENT.split(text):
        if not seg or not seg.strip():
            continue
        urls = _URL.findall(seg) if linked else ()
        bare = _TAGGED.sub(" ", _URL.sub(" ", seg)) if urls or "<" in seg else seg
        words = _WORD.findall(bare.lower())
        total = len(_WORD.findall(seg)) if urls or "<" in seg else len(words)
        content = [w for w in words if w not in FUNCTION]
        words_of += content
        where += [len(segments)] * len(content)
        segments.append((seg, len(urls), len(words), len(words) - len(content), total))
    return segments, words_of, where


def judge(segments: list[tuple], where: list[int], often: list[bool], twice: list[bool]) -> tuple[int, int]:
    """(words, piled-up words) of a page whose repeated words are known."""
    content, own, once = ([0] * len(segments) for _ in range(3))
    for k, c, c2 in zip(where, often, twice):
        content[k] += 1
        if not c:
            own[k] += 1
            once[k] += not c2
    all_words = piled = 0
    for k, (seg, urls, n, function, total) in enumerate(segments):
        all_words += total
        clause = function >= 2 and function >= 0.16 * n
        # A clause must have words of its own; in a mere phrase a second occurrence is enough
        # to make a word a repeated one.
        mine = (own if clause else once)[k] / content[k] if content[k] else 1.0
        if clause and mine >= LEAST_OWN:
            continue
        if not (content[k] and mine < LEAST_OWN):
            hashes = len(_HASH.findall(seg)) if "#" in seg else 0
            items = max(seg.count(","), seg.count("|"), seg.count(";"), seg.count("/") - 3 * urls - 2 * (urls > 0))
            if not (hashes >= 3 or (items >= 3 and items >= 0.2 * n and not clause) or (urls and not clause)):
                continue
        if urls or "<a " in seg or not _CODE.search(seg):
            piled += total
    return all_words, piled


def measures(texts: list[str | None]) -> list[tuple[int, int, int]]:
    """(words, piled-up words, characters covered by repeats) of each page."""
    parts = [cut(t) for t in texts]
    out = []
    first, size = 0, 0
    for k, (_, words, _) in enumerate(parts):
        size += sum(map(len, words)) + len(words)
        if size > GROUP or k == len(parts) - 1:
            group = parts[first : k + 1]
            out += [(*judge(s, w, o, t), c) for (s, _, w), (o, t, c) in zip(group, piles([p[1] for p in group]))]
            first, size = k + 1, 0
    return out


def measure(text: str | None) -> tuple[int, int, int]:
    return measures([text])[0]


def pages(documents: DataFrame) -> DataFrame:
    """(doc_id, words, piled, covered_chars, stuffed) for every page.

    Null and empty texts have no words and are not stuffed; equal texts are measured once
    a batch; repeated rows are kept.
    """

    def run(doc_id, text) -> list:
        once = list(dict.fromkeys(text))
        known = dict(zip(once, measures(once)))
        rows = [known[t] for t in text]
        w, p, c = (list(x) for x in zip(*rows))
        return [doc_id, w, p, c, [b >= LEAST_WORDS and b > MOST_SHARE * a for a, b, _ in rows]]

    return map_batches(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, words int, piled int, covered_chars int, stuffed boolean")

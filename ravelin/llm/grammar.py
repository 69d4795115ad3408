"""Re-Pair grammars over the token sequences of many files at once.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol until no
pair repeats.  Here a round replaces, in all files of a batch at the same time, every
pair that is frequent in its file and at least as frequent as both pairs it overlaps
with, so a handful of array operations a round does the work of many single steps.

Rules of different files meet by what they expand to.  ``phrases`` lets all files agree on
their rules without counting across files: the pair to replace is chosen by the greatest
hash among overlapping pairs instead of the greatest count, so equal stretches of text get
equal rules wherever they stand.
"""

from __future__ import annotations

import re
import zlib
from itertools import accumulate

import numpy as np
import pandas as pd

#: A pair must occur this often to become a rule.
LEAST_PAIRS = 3
#: Tokens whose grammars are built at a time.  A rule takes the place of two tokens at least,
#: so the numbers of all symbols stay below 24 bits; a single longer sequence has 31.
GROUP = 4_000_000
#: Phrases grow until they have this many tokens.
PHRASE = 24
TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`|[A-Z]?[a-z]+|[A-Z]+|\d[0-9a-fA-F]*|[^\s\w]|[^\W\d_a-zA-Z]+|\n[ \t]*(?=\S)')
STRING, NUMBER, BREAK = 0, 1, 2
_BASE, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Symbols(dict):
    """Token to symbol number; all strings are one symbol, all numbers and all line breaks
    another.  ``hashes`` are the same for a token in every batch."""

    def __init__(self):
        super().__init__()
        self.hashes = [1, 2, 3]

    def __missing__(self, t: str) -> int:
        c = t[0]
        if c in "\"'`" and len(t) > 1:
            n = STRING
        elif c.isdigit():
            n = NUMBER
        elif c == "\n":
            n = BREAK
        else:
            n = len(self.hashes)
            self.hashes.append(zlib.crc32(t.encode("utf-8", "surrogatepass")) + 4)
        self[t] = n
        return n


def _groups(sizes: list[int]) -> list[slice]:
    """Neighbouring sequences with ``GROUP`` tokens at most, or single longer ones."""
    out, first, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > first and (total + n > GROUP or k - first >= 1 << 15):
            out.append(slice(first, k))
            first, total = k, 0
        total += n
    return [*out, slice(first, len(sizes))] if sizes else []


def grammars(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sequence the length of its start rule, the number of its rules, and how many
    of these expand to something with a line break (symbol ``BREAK``)."""
    parts = [_grammars(sequences[g]) for g in _groups([len(s) for s in sequences])]
    if not parts:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*parts))


def _grammars(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = len(sequences)
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)
    owner = np.repeat(np.arange(k, dtype=np.int64), sizes)
    left, rules, breaking = sizes.copy(), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
    if not len(owner):
        return left, rules, breaking
    s, known = pd.factorize(np.concatenate([np.asarray(s, dtype=np.int64) for s in sequences]))
    s = s.astype(np.int64)
    breaks = known == BREAK
    fresh = len(known)
    while len(s) > 1:
        # A pair is particular to its file and never spans two.
        codes, _ = pd.factorize((owner[:-1] << 48) | (s[:-1] << 24) | s[1:] if k > 1 else (s[:-1] << 31) | s[1:])
        count = np.bincount(codes)[codes]
        count[owner[:-1] != owner[1:]] = 0
        rank = (count.astype(np.int64) << 32) | codes
        good = count >= LEAST_PAIRS
        good[1:] &= rank[1:] >= rank[:-1]
        good[:-1] &= rank[:-1] >= rank[1:]
        at = np.flatnonzero(good)
        if not len(at):
            break
        # Neighbours are both chosen only in a run of one symbol: every second one stays.
        first = np.ones(len(at), dtype=bool)
        first[1:] = at[1:] != at[:-1] + 1
        start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        used = np.bincount(codes[at], minlength=int(codes.max()) + 1)
        at = at[used[codes[at]] >= 2]
        if not len(at):
            break
        names, lead = np.unique(codes[at], return_index=True)
        number = np.zeros(int(codes.max()) + 1, dtype=np.int64)
        number[names] = fresh + np.arange(len(names))
        held = breaks[s[at[lead]]] | breaks[s[at[lead] + 1]]
        breaks = np.concatenate([breaks, held])
        rules += np.bincount(owner[at[lead]], minlength=k)
        breaking += np.bincount(owner[at[lead[held]]], minlength=k)
        fresh += len(names)
        s[at] = number[codes[at]]
        keep = np.ones(len(s), dtype=bool)
        keep[at + 1] = False
        left -= np.bincount(owner[at], minlength=k)
        # A file without a replacement has none in later rounds either.
        going = np.zeros(k, dtype=bool)
        going[owner[at]] = True
        keep &= going[owner]
        s, owner = s[keep], owner[keep]
    return left, rules, breaking


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def phrases(sequences: list[np.ndarray], hashes: list[int], least: int = PHRASE) -> tuple[list[list[int]], list[list[int]]]:
    """For each sequence the rules its start rule consists of, named by a hash of what they
    expand to, and their lengths in tokens.  Line breaks are left out.

    A pair is replaced if its hash is the greatest of the pairs it overlaps with and neither
    of its symbols has ``least`` tokens yet.  What a stretch becomes depends on the stretch
    alone but for its ends, so copies share rules, and an edit changes only those around it.
    """
    parts = [_phrases(sequences[g], hashes, least) for g in _groups([len(s) for s in sequences])]
    return [x for a, _ in parts for x in a], [x for _, b in parts for x in b]


def _phrases(sequences: list[np.ndarray], hashes: list[int], least: int) -> tuple[list[list[int]], list[list[int]]]:
    k = len(sequences)
    s = np.concatenate([np.asarray(s, dtype=np.int64) for s in sequences]) if k else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(k, dtype=np.int64), [len(s) for s in sequences])
    s, owner = s[s != BREAK], owner[s != BREAK]
    h = _mixed(np.array(hashes, dtype=np.uint64)[s])
    size, power = np.ones(len(h), dtype=np.int64), np.full(len(h), _BASE)
    while len(h) > 1:
        open_ = (owner[:-1] == owner[1:]) & (size[:-1] < least) & (size[1:] < least)
        rank = np.where(open_, _mixed(h[:-1] * _BASE + np.uint64(3) * h[1:]) | np.uint64(1), np.uint64(0))
        good = open_.copy()
        good[1:] &= rank[1:] > rank[:-1]
        good[:-1] &= rank[:-1] >= rank[1:]
        at = np.flatnonzero(good)
        if not len(at):
            break
        h[at] = h[at] * power[at + 1] + h[at + 1]
        power[at] *= power[at + 1]
        size[at] += size[at + 1]
        keep = np.ones(len(h), dtype=bool)
        keep[at + 1] = False
        h, size, power, owner = h[keep], size[keep], power[keep], owner[keep]
    ends = [0, *accumulate(np.bincount(owner, minlength=k).tolist())]
    names, sizes = h.view(np.int64).tolist(), size.tolist()
    return [names[a:b] for a, b in zip(ends, ends[1:])], [sizes[a:b] for a, b in zip(ends, ends[1:])]

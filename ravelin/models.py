"""Embedding, scoring and expansion as protocols, with deterministic defaults.

A model is anything with these methods; nothing here needs a network or model files.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from typing import Protocol


class Embed(Protocol):
    model_id: str
    dim: int

    def embed_query(self, text: str) -> list[float]: ...

    def embed_document(self, text: str) -> list[float]: ...


class Score(Protocol):
    top_k: int
    output_n: int

    def score_pairs(self, query: str, candidates: list[str]) -> list[float]: ...


class Expand(Protocol):
    def expand(self, query: str) -> list[tuple[str, str]]: ...


@dataclass
class HashEmbedder:
    """Signed feature hashing of words, with length 1."""

    dim: int = 64
    model_id: str = "hash-64"

    def embed_document(self, text: str) -> list[float]:
        v = [0.0] * self.dim
        for w in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            v[h % self.dim] += 1.0 if h >> 31 else -1.0
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    embed_query = embed_document


@dataclass
class LexicalScorer:
    """Share of the query's distinct words that occur in a candidate."""

    top_k: int = 20
    output_n: int = 5

    def score_pairs(self, query: str, candidates: list[str]) -> list[float]:
        q = set(re.findall(r"[^\W_]+", query.lower()))
        return [len(q & set(re.findall(r"[^\W_]+", c.lower()))) / len(q) if q else 0.0 for c in candidates]

    def rank(self, query: str, candidates: list[str]) -> list[tuple[int, float]]:
        """(index, score) of the best candidates among the first ``top_k``."""
        s = self.score_pairs(query, candidates[: self.top_k])
        return sorted(enumerate(s), key=lambda x: (-x[1], x[0]))[: self.output_n]


@dataclass
class RuleExpander:
    """Variants by rule: the bare terms for words, the whole for vectors."""

    max_variants: int = 4

    def expand(self, query: str) -> list[tuple[str, str]]:
        w = re.findall(r"[^\W_]+", query.lower())
        out = [("lex", " ".join(w)), ("lex", " ".join(x for x in w if len(x) > 3)), ("vec", query.strip())]
        seen: set[str] = {query.strip()}
        kept = []
        for kind, v in out:
            if v and v not in seen:
                seen.add(v)
                kept.append((kind, v))
        return kept[: self.max_variants]


def parse_variants(answer: str, most: int = 4) -> list[tuple[str, str]]:
    """(kind, text) of a model's answer: one variant a line, thinking and bullets dropped."""
    text = re.sub(r"<think>.*?(?:</think>|\Z)", "", answer, flags=re.S)
    out, seen = [], set()
    for line in text.splitlines():
        line = re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", line).strip()
        m = re.match(r"(lex|vec|hyde)\s*:\s*(.*)", line, re.I)
        kind, v = (m.group(1).lower(), m.group(2).strip()) if m else ("lex", line)
        if v and v.lower() not in seen:
            seen.add(v.lower())
            out.append((kind, v))
    return out[:most]


def yes_probability(yes_logprob: float, no_logprob: float) -> float:
    """Probability of yes from the log probabilities of yes and no."""
    from math import exp

    y, n = exp(yes_logprob), exp(no_logprob)
    return y / (y + n) if y + n else 0.0


# ---- settings and choice of models


@dataclass
class ScorerSettings:
    """Defaults of the second ranking stage (fixed values)."""

    top_k: int = 20
    output_n: int = 5


@dataclass
class ExpansionSettings:
    """Defaults of query expansion (fixed values)."""

    max_variants: int = 4
    anchor_floor: float = 0.5
    pool_fraction: float = 0.34
    additive_only: bool = True


#: Makers of embedders, scorers and expanders by provider and kind; more can be added.
PROVIDERS: dict[tuple[str, str], object] = {
    ("builtin", "embed"): HashEmbedder,
    ("builtin", "score"): LexicalScorer,
    ("builtin", "expand"): RuleExpander,
}


def make(kind: str, config: dict | None):
    """The model a configuration names, or None: without one, a search goes on without it."""
    if not config or not config.get("provider"):
        return None
    maker = PROVIDERS.get((config["provider"], kind))
    if maker is None:
        return None
    return maker(**{k: v for k, v in config.items() if k != "provider"})


def allowed_model(requested: str | None, catalog: list[str], default: str) -> str:
    """The model a request may use: one of the catalog, or the default if none is named."""
    if not requested:
        return default
    if requested not in catalog and requested != default:
        raise ValueError(f"model {requested!r} is not one of: {', '.join(sorted({*catalog, default}))}")
    return requested


def candidate_text(hit: dict) -> str:
    """What a scorer sees of a hit: kind, symbol and snippet."""
    head = " ".join(x for x in (hit.get("kind"), hit.get("symbol")) if x)
    return f"{head}: {hit.get('snippet') or ''}" if head else hit.get("snippet") or ""

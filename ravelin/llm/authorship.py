"""Generated, minified and vendored files and data stored as code.

The signals come from Re-Pair grammars over token sequences.  A file whose grammar is far
smaller than its sequence is generated or a table of literals; literals that hardly shrink
are blobs; a grammar with next to no rule that holds a line break is that of a squeezed
script; and rules shared by packages mark copies.  What a file's opening comment states
about its origin and the folder it lies in are read as well, as a tool may emit code that
does not repeat itself and a foreign file may have no other copy.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import grammar
from ravelin.llm.batches import map_batches
from ravelin.llm.syntax import LANGUAGE, faults
from ravelin.operators.skew import lookup_join
from ravelin.session import Cut

#: Grammar size over sequence length up to which a file counts as generated or as data.
MOST_RATIO = 0.33
#: A shorter token sequence says nothing about repetition.
LEAST_TOKENS = 60
#: Share of a grammar's rules that hold a line break, up to which the file counts as squeezed,
#: and rules from which on the share says something.
MOST_BREAKS, LEAST_RULES = 0.1, 8
#: Share of a file's code in string literals, and size of the grammar over their characters,
#: from which the literals count as a blob; shorter ones say nothing about compression.
LEAST_LITERAL_SHARE = 0.5
LEAST_BLOB_RATIO = 0.88
LEAST_BLOB = 200
#: Literals are measured in pieces of so many characters: the grammar of any longer text is
#: smaller, as pairs of 64 letters recur by chance.
BLOB_PIECE = 8_000
#: Tokens a rule needs to be told apart from an idiom of the language, and share of a file's
#: tokens in such rules that other packages have as well.
LEAST_RULE = 16
LEAST_SHARED = 0.65
#: A text whose first error lies among so many symbols is of another format altogether.
ALIEN = 40

_STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`'
_SLASH = re.compile(rf"({_STRING})|//[^\n]*|/\*.*?\*/", re.S)
_HASH = re.compile(rf'("""|\'\'\'|{_STRING})|#[^\n]*')
_PHP = re.compile(rf"({_STRING})|//[^\n]*|#[^\n]*|/\*.*?\*/", re.S)
_STRIP = {"python": _HASH, "ruby": _HASH, "php": _PHP}
_LINE_COMMENT = re.compile(r"\A(?:\s*(?:<\?php|//[^\n]*|#(?!include|define|pragma|if)[^\n]*|/\*(?s:.*?)\*/|\"\"\"(?s:.*?)\"\"\"))*")

#: What opening comments of generated files state (fixed values).
_MADE = re.compile(
    r"@generated\b"
    r"|<auto-?generated"
    r"|\bauto-?generated (?:file|code)\b"
    r"|\b(?:file|code|source) (?:was |is |has been )?(?:automatically |auto-?)?generated (?:by|from|with|using)\b"
    r"|\bautomatically generated (?:by|from|with|using)\b"
    r"|^\W*(?:code )?generated (?:by|from|with|using) "
    r"|\bmachine[- ](?:made|generated)\b"
    r"|\bdo not (?:edit|modify|change)(?: this file)?(?: by hand)?\s*[:;.,-]+\s*(?:it (?:is|was) )?(?:produced|generated|created|written|made) (?:by|from)\b"
    r"|\bchanges (?:will|are going to) be (?:lost|overwritten)\b"
    r"|\bgenerated (?:by|from) [^.]{1,80}[.;-]+ do not (?:edit|modify)\b",
    re.I | re.M,
)
#: What opening comments of copied files state (fixed values).
_COPIED = re.compile(
    r"\b(?:imported|copied|vendored|taken) from \S+@\d"
    r"|\bthis file is part of [\w.-]+, (?:release|version) v?\d"
    r"|\bcopied (?:without changes|verbatim|unchanged) from\b"
    r"|^\W*upstream: *https?://"
    r"|^\W*\(c\) the [\w.-]+ contributors\b"
    r"|\blicensed under the terms of the [\w.-]+ licen[cs]e, see its\b",
    re.I | re.M,
)
#: Directory names that hold other projects' files (fixed values).
_FOREIGN_DIRS = {"third_party", "3rdparty", "thirdparty", "vendor", "vendored", "_vendor", "node_modules", "bower_components", "external", "extern", "deps"}

FEATURES = "package string, path string, seen_at timestamp, received_at timestamp, there boolean, language string, tokens int, ratio double, breaks double, made boolean, copied boolean, blob_ratio double, rules array<bigint>, rule_tokens array<int>"


def opening(text: str) -> str:
    """The comments a text begins with."""
    return _LINE_COMMENT.match(text).group()


def _features(package, path, seen_at, received_at, content) -> list:
    symbols = grammar.Symbols()
    look = symbols.__getitem__
    sequences, rows, blobs, blob_of = [], [], [], []
    for p, t in zip(path, content):
        lang = LANGUAGE.get((p or "").rsplit(".", 1)[-1].lower())
        t = t or ""
        code = _STRIP.get(lang, _SLASH).sub(lambda m: m.group(1) or "", t)
        tokens = grammar.TOKEN.findall(code)
        sequences.append(np.fromiter(map(look, tokens), dtype=np.int64, count=len(tokens)))
        literals = "".join(x[1:-1] for x in tokens if x[0] in "\"'`" and len(x) > 2)
        if len(literals) >= LEAST_BLOB and len(literals) >= LEAST_LITERAL_SHARE * len(" ".join(code.split())):
            chars_of = np.frombuffer(literals.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            for i in range(0, len(chars_of), BLOB_PIECE):
                blobs.append(chars_of[i : i + BLOB_PIECE])
                blob_of.append((len(rows), len(chars_of)))
        head = opening(t)
        foreign = any(x in _FOREIGN_DIRS for x in (p or "").split("/")[1:-1])
        rows.append((lang, len(tokens), bool(_MADE.search(head)), bool(_COPIED.search(head)) or foreign))
    left, rules, breaking = grammar.grammars(sequences)
    ratio = [float(n + 2 * r) / x[1] if x[1] else 1.0 for n, r, x in zip(left, rules, rows)]
    breaks = [float(b) / float(r) if r >= LEAST_RULES else 1.0 for b, r in zip(breaking, rules)]
    blob = [0.0] * len(rows)
    left, rules, _ = grammar.grammars(blobs)
    for (k, size), n, r in zip(blob_of, left, rules):
        blob[k] += float(n + 2 * r) / size
    for k, (x, t) in enumerate(zip(rows, content)):
        # A text of another format than its extension says may repeat itself as well.
        if x[0] and (x[1] >= LEAST_TOKENS and ratio[k] <= MOST_RATIO or breaks[k] <= MOST_BREAKS or blob[k] >= LEAST_BLOB_RATIO) and any(at < ALIEN for at, _ in faults(x[0], t)):
            ratio[k], breaks[k], blob[k] = 1.0, 1.0, 0.0
    names, sizes = grammar.phrases(sequences, symbols.hashes)
    cols = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(4)]
    return [package, path, seen_at, received_at, [c is not None for c in content], *cols[:2], ratio, breaks, *cols[2:], blob, names, sizes]


def features(scans: DataFrame) -> DataFrame:
    """Grammar and layout figures of the newest text of every path.

    Computed where the texts are read; only the figures travel.  Paths whose newest
    record has no text give no row; null and empty texts have no tokens.
    """
    each = map_batches(scans.select("package", "path", "seen_at", "received_at", "content"), _features, FEATURES)
    rest = [c for c in each.columns if c not in ("path", "seen_at", "received_at")]
    best = each.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("seen_at", "received_at", "tokens", "ratio")).alias("_b"))
    return best.select("path", *[F.col(f"_b.{c}").alias(c) for c in rest]).where("there").drop("there")


def classify(spark: SparkSession, scans: DataFrame) -> DataFrame:
    """(path, package, language, tokens, ratio, breaks, shared, blob_ratio, generated,
    blob, minified, vendored) for the newest text of every path.

    ``breaks`` is the share of the grammar's rules that hold a line break (1 for grammars
    too small to tell), ``shared`` the share of a file's tokens in rules that occur in other
    packages too.  A rule's packages are counted by their least and greatest name, which
    combines before the shuffle; a rule that very many files share is spread by salting.
    All files that share rules are marked, the one the others were copied from too.
    """
    cut = Cut(spark, "authorship")
    f = cut(features(scans))
    r = f.select("path", "package", F.explode(F.arrays_zip("rules", "rule_tokens")).alias("_r")).select("path", "package", F.col("_r.rules").alias("rule"), F.col("_r.rule_tokens").alias("size"))
    r = r.where(F.col("size") >= LEAST_RULE)
    shared = r.groupBy("rule").agg(F.min("package").alias("_a"), F.max("package").alias("_b")).where(F.col("_a") != F.col("_b")).select("rule")
    hits = lookup_join(r, shared.withColumn("_s", F.lit(True)), "rule", "rule", "inner")
    per_file = hits.groupBy("path").agg(F.sum("size").alias("_shared"))
    total = F.aggregate("rule_tokens", F.lit(0), lambda a, x: a + x)
    out = f.join(per_file, "path", "left").withColumn("shared", F.round(F.coalesce("_shared", F.lit(0)) / F.greatest(total, F.lit(1)), 6))
    small = (F.col("ratio") <= MOST_RATIO) & (F.col("tokens") >= LEAST_TOKENS)
    return out.select(
        "path", "package", "language", "tokens", F.round("ratio", 6).alias("ratio"), F.round("breaks", 6).alias("breaks"), "shared", F.round("blob_ratio", 6).alias("blob_ratio"),
        (small | F.col("made")).alias("generated"), (F.col("blob_ratio") >= LEAST_BLOB_RATIO).alias("blob"), (F.col("breaks") <= MOST_BREAKS).alias("minified"),
        ((F.col("shared") >= LEAST_SHARED) | F.col("copied")).alias("vendored"),
    )

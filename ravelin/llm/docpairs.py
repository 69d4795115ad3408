"""Functions paired with their documentation.

Within a file every documentation comment is a candidate for the symbol it stands at and
for the symbols near it.  Candidates are weighed by the parameter names a comment tags, by
the names it mentions and by distance; the heaviest bipartite assignment gives each symbol
at most one comment and each comment at most one symbol.  Implausible links are no
candidates, and comments that say nothing of their own are marked.
"""

from __future__ import annotations

import re
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.batches import map_batches

#: Lines of a file that are one unit of work, and lines before and after them that are looked
#: at as well, so no link is lost at an edge.
BLOCK_LINES, MARGIN_LINES = 4_096, 512
#: Symbols that are held at a time, however many stand on few lines, and those looked at around.
HELD, MARGIN = 8_192, 256
#: Symbols before and after a comment that are candidates for it.
REACH = 3
#: A link lighter than this is implausible.
LEAST_WEIGHT = 0.25

_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_][\w'-]*")
_MARKS = re.compile(r"^[ \t]*(?:/\*\*?!?|\*+/|\*(?!\*)|///?!?|//!|#+!?|--+\|?|;+|%+|\"\"\"|''')[ \t]?|(?:\*+/|\"\"\"|''')[ \t]*$", re.M)
_TAG = re.compile(r"</?[A-Za-z][\w:.-]*(?:\s[^<>]*)?/?>")
_INLINE_TAG = re.compile(r"\{@(?:code|link|literal|linkplain|value)\s+([^{}]*)\}")
_INHERIT = re.compile(r"\{@inheritdoc\}|@inheritdoc\b|<inheritdoc\s*/?>|\(inherited\)|^\W*(?:inherited from|see (?:the )?(?:super|base|parent)(?: ?class)?|same as (?:super|base|parent))\b[^.\n]*\.?|@see\s+super\b[^\n]*|@override\b", re.I | re.M)
_BRIEF = re.compile(r"^[ \t]*[\\@](?:brief|note|details|short|summary|remarks?|warning|attention|description|deprecated)\b[ \t:]*", re.M | re.I)
#: Lines that carry a tag for a parameter, a result or an error, with all that follows them.
_PARAM = re.compile(
    r"^[ \t]*(?:[@\\](?:param|arg|tparam|return|returns|throws|throw|exception|raises|yields?|retval)\b\W*(?P<a>[\w$*&.]*)|:(?:param|type|arg|keyword|return|returns|rtype|raises|raise)\b(?:[ \t]+(?:[\w.\[\]]+[ \t]+)?(?P<b>[\w$*]+))?:)[^\n]*$",
    re.M | re.I,
)
_SECTION = re.compile(r"^[ \t]*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|exceptions|attributes)[ \t]*:[ \t]*$", re.I)
_ENTRY = re.compile(r"^\s*[-*]?\s*`?\$?([\w$*]+)`?\s*(?:\([^)]*\))?\s*:(?:\s|$)")
#: Lines about authors, licences and versions, and instructions to tools (fixed values).
_META = re.compile(
    r"^[ \t]*(?:[@\\](?:author|version|since|date|copyright|license|licence|internal|api|category|package|subpackage|hide|private|public|protected|static|ignore|todo|see|link|deprecated|experimental|beta|alpha|final|async|generator|suppress\w*|nullable|noinspection|test)\b[^\n]*"
    r"|spdx-license-identifier:[^\n]*|copyright\b[^\n]*|\(c\)[^\n]*|©[^\n]*|all rights reserved\.?|licen[cs]ed? ?(?:under|:)[^\n]*|author:?[^\n]*|written by\b[^\n]*|version:?[ \t]*[\d.]+[^\n]*"
    r"|eslint[-\w]*\b[^\n]*|pylint:[^\n]*|noqa\b[^\n]*|nolint\b[^\n]*|nosec\b[^\n]*|clang-format[^\n]*|clang-tidy[^\n]*|prettier-ignore[^\n]*|tslint:[^\n]*|ts-(?:ignore|nocheck|expect-error)[^\n]*|@ts-\w+[^\n]*"
    r"|type:[ \t]*ignore[^\n]*|mypy:[^\n]*|pragma:?[^\n]*|fmt:[ \t]*(?:on|off|skip)[^\n]*|yapf:[^\n]*|isort:[^\n]*|rubocop:[^\n]*|swiftlint:[^\n]*|ktlint[-\w]*[^\n]*|phpcs:[^\n]*|phpstan-\w+[^\n]*|psalm-\w+[^\n]*|@phpstan[^\n]*"
    r"|istanbul ignore[^\n]*|c8 ignore[^\n]*|coverage:[^\n]*|gocyclo:[^\n]*|go:\w+[^\n]*|\+build[^\n]*|rustfmt::\w+[^\n]*|codespell:[^\n]*|lint:[^\n]*|nopmd\b[^\n]*|checkstyle:[^\n]*|sonar-[^\n]*|vim?:[^\n]*|scalafmt:[^\n]*|scalastyle:[^\n]*|dprint-ignore[^\n]*|biome-ignore[^\n]*|jshint\b[^\n]*|jslint\b[^\n]*|globals?\b:?[^\n.]*$)[ \t]*$",
    re.M | re.I,
)
#: Placeholders, stub notices and work notes without any further word (fixed values).
_EMPTY = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|hack|tbd|wip|tba)\b"
    r"|(?:todo\W+)?(?:auto-?generated|generated|default|empty|placeholder) (?:method |function |class |constructor |catch |code )*(?:stub|block|placeholder)"
    r"|(?:add |insert |write |put |enter |your )*(?:a )?(?:description|documentation|docs?|docstring|comment|summary|text|doc)(?: (?:goes|comes))?(?: here| needed| missing| pending| required| follows)?"
    r"|description of \w+|(?:no|missing|without|lacks|needs|empty) (?:a )?(?:description|documentation|docs?|docstring|comment|summary)(?: (?:available|provided|yet|given|here))?"
    r"|(?:not |un)(?:yet )?documented(?: yet)?|to be (?:done|documented|written|described|determined|added|completed)|document (?:me|this)|write (?:me|docs?)|fill (?:me |this )?in|describe me|implement me|not (?:yet )?implemented(?: yet)?|coming soon|lorem ipsum.*"
    r"|stub|placeholder|dummy|none|null|nil|n/?a|foo|bar|test|blah.*|see (?:above|below|code|source|name|title)|self[- ]explanatory|obvious|inherited|deprecated|internal"
    r"|(?:keine|ohne|fehlende) (?:beschreibung|dokumentation|doku)|beschreibung (?:fehlt|folgt)|sin (?:descripci[oó]n|documentaci[oó]n|documentar)|(?:pas de|sans|aucune) (?:description|documentation)|(?:à|a) (?:compl[ée]ter|documenter|faire)|por (?:hacer|documentar)|pendiente|descripci[oó]n pendiente|nessuna descrizione|sem descri[cç][aã]o)\W*$",
    re.I,
)
_NOTE = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD)\b(?:\([^)\n]*\))?\s*[:\-–]?\s*[^.\n!?]*(?:[.!?]+|$)", re.M)
_NOTE_LOW = re.compile(r"^[ \t]*(?:todo|fixme|xxx|hack|tbd)\b[ \t]*[:\-–]+[^.\n!?]*(?:[.!?]+|$)", re.M | re.I)
#: Words that add nothing to a name (fixed values).
_FILL = frozenset(
    "a an the this that these its of for to on in from with by and or is are be it given specified current new some all any function method procedure routine constructor getter setter "
    "helper operation call object class instance value values param params parameter parameters argument arguments name simple implementation does do performs perform "
    "der die das den dem ein eine einen einer le la les un une el los las lo una de du des del al funktion methode función método fonction méthode".split()
)


def subwords(name: str | None) -> list[str]:
    return [w.lower() for w in _CAMEL.findall(name or "")]


def parameters(signature: str | None) -> frozenset[str]:
    """Names of the parameters that a signature lists, in any of the languages."""
    m = re.search(r"\((.*)\)", signature or "", re.S)
    if not m:
        return frozenset()
    out = set()
    for part in m.group(1).split(","):
        part = part.split("=")[0]
        left = part.split(":")[0] if ":" in part else part
        words = re.findall(r"[A-Za-z_]\w*", left)
        if words:
            # ``long a`` and ``a int64`` hide which one is the type; both are kept.
            out.update(w.lower() for w in (words if ":" not in part else words[-1:]))
    return frozenset(out)


def _stem(w: str) -> str:
    w = w.lower().replace("'s", "")
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    for end in ("ing", "ed", "es", "s"):
        if len(w) > len(end) + 2 and w.endswith(end) and not w.endswith("ss"):
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiouls":
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] == "e" else w


def unmarked(text: str) -> str:
    """The text without comment marks and tags; the words between tags stay."""
    t = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    t = _MARKS.sub("", t)
    t = _INLINE_TAG.sub(r"\1", t)
    return t


def parse(text: str | None) -> tuple[str, list[str]]:
    """(description without parameter lists, marks, notices and notes; tagged names)."""
    if not text or not text.strip():
        return "", []
    t = unmarked(text)
    t = _INHERIT.sub(" ", t)
    t = _TAG.sub(" ", t)
    t = _BRIEF.sub("", t)
    tags: list[str] = []

    def tagged(m: re.Match) -> str:
        word = m.group(0).lstrip()[1:].split(None, 1)[0].rstrip(":").lower()
        n = m.group("a") or m.group("b")
        if n and word in ("param", "arg", "tparam", "type", "keyword"):
            tags.append(n.strip("*&$").lower())
        return ""

    t = _PARAM.sub(tagged, t)
    lines, out, skip = t.split("\n"), [], None
    for line in lines:
        if _SECTION.match(line):
            skip = len(line) - len(line.lstrip())
            continue
        if skip is not None:
            e = _ENTRY.match(line)
            deeper = len(line) - len(line.lstrip()) > skip
            if line.strip() and (deeper or e):
                if e:
                    tags.append(e.group(1).strip("*&$").lower())
                continue
            if not line.strip():
                continue
            skip = None
        out.append(line)
    t = "\n".join(out)
    t = _META.sub("", t)
    kept = []
    for line in t.split("\n"):
        line = line.strip()
        if not line or not re.search(r"\w", line) or _EMPTY.match(line):
            continue
        line = _NOTE_LOW.sub("", _NOTE.sub("", line)).strip()
        if line and re.search(r"\w", line) and not _EMPTY.match(line):
            kept.append(line)
    return " ".join(" ".join(kept).split()), tags


def informative(description: str, name: str | None, names: frozenset[str]) -> bool:
    """True if a description has words beyond the symbol's name and its parameters."""
    if not description:
        return False
    known = {_stem(w) for w in subwords(name)} | {_stem(w) for n in names for w in subwords(n)}
    whole = (name or "").lower()
    for w in _WORD.findall(description):
        low = w.lower()
        if low == whole or low in _FILL:
            continue
        parts = subwords(w) or [low]
        if all(_stem(p) in known or p in _FILL for p in parts):
            continue
        if "_" in w and w.lower().replace("_", "") == whole.replace("_", ""):
            continue
        return True
    return False


def weight(gap: int, tags: list[str], names: frozenset[str], description: str, name: str | None) -> float:
    """How plausible it is that a comment ``gap`` symbols away documents a symbol."""
    w = 1.0 / (1 + 2 * abs(gap))
    if tags:
        # A symbol whose parameters are unknown gets half the credit.
        hit = sum(t in names for t in tags) / len(tags) if names else 0.5
        w += 0.8 * hit - (0.3 if not hit else 0)
    low = description.lower()
    if name and len(name) > 3 and name.lower() in low:
        w += 0.3
    return w


def assign(options: list[list[tuple[int, float]]]) -> list[int | None]:
    """For each comment the symbol it gets in the heaviest assignment, or none.

    ``options``: (symbol, weight above 0) of each comment.  Successive shortest augmenting
    paths with potentials, over the given pairs only; a comment may stay without a symbol
    at weight 0, so it never takes a symbol from a heavier one.
    """
    owner: dict[int, int] = {}
    got: list[int | None] = [None] * len(options)
    price: dict[int, float] = {}
    for start, mine in enumerate(options):
        if not mine:
            continue
        # Distances to symbols, in terms of weight lost; -1 - k stands for "comment k gets none".
        best: dict[int, float] = {}
        came: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, far = start, 0.0
        base = max(0.0, *(x - price.get(j, 0.0) for j, x in mine))
        while True:
            for j, x in [*options[row], (-1 - row, 0.0)]:
                d = far + base - (x - price.get(j, 0.0))
                if j not in done and d < best.get(j, float("inf")) - 1e-12:
                    best[j], came[j] = d, row
                    heappush(heap, (d, j))
            while True:
                far, j = heappop(heap)
                if j not in done and far <= best[j] + 1e-12:
                    break
            done.add(j)
            if j < 0 or j not in owner:
                break
            row = owner[j]
            base = next(x for i, x in options[row] if i == j) - price.get(j, 0.0)
        # Symbols passed on the way become dearer by what the path saved on them.
        for x in done:
            if x >= 0:
                price[x] = price.get(x, 0.0) + far - best[x]
        while True:
            row = came[j]
            before = got[row]
            got[row] = j if j >= 0 else None
            if j >= 0:
                owner[j] = row
            if row == start:
                break
            j = before
    return got


def _links(rows: list[dict]) -> list[tuple[int, int, float]]:
    """(comment row, symbol row, weight) of a stretch of one file's symbols, in their order."""
    options = []
    for k, r in enumerate(rows):
        mine = []
        if r["_doc"] is not None:
            for j in range(max(0, k - REACH), min(len(rows), k + REACH + 1)):
                x = weight(j - k, r["_doc"][1], rows[j]["_names"], r["_doc"][0], rows[j]["name"])
                if x >= LEAST_WEIGHT:
                    mine.append((j, x))
        options.append(mine)
    return [(k, j, dict(options[k])[j]) for k, j in enumerate(assign(options)) if j is not None]


def _rows(rows: list[dict], first: int, last: int) -> list[tuple]:
    """The links of the comments of rows ``first`` to ``last`` that are at home here."""
    out = []
    for k, j, x in _links(rows):
        if first <= k < last and rows[k]["_home"]:
            c, y = rows[k], rows[j]
            out.append((y["id"], c["id"], y["signature"] or y["name"], c["_doc"][0], x, informative(c["_doc"][0], y["name"], y["_names"])))
    return out


SCHEMA = "id string, comment_id string, signature string, description string, weight double, informative boolean"


def newest(nodes: DataFrame) -> DataFrame:
    """The newest row of each id of kind function or method, by updated_at.

    Ties are decided by the whole row.  Rows without id are dropped.
    """
    cols = ["package", "kind", "name", "file_path", "start_line", "docstring", "signature"]
    n = nodes.where(F.col("id").isNotNull())
    best = n.groupBy("id").agg(F.max(F.struct("updated_at", *cols)).alias("_b"))
    return best.select("id", *[F.col(f"_b.{c}").alias(c) for c in cols]).where(F.lower(F.trim("kind")).isin("function", "method"))


def links(nodes: DataFrame) -> DataFrame:
    """(id, comment_id, signature, description, weight, informative): the comment assigned
    to each function or method.

    Symbols are gathered by file and block of ``BLOCK_LINES`` lines, sorted by line; those
    within ``MARGIN_LINES`` of a block's edge are given to the block beyond it as well, and
    each comment is answered for by its own block.  No task holds more than ``HELD`` symbols
    at a time.  Symbols without a file or line are spread by their id and have no
    neighbours.  Null, blank and repeated docstrings, null signatures, names and lines give
    no link or an uninformative one.
    """
    n = newest(nodes)
    line, known = F.col("start_line"), F.col("file_path").isNotNull() & F.col("start_line").isNotNull()
    own = F.floor(line / BLOCK_LINES)
    near = F.array_distinct(F.array(own, F.floor((line - MARGIN_LINES) / BLOCK_LINES), F.floor((line + MARGIN_LINES) / BLOCK_LINES)))
    n = n.withColumn("_block", F.explode(F.when(known, near).otherwise(F.array(F.lit(0).cast("bigint"))))).withColumn("_home", ~known | (F.col("_block") == own))
    key = F.when(known, F.xxhash64(F.coalesce("package", F.lit("")), "file_path", "_block")).otherwise(F.xxhash64(F.lit("\\"), "id"))
    s = n.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key", "file_path", "start_line", "id")
    names = ["_key", "_home", "id", "name", "signature", "docstring"]

    def run(batches):
        schema = pa.schema([("id", pa.string()), ("comment_id", pa.string()), ("signature", pa.string()), ("description", pa.string()), ("weight", pa.float64()), ("informative", pa.bool_())])
        held: list[dict] = []
        first = 0

        def emit(rows: list[tuple]):
            cols = list(zip(*rows)) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                if held and held[-1]["_key"] != r["_key"]:
                    out += _rows(held, first, len(held))
                    held, first = [], 0
                elif len(held) == HELD:
                    out += _rows(held, first, HELD - MARGIN)
                    held, first = held[HELD - 2 * MARGIN :], MARGIN
                r["_doc"] = parse(r["docstring"]) if (r["docstring"] or "").strip() else None
                r["_names"] = parameters(r["signature"])
                held.append(r)
            if out:
                yield emit(out)
        if held:
            yield emit(_rows(held, first, len(held)))

    return s.select(*names).mapInArrow(run, SCHEMA)

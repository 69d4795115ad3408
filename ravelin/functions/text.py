"""Text building blocks as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a task description (fixed values).
TASK_STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "from", "into", "how", "does", "what", "when", "where", "which", "all", "any", "get", "set", "use", "using", "via",
]
#: Words a query variant must not end in (fixed values).
DANGLING = ["a", "an", "the", "of", "for", "to", "in", "on", "at", "by", "with", "from", "and", "or", "but", "as", "is", "are"]


def tokens(c: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def significant(c: Column, most: int = 10) -> Column:
    """Search terms of a task: runs of letters, digits and underscores of at least three
    bytes, in lower case, each once in first-seen order, without stopwords, at most ``most``."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    kept = F.filter(F.transform(F.filter(runs, lambda t: F.octet_length(t) >= 3), F.lower), lambda t: ~t.isin(TASK_STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def phrase_text(c: Column) -> Column:
    """A text's tokens, each between two blanks, so phrases can be counted as substrings.

    Underscores separate tokens, as in the index of the symbol graph.
    """
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "  "), r"^ *(.*?) *$", " $1 ")


def phrase_needle(phrase: str) -> str:
    """A phrase in the form of ``phrase_text``."""
    return " " + "  ".join(re.findall(r"[^\W_]+", phrase.lower())) + " "


def phrase_count(c: Column, phrase: str) -> Column:
    """How often the tokens of ``phrase`` occur in a row in a text."""
    p = phrase_needle(phrase)
    hay = phrase_text(c)
    return ((F.length(hay) - F.length(F.replace(hay, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("bigint")


def snippet(c: Column, is_code: Column) -> Column:
    """The first 600 characters of code or 400 of documentation."""
    return F.when(is_code, F.substring(c, 1, 600)).otherwise(F.substring(c, 1, 400))


def normal_path(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("\\"), F.lit("/")))


def path_matches(c: Column, suffix: str) -> Column:
    """The path itself or a path that ends in ``/suffix`` or ``\\suffix``; letters of the
    suffix arms compare without case."""
    low = suffix.lower()
    return (c == suffix) | F.lower(c).endswith("/" + low) | F.lower(c).endswith("\\" + low)


def glob_regex(pattern: str, crosses: bool = True) -> str:
    """A glob as a regular expression: ``*`` any run (of one segment unless ``crosses``), ``?`` one."""
    out = []
    for ch in pattern:
        out.append((".*" if crosses else "[^/]*") if ch == "*" else "." if ch == "?" else re.escape(ch))
    return "^" + "".join(out) + "$"


def file_filter(c: Column, pattern: str | None) -> Column:
    """Glob if the pattern has a star, else substring without case; no pattern keeps all."""
    if not pattern:
        return F.lit(True)
    return c.rlike(glob_regex(pattern)) if "*" in pattern else F.lower(c).contains(pattern.lower())


def expand_braces(pattern: str) -> list[str]:
    """``a{b,c}d`` as ``abd`` and ``acd``; only the first group is expanded."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [pattern[: m.start()] + x.strip() + pattern[m.end() :] for x in m.group(1).split(",")]


def lines(c: Column) -> Column:
    """Lines without line ends; a final line end makes no further line."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n", "\n")
    return F.split(F.regexp_replace(body, "\n\\z", ""), "\n", -1)


def content_terms(c: Column, stop: list[str]) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(stop))


def acceptable_variant(variant: Column, original: Column, stop: list[str] | None = None) -> Column:
    """Whether a query variant may be added: four characters at least, no dangling last
    word, content words, one of them shared with the original if that has any."""
    stop = stop or sorted(set(DANGLING) | set(TASK_STOPWORDS))
    v, o = content_terms(variant, stop), content_terms(original, stop)
    last = F.try_element_at(tokens(variant), F.lit(-1))
    return (
        (F.length(F.trim(variant)) >= 4)
        & ~F.coalesce(last.isin(DANGLING), F.lit(False))
        & (F.size(v) > 0)
        & ((F.size(o) == 0) | F.arrays_overlap(v, o))
    )


def matches_name(query: Column, symbol: Column, signature: Column) -> Column:
    """At least half of the query's terms (three bytes or more) occur in name or signature."""
    hay = F.lower(F.concat_ws(" ", symbol, signature))
    terms = F.filter(tokens(query), lambda t: F.octet_length(t) >= 3)
    hit = F.size(F.filter(terms, lambda t: F.instr(hay, t) > 0))
    return (F.length(F.trim(hay)) > 0) & (F.size(terms) > 0) & (hit * 2 >= F.size(terms))


def significant_lines(c: Column) -> Column:
    """Lines with blanks collapsed that have four characters and a letter or digit."""
    flat = F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|\n|\r", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(flat, lambda x: (F.length(x) >= 4) & x.rlike(r"[\p{L}\p{N}]"))


def clean_comment(c: Column) -> Column:
    """A documentation comment without its marks, one line of text a line."""
    marks = r"^\s*(?:/\*\*?|\*/|\*|///?|#+|\"\"\")\s?|\s*(?:\*/|\"\"\")\s*$"
    kept = F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.trim(F.regexp_replace(x, marks, ""))), lambda x: x != "")
    return F.array_join(kept, "\n")


def without_chunk(c: Column) -> Column:
    """A stored document path without the number of its chunk (``a.md#3``)."""
    return F.regexp_replace(c, r"#\d+$", "")


def doc_path_matches(c: Column, wanted: str) -> Column:
    """``path_matches`` for stored documents, whatever the number of their chunk."""
    return path_matches(without_chunk(c), wanted)


def forward(c: Column) -> Column:
    """A path with forward slashes and none at its end."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "(?<=.)/+$", "")


def components(c: Column) -> Column:
    """The parts of a path, without empty ones and steps on the spot."""
    return F.filter(F.split(forward(c), "/"), lambda x: (x != "") & (x != "."))

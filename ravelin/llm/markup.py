"""Markup residue in text documents: which kinds there are, and clean text without it.

A small scanner for HTML, Markdown, wiki and LaTeX.  Code is set aside first, so markup
shown in a code block as a sample is no markup.  Texts may be cut anywhere: a part of a
tag, link, formula or emphasis at either end counts as well.
"""

from __future__ import annotations

import re
from html.entities import html5

#: Names of HTML elements (fixed values).
TAGS = frozenset(
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data "
    "dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i "
    "iframe img input ins kbd label legend li link main map mark meta nav noscript object ol optgroup option output p param pre q s samp "
    "script section select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
_ENTITIES = frozenset(k[:-1] for k in html5 if k.endswith(";"))
_BLOCK = frozenset("p div ul ol li table tr h1 h2 h3 h4 h5 h6 pre blockquote br hr section article header footer dl dt dd thead tbody".split())
#: Names of LaTeX commands that need no argument (fixed values).
_TEX_BARE = frozenset(
    "item sum cdot frac int prod sqrt alpha beta gamma delta epsilon lambda mu pi sigma omega infty leq geq neq times to rightarrow leftarrow Rightarrow "
    "ldots dots cdots in notin subset cup cap forall exists partial nabla hline maketitle tableofcontents newpage par noindent centering bf it rm tt quad qquad "
    "left right begin end section subsection chapter paragraph textbf emph texttt textit ref cite label footnote caption includegraphics usepackage documentclass".split()
)

_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(\s[^<>]*?|\s*/)?>")
_TAG_CUT = re.compile(r"(?<!\w)<(?:/?([A-Za-z][A-Za-z0-9]*)(\s[^<>]*)?|/|!-{0,2}[^>]*)\Z|(?<=\w)</[A-Za-z0-9]*\Z")
_TAG_TAIL = re.compile(r'\A(?:/?([A-Za-z][A-Za-z0-9]{0,9})|/|[\w-]*=?"?[^"<>\n]{0,60}")\s*/?>(?!>| or )')
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]{1,30}));")
_ENTITY_CUT = re.compile(r"&(?:#\w{0,6}|(?<!\w&)([A-Za-z]{1,8}))\Z")
_ENTITY_TAIL = re.compile(r"\A(?:#?3?9|nbsp|bsp|mdash|dash|ash|amp|quot|uot);")
_HEAD = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+\S|[ \t]*\Z)", re.M)
# Patterns begin with a letter of their own where they can, so the search leaps from one to the
# next; what is cut off by either end of a text is looked for in its first or last line only.
_UNDER = re.compile(r"\n(?:={3,}|-{3,})[ \t]*(?=\n|\Z)")
_STRONG = [re.compile(p) for p in (r"\*\*(?=\S)[^*\n]+?\*\*", r"__(?<!\w__)(?=\S)[^_\n]+__(?!\w)", r"~~(?=\S)[^~\n]+~~")]
_EM_STAR = re.compile(r"\*(?<![\w*\\]\*)(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])")
_EM_LINE = re.compile(r"_(?<![\w\\]_)(?=[^\W_])[^_\n.;$\\]{1,60}(?<=[^\s_])_(?!\w)")
_MARK_TAIL = re.compile(r"(?:\*\*|~~)(?=\S)[^*~\n]*[*~]?\Z|(?<!\w)__(?=\w)[^_\n]*_?\Z|(?<![\w*])\*(?=[^\s*])[^*\n]*\Z")
_MARK_HEAD = re.compile(r"[^\s*~_][^*~\n]{0,60}?(?:\*\*|~~)(?!\S)|[^\W_][^_\n]{0,60}__(?!\w)")
_LINK = [re.compile(p, re.M) for p in (r"\[[^\]\n]*\]\([^)\n]*\)", r"\[(?<![\w\]\[]\[)[^\]\[\n]+\]\[[^\]\n]*\]", r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S")]
_LINK_TAIL = re.compile(r"\]\([^)\n]*\Z|(?<!\w)!\[[^\]\n]*\]?\Z|(?<![\w\[\]])\[[A-Za-z][^\]\[\n]*\]?\Z|(?<![\w\]\[])\[[A-Za-z][^\]\[\n]*\]\[[^\]\n]*\Z")
_LINK_HEAD = re.compile(r"[^\[\n]*\]\([^)\n]+\)|[^\[\n]{0,40}\]\[\d+\]|[\w./-]*\.(?:md|png|html?|jpg|svg)\)|\d*\](?= )")
_QUOTE = re.compile(r"^ {0,3}>[ \t]?(?=\S)", re.M)
_TABLE = re.compile(r"^[ \t]*\|[^\n]*\|[ \t]*$|^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\||^\|[^|\n]*\|[^|\n]*\Z", re.M)
_BAR = re.compile(r"\|[ \t]*\n")
_WIKI_LINK = re.compile(r"\[\[[^\[\]\n]+\]\]|\[https?://[^\s\]]+ [^\]\n]+\]")
_WIKI_EM = re.compile(r"(?<!')'{2,5}(?=[^'\s])[^'\n]+'{2,5}(?!')")
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}\n]*\}\}")
_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*[^=\s][^\n]*?[ \t]*\1[ \t]*$|^={2,6} [^=\n]*=?\Z", re.M)
_WIKI_TABLE = re.compile(r"^\{\||^\|\}|^\|-[ \t]*$|^! \S", re.M)
_WIKI_TAIL = re.compile(r"\[\[[^\]\n]*\]?\Z|\{\{[^}\n]*\}?\Z|(?<!')'{2,5}(?=[^'\s])[^'\n]*'?\Z|\{\|?\Z(?<=\n\{)")
_WIKI_START = re.compile(r"[^\[\n]{0,60}\]\]|[^{\n]{0,60}\}\}(?!\})|[^'\n]{1,60}(?<=\S)'{2,5}(?![\w'])|(?![A-Z])[^=\n|]+ ={2,4}[ \t]*\n")
_TEX = re.compile(r"\\(?<![\w:\\]\\)([A-Za-z]+)(\*?[\[{])?|\\([A-Za-z]+)\*?\{")
_TEX_MATH = re.compile(r"(?<!\\)\\[\[\]()]|\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*[\\^_{}][^$\n]*(?<=\S)\$(?!\d)")
_TEX_FORMULA = [re.compile(p) for p in (r"\\(?<!\\\\)[\[\]()]", r"\$\$|\$(?<![\w$\\]\$)(?=[^\s$])[^$\n]*[\\^_{}][^$\n]*(?<=\S)\$(?!\d)")]
_TEX_TAIL = re.compile(r"(?<![\w$\\])\$(?=[^\s$])[^$\s]*[\\^_{}][^$\n]*\Z|(?<![\w:\\])\\\Z")
_TEX_HEAD = re.compile(r"[^$\s]{0,30}[{}^_][^$\s]{0,30}\$(?!\w)|[a-z]{1,14}\*?\{[^{}\n]*\}|\{[^{}\n]*\}|\w*\d\}(?=[$\s^])")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)[^\n`]*$", re.M)
_PRE = re.compile(r"<pre\b[^>]*>.*?(?:</pre>|\Z)", re.S | re.I)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}.*?(?:\\end\{\1\}|\Z)", re.S)
_NOWIKI = re.compile(r"<(nowiki|syntaxhighlight|source)\b[^>]*>.*?(?:</\1>|\Z)", re.S | re.I)
_INLINE = re.compile(r"(`+)(?=[^`])([^\n]*?[^`\n])\1(?!`)")


def _fences(t: str) -> tuple[list[tuple[int, int]], bool]:
    """Spans of fenced code (marks included), and whether there is any fence.

    A fence that follows the text's first lines without a blank line between closes a
    block whose beginning is cut off.
    """
    marks = list(_FENCE.finditer(t))
    if not marks:
        return [], False
    spans, k = [], 0
    first = marks[0].start()
    if first and "\n\n" not in t[:first].replace("\r", "") and len(marks) % 2 and t[:first].count("\n") <= 2:
        spans.append((0, marks[0].end()))
        k = 1
    while k < len(marks):
        end = marks[k + 1].end() if k + 1 < len(marks) else len(t)
        spans.append((marks[k].start(), end))
        k += 2
    return spans, True


def without_code(t: str) -> tuple[str, set[str]]:
    """The text with code taken out, and the kinds of markup that marked the code."""
    kinds: set[str] = set()
    if "```" in t or "~~~" in t:
        spans, any_fence = _fences(t)
        if any_fence:
            kinds.add("markdown")
        for a, b in reversed(spans):
            t = t[:a] + "\n" + t[b:]
    if "<" in t:
        if _PRE.search(t):
            kinds.add("html")
            t = _PRE.sub(" ", t)
        if _NOWIKI.search(t):
            kinds.add("wiki")
            t = _NOWIKI.sub(" ", t)
    if "\\begin{" in t and _VERBATIM.search(t):
        kinds.add("latex")
        t = _VERBATIM.sub(" ", t)
    if "`" in t:
        kinds.add("markdown")
        t = _INLINE.sub(" ", t)
    return t, kinds


def _is_html(t: str) -> bool:
    if "<" in t:
        if "<!--" in t or "<!DOCTYPE" in t:
            return True
        for m in _TAG.finditer(t):
            name = m.group(1).lower()
            if name not in TAGS:
                continue
            # ``List<label>`` is no tag; a tag glued to a word has an end tag somewhere.
            a = m.start()
            if t[a + 1] == "/" or m.group(2) or a == 0 or not (t[a - 1].isalnum() or t[a - 1] == "_"):
                return True
            if f"</{name}" in t.lower():
                return True
        m = _TAG_CUT.search(t[-120:])
        if m and (m.group(1) is None or any(x.startswith(m.group(1).lower()) for x in TAGS)):
            return True
    if "&" in t:
        for m in _ENTITY.finditer(t):
            if m.group(1) is None or m.group(1) in _ENTITIES:
                return True
        m = _ENTITY_CUT.search(t[-12:])
        if m and (m.group(1) is None or any(x.startswith(m.group(1)) for x in ("nbsp", "mdash", "ndash", "amp", "quot", "apos", "lt", "gt", "copy", "hellip"))):
            return True
    if ">" in t[:80]:
        m = _TAG_TAIL.match(t)
        if m and (m.group(1) is None or any(x.endswith(m.group(1).lower()) for x in TAGS if len(m.group(1)) > 1 or x == m.group(1).lower())):
            return m.group() not in (">",)
    return bool(_ENTITY_TAIL.match(t))


def _underlined(t: str) -> bool:
    """A heading with a line of ``=`` or ``-`` below it, whole or cut off."""
    if ("===" in t or "---" in t) and (t[0] in "=-" and _UNDER.match("\n" + t) or any(t[t.rfind("\n", 0, m.start()) + 1 : m.start()].strip() for m in _UNDER.finditer(t))):
        return True
    if not t.endswith("="):
        return False
    above, _, last = t.rpartition("\n")
    above = above[above.rfind("\n") + 1 :]
    return "=" not in above and bool(above.strip()) and not last.strip("=")


def _follows(t: str, at: int) -> bool:
    """True if something stands before ``at`` in its line."""
    while at and t[at - 1] in " \t":
        at -= 1
    return at > 0 and not t[at - 1].isspace()


def _is_markdown(t: str) -> bool:
    if "#" in t and _HEAD.search(t):
        return True
    if _underlined(t):
        return True
    last = t.rfind("\n") + 1
    if "*" in t or "_" in t or "~~" in t:
        if "*" in t and (_STRONG[0].search(t) or _EM_STAR.search(t)) or "_" in t and (_STRONG[1].search(t) or _EM_LINE.search(t)) or "~~" in t and _STRONG[2].search(t):
            return True
        if _MARK_HEAD.match(t) or _MARK_TAIL.search(t, last):
            return True
    if "[" in t and ("](" in t and _LINK[0].search(t) or "][" in t and _LINK[1].search(t) or "]:" in t and _LINK[2].search(t)):
        return True
    if ("[" in t or "]" in t or ")" in t[:60]) and (_LINK_HEAD.match(t) or _LINK_TAIL.search(t, last)):
        return True
    if "`" in t:
        return True
    if ">" in t:
        for m in _QUOTE.finditer(t):
            if m.start() or t[m.end() : m.end() + 1].isupper():
                return True
    return "|" in t and bool(_TABLE.search(t) or any(_follows(t, m.start()) for m in _BAR.finditer(t)))


def _is_wiki(t: str) -> bool:
    if "[[" in t and _WIKI_LINK.search(t) or "[http" in t and _WIKI_LINK.search(t):
        return True
    if "''" in t and _WIKI_EM.search(t):
        return True
    if "{{" in t and _WIKI_TEMPLATE.search(t):
        return True
    if "==" in t and _WIKI_HEAD.search(t):
        return True
    if ("|" in t or "! " in t) and _WIKI_TABLE.search(t):
        return True
    return bool(_WIKI_START.match(t) or _WIKI_TAIL.search(t, t.rfind("\n") + 1))


def _is_latex(t: str) -> bool:
    if "\\" in t:
        for m in _TEX.finditer(t):
            if m.group(2) or m.group(3) or m.group(1) in _TEX_BARE:
                return True
    if "\\" in t and _TEX_FORMULA[0].search(t) or "$" in t and _TEX_FORMULA[1].search(t):
        return True
    if _TEX_HEAD.match(t) or _TEX_TAIL.search(t, t.rfind("\n") + 1):
        return True
    # A command's name cut off at the end.
    m = re.search(r"(?<![\w:\\])\\([A-Za-z]{1,14})\Z", t[-20:])
    return bool(m and any(x.startswith(m.group(1)) for x in _TEX_BARE))


def kinds(text: str | None) -> list[str]:
    """The kinds of markup in a text, in the order html, markdown, wiki, latex."""
    if not text:
        return []
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    t, out = without_code(t)
    if "html" not in out and _is_html(t):
        out.add("html")
    if "markdown" not in out and _is_markdown(t):
        out.add("markdown")
    if "wiki" not in out and _is_wiki(t):
        out.add("wiki")
    if "latex" not in out and _is_latex(t):
        out.add("latex")
    return [k for k in ("html", "markdown", "wiki", "latex") if k in out]


# ---- conversion to clean text

#: What a text must hold for a rule, the rule, and what it puts in the place.
_RULES_BLOCK = [
    ("\\", re.compile(r"\\(?:part|chapter)\*?\{([^{}]*)\}"), r"\n# \1\n"),
    ("\\section", re.compile(r"\\section\*?\{([^{}]*)\}"), r"\n# \1\n"),
    ("\\subsection", re.compile(r"\\subsection\*?\{([^{}]*)\}"), r"\n## \1\n"),
    ("\\", re.compile(r"\\(?:subsubsection|paragraph)\*?\{([^{}]*)\}"), r"\n### \1\n"),
    ("\\item", re.compile(r"^[ \t]*\\item(?:\[[^\]]*\])?[ \t]*", re.M), "- "),
    ("\\", re.compile(r"^[ \t]*\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?[ \t]*$", re.M), ""),
    ("\\", re.compile(r"\\(?:begin|end)\{[^{}]*\}"), ""),
    ("\\label", re.compile(r"\\label\{[^{}]*\}"), ""),
    ("==", re.compile(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M), lambda m: "#" * (len(m.group(1)) - 1) + " " + m.group(2)),
    ("===", re.compile(r"^(?=[^\n]*\S)([^\n]+)\n={3,}[ \t]*$", re.M), r"# \1"),
    ("---", re.compile(r"^(?=[^\n]*\S)([^\n|>-][^\n|]*)\n-{3,}[ \t]*$", re.M), r"## \1"),
    ("---", re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*\n?", re.M), ""),
    ("|", re.compile(r"^\{\|[^\n]*\n?|^\|\}[ \t]*\n?|^\|-[^\n]*\n?", re.M), ""),
    ("", re.compile(r"^[!|][ \t]+([^|\n]*)$", re.M), r"\1"),
    ("|", re.compile(r"^[ \t]*\|(.*)\|[ \t]*$", re.M), lambda m: " | ".join(c.strip() for c in m.group(1).split("|"))),
    (">", re.compile(r"^ {0,3}>[ \t]?", re.M), ""),
    ("", re.compile(r"^[ \t]*[*+-][ \t]+", re.M), "- "),
]
_RULES_INLINE = [
    ("](", re.compile(r"!\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    ("](", re.compile(r"\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    ("][", re.compile(r"(?<![\w\]\[])\[([^\]\[\n]+)\]\[[^\]\n]*\]"), r"\1"),
    ("]:", re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S+[^\n]*\n?", re.M), ""),
    ("[[", re.compile(r"\[\[(?:Category|File|Image):[^\[\]\n]*\]\]"), ""),
    ("[[", re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]"), r"\1"),
    ("{{", re.compile(r"\{\{[^{}|\n]*\|([^{}\n]*)\}\}"), r"\1"),
    ("{{", re.compile(r"\{\{([^{}|\n]*)\}\}"), r"\1"),
    ("[http", re.compile(r"\[(?:https?://[^\s\]]+) ([^\]\n]+)\]"), r"\1"),
    ("''", re.compile(r"(?<!')'{2,5}(?=[^'\s])([^'\n]+)'{2,5}(?!')"), r"\1"),
    ("**", re.compile(r"\*\*(?=\S)([^*\n]+?)\*\*"), r"\1"),
    ("__", re.compile(r"(?<!\w)__(?=\S)([^_\n]+)__(?!\w)"), r"\1"),
    ("~~", re.compile(r"~~(?=\S)([^~\n]+)~~"), r"\1"),
    ("*", re.compile(r"\*(?<![\w*\\]\*)(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*(?![\w*])"), r"\1"),
    ("\\", re.compile(r"\\(?<![\w:\\]\\)(?:textbf|emph|texttt|textit|underline|footnote|ref|cite|url|caption|mbox|text)\*?(?:\[[^\]]*\])?\{([^{}]*)\}"), r"\1"),
]
_DISPLAY = re.compile(r"\\(?<!\\\\)\[(.+?)\\\]", re.S)
_KEPT = re.compile("\x00(\\d+)\x00")
_ENDS, _GAPS = re.compile(r"[ \t]+\n"), re.compile(r"\n{3,}")
_CELL = re.compile(r"</t[dh]>\s*<t[dh]\b[^>]*>", re.I)
_COMMENT = re.compile(r"<!--.*?-->", re.S)


def _entity(m: re.Match) -> str:
    from html import unescape

    s = unescape(m.group())
    return " " if s == "\xa0" else s


def _untag(m: re.Match) -> str:
    name = m.group(1).lower()
    if name not in TAGS:
        return m.group()
    a, t = m.start(), m.string
    end = t[a + 1] == "/"
    if not end and not m.group(2) and a and (t[a - 1].isalnum() or t[a - 1] == "_") and f"</{name}" not in t.lower():
        return m.group()
    if re.fullmatch(r"h[1-6]", name):
        return "\n" if end else "\n" + "#" * int(name[1]) + " "
    if name == "li":
        return "" if end else "\n- "
    return "\n" if name in _BLOCK else ""


def clean(text: str | None) -> str | None:
    """Clean text in one plain notation for structure, whatever the markup was.

    Headings become ``# title``, list items ``- item``, table rows ``a | b``, code stays
    between fences and formulas between dollars.  Emphasis, links, templates, comments
    and all other tags leave their visible text only.  Null stays null; a text without
    markup keeps its words and lines.
    """
    if text is None:
        return None
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    for a, b in reversed(_fences(t)[0] if "```" in t or "~~~" in t else []):
        body = _FENCE.sub("", t[a:b]).strip("\n")
        t = t[:a] + keep(f"```\n{body}\n```") + t[b:]
    if "<" in t:
        t = _PRE.sub(lambda m: "\n" + keep("```\n" + _ENTITY.sub(_entity, re.sub(r"</?[A-Za-z][^>]*>", "", m.group())).strip("\n") + "\n```") + "\n", t)
    if "\\begin{" in t:
        t = _VERBATIM.sub(lambda m: keep("```\n" + re.sub(r"\\(?:begin|end)\{\w+\}", "", m.group()).strip("\n") + "\n```"), t)
    if "`" in t:
        t = _INLINE.sub(lambda m: keep(m.group(2)), t)
    if "\\[" in t:
        t = _DISPLAY.sub(lambda m: keep(f"$${m.group(1).strip()}$$"), t)
    if "$" in t:
        t = _TEX_MATH.sub(lambda m: keep(m.group()) if m.group()[0] == "$" and len(m.group()) > 2 else m.group(), t)
    if "<" in t:
        t = _COMMENT.sub("", t)
        t = _CELL.sub(" | ", t)
        t = _TAG.sub(_untag, t)
    for needs, pattern, new in _RULES_BLOCK:
        if needs in t:
            t = pattern.sub(new, t)
    for needs, pattern, new in _RULES_INLINE:
        if needs in t:
            t = pattern.sub(new, t)
    if "&" in t:
        t = _ENTITY.sub(lambda m: _entity(m) if m.group(1) is None or m.group(1) in _ENTITIES else m.group(), t)
    while "\x00" in t:
        new = _KEPT.sub(lambda m: kept[int(m.group(1))] if int(m.group(1)) < len(kept) else "", t)
        if new == t:
            break
        t = new
    return _GAPS.sub("\n\n", _ENDS.sub("\n", t + "\n")).strip("\n")

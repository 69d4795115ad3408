"""Recursive-descent syntax check for source files of fourteen languages.

A text is cut into tokens and each token becomes one character of a *shape*: every name
is ``i``, every number ``0``, every string ``"``, each keyword and operator a character
of its own.  Statements are parsed by recursive descent over the shape, expressions by
precedence climbing.  After an error the parser goes on in panic mode at the next
statement, so all errors of a file are kept.

Names do not matter to syntax, so the verdict on a statement's shape is remembered and
repeated shapes (``let i = i + i;``) are parsed once per worker.  Only statements are
remembered, never files; a file whose statements do not all stand on their own is parsed
as a whole.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from functools import lru_cache

#: Extension to language (fixed values).
LANGUAGE = {
    "py": "python", "rs": "rust", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "java": "java", "go": "go", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "rb": "ruby", "cs": "csharp", "php": "php",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "sc": "scala",
}

_WORDS = """
if else elif elsif for foreach while until do loop return break continue switch case default match when try catch except
finally throw raise with def class fn fun func function let mut const var val static public private protected internal
import from use using package namespace module include struct impl trait interface enum object type extends implements
new in is as and or not lambda pass del global nonlocal assert yield async await export require end begin rescue ensure
unless then self next redo goto defer guard override final abstract sealed open data pub extern unsafe where template
typename void int long short char float double bool boolean unsigned signed signed_ virtual inline volatile register
operator typeof instanceof delete print echo typedef union move ref out readonly partial go chan map range fallthrough
select lazy implicit of constexpr noexcept friend throws undef alias super mod crate dyn init extension protocol native
""".split()
KW = {w: chr(0x100 + n) for n, w in enumerate(_WORDS)}
OPS = {
    "=>": "⇒", "->": "→", "<-": "←", "::": "∷", "...": "…", "..=": "…", "..<": "…", "..": "…", "++": "⧺", "--": "⊖",
    "**": "⋆", "&&": "∧", "||": "∨", "??": "⁇", "==": "≡", "!=": "≡", "===": "≡", "!==": "≡", "<=>": "≡", "<=": "≤", ">=": "≤",
    "<<": "«", "+=": "≔", "-=": "≔", "*=": "≔", "/=": "≔", "%=": "≔", "&=": "≔", "|=": "≔", "^=": "≔", "<<=": "≔",
    ">>=": "≔", "**=": "≔", "//=": "≔", "&&=": "≔", "||=": "≔", "??=": "≔", ":=": "≔", "?.": "⍰", "?:": "⁇", "=~": "≡", "//": "/",
}
#: Binary operators with their binding powers; right-associative ones in RIGHT.
POWER = {
    "≔": 1, "=": 1, "⇒": 2, "?": 3, "⁇": 4, "∨": 5, "∧": 6, "≡": 9, "<": 10, ">": 10, "≤": 10, "|": 7, "^": 7, "&": 8, "…": 11, "«": 12,
    "+": 13, "-": 13, "*": 14, "/": 14, "%": 14, "@": 14, "⋆": 16,
}
RIGHT = set("≔=⇒⁇⋆?")
BAD = "�"


@lru_cache(maxsize=None)
def _kw(*names: str) -> str:
    return "".join(KW[n] for n in names)


_C_KEYS = "if else for while do return break continue switch case default const static struct enum typedef union extern goto void int long short char float double unsigned signed volatile register inline"
#: Keywords per language; other names of the list above are plain names there (fixed values).
KEYWORDS = {
    "python": "if else elif for while return break continue try except finally raise with def class import from in is as and or not lambda pass del global nonlocal assert yield async await",
    "ruby": "if else elsif for while until do return break case when def class module end begin rescue ensure unless then in and or not next redo yield require self",
    "rust": "if else for while loop return break continue match fn let mut const static use struct impl trait enum type in as mod pub extern unsafe where self move ref dyn async await crate super",
    "javascript": "if else for while do return break continue switch case default try catch finally throw class function let const var import export from new in of typeof instanceof delete yield async await extends static void",
    "typescript": "if else for while do return break continue switch case default try catch finally throw class function let const var import export from new in of typeof instanceof delete yield async await extends static void interface enum type implements public private protected readonly abstract as namespace",
    "java": "if else for while do return break continue switch case default try catch finally throw class interface enum extends implements new import package public private protected static final abstract void int long short char float double boolean instanceof throws native assert",
    "go": "if else for return break continue switch case default func const var import package struct interface type go chan map range fallthrough select defer goto",
    "c": _C_KEYS,
    "cpp": _C_KEYS + " class namespace using template typename public private protected virtual operator new delete try catch throw constexpr noexcept friend bool override final",
    "csharp": "if else for foreach while do return break continue switch case default try catch finally throw class struct interface enum new using namespace public private protected internal static abstract sealed override virtual readonly const void int long short char float double bool is as in ref out partial async await typeof",
    "php": "if else elseif for foreach while do return break continue switch case default try catch finally throw class interface trait enum extends implements new use namespace public private protected static final abstract function const as echo print and or instanceof global fn match",
    "kotlin": "if else for while do return break continue when try catch finally throw class interface object fun val var import package in is as typealias public private protected internal override open abstract data enum final lateinit suspend inline const",
    "swift": "if else for while return break continue switch case default do catch throw throws try class struct enum protocol extension func let var import in is as guard defer init public private internal static override final where mutating open",
    "scala": "if else for while do return match case try catch finally throw class trait object def val var import package extends with new yield type lazy implicit override abstract final sealed private protected",
}
for _n, _w in enumerate(sorted({w for v in KEYWORDS.values() for w in v.split()} - set(KW))):
    KW[_w] = chr(0x300 + _n)
KW["elseif"] = KW["elsif"]

_STR = r'"(?:[^"\\\n]|\\.)*"'
_SQ = r"'(?:[^'\\\n]|\\.)*'"
_NUM = r"0[xX][0-9A-Fa-f_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[A-Za-z_]*\d*"
_OP = "|".join(re.escape(o) for o in sorted(OPS, key=len, reverse=True))
_C_COM = r"//[^\n]*|/\*(?s:.*?)\*/|/\*"
_HASH = r"#[^\n]*"
_LEX = {
    "python": rf'[rbfuRBFU]{{0,2}}"""(?:[^\\]|\\(?s:.))*?"""|[rbfuRBFU]{{0,2}}\'\'\'(?:[^\\]|\\(?s:.))*?\'\'\'|"""|\'\'\'|{_HASH}|[rbfuRBFU]{{0,2}}{_STR}|[rbfuRBFU]{{0,2}}{_SQ}|\\\n|\n[ \t]*',
    "ruby": rf"{_HASH}|{_STR}|{_SQ}|:[A-Za-z_]\w*|[@$]+[A-Za-z_]\w*|[A-Za-z_]\w*[?!](?!=)|\n",
    "rust": rf"{_C_COM}|{_STR}|'(?:[^'\\\n]|\\[^\n]{{1,8}})'|'[A-Za-z_]\w*|#!?\[[^\]\n]*\]|[A-Za-z_]\w*!",
    "javascript": rf"{_C_COM}|{_STR}|{_SQ}|`(?:[^`\\]|\\.)*`|(?<=[=(,:;!&|?{{}}+\n])\s*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|\#[A-Za-z_]\w*|\n",
    "java": rf"{_C_COM}|{_STR}|{_SQ}|@[A-Za-z_][\w.]*(?:\([^()\n]*\))?",
    "go": rf"{_C_COM}|{_STR}|`[^`]*`|{_SQ}|\n",
    "c": rf"{_C_COM}|(?m:^[ \t]*\#[ \t]*(?:include|define|if|ifdef|ifndef|else|elif|endif|undef|pragma|error|line|warning)\b(?:[^\n\\]|\\.|\\\n)*$)|[LuU]?{_STR}|{_SQ}",
    "csharp": rf'{_C_COM}|(?m:^[ \t]*\#(?:region|endregion|if|else|elif|endif|pragma|define|undef|nullable)[^\n]*$)|@"(?:[^"]|"")*"|\$?{_STR}|{_SQ}',
    "php": rf"{_C_COM}|\#(?!\[)[^\n]*|{_STR}|{_SQ}|<\?php|<\?=|\?>|\$[A-Za-z_]\w*|\\?[A-Za-z_]\w*(?:\\[A-Za-z_]\w*)+",
    "kotlin": rf'{_C_COM}|"""(?s:.*?)"""|{_STR}|{_SQ}|@[A-Za-z_][\w.]*(?:\([^()\n]*\))?|`[^`\n]+`|\n',
    "swift": rf'{_C_COM}|"""(?s:.*?)"""|{_STR}|@[A-Za-z_]\w*(?:\([^()\n]*\))?|\#if[^\n]*|\#else[^\n]*|\#endif[^\n]*|\n',
    "scala": rf'{_C_COM}|"""(?s:.*?)"""|[sf]?{_STR}|\'(?:[^\'\\\n]|\\.)\'|@[A-Za-z_]\w*(?:\([^()\n]*\))?|\n',
}
_LEX["typescript"] = _LEX["javascript"] + r"|@[A-Za-z_][\w.]*"
_LEX["cpp"] = _LEX["c"]
_MARK = r"(?m:^(?:<{7}|>{7}|\|{7}|={7})(?=[ \n]|\Z)[^\n]*)"
LEXER = {k: re.compile(rf"{_MARK}|{v}|[A-Za-z_$ª-\U0010ffff][\w$]*|{_NUM}|{_OP}|\S") for k, v in _LEX.items()}


class _Shapes(dict):
    """Token to its character of the shape; unknown tokens are classified once."""

    def __init__(self, lang: str):
        self.lang = lang
        self.fixed = {w: KW[w] for w in KEYWORDS[lang].split()} | OPS
        if lang != "python":  # a bare ``//`` is an empty comment
            del self.fixed["//"], self.fixed["//="]
        if lang not in ("kotlin", "php"):  # no operator of its own
            self.fixed["?:"] = "?:"
        super().__init__(self.fixed)

    def __missing__(self, t: str) -> str:
        if len(self) > 300_000:
            self.clear()
            self.update(self.fixed)
        c = self[t] = self.kind(t)
        return c

    def kind(self, t: str) -> str:
        a, lang = t[0], self.lang
        if len(t) >= 7 and t[:7] in ("<<<<<<<", ">>>>>>>", "|||||||", "======="):
            return BAD
        if lang == "python":
            if a == "\n":
                return "\n" + chr(0x1000 + len(t.expandtabs(8)) - 1)
            if t == "\\\n":
                return ""
            if a == "#":
                return ""
            if t in ('"""', "'''"):
                return BAD
        if a == "\n":
            return "\n"
        if a == "/" and len(t) > 1 and t[1] in "/*":
            return "" if t != "/*" else BAD
        if a == "#":
            if lang == "ruby":
                return ""
            if lang == "php":
                return ""
            if lang in ("c", "cpp", "csharp"):
                return "" if len(t) > 1 else BAD
            if lang in ("rust", "swift"):
                return "" if len(t) > 1 else BAD
            if lang == "javascript" and len(t) > 1:
                return "i"
            return BAD
        s = t.lstrip()
        if s[:1] == "#" and lang in ("c", "cpp", "csharp"):
            return ""
        if s[:1] == "/" and len(s) > 1:
            return '"'
        if a == "@" and len(t) > 1:
            return '"' if t[1] == '"' else ("i" if lang == "ruby" else "@")
        if t[-1] in "\"'`" and len(t) > 1:
            return "i" if lang in ("kotlin", "swift") and a == "`" else '"'
        if a == "'" and lang == "rust" and len(t) > 1:
            return "'"
        if a in "\"'`":
            return BAD
        if a.isdigit():
            # A number run together with a name, such as a sloppily cut word, is no number.
            return "0" if re.fullmatch(r"0[xXbBoO][0-9A-Fa-f_]+[uUlL]*|[\d_]+(?:\.[\d_]+)?(?:[eE][+-]?\d+)?(?:[a-zA-Z]{0,5}\d{0,3})", t) else BAD
        if lang == "php":
            if t in ("<?php", "<?="):
                return "⟦"
            if t == "?>":
                return "⟧"
            if a == "$" and len(t) > 1:
                return "i"
            if "\\" in t and len(t) > 1:
                return "n"
            if a.isalpha() or a == "_":
                return "n"
            if t.lower() in self.fixed:
                return self.fixed[t.lower()]
        if lang == "ruby" and a == ":" and len(t) > 1:
            return '"'
        if lang == "rust" and t[-1] == "!" and len(t) > 1:
            return "m"
        if lang == "ruby" and a == "$" and len(t) > 1:
            return "i"
        if a.isalpha() or a in "_$" or (ord(a) > 127 and (a.isalnum() or a.isidentifier())):
            return "i"
        if a in "()[]{};,.:?=+-*/%<>!&|^~@":
            return a
        if a == "\\" and lang == "php":
            return "n"
        return BAD


_SHAPES: dict[str, _Shapes] = {}


def shape(lang: str, text: str) -> str:
    """The text as one character a token; comments leave nothing, unknown characters BAD."""
    k = _SHAPES.get(lang)
    if k is None:
        k = _SHAPES[lang] = _Shapes(lang)
    return "".join([k[t] for t in LEXER[lang].findall(text)])


class Fault(Exception):
    def __init__(self, at: int, why: str):
        self.at, self.why = at, why


K = KW
_MODIFIERS = {
    "java": _kw("public", "private", "protected", "static", "final", "abstract", "native") + "@",
    "csharp": _kw("public", "private", "protected", "internal", "static", "abstract", "sealed", "override", "virtual", "readonly", "partial", "async", "const"),
    "kotlin": _kw("public", "private", "protected", "internal", "override", "open", "abstract", "data", "final", "lateinit", "suspend", "inline", "const") + "@",
    "swift": _kw("public", "private", "internal", "static", "override", "final", "open", "mutating") + "@",
    "scala": _kw("private", "protected", "override", "abstract", "final", "sealed", "lazy", "implicit") + "@",
    "php": _kw("public", "private", "protected", "static", "final", "abstract"),
    "typescript": _kw("export", "default", "public", "private", "protected", "readonly", "abstract", "static", "async") + "@",
    "javascript": _kw("export", "default", "static", "async"),
    "rust": _kw("pub", "unsafe", "extern", "async", "const", "static"),
    "c": _kw("static", "const", "extern", "inline", "volatile", "register"),
    "cpp": _kw("static", "const", "extern", "inline", "volatile", "register", "virtual", "constexpr", "friend"),
    "go": "",
}
_PRIMITIVE = set(_kw("void", "int", "long", "short", "char", "float", "double", "bool", "boolean", "unsigned", "signed"))
_NL = {"go", "kotlin", "swift", "scala", "javascript", "typescript"}


class Parser:
    """Recursive descent over one shape of a language with braces."""

    def __init__(self, lang: str, s: str):
        self.lang, self.s, self.n, self.p = lang, s, len(s), 0
        self.nl = lang in _NL
        self.errors: list[tuple[int, str]] = []
        self.depth = 0  # inside round or square brackets line ends mean nothing
        self.nobrace = 0  # a brace opens the body and no literal
        self.mods = _MODIFIERS.get(lang, "")

    # ---- tokens
    def peek(self) -> str:
        if self.depth and self.nl:
            while self.p < self.n and self.s[self.p] == "\n":
                self.p += 1
        return self.s[self.p] if self.p < self.n else ""

    def skip_nl(self) -> str:
        while self.p < self.n and self.s[self.p] == "\n":
            self.p += 1
        return self.s[self.p] if self.p < self.n else ""

    def after_nl(self) -> str:
        q = self.p
        while q < self.n and self.s[q] == "\n":
            q += 1
        return self.s[q] if q < self.n else ""

    def fault(self, why: str):
        raise Fault(min(self.p, self.n), why if self.p < self.n else why + " (the text ends)")

    def take(self, c: str, why: str = ""):
        if self.peek() != c:
            self.fault(why or f"'{c}' is missing")
        self.p += 1

    def maybe(self, c: str) -> bool:
        if self.peek() == c:
            self.p += 1
            return True
        return False

    def name(self):
        if self.peek() not in ("i", "n") or not self.peek():
            self.fault("a name is missing")
        self.p += 1

    # ---- types
    def type_(self):
        """A type of any of the languages."""
        lang = self.lang
        c = self.peek()
        while c and not (lang == "go" and c == K["struct"]) and c in "&*?[(" + "'" + _kw("mut", "dyn", "const", "struct", "unsigned", "signed", "typename", "enum", "chan", "in", "out", "ref", "final", "readonly", "static"):
            if c == "[":
                self.p += 1
                self.depth += 1
                if self.peek() != "]":
                    self.type_() if lang != "go" else self.expr()
                    if self.maybe(";"):
                        self.expr()
                    while self.maybe(",") or self.maybe(":"):
                        self.type_()
                self.depth -= 1
                self.take("]")
                if lang == "go":
                    c = self.peek()
                    continue
                break
            if c == "(":
                self.p += 1
                self.depth += 1
                while self.peek() != ")":
                    if self.peek() == "i" and self.s[self.p + 1 : self.p + 2] == ":":
                        self.p += 2
                    self.type_()
                    if not self.maybe(","):
                        break
                self.depth -= 1
                self.take(")")
                break
            self.p += 1
            if c in _PRIMITIVE and self.peek() not in _PRIMITIVE and self.peek() != "i":
                break
            c = self.peek()
        else:
            c = self.peek()
            if c and c in _PRIMITIVE:
                while self.peek() and self.peek() in _PRIMITIVE:
                    self.p += 1
            elif c == K["func"] and lang == "go":
                self.p += 1
                self.params()
                if self.peek() in ("i", "*", "(", "["):
                    self.type_()
                return
            elif c == K["map"] and lang == "go":
                self.p += 1
                self.take("[")
                self.type_()
                self.take("]")
                self.type_()
                return
            elif c in (K["interface"], K["struct"]) and lang == "go":
                self.p += 1
                self.take("{")
                self.body("class")
                return
            elif c == K["fn"] and lang == "rust":
                self.p += 1
                self.params()
            elif c in ("{",) and lang == "typescript":
                self.p += 1
                self.body("class")
            elif c in ('"', "0") and lang == "typescript":
                self.p += 1
            elif c and c in _kw("self", "crate", "super", "void", "typeof"):
                self.p += 1
                if c == K["typeof"]:
                    self.name()
            else:
                self.name()
        while True:
            c = self.peek()
            if c in (".", "∷") and c:
                self.p += 1
                if self.peek() == "<":
                    continue
                if self.maybe("*"):
                    continue
                self.name()
            elif c == "<" and lang not in ("go", "c", "scala", "php"):
                self.generics()
            elif c == "[" and lang in ("java", "csharp", "typescript", "javascript", "scala", "go"):
                if lang in ("scala", "go"):
                    self.p += 1
                    self.depth += 1
                    self.type_()
                    while self.maybe(","):
                        self.type_()
                    self.depth -= 1
                    self.take("]")
                else:
                    self.p += 1
                    if self.peek() not in ("]", ","):
                        self.expr()
                    while self.maybe(","):
                        pass
                    self.take("]")
            elif c and c in "*&" and lang in ("c", "cpp", "csharp"):
                self.p += 1
                while self.maybe(K["const"]):
                    pass
            elif c == K["const"] and lang in ("c", "cpp"):
                self.p += 1
            elif c == "?" and lang in ("kotlin", "swift", "csharp"):
                self.p += 1
            elif c == "!" and lang == "swift":
                self.p += 1
            elif c and c in "|&" and lang in ("typescript", "php"):
                self.p += 1
                self.type_()
            elif c == "+" and lang == "rust":
                self.p += 1
                self.type_()
            elif c in ("→", "⇒") and lang in ("kotlin", "swift", "scala", "rust", "typescript") and (lang != "rust" or self.s[self.p - 1] == ")"):
                if lang == "typescript" and self.s[self.p - 1] != ")":
                    return
                self.p += 1
                self.type_()
            else:
                return

    def generics(self):
        self.take("<")
        self.depth += 1
        while self.peek() != ">":
            if self.peek() in ("?", "0", '"') and self.peek():
                self.p += 1
                if self.peek() and self.peek() in _kw("extends"):
                    self.p += 1
                    self.type_()
            else:
                if self.peek() and self.peek() in _kw("in", "out", "class", "typename", "const"):
                    self.p += 1
                self.type_()
            if self.peek() and self.peek() in ":=" + _kw("extends"):
                self.p += 1
                self.type_()
            if not self.maybe(","):
                break
        self.depth -= 1
        self.take(">")

    def params(self):
        """A bracketed list of parameters."""
        lang = self.lang
        self.take("(")
        self.depth += 1
        while self.peek() != ")":
            while self.peek() and self.peek() in "@…" + _kw("final", "mut", "ref", "out", "const", "static", "public", "private", "protected", "readonly", "val", "var", "override", "implicit") and not (lang in ("c", "cpp") and self.peek() == K["const"]):
                self.p += 1
            if lang in ("c", "cpp", "java", "csharp"):
                if self.peek() == "…":
                    self.p += 1
                else:
                    self.type_()
                    if self.peek() == "…":
                        self.p += 1
                    if self.peek() in ("i",):
                        self.p += 1
                    while self.peek() == "[":
                        self.p += 1
                        if self.peek() != "]":
                            self.expr()
                        self.take("]")
                    if self.maybe("="):
                        self.expr(2)
            elif lang == "rust":
                while self.peek() and self.peek() in "&'" + _kw("mut"):
                    self.p += 1
                if self.maybe(K["self"]):
                    if self.maybe(":"):
                        self.type_()
                else:
                    self.primary()
                    self.take(":")
                    self.type_()
            elif lang == "go":
                self.type_()
                if self.peek() not in (",", ")"):
                    self.maybe("…")
                    self.type_()
            elif lang == "php":
                if self.peek() != "i":
                    self.maybe("?")
                    self.type_()
                self.maybe("&")
                self.maybe("…")
                self.take("i", "a parameter is missing")
                if self.maybe("="):
                    self.expr(2)
            elif lang == "swift":
                self.name()
                if self.peek() == "i":
                    self.p += 1
                self.take(":")
                self.maybe(K["in"])
                self.maybe("@")
                self.type_()
                self.maybe("…")
                if self.maybe("="):
                    self.expr(2)
            elif lang in ("kotlin", "scala"):
                self.name()
                self.take(":")
                self.maybe("⇒")
                self.type_()
                self.maybe("*")
                if self.maybe("="):
                    self.expr(2)
            else:  # javascript, typescript
                if self.peek() and self.peek() in "[{":
                    self.primary()
                else:
                    self.name()
                if lang == "typescript":
                    self.maybe("?")
                    if self.maybe(":"):
                        self.type_()
                if self.maybe("="):
                    self.expr(2)
            if not self.maybe(","):
                break
        self.depth -= 1
        self.take(")")
        if lang == "scala" and self.peek() == "(":
            self.params()

    # ---- expressions, by precedence climbing
    def expr(self, least: int = 1):
        self.unary()
        while True:
            c = self.peek()
            if not c:
                return
            if c == "\n":
                # A line that starts with a dot or an operator continues the expression.
                nxt = self.after_nl()
                if nxt and (nxt in ".⍰" or (self.lang in ("kotlin", "javascript", "typescript", "scala", "swift") and nxt in "∧∨⁇?")) and not (nxt == "?" and self.lang == "swift"):
                    self.skip_nl()
                    continue
                return
            power = POWER.get(c)
            if power is None:
                if c and c in _kw("in", "is", "as", "instanceof", "of", "until", "and", "or") and c in self.words():
                    if least > 9:
                        return
                    self.p += 1
                    if c in _kw("is", "as", "instanceof"):
                        self.maybe("?")
                        self.maybe("!")
                        self.type_()
                    else:
                        self.expr(10)
                    continue
                if c == "i" and self.lang in ("kotlin", "scala") and self.s[self.p + 1 : self.p + 2] not in ("\n", "", ";", "}", "="):
                    # An infix call by name, as in ``0 until n``.
                    if least > 11:
                        return
                    self.p += 1
                    self.expr(12)
                    continue
                if c == K["match"] and self.lang == "scala":
                    self.p += 1
                    self.take("{")
                    self.body("match")
                    continue
                return
            if power < least:
                return
            if c == "{":
                return
            self.p += 1
            if c == ">" and self.peek() == ">":
                self.p += 1
                if self.peek() == ">":
                    self.p += 1
            if self.nl:
                self.skip_nl()
            if c == "?":
                if self.lang == "rust" or (self.lang in ("kotlin",) and self.peek() in ".,)"):
                    continue
                self.expr(2)
                if self.nl:
                    self.skip_nl()
                self.take(":", "the other branch of the condition is missing")
                if self.nl:
                    self.skip_nl()
                self.expr(2)
            elif c == "⇒":
                if self.peek() == "{":
                    self.p += 1
                    self.body("func")
                else:
                    self.expr(2)
            elif c == "…" and (self.peek() in ("]", ")", "{", "") or self.peek() in (";",)):
                continue
            else:
                self.expr(power if c in RIGHT else power + 1)

    def words(self) -> str:
        return _WORDOPS.get(self.lang, "")

    def unary(self):
        c = self.peek()
        if self.lang == "php" and c == "(" and self.s[self.p + 1 : self.p + 3] == "n)":
            self.p += 3
            return self.unary()
        while c and c in "-+!~&*⧺⊖…⋆@" + _UNARY.get(self.lang, ""):
            self.p += 1
            c = self.peek()
        if c and c in _kw("return", "throw", "break", "continue") and self.lang in ("kotlin", "rust", "scala", "php", "csharp"):
            self.p += 1
            if self.peek() not in (")", "}", ";", ",", "\n", ""):
                self.expr(2)
            return
        self.primary()
        self.postfix()

    def items(self, close: str, entry=None):
        """Comma-separated expressions up to ``close``; a comma may trail."""
        self.depth += 1
        while self.peek() != close:
            if self.peek() == "," and self.lang in ("javascript", "typescript"):
                self.p += 1
                continue
            (entry or self.entry)()
            if not self.maybe(","):
                break
        self.depth -= 1
        self.take(close, f"'{close}' is missing")

    def entry(self):
        self.maybe("…")
        if self.peek() and self.peek() in "i\"" + _kw("default") and self.s[self.p + 1 : self.p + 2] == ":" and self.lang in ("swift", "kotlin", "csharp", "php", "javascript", "typescript", "go"):
            self.p += 2
        elif self.peek() == "n" and self.s[self.p + 1 : self.p + 2] == ":":
            self.p += 2
        if self.peek() and self.peek() in _kw("ref", "out"):
            self.p += 1
        if self.peek() == "{" and self.lang in ("c", "cpp", "java", "go", "csharp"):
            self.p += 1
            return self.items("}")
        if self.peek() == "." and self.lang in ("c", "cpp"):
            self.p += 1
            self.name()
            self.take("=")
            return self.entry()
        self.expr(2 if self.lang not in ("kotlin", "scala", "csharp", "php") else 1)
        if self.lang == "go" and self.maybe(":"):
            self.entry()
        if self.lang == "swift" and self.maybe(":"):
            self.expr(2)

    def primary(self):
        c, lang = self.peek(), self.lang
        if c == "i" or c == "0":
            self.p += 1
            if lang == "csharp" and self.peek() == "i" and self.s[self.p + 1 : self.p + 2] in ("=", ")", ",", ";"):
                self.p += 1
        elif c == "n":
            self.p += 1
        elif c == '"':
            self.p += 1
            while self.peek() == '"' and lang in ("c", "cpp"):
                self.p += 1
        elif c == "m":
            self.p += 1
            o = self.peek()
            if o and o in "([{":
                self.p += 1
                self.macro({"(": ")", "[": "]", "{": "}"}[o])
            else:
                self.fault("the macro has no arguments")
        elif c == "(":
            self.p += 1
            self.depth += 1
            hold, self.nobrace = self.nobrace, 0
            while self.peek() != ")":
                self.maybe("…")
                if lang in ("c", "cpp", "java", "csharp") and (self.peek() in _PRIMITIVE or self.peek() == K["const"]):
                    self.type_()
                    if self.peek() == "i":
                        self.p += 1
                elif lang == "kotlin" and self.peek() in (K["val"], K["var"]):
                    self.p += 1
                else:
                    self.expr()
                    if lang in ("typescript", "scala", "swift", "rust", "kotlin") and self.maybe("?"):
                        pass
                    if lang in ("typescript", "scala", "swift") and self.maybe(":"):
                        self.type_()
                        if self.maybe("="):
                            self.expr(2)
                if not self.maybe(","):
                    break
            self.depth -= 1
            self.nobrace = hold
            self.take(")", "')' is missing")
            if lang == "typescript" and self.peek() == ":" and re.match(r":[i.<>\[\]|]+⇒", self.s[self.p : self.p + 40]):
                self.p += 1
                self.type_()
            nxt = self.peek()
            if lang in ("c", "cpp", "java", "csharp") and nxt and (nxt in "i0\"" or nxt == "("):
                if self.s[self.p - 2] in "i*>]" or self.s[self.p - 2] in _PRIMITIVE:
                    self.unary()  # a cast
        elif c == "[":
            self.p += 1
            hold, self.nobrace = self.nobrace, 0
            if lang in ("cpp",):
                self.items("]")
                if self.peek() == "(":
                    self.params()
                self.take("{")
                self.body("func")
            elif lang == "go":
                if self.peek() != "]":
                    self.expr()
                self.take("]")
                self.type_()
                self.take("{")
                self.items("}")
            elif lang == "rust":
                self.depth += 1
                while self.peek() != "]":
                    self.expr()
                    if not (self.maybe(",") or self.maybe(";")):
                        break
                self.depth -= 1
                self.take("]")
            elif lang in ("php", "javascript", "typescript", "csharp", "swift", "kotlin"):
                self.items("]")
            else:
                self.fault("unexpected '['")
            self.nobrace = hold
        elif c == "{" and lang in ("javascript", "typescript"):
            self.p += 1
            self.items("}", self.property)
        elif c == "{" and lang in ("kotlin", "swift", "scala", "rust"):
            self.p += 1
            self.body("func")
        elif c == "{" and lang in ("c", "cpp", "java", "csharp"):
            self.p += 1
            self.items("}")
        elif c == "|" and lang == "rust" or c == "∨" and lang == "rust":
            self.p += 1
            if c == "|":
                while self.peek() != "|":
                    self.maybe("&")
                    self.maybe(K["mut"])
                    self.primary()
                    if self.maybe(":"):
                        self.type_()
                    if not self.maybe(","):
                        break
                self.take("|")
            if self.maybe("→"):
                self.type_()
            self.expr(2)
        elif c == "<" and lang in ("rust",):
            self.generics()
            self.take("∷")
            self.name()
        elif c == "'" and lang == "rust":
            self.p += 1
        elif c and c == K["new"] and lang in ("java", "javascript", "typescript", "csharp", "cpp", "php", "scala"):
            self.p += 1
            if lang == "csharp" and self.peek() in ("{", "("):
                pass
            elif lang in ("javascript", "typescript", "php") and self.peek() == "(":
                pass
            elif lang in ("javascript", "typescript", "php"):
                self.primary()
                while self.maybe("."):
                    self.name()
                if self.peek() == "<":
                    self.generics()
            else:
                self.type_()
            if self.maybe("("):
                self.items(")")
            if self.peek() == "{" and lang in ("java", "csharp", "scala"):
                self.p += 1
                self.items("}") if lang == "csharp" or self.s[self.p : self.p + 1] in ('"', "0", "i", "{") else self.body("class")
        elif c and c in (K["function"], K["func"], K["fn"], K["fun"]):
            if lang == "rust" or lang == "swift":
                self.fault("unexpected definition")
            self.p += 1
            self.maybe("*")
            if self.peek() == "i":
                self.p += 1
            self.maybe("&")
            self.params()
            if lang == "php" and self.maybe(K["use"]):
                self.take("(")
                self.items(")")
            if self.peek() in (":", "i", "*", "(", "[") and self.peek():
                self.maybe(":")
                self.type_()
            if lang == "php" and self.maybe("⇒"):
                self.expr(2)
            else:
                self.take("{")
                self.body("func")
        elif c and c == K["class"] and lang in ("javascript", "typescript"):
            self.p += 1
            if self.peek() == "i":
                self.p += 1
            if self.maybe(K["extends"]):
                self.expr(10)
            self.take("{")
            self.body("class")
        elif c and c == K["if"] and lang in ("rust", "kotlin", "scala"):
            self.if_()
        elif c and c in (K["match"], K["when"]) and lang in ("rust", "kotlin", "php", "csharp"):
            self.p += 1
            if self.peek() != "{":
                self.head()
            self.take("{")
            self.body("match")
        elif c and c in _kw("self", "super", "crate", "import", "void", "object", "try", "loop", "async", "require", "typeof", "map", "struct", "static", "init") and (c in _PRIM_WORDS.get(lang, "")):
            self.p += 1
            if c == K["map"]:
                self.p -= 1
                self.type_()
                self.take("{")
                self.items("}")
            if c in (K["try"], K["loop"]) and self.peek() == "{":
                self.p += 1
                self.body("func")
        elif c and c in _PRIMITIVE and lang in ("cpp", "csharp", "java", "c"):
            self.p += 1
        else:
            self.fault("an expression is missing" if c not in (BAD,) else "unexpected character")

    def macro(self, close: str):
        self.depth += 1
        while self.peek() != close:
            if not self.peek():
                self.fault(f"'{close}' is missing")
            o = self.peek()
            self.p += 1
            if o in "([{":
                self.macro({"(": ")", "[": "]", "{": "}"}[o])
            elif o in ")]}" + BAD:
                self.fault("unbalanced macro")
        self.depth -= 1
        self.take(close)

    def property(self):
        """An entry of an object literal."""
        if self.maybe("…"):
            return self.expr(2)
        while self.peek() and self.peek() in _kw("async", "static") and self.s[self.p + 1 : self.p + 2] in ("i", "*", '"'):
            self.p += 1
        self.maybe("*")
        if self.maybe("["):
            self.expr()
            self.take("]")
        elif self.peek() and (self.peek() in "i\"0" or self.peek() >= "Ā"):
            self.p += 1
            if self.peek() in ("i",) and self.s[self.p + 1 : self.p + 2] == "(":
                self.p += 1
        else:
            self.fault("a property is missing")
        if self.peek() == "(":
            self.params()
            if self.maybe(":"):
                self.type_()
            self.take("{")
            self.body("func")
        elif self.maybe(":"):
            self.expr(2)
        elif self.maybe("="):
            self.expr(2)

    def postfix(self):
        lang = self.lang
        while True:
            c = self.peek()
            if not c:
                return
            if c in ".⍰∷" or (c == "→" and lang in ("php", "c", "cpp")):
                self.p += 1
                if self.nl:
                    self.skip_nl()
                if self.peek() == "<" and lang == "rust":
                    self.generics()
                elif self.peek() == "(" and lang == "go":
                    self.p += 1
                    self.type_()
                    self.take(")")
                elif self.peek() in ("(", "[") and c in "⍰.":
                    continue
                elif self.peek() and (self.peek() in "0in" or (self.peek() >= "Ā" and self.peek() < "Ѐ")):
                    self.p += 1
                elif self.peek() == "{" and lang == "rust":
                    self.p += 1
                    self.items("}")
                elif self.peek() == "*" and lang in ("rust", "java"):
                    self.p += 1
                else:
                    self.fault("a member is missing")
            elif c == "(":
                self.p += 1
                hold, self.nobrace = self.nobrace, 0
                self.items(")")
                self.nobrace = hold
            elif c == "[":
                self.p += 1
                self.depth += 1
                while self.peek() != "]":
                    if not self.maybe(":"):
                        self.expr()
                    if not (self.maybe(",") or self.peek() in (":", "]")):
                        break
                self.depth -= 1
                self.take("]")
            elif c in "⧺⊖":
                self.p += 1
            elif c == "!" and lang in ("typescript", "kotlin", "swift"):
                self.p += 1
            elif c == "?" and lang == "rust":
                self.p += 1
            elif c == '"' and lang in ("javascript", "typescript") and self.s[self.p - 1] in "i)":
                return
            elif c == "{" and not self.nobrace and lang in ("rust", "go", "kotlin", "swift", "scala", "cpp") and self.s[self.p - 1] in "i)>":
                self.p += 1
                if lang in ("rust", "go", "cpp"):
                    self.items("}", self.field if lang == "rust" else None)
                else:
                    self.body("func")
            elif c == "<" and lang in ("java", "csharp", "cpp", "typescript", "kotlin", "swift"):
                hold = self.p
                try:
                    self.generics()
                    if self.peek() not in ("(", "∷", "{", ")", ".", "i", ">") or not self.peek():
                        raise Fault(self.p, "")
                    if self.peek() == "i" and self.s[self.p - 1] != ">":
                        raise Fault(self.p, "")
                    if self.peek() == "i":
                        self.p = hold
                        return
                except Fault:
                    self.p = hold
                    return
            else:
                return

    def field(self):
        if self.maybe("…"):
            return self.expr()
        self.name()
        if self.maybe(":"):
            self.expr(2)

    # ---- statements
    def head(self):
        """The condition of a header: a brace after it opens the body."""
        self.nobrace += 1
        self.expr()
        self.nobrace -= 1

    def bracketed_head(self):
        self.take("(")
        self.depth += 1
        hold, self.nobrace = self.nobrace, 0
        if self.lang == "csharp" and self.s[self.p : self.p + 2] == "ii":
            self.p += 2
        self.expr()
        while self.maybe(",") or self.maybe(";"):
            self.expr()
        self.nobrace = hold
        self.depth -= 1
        self.take(")")

    def if_(self):
        self.p += 1
        lang = self.lang
        if lang in ("rust", "go", "swift"):
            if self.peek() == K["let"] or self.peek() == K["var"] or self.peek() == K["case"]:
                self.p += 1
                self.nobrace += 1
                self.expr(2)
                self.maybe("=")
                self.expr(2)
                self.nobrace -= 1
            else:
                self.head()
            while self.maybe(";") or self.maybe(","):
                self.head()
            self.take("{")
            self.body("func")
        else:
            self.bracketed_head()
            self.inner()
        if (self.after_nl() if self.nl else self.peek()) in (K["else"], KW["elsif"]):
            if lang == "go" and self.peek() == "\n":
                return
            if self.nl:
                self.skip_nl()
            if self.maybe(KW["elsif"]):
                self.p -= 1
                return self.if_()
            self.p += 1
            if self.peek() == K["if"]:
                self.if_()
            elif lang in ("rust", "go", "swift"):
                self.take("{")
                self.body("func")
            else:
                self.inner()

    def inner(self):
        """The body of a header: a block or a single statement."""
        if self.nl:
            self.skip_nl()
        if self.maybe("{"):
            self.body("func")
        else:
            self.statement("func")

    def end(self):
        """The end of a simple statement."""
        c = self.peek()
        if c == ";":
            self.p += 1
        elif self.nl and c in ("\n", "}", "", ")"):
            pass
        elif c == "}" and self.lang in ("javascript", "typescript", "rust"):
            pass
        elif c == "⟧":
            pass
        else:
            self.fault("the statement does not end here" if c != BAD else "unexpected character")

    def body(self, kind: str):
        """Statements up to the closing brace."""
        hold, self.depth, brace, self.nobrace = self.depth, 0, self.nobrace, 0
        while True:
            c = self.skip_nl() if self.nl else self.peek()
            if c == "}":
                self.p += 1
                break
            if not c:
                self.depth, self.nobrace = hold, brace
                self.fault("'}' is missing")
            self.guarded(kind)
        self.depth, self.nobrace = hold, brace

    def guarded(self, kind: str):
        """One statement; after an error, panic mode skips to where one may start."""
        start = self.p
        try:
            self.statement(kind)
        except Fault as f:
            self.errors.append((f.at, f.why))
            self.depth = 0
            self.p = max(self.p, start)
            while self.p < self.n and self.s[self.p] not in ";{}\n":
                self.p += 1
            if self.p < self.n and self.s[self.p] != "}" or self.p == start:
                self.p += 1

    def declaration(self, kind: str) -> bool:
        """A definition of the languages that write the type first; False if it is none."""
        lang, start = self.lang, self.p
        mods = 0
        while self.peek() and self.peek() in self.mods:
            self.p += 1
            mods += 1
        c = self.peek()
        if c and c in _kw("class", "interface", "enum", "struct", "union", "namespace", "trait") and (lang not in ("c", "cpp") or re.match(".i?[^;={]*\\{", self.s[self.p : self.p + 60]) or self.s[self.p + 2 : self.p + 3] == ";"):
            self.p += 1
            if lang == "csharp" and c == K["namespace"] or lang == "cpp" and c == K["namespace"]:
                if self.peek() == "i":
                    self.type_()
            elif self.peek() == "i" or lang not in ("c", "cpp"):
                self.name()
            if self.peek() == "<":
                self.generics()
            if lang == "csharp" and self.peek() == "(" :
                self.params()
            while self.peek() and self.peek() in ":,i" + _kw("extends", "implements", "public", "private", "protected", "virtual", "final", "throws"):
                self.p += 1
                if self.peek() == "i":
                    self.type_()
            if self.maybe(";"):
                return True
            self.take("{")
            if c == K["enum"]:
                self.enum_body()
            else:
                self.body("class" if c != K["namespace"] else "top")
            if lang in ("c", "cpp") and c != K["namespace"]:
                while self.peek() == "i" or self.peek() == "," or self.peek() == "*":
                    self.p += 1
                self.take(";")
            return True
        # A type and a name, then a definition, or a list of variables.
        if kind == "class" and c == "i" and self.s[self.p + 1 : self.p + 2] == "(" and lang in ("java", "csharp", "cpp"):
            self.p += 1
        elif kind == "class" and c == "~" and lang in ("cpp", "csharp"):
            self.p += 2
        elif c == "{" and kind == "class" and lang == "java":
            self.p += 1
            self.body("func")
            return True
        else:
            hold = self.p
            try:
                if c == "<" and lang == "java":
                    self.generics()
                self.type_()
                if self.peek() == K["operator"] or (lang == "cpp" and self.peek() == "∷"):
                    self.p += 1
                ok = self.peek() == "i"
                if ok:
                    self.p += 1
                    ok = self.peek() in ("=", ";", "(", ",", "[", "{", ":", "⇒", "<", "∷")
                    if ok and self.peek() == "⇒" and lang != "csharp":
                        ok = False
            except Fault:
                if mods or (hold < self.n and self.s[hold] in _PRIMITIVE):
                    raise
                ok = False
            if not ok:
                if mods or (hold < self.n and self.s[hold] in _PRIMITIVE):
                    self.fault("the declaration has no name")
                self.p = start
                return False
        if self.peek() == "∷":
            while self.maybe("∷"):
                self.maybe("~")
                self.name()
        if self.peek() == "<":
            self.generics()
        if self.peek() == "(" and (kind != "func" or lang in ("c", "cpp", "csharp") and re.match(r"\([^()]*\)\{", self.s[self.p : self.p + 200])):
            if lang in ("c", "cpp") and kind == "func":
                self.fault("a function within a function")
            self.params()
            while self.peek() and self.peek() in "i,." + _kw("const", "noexcept", "override", "final", "throws", "volatile"):
                self.p += 1
            if self.maybe("→"):
                self.type_()
            if self.maybe(":"):
                while self.peek() not in ("{", ";", ""):
                    self.expr(2)
                    if not self.maybe(","):
                        break
            if self.maybe("⇒"):
                self.expr()
                self.take(";")
            elif self.maybe("{"):
                self.body("func")
            elif self.maybe("="):
                self.expr()
                self.take(";")
            else:
                self.take(";", "the function has no body")
            return True
        if self.peek() == "{" and lang == "csharp":
            self.p += 1
            depth = 1
            while depth:
                c = self.peek()
                if not c or c == BAD:
                    self.fault("'}' is missing")
                depth += (c == "{") - (c == "}")
                self.p += 1
            if self.maybe("="):
                self.expr()
                self.take(";")
            return True
        if self.peek() == "⇒" and lang == "csharp":
            self.p += 1
            self.expr()
            self.take(";")
            return True
        if self.peek() == "(":  # variable with constructor arguments
            self.p += 1
            self.items(")")
        while True:
            while self.maybe("["):
                if self.peek() != "]":
                    self.expr()
                self.take("]")
            if self.peek() == "{" and lang == "cpp":
                self.entry()
            if self.maybe(":") and kind == "class":
                self.expr(2)
            if self.maybe("="):
                self.entry()
            if not self.maybe(","):
                break
            self.maybe("*")
            self.name()
        if self.peek() == ":" and kind == "for":
            return True
        if kind == "for" and self.peek() in (K["in"],):
            return True
        self.take(";", "the declaration does not end here")
        return True

    def enum_body(self):
        hold, self.depth = self.depth, 1
        while self.peek() not in ("}", ";", ""):
            while self.maybe("@"):
                pass
            self.name()
            if self.maybe("("):
                self.items(")")
            if self.maybe("="):
                self.expr(2)
            if self.maybe("{"):
                self.items("}", self.field)
            if not self.maybe(","):
                break
        self.depth = hold
        if self.maybe(";"):
            self.body("class")
        else:
            self.take("}")

    def statement(self, kind: str):
        lang = self.lang
        c = self.peek()
        if c == BAD:
            self.fault("unexpected character")
        if c == ";":
            self.p += 1
            return
        if c == "{" and kind not in ("class",):
            if kind == "top" and lang in ("c", "cpp", "java", "csharp", "go", "rust", "kotlin", "scala", "swift"):
                self.fault("a block without header")
            self.p += 1
            return self.body("func")
        if lang in ("java", "csharp", "c", "cpp"):
            return self.stmt_c(kind, c)
        return getattr(self, "stmt_" + {"typescript": "javascript"}.get(lang, lang))(kind, c)

    def control(self, c: str) -> bool:
        """Statements that the languages with bracketed conditions share."""
        lang = self.lang
        if c == K["if"]:
            self.if_()
        elif c in (K["while"], K["switch"]):
            self.p += 1
            self.bracketed_head()
            if c == K["switch"]:
                self.take("{")
                self.body("match")
            else:
                self.inner()
        elif c == K["do"]:
            self.p += 1
            self.inner()
            if self.nl:
                self.skip_nl()
            self.take(K["while"])
            self.bracketed_head()
            self.end()
        elif c == K["for"] or c == K["foreach"]:
            self.p += 1
            self.maybe(K["await"]) if lang in ("javascript", "typescript") else None
            self.take("(")
            self.depth += 1
            self.for_head()
            self.depth -= 1
            self.take(")")
            self.inner()
        elif c in (K["return"], K["throw"]):
            self.p += 1
            if self.peek() not in (";", "\n", "}", "") or (c == K["throw"]):
                self.expr()
                while lang in ("javascript", "typescript") and self.maybe(","):
                    self.expr()
            self.end()
        elif c in (K["break"], K["continue"], K["goto"]):
            self.p += 1
            if self.peek() in ("i", "0"):
                self.p += 1
            self.end()
        elif c == K["try"]:
            self.p += 1
            if self.peek() == "(":
                self.p += 1
                self.items(")")
            self.take("{")
            self.body("func")
            seen = False
            while (self.after_nl() if self.nl else self.peek()) in (K["catch"], K["finally"]) and (self.after_nl() if self.nl else self.peek()):
                if self.nl:
                    self.skip_nl()
                self.p += 1
                seen = True
                if self.maybe("("):
                    self.depth += 1
                    while self.peek() not in (")", "", BAD):
                        self.p += 1
                    self.depth -= 1
                    self.take(")")
                self.take("{")
                self.body("func")
            if not seen:
                self.fault("'try' has no handler")
        elif c in (K["case"], K["default"]) and c:
            self.p += 1
            if c == K["case"]:
                self.expr(4)
            if not (self.maybe(":") or self.maybe("→") or self.maybe(";")):
                self.fault("':' is missing")
        else:
            return False
        return True

    def for_head(self):
        lang = self.lang
        if lang in ("c", "cpp", "java", "csharp"):
            if lang == "csharp" and self.s[self.p : self.p + 2] == "ii":
                self.p += 2
            elif not self.maybe(";"):
                if not self.declaration("for"):
                    self.expr()
                    while self.maybe(","):
                        self.expr()
                    self.take(";")
            if self.maybe(":") or self.maybe(K["in"]):
                self.expr()
                return
        elif lang == "php":
            if self.peek() != ";":
                self.expr(2)
                while self.maybe(","):
                    self.expr()
                if self.maybe("="):
                    self.expr(2)
                if self.maybe(K["as"]):
                    self.expr()
                    return
            self.take(";")
        else:
            if self.peek() and self.peek() in _kw("let", "const", "var"):
                self.p += 1
                self.primary()
                if self.maybe(K["of"]) or self.maybe(K["in"]):
                    self.expr()
                    return
                if self.maybe(":"):
                    self.type_()
                while self.maybe("="):
                    self.expr(2)
                    if self.maybe(","):
                        self.name()
            elif self.peek() != ";":
                self.expr()
                while self.maybe(","):
                    self.expr()
                if self.maybe(K["of"]):
                    self.expr()
                    return
                if self.peek() == ")":
                    return
            self.take(";")
        if self.peek() != ";":
            self.expr()
        self.take(";")
        if self.peek() != ")":
            self.expr()
            while self.maybe(","):
                self.expr()

    def stmt_c(self, kind: str, c: str):
        lang = self.lang
        if kind == "class" and c and c in _kw("public", "private", "protected") and self.s[self.p + 1 : self.p + 2] == ":":
            self.p += 2
            return
        if kind == "func" or kind == "match":
            if self.control(c):
                return
            if c == "i" and self.s[self.p + 1 : self.p + 2] == ":":
                self.p += 2
                return
            if kind == "match" and c == "i" and lang == "csharp" and "⇒" in self.s[self.p : self.p + 20]:
                self.expr()
                self.maybe(",")
                return
        if c and c in _kw("import", "package", "using", "template", "typedef", "namespace", "extern") and c:
            if c == K["package"] or c == K["import"]:
                if kind != "top":
                    self.fault("unexpected import")
                self.p += 1
                self.maybe(K["static"])
                self.type_()
                self.take(";")
                return
            if c == K["using"]:
                if lang == "csharp" and self.s[self.p + 1 : self.p + 2] == "(":
                    self.p += 2
                    self.depth += 1
                    self.for_decl()
                    self.depth -= 1
                    self.take(")")
                    return self.inner()
                self.p += 1
                self.maybe(K["namespace"])
                self.maybe(K["static"])
                self.type_()
                if self.maybe("="):
                    self.type_()
                self.take(";")
                return
            if c == K["template"]:
                self.p += 1
                self.generics()
                return self.statement(kind)
            if c == K["typedef"]:
                self.p += 1
                if self.peek() in (K["struct"], K["union"], K["enum"]):
                    self.p += 1
                    if self.peek() == "i":
                        self.p += 1
                    if self.maybe("{"):
                        self.body("class") if self.s[self.p - 2] != K["enum"] else self.enum_body()
                    else:
                        self.p -= 1
                        self.type_()
                else:
                    self.type_()
                self.maybe("*")
                self.name()
                self.take(";")
                return
            if c == K["extern"] and self.s[self.p + 1 : self.p + 2] == '"':
                self.p += 2
                self.take("{")
                return self.body("top")
        if lang == "csharp" and c == "[" and kind != "func":
            self.p += 1
            self.items("]")
            return self.statement(kind)
        if self.declaration(kind):
            return
        if kind == "class" or (kind == "top"):
            self.fault("a declaration is missing")
        self.expr()
        while self.maybe(","):
            self.expr()
        self.take(";", "the statement does not end here")

    def for_decl(self):
        self.type_()
        self.name()
        self.take("=")
        self.expr()

    def stmt_php(self, kind: str, c: str):
        if c == "⟧":
            self.p += 1
            return
        if c == "⟦":
            self.p += 1
            return
        if kind != "class" and self.control(c):
            return
        start = self.p
        while self.peek() and self.peek() in self.mods:
            self.p += 1
        m = self.p > start
        c = self.peek()
        if c and c in _kw("namespace", "use"):
            self.p += 1
            self.maybe(K["function"])
            self.take("n")
            while self.maybe(","):
                self.take("n")
            if self.maybe(K["as"]):
                self.name()
            self.take(";")
        elif c and c in _kw("class", "interface", "trait", "enum"):
            self.p += 1
            self.take("n", "the class has no name")
            while self.peek() and self.peek() in ",:" + _kw("extends", "implements"):
                self.p += 1
                self.take("n")
            self.take("{")
            self.body("class")
        elif c == K["function"] and (m or self.s[self.p + 1 : self.p + 2] in ("n", "&")):
            self.p += 1
            self.maybe("&")
            self.take("n", "the function has no name")
            self.params()
            if self.maybe(":"):
                self.maybe("?")
                self.type_()
            if not self.maybe(";"):
                self.take("{")
                self.body("func")
        elif c == K["const"]:
            self.p += 1
            self.take("n")
            self.take("=")
            self.expr(2)
            self.take(";")
        elif m or kind == "class":
            if self.peek() == "n" or self.peek() == "?":
                self.maybe("?")
                self.type_()
            self.take("i", "a member is missing")
            if self.maybe("="):
                self.expr(2)
            self.take(";")
        elif c and c in _kw("echo", "print", "global"):
            self.p += 1
            self.expr()
            while self.maybe(","):
                self.expr()
            self.end()
        elif kind == "match" and c not in ("i", "n"):
            self.expr()
            self.maybe(",")
            self.maybe(";")
        else:
            self.expr()
            if kind == "match" and self.maybe(","):
                return
            self.end()

    def stmt_javascript(self, kind: str, c: str):
        ts = self.lang == "typescript"
        if kind == "class":
            while self.peek() and self.peek() in self.mods + "@" and self.s[self.p + 1 : self.p + 2] not in ("(", "=", ":", ";"):
                self.p += 1
            self.maybe("*")
            if self.maybe("["):
                self.expr()
                if ts and self.maybe(":"):
                    self.type_()
                self.take("]")
            elif self.peek() == "i" and self.s[self.p + 1 : self.p + 2] in ("i", "["):
                self.p += 2
            elif self.peek() == "{" and self.s[self.p - 1] == K["static"]:
                self.p += 1
                return self.body("func")
            elif self.peek() and (self.peek() in "i\"0" or "Ā" <= self.peek() < "Ѐ"):
                self.p += 1
            elif self.peek() == "(" and ts:
                pass
            else:
                self.fault("a member is missing")
            if ts:
                self.maybe("?")
                self.maybe("!")
            if self.peek() == "<" and ts:
                self.generics()
            if self.peek() == "(":
                self.params()
                if ts and self.maybe(":"):
                    self.type_()
                if self.maybe("{"):
                    self.body("func")
                elif ts:
                    self.end()
                else:
                    self.fault("the method has no body")
                return
            if ts and self.maybe(":"):
                self.type_()
            if self.maybe("="):
                self.expr(2)
            if ts and self.maybe(","):
                return
            return self.end()
        if c == "@" and ts:
            self.p += 1
            if self.maybe("("):
                self.items(")")
            return
        if c == K["export"]:
            self.p += 1
            c = self.peek()
            if self.maybe(K["default"]):
                c = self.peek()
                if c not in (K["function"], K["class"], K["async"]):
                    self.expr()
                    return self.end()
            elif c == "*":
                self.p += 1
                if self.peek() == K["as"] or self.peek() == "i":
                    self.p += 2
                self.take(K["from"])
                self.take('"')
                return self.end()
            elif c == "{":
                self.p += 1
                self.items("}", self.spec)
                if self.maybe(K["from"]):
                    self.take('"')
                return self.end()
            elif not (c and c in _kw("function", "class", "const", "let", "var", "async", "interface", "enum", "type", "abstract", "namespace")):
                self.fault("nothing to export")
        if c == K["import"] and self.s[self.p + 1 : self.p + 2] not in ("(", "."):
            self.p += 1
            if not self.maybe('"'):
                if ts:
                    self.maybe(K["type"])
                while True:
                    if self.maybe("{"):
                        self.items("}", self.spec)
                    elif self.maybe("*"):
                        self.p += 1
                        self.name()
                    else:
                        self.name()
                    if not self.maybe(","):
                        break
                if ts and self.maybe("="):
                    self.expr()
                    return self.end()
                self.take(K["from"], "'from' is missing")
                self.take('"')
            return self.end()
        if self.control(c):
            return
        if ts and c and c in _kw("interface", "enum", "type", "abstract", "namespace") and self.s[self.p + 1 : self.p + 2] in ("i", K["class"]):
            self.p += 1
            if c == K["abstract"]:
                c = K["class"]
                self.take(c)
            self.name()
            if self.peek() == "<":
                self.generics()
            if c == K["type"]:
                self.take("=")
                self.type_()
                return self.end()
            while self.peek() and self.peek() in "," + _kw("extends", "implements"):
                self.p += 1
                self.type_()
            self.take("{")
            return self.enum_body() if c == K["enum"] else self.body("func" if c == K["namespace"] else "class")
        if c and c in (K["function"], K["async"]) and self.s[self.p + 1 : self.p + 2] not in ("(", "."):
            if c == K["async"]:
                self.p += 1
                if self.peek() != K["function"]:
                    self.expr()
                    return self.end()
            self.p += 1
            self.maybe("*")
            if self.peek() == "i":
                self.p += 1
            elif self.peek() != "(":
                self.fault("the function has no name")
            if ts and self.peek() == "<":
                self.generics()
            self.params()
            if ts and self.maybe(":"):
                self.type_()
            self.take("{", "the function has no body")
            return self.body("func")
        if c == K["class"]:
            self.p += 1
            if self.peek() == "i":
                self.p += 1
            if ts and self.peek() == "<":
                self.generics()
            while self.peek() and self.peek() in "," + _kw("extends", "implements"):
                self.p += 1
                self.nobrace += 1
                self.type_() if ts else self.expr(10)
                self.nobrace -= 1
            self.take("{")
            return self.body("class")
        if c and c in _kw("const", "let", "var"):
            self.p += 1
            if ts and self.peek() == K["enum"]:
                return self.stmt_javascript(kind, K["enum"])
            while True:
                if self.nl:
                    self.skip_nl()
                if self.peek() in ("[", "{"):
                    self.primary()
                else:
                    self.name()
                if ts and self.maybe("!"):
                    pass
                if ts and self.maybe(":"):
                    self.type_()
                if self.maybe("="):
                    self.skip_nl()
                    self.expr(2)
                elif c == K["const"] and not ts:
                    self.fault("a constant without value")
                if not self.maybe(","):
                    break
            return self.end()
        if c == "i" and self.s[self.p + 1 : self.p + 2] == ":":
            self.p += 2
            return
        self.expr()
        while self.maybe(","):
            self.skip_nl()
            self.expr()
        self.end()

    def spec(self):
        self.maybe(K["type"])
        if self.peek() and (self.peek() == "i" or self.peek() == '"' or self.peek() >= "Ā"):
            self.p += 1
        else:
            self.fault("a name is missing")
        if self.peek() and self.peek() in (K["as"], "i"):
            if self.peek() == "i":
                self.p += 1
            else:
                self.p += 1
            if self.peek() in ("i", K["default"]):
                self.p += 1

    def stmt_rust(self, kind: str, c: str):
        start = self.p
        while self.peek() and self.peek() in self.mods:
            c = self.peek()
            self.p += 1
            if c == K["pub"] and self.peek() == "(":
                self.p += 1
                self.items(")")
            if c == K["extern"] and self.peek() == '"':
                self.p += 1
            if c in (K["const"], K["static"]) and self.peek() in ("i", K["mut"]):
                self.maybe(K["mut"])
                self.name()
                self.take(":")
                self.type_()
                if self.maybe("="):
                    self.expr()
                return self.take(";")
        m = self.p > start
        c = self.peek()
        if c == K["fn"]:
            self.p += 1
            self.name()
            if self.peek() == "<":
                self.generics()
            self.params()
            if self.maybe("→"):
                self.type_()
            self.where()
            if kind == "class" and self.maybe(";"):
                return
            self.take("{", "the function has no body")
            return self.body("func")
        if c in (K["struct"], K["enum"], K["trait"], K["impl"], K["mod"]) and c:
            self.p += 1
            if c == K["impl"] and self.peek() == "<":
                self.generics()
            self.type_()
            if c == K["impl"] and self.maybe(K["for"]):
                self.type_()
            if self.maybe(":"):
                self.type_()
            self.where()
            if self.maybe(";"):
                return
            if c == K["struct"] and self.peek() == "(":
                self.p += 1
                while self.peek() != ")":
                    self.maybe(K["pub"])
                    self.type_()
                    if not self.maybe(","):
                        break
                self.take(")")
                return self.take(";")
            self.take("{")
            if c == K["mod"]:
                return self.body("top")
            if c in (K["struct"], K["enum"]):
                while self.peek() != "}":
                    self.maybe(K["pub"])
                    self.name()
                    if c == K["struct"]:
                        self.take(":")
                        self.type_()
                    elif self.maybe("("):
                        self.type_()
                        while self.maybe(","):
                            self.type_()
                        self.take(")")
                    elif self.maybe("{"):
                        self.items("}", self.typed)
                    elif self.maybe("="):
                        self.expr()
                    if not self.maybe(","):
                        break
                return self.take("}")
            return self.body("class")
        if c == K["use"]:
            self.p += 1
            self.maybe("∷")
            self.use_tree()
            return self.take(";")
        if c == K["type"]:
            self.p += 1
            self.type_()
            if self.maybe("="):
                self.type_()
            return self.take(";")
        if c == "m":
            self.primary()
            if self.peek() == ";":
                self.p += 1
            elif self.peek() not in ("}", "") and self.s[self.p - 1] != "}":
                self.postfix()
                self.expr_tail()
            return
        if m and c == "{":
            self.p += 1
            return self.body("func")
        if m or kind in ("class", "top"):
            self.fault("a definition is missing")
        if kind == "match":
            self.expr(3)
            if self.maybe(K["if"]):
                self.expr(3)
            self.take("⇒")
            if self.maybe("{"):
                self.body("func")
                self.maybe(",")
            else:
                self.expr(2)
                if not self.maybe(",") and self.peek() != "}":
                    self.fault("',' is missing")
            return
        if c == K["let"]:
            self.p += 1
            self.maybe(K["mut"])
            self.primary()
            if self.peek() == "(":
                self.postfix()
            if self.maybe(":"):
                self.type_()
            if self.maybe("="):
                self.expr(2)
            if self.maybe(K["else"]):
                self.take("{")
                self.body("func")
            return self.take(";", "the statement does not end here")
        if c == "'":
            self.p += 1
            self.take(":")
            c = self.peek()
        if c == K["if"]:
            self.if_()
            if self.peek() == ".":
                self.postfix()
                self.end()
            return
        if c in (K["for"], K["while"], K["loop"]) and c:
            self.p += 1
            if c == K["for"]:
                self.primary()
                self.take(K["in"])
                self.head()
            elif c == K["while"]:
                if self.maybe(K["let"]):
                    self.nobrace += 1
                    self.expr(2)
                    self.take("=")
                    self.expr(2)
                    self.nobrace -= 1
                else:
                    self.head()
            self.take("{")
            return self.body("func")
        if c == K["match"]:
            self.primary()
            return
        if c and c in _kw("return", "break", "continue"):
            self.p += 1
            if self.peek() not in (";", "}"):
                self.expr()
            return self.end()
        self.expr()
        self.end()

    def expr_tail(self):
        while self.peek() in POWER:
            self.p += 1
            self.expr()
        self.end()

    def typed(self):
        self.maybe(K["pub"])
        self.name()
        self.take(":")
        self.type_()

    def where(self):
        if self.maybe(K["where"]):
            while self.peek() not in ("{", ";", ""):
                self.type_()
                self.take(":")
                self.type_()
                if not self.maybe(","):
                    break

    def use_tree(self):
        while True:
            if self.maybe("{"):
                while self.peek() != "}":
                    self.use_tree()
                    if not self.maybe(","):
                        break
                return self.take("}")
            if self.maybe("*"):
                return
            if self.peek() and self.peek() in "i" + _kw("self", "crate", "super"):
                self.p += 1
            else:
                self.fault("a path is missing")
            if self.maybe(K["as"]):
                return self.name()
            if not self.maybe("∷"):
                return

    def stmt_go(self, kind: str, c: str):
        if c == K["package"] and kind == "top":
            self.p += 1
            self.name()
            return self.end()
        if c == K["import"] and kind == "top":
            self.p += 1
            if self.maybe("("):
                while self.skip_nl() != ")":
                    if self.peek() in ("i", "."):
                        self.p += 1
                    self.take('"')
                    self.end()
                self.p += 1
            else:
                if self.peek() in ("i", "."):
                    self.p += 1
                self.take('"', "the import has no path")
            return self.end()
        if c == K["func"] and kind == "top":
            self.p += 1
            if self.peek() == "(":
                self.params()
            self.name()
            if self.peek() == "[":
                self.type_params()
            self.params()
            if self.peek() not in ("{", "\n", ""):
                self.params() if self.peek() == "(" else self.type_()
            if self.maybe("{"):
                self.body("func")
            return self.end()
        if c in (K["type"], K["var"], K["const"]) and c:
            self.p += 1
            if self.maybe("("):
                while self.skip_nl() != ")":
                    self.go_spec(c)
                    self.end()
                self.p += 1
            else:
                self.go_spec(c)
            return self.end()
        if kind == "top":
            self.fault("a declaration is missing")
        if kind == "class":
            if self.peek() == "*":
                self.type_()
                return self.end()
            self.name()
            while self.maybe(","):
                self.name()
            if self.peek() == "(":
                self.params()
                if self.peek() not in ("\n", "}"):
                    self.type_()
            elif self.peek() not in ("\n", "}", ".", '"'):
                self.type_()
            elif self.maybe("."):
                self.name()
            self.maybe('"')
            return self.end()
        if c == K["if"]:
            self.if_()
            return self.end()
        if c == K["for"]:
            self.p += 1
            if self.peek() != "{":
                self.nobrace += 1
                if self.peek() == K["range"]:
                    self.p += 1
                    self.expr()
                else:
                    if self.peek() != ";":
                        self.go_simple()
                    if self.maybe(";"):
                        if self.peek() != ";":
                            self.expr()
                        self.take(";")
                        if self.peek() != "{":
                            self.go_simple()
                self.nobrace -= 1
            self.take("{")
            self.body("func")
            return self.end()
        if c in (K["switch"], K["select"]) and c:
            self.p += 1
            self.nobrace += 1
            while self.peek() != "{":
                self.go_simple()
                if not self.maybe(";"):
                    break
            self.nobrace -= 1
            self.take("{")
            self.body("func")
            return self.end()
        if c in (K["case"], K["default"]) and c:
            self.p += 1
            if c == K["case"]:
                self.go_simple()
            return self.take(":")
        if c in (K["go"], K["defer"]) and c:
            self.p += 1
            self.expr()
            return self.end()
        if c and c in _kw("return", "break", "continue", "fallthrough", "goto"):
            self.p += 1
            if self.peek() not in ("\n", "}", ";", ""):
                self.expr()
                while self.maybe(","):
                    self.skip_nl()
                    self.expr()
            return self.end()
        self.go_simple()
        if self.maybe(":"):
            return
        self.end()

    def go_simple(self):
        self.expr(2)
        while self.maybe(","):
            self.expr(2)
        if self.peek() in ("=", "≔"):
            self.p += 1
            if self.maybe(K["range"]):
                self.expr()
                return
            self.expr(2)
            while self.maybe(","):
                self.expr(2)
        elif self.maybe("←"):
            self.expr()

    def type_params(self):
        self.take("[")
        self.depth += 1
        while self.peek() != "]":
            self.name()
            if self.peek() not in (",", "]"):
                self.type_()
            if not self.maybe(","):
                break
        self.depth -= 1
        self.take("]")

    def go_spec(self, c: str):
        self.name()
        while self.maybe(","):
            self.name()
        if c == K["type"]:
            if self.peek() == "[" and self.s[self.p + 1 : self.p + 3] in ("ii",):
                self.type_params()
            self.maybe("=")
            return self.type_()
        if self.peek() not in ("=", "\n", ")", ""):
            self.type_()
        if self.maybe("="):
            self.skip_nl()
            self.expr()
            while self.maybe(","):
                self.expr()

    def stmt_kotlin(self, kind: str, c: str):
        if c == K["package"] or c == K["import"]:
            if kind != "top":
                self.fault("unexpected import")
            self.p += 1
            self.type_()
            if self.maybe(K["as"]):
                self.name()
            return self.end()
        while self.peek() and self.peek() in self.mods:
            self.p += 1
            if self.peek() == "\n":
                self.skip_nl()
        c = self.peek()
        if c in (K["class"], K["interface"], K["object"]) and c and not (c == K["object"] and kind == "func"):
            self.p += 1
            if self.peek() == "i":
                self.name()
            elif c != K["object"]:
                self.fault("the class has no name")
            if self.peek() == "<":
                self.generics()
            if self.peek() == "(":
                self.params()
            if self.maybe(":"):
                while True:
                    self.type_()
                    if self.maybe("("):
                        self.items(")")
                    if not self.maybe(","):
                        break
            if self.maybe("{"):
                self.body("class")
            return self.end()
        if c == K["fun"]:
            self.p += 1
            if self.peek() == "<":
                self.generics()
            self.name()
            while self.maybe("."):
                self.name()
            self.params()
            if self.maybe(":"):
                self.type_()
            if self.maybe("="):
                self.skip_nl()
                self.expr()
            elif self.maybe("{"):
                self.body("func")
            return self.end()
        if c in (K["val"], K["var"]) and c:
            self.p += 1
            if self.maybe("("):
                self.items(")")
            else:
                self.name()
            if self.maybe(":"):
                self.type_()
            if self.maybe("=") or self.maybe("i"):
                self.skip_nl()
                self.expr(2)
            return self.end()
        if c == "i" and kind == "class" and self.s[self.p + 1 : self.p + 2] == "{":
            self.p += 2
            return self.body("func")
        if kind == "class":
            self.fault("a member is missing")
        return self.common(kind, c)

    def common(self, kind: str, c: str):
        """Statements of the languages with line ends and bracketed conditions."""
        if c == K["for"]:
            self.p += 1
            self.take("(")
            self.depth += 1
            self.expr(12)
            if self.lang == "scala":
                while self.maybe("←") or self.maybe("=") or self.maybe(";") or self.maybe(K["if"]):
                    self.expr(2)
            else:
                if self.maybe(":"):
                    self.type_()
                self.take(K["in"])
                self.expr()
            self.depth -= 1
            self.take(")")
            self.maybe(K["yield"]) if self.lang == "scala" else None
            return self.inner()
        if kind == "match" and c != K["case"] or kind == "match" and self.lang == "kotlin":
            if self.maybe(K["else"]):
                pass
            else:
                if self.peek() and self.peek() in _kw("in", "is"):
                    self.p += 1
                self.expr()
                while self.maybe(","):
                    self.expr()
            if self.maybe("→"):
                return self.inner()
            return self.end()
        if self.control(c):
            return
        self.expr()
        self.end()

    def stmt_scala(self, kind: str, c: str):
        if c == K["package"] or c == K["import"]:
            self.p += 1
            self.scala_path()
            while self.maybe(","):
                self.scala_path()
            if c == K["package"] and self.maybe("{"):
                return self.body("top")
            return self.end()
        while self.peek() and self.peek() in self.mods:
            self.p += 1
            if self.peek() == "[":
                self.p += 1
                self.items("]")
            if self.peek() == "\n":
                self.skip_nl()
        c = self.peek()
        if c == K["case"] and self.s[self.p + 1 : self.p + 2] in (K["class"], K["object"]):
            self.p += 1
            c = self.peek()
        if c in (K["class"], K["trait"], K["object"]) and c:
            self.p += 1
            self.name()
            if self.peek() == "[":
                self.p += 1
                self.items("]")
            if self.peek() == "(":
                self.params()
            while self.peek() and self.peek() in _kw("extends", "with"):
                self.p += 1
                self.type_()
                if self.maybe("("):
                    self.items(")")
            if self.maybe("{"):
                self.body("class")
            return self.end()
        if c == K["def"]:
            self.p += 1
            self.name()
            if self.peek() == "[":
                self.p += 1
                self.items("]")
            if self.peek() == "(":
                self.params()
            if self.maybe(":"):
                self.type_()
            if self.maybe("="):
                self.skip_nl()
                self.expr()
            elif self.maybe("{"):
                self.body("func")
            return self.end()
        if c in (K["val"], K["var"], K["type"]) and c:
            self.p += 1
            self.primary()
            if self.maybe(":"):
                self.type_()
            if self.maybe("="):
                self.skip_nl()
                self.expr(2) if c != K["type"] else self.type_()
            return self.end()
        if c == K["case"]:
            self.p += 1
            self.expr(3)
            if self.maybe(":"):
                self.type_()
            if self.maybe(K["if"]):
                self.expr(3)
            return self.take("⇒")
        if kind == "top":
            self.fault("a definition is missing")
        return self.common(kind, c)

    def scala_path(self):
        self.name()
        while self.maybe("."):
            if self.maybe("{"):
                self.items("}")
                return
            if self.peek() == "i" or self.peek() == "_":
                self.p += 1
            elif self.peek() == "*":
                self.p += 1
                return
            else:
                self.fault("a name is missing")

    def stmt_swift(self, kind: str, c: str):
        if c == K["import"]:
            self.p += 1
            self.type_()
            return self.end()
        while self.peek() and self.peek() in self.mods:
            self.p += 1
            if self.peek() == "\n":
                self.skip_nl()
        c = self.peek()
        if c in (K["class"], K["struct"], K["enum"], K["protocol"], K["extension"]) and c:
            self.p += 1
            if c == K["class"] and self.peek() in (K["func"], K["var"], K["let"]):
                return self.stmt_swift(kind, self.peek())
            self.type_()
            if self.maybe(":"):
                self.type_()
                while self.maybe(","):
                    self.type_()
            self.take("{")
            self.body("class")
            return self.end()
        if c in (K["func"], K["init"]) and c:
            self.p += 1
            if c == K["func"]:
                self.name()
            else:
                self.maybe("?")
            if self.peek() == "<":
                self.generics()
            self.params()
            if self.peek() == K["throws"]:
                self.p += 1
            if self.maybe("→"):
                self.type_()
            if self.maybe("{"):
                self.body("func")
            elif kind != "class":
                self.fault("the function has no body")
            return self.end()
        if c in (K["let"], K["var"]) and c:
            self.p += 1
            self.primary()
            if self.maybe(":"):
                self.type_()
            if self.maybe("="):
                self.skip_nl()
                self.expr(2)
            if self.maybe("{"):
                self.body("func")
            return self.end()
        if c == K["case"]:
            self.p += 1
            self.maybe(".")
            self.expr(2)
            while self.maybe(","):
                self.maybe(".")
                self.expr(2)
            if self.maybe("="):
                self.expr()
            if self.maybe(":"):
                return
            return self.end()
        if c == K["default"]:
            self.p += 1
            return self.take(":")
        if kind == "class":
            self.fault("a member is missing")
        if c == K["if"]:
            self.if_()
            return self.end()
        if c == K["for"]:
            self.p += 1
            self.primary()
            self.take(K["in"])
            self.head()
            if self.maybe(K["where"]):
                self.head()
            self.take("{")
            self.body("func")
            return self.end()
        if c in (K["while"], K["switch"]) and c:
            self.p += 1
            self.head()
            self.take("{")
            self.body("func")
            return self.end()
        if c == K["guard"]:
            self.p += 1
            self.maybe(K["let"])
            self.nobrace += 1
            self.expr()
            self.nobrace -= 1
            self.take(K["else"])
            self.take("{")
            self.body("func")
            return self.end()
        if c in (K["do"], K["defer"]) and c:
            self.p += 1
            self.take("{")
            self.body("func")
            while self.after_nl() == K["catch"]:
                self.skip_nl()
                self.p += 1
                if self.peek() != "{":
                    self.head()
                self.take("{")
                self.body("func")
            return self.end()
        if c and c in _kw("return", "throw", "break", "continue"):
            self.p += 1
            if self.peek() not in ("\n", "}", ";", ""):
                self.expr()
            return self.end()
        self.expr()
        self.end()

    # ---- whole texts
    def file(self) -> list[tuple[int, str]]:
        if self.lang == "php":
            if self.s[:1] != "⟦":
                return [(0, "the opening tag is missing")]
        while True:
            c = self.skip_nl() if self.nl else self.peek()
            if not c:
                return self.errors
            if c == "}":
                self.errors.append((self.p, "unexpected '}'"))
                self.p += 1
                continue
            self.guarded("top")


_WORDOPS = {
    "javascript": _kw("in", "instanceof", "of"), "typescript": _kw("in", "instanceof", "as"), "java": _kw("instanceof"), "csharp": _kw("is", "as"),
    "kotlin": _kw("in", "is", "as"), "swift": _kw("is", "as"), "rust": _kw("as"), "php": _kw("and", "or", "instanceof"), "scala": "", "go": "",
}
_UNARY = {
    "javascript": _kw("typeof", "delete", "void", "await", "yield", "async"), "typescript": _kw("typeof", "delete", "void", "await", "yield", "async"),
    "csharp": _kw("await", "ref", "out"), "rust": _kw("mut", "ref", "move", "unsafe"), "swift": _kw("try", "await"), "cpp": _kw("delete"), "go": "←",
    "kotlin": "", "php": "",
}
_PRIM_WORDS = {
    "rust": _kw("self", "super", "crate", "loop", "async"), "javascript": _kw("import", "void"), "typescript": _kw("import", "void"), "kotlin": _kw("object", "try"),
    "swift": _kw("init"), "go": _kw("map", "struct"), "php": _kw("static"), "scala": _kw("try"),
}

_UNIT = re.compile(r"[;{}]")
_UNIT_NL = re.compile(r"[;{}\n]")
_MEMO: dict[tuple[str, str], dict[str, str]] = {}
_EXTEND, _WHOLE, _SIMPLE = "x", "w", "s"


def _judge(lang: str, kind: str, unit: str) -> str:
    """What a unit is on its own: a simple statement, a header (the kind of its body),
    an unfinished piece, or something that only the whole text can tell."""
    if unit.count("(") != unit.count(")") or unit.count("[") != unit.count("]"):
        return _EXTEND
    if unit[-1] != "{":
        p = Parser(lang, unit)
        try:
            p.statement(kind)
            if p.nl:
                p.skip_nl()
        except Fault:
            return _WHOLE
        return _SIMPLE if p.p == p.n and not p.errors else _WHOLE
    seen: list[str] = []

    class Probe(Parser):
        def body(self, k: str):
            if self.p == len(unit):
                seen.append(k)
            super().body(k)

    p = Probe(lang, unit + "}" + (";" if lang in ("c", "cpp") and unit[0] in _kw("class", "struct") else ""))
    try:
        p.statement(kind)
    except Fault:
        return _WHOLE
    if p.p != p.n or p.errors or len(seen) != 1:
        return _WHOLE
    if unit[0] in _kw("do", "try", "switch", "match", "when") or seen[0] == "match":
        return _WHOLE
    return ("I" if unit[0] == K["if"] or unit[0] == K["else"] else "C" if lang in ("c", "cpp") and unit[0] in _kw("class", "struct") else "B") + seen[0]


def _units_hold(lang: str, s: str) -> bool:
    """True if every statement of the shape stands on its own; False decides nothing."""
    nl = lang in _NL
    find = (_UNIT_NL if nl else _UNIT).search
    kinds = ["top"]
    tags = ["B"]
    p, n, last = 0, len(s), ""
    if lang == "php":
        if s[:1] != "⟦":
            return False
        p = 1
    while p < n:
        c = s[p]
        if c == "\n":
            p += 1
            continue
        if c == "}":
            if len(kinds) == 1:
                return False
            kinds.pop()
            last = tags.pop()
            p += 1
            if last == "C":
                if s[p : p + 1] != ";":
                    return False
                p += 1
            elif nl and s[p : p + 1] not in ("\n", "}", "", K["else"]):
                return False
            continue
        kind = kinds[-1]
        memo = _MEMO.setdefault((lang, kind), {})
        if c == K["else"]:
            if last != "I":
                return False
            if s[p + 1 : p + 2] == "{":
                kinds.append("func")
                tags.append("B")
                p += 2
                continue
            if s[p + 1 : p + 2] != K["if"]:
                return False
            p += 1
        q = p
        while True:
            m = find(s, q)
            if m is None:
                return False
            q = m.end()
            if s[q - 1] == "}":
                return False
            unit = s[p:q]
            r = memo.get(unit)
            if r is None:
                if len(memo) > 200_000:
                    memo.clear()
                r = memo[unit] = _judge(lang, kind, unit)
            if r != _EXTEND:
                break
            if q - p > 2_000:
                return False
        if r == _WHOLE:
            return False
        p = q
        last = ""
        if r != _SIMPLE:
            kinds.append(r[1:])
            tags.append(r[0])
    return len(kinds) == 1


# ---- languages by lines


class Lines(Parser):
    """Statements of Python and Ruby: one logical line each."""

    def __init__(self, lang: str, s: str):
        super().__init__(lang, s)
        self.nl = False

    def expr(self, least: int = 1):
        py = self.lang == "python"
        self.unary()
        while True:
            c = self.peek()
            if not c:
                return
            if c == K["if"] and py:
                if least > 2:
                    return
                hold = self.p
                self.p += 1
                self.expr(3)
                if self.peek() != K["else"]:
                    self.p = hold
                    return
                self.p += 1
                self.expr(2)
                continue
            w = {K["or"]: 4, K["and"]: 5, K["in"]: 9, K["is"]: 9, K["not"]: 9}.get(c)
            if w is not None and (py or c in _kw("or", "and")):
                if w < least:
                    return
                self.p += 1
                if c == K["not"]:
                    self.take(K["in"])
                if c == K["is"]:
                    self.maybe(K["not"])
                self.expr(w + 1)
                continue
            power = POWER.get(c)
            if power is None or power < least or (py and c in "=?≔⇒" and not (c == "≔" and self.depth)):
                return
            self.p += 1
            if c == ">" and self.peek() == ">":
                self.p += 1
            if c == "?":
                self.expr(2)
                self.take(":")
                self.expr(2)
            elif c == "…" and self.peek() in ("]", ")", ""):
                continue
            else:
                self.expr(power if c in RIGHT else power + 1)

    def unary(self):
        c = self.peek()
        while c and c in "-+~!*⋆&@" + _kw("not", "await"):
            self.p += 1
            c = self.peek()
        self.primary()
        self.postfix()

    def comp(self):
        """The clauses of a comprehension."""
        while self.peek() in (K["for"], K["async"]) and self.peek():
            self.maybe(K["async"])
            self.take(K["for"])
            self.expr(10)
            while self.maybe(","):
                self.expr(10)
            self.take(K["in"])
            self.expr(3)
            while self.maybe(K["if"]):
                self.expr(3)

    def primary(self):
        c, py = self.peek(), self.lang == "python"
        if c in ("i", "0", "…", K["self"]) and c:
            self.p += 1
        elif c == '"':
            while self.maybe('"'):
                pass
        elif c == "(" or c == "[" or c == "{":
            close = {"(": ")", "[": "]", "{": "}"}[c]
            self.p += 1
            self.depth += 1
            while self.peek() != close:
                self.arg()
                if c == "{" and (self.maybe(":") or self.maybe("⇒")):
                    self.expr(2)
                elif c == "{" and not py and self.s[self.p - 1] == ":":
                    self.expr(2)
                if py:
                    self.comp()
                if not self.maybe(","):
                    break
            self.depth -= 1
            self.take(close, f"'{close}' is missing")
        elif c == K["lambda"] and py:
            self.p += 1
            while self.peek() != ":":
                self.maybe("*") or self.maybe("⋆")
                self.take("i")
                if self.maybe("="):
                    self.expr(2)
                if not self.maybe(","):
                    break
            self.take(":")
            self.expr(2)
        elif c == K["yield"]:
            self.p += 1
            self.maybe(K["from"])
            if self.peek() not in ("", ")"):
                self.expr()
        elif c == "→" and not py:
            self.p += 1
            if self.peek() == "(":
                self.params_rb()
            self.block()
        else:
            self.fault("an expression is missing" if c != BAD else "unexpected character")

    def arg(self):
        py = self.lang == "python"
        while self.peek() and self.peek() in "*⋆&":
            self.p += 1
        if self.s[self.p : self.p + 2] == "i=" and py:
            self.p += 2
        elif self.s[self.p : self.p + 2] in ("i:", '":') and not py:
            self.p += 2
            if self.peek() in (",", ")", "]", "}"):
                return
        self.expr(1 if not py else 2)
        if py and self.maybe("≔"):
            self.expr(2)

    def postfix(self):
        py = self.lang == "python"
        while True:
            c = self.peek()
            if not c:
                return
            if c in ".∷⍰" or (c == "&" and not py and self.s[self.p + 1 : self.p + 2] == "."):
                self.p += 1 + (c == "&")
                if self.peek() and (self.peek() == "i" or (self.peek() >= "Ā" and not py)):
                    self.p += 1
                else:
                    self.fault("a member is missing")
            elif c == "(":
                self.p += 1
                self.depth += 1
                while self.peek() != ")":
                    self.arg()
                    if py:
                        self.comp()
                    elif self.maybe("⇒"):
                        self.expr(2)
                    if not self.maybe(","):
                        break
                self.depth -= 1
                self.take(")", "')' is missing")
            elif c == "[":
                self.p += 1
                self.depth += 1
                while self.peek() != "]":
                    if not self.maybe(":"):
                        self.expr()
                    if not (self.maybe(",") or self.peek() in (":", "]")):
                        break
                self.depth -= 1
                self.take("]")
            elif c == "{" and not py and self.s[self.p - 1] in "i)":
                self.block()
            elif not py and c in ('"', "i", "0") and self.s[self.p - 1] == "i" and not self.depth:
                # A Ruby call without brackets.
                self.expr(2)
                while self.maybe(","):
                    self.arg()
                    if self.maybe("⇒"):
                        self.expr(2)
                return
            else:
                return

    def block(self):
        self.take("{")
        if self.maybe("|"):
            while self.maybe("i") or self.maybe(",") or self.maybe("*"):
                pass
            self.take("|")
        while self.peek() != "}":
            self.expr()
            if not self.maybe(";"):
                break
        self.take("}")

    def exprs(self):
        self.expr()
        while self.maybe(","):
            if self.peek() in ("", "=", ":", ")"):
                break
            self.expr()

    def params_py(self):
        self.take("(")
        self.depth += 1
        while self.peek() != ")":
            if self.maybe("/"):
                pass
            elif self.peek() in ("*",) and self.s[self.p + 1 : self.p + 2] == ",":
                self.p += 1
            else:
                self.maybe("*") or self.maybe("⋆")
                self.take("i", "a parameter is missing")
                if self.maybe(":"):
                    self.expr(2)
                if self.maybe("="):
                    self.expr(2)
            if not self.maybe(","):
                break
        self.depth -= 1
        self.take(")")

    def params_rb(self):
        self.take("(")
        self.depth += 1
        while self.peek() != ")":
            self.maybe("*") or self.maybe("⋆") or self.maybe("&")
            self.take("i", "a parameter is missing")
            if self.maybe(":") or self.maybe("="):
                if self.peek() not in (",", ")"):
                    self.expr(2)
            if not self.maybe(","):
                break
        self.depth -= 1
        self.take(")")

    def python_line(self) -> str:
        """Kind of a logical line: ``:`` for a header, else empty."""
        c = self.peek()
        if c == "@":
            self.p += 1
            self.expr()
            return "@"
        self.maybe(K["async"])
        c = self.peek()
        head = ""
        if c == K["def"]:
            self.p += 1
            self.take("i", "the function has no name")
            self.params_py()
            if self.maybe("→"):
                self.expr()
            head = ":"
        elif c == K["class"]:
            self.p += 1
            self.take("i", "the class has no name")
            if self.peek() == "(":
                self.postfix()
            head = ":"
        elif c in (K["if"], K["while"]) and c:
            self.p += 1
            self.expr()
            head = ":i" if c == K["if"] else ":l"
        elif c == K["elif"]:
            self.p += 1
            self.expr()
            head = ":e"
        elif c == K["else"]:
            self.p += 1
            head = ":x"
        elif c == K["for"]:
            self.p += 1
            self.expr(10)
            while self.maybe(","):
                if self.peek() != K["in"]:
                    self.expr(10)
            self.take(K["in"])
            self.exprs()
            head = ":l"
        elif c == K["try"]:
            self.p += 1
            head = ":t"
        elif c in (K["except"], K["finally"]) and c:
            self.p += 1
            self.maybe("*")
            if c == K["except"] and self.peek() != ":":
                self.exprs()
                if self.maybe(K["as"]):
                    self.take("i")
            head = ":c"
        elif c == K["with"]:
            self.p += 1
            while True:
                self.expr()
                if self.maybe(K["as"]):
                    self.expr(10)
                if not self.maybe(","):
                    break
            head = ":"
        if head:
            self.take(":", "':' is missing")
            if self.peek():
                self.python_simple()
                return "" if head in (":", ":l") else "1" + head[1:]
            return head
        self.python_simple()
        return ""

    def python_simple(self):
        while True:
            c = self.peek()
            if c in (K["import"],) and c:
                self.p += 1
                while True:
                    self.take("i")
                    while self.maybe("."):
                        self.take("i")
                    if self.maybe(K["as"]):
                        self.take("i")
                    if not self.maybe(","):
                        break
            elif c == K["from"]:
                self.p += 1
                dots = False
                while self.maybe(".") or self.maybe("…"):
                    dots = True
                if self.peek() == "i":
                    self.take("i")
                    while self.maybe("."):
                        self.take("i")
                elif not dots:
                    self.fault("a module is missing")
                self.take(K["import"])
                if not self.maybe("*"):
                    br = self.maybe("(")
                    while True:
                        self.take("i")
                        if self.maybe(K["as"]):
                            self.take("i")
                        if not self.maybe(",") or (br and self.peek() == ")"):
                            break
                    if br:
                        self.take(")")
            elif c and c in _kw("pass", "break", "continue"):
                self.p += 1
            elif c and c in _kw("return", "raise", "del", "assert"):
                self.p += 1
                if self.peek() not in ("", ";"):
                    self.exprs()
                    if c == K["raise"] and self.maybe(K["from"]):
                        self.expr()
            elif c and c in _kw("global", "nonlocal"):
                self.p += 1
                self.take("i")
                while self.maybe(","):
                    self.take("i")
            else:
                self.exprs()
                if self.maybe(":"):
                    self.expr()
                if self.maybe("≔"):
                    self.exprs()
                while self.maybe("="):
                    self.exprs()
            if not self.maybe(";") or not self.peek():
                break
        if self.peek():
            self.fault("the statement does not end here" if self.peek() != BAD else "unexpected character")

    def ruby_line(self) -> str:
        """Kind of a logical line: ``+`` opens a block, ``-`` closes one, ``~`` continues one."""
        c = self.peek()
        out = ""
        if c == K["end"]:
            self.p += 1
            if self.peek() == ".":
                self.postfix()
            if self.peek():
                self.fault("the statement does not end here")
            return "-"
        if c == K["def"]:
            self.p += 1
            self.maybe(K["self"]) and self.take(".")
            self.take("i", "the method has no name")
            self.maybe("=")
            if self.peek() == "(":
                self.params_rb()
            elif self.peek() == "i":
                self.exprs()
            out = "+"
            if self.maybe("="):
                self.expr()
                out = ""
        elif c in (K["class"], K["module"]) and c:
            self.p += 1
            self.maybe("«")
            self.take("i", "the class has no name") if self.peek() != K["self"] else self.take(K["self"])
            while self.maybe("∷"):
                self.take("i")
            if self.maybe("<"):
                self.expr()
            out = "+"
        elif c and c in _kw("if", "unless", "while", "until", "case"):
            self.p += 1
            if self.peek():
                self.expr()
            elif c != K["case"]:
                self.fault("a condition is missing")
            self.maybe(K["then"])
            self.maybe(K["do"])
            out = "+"
        elif c == K["for"]:
            self.p += 1
            self.take("i")
            self.take(K["in"])
            self.expr()
            self.maybe(K["do"])
            out = "+"
        elif c == K["begin"]:
            self.p += 1
            out = "+"
        elif c and c in _kw("else", "elsif", "when", "rescue", "ensure", "in"):
            self.p += 1
            if self.peek():
                if self.peek() != "⇒":
                    self.exprs()
                if self.maybe("⇒"):
                    self.take("i")
            self.maybe(K["then"])
            out = "~"
        else:
            if c and c in _kw("return", "break", "next", "redo", "require", "yield"):
                self.p += 1
                if self.peek() and self.peek() not in (K["if"], K["unless"]):
                    self.exprs()
            else:
                self.expr()
                while self.maybe(","):
                    self.expr()
                if self.peek() in ("=", "≔"):
                    self.p += 1
                    self.exprs()
            if self.peek() and self.peek() in _kw("if", "unless", "while", "until", "rescue"):
                self.p += 1
                self.expr()
            if self.maybe(K["do"]):
                if self.maybe("|"):
                    while self.maybe("i") or self.maybe(",") or self.maybe("*") or self.maybe("(") or self.maybe(")"):
                        pass
                    self.take("|")
                out = "+"
        if self.peek():
            self.fault("the statement does not end here" if self.peek() != BAD else "unexpected character")
        return out


_LINES: dict[tuple[str, str], tuple] = {}


def _line(lang: str, unit: str) -> tuple:
    """(kind, None) of a logical line, or (None, error); brackets must be balanced here."""
    key = (lang, unit)
    r = _LINES.get(key)
    if r is None:
        if len(_LINES) > 300_000:
            _LINES.clear()
        p = Lines(lang, unit)
        try:
            r = (p.python_line() if lang == "python" else p.ruby_line(), None)
        except Fault as f:
            r = (None, (f.at, f.why))
        _LINES[key] = r
    return r


_OPEN, _CLOSE = re.compile(r"[(\[{]"), re.compile(r"[)\]}]")


def _open(s: str) -> int:
    return s.count("(") + s.count("[") + s.count("{") - s.count(")") - s.count("]") - s.count("}")


def _by_lines(lang: str, s: str) -> list[tuple[int, str]]:
    py = lang == "python"
    errors: list[tuple[int, str]] = []
    if py:
        s = "\nက" + s
    parts = s.split("\n")
    pos = 1 if py else 0
    indents, want, ruby = [0], False, 0
    heads: dict[int, str] = {}
    deco = False
    k, off = (1, 0) if py else (0, 0)
    at = 0 if py else 0
    while k < len(parts):
        raw = parts[k]
        begin = at
        at += len(raw) + 1
        if py:
            width, unit = ord(raw[0]) - 0x1000, raw[1:]
        else:
            width, unit = 0, raw
        k += 1
        if not unit:
            continue
        n = _open(unit)
        more = [unit]
        while (n > 0 or (not py and unit[-1] in "+-*/=,.∧∨&(≔" and len(unit) > 1)) and k < len(parts):
            nxt = parts[k][1:] if py else parts[k]
            at += len(parts[k]) + 1
            k += 1
            more.append(nxt)
            if not nxt and n <= 0:
                continue
            n += _open(nxt)
            unit = nxt or unit
        if not py:
            while k < len(parts) and parts[k][:1] == "." and parts[k][1:2] != ".":
                more.append(parts[k])
                at += len(parts[k]) + 1
                k += 1
        unit = "".join(more)
        kind, err = _line(lang, unit)
        here = begin
        if err is not None:
            errors.append((here + err[0], err[1]))
            kind = ":" if py and unit[-1] == ":" else ""
        if py:
            if want:
                if width <= indents[-1]:
                    errors.append((here, "an indented block is missing"))
                else:
                    indents.append(width)
            elif width > indents[-1]:
                errors.append((here, "unexpected indent"))
                indents.append(width)
            while width < indents[-1]:
                heads.pop(indents[-1], None)
                indents.pop()
            if width != indents[-1]:
                errors.append((here, "the indent matches no outer block"))
                indents.append(width)
            if deco and kind != "@" and unit[0] not in _kw("def", "class", "async"):
                errors.append((here, "a decorator without definition"))
            deco = kind == "@"
            want = kind[:1] == ":"
            tag = kind[1:2] if kind and kind[0] in ":1" else ""
            before = heads.get(width, "")
            if tag in ("e", "x", "c") and tag and not (
                (tag == "e" and before in ("i", "e")) or (tag == "x" and before in ("i", "e", "l", "c")) or (tag == "c" and before in ("t", "c", "x"))
            ):
                errors.append((here, "a branch without its beginning"))
            heads[width] = tag if not (tag == "x" and before == "c") else "c"
        else:
            if kind == "+":
                ruby += 1
            elif kind == "-":
                ruby -= 1
                if ruby < 0:
                    errors.append((here, "unexpected 'end'"))
                    ruby = 0
            elif kind == "~" and ruby == 0:
                errors.append((here, "a branch without its beginning"))
    if py and want:
        errors.append((len(s), "an indented block is missing (the text ends)"))
    if py and deco:
        errors.append((len(s), "a decorator without definition (the text ends)"))
    if not py and ruby > 0:
        errors.append((len(s), "'end' is missing (the text ends)"))
    return errors


def _make_room(s: str) -> None:
    """Lets the parser descend as deep as a text can nest: frames of Python functions lie on
    the heap, so only the interpreter's own limit stands against it."""
    need = 1_000 + 40 * len(s)
    if need > sys.getrecursionlimit():
        sys.setrecursionlimit(need)


def faults(lang: str, text: str, memo: bool = True) -> list[tuple[int, str]]:
    """All errors as (position in the shape, reason); empty if the text is accepted."""
    s = shape(lang, text)
    _make_room(s)
    if lang in ("python", "ruby"):
        return _by_lines(lang, s)
    if memo and _units_hold(lang, s):
        return []
    return Parser(lang, s).file()


def located(lang: str, text: str, errors: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The errors with line numbers, from 1, in the order of the text."""
    shape(lang, "")
    k = _SHAPES[lang]
    ends, offs, n = [], [], 1 if lang == "python" else 0
    for m in LEXER[lang].finditer(text):
        c = k[m.group()]
        if c:
            n += len(c)
            ends.append(n)
            offs.append(m.start())
    out, breaks = [], [m.start() for m in re.finditer("\n", text)]
    for at, why in errors:
        j = bisect_right(ends, at)
        o = offs[j] if j < len(offs) else len(text)
        out.append((bisect_left(breaks, o) + 1 + (text[o : o + 1] == "\n"), why))
    return sorted(out)

"""Definitions and references of one source file, for thirteen languages.

A file is cut into tokens, brackets are matched, and one walk over the tokens keeps a stack
of the scopes it is in.  Words that begin a definition in a language are handled by the rule
of that language; every name before an opening bracket is a call.  Python, whose grammar is
at hand, is walked as a syntax tree.  A receiver's type is followed through parameters,
variables, fields and loops as a chain of steps that is resolved when all files are known.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from dataclasses import dataclass, field

FIELDS = (
    "row string, path string, language string, id string, kind string, name string, qualified_name string, start_line int, end_line int, start_column int, end_column int, docstring string, "
    "signature string, visibility string, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean, decorators string, type_parameters string, parent string, "
    "ref_kind string, qualifier string, chain string, line int, col int"
)
COLUMNS = [c.strip().split(" ")[0] for c in FIELDS.split(",")]
_AT = {c: i for i, c in enumerate(COLUMNS)}


def row(**kw) -> tuple:
    out: list = [None] * len(COLUMNS)
    for k, v in kw.items():
        out[_AT[k]] = v
    return tuple(out)


def node_id(kind: str, qualified: str, path: str, line: int, col: int) -> str:
    if kind == "file":
        return f"file:{path}"
    raw = b"\0".join([qualified.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass"), line.to_bytes(4, "little"), col.to_bytes(4, "little")])
    return f"{kind}:{hashlib.sha256(raw).hexdigest()[:32]}"


# ---- tokens

_TOKEN = re.compile(
    r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"?|`[^`]*`?|(?<![A-Za-z0-9_])'(?:[^'\\\n]|\\.)*')"
    r"|(?P<w>[$@]?[^\W\d]\w*[!?]?(?=\W|\Z)|[$@]?[^\W\d]\w*)|(?P<n>\d[\w.]*)|(?P<o>::|->|=>|==|!=|<=|>=|&&|\|\||\?\.|\.\.\.?|[^\s\w])",
    re.S,
)
_RUST_CHAR = re.compile(r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'")
_HASHES = re.compile(r"#[^\n]*")
OPEN, CLOSE = "([{", ")]}"


@dataclass
class Token:
    kind: str
    text: str
    at: int
    end: int
    line: int
    col: int
    first: bool


def tokens(language: str, text: str) -> tuple[list[Token], list[Token]]:
    """(code, comments) of a text; words lose a trailing mark that belongs to the next token."""
    code, notes = [], []
    hashes = language in ("ruby", "php")
    at, line, begin, last = 0, 1, 0, 0
    while at < len(text):
        c = text[at]
        if c == "\n":
            line, begin, at = line + 1, at + 1, at + 1
            continue
        if c.isspace():
            at += 1
            continue
        if c == "#" and hashes and text[at : at + 2] != "#[":
            m, kind = _HASHES.match(text, at), "c"
        elif c == "'" and language in ("rust", "scala", "kotlin"):
            m, kind = _RUST_CHAR.match(text, at), "s"
            if not m:
                at += 1
                continue
        elif c == "'" and language in ("javascript", "typescript", "php", "ruby"):
            m, kind = re.compile(r"'(?:[^'\\]|\\.)*'?", re.S).match(text, at), "s"
        else:
            m = _TOKEN.match(text, at)
            if not m:
                at += 1
                continue
            kind = m.lastgroup
        s = m.group()
        if kind == "w" and s[-1] in "!?" and language != "ruby":
            s = s[:-1]
        if kind == "w" and s[0] == "@" and language not in ("ruby",):
            kind, s = "o", "@"
        t = Token(kind, s, at, at + len(s), line, at - begin, line != last)
        (notes if kind == "c" else code).append(t)
        if kind != "c":
            last = line
        n = s.count("\n")
        if n:
            line += n
            begin = at + s.rfind("\n") + 1
            if kind != "c":
                last = line
        at += len(s)
    return code, notes


def matches(code: list[Token]) -> list[int]:
    """For each opening bracket its closing one, else -1; mismatches are closed by the next."""
    out, stack = [-1] * len(code), []
    for i, t in enumerate(code):
        if t.kind != "o":
            continue
        if t.text in OPEN:
            stack.append(i)
        elif t.text in CLOSE:
            want = OPEN[CLOSE.index(t.text)]
            while stack and code[stack[-1]].text != want:
                stack.pop()
            if stack:
                out[stack[-1]] = i
                out[i] = stack.pop()
    return out


_MARK = re.compile(r"^[ \t]*(?:/\*\*?!?|///?!?|//!|\*(?!/)|#+)?[ \t]?|[ \t]*\*/[ \t]*$")


def clean_comment(lines: list[str]) -> str | None:
    text = "\n".join(_MARK.sub("", x.rstrip()).rstrip() for c in lines for x in c.split("\n")).strip()
    return text or None


# ---- languages

#: Words that may stand before a definition (fixed values).
MODIFIERS = {
    "rust": {"pub", "async", "unsafe", "const", "extern", "default"},
    "typescript": {"async", "static", "abstract", "public", "private", "protected", "readonly", "declare", "override", "get", "set"},
    "java": {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "transient", "volatile", "sealed"},
    "csharp": {"public", "private", "protected", "internal", "static", "readonly", "const", "abstract", "sealed", "virtual", "override", "async", "partial", "extern", "new", "unsafe", "required", "volatile"},
    "kotlin": {"public", "private", "protected", "internal", "abstract", "open", "final", "sealed", "data", "enum", "inner", "override", "suspend", "inline", "const", "lateinit", "operator", "infix", "tailrec", "external", "annotation", "value", "companion"},
    "php": {"public", "private", "protected", "static", "abstract", "final", "readonly", "var"},
    "scala": {"private", "protected", "abstract", "final", "sealed", "implicit", "lazy", "override", "case", "inline", "open"},
    "swift": {"public", "private", "fileprivate", "internal", "open", "static", "final", "override", "mutating", "convenience", "required", "lazy", "weak", "indirect", "class"},
    "c": {"static", "extern", "inline", "const", "volatile", "register"},
    "go": set(),
    "ruby": set(),
}
MODIFIERS["javascript"] = MODIFIERS["typescript"]
MODIFIERS["cpp"] = MODIFIERS["c"] | {"virtual", "constexpr", "explicit", "friend", "typename", "mutable"}
#: Words that look like calls and are none (fixed values).
NO_CALL = {
    "if", "else", "for", "foreach", "while", "switch", "match", "when", "return", "catch", "throw", "throws", "sizeof", "typeof", "instanceof", "in", "of", "is", "as", "do", "try", "with", "using", "lock", "fixed", "yield", "await", "delete",
    "assert", "and", "or", "not", "case", "default", "super", "this", "self", "base", "init", "constructor", "function", "func", "fun", "fn", "def", "new", "defer", "go", "select", "range", "guard", "repeat", "until", "elsif", "elseif", "unless", "echo",
    "print", "isset", "unset", "empty", "list", "array", "require", "require_once", "include", "include_once", "exit", "die", "static", "alignof", "decltype", "nameof", "where", "import", "operator", "unsafe", "move", "loop", "let", "var", "val", "const", "mut",
}
_PRIMITIVE = {
    "bool", "char", "str", "string", "number", "boolean", "void", "int", "long", "short", "byte", "float", "double", "any", "unknown", "never", "null", "undefined", "object", "symbol", "bigint", "error", "rune", "uintptr", "complex64", "complex128", "usize", "isize",
    "decimal", "uint", "ulong", "ushort", "sbyte", "nint", "nuint", "dynamic", "var", "u8", "u16", "u32", "u64", "u128", "i8", "i16", "i32", "i64", "i128", "f32", "f64", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64",
    "dyn", "impl", "mut", "const", "ref", "out", "params", "this", "final", "readonly", "keyof", "typeof", "infer", "is", "extends", "chan", "map", "func", "struct", "interface", "fn", "where", "unsafe", "self", "crate", "super", "Self",
}
#: Languages whose scopes name what lies in them, by kind of scope.
_QUALIFIES = {
    "rust": {"impl", "struct", "enum", "trait", "mod"}, "typescript": {"class", "enum", "interface"}, "javascript": {"class", "enum", "interface"}, "c": {"enum"}, "cpp": {"enum"}, "go": set(),
    "java": {"namespace", "class", "interface", "enum"}, "csharp": {"class", "struct", "interface", "enum"}, "kotlin": {"namespace", "class", "interface", "enum"},
    "php": {"class", "interface", "trait", "enum"}, "scala": {"class", "trait", "enum"}, "swift": {"class", "struct", "enum", "interface"}, "ruby": {"module", "class"},
}
_TYPES = {"class", "struct", "interface", "trait", "enum", "impl", "module"}


@dataclass
class Scope:
    kind: str
    name: str
    id: str | None
    end: int
    known: dict[str, list] = field(default_factory=dict)


class Walk:
    def __init__(self, path: str, language: str, text: str):
        self.path, self.lang, self.text = path, language, text
        self.t, self.notes = tokens(language, text)
        self.pair = matches(self.t)
        self.rows: list[tuple] = []
        self.scopes: list[Scope] = []
        self.types: dict[str, str] = {}
        self.members: dict[str, dict[str, list]] = {}
        self.late: list[tuple] = []
        self.package: str | None = None
        self.by_end = {n.line + n.text.count("\n"): n for n in self.notes if not self._shares_line(n)}
        self.marker: dict[int, str] = {}
        self.directives = {t.line for t in self.t if t.first and t.text == "#"}

    def _shares_line(self, n: Token) -> bool:
        begin = self.text.rfind("\n", 0, n.at) + 1
        return bool(self.text[begin : n.at].strip())

    # -- reading tokens

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts and self.t[i].kind != "s"

    def word(self, i: int) -> str | None:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind == "w" else None

    def close(self, i: int) -> int:
        """The bracket that closes the one at ``i``; the end of the text if there is none."""
        return self.pair[i] if self.pair[i] >= 0 else len(self.t) - 1

    def angles(self, i: int) -> int:
        """The token after a list in angle brackets at ``i``, or ``i``."""
        if not self.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < len(self.t):
            s = self.t[k].text
            depth += (s == "<") - (s == ">")
            if s in "({[" and self.t[k].kind == "o":
                k = self.close(k)
            elif s in ";" or s == "&&":
                return i
            k += 1
            if depth == 0:
                return k
        return i

    def until(self, i: int, *stops: str) -> int:
        """The first of ``stops`` from ``i`` on at this level of brackets, or the end."""
        while i < len(self.t) and not (self.t[i].text in stops and self.t[i].kind != "s"):
            if self.t[i].kind == "o" and self.t[i].text in OPEN:
                i = self.close(i)
            elif self.t[i].kind == "o" and self.t[i].text in CLOSE:
                return i
            i += 1
        return min(i, len(self.t))

    def line_end(self, i: int) -> int:
        """The token after the statement at ``i`` in a language that ends it with the line."""
        while i < len(self.t):
            if self.t[i].kind == "o" and self.t[i].text in OPEN:
                i = self.close(i)
            i += 1
            if i < len(self.t) and (self.t[i].first or self.t[i].text in (";", "}")):
                break
        return min(i, len(self.t))

    def src(self, a: int, b: int) -> str:
        """The text from token ``a`` to before token ``b``."""
        return self.text[self.t[a].at : self.t[b - 1].end].replace("\r\n", "\n") if a < b <= len(self.t) else ""

    # -- writing rows

    def prefix(self) -> list[str]:
        return [s.name for s in self.scopes if s.kind in _QUALIFIES[self.lang]]

    def owner(self) -> str:
        return next((s.id for s in reversed(self.scopes) if s.id), f"file:{self.path}")

    def container(self) -> Scope | None:
        return next((s for s in reversed(self.scopes) if s.kind in _TYPES), None)

    def in_body(self) -> bool:
        return any(s.kind in ("function", "method") for s in self.scopes)

    def first_of(self, i: int) -> int:
        """The first token of the definition at ``i``: modifiers and annotations before it."""
        mods = MODIFIERS[self.lang]
        while i > 0:
            if self.t[i - 1].kind == "w" and self.t[i - 1].text in mods:
                i -= 1
            elif self.is_(i - 1, ")") and self.is_(self.pair[i - 1] - 1, "pub", "private", "internal"):
                i = self.pair[i - 1]
            elif self.is_(i - 1, ")") and self.is_(self.pair[i - 1] - 2, "@"):
                i = self.pair[i - 1] - 2
            elif self.t[i - 1].kind == "w" and self.is_(i - 2, "@"):
                i -= 2
            elif self.t[i - 1].kind == "s" and self.is_(i - 2, "extern"):
                i -= 1
            elif self.lang == "csharp" and self.is_(i - 1, "]") and self.pair[i - 1] >= 0 and self.t[self.pair[i - 1]].first:
                i = self.pair[i - 1]
            else:
                break
        return i

    def doc(self, first: int) -> str | None:
        while first and (self.is_(first - 1, "export", "default") or (self.is_(first - 1, "]") and self.lang == "rust" and self.is_(self.pair[first - 1] - 1, "#"))):
            first = self.pair[first - 1] - 1 if self.is_(first - 1, "]") else first - 1
        line, got = self.t[first].line - 1, []
        while line in self.by_end:
            n = self.by_end[line]
            if n.text.startswith("//!"):
                break
            got.append(n.text)
            line = n.line - 1
        return clean_comment(got[::-1]) if got else None

    def node(self, kind: str, name: str, first: int, last: int, *, signature=None, qualified=None, mods=None, parent=None, doc=True, params=None, **more) -> str:
        a, z = self.t[first], self.t[max(first, min(last, len(self.t) - 1))]
        q = qualified or "::".join([*self.prefix(), name])
        i = node_id(kind, q, self.path, a.line, a.col)
        mods = set(self.modifiers(first) if mods is None else mods)
        self.rows.append(
            row(
                row="node", path=self.path, language=self.lang, id=i, kind=kind, name=name, qualified_name=q, start_line=a.line, end_line=z.line + z.text.count("\n"), start_column=a.col,
                end_column=z.col + len(z.text), docstring=self.doc(first) if doc and kind not in ("import", "enum_member") else None, signature=signature,
                visibility=self.visibility(kind, mods, first), is_exported=more.get("exported", False), is_async=bool(mods & {"async", "suspend"}), is_static="static" in mods and self.lang not in ("c", "cpp"),
                is_abstract="abstract" in mods, type_parameters=json.dumps(params) if params else None, parent=parent or self.owner(),
            )
        )
        if kind in _TYPES:
            self.types.setdefault(name, i)
        return i

    def modifiers(self, i: int) -> list[str]:
        out = []
        while i < len(self.t):
            if self.is_(i, "@"):
                i = self.close(i + 2) + 1 if self.is_(i + 2, "(") else i + 2
            elif self.t[i].kind == "w" and self.t[i].text in MODIFIERS[self.lang]:
                out.append(self.t[i].text)
                i = self.close(i + 1) + 1 if self.is_(i + 1, "(") else i + 1
            elif self.t[i].kind == "s" and out[-1:] == ["extern"] or self.is_(i, "["):
                i = self.close(i) + 1
            else:
                break
        return out

    def visibility(self, kind: str, mods: set, first: int) -> str | None:
        lang = self.lang
        if kind in ("import", "file", "enum_member", "namespace", "module", "variable", "type_alias") or kind == "constant" and lang != "php":
            return None
        found = next((m for m in ("public", "private", "protected", "internal", "fileprivate") if m in mods), None)
        if lang == "rust":
            return "public" if "pub" in mods and kind != "variable" else None
        if lang == "java":
            return found
        if lang == "ruby":
            return self.marker.get(len(self.scopes), "public") if kind in ("method", "function") else "public"
        default = {"csharp": "private", "swift": "internal", "kotlin": "public", "php": "public", "scala": "public"}.get(lang)
        return {"fileprivate": "private"}.get(found, found) or default

    def site(self, ref: str, name: str, at: int, *, qualifier=None, chain=None, source=None) -> None:
        t = self.t[at]
        self.rows.append(
            row(row="site", path=self.path, language=self.lang, id=source or self.owner(), name=name, ref_kind=ref, qualifier=qualifier, chain=json.dumps(chain) if chain else None, line=t.line, col=t.col)
        )

    def import_(self, name: str, first: int, last: int, at: int | None = None) -> None:
        if not name or (self.in_body() and self.lang in ("rust", "typescript", "javascript")):
            return
        i = self.node("import", name, first, last - 1, signature=self.src(first, last).strip(), doc=False)
        self.rows.append(row(row="site", path=self.path, language=self.lang, id=self.owner() if self.lang == "kotlin" else f"file:{self.path}", name=name, ref_kind="imports", qualifier=i, line=self.t[first].line, col=self.t[first].col))

    def push(self, kind: str, name: str, i: str | None, end: int) -> None:
        self.scopes.append(Scope(kind, name, i, end))

    # -- types and chains

    def bare(self, a: int, b: int) -> str | None:
        """The name of the type in tokens ``a`` to ``b``, without references and arguments."""
        while a < b and (self.t[a].text in ("&", "*", "mut", "dyn", "const", "final", "readonly", "struct") or self.t[a].text.startswith("'")):
            a += 1
        name = None
        while a < b and self.t[a].kind == "w":
            name = self.t[a].text
            a += 1
            if a < b and self.t[a].text in ("::", "."):
                a += 1
                continue
            break
        if a < b and self.t[a].text not in ("<", ",", "="):
            return None
        return name if name and name not in _PRIMITIVE else ("Self" if name == "Self" else None)

    def own_type(self) -> str | None:
        c = self.container()
        if c is None:
            return None
        return "::".join([s.name for s in self.scopes[: self.scopes.index(c) + 1] if s.kind in _QUALIFIES[self.lang]]) if self.lang == "java" else c.name

    def type_step(self, name: str | None) -> list | None:
        if not name:
            return None
        return [{"op": "type", "name": f"{self.package}::{name}" if self.lang == "java" and self.package and "::" not in name else name}]

    def lookup(self, name: str) -> list | None:
        for s in reversed(self.scopes):
            if name in s.known:
                return s.known[name]
            if s.kind in ("function", "method"):
                break
        return None

    def chain(self, i: int, stop: int) -> list | None:
        """The steps of the expression from ``i`` to before ``stop``; None if it is no such chain."""
        while i < stop and self.is_(i, "await", "&", "mut", "*"):
            i += 1
        steps: list | None = None
        if self.is_(i, "new") and self.word(i + 1):
            steps, i = self.type_step(self.word(i + 1)), self.angles(i + 2)
            if self.is_(i, "("):
                i = self.close(i) + 1
        elif self.is_(i, "self", "this"):
            own = self.own_type()
            i += 1
            if own and self.is_(i, ".") and self.word(i + 1) and not self.is_(i + 2, "("):
                steps = self.members.get(own.rsplit("::", 1)[-1], {}).get(self.word(i + 1))
                i += 2
                if steps is None:
                    return None
            else:
                steps = [{"op": "type", "name": own}] if own else None
        elif self.word(i):
            path = [self.t[i].text]
            k = i + 1
            while self.is_(k, "::") and (self.word(k + 1) or self.is_(k + 1, "<")):
                if self.word(k + 1):
                    path.append(self.t[k + 1].text)
                    k += 2
                else:
                    k = self.angles(k + 1)
            if self.is_(k, "("):
                steps = [{"op": "bare", "name": path[0]}] if len(path) == 1 else [{"op": "qualified", "qualifier": path[-2], "name": path[-1]}]
                k = self.close(k) + 1
            elif self.is_(k, "{") and self.lang == "rust" and path[-1][:1].isupper() and k < stop:
                steps, k = [{"op": "type", "name": path[-1]}], self.close(k) + 1
            elif len(path) == 1:
                steps = self.lookup(path[0])
            i = k
        if steps is None:
            return None
        steps = list(steps)
        while i < stop:
            if self.is_(i, "?", "!") or (self.is_(i, ".") and self.is_(i + 1, "await")):
                i += 2 if self.is_(i, ".") else 1
            elif self.is_(i, ".", "?.") and self.word(i + 1) and self.is_(self.angles(i + 2), "("):
                steps.append({"op": "method", "name": self.t[i + 1].text})
                i = self.close(self.angles(i + 2)) + 1
            else:
                return None
        return steps

    def begins(self, i: int) -> int:
        """The first token of the receiver that ends at ``i``."""
        while i >= 0:
            if self.is_(i, ")", "]"):
                if self.pair[i] < 0:
                    return i
                i = self.pair[i] - 1
                if i < 0 or self.t[i].kind != "w":
                    return i + 1
            if self.is_(i, "?", "!"):
                i -= 1
                continue
            if i >= 0 and self.t[i].kind == "w":
                if self.is_(i - 1, ".", "?.", "::"):
                    i -= 2
                    continue
                return i - 1 if self.is_(i - 1, "new") else i
            return i + 1
        return 0

    def learn(self, name: str, steps: list | None) -> None:
        if steps and self.scopes:
            self.scopes[-1].known[name] = steps

    def parameters(self, a: int, b: int) -> list[tuple[str, int, int]]:
        """(name, first and end token of its type) of the parameters between brackets."""
        out, i = [], a + 1
        groups = []
        while i < b:
            j = i
            while j < b and not self.is_(j, ","):
                n = self.angles(j)
                j = n if n > j else (self.close(j) + 1 if self.t[j].kind == "o" and self.t[j].text in OPEN else j + 1)
            groups.append((i, min(j, b)))
            i = j + 1
        if self.lang == "go":
            named = any(z - x > 1 and self.word(x) and not self.is_(x + 1, ".") for x, z in groups)
            return [(self.t[x].text if named else "", x + 1 if named else x, z) for x, z in groups]
        for x, z in groups:
            end = next((k for k in range(x, z) if self.is_(k, "=") and self.t[k].kind == "o"), z)
            colon = next((k for k in range(x, end) if self.is_(k, ":")), None)
            if self.lang in ("java", "csharp", "c", "cpp", "php"):
                names = [k for k in range(x, end) if self.t[k].kind == "w"]
                if names and len(names) > 1:
                    out.append((self.t[names[-1]].text, x, names[-1]))
            elif colon is not None:
                name = next((self.t[k].text for k in range(colon - 1, x - 1, -1) if self.t[k].kind == "w"), "")
                out.append((name, colon + 1, end))
        return out

    def type_refs(self, spans: list[tuple[int, int]], ref: str, source: str) -> None:
        for a, b in spans:
            for k in range(a, min(b, len(self.t))):
                w = self.word(k)
                if not w or w in _PRIMITIVE or self.is_(k + 1, "::") or (self.is_(k - 1, ".") and self.lang not in ("csharp", "go")) or self.is_(k - 1, "'"):
                    continue
                if self.is_(k + 1, ".") and self.lang in ("csharp", "go", "java"):
                    continue
                if self.lang in ("typescript", "javascript") and self.is_(k + 1, ":", "?") and not self.is_(k - 1, "|"):
                    continue
                self.site(ref, w, k, source=source)

    # -- definitions common to several languages

    def returned(self, i: int) -> int:
        """The token after the return type at ``i`` (after the parameters)."""
        stops = ("{", ";", "=", "where") if self.lang != "typescript" else ("{", ";", "=>")
        k = i
        while k < len(self.t) and not (self.t[k].text in stops and self.t[k].kind != "s"):
            if self.t[k].text == "{" or self.t[k].text in CLOSE:
                break
            if self.t[k].text in "([" and self.t[k].kind == "o":
                k = self.close(k)
            elif self.lang in ("kotlin", "swift", "scala", "go") and self.t[k].first and k > i:
                break
            k += 1
        return k

    def callable(self, keyword: int, name_at: int, *, kind=None, qualified=None, name=None, receiver=None, first=None) -> int | None:
        """A function or method whose name stands at ``name_at``; the token to go on with."""
        name = name or self.t[name_at].text
        generics = self.angles(name_at + 1)
        params = [x.text for x in self.t[name_at + 2 : generics - 1] if x.kind == "w" and x.text not in ("extends", "in", "out")] if generics > name_at + 1 else None
        open_ = generics
        if not self.is_(open_, "("):
            if self.lang == "scala":
                close = open_ - 1
            else:
                return None
        else:
            close = self.close(open_)
        end = self.returned(close + 1)
        c = self.container()
        inside = c is not None and not self.in_body()
        kind = kind or ("method" if inside or (self.lang in ("rust", "typescript", "javascript") and c is not None) else "function")
        body = end if self.is_(end, "{") else None
        last = self.close(end) if body is not None else end
        if self.lang in ("kotlin", "scala") and self.is_(end, "="):
            last = self.line_end(end + 1) - 1
            if self.lang == "scala" and self.is_(end + 1, "{"):
                body, last = end + 1, self.close(end + 1)
        elif body is None and not self.is_(end, ";"):
            last = end - 1
        if self.lang == "rust" and body is None:
            return end + 1
        if self.lang == "typescript" and body is None and kind == "function":
            return end + 1
        if self.lang == "swift" and body is None:
            return end
        sig = None
        if self.lang in ("rust", "typescript", "javascript", "go"):
            where = next((k for k in range(close + 1, end) if self.is_(k, "where")), end)
            sig = self.src(open_, where).strip()
        elif self.lang == "scala":
            sig = self.src(open_, end).strip() or None
        first = self.first_of(keyword) if first is None else first
        i = self.node(kind, name, first, last, signature=sig, qualified=qualified, params=params, exported=self.exported(keyword, kind, name))
        if receiver and receiver in self.types:
            self.late.append(("contains", self.types[receiver], i))
        elif receiver:
            self.late.append(("later", receiver, i))
        given = self.parameters(open_, close) if self.is_(open_, "(") else []
        result = (close + 1, end)
        if self.lang == "rust" or self.lang in ("typescript", "javascript"):
            self.type_refs([(a, b) for _, a, b in given] + [result], "references", i)
        elif self.lang == "go":
            self.type_refs([(a, b) for _, a, b in given] + [result], "strict", i)
        elif self.lang == "swift":
            self.type_refs([result], "references", i)
        stop = last + 1 if body is not None or self.lang in ("kotlin", "scala") else end
        self.push(kind, name, i, max(stop, close + 1))
        for n, a, b in given:
            self.learn(n, self.type_step(self.bare(a, b)))
        return (body + 1) if body is not None else (end + 1 if self.is_(end, "=") else max(end, close + 1))

    def exported(self, keyword: int, kind: str, name: str) -> bool:
        if self.lang in ("typescript", "javascript"):
            k = self.first_of(keyword)
            return self.is_(k - 1, "export", "default")
        return self.lang == "go" and kind in ("function", "struct", "interface", "type_alias") and name[:1].isupper()

    def type_(self, kind: str, keyword: int, name_at: int, heritage, *, first=None, need_body=False) -> int | None:
        """A type with a body; ``heritage`` reads what stands between name and body."""
        name = self.word(name_at)
        if not name:
            return None
        generics = self.angles(name_at + 1)
        params = [x.text for x in self.t[name_at + 2 : generics - 1] if x.kind == "w" and x.text not in ("extends", "in", "out", "class")] if generics > name_at + 1 else None
        k = generics
        while k < len(self.t) and not (self.t[k].text in ("{", ";", "}") and self.t[k].kind == "o"):
            if self.lang in ("kotlin", "scala", "swift") and self.t[k].first and not self.is_(k, ":", ",", "extends", "with") and not self.is_(k - 1, ",", ":", "with", "extends"):
                break
            k = self.close(k) + 1 if self.t[k].text in "([" and self.t[k].kind == "o" else k + 1
        body = self.is_(k, "{")
        if need_body and not body:
            return None
        last = self.close(k) if body else (k if self.is_(k, ";") else k - 1)
        first = self.first_of(keyword) if first is None else first
        i = self.node(kind, name, first, last, params=params, exported=self.exported(keyword, kind, name))
        if heritage:
            heritage(generics, k, i)
        if self.lang == "kotlin" or self.lang == "scala":
            self.members.setdefault(name, {})
        self.push(kind, name, i, last + 1 if body else k)
        if kind == "enum" and body and self.lang != "swift" and self.lang != "php" and self.lang != "scala":
            return self.enum_members(k, last, i)
        return k + 1 if body else k

    def enum_members(self, a: int, z: int, owner: str) -> int:
        """The members of an enumeration between brackets; goes on after them."""
        k = a + 1
        while k < z:
            while self.is_(k, "@", "#", "["):
                k = self.close(k) + 1 if self.is_(k, "[") else k + (2 if self.is_(k, "@") else 1)
            if self.is_(k, ";") or k >= z:
                break
            if self.word(k) or self.t[k].kind == "s":
                end = k + 1
                while end < z and not self.is_(end, ",", ";"):
                    end = self.close(end) + 1 if self.t[end].kind == "o" and self.t[end].text in OPEN else end + 1
                self.node("enum_member", self.t[k].text.strip("\"'"), k, end - 1, mods=())
                k = end
            if self.is_(k, ";"):
                break
            k += 1
        return k + 1 if k < z else z

    def parents(self, a: int, b: int, edge: str, source: str, at=None) -> None:
        """A list of types, with commas, that ``source`` inherits from."""
        k = a
        while k < b:
            while k < b and (self.is_(k, ",", "public", "private", "protected", "virtual", "final") or self.t[k].kind != "w"):
                k += 1
            if k >= b:
                break
            name = k
            while self.is_(name + 1, "::", ".") and self.word(name + 2) and self.lang not in ("typescript", "javascript"):
                name += 2
            self.site(edge, self.t[name].text.lstrip("\\"), name if at is None else at, source=source)
            k = name + 1
            while k < b and not self.is_(k, ","):
                n = self.angles(k)
                k = n if n > k else (self.close(k) + 1 if self.t[k].kind == "o" and self.t[k].text in OPEN else k + 1)

    # -- the walk

    def run(self) -> list[tuple]:
        i, rules = 0, RULES[self.lang]
        while i < len(self.t):
            while self.scopes and i >= self.scopes[-1].end:
                self.scopes.pop()
            t = self.t[i]
            nxt = None
            if self.lang == "ruby":
                nxt = self.ruby(i)
            elif t.kind in "wo":
                rule = rules.get(t.text)
                if rule is not None and not self.is_(i - 1, ".", "->", "?."):
                    nxt = rule(self, i)
                if nxt is None and "" in rules and t.kind == "w":
                    nxt = rules[""](self, i)
                if nxt is None and t.kind == "w":
                    self.call(i)
                    self.variable(i)
            i = nxt if nxt is not None and nxt > i else i + 1
        for what, a, b in self.late:
            if what == "implements":
                if a in self.types and b[0]:
                    self.site("implements", b[0], b[1], source=self.types[a])
                continue
            if what == "later":
                if a not in self.types:
                    continue
                a = self.types[a]
            parent = next((r[_AT["parent"]] for r in self.rows if r[0] == "node" and r[_AT["id"]] == b), None)
            if a != parent:
                self.rows.append(row(row="contains", path=self.path, language=self.lang, id=b, parent=a))
        return self.rows

    # -- Ruby, whose blocks end with a word

    def ruby_ends(self) -> dict[int, int]:
        """For each word that opens a block its ``end``."""
        out, stack = {}, []
        for i, t in enumerate(self.t):
            if t.kind != "w" or self.is_(i - 1, ".", "::", ":") or self.is_(i + 1, ":") and not self.is_(i + 1, "::"):
                continue
            starts = t.first or self.is_(i - 1, "=", ";", "(", "do", "then", "else", "|", "||", "return", "and", "or")
            if t.text in ("def", "class", "module", "begin", "do") or t.text in ("if", "unless", "while", "until", "case", "for") and starts:
                if t.text == "do" and stack and self.t[stack[-1]].text in ("while", "until", "for") and self.t[stack[-1]].line == t.line:
                    continue
                stack.append(i)
            elif t.text == "end" and stack:
                out[stack.pop()] = i
        return out

    def ruby(self, i: int) -> int | None:
        t = self.t[i]
        if i == 0:
            self.ends = self.ruby_ends()
        if t.kind != "w" or self.is_(i - 1, ":") or self.is_(i + 1, ":"):
            return None
        w, end = t.text, self.ends.get(i)
        if self.is_(i - 1, ".", "&"):
            return None
        if w in ("class", "module") and end is not None and self.word(i + 1):
            name = i + 1
            while self.is_(name + 1, "::") and self.word(name + 2):
                name += 2
            own = self.t[name].text
            n = self.node(w, own, i, end)
            if w == "class" and self.is_(name + 1, "<") and self.word(name + 2):
                base = name + 2
                while self.is_(base + 1, "::") and self.word(base + 2):
                    base += 2
                self.site("extends", self.t[base].text, base, source=n)
                name = base
            self.push(w, own, n, end)
            self.marker.pop(len(self.scopes), None)
            return name + 1
        if w == "def" and self.word(i + 1):
            name = i + 1
            if self.is_(name, "self") and self.is_(name + 1, "."):
                name += 2
            last = end if end is not None else self.line_end(i) - 1
            c = self.container()
            n = self.node("method" if c is not None or name > i + 1 else "function", self.t[name].text, i, last)
            self.push("method" if c is not None else "function", self.t[name].text, n, last + 1)
            k = name + 1
            if self.is_(k, "("):
                return self.close(k) + 1
            while k < len(self.t) and not self.t[k].first:
                k += 1
            return k
        if w in ("private", "protected", "public") and t.first and (i + 1 >= len(self.t) or self.t[i + 1].first):
            self.marker[len(self.scopes) + 1] = self.marker[len(self.scopes)] = w
            return i + 1
        if w in ("require", "require_relative"):
            k = i + 1 + self.is_(i + 1, "(")
            if k < len(self.t) and self.t[k].kind == "s":
                self.import_(self.t[k].text.strip("\"'"), i, k + 1 + self.is_(k + 1, ")"))
                return k + 1
        if t.first and self.is_(i + 1, "=") and w[0] not in "@$" and not self.in_body() and (i + 2 < len(self.t)):
            self.node("variable", w, i, self.line_end(i) - 1)
            return i + 2
        if w[0] in "@$" or w in NO_CALL or w in ("end", "then", "begin", "rescue", "ensure", "nil", "true", "false", "next", "break", "redo", "retry", "alias", "undef", "defined?"):
            return None
        if w[:1].isupper():
            k, at = i, i
            while self.is_(k + 1, "::") and self.word(k + 2) and self.t[k + 2].text[:1].isupper():
                k += 2
            if self.is_(k + 1, ".", "::") and self.word(k + 2):
                if self.t[k + 2].text == "new":
                    self.site("new", self.t[k].text, at)
                else:
                    self.site("qualified", self.t[k + 2].text, at, qualifier=self.t[k].text)
                return k + 3
            return None
        nxt = self.t[i + 1] if i + 1 < len(self.t) else None
        if self.is_(i + 1, "(") and nxt.at == t.end:
            self.site("calls", w, i)
        elif t.first and nxt is not None and not nxt.first and (nxt.kind in "wsn" and nxt.text not in ("if", "unless", "and", "or", "do", "while", "until") or nxt.text in ":@" and nxt.at > t.end):
            self.site("calls", w, i)
        elif t.first and self.in_body() and (nxt is None or nxt.first or nxt.text in ("if", "unless")):
            self.site("calls", w, i)
        return None

    def call(self, i: int) -> None:
        name, lang = self.t[i].text, self.lang
        open_ = self.angles(i + 1) if lang in ("typescript", "java", "csharp", "kotlin", "cpp", "scala") else i + 1
        if lang == "rust" and self.is_(i + 1, "::") and self.is_(i + 2, "<"):
            open_ = self.angles(i + 2)
        trailing = lang in ("kotlin", "swift", "scala") and self.is_(open_, "{") and self.is_(i - 1, ".")
        if lang in ("c", "cpp") and not self.in_body():
            return
        linked = self.is_(i - 1, ".", "?.", "->", "::")
        if self.scopes and self.scopes[-1].kind == "interface" and lang in ("typescript", "javascript", "java", "go", "php"):
            return
        if (name in NO_CALL and not linked) or not (self.is_(open_, "(") or trailing) or self.is_(i - 1, "@", "#", "fn", "func", "def", "fun", "function"):
            return
        if lang == "php" and name.startswith("$"):
            return
        at = i
        if self.is_(i - 1, "new"):
            if lang not in ("scala",):
                self.site("new", name, i - 1)
            return
        if self.is_(i - 1, "::"):
            head = i - 2
            if lang == "rust" and self.is_(head, ">"):
                return
            q = self.word(head)
            if not q:
                return
            while self.is_(head - 1, "::") and self.word(head - 2):
                head -= 2
            if self.is_(head - 1, "new"):
                self.site("new", name, head - 1)
                return
            if lang == "rust" and q == "Self":
                q = self.own_type() or q
            self.site("qualified", name, head, qualifier=q.lstrip("\\"))
            return
        if self.is_(i - 1, ".", "?.", "->"):
            start = self.begins(i - 2)
            if self.is_(start - 1, "new") and lang in ("java", "csharp"):
                return
            if lang in ("go", "cpp"):
                self.site("calls", name, max(start, 0))
                return
            if lang in ("rust", "typescript", "javascript"):
                steps = self.chain(start, i - 1)
                if steps:
                    self.site("method", name, start, chain=steps)
                return
            one = start == i - 2
            q = self.word(start)
            if lang in ("java", "csharp") and one and q:
                if lang == "java":
                    steps = [{"op": "type", "name": self.own_type()}] if q == "this" and self.own_type() else self.lookup(q) or self.members.get((self.own_type() or "").rsplit("::", 1)[-1], {}).get(q)
                    if steps and steps[0]["op"] == "type":
                        self.site("qualified", name, start, qualifier=steps[0]["name"])
                        return
                if q[:1].isupper():
                    self.site("qualified", name, start, qualifier=f"{self.package}::{q}" if lang == "java" and self.package else q)
            return
        if lang == "php" and self.is_(i - 1, "\\"):
            return
        self.site("calls", name, at)

    def variable(self, i: int) -> None:
        """What is known of a local variable from its declaration."""
        lang, w = self.lang, self.t[i].text
        if not self.in_body():
            return
        if lang == "rust" and w == "let" or lang in ("typescript", "javascript") and w in ("let", "const", "var"):
            k = i + 1 + self.is_(i + 1, "mut")
            name = self.word(k)
            if not name:
                return
            end = self.until(k, ";")
            if self.is_(k + 1, ":"):
                eq = self.until(k + 2, "=", ";")
                self.learn(name, self.type_step(self.bare(k + 2, eq)))
            elif self.is_(k + 1, "="):
                self.learn(name, self.chain(k + 2, end))
            elif self.is_(k + 1, "of") and self.is_(i - 1, "("):
                steps = self.chain(k + 2, self.close(i - 1))
                self.learn(name, [*steps, {"op": "element"}] if steps and steps[-1]["op"] != "type" else None)
        elif lang == "rust" and w == "for" and self.word(i + 1) and self.is_(i + 2, "in"):
            body = i + 3
            while body < len(self.t) and not self.is_(body, "{"):
                body = self.close(body) + 1 if self.t[body].kind == "o" and self.t[body].text in OPEN else body + 1
            steps = self.chain(i + 3, body)
            self.learn(self.t[i + 1].text, [*steps, {"op": "element"}] if steps and steps[-1]["op"] != "type" else None)
        elif lang == "java" and w not in NO_CALL and self.word(i + 1) and self.is_(i + 2, "=", ";", ":") and (w[:1].isupper()):
            self.learn(self.t[i + 1].text, self.type_step(w))


# ---- rules of the single languages: (walk, index) -> index to go on with, or None


def _rust_fn(w: Walk, i: int):
    if not w.word(i + 1):
        return None
    c = w.container()
    return w.callable(i, i + 1, receiver=c.name if c is not None and c.kind == "impl" else None)


def _rust_struct(w: Walk, i: int):
    if not w.word(i + 1) or w.is_(i - 1, "::"):
        return None
    nxt = w.type_("struct", i, i + 1, None)
    s = w.scopes[-1]
    for k in range(nxt or 0, min(s.end, len(w.t))):
        if w.word(k) and w.is_(k + 1, ":") and not w.is_(k - 1, ":"):
            steps = w.type_step(w.bare(k + 2, w.until(k + 2, ",", "}")))
            if steps:
                w.members.setdefault(s.name, {})[w.t[k].text] = steps
    return nxt


def _rust_trait(w: Walk, i: int):
    def bounds(a, b, source):
        if w.is_(a, ":"):
            w.parents(a + 1, next((k for k in range(a, b) if w.is_(k, "where")), b), "extends", source, at=a)
    return w.type_("trait", i, i + 1, bounds) if w.word(i + 1) else None


def _rust_impl(w: Walk, i: int):
    if w.in_body() and not w.t[i].first:
        return None
    a = w.angles(i + 1)
    body = a
    while body < len(w.t) and not w.is_(body, "{", ";"):
        body = w.close(body) + 1 if w.t[body].kind == "o" and w.t[body].text in "([" else body + 1
    if not w.is_(body, "{"):
        return None
    split = next((k for k in range(a, body) if w.is_(k, "for") and not w.is_(k + 1, "<")), None)
    where = next((k for k in range(a, body) if w.is_(k, "where")), body)

    def last_name(x, z):
        got = None
        while x < z:
            if w.is_(x, "<"):
                break
            got = w.t[x].text if w.t[x].kind == "w" and w.t[x].text not in ("dyn", "mut") else got
            x += 1
        return got

    name = last_name(split + 1 if split else a, where)
    if split and name and last_name(a, split):
        w.late.append(("implements", name, (last_name(a, split), a)))
    w.push("impl", name or "", None, w.close(body) + 1)
    return body + 1


def _rust_value(w: Walk, i: int):
    k = i + 1 + w.is_(i + 1, "mut")
    if not w.word(k) or not w.is_(k + 1, ":"):
        return None
    end = w.until(k, ";")
    w.node("variable", w.t[k].text, w.first_of(i), end, signature=w.src(k + 1, end).strip() or None)
    return k + 1


def _rust_use(w: Walk, i: int):
    end = w.until(i, ";")
    k = i + 1 + w.is_(i + 1, "::")
    last = w.t[end - 1].text if end > i else ""
    if w.word(k) and not (last == "*") and not (w.is_(k + 1, "as")):
        w.import_(w.t[k].text, w.first_of(i), end + 1)
    return end + 1


def _named_alias(w: Walk, i: int):
    if not w.word(i + 1) or not (w.is_(w.angles(i + 2), "=", ";") or w.lang == "scala" and w.is_(w.angles(i + 2), "=", "<")):
        return None
    end = w.until(i, ";") if w.lang in ("rust", "typescript") else w.line_end(i)
    w.node("type_alias", w.t[i + 1].text, w.first_of(i), end if w.is_(end, ";") else end - 1, exported=w.exported(i, "type_alias", ""))
    return i + 2


def _mod(w: Walk, i: int):
    if w.word(i + 1) and w.is_(i + 2, "{"):
        w.push("mod", w.t[i + 1].text, None, w.close(i + 2) + 1)
        return i + 3
    return None


def _ts_heritage(w: Walk):
    def read(a, b, source):
        for edge in ("extends", "implements"):
            k = next((k for k in range(a, b) if w.is_(k, edge)), None)
            if k is not None:
                other = next((m for m in range(k + 1, b) if w.is_(m, "implements", "extends")), b)
                w.parents(k + 1, other, edge, source)
    return read


def _ts_class(w: Walk, i: int):
    return w.type_("class", i, i + 1, _ts_heritage(w)) if w.word(i + 1) and not w.is_(i + 1, "extends") else None


def _ts_function(w: Walk, i: int):
    k = i + 1 + w.is_(i + 1, "*")
    return w.callable(i, k) if w.word(k) else None


def _ts_import(w: Walk, i: int):
    if w.is_(i + 1, "(", ".") or not w.t[i].first:
        return None
    end = w.until(i, ";")
    for k in range(i + 1, len(w.t)):
        if w.t[k].kind == "s":
            end = k + 1 + w.is_(k + 1, ";")
            w.import_(w.t[k].text.strip("\"'`"), i, end)
            return end
        if w.t[k].first and w.is_(k, "import", "export", "const", "function", "class"):
            break
    return end


def _ts_member(w: Walk, i: int):
    """Methods and fields directly in the body of a class."""
    s = w.scopes[-1] if w.scopes else None
    if s is None or s.kind != "class" or w.is_(i - 1, ".", "@", "new", "=", "(", ","):
        return None
    name, k = w.t[i].text, i + 1
    if name in MODIFIERS["typescript"] and (w.word(k) or w.is_(k, "[", "#", "*")) and not w.t[k].first:
        return None
    k += w.is_(k, "?", "!")
    if w.is_(w.angles(k), "("):
        nxt = w.callable(i, i, kind="method")
        return nxt
    if w.is_(k, ":", "=", ";") or (k < len(w.t) and w.t[k].first):
        first = w.first_of(i)
        end = k
        while end < s.end - 1 and not w.is_(end, ";"):
            if end > k and w.t[end].first and not w.is_(end, ".", "|", "&", "?", ":", "+"):
                break
            end = w.close(end) + 1 if w.t[end].kind == "o" and w.t[end].text in OPEN else end + 1
        n = w.node("method", name, first, end - 1)
        if w.is_(k, ":"):
            eq = next((m for m in range(k, end) if w.is_(m, "=")), end)
            w.type_refs([(k + 1, eq)], "references", n)
            steps = w.type_step(w.bare(k + 1, eq))
            if steps:
                w.members.setdefault(s.name, {})[name] = steps
        eq = next((m for m in range(k, end) if w.is_(m, "=")), None)
        return eq + 1 if eq is not None else end
    return None


def _go_func(w: Walk, i: int):
    if w.scopes and w.in_body():
        return None
    if w.is_(i + 1, "("):
        close = w.close(i + 1)
        recv = next((w.t[k].text for k in range(close - 1, i + 1, -1) if w.t[k].kind == "w" and not w.is_(k + 1, "]")), None)
        if not w.word(close + 1) or not recv:
            return None
        return w.callable(i, close + 1, kind="method", qualified=f"{recv}::{w.t[close + 1].text}", receiver=recv)
    return w.callable(i, i + 1, kind="function") if w.word(i + 1) else None


def _go_group(w: Walk, i: int, one):
    if w.in_body():
        return None
    if w.is_(i + 1, "("):
        end, k = w.close(i + 1), i + 2
        while k < end:
            k = max(one(w, k), k + 1)
        return end + 1
    return one(w, i + 1)


def _go_type(w: Walk, i: int):
    def one(w, k):
        if not w.word(k) or w.is_(k + 1, "="):
            return w.line_end(k)
        name, g = w.t[k].text, k + 1
        if w.is_(g, "[") and w.word(g + 1) and not w.is_(w.close(g) + 1, "="):
            g = w.close(g) + 1 if w.word(g + 2) else g
        kind = {"struct": "struct", "interface": "interface"}.get(w.t[g].text if g < len(w.t) else "", "type_alias")
        last = w.close(g + 1) if kind != "type_alias" and w.is_(g + 1, "{") else w.line_end(g) - 1
        n = w.node(kind, name, k, last, exported=name[:1].isupper(), doc=False)
        text = w.doc(i) if k == i + 1 else w.doc(k)
        w.rows[-1] = tuple(text if c == "docstring" else v for c, v in zip(COLUMNS, w.rows[-1]))
        if kind != "type_alias":
            m = g + 2
            while m < last:
                e = w.line_end(m)
                e = min(e, last)
                x = m + w.is_(m, "*")
                ids = [y for y in range(x, e) if w.t[y].kind == "w"]
                whole = e - x
                if ids and (whole == 1 or whole == 3 and w.is_(x + 1, ".") or w.is_(x + 1, "[") and w.close(x + 1) == e - 1 and kind == "struct" and False):
                    w.site("extends", w.t[ids[-1]].text, ids[-1], source=n)
                m = max(e, m + 1)
        return last + 1
    return _go_group(w, i, one)


def _go_value(kind):
    def rule(w: Walk, i: int):
        def one(w, k):
            if not w.word(k):
                return w.line_end(k)
            end = w.line_end(k)
            eq = next((m for m in range(k, end) if w.is_(m, "=")), None)
            w.node(kind, w.t[k].text, k, end - 1, signature=f"= {w.src(eq + 1, end).strip()}" if eq is not None and eq + 1 < end else None)
            return end
        return _go_group(w, i, one)
    return rule


def _go_import(w: Walk, i: int):
    def one(w, k):
        end = w.line_end(k)
        s = next((m for m in range(k, end) if w.t[m].kind == "s"), None)
        if s is not None:
            w.import_(w.t[s].text.strip('"`'), k, s + 1)
        return end
    return _go_group(w, i, one)


def _include(w: Walk, i: int):
    if not w.is_(i + 1, "include", "import"):
        line = w.t[i].line
        k = i
        while k < len(w.t) and w.t[k].line == line and not (w.is_(k, "\\")):
            k += 1
        return k
    line = w.t[i].line
    begin = w.text.rfind("\n", 0, w.t[i].at) + 1
    end = w.text.find("\n", w.t[i].at)
    m = re.search(r'[<"]([^>"\n]+)[>"]', w.text[begin : end if end >= 0 else len(w.text)])
    k = i
    while k < len(w.t) and w.t[k].line == line:
        k += 1
    if m:
        w.import_(m.group(1), i, k)
    return k


def _c_typedef(w: Walk, i: int):
    end = w.until(i, ";")
    names = [k for k in range(i, end) if w.t[k].kind == "w"]
    ptr = next((k for k in range(i, end - 1) if w.is_(k, "(") and w.is_(k + 1, "*") and w.word(k + 2)), None)
    at = ptr + 2 if ptr is not None else (names[-1] if names and names[-1] > i + 1 else None)
    if at is not None:
        w.node("type_alias", w.t[at].text, i, end)
    return i + 1


def _cpp_using(w: Walk, i: int):
    if w.word(i + 1) and w.is_(i + 2, "="):
        end = w.until(i, ";")
        w.node("type_alias", w.t[i + 1].text, i, end)
        return end + 1
    return w.until(i, ";") + 1


def _c_type(kind):
    def bases(w):
        def read(a, b, source):
            k = next((k for k in range(a, b) if w.is_(k, ":")), None)
            if k is not None and w.lang == "cpp":
                w.parents(k + 1, b, "extends", source)
        return read

    def rule(w: Walk, i: int):
        k = i + 1
        if kind == "enum" and w.is_(k, "class", "struct"):
            k += 1
        if not w.word(k) or w.is_(i - 1, "enum", "<", ","):
            return None
        b = w.angles(k + 1)
        while b < len(w.t) and (w.t[b].kind == "w" or w.is_(b, ":", ",", "::", "<", ">")):
            b += 1
        if not w.is_(b, "{"):
            return None
        return w.type_(kind, i, k, bases(w) if kind != "enum" else None, first=i, need_body=True)
    return rule


def _transparent(w: Walk, i: int):
    """A namespace or a block of linkage: its content counts as if it stood outside."""
    k = i + 1
    while w.word(k) or w.is_(k, "::", ".") or (k < len(w.t) and w.t[k].kind == "s"):
        k += 1
    return k + 1 if w.is_(k, "{", ";") else None


def _c_function(w: Walk, i: int):
    """A function's definition: a name before parameters and a body, after a type."""
    if w.in_body() or w.t[i].text in NO_CALL or not w.is_(i + 1, "(") or w.is_(i - 1, ".", "->", "=", "(", ",", "return", "new", "#"):
        return None
    close = w.close(i + 1)
    k = close + 1
    while w.is_(k, "const", "noexcept", "override", "final", "&", "&&") or (w.is_(k, "throw") and w.is_(k + 1, "(")):
        k = w.close(k + 1) + 1 if w.is_(k + 1, "(") else k + 1
    if w.is_(k, "->"):
        while k < len(w.t) and not w.is_(k, "{", ";"):
            k += 1
    if w.is_(k, ":") and w.lang == "cpp":
        while k < len(w.t) and not (w.is_(k, "{") and (w.is_(k - 1, ")", "}"))) and not w.is_(k, ";"):
            k = w.close(k) + 1 if w.is_(k, "(") or (w.is_(k, "{") and w.word(k - 1)) else k + 1
    if not w.is_(k, "{"):
        return None
    head = i
    while w.is_(head - 1, "::", "~"):
        head -= 2 if w.is_(head - 1, "::") else 1
    first = head
    while first > 0 and (w.t[first - 1].kind == "w" and w.t[first - 1].text not in ("else", "public", "private", "protected") or w.is_(first - 1, "*", "&", "::", ">", "<", ",")) and not w.is_(first - 1, ";", "}", "{"):
        if w.t[first - 1].line in w.directives:
            break
        if w.is_(first - 1, ",") and not any(w.is_(m, ">") for m in range(first, head)):
            break
        first -= 1
    if first == head and head == i and w.lang == "c":
        return None
    name = w.t[i].text
    q = w.src(head, i + 1).replace(" ", "") if head < i else None
    n = w.node("method" if q and "::" in q else "function", name, first, w.close(k), qualified=q if q and "::" in q else name)
    w.push("function", name, n, w.close(k) + 1)
    return k + 1


def _j_type(kind):
    def heritage(w):
        def read(a, b, source):
            if w.lang == "csharp":
                k = next((k for k in range(a, b) if w.is_(k, ":")), None)
                if k is not None:
                    w.parents(k + 1, next((m for m in range(k, b) if w.is_(m, "where")), b), "inherits", source)
                return
            for word, edge in (("extends", "extends"), ("implements", "implements")):
                k = next((k for k in range(a, b) if w.is_(k, word)), None)
                if k is not None and (kind in ("class", "enum") or word == "extends"):
                    other = next((m for m in range(k + 1, b) if w.is_(m, "extends", "implements", "permits")), b)
                    if kind == "class" or kind == "interface":
                        w.parents(k + 1, other, edge, source)
        return read

    def rule(w: Walk, i: int):
        if not w.word(i + 1) or w.is_(i - 1, ".", ":", ",", "<"):
            return None
        return w.type_(kind, i, i + 1, heritage(w))
    return rule


def _java_package(w: Walk, i: int):
    end = w.until(i, ";")
    name = w.src(i + 1, end).replace(" ", "")
    n = w.node("namespace", name, i, end)
    w.package = name
    w.push("namespace", name, n, len(w.t) + 1)
    return end + 1


def _dotted_import(w: Walk, i: int):
    end = w.until(i, ";") if w.lang in ("java", "csharp", "php") else w.line_end(i)
    if w.lang == "csharp" and (w.in_body() or w.is_(i + 1, "(", "var", "await")):
        return None
    k = i + 1
    while w.is_(k, "static", "function", "const", "typealias", "class", "struct", "func"):
        k += 1
    stop = next((m for m in range(k, end) if w.is_(m, "as", "{", "=>", ",")), end)
    if w.lang == "csharp" and any(w.is_(m, "=") for m in range(k, end)):
        k = next(m for m in range(k, end) if w.is_(m, "=")) + 1
    name = w.src(k, stop).strip().rstrip(".\\").lstrip("\\")
    name = name[:-2] if name.endswith(".*") else name
    if w.lang == "scala":
        name = name.split(".")[0]
    w.import_(name, i, end + 1 if w.is_(end, ";") else end)
    return end


def _j_member(w: Walk, i: int):
    """Methods, constructors, fields and properties directly in the body of a type."""
    s = w.scopes[-1] if w.scopes else None
    if s is None or s.kind not in ("class", "interface", "struct", "enum") or w.t[i].text in NO_CALL or w.is_(i - 1, ".", "@", "=", "new", "("):
        return None
    name, lang = w.t[i].text, w.lang
    g = w.angles(i + 1) if lang == "csharp" else i + 1
    mods = MODIFIERS[lang]
    if name in mods:
        return None
    if w.is_(g, "("):
        close = w.close(g)
        k = close + 1
        if lang == "java" and w.is_(k, "throws"):
            k = w.until(k, "{", ";")
        if lang == "csharp" and w.is_(k, ":"):
            k = w.until(k, "{", ";", "=>")
        if lang == "csharp" and w.is_(k, "where"):
            k = w.until(k, "{", ";", "=>")
        if not w.is_(k, "{", ";", "=>"):
            return None
        a = i
        while a > 0 and (w.t[a - 1].kind == "w" and w.t[a - 1].text not in mods and not w.is_(a - 2, "@") or w.is_(a - 1, ">", "<", "[", "]", ".", "?", ",") and not (w.is_(a - 1, ",") and not any(w.is_(m, ">") for m in range(a, i)))) and not w.is_(a - 1, ";", "{", "}"):
            a -= 1
        has_type = a < i
        if not has_type and name != s.name:
            return None
        first = w.first_of(a)
        last = w.close(k) if w.is_(k, "{") else (w.until(k, ";") if w.is_(k, "=>") else k)
        params = w.src(g, close + 1)
        sig = None
        if lang == "java":
            ty = a
            while w.is_(ty, "<"):
                ty = w.angles(ty)
            sig = f"{w.src(ty, i).strip()} {params}" if has_type else params
        n = w.node("method", name, first, last, signature=sig, mods={x.text for x in w.t[first:a]})
        given = w.parameters(g, close)
        w.type_refs(([(a, i)] if has_type else []) + [(x, z) for _, x, z in given] if lang == "csharp" else [(x, z) for _, x, z in given] + ([(a, i)] if has_type else []), "strict" if lang == "java" else "references", n)
        w.push("method", name, n, last + 1)
        for x, p, z in given:
            w.learn(x, w.type_step(w.bare(p, z)))
        return k + 1
    k = i + 1
    if lang == "csharp" and w.is_(k, "{", "=>") and (w.t[i - 1].kind == "w" or w.is_(i - 1, ">", "]", "?")) and w.t[i - 1].text not in ("class", "struct", "interface", "enum", "namespace"):
        kind = "property"
    elif w.is_(k, "=", ";", ",") and (w.t[i - 1].kind == "w" or w.is_(i - 1, ">", "]", "?")) and s.kind in ("class", "struct", "interface", "enum"):
        kind = "field"
    else:
        return None
    a = i
    while a > 0 and (w.t[a - 1].kind == "w" and w.t[a - 1].text not in mods or w.is_(a - 1, ">", "<", "[", "]", ".", "?")) and not w.is_(a - 1, ";", "{", "}"):
        a -= 1
    if a == i:
        return None
    first = w.first_of(a)
    end = w.until(k, ";") if not w.is_(k, "{") else w.close(k)
    if w.is_(k, "{") and w.is_(end + 1, "="):
        end = w.until(end + 1, ";")
    w.node(kind, name, first, end, signature=f"{w.src(a, i).strip()} {name}", mods={x.text for x in w.t[first:a]})
    steps = w.type_step(w.bare(a, i))
    if steps:
        w.members.setdefault(s.name, {})[name] = steps
    return k + 1 if kind == "field" else k


def _kt_class(w: Walk, i: int):
    if not w.word(i + 1) or w.is_(i - 1, "::"):
        return None
    word = w.t[i].text
    kind = "interface" if word == "interface" else "enum" if w.is_(i - 1, "enum") or (w.is_(i - 2, "enum") and w.t[i - 1].kind == "w") else "class"

    def heritage(a, b, source):
        k = a
        while k < b and not w.is_(k, ":"):
            k = w.close(k) + 1 if w.is_(k, "(") else k + 1
        while k < b:
            k += 1
            name = k
            while w.is_(name + 1, ".") and w.word(name + 2):
                name += 2
            if not w.word(name):
                break
            g = w.angles(name + 1)
            w.site("extends" if w.is_(g, "(") else "implements", w.t[name].text, name, source=source)
            k = w.until(g, ",", "{")
            if not w.is_(k, ","):
                break
    return w.type_(kind, i, i + 1, heritage)


def _kt_fun(w: Walk, i: int):
    k = w.angles(i + 1)
    start = k
    while w.word(k) and (w.is_(w.angles(k + 1), ".")):
        k = w.angles(k + 1) + 1
    if not w.word(k):
        return None
    if w.in_body():
        return None
    if k > start:
        recv = w.t[start].text
        name = w.t[k].text
        return w.callable(i, k, kind="method", qualified="::".join([*w.prefix(), recv, name]))
    return w.callable(i, k)


def _kt_package(w: Walk, i: int):
    end = w.line_end(i)
    name = w.src(i + 1, end).strip()
    n = w.node("namespace", name, i, end - 1)
    w.push("namespace", name, n, len(w.t) + 1)
    return end


def _php_type(kind):
    def rule(w: Walk, i: int):
        if not w.word(i + 1) or w.is_(i - 1, "::", "new"):
            return None
        return w.type_(kind, i, i + 1, _ts_heritage(w))
    return rule


def _php_function(w: Walk, i: int):
    k = i + 1 + w.is_(i + 1, "&")
    if not w.word(k) or w.in_body():
        return None
    return w.callable(i, k)


def _php_use(w: Walk, i: int):
    s = w.scopes[-1] if w.scopes else None
    if s is not None and s.kind in ("class", "trait", "enum"):
        end = w.until(i, ";", "{")
        w.parents(i + 1, end, "implements", s.id, at=i)
        return end
    if w.in_body() or w.is_(i + 1, "("):
        return None
    return _dotted_import(w, i)


def _php_const(w: Walk, i: int):
    if w.in_body() or not w.word(i + 1):
        return None
    end = w.until(i, ";")
    eq = next((k for k in range(i + 1, end) if w.is_(k, "=")), None)
    if eq is not None and w.word(eq - 1):
        w.node("constant", w.t[eq - 1].text, eq - 1, end - 1, mods=())
    return end


def _php_field(w: Walk, i: int):
    s = w.scopes[-1] if w.scopes else None
    if s is None or s.kind not in ("class", "trait") or not w.t[i].text.startswith("$"):
        return None
    first = w.first_of(i)
    a = i
    while w.t[a - 1].kind == "w" and w.t[a - 1].text not in MODIFIERS["php"] or w.is_(a - 1, "?", "|", "\\"):
        a -= 1
    if a < i:
        first = w.first_of(a)
    name = w.t[i].text[1:]
    ty = w.src(a, i).strip()
    w.node("field", name, i, w.until(i, ";", "=") - 1, signature=f"{ty} ${name}" if ty else f"${name}", mods={x.text for x in w.t[first:a]})
    return w.until(i, ";")


def _case_members(w: Walk, i: int):
    s = w.scopes[-1] if w.scopes else None
    if s is None or s.kind != "enum" or not w.word(i + 1) or w.is_(i + 1, "class", "object"):
        return None
    end = w.until(i, ";") if w.lang == "php" else w.line_end(i)
    k = i + 1
    while k < end:
        if w.word(k):
            e = w.until(k, ",", ";") if w.lang != "php" else end
            w.node("enum_member", w.t[k].text, i if w.lang != "scala" else k, min(e, end) - 1, mods=())
            k = min(e, end)
        k += 1
    return end


def _scala_type(kind):
    def rule(w: Walk, i: int):
        if not w.word(i + 1):
            return None

        def heritage(a, b, source):
            k = next((k for k in range(a, b) if w.is_(k, "extends")), None)
            if k is not None and w.word(k + 1):
                name = k + 1
                while w.is_(name + 1, ".") and w.word(name + 2):
                    name += 2
                w.site("extends", w.t[name].text, name, source=source)
        return w.type_(kind, i, i + 1, heritage)
    return rule


def _scala_value(w: Walk, i: int):
    if w.in_body() or not w.word(i + 1) or w.is_(i - 1, "(", ","):
        return None
    c = w.container()
    word, name = w.t[i].text, w.t[i + 1].text
    end = w.line_end(i)
    ty = None
    if w.is_(i + 2, ":"):
        eq = next((k for k in range(i + 3, end) if w.is_(k, "=")), end)
        ty = w.src(i + 3, eq).strip()
    w.node("field" if c else "constant" if word == "val" else "variable", name, w.first_of(i), end - 1, signature=f"{word} {name}: {ty}" if ty else None)
    return i + 2


def _scala_def(w: Walk, i: int):
    return w.callable(i, i + 1) if w.word(i + 1) and not w.in_body() else None


def _swift_type(w: Walk, i: int):
    word = w.t[i].text
    if not w.word(i + 1) or w.is_(i + 1, "func", "var", "let"):
        return None

    def heritage(a, b, source):
        if w.is_(a, ":"):
            w.parents(a + 1, next((k for k in range(a, b) if w.is_(k, "where")), b), "inherits", source)
    return w.type_({"protocol": "interface", "actor": "class"}.get(word, word), i, i + 1, heritage)


def _swift_func(w: Walk, i: int):
    if not w.word(i + 1) or w.in_body():
        return None
    return w.callable(i, i + 1)


RULES = {
    "rust": {"fn": _rust_fn, "struct": _rust_struct, "enum": lambda w, i: w.type_("enum", i, i + 1, None), "trait": _rust_trait, "impl": _rust_impl, "type": _named_alias, "const": _rust_value, "static": _rust_value, "use": _rust_use, "mod": _mod},
    "typescript": {"class": _ts_class, "interface": lambda w, i: w.type_("interface", i, i + 1, None) if w.word(i + 1) and w.t[i].kind == "w" and not w.in_body() else None, "enum": lambda w, i: w.type_("enum", i, i + 1, None) if w.word(i + 1) else None,
                   "function": _ts_function, "type": _named_alias, "import": _ts_import, "": _ts_member},
    "go": {"func": _go_func, "type": _go_type, "const": _go_value("constant"), "var": _go_value("variable"), "import": _go_import},
    "c": {"#": _include, "typedef": _c_typedef, "struct": _c_type("struct"), "enum": _c_type("enum"), "extern": _transparent, "": _c_function},
    "cpp": {"#": _include, "typedef": _c_typedef, "using": _cpp_using, "struct": _c_type("struct"), "class": _c_type("class"), "enum": _c_type("enum"), "namespace": _transparent, "extern": _transparent, "": _c_function},
    "java": {"package": _java_package, "import": _dotted_import, "class": _j_type("class"), "interface": _j_type("interface"), "enum": _j_type("enum"), "record": lambda w, i: _j_type("class")(w, i) if w.is_(w.angles(i + 2), "(") and not w.in_body() else None, "": _j_member},
    "csharp": {"namespace": _transparent, "using": _dotted_import, "class": _j_type("class"), "interface": _j_type("interface"), "struct": _j_type("struct"), "enum": _j_type("enum"), "record": lambda w, i: _j_type("class")(w, i) if w.word(i + 1) and not w.in_body() else None, "": _j_member},
    "kotlin": {"package": _kt_package, "import": _dotted_import, "class": _kt_class, "interface": _kt_class, "object": _kt_class, "fun": _kt_fun, "typealias": _named_alias},
    "php": {"class": _php_type("class"), "interface": _php_type("interface"), "trait": _php_type("trait"), "enum": _php_type("enum"), "function": _php_function, "use": _php_use, "const": _php_const, "case": _case_members, "": _php_field},
    "scala": {"import": _dotted_import, "class": _scala_type("class"), "object": _scala_type("class"), "trait": _scala_type("trait"), "enum": _scala_type("enum"), "def": _scala_def, "val": _scala_value, "var": _scala_value, "type": _named_alias, "case": _case_members},
    "swift": {"import": _dotted_import, "class": _swift_type, "struct": _swift_type, "enum": _swift_type, "protocol": _swift_type, "actor": _swift_type, "func": _swift_func, "typealias": _named_alias, "case": _case_members},
    "ruby": {},
}
RULES["javascript"] = RULES["typescript"]


# ---- Python


class _Python(ast.NodeVisitor):
    def __init__(self, path: str, source: str):
        self.path, self.rows = path, []
        self.lines = source.split("\n")
        self.scope: list[str] = []
        self.kinds: list[str] = []
        self.owners = [f"file:{path}"]
        self.known: list[dict[str, list]] = [{}]
        self.members: dict[str, dict[str, list]] = {}

    def _col(self, line: int, col: int) -> int:
        """Columns count characters; the tree counts bytes."""
        text = self.lines[line - 1] if line <= len(self.lines) else ""
        return col if text.isascii() else len(text.encode("utf-8", "surrogatepass")[:col].decode("utf-8", "replace"))

    def node(self, n, kind: str, name: str, **more) -> str:
        q = "::".join([*self.scope, name])
        col = self._col(n.lineno, n.col_offset)
        i = node_id(kind, q, self.path, n.lineno, col)
        doc = ast.get_docstring(n) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
        deco = ["@" + ast.unparse(d) for d in getattr(n, "decorator_list", [])]
        params = [ast.unparse(p) for p in getattr(n, "type_params", [])]
        self.rows.append(
            row(
                row="node", path=self.path, language="python", id=i, kind=kind, name=name, qualified_name=q, start_line=n.lineno, end_line=n.end_lineno, start_column=col, end_column=n.end_col_offset,
                docstring=doc, is_exported=False, is_async=isinstance(n, ast.AsyncFunctionDef), is_static=False, is_abstract=False, decorators=json.dumps(deco) if deco else None,
                type_parameters=json.dumps(params) if params else None, parent=self.owners[-1], **more,
            )
        )
        return i

    def site(self, ref: str, name: str, n, source: str | None = None, **more) -> None:
        self.rows.append(row(row="site", path=self.path, language="python", id=source or self.owners[-1], name=name, ref_kind=ref, line=n.lineno, col=self._col(n.lineno, n.col_offset), **more))

    def _inside(self, n, i: str, name: str, kind: str) -> None:
        self.owners.append(i)
        self.kinds.append(kind)
        if kind == "class":
            self.scope.append(name)
        for x in n.body:
            self.visit(x)
        if kind == "class":
            self.scope.pop()
        self.kinds.pop()
        self.owners.pop()

    def _type(self, a) -> list | None:
        if isinstance(a, ast.Constant) and isinstance(a.value, str):
            m = re.fullmatch(r"[\w.]+", a.value)
            return [{"op": "type", "name": a.value.rsplit(".", 1)[-1]}] if m else None
        if isinstance(a, ast.Name):
            return [{"op": "type", "name": a.id}]
        return [{"op": "type", "name": a.attr}] if isinstance(a, ast.Attribute) else None

    def chain(self, n) -> list | None:
        while isinstance(n, ast.Await):
            n = n.value
        if isinstance(n, ast.Name):
            if n.id in ("self", "cls"):
                return [{"op": "type", "name": self.scope[-1]}] if self.scope else None
            return self.known[-1].get(n.id)
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self" and self.scope:
            return self.members.get(self.scope[-1], {}).get(n.attr)
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                return [{"op": "bare", "name": f.id}]
            if isinstance(f, ast.Attribute):
                inner = self.chain(f.value)
                if inner:
                    return [*inner, {"op": "method", "name": f.attr}]
                if isinstance(f.value, ast.Name) and f.value.id[:1].isupper():
                    return [{"op": "qualified", "qualifier": f.value.id, "name": f.attr}]
        return None

    def _function(self, n) -> None:
        kind = "method" if "class" in self.kinds else "function"
        sig = f"({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
        for d in n.decorator_list:
            self.visit(d)
        i = self.node(n, kind, n.name, signature=sig)
        known = {}
        for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]:
            t = self._type(a.annotation) if a.annotation else None
            if t:
                known[a.arg] = t
        self.known.append(known)
        for d in [*n.args.defaults, *n.args.kw_defaults]:
            if d is not None:
                self.visit(d)
        self._inside(n, i, n.name, kind)
        self.known.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, n) -> None:
        i = self.node(n, "class", n.name)
        for b in n.bases:
            if isinstance(b, (ast.Name, ast.Attribute)):
                self.site("extends", ast.unparse(b), b, source=i)
        held = self.members.setdefault(n.name, {})
        for x in ast.walk(n):
            if isinstance(x, ast.AnnAssign):
                t = self._type(x.annotation)
                if t and isinstance(x.target, ast.Attribute) and isinstance(x.target.value, ast.Name) and x.target.value.id == "self":
                    held[x.target.attr] = t
                elif t and isinstance(x.target, ast.Name) and x in n.body:
                    held[x.target.id] = t
        for f in n.body:
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                given = {a.arg: self._type(a.annotation) for a in f.args.args if a.annotation}
                for x in ast.walk(f):
                    if isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Attribute) and isinstance(x.targets[0].value, ast.Name) and x.targets[0].value.id == "self":
                        v, t = x.value, None
                        if isinstance(v, ast.Name):
                            t = given.get(v.id)
                        elif isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id[:1].isupper():
                            t = [{"op": "type", "name": v.func.id}]
                        if t:
                            held.setdefault(x.targets[0].attr, t)
        for d in [*n.decorator_list, *n.keywords]:
            self.visit(d.value if isinstance(d, ast.keyword) else d)
        self._inside(n, i, n.name, "class")

    def _import(self, n, module: str) -> None:
        if any(k in ("function", "method") for k in self.kinds) or module == "__future__":
            return
        i = self.node(n, "import", module, signature="\n".join(self.lines[n.lineno - 1 : n.end_lineno]).strip())
        # ``import x`` names a module but is no link to its node.
        self.site("imports", module, n, source=f"file:{self.path}", qualifier=i if isinstance(n, ast.ImportFrom) else None)

    def visit_Import(self, n) -> None:
        self._import(n, n.names[0].name)

    def visit_ImportFrom(self, n) -> None:
        self._import(n, "." * n.level + (n.module or ""))

    def visit_TypeAlias(self, n) -> None:
        self.node(n, "type_alias", n.name.id)

    def visit_Call(self, n) -> None:
        f = n.func
        if isinstance(f, ast.Name):
            self.site("calls", f.id, n)
        elif isinstance(f, ast.Attribute):
            steps = self.chain(f.value)
            if steps:
                self.site("method", f.attr, n, chain=json.dumps(steps))
        self.generic_visit(n)

    def visit_Assign(self, n) -> None:
        if not self.kinds and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            self.node(n, "variable", n.targets[0].id, signature="= " + ast.unparse(n.value))
        elif len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            t = self.chain(n.value)
            if t:
                self.known[-1][n.targets[0].id] = t
            else:
                self.known[-1].pop(n.targets[0].id, None)
        self.generic_visit(n)

    def visit_AnnAssign(self, n) -> None:
        if isinstance(n.target, ast.Name):
            if not self.kinds:
                self.node(n, "variable", n.target.id, signature=f": {ast.unparse(n.annotation)}" + (f" = {ast.unparse(n.value)}" if n.value else ""))
            else:
                t = self._type(n.annotation)
                if t:
                    self.known[-1][n.target.id] = t
        self.generic_visit(n)

    def _for(self, n) -> None:
        if isinstance(n.target, ast.Name):
            t = self.chain(n.iter)
            if t and t[-1]["op"] != "type":
                self.known[-1][n.target.id] = [*t, {"op": "element"}]
        self.generic_visit(n)

    visit_For = visit_AsyncFor = _for


_PY_DEF = re.compile(r"^([ \t]*)(async[ \t]+def|def|class)[ \t]+([^\W\d]\w*)")
_PY_IMPORT = re.compile(r"^(?:from[ \t]+([.\w]+)[ \t]+import\b|import[ \t]+([.\w]+))")


def _python_lines(path: str, source: str) -> list[tuple]:
    """Definitions and imports of a Python text that does not parse, by line and indent."""
    lines = source.split("\n")
    rows: list[dict] = []
    open_: list[tuple[int, dict]] = []

    def close(indent: int, last: int) -> None:
        while open_ and open_[-1][0] >= indent:
            row_ = open_.pop()[1]
            while last > row_["start_line"] and not lines[last - 1].strip():
                last -= 1
            row_["end_line"], row_["end_column"] = last, len(lines[last - 1])

    for n, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        close(indent, n - 1)
        m, i = _PY_DEF.match(line), _PY_IMPORT.match(line)
        if m:
            inside = [r for _, r in open_ if r["kind"] == "class"]
            kind = "class" if m.group(2) == "class" else "method" if inside else "function"
            q = "::".join([*(r["name"] for r in inside), m.group(3)])
            row_ = dict(row="node", path=path, language="python", id=node_id(kind, q, path, n, indent), kind=kind, name=m.group(3), qualified_name=q, start_line=n, start_column=indent, parent=open_[-1][1]["id"] if open_ else f"file:{path}", is_exported=False, is_async=m.group(2).startswith("async"), is_static=False, is_abstract=False)
            rows.append(row_)
            open_.append((indent, row_))
        elif i and (i.group(1) or i.group(2)) != "__future__":
            name = i.group(1) or i.group(2)
            rows.append(dict(row="node", path=path, language="python", id=node_id("import", name, path, n, 0), kind="import", name=name, qualified_name=name, start_line=n, end_line=n, start_column=0, end_column=len(line), signature=line.strip(), parent=f"file:{path}", is_exported=False, is_async=False, is_static=False, is_abstract=False))
            rows.append(dict(row="site", path=path, language="python", id=f"file:{path}", name=name, ref_kind="imports", qualifier=rows[-1]["id"] if i.group(1) else None, line=n, col=0))
    close(0, len(lines))
    return [row(**r) for r in rows]


def extract(path: str, language: str, source: str) -> list[tuple]:
    """All rows of a file: its own node first, definitions, further containment, references."""
    end = source.count("\n") + 1
    out = [row(row="node", path=path, language=language, id=f"file:{path}", kind="file", name=path.rsplit("/", 1)[-1], qualified_name=path, start_line=1, end_line=end, start_column=0, end_column=0, is_exported=False, is_async=False, is_static=False, is_abstract=False)]
    if language == "python":
        try:
            v = _Python(path, source)
            v.visit(ast.parse(source))
            return out + v.rows
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return out + _python_lines(path, source)
    if language not in RULES:
        return out
    rows = Walk(path, language, source).run()
    if language == "java":
        # Top-level declarations belong to the package of the file.
        space = next((r[_AT["id"]] for r in rows if r[_AT["kind"]] == "namespace"), None)
        if space:
            rows = [tuple(space if c == "id" and r[_AT["ref_kind"]] == "imports" or c == "parent" and r[0] == "node" and v == f"file:{path}" and r[_AT["kind"]] != "namespace" else v for c, v in zip(COLUMNS, r)) for r in rows]
    return out + rows

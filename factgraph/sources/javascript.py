"""Facts of JavaScript and TypeScript files, from tokens and bracket structure.

No grammar is at hand, so this reads as much syntax as the facts need: declarations at the top level, import and export
clauses, calls, literals with what they are bound to, and whether functions return JSX.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from factgraph.functions import fixed

_SHEBANG = re.compile(r"\#![^\n]*")
_SPACE = re.compile(r"(?://[^\n]*|/\*.*?\*/)(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)
_TOKEN = re.compile(
    r"""\s*(?:(?P<id>[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<num>\d[\w.]*)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<op>=>|\?\.|\.\.\.|[=!]==?|&&|\|\||\?\?|\+\+|--|[-+*/%&|^<>]=|.)|$)""",
    re.S,
)
#: A type parameter, not an element.
_GENERIC = re.compile(r"<[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_VALUE = frozenset("return typeof case in of new delete void throw else do await yield default extends".split())
_NOT_CALLEES = frozenset("if for while switch catch function return typeof await new with constructor".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_CLOSERS = frozenset(_PAIRS.values())
#: What a pattern, not a division, may follow: a condition in parentheses, or a block in braces after these.
_CONDITIONS = frozenset("if while for with".split())
_BLOCK_WORDS = frozenset("else do try finally".split())
_MODIFIERS = frozenset("get set static async public private protected readonly override abstract declare".split())
#: In type arguments, besides names and brackets.
_TYPE_OPS = frozenset(". , | & ? : ; => ...".split())
_NAME = re.compile(r"[A-Za-z_$][\w$.\-:]*")


class Token:
    __slots__ = ("kind", "text", "start", "end", "close")

    def __init__(self, kind: str, text: str, start: int, end: int):
        self.kind, self.text, self.start, self.end, self.close = kind, text, start, end, -1

    def __repr__(self) -> str:
        return f"{self.kind}:{self.text}"


class Lexer:
    def __init__(self, source: str, jsx: bool):
        self.source, self.jsx, self.tokens = source, jsx, []
        #: Open brackets: whether a value may follow the closing one.  ``after`` is that of the last closing one.
        self.open: list[bool] = []
        self.after = False

    def value_next(self) -> bool:
        """Whether a value may stand here, so that a slash begins a pattern and a less-than begins an element."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "id":
            return t.text in _BEFORE_VALUE
        if t.kind != "op":
            return False
        return self.after if t.text in (")", "}") else t.text not in ("]", "++", "--")

    def opens(self, text: str) -> None:
        before = self.tokens[-1] if self.tokens else None
        if text == "(":
            self.open.append(before is not None and before.kind == "id" and before.text in _CONDITIONS)
        else:
            block = before is None or (before.text in _BLOCK_WORDS if before.kind == "id" else before.kind == "op" and before.text in (")", ";", "{", "}", "=>"))
            self.open.append(text == "{" and block)

    def closes(self) -> None:
        self.after = self.open.pop() if self.open else False

    def run(self, at: int = 0, until: str = "") -> int:
        """Tokens up to the closing bracket ``until``, which isn't taken; returns where that is."""
        source, depth, add = self.source, 0, self.tokens.append
        if not at and (m := _SHEBANG.match(source)):
            at = m.end()
        scan = _TOKEN.scanner(source, at).match
        while m := scan():
            kind = m.lastgroup
            if kind is None:  # only white space was left
                break
            start, at = m.span(kind)
            text = source[start:at]
            if kind == "op":
                if text in _PAIRS:
                    depth += 1
                    self.opens(text)
                elif text in _CLOSERS:
                    if until and text == until and not depth:
                        return start
                    depth -= 1
                    self.closes()
                elif text[0] in "`/<" and (end := self.special(start)):
                    scan = _TOKEN.scanner(source, end).match
                    continue
            add(Token(kind, text, start, at))
        return len(source)

    def special(self, at: int) -> int:
        """Reads a template, a comment, a pattern or an element that begins here; returns its end, or 0 if none does."""
        source, c = self.source, self.source[at]
        if c == "`":
            return self.template(at)
        if c == "/":
            if m := _SPACE.match(source, at):
                return m.end()
            if self.value_next() and (m := _REGEX.match(source, at)):
                self.tokens.append(Token("regex", m[0], at, m.end()))
                return m.end()
        elif self.jsx and self.value_next() and (source[at + 1 : at + 2] == ">" or _NAME.match(source, at + 1)) and not _GENERIC.match(source, at):
            return self.element(at)
        return 0

    def template(self, at: int) -> int:
        start, plain, source = at, True, self.source
        at += 1
        inner = []
        while at < len(source) and source[at] != "`":
            if source[at] == "\\":
                at += 2
            elif source.startswith("${", at):
                plain = False
                sub = Lexer(source, self.jsx)
                at = sub.run(at + 2, "}") + 1
                inner += sub.tokens
            else:
                at += 1
        self.tokens.append(Token("tmpl", source[start + 1 : at] if plain else "", start, at + 1))
        self.tokens += inner
        return at + 1

    def element(self, at: int) -> int:
        """A JSX element with all that is in it; names of components are references."""
        source, start = self.source, at
        mark = Token("jsx", "<", at, at)
        self.tokens.append(mark)
        depth = 0
        while at < len(source):
            if source[at] == "<":
                closing = source.startswith("</", at)
                at += 2 if closing else 1
                if m := _NAME.match(source, at):
                    if not closing and (m[0][0].isupper() or "." in m[0]):
                        self.tokens.append(Token("id", m[0].split(".")[0], at, at + len(m[0].split(".")[0])))
                    at = m.end()
                while at < len(source) and source[at] != ">":
                    if source[at] in "\"'":
                        at = source.find(source[at], at + 1) % (len(source) + 1) + 1
                    elif source[at] == "{":
                        at = self.braces(at)
                    elif source.startswith("/>", at):
                        depth -= 1
                        at += 1
                        break
                    else:
                        at += 1
                at += 1
                depth += -1 if closing else 1
                if depth <= 0:
                    break
            elif source[at] == "{":
                at = self.braces(at)
            else:
                at += 1
        mark.start, mark.end = start, at
        return at

    def braces(self, at: int) -> int:
        self.open.append(False)
        self.tokens.append(Token("op", "{", at, at + 1))
        end = self.run(at + 1, "}")
        self.closes()
        self.tokens.append(Token("op", "}", end, end + 1))
        return end + 1


def _unquote(token: Token) -> str:
    return token.text[1:-1] if token.kind == "str" else token.text


class Module:
    """Facts of one file; spans are lines from 1 and byte offsets."""

    def __init__(self, source: str, language: str):
        self.source = source
        lexer = Lexer(source, language in ("jsx", "tsx", "javascript"))
        lexer.run()
        self.tokens = lexer.tokens
        self.typed = language in ("typescript", "tsx")
        #: The bracket around each opening bracket, and the brackets that are bodies of classes and of interfaces.
        self.outer: dict[int, int] = {}
        self.members: set[int] = set()
        self.types: list[tuple[int, int]] = []
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op":
                if t.text in _PAIRS:
                    self.outer[i] = stack[-1] if stack else -1
                    stack.append(i)
                elif t.text in _CLOSERS and stack:
                    self.tokens[stack[-1]].close = i
                    t.close = stack.pop()
        for i in stack:
            self.tokens[i].close = len(self.tokens) - 1
        self.lines = [m.end() for m in re.finditer("\n", source)]
        self.ascii = source.isascii()
        self.imports, self.exports, self.symbols, self.bound = [], [], [], set()
        self.marked: set[str] = set()
        self.statements()
        for s in self.symbols:
            s["exported"] = s["exported"] or s["name"] in self.marked

    def byte(self, at: int) -> int:
        return at if self.ascii else len(self.source[:at].encode())

    def span(self, start: int, end: int) -> dict:
        return {"line": bisect_right(self.lines, start) + 1, "start": self.byte(start), "end": self.byte(end)}

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_op(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "op" and self.tokens[i].text == text

    # statements

    def begins_statement(self, i: int) -> bool:
        if i == 0:
            return True
        before = self.tokens[i - 1]
        if before.kind == "op" and before.text in (";", "}"):
            return True
        return "\n" in self.source[before.end : self.tokens[i].start] and not (before.kind == "op" and before.text not in (")", "]", "++", "--")) and before.text not in _BEFORE_VALUE

    def statements(self) -> None:
        i = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "op" and t.text in _PAIRS:
                i = t.close + 1 if t.close > i else i + 1
            elif t.kind == "id" and self.begins_statement(i):
                i = max(self.statement(i, t.start, False), i + 1)
            else:
                i += 1

    def statement(self, i: int, start: int, exported: bool) -> int:
        word, nxt = self.text(i), self.text(i + 1)
        if word == "import" and not exported and nxt not in ("(", "."):
            return self.import_statement(i)
        if word == "export":
            return self.export_statement(i)
        if word in ("declare", "abstract") and self.tokens[min(i + 1, len(self.tokens) - 1)].kind == "id":
            return self.statement(i + 1, start, exported)
        if word == "async" and nxt == "function":
            return self.function(i + 1, start, exported, True)
        if word == "function":
            return self.function(i, start, exported, False)
        if word == "class":
            return self.class_like(i, start, exported, "class")
        if word == "interface" and self.tokens[min(i + 1, len(self.tokens) - 1)].kind == "id":
            return self.class_like(i, start, exported, "interface")
        if word == "enum" or word == "const" and nxt == "enum":
            i += word == "const"
            brace = next((k for k in range(i, min(i + 4, len(self.tokens))) if self.is_op(k, "{")), i + 1)
            end = self.tokens[brace].close if self.is_op(brace, "{") else brace
            self.symbol(self.text(i + 1), "enum", start, end, exported)
            return end + 1
        if word == "type" and self.tokens[min(i + 1, len(self.tokens) - 1)].kind == "id" and self.text(i + 2) in ("=", "<"):
            end = self.end_of(i + 2)
            self.types.append((i, end))
            refs = [self.text(k) for k in range(i + 3, end + 1) if self.tokens[k].kind == "id"]
            self.symbol(nxt, "type", start, end, exported, type_refs=refs)
            return end + 1
        if word in ("const", "let", "var"):
            return self.variables(i, start, exported)
        return i + 1

    def end_of(self, i: int) -> int:
        """Last token of the statement that has token ``i``."""
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "op" and t.text == ";":
                return i
            if t.kind == "op" and t.text in _PAIRS and t.close > i:
                i = t.close
            elif t.kind == "op" and t.text in _PAIRS.values():
                return i - 1
            if i + 1 < len(self.tokens) and "\n" in self.source[self.tokens[i].end : self.tokens[i + 1].start]:
                here, following = self.tokens[i], self.tokens[i + 1]
                open_end = here.kind == "op" and here.text not in (")", "]", "}") or here.text in _BEFORE_VALUE
                goes_on = following.kind == "op" and following.text not in ("{", "}") or following.kind == "tmpl"
                if not open_end and not goes_on:
                    return i
            i += 1
        return len(self.tokens) - 1

    def add_import(self, i: int, specifier: str, kind: str, names: list[str], start: int, end: int) -> None:
        if specifier:
            self.imports.append({"specifier": specifier, "kind": kind, "names": names, **self.span(start, end)})

    def named(self, i: int, outer: bool) -> tuple[list[tuple[str, str]], int]:
        """(name, alias) of a clause in braces, and the token after it."""
        close, out, k = self.tokens[i].close, [], i + 1
        while k < close:
            if self.text(k) == "type" and self.tokens[k + 1].kind == "id" and self.text(k + 1) != "as":
                k += 1
            name = _unquote(self.tokens[k])
            if self.text(k + 1) == "as":
                out.append((name, _unquote(self.tokens[k + 2])))
                k += 3
            else:
                out.append((name, name))
                k += 1
            k += self.is_op(k, ",")
        return out, close + 1

    def import_statement(self, i: int) -> int:
        start, k, names = self.tokens[i].start, i + 1, []
        if self.text(k) == "type" and not self.is_op(k + 1, ",") and self.text(k + 1) != "from":
            k += 1
        while k < len(self.tokens) and self.tokens[k].kind != "str":
            if self.is_op(k, "{"):
                found, k = self.named(k, False)
                names += [n for n, _ in found]
            elif self.is_op(k, "*"):
                names.append("*")
                k += 3
            elif self.is_op(k, ",") or self.text(k) == "from":
                k += 1
            elif self.tokens[k].kind == "id":
                names.append("default")
                k += 1
            else:
                return k
        if k < len(self.tokens):
            end = k + self.is_op(k + 1, ";")
            self.add_import(i, _unquote(self.tokens[k]), "static", names, start, self.tokens[end].end)
        return k + 1

    def export_statement(self, i: int) -> int:
        start, k = self.tokens[i].start, i + 1
        if self.text(k) == "default":
            self.export("default", start, self.tokens[k].end)
            return self.default_export(k + 1, start)
        if self.text(k) == "type" and self.is_op(k + 1, "{"):
            k += 1
        if self.is_op(k, "{"):
            found, k = self.named(k, True)
            if self.text(k) == "from":
                end = k + 1 + self.is_op(k + 2, ";")
                self.add_import(i, _unquote(self.tokens[k + 1]), "re_export", [n for n, _ in found], start, self.tokens[min(end, len(self.tokens) - 1)].end)
                return k + 2
            for name, alias in found:
                self.export(alias, start, self.tokens[k - 1].end)
                self.marked.add(name)
            return k
        if self.is_op(k, "*"):
            while k < len(self.tokens) and self.tokens[k].kind != "str":
                k += 1
            if k < len(self.tokens):
                self.add_import(i, _unquote(self.tokens[k]), "re_export", ["*"], start, self.tokens[k].end)
            return k + 1
        n = len(self.symbols)
        end = self.statement(k, start, True)
        for s in self.symbols[n:]:
            self.exports.append({"name": s["name"], "line": s["line"], "start": s["start"], "end": s["end"]})
        return end

    def export(self, name: str, start: int, end: int) -> None:
        self.exports.append({"name": name, **self.span(start, end)})

    def default_export(self, k: int, start: int) -> int:
        is_async = self.text(k) == "async" and self.text(k + 1) == "function"
        k += is_async
        if self.text(k) == "abstract":
            k += 1
        if self.text(k) == "function":
            return self.function(k, start, True, is_async, "default")
        if self.text(k) == "class":
            return self.class_like(k, start, True, "class", "default")
        end = self.end_of(k)
        arrow = self.arrow(k)
        if arrow:
            self.symbol("default", "function", start, end, True, **arrow)
        else:
            self.symbol("default", "unknown", start, end, True)
            if self.tokens[min(k, len(self.tokens) - 1)].kind == "id":
                self.marked.add(self.text(k))
        return end + 1

    # declarations

    def symbol(self, name: str, kind: str, start: int, end: int, exported: bool, **more) -> None:
        end = min(end, len(self.tokens) - 1)
        row = {"name": name, "kind": kind, "exported": exported, "params": None, "is_async": None, "returns_jsx": None, "body_start": None, "body_end": None, "body_lines": None, "extends": None, "type_refs": None}
        self.symbols.append(row | self.span(start, self.tokens[end].end) | more)

    def params(self, i: int) -> list[str]:
        out, k, close = [], i + 1, self.tokens[i].close
        while k < close:
            t = self.tokens[k]
            out.append("{}" if t.text == "{" else "[]" if t.text == "[" else "..." if t.text == "..." else t.text)
            while k < close and not self.is_op(k, ","):
                k = self.beyond(k)
            k += 1
        return out

    def beyond(self, k: int) -> int:
        """The token after token ``k``, or after what it opens."""
        t = self.tokens[k]
        if t.kind != "op":
            return k + 1
        if t.text in _PAIRS and t.close > k:
            return t.close + 1
        if t.text == "<" and self.typed and k and self.tokens[k - 1].kind == "id":
            return self.after_type_arguments(k) or k + 1
        return k + 1

    def after_type_arguments(self, i: int) -> int | None:
        """The parenthesis that follows the type arguments from token ``i`` on; None if these aren't any."""
        depth, k = 0, i
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "op":
                if t.text == "<":
                    depth += 1
                elif t.text == ">":
                    depth -= 1
                    if not depth:
                        return k + 1 if self.is_op(k + 1, "(") else None
                elif t.text in _PAIRS and t.close > k:
                    k = t.close
                elif t.text not in _TYPE_OPS:
                    return None
            elif t.kind not in ("id", "str", "num"):
                return None
            k += 1
        return None

    def body(self, brace: int) -> dict:
        """Span and JSX returns of a body in braces."""
        close = self.tokens[brace].close
        span = self.span(self.tokens[brace].start, self.tokens[close].end)
        return {"body_start": span["start"], "body_end": span["end"], "body_lines": bisect_right(self.lines, self.tokens[close].start) + 2 - span["line"], "returns_jsx": self.returns_jsx(brace + 1, close)}

    def returns_jsx(self, k: int, end: int) -> bool:
        while k < end:
            t = self.tokens[k]
            if t.text == "function" and t.kind == "id" or self.is_op(k, "=>"):
                j = k + 1
                while j < end and not self.is_op(j, "{") and not (t.text == "=>" and j > k + 1):
                    j = self.tokens[j].close if self.is_op(j, "(") and self.tokens[j].close > j else j
                    j += 1
                    if t.text == "=>":
                        break
                if self.is_op(k + 1, "{") if t.text == "=>" else self.is_op(j, "{"):
                    k = self.tokens[k + 1 if t.text == "=>" else j].close
            elif t.kind == "id" and t.text == "return" and self.jsx_value(k + 1, end):
                return True
            k += 1
        return False

    def jsx_value(self, k: int, end: int) -> bool:
        """An element, in parentheses or in a branch of a condition."""
        while self.is_op(k, "("):
            k += 1
        depth = 0
        while k < end:
            t = self.tokens[k]
            if t.kind == "jsx":
                return True
            if t.kind == "op" and t.text in ("(", "[", "{"):
                k = t.close if t.close > k and t.text != "(" else k
                depth += t.text == "("
            elif t.kind == "op" and t.text in (";", "}"):
                return False
            elif t.kind == "op" and t.text == ")":
                depth -= 1
                if depth < 0:
                    return False
            elif self.begins_statement(k) and depth == 0 and k + 1 < end and self.source[self.tokens[k - 1].end : t.start].count("\n"):
                return False
            if self.text(k) not in ("?", ":", "&&", "||", "??", "(", "!", ".", "?.") and t.kind not in ("id", "num", "str") and not (t.kind == "op" and t.text in ("=", "===", "!==", ">", "<", ")", "[", "{", "]", "}", "==", "!=", "+", "-")):
                return False
            k += 1
        return False

    def function(self, i: int, start: int, exported: bool, is_async: bool, name: str | None = None) -> int:
        k = i + 1
        k += self.is_op(k, "*")
        own = self.text(k) if k < len(self.tokens) and self.tokens[k].kind == "id" else None
        while k < len(self.tokens) and not self.is_op(k, "("):
            k += 1
        if k >= len(self.tokens):
            return i + 1
        params, brace = self.params(k), self.tokens[k].close + 1
        while brace < len(self.tokens) and not self.is_op(brace, "{") and not self.is_op(brace, ";"):
            brace += 1
        if self.is_op(brace - 1, ":"):  # a type in braces comes first
            brace = self.tokens[brace].close + 1
        if not self.is_op(brace, "{"):
            self.symbol(name or own or "default", "function", start, brace, exported, params=params, is_async=is_async, returns_jsx=False)
            return brace + 1
        self.symbol(name or own or "default", "function", start, self.tokens[brace].close, exported, params=params, is_async=is_async, **self.body(brace))
        return self.tokens[brace].close + 1

    def arrow(self, k: int) -> dict | None:
        """Payload of a function value that begins at a token; None for other values."""
        is_async = self.text(k) == "async"
        k += is_async
        if self.text(k) == "function":
            while k < len(self.tokens) and not self.is_op(k, "("):
                k += 1
            if k >= len(self.tokens):
                return None
            params, k = self.params(k), self.tokens[k].close + 1
            while k < len(self.tokens) and not self.is_op(k, "{"):
                k += 1
            return {"params": params, "is_async": is_async, **self.body(k)} if k < len(self.tokens) else None
        if self.is_op(k, "<"):
            while k < len(self.tokens) and not self.is_op(k, "("):
                k += 1
        if k < len(self.tokens) and self.is_op(k, "("):
            params, after = self.params(k), self.tokens[k].close + 1
            if self.is_op(after, ":"):
                while after < len(self.tokens) and not self.is_op(after, "=>") and not self.is_op(after, ";"):
                    after += 1
        elif k < len(self.tokens) and self.tokens[k].kind == "id":
            params, after = [self.text(k)], k + 1
        else:
            return None
        if not self.is_op(after, "=>"):
            return None
        if self.is_op(after + 1, "{"):
            return {"params": params, "is_async": is_async, **self.body(after + 1)}
        end = self.end_of(after + 1)
        span = self.span(self.tokens[min(after + 1, len(self.tokens) - 1)].start, self.tokens[end].end)
        return {"params": params, "is_async": is_async, "body_start": span["start"], "body_end": span["end"], "body_lines": bisect_right(self.lines, self.tokens[end].start) + 2 - span["line"], "returns_jsx": self.jsx_value(after + 1, end + 1)}

    def class_like(self, i: int, start: int, exported: bool, kind: str, name: str | None = None) -> int:
        k, own = i + 1, None
        if k < len(self.tokens) and self.tokens[k].kind == "id" and self.text(k) not in ("extends", "implements"):
            own, k = self.text(k), k + 1
        parents, depth, expects = [], 0, False
        while k < len(self.tokens) and not (self.is_op(k, "{") and depth == 0):
            t = self.text(k)
            depth += (t == "<") - (t == ">")
            if t in ("extends", "implements") and depth == 0:
                expects = True
            elif expects and depth == 0 and self.tokens[k].kind == "id" and not self.is_op(k - 1, "."):
                parents.append(t)
            k += 1
        if k >= len(self.tokens):
            return i + 1
        close = self.tokens[k].close
        if kind == "interface":
            self.types.append((k, close))
        refs = [self.text(j) for j in range(k + 1, close) if self.tokens[j].kind == "id" and self.is_op(j - 1, ":")]
        self.symbol(name or own or "default", kind, start, close, exported, extends=parents, type_refs=refs)
        return close + 1

    def variables(self, i: int, start: int, exported: bool) -> int:
        kind, end, k = self.text(i), self.end_of(i), i + 1
        while k <= end and k < len(self.tokens):
            name = self.tokens[k]
            # of a pattern no name is taken, as it may rename or hold defaults
            value = name.close + 1 if name.kind == "op" and name.text in ("{", "[") and name.close > k else k + 1
            if self.is_op(value, ":"):
                depth = 0
                while value <= end and not (self.is_op(value, "=") and depth == 0) and not (self.is_op(value, ",") and depth == 0):
                    t = self.tokens[value]
                    depth += (t.text == "<") - (t.text == ">")
                    value = t.close + 1 if t.kind == "op" and t.text in _PAIRS and t.close > value else value + 1
            stop = value
            while stop <= end and not self.is_op(stop, ",") and not self.is_op(stop, ";"):
                stop = self.beyond(stop)
            if name.kind == "id":
                self.bound.add(name.start)
                found = self.arrow(value + 1) if self.is_op(value, "=") else None
                if found:
                    self.symbol(name.text, "function", name.start, min(stop, end + 1) - 1, exported, **found)
                else:
                    self.symbol(name.text, kind, name.start, min(stop, end + 1) - 1, exported)
            if not self.is_op(stop, ","):
                break
            k = stop + 1
        return end + 1

    # whole-file facts

    def class_body(self, i: int) -> None:
        """Notes the braces of the class that begins at token ``i``."""
        k, depth = i + 1, 0
        while k < len(self.tokens) and k < i + 200:
            t = self.tokens[k]
            if t.kind == "op":
                if t.text == "{" and depth <= 0:
                    self.members.add(k)
                    return
                depth += (t.text == "<") - (t.text == ">")
                if t.text in _PAIRS and t.close > k:
                    k = t.close
                elif t.text in (";", "=", ")", "}"):
                    return
            k += 1

    def before_type_arguments(self, i: int) -> int | None:
        """Last token before the type arguments that end at token ``i``; None if these aren't any."""
        depth, k = 0, i
        while k > 0:
            t = self.tokens[k]
            if t.kind == "op":
                if t.text == ">":
                    depth += 1
                elif t.text == "<":
                    depth -= 1
                    if not depth:
                        return k - 1 if self.tokens[k - 1].kind == "id" and self.tokens[k - 1].text not in _BEFORE_VALUE else None
                elif t.text in _CLOSERS:
                    if not 0 <= t.close < k:
                        return None
                    k = t.close
                elif t.text not in _TYPE_OPS:
                    return None
            elif t.kind not in ("id", "str", "num"):
                return None
            k -= 1
        return None

    def callee(self, i: int) -> tuple[int, int] | None:
        """First and last token of the callee before the parenthesis ``i``."""
        k = i - 1
        if k >= 0 and self.typed and self.is_op(k, ">"):
            k = self.before_type_arguments(k)
        if k is not None and k >= 0 and self.typed and self.is_op(k, "!"):
            k -= 1
        if k is None or k < 0 or self.tokens[k].kind != "id" and not self.is_op(k, "]"):
            return None
        last = k
        while True:
            if self.is_op(k, "]") and self.tokens[k].close >= 0:
                k = self.tokens[k].close - 1
                continue
            if self.text(k - 1) in (".", "?."):
                k -= 2
                if self.is_op(k, ")"):
                    k = self.tokens[k].close - 1
                    if k < 0 or self.tokens[k].kind != "id":
                        return k + 1, last
                continue
            return k, last

    def declares(self, first: int, last: int, i: int) -> bool:
        """Whether the name and parenthesis declare a method, or a signature, instead of calling."""
        close = self.tokens[i].close
        if first != last or close < i:
            return False
        before, after = self.tokens[first - 1] if first else None, self.tokens[close + 1] if close + 1 < len(self.tokens) else None
        starts = before is None or before.kind == "op" and before.text in ("{", "}", ";", ",", "*") or before.kind == "id" and before.text in _MODIFIERS
        starts = starts or before.text == ")" and "\n" in self.source[before.end : self.tokens[first].start]  # after a decorator
        if self.outer[i] in self.members:
            return starts or "\n" in self.source[before.end : self.tokens[first].start] and not self.is_op(first - 1, "=")
        if after is None or after.kind != "op":
            return False
        same_line = "\n" not in self.source[self.tokens[close].end : after.start]
        return starts and same_line and (after.text == "{" or self.typed and after.text == ":" and self.is_op(self.outer[i], "{"))

    def facts(self) -> dict:
        calls, env, evals, dynamic, refs, secrets = [], [], [], [], [], []
        wanted = {n for i in self.imports for n in fixed.DYNAMIC_APIS.get(i["specifier"], ()) if n in i["names"]}
        tokens, types = self.tokens, sorted(self.types)
        for i, t in enumerate(tokens):
            if t.kind == "id" and t.text == "class" and not (i and tokens[i - 1].text in (".", "?.")):
                self.class_body(i)
            before = tokens[i - 1].text if i else ""
            if t.kind == "op" and t.text == "(":
                while types and types[0][1] < i:
                    types.pop(0)
                if types and types[0][0] < i:  # a type has no calls
                    continue
                found = self.callee(i)
                if found is None or before in _NOT_CALLEES and before != "import":
                    if before != "import":
                        continue
                    found = i - 1, i - 1
                first, last = found
                head = self.text(first - 1) if first else ""
                callee = self.source[tokens[first].start : tokens[last].end]
                span = self.span(self.tokens[first].start, self.tokens[t.close].end if t.close > i else t.end)
                if head == "new":
                    if callee == "Function":
                        evals.append({"name": "new Function", **self.span(self.tokens[first - 1].start, self.tokens[t.close].end)})
                    continue
                if head == "function" or head == "*" and self.text(first - 2) == "function" or self.declares(first, last, i):
                    continue
                arg = self.tokens[i + 1] if i + 1 < t.close else None
                if callee in ("require", "import") and arg is not None and arg.kind == "str":
                    self.add_import(i, _unquote(arg), "require" if callee == "require" else "dynamic", [], self.tokens[first].start, self.tokens[t.close].end)
                calls.append({"callee": callee, "args": len(self.params(i)), **span})
                if callee in fixed.EVAL_CALLEES:
                    evals.append({"name": callee, **span})
                if callee in wanted:
                    dynamic.append({"name": callee, **span})
            elif t.kind == "id":
                if t.text == "process" and self.text(i + 1) == "." and self.text(i + 2) == "env" and before not in (".", "?."):
                    if self.text(i + 3) == "." and i + 4 < len(self.tokens):
                        env.append({"name": self.text(i + 4), **self.span(t.start, self.tokens[i + 4].end)})
                    elif self.is_op(i + 3, "[") and self.tokens[i + 4].kind == "str":
                        env.append({"name": _unquote(self.tokens[i + 4]), **self.span(t.start, self.tokens[i + 5].end)})
                key = self.text(i + 1) == ":" and before in ("{", ",")
                named = before in ("function", "class", "interface", "type", "enum") or t.start in self.bound or before == "*" and self.text(i - 2) == "function"
                if before not in (".", "?.") and not key and not named:
                    refs.append(t.text)
            elif t.kind == "str":
                if found := self.secret(i):
                    secrets.append(found)
        directives = []
        for i, t in enumerate(self.tokens):
            if t.kind == "str":
                if _unquote(t) in ("use client", "use server"):
                    directives.append(_unquote(t))
            elif not self.is_op(i, ";"):
                break
        self.imports.sort(key=lambda x: x["start"])
        return {"imports": self.imports, "exports": self.exports, "symbols": sorted(self.symbols, key=lambda s: s["start"]), "calls": calls, "env_reads": env, "eval_calls": evals, "dynamic_calls": dynamic, "refs": sorted(set(refs)), "secrets": secrets, "directives": directives}

    def secret(self, i: int) -> dict | None:
        value = _unquote(self.tokens[i])
        lower = value.lower()
        if len(value.encode()) < 8 or " " in value or value.startswith(fixed.PLACEHOLDER_STARTS) or any(f in lower for f in fixed.PLACEHOLDER_FRAGMENTS):
            return None
        binding = None
        if self.is_op(i - 1, ":") and self.tokens[i - 2].kind in ("id", "str"):
            binding = self.text(i - 2)
        elif self.is_op(i - 1, "="):
            k = i - 2
            while k > 0 and not (self.text(k - 1) in ("const", "let", "var", ",", ";", "{", "}", "(") or self.begins_statement(k)):
                k -= 1
            binding = self.source[self.tokens[k].start : self.tokens[i - 2].end].split(":")[0].strip()
        signal = None
        if len(value.encode()) >= 16 and value.startswith(fixed.SECRET_PREFIXES):
            signal = "known_prefix"
        elif binding and any(f in binding.lower() for f in fixed.SECRET_NAME_FRAGMENTS):
            signal = "suspicious_name"
        return signal and {"binding": binding, "preview": value[:4], "length": len(value), "signal": signal, **self.span(self.tokens[i].start, self.tokens[i].end)}


def facts(source: str, language: str) -> dict:
    return Module(source, language).facts()

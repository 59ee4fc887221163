"""A small structural parser for Dart: executables, their branch counts and nesting, and string literals.

It reads statements and bracket structure, not types.  Branches are counted
where the metrics want them: if, for, while, do, case, catch, conditional
expressions and the logical operators; nested executables count for themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Token:
    kind: str  # word, number, string, mark
    text: str
    start: int
    end: int
    doc: int | None = None  # start of a documentation comment just before


@dataclass
class Executable:
    name: str
    start: int
    end: int = 0
    complexity: int = 1
    depth: int = 0


@dataclass
class Literal:
    value: str
    start: int
    executable: int | None
    context: str = ""  # the name that the literal is given to


@dataclass
class Parsed:
    executables: list[Executable] = field(default_factory=list)
    literals: list[Literal] = field(default_factory=list)


_MARKS = re.compile(r">>>=|\.\.\.\?|\?\?=|>>=|<<=|&&=|\|\|=|\?\.\.|\.\.\.|&&|\|\||\?\?|\?\.|=>|==|!=|<=|>=|\.\.|\+\+|--|[-+*/%&|^~]=|.", re.S)
_WORD = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def tokenize(text: str, start: int = 0, closing: bool = False) -> tuple[list[Token], int]:
    """Tokens from a place on; with closing, up to the brace that ends an interpolation."""
    out, i, doc, level = [], start, None, 0

    def put(kind: str, a: int, b: int, value: str | None = None):
        nonlocal doc
        out.append(Token(kind, text[a:b] if value is None else value, a, b, doc))
        doc = None

    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif text.startswith("//", i):
            stop = text.find("\n", i)
            doc = (i if doc is None else doc) if text.startswith("///", i) else doc
            i = len(text) if stop < 0 else stop
        elif text.startswith("/*", i):
            doc, level_, i = (i if text.startswith("/**", i) else doc), 1, i + 2
            while i < len(text) and level_:
                if text.startswith("/*", i):
                    level_, i = level_ + 1, i + 2
                elif text.startswith("*/", i):
                    level_, i = level_ - 1, i + 2
                else:
                    i += 1
        elif c in "\"'" or c == "r" and text[i + 1 : i + 2] in ("'", '"') and not (out and out[-1].end == i and out[-1].kind == "word"):
            i = _string(text, i, out, put)
        elif m := _WORD.match(text, i):
            put("word", i, m.end())
            i = m.end()
        elif m := _NUMBER.match(text, i):
            put("number", i, m.end())
            i = m.end()
        else:
            if closing and c == "}" and not level:
                return out, i
            level += (c == "{") - (c == "}")
            m = _MARKS.match(text, i)
            put("mark", i, m.end())
            i = m.end()
    return out, i


def _string(text: str, i: int, out: list[Token], put) -> int:
    """One literal: its token, then the tokens of its interpolations."""
    begin, raw = i, text[i] == "r"
    i += raw
    quote = text[i] * 3 if text.startswith(text[i] * 3, i) else text[i]
    i += len(quote)
    value, inner, first = [], [], len(out)
    put("string", begin, begin, "")
    while i < len(text) and not text.startswith(quote, i):
        c = text[i]
        if not raw and c == "\\":
            value.append({"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v"}.get(text[i + 1 : i + 2], text[i + 1 : i + 2]))
            i += 2
        elif not raw and text.startswith("${", i):
            found, stop = tokenize(text, i + 2, True)
            inner += [Token("mark", "(", i, i + 2), *found, Token("mark", ")", stop, stop + 1)]
            value.append(text[i : stop + 1])
            i = stop + 1
        elif c == "\n" and len(quote) == 1:
            break  # an unclosed literal ends with its line
        else:
            value.append(c)
            i += 1
    i = min(len(text), i + len(quote))
    out[first].text, out[first].end = "".join(value), i
    out += inner
    return i


_CONTROL = {"if", "for", "while", "switch", "catch", "assert", "return", "await", "in", "case", "throw", "yield", "when"}
_ASYNC = {"async", "sync"}


class _Parser:
    def __init__(self, text: str):
        self.text, self.t, self.i = text, tokenize(text)[0], 0
        self.out, self.stack = Parsed(), []
        self.match = self._brackets()

    def _brackets(self) -> dict[int, int]:
        open_, out = [], {}
        for i, t in enumerate(self.t):
            if t.kind == "mark" and t.text in _OPEN:
                open_.append(i)
            elif t.kind == "mark" and t.text in _CLOSE and open_:
                out[open_.pop()] = i
        return out

    # helpers

    def text_at(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind in ("word", "mark") else ""

    def add(self, n: int = 1) -> None:
        if self.stack:
            self.out.executables[self.stack[-1][0]].complexity += n

    def nest(self, by: int) -> None:
        if self.stack:
            self.stack[-1][1] += by
            e = self.out.executables[self.stack[-1][0]]
            e.depth = max(e.depth, self.stack[-1][1])

    def end_of(self, i: int) -> int:
        return self.match.get(i, len(self.t) - 1)

    def body_after(self, i: int) -> int | None:
        """The place of a function body's first token, after parameters that end at i."""
        i += 1
        if self.text_at(i) in _ASYNC:
            i += 1 + (self.text_at(i + 1) == "*")
        return i if self.text_at(i) in ("{", "=>") else None

    def literal(self, i: int) -> None:
        t, named = self.t[i], self.text_at(i - 1) in ("=", ":") and i > 1 and self.t[i - 2].kind == "word"
        self.out.literals.append(Literal(t.text, t.start, self.stack[-1][0] if self.stack else None, self.t[i - 2].text if named else ""))

    def executable(self, name: str, start: int, first: int, body: int | None, stop: str = ";") -> None:
        """Reads parameters and initialisers from token first on, then the body."""
        self.out.executables.append(Executable(name, start))
        self.stack.append([len(self.out.executables) - 1, 0])
        self.i = first
        if body is None:
            self.expression({";"})
        else:
            self.expression(set(), body)
            if self.text_at(body) == "{":
                self.i = body
                self.block()
            else:
                self.i = body + 1
                self.expression({";", ",", ")", "]", "}"} if stop == "," else {";"})
        e, last = self.out.executables[self.stack.pop()[0]], max(0, self.i - 1)
        e.end = self.t[min(last, len(self.t) - 1)].end
        if stop == ";" and self.text_at(self.i) == ";" and (body is None or self.text_at(body) == "=>"):
            e.end = self.t[self.i].end
            self.i += 1

    # expressions

    def conditional(self, i: int, limit: int) -> bool:
        """Whether a lone question mark has a colon of its own on its level."""
        open_ = 1
        i += 1
        while i < limit:
            x = self.text_at(i)
            if x in _OPEN and i in self.match:
                i = self.match[i]
            elif x in _CLOSE or x in (";", ","):
                return False
            elif x == "?":
                open_ += 1
            elif x == ":":
                open_ -= 1
                if not open_:
                    return True
            i += 1
        return False

    def expression(self, stops: set[str], limit: int | None = None) -> None:
        """Reads up to, not over, one of the stops on this level or the limit."""
        limit = len(self.t) if limit is None else limit
        while self.i < limit:
            t = self.t[self.i]
            if t.kind == "string":
                self.literal(self.i)
            elif t.kind == "mark":
                if t.text in stops:
                    return
                if t.text in ("&&", "||"):
                    self.add()
                elif t.text == "?" and self.conditional(self.i, limit):
                    self.add()
                elif t.text == "(":
                    close = self.end_of(self.i)
                    body = self.body_after(close) if self.text_at(self.i - 1) not in _CONTROL - {"return", "await", "throw", "yield", "in"} else None
                    if body is not None and body < limit:
                        self.executable("<anonymous>", t.start, self.i, body, ",")
                        continue
                    self.i += 1
                    self.expression(set(), close)
                elif t.text in _OPEN:
                    close = self.end_of(self.i)
                    self.i += 1
                    self.expression(set(), close)
                elif t.text in _CLOSE and stops:
                    return
            self.i += 1

    # statements

    def block(self) -> None:
        close = self.end_of(self.i)
        self.i += 1
        while self.i < close:
            before = self.i
            self.statement(close)
            if self.i == before:
                self.i += 1
        self.i = close + 1

    def parens(self) -> None:
        if self.text_at(self.i) == "(":
            close = self.end_of(self.i)
            self.i += 1
            self.expression(set(), close)
            self.i = close + 1

    def until_semicolon(self) -> None:
        self.expression({";"})
        self.i += self.text_at(self.i) == ";"

    def statement(self, limit: int) -> None:
        word = self.text_at(self.i)
        if word == "{":
            self.block()
        elif word == "await" and self.text_at(self.i + 1) == "for":
            self.i += 1
            self.statement(limit)
        elif word in ("if", "for", "while"):
            self.add()
            self.nest(1)
            self.i += 1
            self.parens()
            self.statement(limit)
            if word == "if" and self.text_at(self.i) == "else":
                self.i += 1
                self.statement(limit)
            self.nest(-1)
        elif word == "do":
            self.add()
            self.nest(1)
            self.i += 1
            self.statement(limit)
            self.i += self.text_at(self.i) == "while"
            self.parens()
            self.i += self.text_at(self.i) == ";"
            self.nest(-1)
        elif word == "switch" and self.text_at(self.i + 1) == "(":
            self.nest(1)
            self.i += 1
            self.parens()
            close = self.end_of(self.i)
            self.i += 1
            while self.i < close:
                before = self.i
                if self.text_at(self.i) == "case":
                    self.add()
                    self.i += 1
                    self.expression({":"}, close)
                    self.i += 1
                elif self.text_at(self.i) == "default" and self.text_at(self.i + 1) == ":":
                    self.i += 2
                else:
                    self.statement(close)
                if self.i == before:
                    self.i += 1
            self.i = close + 1
            self.nest(-1)
        elif word == "try":
            self.nest(1)
            self.i += 1
            self.block()
            while (w := self.text_at(self.i)) in ("on", "catch", "finally"):
                if w != "finally":
                    self.add()
                while self.i < limit and self.text_at(self.i) != "{":
                    self.i += 1
                self.block()
            self.nest(-1)
        elif (found := self.declared(limit)) is not None:
            name, params, body = found
            self.executable(name, self.t[params].start, params, body)
        elif self.t[self.i].kind == "word" and self.text_at(self.i + 1) == ":":
            self.i += 2
        else:
            self.until_semicolon()

    def declared(self, limit: int) -> tuple[str, int, int] | None:
        """Name, parameters and body of a local function that starts here, after an optional type."""
        i, last = self.i, None
        while i < limit:
            t, x = self.t[i], self.text_at(i)
            if t.kind == "word" and x not in _CONTROL and x not in ("new", "const", "else", "rethrow", "break", "continue", "this", "super"):
                last, i = i, i + 1
            elif x == "<":
                level = 0
                while i < limit:
                    level += self.text_at(i).count("<") - self.text_at(i).count(">")
                    i += 1
                    if level <= 0:
                        break
            elif x in ("?", ".") and last is not None:
                i += 1
            elif x == "(" and last is not None and self.text_at(i - 1) not in (".",):
                body = self.body_after(self.end_of(i))
                return (self.text_at(last), i, body) if body is not None else None
            else:
                return None
        return None

    # declarations

    def unit(self, close: int, owner: str | None) -> None:
        while self.i < close:
            before = self.i
            self.declaration(close, owner)
            if self.i == before:
                self.i += 1

    def declaration(self, close: int, owner: str | None) -> None:
        """A class or the like, an executable, or a variable."""
        first = self.i
        while self.text_at(self.i) == "@":
            self.i += 2
            while self.text_at(self.i) in (".",):
                self.i += 2
            if self.text_at(self.i) == "(":
                inside = self.end_of(self.i)
                self.expression(set(), inside)
                self.i = inside + 1
        words, i = [], self.i
        while i < close:
            t, x = self.t[i], self.text_at(i)
            if t.kind == "word" or x in (".", "?"):
                if x in ("class", "mixin", "extension", "enum") and self.t[i + 1 : i + 2] and self.t[i + 1].kind == "word" and not {"=", "("} & {self.text_at(k) for k in range(self.i, i)}:
                    return self.type_body(i, close)
                words.append(i)
                if x == "operator":
                    i += 1
                    while i < close and self.text_at(i) != "(":
                        words.append(i)
                        i += 1
                    i -= 1
                elif x == "get" and self.t[i + 1].kind == "word":
                    name, body = i + 1, self.body_after(i + 1)
                    return self.function(self.text_at(name), first, name + 1, body, owner)
            elif x == "<":
                level = 0
                while i < close:
                    level += self.text_at(i).count("<") - self.text_at(i).count(">")
                    if level <= 0:
                        break
                    i += 1
            elif x == "(" and words:
                return self.callable(first, words, i, close, owner)
            else:
                break
            i += 1
        self.until_semicolon()

    def type_body(self, i: int, close: int) -> None:
        name = self.text_at(i + 1)
        while i < close and self.text_at(i) not in ("{", ";"):
            i += 1
        if self.text_at(i) == ";":
            self.i = i + 1
            return
        inside = self.end_of(i)
        self.i = i + 1
        self.unit(inside, name)
        self.i = inside + 1

    def callable(self, first: int, words: list[int], params: int, close: int, owner: str | None) -> None:
        names = [self.text_at(k) for k in words]
        name = names[-1]
        if "operator" in names:
            name = "".join(names[names.index("operator") + 1 :])
        if owner and owner in names and (names[-1] == owner or names[-2:-1] == ["."] and names[-3:-2] == [owner]):
            name = owner if names[-1] == owner and "." not in names else f"{owner}.{names[-1]}"
        after = self.end_of(params)
        body = self.body_after(after)
        if body is None and self.text_at(after + 1) == ":":  # initialisers
            k = after + 2
            while k < close and self.text_at(k) != ";":
                if self.text_at(k) in ("(", "["):
                    k = self.end_of(k)
                elif self.text_at(k) == "{" and (self.text_at(k - 1) in (")", "]", "}") or self.t[k - 1].kind != "mark"):
                    break
                elif self.text_at(k) == "{":
                    k = self.end_of(k)
                k += 1
            body = k if self.text_at(k) == "{" else None
        elif body is None and self.text_at(after + 1) not in (";",):
            self.i = first
            return self.until_semicolon()
        self.function(name, first, params, body, owner)

    def function(self, name: str, first: int, params: int, body: int | None, owner: str | None) -> None:
        """Members begin with their documentation and annotations; other functions with their parameters."""
        head = self.t[first]
        start = (head.start if head.doc is None else head.doc) if owner else self.t[min(params, len(self.t) - 1)].start
        self.executable(name, start, params, body)


def parse(text: str) -> Parsed:
    p = _Parser(text)
    p.unit(len(p.t), None)
    return p.out

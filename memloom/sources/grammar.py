"""Declarations of Rust, TypeScript and JavaScript sources, by a lexer and recursive descent.

The lexer knows what hides braces: nested comments, raw strings, lifetimes, templates with code in
them, regular expressions and JSX.  The parsers know in which body they are, so that a call is no
method, a class or function within an expression no declaration, and a signature no function;
what they don't know they pass over, bracket by bracket.  Declarations come in pre-order as (kind,
name, first row, last row).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

Found = list[tuple[str, str, int, int]]
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_ID = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")


@dataclass(slots=True)
class Token:
    kind: str  # id, num, str, re or op
    text: str
    row: int


class _Lexer:
    """What all the languages share: position, rows, white space, comments."""

    nested = False

    def __init__(self, source: str):
        self.s, self.at, self.row, self.out = source, 0, 0, []

    def take(self, end: int) -> str:
        text = self.s[self.at : end]
        self.row += text.count("\n")
        self.at = end
        return text

    def put(self, kind: str, text: str, row: int | None = None) -> None:
        self.out.append(Token(kind, text, self.row if row is None else row))

    def blank(self) -> bool:
        """Passes white space or a comment, if here is one."""
        s, at = self.s, self.at
        if s[at].isspace():
            self.take(at + 1)
        elif s.startswith("//", at):
            end = s.find("\n", at)
            self.take(len(s) if end < 0 else end)
        elif s.startswith("/*", at):
            depth, end = 1, at + 2
            while depth and end < len(s):
                if s.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                elif self.nested and s.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                else:
                    end += 1
            self.take(end)
        else:
            return False
        return True

    def quoted(self, quote: str) -> None:
        """A string up to its quote; a backslash covers the next character."""
        end, s, row = self.at + 1, self.s, self.row
        while end < len(s) and s[end] != quote:
            end += 2 if s[end] == "\\" else 1
        self.put("str", self.take(min(len(s), end + 1)), row)

    def word(self) -> bool:
        for kind, pattern in (("id", _ID), ("num", _NUMBER)):
            if m := pattern.match(self.s, self.at):
                self.put(kind, self.take(m.end()))
                return True
        return False


class _Rust(_Lexer):
    nested = True
    _raw = re.compile(r'(?:b|c)?r(#*)"')
    _char = re.compile(r"b?'(?:\\.[^']*|[^\\'])'", re.S)

    def tokens(self) -> list[Token]:
        s = self.s
        while self.at < len(s):
            if self.blank():
                continue
            if m := self._raw.match(s, self.at):
                end, row = s.find('"' + m[1], m.end()), self.row
                self.put("str", self.take(len(s) if end < 0 else end + 1 + len(m[1])), row)
            elif m := self._char.match(s, self.at):
                self.put("str", self.take(m.end()))
            elif s[self.at] == '"':
                self.quoted('"')
            elif s.startswith("r#", self.at) and (m := _ID.match(s, self.at + 2)):
                self.take(m.end())
                self.put("raw", m[0])
            elif s[self.at] == "'":  # a lifetime
                self.take(self.at + 1)
            elif not self.word():
                two = s[self.at : self.at + 2]
                self.put("op", self.take(self.at + (2 if two in ("->", "=>", "::") else 1)))
        return self.out


#: Tokens behind which an operand comes, not an operator.
_BEFORE_OPERAND = set("([{,;=:?!&|+-*/%^~<>") | {"=>", "...", "return", "typeof", "await", "new", "in", "of", "void", "delete", "yield", "throw", "case", "else", "do", "extends", "default", "instanceof"}
#: Tokens behind which a function or class is part of an expression.
_IN_EXPRESSION = set("([,=:?!&|+-*/%^~<>") | {"=>", "...", "return", "typeof", "await", "new", "in", "of", "void", "delete", "yield", "throw", "case", "extends", "instanceof", "."}


class _Script(_Lexer):
    def __init__(self, source: str, jsx: bool, typed: bool):
        super().__init__(source)
        self.jsx, self.typed = jsx, typed

    def operand(self) -> bool:
        """Whether an operand may come here."""
        return not self.out or (self.out[-1].text in _BEFORE_OPERAND and self.out[-1].kind in ("op", "id")) or self.out[-1].text == "}"

    def tokens(self) -> list[Token]:
        while self.at < len(self.s):
            self.one()
        return self.out

    def one(self) -> None:
        s, c = self.s, self.s[self.at]
        if self.blank():
            return
        if c in "\"'":
            self.quoted(c)
        elif c == "`":
            self.template()
        elif c == "/" and self.operand():
            row, end, inside = self.row, self.at + 1, False
            while end < len(s) and (inside or s[end] != "/") and s[end] != "\n":
                inside = (inside or s[end] == "[") and s[end] != "]"
                end += 2 if s[end] == "\\" else 1
            self.put("re", self.take(min(len(s), end + 1)), row)
        elif c == "<" and self.jsx and self.operand() and re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>{]))(?!\s+extends\b)").match(s, self.at):
            self.element()
        elif c == "#" and (m := _ID.match(s, self.at + 1)):
            self.put("id", self.take(m.end()))
        elif not self.word():
            for op in ("...", "=>", "?."):
                if s.startswith(op, self.at):
                    self.put("op", self.take(self.at + len(op)))
                    return
            self.put("op", self.take(self.at + 1))

    def code(self) -> None:
        """Code in braces within a template or JSX, as a group in parentheses."""
        self.take(self.at + 1)
        self.put("op", "(")
        open_ = 0
        while self.at < len(self.s):
            if self.s[self.at] == "}" and not open_:
                self.take(self.at + 1)
                break
            before = len(self.out)
            self.one()
            for t in self.out[before:][-1:]:
                open_ += (t.kind == "op") * ((t.text == "{") - (t.text == "}"))
        self.put("op", ")")

    def template(self) -> None:
        s, row = self.s, self.row
        self.put("str", "`", row)
        self.take(self.at + 1)
        while self.at < len(s):
            c = s[self.at]
            if c == "\\":
                self.take(self.at + 2)
            elif c == "`":
                self.take(self.at + 1)
                break
            elif s.startswith("${", self.at):
                self.take(self.at + 1)
                self.code()
            else:
                self.take(self.at + 1)
        self.put("str", "`")

    def element(self) -> None:
        """A JSX element, its attributes and children."""
        s = self.s
        self.put("str", "<>")
        name = re.compile(r"<([\w$.:-]*)").match(s, self.at)
        self.take(name.end())
        while self.at < len(s):  # attributes
            if s.startswith("/>", self.at):
                self.take(self.at + 2)
                self.put("str", "</>")
                return
            c = s[self.at]
            if c == ">":
                self.take(self.at + 1)
                break
            if c == "{":
                self.code()
            elif c in "\"'":
                end = s.find(c, self.at + 1)
                self.take(len(s) if end < 0 else end + 1)
            else:
                self.take(self.at + 1)
        while self.at < len(s):  # children
            c = s[self.at]
            if s.startswith("</", self.at):
                end = s.find(">", self.at)
                self.take(len(s) if end < 0 else end + 1)
                break
            if c == "{":
                self.code()
            elif c == "<":
                self.element()
            else:
                self.take(self.at + 1)
        self.put("str", "</>")


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.t, self.found = tokens, []
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(tokens):
            if t.kind == "op" and t.text in _PAIRS:
                stack.append(i)
            elif t.kind == "op" and t.text in ")]}":
                # an unmatched opening bracket within ends here as well
                while stack:
                    j = stack.pop()
                    self.close[j] = i
                    if _PAIRS[tokens[j].text] == t.text:
                        break
        for j in stack:
            self.close[j] = len(tokens)

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind in ("op", "id") else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind in ("id", "raw")

    def row(self, i: int) -> int:
        return self.t[min(i, len(self.t) - 1)].row

    def over(self, i: int) -> int:
        """Behind the bracket group that begins here, or behind the token."""
        return self.close.get(i, i) + 1

    def angles(self, i: int) -> int:
        """Behind the type parameters that begin here, if any."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            depth += (self.text(i) == "<") - (self.text(i) == ">")
            if depth == 0:
                return i + 1
            i = self.over(i)
        return i


class _RustParser(_Parser):
    _modifiers = {"pub", "async", "const", "unsafe", "extern", "default"}

    def run(self, i: int, end: int) -> None:
        first = None  # where the modifiers of what comes begin
        while i < end:
            word = self.text(i)
            if word in self._modifiers:
                first = i if first is None else first
                i = self.over(i + 1) if word == "pub" and self.text(i + 1) == "(" else i + 1
                continue
            if first is not None and self.t[i].kind == "str" and self.text(i - 1) == "extern":
                i += 1
                continue
            start, first = i if first is None else first, None
            if word in ("fn", "struct", "trait") and self.is_id(i + 1):
                j = i + 2
                while j < end and self.text(j) not in ("{", ";"):
                    j = self.over(j)
                body = self.text(j) == "{"
                last = self.close.get(j, j) if body else j
                if body or word == "struct":
                    self.found.append(({"fn": "function_item", "struct": "struct_item", "trait": "trait_item"}[word], self.t[i + 1].text, self.row(start), self.row(last)))
                if body and word != "struct":
                    self.run(j + 1, min(last, end))
                i = last + 1
            elif word == "!" and self.is_id(i - 1):  # a macro: what it is given are tokens
                i += 2 if self.is_id(i + 1) and self.text(i + 2) in _PAIRS else 1
                if self.text(i) in _PAIRS:
                    i = self.over(i)
            elif word == "#" and self.text(i + 1) == "[":
                i = self.over(i + 1)
            else:
                i += 1


class _ScriptParser(_Parser):
    _members = {"public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "accessor", "declare"}

    def __init__(self, tokens: list[Token], typed: bool):
        super().__init__(tokens)
        self.typed = typed

    def stated(self, i: int) -> bool:
        """Whether a statement begins here."""
        if i <= 0:
            return True
        before = self.t[i - 1]
        return before.kind not in ("op", "id") or before.text not in _IN_EXPRESSION

    def signature(self, i: int) -> int:
        """Behind a parameter list and return type that begin here; -1 if there are none."""
        i = self.angles(i)
        if self.text(i) != "(":
            return -1
        i = self.over(i)
        if self.typed and self.text(i) == ":":
            i += 1
            if self.text(i) in ("asserts", "is"):
                i += 1
            while i < len(self.t):
                if self.text(i) in ("{", "(", "["):  # a type, not a body
                    i = self.over(i)
                elif self.text(i) == "<":
                    i = self.angles(i)
                elif self.is_id(i) or self.t[i].kind in ("str", "num"):
                    i += 1
                else:
                    break
                if self.text(i) in ("|", "&", ".", "=>", "is", "extends", "?"):
                    i += 1
                elif self.text(i) in ("[", "<") or (self.text(i - 1) in ("keyof", "typeof", "readonly", "infer", "unique", "asserts", "new")):
                    continue
                else:
                    break
        return i

    def body(self, kind: str, name: str, first: int, brace: int, end: int, inside, params: int | None = None) -> int:
        """Notes a declaration, if it has a kind, and goes through its parameters and body."""
        last = self.close.get(brace, brace)
        if kind:
            self.found.append((kind, name, self.row(first), self.row(last)))
        if params is not None:
            self.params(params, brace)
        inside(brace + 1, min(last, end))
        return last + 1

    def function(self, i: int, end: int) -> int:
        """A function keyword and what follows."""
        first = i - 1 if self.text(i - 1) == "async" else i
        stated = self.stated(first)
        j = i + 1
        generator = self.text(j) == "*"
        j += generator
        name = self.t[j].text if self.is_id(j) else ""
        j = self.signature(j + bool(name))
        if j < 0 or self.text(j) != "{":
            return i + 1
        return self.body("function_declaration" if stated and name and not generator else "", name, first, j, end, self.run, i + 1)

    def params(self, i: int, end: int) -> None:
        """Code in default values and parameters."""
        while i < end:
            if self.text(i) == "(":
                self.run(i + 1, self.close[i])
            i = self.over(i)

    def class_(self, i: int, end: int) -> int:
        name = self.t[i + 1].text if self.is_id(i + 1) and self.text(i + 1) not in ("extends", "implements") else ""
        j = i + 1
        while j < end and self.text(j) != "{":
            j = self.over(j) if self.text(j) in ("(", "[") else self.angles(j) if self.text(j) == "<" else j + 1
        if j >= end:
            return i + 1
        declared = self.stated(i) and name and self.text(i - 1) != "abstract"
        first = i
        while first >= 2 and self.text(first - 1) == ")" or self.is_id(first - 1) and self.text(first - 2) == "@":  # decorators
            k = first - 1
            while k > 0 and self.text(k) != "@":
                k -= 1
            if self.text(k) != "@" or self.row(first) - self.row(k) > 50:
                break
            first = k
        return self.body("class_declaration" if declared else "", name, first, j, end, self.members)

    def method(self, i: int, end: int) -> int:
        """A method with a body that begins here, or -1."""
        first = i
        while self.text(i) in self._members and self.text(i + 1) not in ("(", "=", ";", ":", ",", "}", "<", "?", "!"):
            i += 1
        if self.text(i) == "*":
            i += 1
        if self.text(i) == "[":
            name = "[" + "".join(t.text for t in self.t[i + 1 : self.close[i]]) + "]"
            after = self.over(i)
        elif i < end and self.t[i].kind in ("id", "raw", "str", "num"):
            name, after = self.t[i].text, i + 1
        else:
            return -1
        if self.text(after) == "?":
            after += 1
        j = self.signature(after)
        if j < 0 or self.text(j) != "{" or j >= end:
            return -1
        return self.body("method_definition", name, first, j, end, self.run, after)

    def members(self, i: int, end: int) -> None:
        """A class body."""
        while i < end:
            if self.text(i) == "@":
                i += 2
                while self.text(i) == ".":
                    i += 2
                i = self.over(i) if self.text(i) == "(" else i
                continue
            if self.text(i) == ";":
                i += 1
                continue
            if self.text(i) == "static" and self.text(i + 1) == "{":
                self.run(i + 2, self.close[i + 1])
                i = self.over(i + 1)
                continue
            after = self.method(i, end)
            if after > 0:
                i = after
                continue
            # a field or signature: up to a semicolon, or a row that begins with another member
            first = i
            i = self.over(i)
            while i < end and self.text(i) != ";":
                t, before = self.t[i], self.t[i - 1]
                if t.row > before.row and before.text not in _BEFORE_OPERAND | {"."} and (t.kind in ("id", "raw", "str") or t.text in ("[", "@", "*", "#")):
                    break
                i = self.over(i)
            self.run(first + 1, i)

    def members_of_object(self, i: int, end: int) -> None:
        while i < end:
            after = self.method(i, end)
            if after > 0:
                i = after
            else:
                first = i
                while i < end and self.text(i) != ",":
                    i = self.over(i)
                self.run(first, i)
            i += self.text(i) == ","

    def run(self, i: int, end: int) -> None:
        """Statements and expressions."""
        case = False
        while i < end:
            word, before = self.text(i), self.text(i - 1)
            if word in ("case", "default"):
                case = True
            if before in (".", "?."):
                i += 1
            elif word == "function":
                i = self.function(i, end)
            elif word == "class" and self.text(i + 1) not in (":", "=", ",", ")", "("):
                i = self.class_(i, end)
            elif self.typed and word == "interface" and self.is_id(i + 1) and self.stated(i):
                j = i + 2
                while j < end and self.text(j) != "{":
                    j = self.angles(j) if self.text(j) == "<" else self.over(j)
                i = self.body("interface_declaration", self.t[i + 1].text, i, j, end, lambda a, b: None)
            elif self.typed and word == "type" and self.is_id(i + 1) and self.stated(i) and self.text(self.angles(i + 2)) == "=":
                i = self.angles(i + 2) + 1
                while i < end and self.text(i) != ";" and not (self.t[i].row > self.row(i - 1) and self.text(i) not in ("|", "&", "?", ":", "=>", "extends") and self.text(i - 1) not in _BEFORE_OPERAND):
                    i = self.over(i)
            elif word == "{":
                label = before == ":" and case
                value = before in _IN_EXPRESSION - {"=>"} and not label or before == "default"
                (self.members_of_object if value else self.run)(i + 1, self.close[i])
                case = case and not label
                i = self.over(i)
            elif word in ("(", "["):
                self.run(i + 1, min(self.close[i], end))
                i = self.over(i)
            else:
                i += 1


def parse_rust(source: str) -> Found:
    parser = _RustParser(_Rust(source).tokens())
    parser.run(0, len(parser.t))
    return parser.found


def script_parser(jsx: bool, typed: bool):
    def parse(source: str) -> Found:
        parser = _ScriptParser(_Script(source, jsx, typed).tokens(), typed)
        parser.run(0, len(parser.t))
        return parser.found

    return parse

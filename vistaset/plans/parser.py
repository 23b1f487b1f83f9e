"""Lexer and recursive-descent parser of the set language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QueryError
from . import nodes as n

KEYWORDS = frozenset({"any", "all", "macro", "obj", "del"})
_TOKENS = re.compile(
    r"""(?P<skip>[\s]+|\#[^\n]*)
      | (?P<number>[0-9][0-9.]*)
      | (?P<text>"(?:[^"\\]|\\.)*")
      | (?P<name>(?:[A-Za-z_]|[^\x00-\x7f])(?:[A-Za-z0-9_]|[^\x00-\x7f])*)
      | (?P<op>&&|\|\||>=|<=|==|!=|>>|[$%^!:|&+\-*/<>=().,;])""",
    re.X,
)
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]*)?")


@dataclass(frozen=True)
class Token:
    kind: str  # number, text, name, key, op, end
    value: str
    at: int


def tokens(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _TOKENS.match(source, at)
        if not m:
            out.append(Token("bad", source[at], at))  # spoils its statement only
            at += 1
            continue
        at = m.end()
        kind, value = m.lastgroup, m[0]
        if kind == "skip":
            continue
        if kind == "text":
            value = re.sub(r"\\([\"\\])", r"\1", value[1:-1])
        elif kind == "number":
            value = _NUMBER.match(value)[0]  # the longest number that it begins with
        elif kind == "name" and value in KEYWORDS:
            kind = "key"
        out.append(Token(kind, value, m.start()))
    return [*out, Token("end", "", len(source))]


class Parser:
    """One statement after another; an error spoils its statement only, up to the next ``;``."""

    def __init__(self, source: str):
        self.all, self.i = tokens(source), 0

    @property
    def now(self) -> Token:
        return self.all[self.i]

    def is_(self, *values: str, kind: str = "op", ahead: int = 0) -> bool:
        t = self.all[min(self.i + ahead, len(self.all) - 1)]
        return t.kind == kind and (not values or t.value in values)

    def take(self) -> Token:
        t = self.now
        self.i += t.kind != "end"
        return t

    def need(self, value: str) -> None:
        if not self.is_(value):
            raise QueryError(f"Expected {value!r} at {self.now.at}, found {self.now.value!r}")
        self.take()

    def name(self) -> str:
        if not self.is_(kind="name"):
            raise QueryError(f"Expected a name at {self.now.at}, found {self.now.value!r}")
        return self.take().value

    def program(self) -> list[n.Node]:
        out = []
        while True:
            while self.is_(";"):
                self.take()
            if self.is_(kind="end"):
                return out
            try:
                out.append(self.statement())
            except QueryError as e:
                out.append(n.Broken(str(e)))
                while not self.is_(";") and not self.is_(kind="end"):
                    self.take()

    def statement(self) -> n.Node:
        if self.is_("macro", kind="key"):
            self.take()
            name, params = self.name(), []
            self.need("(")
            while not self.is_(")"):
                params.append(self.name())
                if not self.is_(")"):
                    self.need(",")
            self.need(")")
            self.need("=")
            return n.MacroDef(name, tuple(params), self.expr())
        if self.is_("del", kind="key"):
            self.take()
            return n.Delete(self.expr())
        if self.is_(kind="name") and self.is_("=", ahead=1):
            name = self.take().value
            self.take()
            return n.Assign(name, self.expr())
        return self.expr()

    def expr(self) -> n.Node:
        e = self.quantified()
        while self.is_(">>"):
            self.take()
            e = n.Expand(e, self.take().value if self.is_(kind="text") else self.name())
        return e

    def quantified(self) -> n.Node:
        e = self.set_()
        while self.is_("any", "all", kind="key"):
            e = n.Quantified(self.take().value, e, self.condition())
        return e

    def condition(self) -> n.Node:
        """A condition in parentheses, or a class name that stands for equality with it."""
        if self.is_("("):
            self.take()
            c = self.expr()
            self.need(")")
            return c
        if self.is_(kind="text") or self.is_(kind="name"):
            return n.Binary("==", n.Name("class"), n.Text(self.take().value))
        raise QueryError(f"Expected a condition at {self.now.at}, found {self.now.value!r}")

    def set_(self) -> n.Node:
        e = self.level(0)
        while self.is_(":", "|", "&", "-"):
            op = self.take().value
            e = n.Filter(e, self.expr()) if op == ":" else n.SetOp(op, e, self.level(0))
        return e

    LEVELS = (("||",), ("&&",), (">", "<", ">=", "<=", "==", "!="), ("+", "-"), ("*", "/"))

    def level(self, k: int) -> n.Node:
        if k == len(self.LEVELS):
            return self.unary()
        e = self.level(k + 1)
        while self.is_(*self.LEVELS[k]):
            op = self.take().value
            e = n.Binary(op, e, self.level(k + 1))
        return e

    def unary(self) -> n.Node:
        if self.is_("!", "-"):
            return n.Unary(self.take().value, self.unary())
        if self.is_("%", "^"):
            return n.Unary(self.take().value, self.quantified())
        e = self.primary()
        while self.is_("."):
            self.take()
            e = n.Member(e, self.name())
        return e

    def primary(self) -> n.Node:
        t = self.now
        if self.is_("$"):
            self.take()
            if self.is_("("):
                self.take()
                c = self.expr()
                self.need(")")
                return n.Quantified("any", n.Library(), c)
            return n.Library()
        if self.is_("obj", kind="key"):
            self.take()
            return n.ImageObjects() if self.is_("any", "all", kind="key") else n.CurrentObject()
        if self.is_("any", "all", kind="key"):
            return n.Quantified(self.take().value, None, self.condition())
        if t.kind == "number":
            return n.Number(float(self.take().value))
        if t.kind == "text":
            return n.Text(self.take().value)
        if t.kind == "name":
            self.take()
            if not self.is_("("):
                return n.Name(t.value)
            self.take()
            if t.value in ("cnt", "collection"):
                if not (self.is_(kind="text") or t.value == "cnt" and self.is_(kind="name")):
                    raise QueryError(f"{t.value} needs one name at {self.now.at}")
                arg = self.take().value
                self.need(")")
                return n.Count(arg) if t.value == "cnt" else n.Album(arg)
            args = []
            while not self.is_(")"):
                args.append(self.expr())
                if not self.is_(")"):
                    self.need(",")
            self.need(")")
            return n.Call(t.value, tuple(args))
        if self.is_("("):
            self.take()
            e = self.expr()
            self.need(")")
            return e
        raise QueryError(f"Unexpected {t.value or 'end of text'!r} at {t.at}")


def parse(source: str) -> list[n.Node]:
    return Parser(source).program()

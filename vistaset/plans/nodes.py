"""Syntax tree of the set language."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    pass


@dataclass(frozen=True)
class Number(Node):
    value: float


@dataclass(frozen=True)
class Text(Node):
    value: str


@dataclass(frozen=True)
class Name(Node):
    name: str


@dataclass(frozen=True)
class Library(Node):
    """``$``"""


@dataclass(frozen=True)
class CurrentObject(Node):
    """``obj``"""


@dataclass(frozen=True)
class ImageObjects(Node):
    """``obj`` before a quantifier: all objects in reach."""


@dataclass(frozen=True)
class Album(Node):
    name: str


@dataclass(frozen=True)
class Count(Node):
    name: str


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Member(Node):
    base: Node
    name: str


@dataclass(frozen=True)
class Unary(Node):
    """``!`` ``-`` ``%`` ``^``"""

    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class SetOp(Node):
    """``|`` ``&`` ``-`` at set level"""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Filter(Node):
    source: Node
    condition: Node


@dataclass(frozen=True)
class Quantified(Node):
    """``source any (condition)``; without a source: over the objects in reach."""

    kind: str
    source: Node | None
    condition: Node


@dataclass(frozen=True)
class Expand(Node):
    source: Node
    pack: str


@dataclass(frozen=True)
class Assign(Node):
    name: str
    value: Node


@dataclass(frozen=True)
class MacroDef(Node):
    name: str
    params: tuple[str, ...]
    body: Node


@dataclass(frozen=True)
class Delete(Node):
    target: Node


@dataclass(frozen=True)
class Broken(Node):
    """A statement that did not parse."""

    message: str

"""A bounded expression language, compiled to Spark columns.

Arithmetic ``+ - * / %``, comparisons, ``&& || !``, ``c ? a : b``, member access,
int, double, bool and string literals and the functions of ``FUNCTIONS``.
Numbers are doubles once either side is; division of doubles follows IEEE.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class CelError(ValueError):
    """The text isn't an expression, or its types don't fit."""


_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?u?)|(?P<name>[A-Za-z_]\w*)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>&&|\|\||[<>=!]=|[-+*/%<>!?:().,]))")
#: How tightly infix operators bind.
_BIND = {"?": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


@dataclass(frozen=True)
class Node:
    kind: str  # num, str, bool, name, member, call, unary, binary, choice
    value: object = None
    parts: tuple[Node, ...] = ()


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.items, at = text, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise CelError(f"unexpected character at {at} in {text!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.items.append(("end", ""))
        self.i = 0

    def peek(self) -> str:
        kind, v = self.items[self.i]
        return v if kind == "op" else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        kind, v = self.items[self.i]
        if want is not None and (kind != "op" or v != want) or kind == "end":
            raise CelError(f"expected {want or 'an operand'} in {self.text!r}, got {v or 'the end'}")
        self.i += 1
        return kind, v

    def expression(self, least: int = 0) -> Node:
        left = self.prefix()
        while (op := self.peek()) in _BIND and _BIND[op] > least:
            self.take()
            if op == "?":
                yes = self.expression()
                self.take(":")
                left = Node("choice", None, (left, yes, self.expression()))
            else:
                left = Node("binary", op, (left, self.expression(_BIND[op])))
        return left

    def prefix(self) -> Node:
        kind, v = self.take()
        if kind == "num":
            return Node("num", float(v) if re.search(r"[.eE]", v) else int(v.rstrip("u")))
        if kind == "str":
            return Node("str", v[1:-1])
        if kind == "op" and v in "-!":
            return Node("unary", v, (self.expression(7),))
        if kind == "op" and v == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind != "name":
            raise CelError(f"unexpected {v!r} in {self.text!r}")
        if v in ("true", "false"):
            return Node("bool", v == "true")
        node = Node("name", v)
        while self.peek() in (".", "("):
            if self.take()[1] == ".":
                kind, v = self.take()
                if kind != "name":
                    raise CelError(f"expected a name after '.' in {self.text!r}")
                node = Node("member", v, (node,))
            else:
                args = []
                while self.peek() != ")":
                    args.append(self.expression())
                    if self.peek() != ")":
                        self.take(",")
                self.take(")")
                if node.kind != "name":
                    raise CelError(f"only plain functions can be called in {self.text!r}")
                node = Node("call", node.value, tuple(args))
        return node


def parse(text: str) -> Node:
    p = _Parser(text)
    node = p.expression()
    if p.items[p.i][0] != "end":
        raise CelError(f"unexpected {p.items[p.i][1]!r} in {text!r}")
    return node


def names(node: Node) -> set[str]:
    """Free variables; of a member access, the variable that it starts from."""
    own = {str(node.value)} if node.kind == "name" else set()
    return own.union(*map(names, node.parts))


def members(node: Node, of: str) -> set[str]:
    """Names ``m`` used as ``of.m``."""
    own = {str(node.value)} if node.kind == "member" and node.parts[0] == Node("name", of) else set()
    return own.union(*(members(p, of) for p in node.parts))


FUNCTIONS: dict[str, tuple[int, Callable]] = {
    "abs": (1, F.abs), "sqrt": (1, F.sqrt), "exp": (1, F.exp), "log": (1, F.ln), "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan),
    "asin": (1, F.asin), "acos": (1, F.acos), "atan": (1, F.atan), "tanh": (1, F.tanh), "floor": (1, F.floor), "ceil": (1, F.ceil),
    "pow": (2, F.pow), "atan2": (2, F.atan2), "min": (2, F.least), "max": (2, F.greatest),
    "clamp": (3, lambda x, a, b: F.least(F.greatest(x, a), b)), "double": (1, lambda x: x.cast("double")), "int": (1, lambda x: x.cast("long")),
}


def divide(a: Column, b: Column) -> Column:
    """Division of doubles with infinities and NaN instead of an error."""
    inf = F.lit(math.inf)
    return F.when(b != 0, a / b).when((a == 0) | F.isnan(a), F.lit(math.nan)).otherwise(F.signum(a) * inf)


@dataclass(frozen=True)
class Typed:
    type: str  # double, int, bool, string
    column: Column


def compile(node: Node, scope: Mapping[str, Typed], inner: Mapping[str, Mapping[str, Typed]] | None = None) -> Typed:
    """A column of the expression; ``inner`` holds the members of variables that have any."""
    go = lambda n: compile(n, scope, inner)
    if node.kind == "num":
        return Typed("double" if isinstance(node.value, float) else "int", F.lit(node.value))
    if node.kind in ("str", "bool"):
        return Typed("string" if node.kind == "str" else "bool", F.lit(node.value))
    if node.kind == "name":
        if node.value not in scope:
            raise CelError(f"unknown variable {node.value}")
        return scope[node.value]
    if node.kind == "member":
        base = node.parts[0]
        if base.kind != "name" or not inner or base.value not in inner or node.value not in inner[base.value]:
            raise CelError(f"no member {node.value}")
        return inner[base.value][node.value]
    parts = [go(p) for p in node.parts]
    cols = [p.column for p in parts]
    numeric = all(p.type in ("double", "int") for p in parts)
    wide = [c.cast("double") for c in cols] if any(p.type == "double" for p in parts) else cols
    kind = "double" if any(p.type == "double" for p in parts) else "int"
    if node.kind == "call":
        if node.value not in FUNCTIONS or len(parts) != FUNCTIONS[node.value][0]:
            raise CelError(f"no function {node.value} of {len(parts)} arguments")
        if not numeric:
            raise CelError(f"{node.value} takes numbers")
        out = FUNCTIONS[node.value][1](*[c.cast("double") for c in cols])
        return Typed("int", out) if node.value == "int" else Typed("double", out.cast("double"))
    if node.kind == "unary":
        if node.value == "!" and parts[0].type == "bool":
            return Typed("bool", ~cols[0])
        if node.value == "-" and numeric:
            return Typed(parts[0].type, -cols[0])
        raise CelError(f"{node.value} doesn't apply to {parts[0].type}")
    if node.kind == "choice":
        if parts[0].type != "bool":
            raise CelError("a condition must be bool")
        if parts[1].type != parts[2].type and not {parts[1].type, parts[2].type} <= {"int", "double"}:
            raise CelError("both sides of a choice must have one type")
        same = parts[1].type if parts[1].type == parts[2].type else "double"
        a, b = (c.cast("double") for c in cols[1:]) if same == "double" else cols[1:]
        return Typed(same, F.when(cols[0], a).otherwise(b))
    op = node.value
    if op in ("&&", "||"):
        if any(p.type != "bool" for p in parts):
            raise CelError(f"{op} takes bools")
        return Typed("bool", cols[0] & cols[1] if op == "&&" else cols[0] | cols[1])
    if op in ("==", "!=", "<", "<=", ">", ">="):
        if not numeric and parts[0].type != parts[1].type:
            raise CelError(f"{parts[0].type} and {parts[1].type} don't compare")
        a, b = wide
        out = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if numeric and kind == "double":  # NaN compares with nothing
            nan = F.isnan(a) | F.isnan(b)
            out = (out | nan) if op == "!=" else (out & ~nan)
        return Typed("bool", out)
    if not numeric:
        if op == "+" and all(p.type == "string" for p in parts):
            return Typed("string", F.concat(*cols))
        raise CelError(f"{op} takes numbers")
    a, b = wide
    if op == "/":
        return Typed(kind, divide(a, b) if kind == "double" else F.call_function("div", a.cast("long"), b.cast("long")))
    return Typed(kind, {"+": a + b, "-": a - b, "*": a * b, "%": a % b}[op])


def evaluate(node: Node, scope: Mapping[str, object]) -> object:
    """The value on the driver, for expressions over few numbers; ``scope`` maps names to values or mappings of them."""
    go = lambda n: evaluate(n, scope)
    if node.kind in ("num", "str", "bool"):
        return node.value
    if node.kind == "name":
        return scope[str(node.value)]
    if node.kind == "member":
        return go(node.parts[0])[node.value]
    if node.kind == "choice":
        c = go(node.parts[0])
        if not isinstance(c, bool):
            raise CelError("a condition must be bool")
        return go(node.parts[1]) if c else go(node.parts[2])
    v = [go(p) for p in node.parts]
    if node.kind == "call":
        table = {"abs": abs, "min": min, "max": max, "log": math.log, "ceil": math.ceil, "floor": math.floor, "clamp": lambda x, a, b: min(max(x, a), b), "double": float, "int": int}
        f = table.get(str(node.value)) or getattr(math, str(node.value), None)
        if node.value not in FUNCTIONS or f is None:
            raise CelError(f"no function {node.value}")
        return f(*v)
    if node.kind == "unary":
        if node.value == "!" and isinstance(v[0], bool):
            return not v[0]
        if node.value == "-" and not isinstance(v[0], (bool, str)):
            return -v[0]
        raise CelError(f"{node.value} doesn't apply")
    a, b = v
    op = node.value
    if op in ("&&", "||"):
        if not (isinstance(a, bool) and isinstance(b, bool)):
            raise CelError(f"{op} takes bools")
        return a and b if op == "&&" else a or b
    if isinstance(a, bool) != isinstance(b, bool) or isinstance(a, str) != isinstance(b, str):
        raise CelError("the types of both sides differ")
    if op == "/":
        if isinstance(a, int) and isinstance(b, int):
            return int(a / b)
        return a / b if b else math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op] if op in _BIND and _BIND[op] == 4 else {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: math.fmod(a, b)}[op]()

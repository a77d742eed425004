"""The common expression language (CEL) to Columns.

Grammar and functions follow its public specification: literals, lists, maps, fields,
indexes, calls, macros and the operators, with integers and doubles apart. What has no
Column raises `ExpressionError` when the plan is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """A text that is no expression, or one without a Column."""


_LEX = re.compile(
    r"""\s*(?:(?P<num>0x[0-9a-fA-F]+u?|\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?u?)|(?P<str>[rRbB]{0,2}(?:\"\"\".*?\"\"\"|'''.*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))|(?P<id>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%!<>?:.,()\[\]{}]))""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"', "`": "`", "?": "?", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
_POWER = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "in": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
_MACROS = {"all", "exists", "exists_one", "map", "filter"}


@dataclass(frozen=True)
class Node:
    """kind is lit, var, field, index, call, op, list, map or if; what it holds is in parts."""

    kind: str
    parts: tuple


def _text(token: str) -> str:
    head = re.match(r"[rRbB]*", token).group()
    body = token[len(head) :]
    body = body[3:-3] if body[:3] in ('"""', "'''") else body[1:-1]
    if "r" in head.lower():
        return body
    return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-3][0-7]{2})|(.))", lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else chr(int(m[4], 8)) if m[4] else _ESCAPES.get(m[5], m[5]), body, flags=re.S)


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _LEX.match(text, at)
            if not m:
                raise ExpressionError(f"cannot read {text[at:at + 20]!r} in {text!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self, *ops: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("op", "id") and value in ops

    def take(self, *ops: str) -> bool:
        if self.peek(*ops):
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ExpressionError(f"expected {op!r}, not {self.tokens[self.at][1]!r}")

    def whole(self) -> Node:
        node = self.ternary()
        if self.tokens[self.at][0] != "end":
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def ternary(self) -> Node:
        test = self.binary(1)
        if not self.take("?"):
            return test
        yes = self.ternary()
        self.need(":")
        return Node("if", (test, yes, self.ternary()))

    def binary(self, least: int) -> Node:
        left = self.unary()
        while self.tokens[self.at][0] in ("op", "id") and _POWER.get(self.tokens[self.at][1], 0) >= least:
            op = self.tokens[self.at][1]
            self.at += 1
            left = Node("op", (op, left, self.binary(_POWER[op] + 1)))
        return left

    def unary(self) -> Node:
        if self.take("!"):
            return Node("op", ("!", self.unary()))
        if self.take("-"):
            return Node("op", ("neg", self.unary()))
        return self.postfix(self.primary())

    def postfix(self, node: Node) -> Node:
        while True:
            if self.take("."):
                kind, name = self.tokens[self.at]
                if kind != "id":
                    raise ExpressionError(f"expected a name after '.', not {name!r}")
                self.at += 1
                node = Node("call", (name, node, self.many(")"))) if self.take("(") else Node("field", (node, name))
            elif self.take("["):
                node = Node("index", (node, self.ternary()))
                self.need("]")
            else:
                return node

    def many(self, end: str) -> tuple[Node, ...]:
        out = []
        while not self.take(end):
            out.append(self.ternary())
            if not self.take(","):
                self.need(end)
                break
        return tuple(out)

    def primary(self) -> Node:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            plain = value.rstrip("u")
            return Node("lit", (int(plain, 16) if plain.startswith("0x") else int(plain) if plain.isdigit() else float(plain),))
        if kind == "str":
            return Node("lit", (_text(value),))
        if kind == "id":
            if value in ("true", "false", "null"):
                return Node("lit", ({"true": True, "false": False, "null": None}[value],))
            return Node("call", (value, None, self.many(")"))) if self.take("(") else Node("var", (value,))
        if value == "(":
            node = self.ternary()
            self.need(")")
            return node
        if value == "[":
            return Node("list", self.many("]"))
        if value == "{":
            pairs = []
            while not self.take("}"):
                key = self.ternary()
                self.need(":")
                pairs.append((key, self.ternary()))
                if not self.take(","):
                    self.need("}")
                    break
            return Node("map", tuple(pairs))
        raise ExpressionError(f"unexpected {value or 'end'!r}")


def parse(text: str) -> Node:
    return _Parser(text).whole()


def _dotted(node: Node) -> str | None:
    if node.kind == "var":
        return node.parts[0]
    if node.kind == "field":
        inner = _dotted(node.parts[0])
        return inner and f"{inner}.{node.parts[1]}"
    return None


def names_in(node: Node) -> set[str]:
    """The dotted names that an expression reads, loop variables of macros left out."""

    def walk(n: object, bound: frozenset[str]) -> set[str]:
        if isinstance(n, tuple):
            return set().union(*(walk(x, bound) for x in n)) if n else set()
        if not isinstance(n, Node):
            return set()
        if (name := _dotted(n)) is not None:
            return set() if name.split(".")[0] in bound else {name}
        if n.kind == "call" and n.parts[0] in _MACROS and n.parts[1] is not None and len(n.parts[2]) >= 2:
            own = _dotted(n.parts[2][0])
            return walk(n.parts[1], bound) | walk(n.parts[2][1:], bound | {own})
        return walk(n.parts, bound)

    return walk(node, frozenset())


_TIME: dict[str, Callable[[Column], Column]] = {
    "getFullYear": F.year,
    "getMonth": lambda c: F.month(c) - 1,
    "getDate": F.dayofmonth,
    "getDayOfMonth": lambda c: F.dayofmonth(c) - 1,
    "getDayOfWeek": lambda c: F.dayofweek(c) - 1,
    "getDayOfYear": lambda c: F.dayofyear(c) - 1,
    "getHours": F.hour,
    "getMinutes": F.minute,
    "getSeconds": F.second,
    "getMilliseconds": lambda c: (F.extract(F.lit("SECONDS"), c) * 1000 % 1000).cast("int"),
}
_DURATION = re.compile(r"^(-?)(?:(\d+(?:\.\d+)?)h)?(?:(\d+(?:\.\d+)?)m)?(?:(\d+(?:\.\d+)?)s)?(?:(\d+(?:\.\d+)?)ms)?$")


@dataclass
class Typed:
    """A Column with what is known of its type: int, double, string, bool, list, map, time or None."""

    col: Column
    kind: str | None = None
    literal: object = None


_KINDS = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "double", "float": "double", "string": "string", "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time", "date": "time"}


def kind_of(dtype: str) -> str | None:
    return _KINDS.get(dtype) or ("list" if dtype.startswith("array") else "map" if dtype.startswith(("map", "struct")) else "double" if dtype.startswith("decimal") else None)


class _Build:
    def __init__(self, lookup: Callable[[str], Typed | None]):
        self.lookup = lookup

    def run(self, n: Node, own: Mapping[str, Typed]) -> Typed:
        return getattr(self, f"on_{n.kind}" if n.kind != "if" else "on_choice")(n, own)

    def on_lit(self, n: Node, own) -> Typed:
        v = n.parts[0]
        kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "double" if isinstance(v, float) else "string" if isinstance(v, str) else None
        return Typed(F.lit(v).cast("bigint") if kind == "int" else F.lit(v), kind, v)

    def on_var(self, n: Node, own) -> Typed:
        return self.name(n.parts[0], own)

    def name(self, name: str, own) -> Typed:
        if name in own:
            return own[name]
        got = self.lookup(name)
        if got is None:
            raise ExpressionError(f"unknown name {name!r}")
        return got

    def on_field(self, n: Node, own) -> Typed:
        dotted = _dotted(n)
        if dotted and dotted.split(".")[0] not in own and (got := self.lookup(dotted)) is not None:
            return got
        return Typed(self.run(n.parts[0], own).col.getField(n.parts[1]))

    def on_index(self, n: Node, own) -> Typed:
        base, at = self.run(n.parts[0], own), self.run(n.parts[1], own)
        if at.kind == "string" or base.kind == "map":
            return Typed(base.col.getItem(at.literal) if at.literal is not None else F.element_at(base.col, at.col))
        return Typed(F.get(base.col, at.col.cast("int")))

    def on_list(self, n: Node, own) -> Typed:
        items = [self.run(x, own) for x in n.parts]
        return Typed(F.array(*[i.col for i in items]), "list", [i.literal for i in items] if all(x.kind == "lit" for x in n.parts) else None)

    def on_map(self, n: Node, own) -> Typed:
        return Typed(F.create_map(*[self.run(x, own).col for p in n.parts for x in p]), "map")

    def on_choice(self, n: Node, own) -> Typed:
        test, yes, no = (self.run(x, own) for x in n.parts)
        return Typed(F.when(test.col, yes.col).when(~test.col, no.col), yes.kind if yes.kind == no.kind else None)

    def on_op(self, n: Node, own) -> Typed:
        op, *args = n.parts
        a = self.run(args[0], own)
        if op == "!":
            return Typed(~a.col, "bool")
        if op == "neg":
            return Typed(-a.col, a.kind)
        b = self.run(args[1], own)
        x, y = a.col, b.col
        if op in ("==", "!=") and (args[0].parts == (None,) or args[1].parts == (None,)):
            null = (x if args[1].parts == (None,) else y).isNull()
            return Typed(null if op == "==" else ~null, "bool")
        if op == "in":
            if b.kind == "map":
                return Typed(F.map_contains_key(y, x), "bool")
            return Typed(x.isin(b.literal) if b.literal is not None else F.array_contains(y, x), "bool")
        simple = {"==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y, "&&": lambda: x & y, "||": lambda: x | y}
        if op in simple:
            # text of a time compares with a time
            if {a.kind, b.kind} == {"time", "string"}:
                x, y = (x, F.to_timestamp(y)) if a.kind == "time" else (F.to_timestamp(x), y)
            return Typed(simple[op](), "bool")
        if op == "+" and ("string" in (a.kind, b.kind) or "list" in (a.kind, b.kind)):
            return Typed(F.concat(x, y), a.kind or b.kind)
        kind = "double" if "double" in (a.kind, b.kind) else a.kind or b.kind
        if op == "/":
            # integers are divided toward zero; nothing is divided by zero
            return Typed(F.try_divide(x, y).cast("bigint") if kind == "int" else F.try_divide(x, y), kind)
        if op == "%":
            return Typed(F.try_mod(x, y), kind)
        return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op](), kind)

    def on_call(self, n: Node, own) -> Typed:
        name, target, args = n.parts
        if name == "has" and target is None:
            return Typed(self.run(args[0], own).col.isNotNull(), "bool")
        if name in _MACROS and target is not None:
            return self.macro(name, self.run(target, own), args, own)
        got = [self.run(a, own) for a in args]
        if target is not None:
            return self.method(name, self.run(target, own), got)
        return self.function(name, got)

    def macro(self, name: str, base: Typed, args: tuple[Node, ...], own) -> Typed:
        var = _dotted(args[0])
        if var is None or len(args) not in (2, 3):
            raise ExpressionError(f"{name} takes a variable and an expression")
        over = F.map_keys(base.col) if base.kind == "map" else base.col
        inside = lambda k: lambda c: self.run(args[k], {**own, var: Typed(c)}).col
        if name == "all":
            return Typed(F.forall(over, inside(1)), "bool")
        if name == "exists":
            return Typed(F.exists(over, inside(1)), "bool")
        if name == "exists_one":
            return Typed(F.size(F.filter(over, inside(1))) == 1, "bool")
        if name == "filter":
            return Typed(F.filter(over, inside(1)), "list")
        return Typed(F.transform(F.filter(over, inside(1)), inside(2)) if len(args) == 3 else F.transform(over, inside(1)), "list")

    def method(self, name: str, t: Typed, args: list[Typed]) -> Typed:
        c = t.col
        if name in _TIME:
            return Typed(_TIME[name](F.convert_timezone(None, args[0].col, c) if args else c).cast("bigint"), "int")
        if name in ("contains", "startsWith", "endsWith") and len(args) == 1:
            return Typed(getattr(c, name.lower())(args[0].col), "bool")
        if name == "matches" and len(args) == 1:
            return Typed(F.regexp_like(c, args[0].col), "bool")
        if name == "size" and not args:
            return self.function("size", [t])
        plain = {"lowerAscii": F.lower, "upperAscii": F.upper, "trim": F.trim}
        if name in plain and not args:
            return Typed(plain[name](c), "string")
        if name == "replace" and len(args) == 2:
            return Typed(F.replace(c, args[0].col, args[1].col), "string")
        if name == "split" and len(args) == 1 and isinstance(args[0].literal, str):
            return Typed(F.split(c, re.escape(args[0].literal)), "list")
        raise ExpressionError(f"no method {name!r} of {len(args)} arguments")

    def function(self, name: str, args: list[Typed]) -> Typed:
        if len(args) != 1:
            raise ExpressionError(f"no function {name!r} of {len(args)} arguments")
        a, c = args[0], args[0].col
        if name == "size":
            return Typed((F.size(c) if a.kind in ("list", "map") else F.length(c)).cast("bigint"), "int")
        casts = {"int": ("bigint", "int"), "uint": ("bigint", "int"), "double": ("double", "double"), "string": ("string", "string"), "bool": ("boolean", "bool"), "bytes": ("binary", None), "timestamp": ("timestamp", "time")}
        if name in casts:
            to, kind = casts[name]
            if name == "int" and a.kind == "time":
                return Typed(F.unix_seconds(c.cast("timestamp")), "int")
            return Typed(c.try_cast(to), kind)
        if name == "duration":
            m = _DURATION.match(str(a.literal))
            if not m or not str(a.literal):
                raise ExpressionError("duration takes a literal such as '1h30m'")
            h, mins, s, ms = (float(x or 0) for x in m.groups()[1:])
            return Typed(F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit((-1 if m[1] else 1) * (h * 3600 + mins * 60 + s + ms / 1000)).cast("decimal(18,6)")), "duration")
        if name == "type":
            return Typed(F.typeof(c), "string")
        if name == "dyn":
            return Typed(c)
        raise ExpressionError(f"no function {name!r}")


def to_column(text: str | Node, lookup: Callable[[str], Typed | None]) -> Column:
    """The Column of an expression; `lookup` gives the column of a dotted name, or None."""
    return _Build(lookup).run(parse(text) if isinstance(text, str) else text, {}).col

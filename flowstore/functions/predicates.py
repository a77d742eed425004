"""Conditions as JSON values or expressions, to boolean Columns.

Three forms: field maps (`{"total": {"$gt": 5}, "status": "open"}`), operator trees
(`{"and": [{">": [{"var": "total"}, 5]}, ...]}`) and expression strings. Comparisons with
null are not true, as in SQL; with nulls="lowest" null is a value below all others.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowstore.functions import expressions
from flowstore.functions.names import find, quoted, resolve

COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")
OPERATORS = (*COMPARISONS, "$in", "$nin", "$exists", "$regex", "$contains", "$startsWith", "$endsWith", "$between", "$not")
_TREE = {"==": "$eq", "!=": "$ne", ">": "$gt", ">=": "$gte", "<": "$lt", "<=": "$lte", "in": "$in"}
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


class ConditionError(ValueError):
    """A condition without a meaning."""


def literal(value: object, dtype: str) -> Column:
    """A literal as the type of the column it meets; what cannot be cast is null. Numbers meet as doubles where either has a fraction."""
    if isinstance(value, bool) and dtype != "boolean" and dtype.startswith(_NUMBERS):
        raise ConditionError(f"a truth value for a column of type {dtype}")
    if dtype.startswith(_NUMBERS):
        if isinstance(value, int):
            return F.lit(value)
        return F.lit(value).try_cast("double")
    if dtype in ("timestamp", "date", "timestamp_ntz") and not isinstance(value, (dt.date, dt.datetime)):
        return F.lit(str(value)).try_cast(dtype)
    if dtype == "string" and not isinstance(value, str):
        return F.lit(str(value))
    if dtype == "boolean" and isinstance(value, str):
        return F.lit(value).try_cast("boolean")
    return F.lit(value)


def comparison(c: Column, dtype: str, op: str, value: object, nulls: str = "sql") -> Column:
    """One operator on one column."""
    if op == "$exists":
        return c.isNotNull() if value in (True, 1, "true") else c.isNull()
    if op == "$not":
        return ~_field(c, dtype, value, nulls)
    if op in ("$in", "$nin"):
        if not isinstance(value, (list, tuple, set)):
            raise ConditionError(f"{op} takes a list")
        values = [v for v in value if v is not None]
        hit = c.isin(*[literal(v, dtype) for v in values]) if values else F.lit(False)
        if None in value:
            hit = F.coalesce(hit, F.lit(False)) | c.isNull()
        elif nulls == "lowest":
            hit = F.coalesce(hit, F.lit(False))
        return hit if op == "$in" else ~hit
    if op == "$between":
        low, high = value
        return comparison(c, dtype, "$gte", low, nulls) & comparison(c, dtype, "$lte", high, nulls)
    if op in ("$regex", "$contains", "$startsWith", "$endsWith"):
        if op == "$contains" and dtype.startswith("array"):
            return F.array_contains(c, F.lit(value))
        text = c if dtype == "string" else c.cast("string")
        hit = {"$regex": text.rlike, "$contains": text.contains, "$startsWith": text.startswith, "$endsWith": text.endswith}[op](str(value))
        return F.coalesce(hit, F.lit(False)) if nulls == "lowest" else hit
    if op not in COMPARISONS:
        raise ConditionError(f"unknown operator {op!r}")
    if value is None:
        if op in ("$eq", "$lte"):
            return c.isNull()
        if op in ("$ne", "$gt"):
            return c.isNotNull()
        return F.lit(op == "$gte")
    v = literal(value, dtype)
    plain = {"$eq": c == v, "$ne": c != v, "$gt": c > v, "$gte": c >= v, "$lt": c < v, "$lte": c <= v}[op]
    return F.coalesce(plain, F.lit(op in ("$ne", "$lt", "$lte"))) if nulls == "lowest" else plain


def _field(c: Column, dtype: str, want: object, nulls: str) -> Column:
    if isinstance(want, Mapping) and want and all(str(k).startswith("$") for k in want):
        out = None
        for op, v in want.items():
            one = comparison(c, dtype, op, v, nulls)
            out = one if out is None else out & one
        return out
    return comparison(c, dtype, "$eq", want, nulls)


def validate(condition: object) -> None:
    """Raises for conditions that say nothing or mix up operators and values."""
    if isinstance(condition, str):
        expressions.parse(condition)
        return
    if not isinstance(condition, Mapping) or not condition:
        raise ConditionError("a condition is a map or an expression, and not empty")
    for name, want in condition.items():
        if name in ("and", "or", "$and", "$or"):
            if not isinstance(want, Sequence) or isinstance(want, str) or not want:
                raise ConditionError(f"{name} takes a list of conditions")
            for part in want:
                validate(part)
        elif name in ("not", "$not"):
            validate(want)
        elif name in _TREE:
            if not isinstance(want, Sequence) or len(want) != 2:
                raise ConditionError(f"{name} takes two arguments")
        elif str(name).startswith("$"):
            raise ConditionError(f"operator {name!r} stands in place of a field")
        elif isinstance(want, Mapping):
            if not want:
                raise ConditionError(f"nothing is said about {name!r}")
            signs = [str(k).startswith("$") for k in want]
            if any(signs) and not all(signs):
                raise ConditionError(f"operators and fields are mixed for {name!r}")
            for k in want:
                if str(k).startswith("$") and k not in OPERATORS:
                    raise ConditionError(f"unknown operator {k!r} for {name!r}")
        elif isinstance(want, str) and want.startswith("$") and want[1:].isalpha() and want in OPERATORS:
            raise ConditionError(f"operator {want!r} stands in place of a value for {name!r}")


def lookup(df: DataFrame) -> Callable[[str], expressions.Typed | None]:
    """Names of expressions: columns, and `key`, `value` or `item` before a name."""
    types = dict(df.dtypes)

    def get(name: str) -> expressions.Typed | None:
        got = find(df.columns, name)
        if got is None and name.split(".")[0] in ("item", "value", "key") and "." in name:
            got = find(df.columns, name.split(".", 1)[1])
        return None if got is None else expressions.Typed(quoted(got), expressions.kind_of(types[got]))

    return get


def condition(df: DataFrame, what: object, nulls: str = "sql") -> Column:
    """The Column of a condition over the columns of df."""
    if what is None or what == {}:
        return F.lit(True)
    validate(what)
    if isinstance(what, str):
        return expressions.to_column(what, lookup(df))
    types, out = dict(df.dtypes), None
    for name, want in what.items():
        if name in ("and", "$and", "or", "$or"):
            one = None
            for part in want:
                c = condition(df, part, nulls)
                one = c if one is None else (one & c if "and" in name else one | c)
        elif name in ("not", "$not"):
            one = ~condition(df, want, nulls)
        elif name in _TREE:
            left, right = want
            if not (isinstance(left, Mapping) and "var" in left):
                raise ConditionError(f"the first argument of {name} names a field: {{'var': ...}}")
            field = resolve(df.columns, left["var"])
            if isinstance(right, Mapping) and "var" in right:
                a, b = quoted(field), quoted(resolve(df.columns, right["var"]))
                one = {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[name]
            else:
                one = comparison(quoted(field), types[field], _TREE[name], right, nulls)
        elif isinstance(want, Mapping) and want and not any(str(k).startswith("$") for k in want):
            one = None  # the fields of a composite key
            for sub, v in want.items():
                c = condition(df, {sub if find(df.columns, f"{name}.{sub}") is None else f"{name}.{sub}": v}, nulls)
                one = c if one is None else one & c
        else:
            field = resolve(df.columns, name)
            one = _field(quoted(field), types[field], want, nulls)
        out = one if out is None else out & one
    return out


def shorthand(text: str) -> dict:
    """A condition of `total > 5`, `name = Bob` or `total $gt:5` as a field map; values are truth values, integers, doubles or text, in that order."""
    import re

    m = re.fullmatch(r"\s*([\w.]+)\s*(>=|<=|!=|<>|==|=|>|<|\$(\w+):)\s*(.+?)\s*", text)
    if not m:
        raise ConditionError(f"cannot read {text!r}")
    sign = {">": "$gt", ">=": "$gte", "<": "$lt", "<=": "$lte", "=": "$eq", "==": "$eq", "!=": "$ne", "<>": "$ne"}.get(m[2]) or f"${m[3]}"
    return {m[1]: {sign: value_of(m[4])}}


def value_of(text: str) -> object:
    """A truth value, integer, double or the text without quotes."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


#: Phrases of questions and the operators they stand for, the longest first.
PHRASES = (
    ("greater than or equal to", "$gte"), ("less than or equal to", "$lte"), ("at least", "$gte"), ("at most", "$lte"), ("no less than", "$gte"), ("no more than", "$lte"),
    ("greater than", "$gt"), ("more than", "$gt"), ("above", "$gt"), ("over", "$gt"), ("less than", "$lt"), ("fewer than", "$lt"), ("below", "$lt"), ("under", "$lt"), ("not equal to", "$ne"), ("equal to", "$eq"), ("equals", "$eq"),
)


def from_phrase(question: str, field: str) -> dict | None:
    """`{field: {op: number}}` of the first comparison in a question such as "orders over 500"; None without one."""
    import re

    best = None
    for phrase, op in PHRASES:
        m = re.search(rf"\b{phrase}\s+\$?(-?\d[\d,]*(?:\.\d+)?)", question, re.I)
        if m and (best is None or m.start() < best[0]):
            best = (m.start(), {field: {op: value_of(m[1].replace(",", ""))}})
    return best and best[1]

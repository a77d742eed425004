"""Field names over a fixed list of columns, resolved when a plan is built."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnknownField(ValueError):
    """A name that no column answers to."""


def quoted(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def find(columns: Sequence[str], name: str) -> str | None:
    """The column meant by a name: itself; itself in another case; the only one ending in `.name`; the name without its first dotted part."""
    if name in columns:
        return name
    low = name.lower()
    for c in columns:
        if c.lower() == low:
            return c
    ends = [c for c in columns if c.lower().endswith("." + low)]
    if len(ends) == 1:
        return ends[0]
    if "." in name:
        return find(columns, name.split(".", 1)[1])
    return None


def resolve(columns: Sequence[str], name: str) -> str:
    """As `find`; an unknown or ambiguous name raises, with the nearest names known."""
    got = find(columns, name)
    if got is None:
        short = {c.rsplit(".", 1)[-1]: c for c in columns}
        near = difflib.get_close_matches(name.rsplit(".", 1)[-1], [*columns, *short], n=1, cutoff=0.6)
        raise UnknownField(f"unknown field {name!r}" + (f", did you mean {short.get(near[0], near[0])!r}?" if near else "") + f" Known: {', '.join(columns)}")
    return got


def prefixed(df: DataFrame, name: str) -> DataFrame:
    """Every column as name.column; columns that carry a prefix keep it."""
    return df.toDF(*[c if "." in c else f"{name}.{c}" for c in df.columns])


def collapsed(df: DataFrame) -> DataFrame:
    """Prefixes dropped where the rest of the name is unique among all columns."""
    short = [c.rsplit(".", 1)[-1] for c in df.columns]
    low = [s.lower() for s in short]
    return df.toDF(*[s if low.count(s.lower()) == 1 else c for s, c in zip(short, df.columns)])

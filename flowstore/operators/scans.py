"""Ordered scans, seeks, navigation and paging over the key of a store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowstore.functions.names import prefixed, quoted, resolve
from flowstore.functions.predicates import condition, literal
from flowstore.functions.projections import sort_keys

LIMITS = {"scan": 1000, "select": 100, "join": 10, "fetch": 10, "page": 100}


def ordered(df: DataFrame, keys: Sequence[str], descending: bool = False, index: Sequence[bool] = ()) -> DataFrame:
    """Sorted by key columns, nulls lowest; index tells which key columns descend by themselves."""
    flags = list(index) + [False] * (len(keys) - len(index))
    return df.orderBy(*[(F.desc if f != descending else F.asc)(f"`{k}`") for k, f in zip(keys, flags)])


def scan(
    df: DataFrame, keys: Sequence[str], where: object = None, direction: str = "asc", start_key: object = None,
    prefix: str | None = None, limit: int | None = LIMITS["scan"], nulls: str = "sql",
) -> DataFrame:
    """Matching rows in key order: from start_key on (at or after it; at or before it when descending),
    with keys of the prefix, the first `limit` matches. limit None is all, in no order.
    """
    down = direction.lower().startswith("desc")
    out = df
    if start_key is not None:
        starts = start_key if isinstance(start_key, (list, tuple)) else [start_key]
        out = out.where(_from(df, keys[: len(starts)], starts, down))
    if prefix is not None:
        out = out.where(quoted(keys[0]).cast("string").startswith(prefix))
    if where is not None:
        out = out.where(condition(out, where, nulls))
    return out if limit is None else ordered(out, keys, down).limit(limit)


def _from(df: DataFrame, keys: Sequence[str], values: Sequence[object], down: bool) -> Column:
    """Lexicographically at or beyond the values."""
    types, out = dict(df.dtypes), F.lit(True)
    for k, v in reversed(list(zip(keys, values))):
        c, x = quoted(k), literal(v, types[k])
        out = (c < x if down else c > x) | ((c == x) & out)
    return out


def fetch(df: DataFrame, keys: Sequence[str], key: object = None, prefix: str | None = None, where: object = None, limit: int = LIMITS["fetch"]) -> DataFrame:
    """Rows of one key, or of a key prefix, that match."""
    out = df
    if key is not None:
        out = out.where(condition(df, dict(key) if isinstance(key, dict) else {keys[0]: key}))
    return scan(out, keys, where, prefix=prefix, limit=limit)


def find(df: DataFrame, keys: Sequence[str], key: object) -> DataFrame:
    """One row (found): whether a key exists."""
    hit = df.where(condition(df, dict(key) if isinstance(key, dict) else {keys[0]: key}))
    return hit.limit(1).agg((F.count("*") > 0).alias("found"))


def find_nearest(df: DataFrame, key: str, value: object, descending: bool = False) -> DataFrame:
    """The row of the key; else of the smallest greater key, else of the largest key (of the other way round, descending).

    Two searches of one row each, whose ranges reach the scan; only the better is kept.
    """
    c, v = quoted(key), literal(value, dict(df.dtypes)[key])
    up, down = F.asc(f"`{key}`"), F.desc(f"`{key}`")
    toward = df.where((c <= v) if descending else (c >= v)).orderBy(down if descending else up).limit(1)
    other = df.where((c > v) if descending else (c < v)).orderBy(up if descending else down).limit(1)
    both = toward.withColumn("__beyond", F.lit(0)).unionByName(other.withColumn("__beyond", F.lit(1)))
    return both.orderBy("__beyond").limit(1).drop("__beyond")


def edge(df: DataFrame, keys: Sequence[str], last: bool = False) -> DataFrame:
    """The first or the last row in key order."""
    return ordered(df, keys, last).limit(1)


def neighbours(df: DataFrame, keys: Sequence[str], of: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Every row with the values of columns `of` in the previous and the next row in key order, as previous_c and next_c.

    With partition columns the order is within each partition and the work is spread over
    them; without, one task sorts all rows, as one order has one end.
    """
    w = Window.partitionBy(*[quoted(p) for p in partition]).orderBy(*[quoted(k) for k in keys])
    return df.select("*", *[f(quoted(c)).over(w).alias(f"{n}_{c}") for c in of for n, f in (("previous", F.lag), ("next", F.lead))])


def step(df: DataFrame, keys: Sequence[str], at: object, back: bool = False) -> DataFrame:
    """The row right after a key, or right before it."""
    c, v = quoted(keys[0]), literal(at, dict(df.dtypes)[keys[0]])
    return ordered(df.where(c < v if back else c > v), keys, back).limit(1)


def key_range(df: DataFrame, key: str, low: object, high: object, descending: bool = False) -> DataFrame:
    """Rows with low <= key <= high, in order."""
    t = dict(df.dtypes)[key]
    return ordered(df.where(quoted(key).between(literal(low, t), literal(high, t))), [key], descending)


def page(
    df: DataFrame, keys: Sequence[str], page_offset: int = 0, page_size: int = LIMITS["page"],
    fetch_count: int | None = None, descending: bool = False,
) -> DataFrame:
    """A page in key order: page_offset * page_size rows on, page_size of them (fetch_count, if given)."""
    return ordered(df, keys, descending).offset(page_offset * page_size).limit(fetch_count or page_size)


def page_with_total(df: DataFrame, keys: Sequence[str], page_offset: int, page_size: int) -> DataFrame:
    """A page whose rows also carry the number of all rows, as total_count; one row a page without a shuffle of the rest."""
    total = df.agg(F.count("*").alias("total_count"))
    return page(df, keys, page_offset, page_size).crossJoin(F.broadcast(total))  # the right side is one row


def sort(df: DataFrame, fields: object) -> DataFrame:
    """By names with directions, nulls lowest; a name without a column does not sort."""
    from flowstore.functions.names import find as find_name

    cols = [(find_name(df.columns, n), d) for n, d in sort_keys(fields)]
    return df.orderBy(*[(F.desc if d else F.asc)(f"`{n}`") for n, d in cols if n])


def as_store(df: DataFrame, name: str) -> DataFrame:
    """Columns named store.column, as they come out of a scan."""
    return prefixed(df, name)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in the order: duplicates dropped by priority, or all but the best score."""
    rank = F.row_number().over(Window.partitionBy(*[quoted(resolve(df.columns, k)) for k in keys]).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")

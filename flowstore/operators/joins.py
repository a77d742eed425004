"""Joins of stores on equal fields, through links, and to the nearest key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowstore.functions.names import find, prefixed, quoted, resolve
from flowstore.functions.projections import project, sort_keys
from flowstore.plans.tables import cut
from flowstore.sources.catalog import Relation, StoreMeta

TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "outer": "full", "left_semi": "left_semi", "left_anti": "left_anti"}


def join_type(text: str) -> str:
    """`left`, `left outer`, `left_outer`, `LEFT JOIN` and so on, as Spark names it."""
    plain = text.lower().replace("_", " ").removesuffix(" join").removesuffix(" outer").strip().replace(" ", "_")
    if plain not in TYPES:
        raise ValueError(f"unknown join type {text!r}")
    return TYPES[plain]


def on_pairs(on: object) -> list[tuple[str, str]]:
    """(left, right) of {left: right}, [same, ...] or one name."""
    if isinstance(on, str):
        return [(on, on)]
    return list(on.items()) if isinstance(on, Mapping) else [(f, f) if isinstance(f, str) else tuple(f) for f in on]


def _equal(a: Column, ta: str, b: Column, tb: str, null_safe: bool) -> Column:
    """Equality over the common type: text meets a number as a number, where it is one."""
    if ta != tb and "string" in (ta, tb):
        other = tb if ta == "string" else ta
        if other.startswith(("bigint", "int", "smallint", "tinyint", "double", "float", "decimal")):
            a, b = (x.try_cast("double") if t == "string" else x.cast("double") for x, t in ((a, ta), (b, tb)))
        else:
            a, b = a.cast("string"), b.cast("string")
    return a.eqNullSafe(b) if null_safe else a == b


def join(
    left: DataFrame, right: DataFrame, on: object, how: str = "inner", left_name: str | None = None,
    right_name: str | None = None, null_safe: bool = False,
) -> DataFrame:
    """Columns left.column and right.column of the rows that agree in all pairs of fields.

    Columns that carry a store's prefix keep it. Nulls do not match, unless null_safe.
    Unmatched sides are null, with the same columns. The planner picks the strategy; a
    side is only broadcast below its checked threshold.
    """
    l = prefixed(left, left_name) if left_name else left  # noqa: E741
    r = prefixed(right, right_name) if right_name else right
    clash = {c.lower() for c in l.columns} & {c.lower() for c in r.columns}
    if clash:
        r = r.toDF(*[f"right.{c}" if c.lower() in clash else c for c in r.columns])
    tl, tr, cond = dict(l.dtypes), dict(r.dtypes), None
    for a, b in on_pairs(on):
        x, y = resolve(l.columns, a), resolve(r.columns, b)
        one = _equal(l[f"`{x}`"], tl[x], r[f"`{y}`"], tr[y], null_safe)
        cond = one if cond is None else cond & one
    return l.join(r, cond, join_type(how))


def relation_of(left: StoreMeta, right: StoreMeta) -> list[tuple[str, str]]:
    """The pairs of fields that a declared relation between two stores gives, either way round."""
    for r in left.relations:
        if r.target_store == right.name:
            return list(zip(r.source_fields, r.target_fields))
    for r in right.relations:
        if r.target_store == left.name:
            return [(t, s) for s, t in zip(r.source_fields, r.target_fields)]
    raise ValueError(f"no relation between {left.name!r} and {right.name!r}")


def bridge(
    left: DataFrame, link: DataFrame, right: DataFrame, left_key: str, right_key: str, names: tuple[str, str, str],
    link_fields: tuple[str, str] = ("key", "value"), how: str = "inner",
) -> DataFrame:
    """Left to right through a store of links (left key, right key)."""
    a = join(left, link, {left_key: link_fields[0]}, how, names[0], names[1])
    return join(a, right, {f"{names[1]}.{link_fields[1]}": right_key}, how, None, names[2])


def select_join(
    left: DataFrame, right: DataFrame, left_name: str, right_name: str, left_fields: Sequence[str],
    right_fields: Sequence[str], how: str = "inner", fields: object = None, order_by: object = None,
    limit: int | None = 10,
) -> DataFrame:
    """The one-call join: fields may name either side; order_by sorts the whole result; the first `limit` rows."""
    names = (left_name, right_name if right_name != left_name else f"{right_name}_2")
    out = join(left, right, list(zip(left_fields, right_fields)), how, *names)
    sides = {"left": names[0], "a": names[0], "right": names[1], "b": names[1]}
    if order_by:
        keys = [(find(out.columns, _side(n, sides)), d) for n, d in sort_keys(order_by)]
        out = out.orderBy(*[(F.desc if d else F.asc)(f"`{n}`") for n, d in keys if n])
    if limit is not None:
        out = out.limit(limit)
    return project(out, fields or ["*"], sides)


def _side(name: str, sides: Mapping[str, str]) -> str:
    head, _, rest = name.partition(".")
    return f"{sides[head]}.{rest}" if rest and head in sides else name


def asof(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, columns: Sequence[str],
    strict: bool = False, span: float | None = None,
) -> DataFrame:
    """Every left row with `columns` of the last right row of the same `by` at or before it (before it, if strict).

    Both sides are put in one order and the last right row is carried on: one shuffle by
    `by`, no pairs. Of right rows at one time the greatest holds. With span (seconds, or
    units of a number) a `by` with many rows is divided into spans of that length, which
    are ordered one by one; what each begins with comes from the last row of each before.
    """
    kept = [c for c in columns]
    l = left.withColumn("__at", quoted(left_at)).withColumn("__side", F.lit(0 if strict else 1))  # noqa: E741
    r = right.select(*[quoted(b) for b in by], quoted(right_at).alias("__at"), F.lit(1 if strict else 0).alias("__side"), F.struct(*[quoted(c) for c in kept]).alias("__got"))
    both = l.unionByName(r, allowMissingColumns=True)
    if span is None:
        both, own = both.withColumn("__last", F.lit(None).cast(r.schema["__got"].dataType)), [quoted(b) for b in by]
    else:
        at = F.col("__at").cast("timestamp").cast("double") if dict(both.dtypes)["__at"].startswith(("date", "timestamp")) else F.col("__at").cast("double")
        both = both.withColumn("__span", F.floor(at / span))
        keys = [f"__k{i}" for i in range(len(by))]
        ends = both.groupBy(*[quoted(b).alias(k) for b, k in zip(by, keys)], F.col("__span").alias("__own")).agg(F.max(F.when(F.col("__got").isNotNull(), F.struct("__at", "__got"))).alias("__end"))
        before = Window.partitionBy(*keys).orderBy(F.col("__own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, "__own", F.last("__end", ignorenulls=True).over(before)["__got"].alias("__last"))  # one row a span
        same = reduce(lambda a, b: a & b, [*[quoted(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)], F.col("__span").eqNullSafe(F.col("__own"))])
        both, own = both.join(ends, same, "left"), [*[quoted(b) for b in by], F.col("__span")]
    w = Window.partitionBy(*own).orderBy("__at", "__side", F.col("__got").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("__last", F.coalesce(F.last("__got", ignorenulls=True).over(w), "__last")).where(F.col("__side") == (0 if strict else 1))
    return carried.select(*[quoted(c) for c in left.columns], *[F.col("__last").getField(c).alias(f"asof_{c}") for c in kept])


def within(
    left: DataFrame, right: DataFrame, by: Sequence[str], at: str, start: str, end: str, columns: Sequence[str],
    how: str = "inner", unit: float = 1.0,
) -> DataFrame:
    """Every left row with `columns` of each right row of the same `by` with start <= at < end; how is inner, or left, which keeps rows that are in none.

    at, start and end are numbers, dates or timestamps (then unit is seconds). An interval
    has a level by its length, bins of `unit` times a power of two, of which it meets two at
    most, whatever its length; a left row looks into one bin of each level there
    is, of which there are at most 64 for lengths from unit on. So both sides are joined on
    equal keys, and no pair is made that is not in one bin. Empty and null intervals, and
    a null at, match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no {how!r} join within intervals")

    def number(df: DataFrame, c: str) -> Column:
        return quoted(c).cast("timestamp").cast("double") if dict(df.dtypes)[c].startswith(("date", "timestamp")) else quoted(c).cast("double")

    keys = [f"__b{i}" for i in range(len(by))]
    held = [quoted(b).alias(k) for b, k in zip(by, keys)]
    spans = right.where(quoted(start) < quoted(end)).select(*held, number(right, start).alias("__s"), number(right, end).alias("__e"), F.struct(*[quoted(c) for c in columns]).alias("__got"))
    spans = spans.withColumn("__level", F.greatest(F.lit(0), F.ceil(F.log2((F.col("__e") - F.col("__s")) / unit))).cast("int"))
    width = F.lit(float(unit)) * F.pow(F.lit(2.0), F.col("__level"))
    bins = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__s") / width), F.floor(F.col("__e") / width))))
    levels = sorted(row[0] for row in spans.select("__level").distinct().collect() if row[0] is not None)
    rows = left.select(F.struct(*[quoted(c) for c in left.columns]).alias("__row"), *held, number(left, at).alias("__x"), F.monotonically_increasing_id().alias("__n"))
    rows = cut(rows) if how == "left" else rows  # written once, so that the numbers stay
    asked = rows.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("__bin", F.floor(F.col("__x") / width))
    hits = asked.join(bins, [*keys, "__level", "__bin"]).where("__s <= __x and __x < __e").select("__n", "__row", "__got")
    if how == "left":
        none = rows.join(hits.select("__n").distinct(), "__n", "left_anti").select("__n", "__row", F.lit(None).cast(hits.schema["__got"].dataType).alias("__got"))
        hits = hits.unionByName(none)
    return hits.select("__row.*", *[F.col("__got").getField(c).alias(f"in_{c}") for c in columns])


def explain_join(left: StoreMeta, right: StoreMeta, left_fields: Sequence[str], right_fields: Sequence[str]) -> list[str]:
    """What a join can use: whether the right fields are its key, a prefix of it, or break it off."""
    keys = list(right.key_fields)
    n = next((i for i, k in enumerate(keys) if k not in right_fields), len(keys))
    if n == len(keys) and keys:
        note = f"seek: the fields cover the key of {right.name}"
    elif n:
        note = f"seek by prefix: {', '.join(keys[:n])} of the key of {right.name}; {', '.join(keys[n:])} is open"
    else:
        broken = [k for k in keys if k in right_fields]
        note = f"hash: no prefix of the key of {right.name}" + (f" ({', '.join(broken)} stands after {keys[0]})" if broken else "")
    return [f"{left.name}.{a} = {right.name}.{b}" for a, b in zip(left_fields, right_fields)] + [note]


__all__ = ["Relation", "asof", "bridge", "explain_join", "join", "join_type", "on_pairs", "relation_of", "select_join", "within"]

"""Groups, distinct rows, cubes and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowstore.functions.names import quoted, resolve
from flowstore.functions.predicates import condition

FUNCTIONS = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct, "approx_count_distinct": F.approx_count_distinct, "stddev": F.stddev, "first": F.first, "last": F.last, "collect": F.collect_list}


def measures(df: DataFrame, aggregates: Mapping[str, object]) -> list[Column]:
    """Columns of {alias: "sum(x)" | {"sum": "x"} | "count(*)"}."""
    out = []
    for alias, what in aggregates.items():
        if isinstance(what, str):
            name, _, arg = what.rstrip(")").partition("(")
        else:
            ((name, arg),) = what.items()
        name = name.strip().lower()
        if name not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {name!r}")
        arg = arg.strip() or "*"
        out.append((F.count("*") if arg == "*" else FUNCTIONS[name](quoted(resolve(df.columns, arg)))).alias(alias))
    return out


def group(
    df: DataFrame, by: Sequence[str], aggregates: Mapping[str, object], having: object = None, kind: str = "plain",
    sets: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """One row a group (plain), or a subtotal for every subset (cube) or prefix (rollup) of the names, or
    for each of `sets` of them; `having` filters the result.
    """
    cols = {b: quoted(resolve(df.columns, b)).alias(b) for b in by}
    if sets is not None:
        # by plain columns: an alias is not told to be the same in a set
        df = df.withColumns({b: c for b, c in cols.items() if resolve(df.columns, b) != b})
        start = df.groupingSets([[quoted(b) for b in one] for one in sets], *[quoted(b) for b in by])
    else:
        start = {"plain": df.groupBy, "cube": df.cube, "rollup": df.rollup}[kind](*cols.values())
    out = start.agg(*measures(df, aggregates))
    return out if having is None else out.where(condition(out, having))


def distinct(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or distinct values of some fields."""
    return (df.select(*[quoted(resolve(df.columns, f)).alias(f) for f in fields]) if fields else df).distinct()


def union(parts: Sequence[DataFrame], dedupe: Sequence[str] = (), best: str | None = None) -> DataFrame:
    """All rows of all parts, missing columns null; with dedupe one row for each of its values: that with the highest `best`, or that of the earliest part."""
    from flowstore.operators.scans import first_by

    out = None
    for i, p in enumerate(parts):
        one = p.withColumn("__part", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if dedupe:
        out = first_by(out, dedupe, [*([F.col(best).desc()] if best else []), F.col("__part").asc()])
    return out.drop("__part")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame, keep_repeats: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_repeats else a.subtract(b)

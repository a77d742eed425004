"""Changes to stores, as new DataFrames: nothing is changed in place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstore.functions.names import quoted, resolve
from flowstore.functions.predicates import condition


def _one_each(rows: DataFrame, key: Sequence[str], last: bool, order: str | None) -> DataFrame:
    """The first or last row of each key, by `order` or as the rows come; combined before the shuffle. Null keys are keys like others."""
    at = quoted(order) if order else F.monotonically_increasing_id()
    whole = F.struct(*[quoted(c) for c in rows.columns]).alias("__r")
    pick = F.max_by if last else F.min_by
    return rows.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(key)], whole, at.alias("__at")).groupBy(*[f"__k{i}" for i in range(len(key))]).agg(pick("__r", "__at").alias("__r")).select("__r.*")


def _without(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of df whose key is not among the keys; null equals null."""
    other = keys.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(key)])
    same = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)])
    return df.join(other, same, "left_anti")


def add(df: DataFrame, new: DataFrame, key: Sequence[str], unique: bool = True, order: str | None = None) -> DataFrame:
    """With the new rows; in a unique store, without those whose key exists, and with the first of a key that repeats, by `order` or as they come."""
    fresh = _one_each(_without(new, df, key), key, False, order) if unique else new
    return df.unionByName(fresh.select(*[quoted(c) if c in new.columns else F.lit(None).alias(c) for c in df.columns]))


def upsert(df: DataFrame, new: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """New rows take the place of all of the same key, others are added. Of new rows of one key the last
    counts, by `order` or as they come; a null key is a key.
    """
    latest = _one_each(new, key, True, order)
    kept = _without(df, latest, key).select(*[quoted(c) for c in df.columns])
    return kept.unionByName(latest.select(*[quoted(c) for c in df.columns if c in latest.columns]), allowMissingColumns=True).select(*[quoted(c) for c in df.columns])


def update(df: DataFrame, where: object, values: Mapping[str, object]) -> DataFrame:
    """Values set in the rows that match; a value is a literal or a Column."""
    hit = F.coalesce(condition(df, where), F.lit(False))
    sets = {resolve(df.columns, k): v for k, v in values.items()}
    types = dict(df.dtypes)
    return df.select(*[F.when(hit, (v if hasattr(v, "alias") else F.lit(v)).cast(types[c])).otherwise(quoted(c)).alias(c) if (v := sets.get(c, Ellipsis)) is not Ellipsis else quoted(c) for c in df.columns])


def update_from(df: DataFrame, new: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Values of the new rows merged into the rows of the same key, of repeated keys the last by `order` or
    as they come; columns that are null there stay. A null key matches nothing.
    """
    changed = [c for c in new.columns if c not in key and c != order]
    n = _one_each(new, key, True, order).select(*[quoted(k) for k in key], *[quoted(c).alias(f"__new_{c}") for c in changed])
    out = df.join(n, list(key), "left")
    return out.select(*[F.coalesce(quoted(f"__new_{c}"), quoted(c)).alias(c) if c in changed else quoted(c) for c in df.columns])


def delete(df: DataFrame, where: object) -> DataFrame:
    """Without the rows that match."""
    return df.where(~F.coalesce(condition(df, where), F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Without the rows whose key is among `keys`."""
    return df.join(keys.select(*[quoted(k) for k in key]), list(key), "left_anti").select(*[quoted(c) for c in df.columns])


def rekey(df: DataFrame, key: str, old: object, new: object) -> DataFrame:
    """One key changed to another, unless that exists."""
    taken = df.where(condition(df, {key: new})).limit(1).select(F.lit(1).alias("__taken"))
    probe = df.join(taken, how="left")  # one row at most on the right
    hit = condition(df, {key: old}) & F.col("__taken").isNull()
    return probe.select(*[F.when(hit, F.lit(new).cast(dict(df.dtypes)[key])).otherwise(quoted(c)).alias(c) if c == key else quoted(c) for c in df.columns])


def chunk(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """(key, chunk_index, data): a long text or binary value in pieces of at most `size`, as large values are stored; an empty one is one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length(quoted(value)) / size)).cast("int")
    parts = df.where(quoted(value).isNotNull()).select(quoted(key).alias("key"), quoted(value).alias("v"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return parts.select("key", "chunk_index", F.substring(F.col("v"), F.col("chunk_index") * size + 1, F.lit(size)).alias("data"))


def assemble(chunks: DataFrame) -> DataFrame:
    """(key, value) of texts or binary values in chunks."""
    got = chunks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "data"))).alias("c"))
    data = F.transform("c", lambda x: x["data"])
    if dict(chunks.dtypes)["data"] == "binary":
        # hexadecimal text keeps every byte while the pieces are joined
        return got.select("key", F.unhex(F.array_join(F.transform(data, F.hex), "")).alias("value"))
    return got.select("key", F.array_join(data, "").alias("value"))

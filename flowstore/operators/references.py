"""References to records that do not exist, are deleted, or came later."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def orphan_references(
    child: DataFrame,
    parent: DataFrame,
    pairs: Sequence[tuple[str, str]],
    match: str = "simple",
    parent_deleted: str | None = None,
    parent_since: str | None = None,
    child_at: str | None = None,
) -> DataFrame:
    """Rows of `child` whose reference has no valid target, with the column `reason`.

    pairs: (child column, parent column), of any number. The references are grouped by
    which of their columns are null; each such mask is looked up on its non-null columns
    only, against the parent reduced to one row for each value of these columns. What a
    partly null reference means is declared by `match`, as in SQL's MATCH:

    * simple: a reference with a null in it refers to nothing and is valid;
    * partial: the non-null columns must occur together in some parent row;
    * full: either all columns are null (valid) or none; a mixture has reason `mixed`.

    An all-null reference is always valid. Reasons: `missing` if no parent row matches;
    else `deleted` if `parent_deleted` (a boolean column) holds in every matching row;
    else `late` if the earliest `parent_since` is after `child_at`. A null `parent_since`
    or `child_at` is never late. Repeated parent rows count as one, repeated child rows
    are all returned; an empty parent makes every reference missing, an empty child gives
    no rows. Parent columns never enter the result, so names may clash freely.

    The parent is aggregated (with map-side combine) before its shuffle. The child is
    shuffled once for each mask that the match semantics must look up; the adaptive planner
    splits a hot key, as the other side has one row for it.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}, not {match!r}")
    if not pairs:
        raise ValueError("a reference needs at least one column")
    ours = [c for c, _ in pairs]
    rows = child.withColumn("__key", F.lit(None).cast("string"))
    out = None
    for mask in product((False, True), repeat=len(pairs)):  # True: null
        if all(mask) or (any(mask) and match == "simple"):
            continue
        group = rows.where(" and ".join(f"`{c}` is {'null' if m else 'not null'}" for c, m in zip(ours, mask)))
        if any(mask) and match == "full":
            bad = group.drop("__key").withColumn("reason", F.lit("mixed"))
        else:
            held = [p for p, m in zip(pairs, mask) if not m]
            # to_json keeps the columns apart, whatever they contain; a single string is its own key
            key = lambda side: F.col(f"`{held[0][side]}`").cast("string") if len(held) == 1 else F.to_json(F.array(*[F.col(f"`{p[side]}`").cast("string") for p in held]))
            targets = parent.where(" and ".join(f"`{p}` is not null" for _, p in held)).select(
                key(1).alias("__key"),
                (F.coalesce(F.col(f"`{parent_deleted}`"), F.lit(False)) if parent_deleted else F.lit(False)).alias("d"),
                (F.col(f"`{parent_since}`") if parent_since else F.lit(None).cast("timestamp")).alias("t"),
            )
            targets = targets.groupBy("__key").agg(F.lit(True).alias("__found"), F.min("d").alias("__gone"), F.min("t").alias("__since"))
            late = F.col("__since") > F.col(f"`{child_at}`") if child_at and parent_since else F.lit(False)
            reason = F.when(F.col("__found").isNull(), "missing").when(F.col("__gone"), "deleted").when(late, "late")
            joined = group.withColumn("__key", key(0)).join(targets, "__key", "left")
            bad = joined.withColumn("reason", reason).where("reason is not null").drop("__key", "__found", "__gone", "__since")
        out = bad if out is None else out.unionByName(bad)
    return out if out is not None else child.withColumn("reason", F.lit(None).cast("string")).where("false")


def orphan_report(orphans: DataFrame, table: str, at: str) -> DataFrame:
    """(table_name, period, reason, n): orphans counted by table column, month and reason; a null time has a null period."""
    return orphans.groupBy(F.col(f"`{table}`").alias("table_name"), F.date_format(F.col(f"`{at}`"), "yyyy-MM").alias("period"), "reason").agg(F.count("*").alias("n"))

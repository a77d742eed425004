"""Content policies over labels and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowstore.functions.names import quoted

#: The preset's words and threshold.
PROFANITY, THRESHOLD = r"(?i)\b(slut|idiot|stupid|damn|hell|ass|bitch|fuck)\b", 0.9


def labelled(text: Column | str, rules: Mapping[str, str]) -> Column:
    """Labels whose expression is found in the text, in the order of the rules."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_compact(F.array(*[F.when(c.rlike(form), F.lit(name)) for name, form in rules.items()]))


def threshold(label: Column | str, score: Column | str, blocked: Sequence[str], least: float) -> Column:
    """`block` for a blocked label with a score of at least `least`, else `allow`."""
    label, score = (F.col(c) if isinstance(c, str) else c for c in (label, score))
    return F.when(label.isin(*blocked) & (score >= least), "block").otherwise("allow")


def chain(*decisions: Column) -> Column:
    """The first decision that blocks; `allow` if none does."""
    return F.coalesce(*[F.when(d == "block", d) for d in decisions], F.lit("allow"))


def strikes(turns: DataFrame, session: str, order: Sequence[str], violation: Column, is_input: Column, most: int, span: float | None = None) -> DataFrame:
    """turns with strikes, locked and decision.

    Only inputs count: a violating one adds a strike, a clean one sets them to 0; at
    `most` strikes the session is locked for good. decision is block for a violation or in
    a locked session. Sessions are windows of their own; strikes are the length of the run
    of violating inputs since the last clean one. With span (seconds, or units of the first
    of `order`) a session of many turns is divided into spans, which are ordered one by
    one; the strikes and the lock that each begins with come from one row for each before.
    """
    base = turns.withColumn("__v", F.coalesce(violation, F.lit(False))).withColumn("__i", F.coalesce(is_input, F.lit(False)))
    own = [quoted(session)]
    if span is not None:
        first = quoted(order[0])
        at = first.cast("timestamp").cast("double") if dict(turns.dtypes)[order[0]].startswith(("date", "timestamp")) else first.cast("double")
        base, own = base.withColumn("__span", F.floor(at / span)), [*own, F.col("__span")]
    w = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = Window.partitionBy(*own, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = base.withColumn("__run", F.sum(F.when(F.col("__i") & ~F.col("__v"), 1).otherwise(0)).over(w))
    counted = base.withColumn("strikes", F.sum(F.when(F.col("__i") & F.col("__v"), 1).otherwise(0)).over(run))
    if span is not None:
        spans = counted.groupBy(quoted(session).alias("__s"), F.col("__span").alias("__p")).agg(F.max("__run").alias("clean"), F.max_by("strikes", F.struct(*[quoted(o) for o in order])).alias("last"))
        before = Window.partitionBy("__s").orderBy(F.col("__p").asc_nulls_first())
        # strikes go on over spans without a clean input
        spans = spans.withColumn("part", F.sum((F.col("clean") > 0).cast("int")).over(before))
        so_far = F.sum("last").over(Window.partitionBy("__s", "part").orderBy(F.col("__p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        spans = spans.withColumn("__carried", so_far).select("__s", "__p", F.coalesce(F.lag("__carried").over(before), F.lit(0)).alias("__carried"))
        same = quoted(session).eqNullSafe(F.col("__s")) & F.col("__span").eqNullSafe(F.col("__p"))
        counted = counted.join(spans, same, "left").withColumn("strikes", F.col("strikes") + F.when(F.col("__run") == 0, F.col("__carried")).otherwise(0)).drop("__s", "__p", "__carried")
    hit = F.col("__v") & (F.col("strikes") >= most)
    out = counted.withColumn("locked", F.max(hit).over(w))
    if span is not None:
        locks = counted.groupBy(quoted(session).alias("__s"), F.col("__span").alias("__p")).agg(F.max(hit).alias("l"))
        earlier = F.coalesce(F.max("l").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        out = out.join(locks.select("__s", "__p", earlier.alias("__earlier")), same, "left").withColumn("locked", F.col("locked") | F.col("__earlier")).drop("__s", "__p", "__earlier", "__span")
    return out.withColumn("decision", F.when(F.col("__v") | F.col("locked"), "block").otherwise("allow")).drop("__v", "__i", "__run")

"""Mixing sources to target weights by exact cuts of hash-ordered prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equal ranges of the random keys; prefix sums are over ranges, and only the range of the cut is sorted.
RANGES = 4096
#: Sums of sources and ranges that are broadcast, at most.
SENT = 1 << 20


def source_name(c: Column | str) -> Column:
    """The source in one spelling: trimmed, lower case, hyphens and blanks as underscores."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def mix_sources(rows: DataFrame, key: str, source: str, size: str, targets: DataFrame, ranges: int = RANGES, seed: int = 1, short: bool = False) -> DataFrame:
    """(key, source, size, uses) of each row that the mixture uses, `uses` times.

    targets: (source, target_share, max_repeats), one row a source, shares that sum to 1.
    The mixture is the largest in which every source can give its share of the total size
    and no row is used more than max_repeats times: the source with the least
    max_repeats * size / share sets the total. With `short` the total is the size of all
    usable rows of sources with a share, whatever the scarcest source has: a source that
    cannot give its share within max_repeats gives all it can and falls short, and the
    others keep their budgets; `mixture_report` tells the shares reached.

    A source's budget is its share of the total; it gives all its rows as often as they fit, and once more the rows at the
    head of its random order, cut at the budget: the row on which the budget ends is
    used if most of it lies within, so that a source is off by half a row at most.

    Sources are compared in one spelling. Rows of a null or unlisted source, or of one
    with no share, and rows without a size or of size 0 or less, are not used. A source
    that has a share but no rows makes the mixture empty unless `short` is set, as does an
    empty table in any case. A null key is a key like others; repeated rows are rows of their own; equal random keys
    follow the key. Other columns are ignored.

    The random key is a hash of key and size. Sums by source and range are combined
    before the shuffle, prefix sums run over at most `ranges` sums a source, and only rows
    in the one range of a source in which its budget ends are sorted. So a source with a
    third of all rows costs no task more than others.
    """
    t = targets.select(source_name("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most")).where("share > 0 and most > 0")
    picked = rows.select(F.col(f"`{key}`").alias("key"), source_name(F.col(f"`{source}`").cast("string")).alias("source"), F.col(f"`{size}`").cast("long").alias("size")).where("size > 0 and source is not null")
    picked = picked.withColumn("rnd", F.xxhash64("key", "size", F.lit(seed)))
    # the top bits, as an unsigned number, name the range
    width = max(1, ranges.bit_length() - 1)
    picked = picked.withColumn("range", F.shiftrightunsigned("rnd", 64 - width).cast("int"))
    sums = picked.groupBy("source", "range").agg(F.sum("size").alias("n"))
    whole = sums.groupBy("source").agg(F.sum("n").alias("have"))
    # one row a source from here on: as many as targets
    plan = t.join(whole, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    total = plan.agg((F.sum("have") if short else F.min(F.col("most") * F.col("have") / F.col("share"))).alias("total"))
    plan = plan.crossJoin(total).where("total > 0 and have > 0")  # one row against one a source
    plan = plan.withColumn("budget", F.least(F.floor(F.col("share") * F.col("total") + 1e-6), F.col("most") * F.col("have"))).withColumn("rounds", F.least(F.floor(F.col("budget") / F.col("have")).cast("int"), "most"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("rounds") * F.col("have")).withColumn("extra", F.col("rounds") < F.col("most")).select("source", "rounds", "rest", "extra")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = sums.withColumn("before", before).join(plan, "source")
    state = F.when(~F.col("extra") | (F.col("before") >= F.col("rest")), "none").when(F.col("before") + F.col("n") <= F.col("rest"), "all").otherwise("cut")
    prefix = prefix.select("source", "range", "rounds", state.alias("state"), (F.col("rest") - F.col("before")).alias("room"))
    # at most sources x ranges rows, a bound that does not grow with the data; broadcast if that is few
    joined = picked.join(F.broadcast(prefix) if targets.count() * ranges <= SENT else prefix, ["source", "range"])
    flat = joined.where("state <> 'cut'").select("key", "source", "size", (F.col("rounds") + F.when(F.col("state") == "all", 1).otherwise(0)).alias("uses"))
    # unsigned order within a range is signed order, as the top bits agree
    run = F.sum("size").over(Window.partitionBy("source").orderBy("rnd", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = joined.where("state = 'cut'").withColumn("run", run).select("key", "source", "size", (F.col("rounds") + (2 * F.col("run") - F.col("size") < 2 * F.col("room")).cast("int")).alias("uses"))
    return flat.unionByName(edge).where("uses > 0")


def mixture_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, size, rows_used, most_uses) of every target, with zeros where it gave nothing."""
    t = targets.select(source_name("source").alias("source"), F.col("target_share").cast("double").alias("target_share"))
    got = mixture.groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("size"), F.count("*").alias("rows_used"), F.max("uses").alias("most_uses"))
    total = got.agg(F.sum("size").alias("total"))
    filled = t.join(got, "source", "left").crossJoin(total)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return filled.select("source", "target_share", F.coalesce(F.col("size") / F.col("total"), F.lit(0.0)).alias("actual_share"), zero("size").alias("size"), zero("rows_used").alias("rows_used"), zero("most_uses").alias("most_uses"))

"""Parent-child rows to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstore.plans.tables import cut

#: States of a node's way up.
OPEN, ROOT, CYCLE = 0, 1, 2


def resolve_hierarchy(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", label_col: str | None = None, sep: str = "/") -> DataFrame:
    """(id, parent, root_id, depth, path, ancestors) of each distinct non-null id.

    A node whose parent is null or has no row is a root of depth 0, and its root_id is its
    own id. `path` holds the labels (the ids without `label_col`; a null label is empty)
    from the root down, joined by `sep`; `ancestors` the ids from the root down, without
    the node. A node whose way up runs into a cycle, or is on one, has depth -1, root_id
    the smallest id on that cycle, and null path and ancestors. Where an id repeats, the
    row of the smallest (parent, label) holds, a null parent last; callers pick the valid
    row before. An empty table gives no rows; other columns are ignored.

    Each node keeps a pointer to an ancestor and the ids and labels on the way. A round
    joins the pointers of the open nodes with those of their targets, which doubles every
    distance. Nodes that reached a root leave the open set, and so do those whose way
    meets an id twice, or leads to such a node: they have run into a cycle. A way closes
    after as many rounds as its length has binary digits, and no array grows beyond twice
    its length. The nodes of a cycle close in one round, each with the smallest id of all.
    """
    col = lambda c: F.col(f"`{c}`").cast("string")
    nodes = rows.select(col(id_col).alias("id"), col(parent_col).alias("parent"), (col(label_col) if label_col else col(id_col)).alias("label")).where("id is not null")
    nodes = nodes.groupBy("id").agg(F.min(F.struct(F.col("parent").isNull().alias("n"), "parent", "label")).alias("r")).select("id", "r.parent", F.coalesce("r.label", F.lit("")).alias("label"))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    # the known side has one row an id, so that the adaptive planner can split a parent of many
    start = nodes.join(known, "parent", "left")
    is_root = F.col("known").isNull()
    start = start.select(
        "id",
        F.when(~is_root, F.col("parent")).alias("parent"),
        F.when(is_root, F.col("id")).otherwise(F.col("parent")).alias("anc"),
        F.when(is_root, ROOT).when(F.col("id") == F.col("parent"), CYCLE).otherwise(OPEN).alias("state"),
        F.when(is_root, F.array().cast("array<string>")).otherwise(F.array("parent")).alias("ids"),
        F.array("label").alias("labels"),
        F.when(is_root, F.col("id")).otherwise(F.least("id", "parent")).alias("least"),
    )
    # what each round wrote: the nodes that were open before it, of which the closed ones stay as they are
    written = [cut(start)]
    while not written[-1].where(F.col("state") == OPEN).isEmpty():
        now = _latest(written)
        target = now.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("state").alias("state2"), F.col("ids").alias("ids2"), F.col("labels").alias("labels2"), F.col("least").alias("least2"))
        went = written[-1].where(F.col("state") == OPEN).join(target, "anc", "left")
        went = went.withColumn("ids", F.when(F.col("state2") != CYCLE, F.concat("ids2", "ids")))
        twice = F.size(F.array_distinct(F.array_append("ids", F.col("id")))) <= F.size("ids")
        state = F.when(F.col("state2") == OPEN, F.when(twice, CYCLE).otherwise(OPEN)).otherwise(F.col("state2"))
        written.append(cut(went.select("id", "parent", F.col("anc2").alias("anc"), state.alias("state"), "ids", F.when(F.col("state2") != CYCLE, F.concat("labels2", "labels")).alias("labels"), F.least("least", "least2").alias("least"))))
    now = _latest(written)
    looped = now.where(F.col("state") == CYCLE)
    least = looped.select(F.col("id").alias("anc"), F.col("least").alias("cycle"))
    looped = looped.select("id", "parent", "anc").join(least, "anc", "left")
    none = F.lit(None)
    return (
        now.where(F.col("state") == ROOT)
        .select("id", "parent", F.col("anc").alias("root_id"), F.size("ids").alias("depth"), F.array_join("labels", sep).alias("path"), F.col("ids").alias("ancestors"))
        .unionByName(looped.select("id", "parent", F.col("cycle").alias("root_id"), F.lit(-1).alias("depth"), none.cast("string").alias("path"), none.cast("array<string>").alias("ancestors")))
    )


def _latest(written: list[DataFrame]) -> DataFrame:
    """Every node as its last round left it."""
    out = written[-1]
    for part in written[:-1]:
        out = out.unionByName(part.where(F.col("state") != OPEN))
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of every pair in the result of `resolve_hierarchy`, without nodes that run into cycles."""
    return tree.where("depth > 0").select(F.posexplode("ancestors").alias("at", "ancestor_id"), F.col("id").alias("descendant_id"), "depth").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))

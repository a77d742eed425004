"""Filling fixed-capacity containers by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstore.llm.vectors import runs, whole_groups
from flowstore.plans.tables import cut

CAPACITY = 2048
#: Items that one lane packs, and containers at least so full that they are not packed again.
LANE, FULL = 20_000, 0.995


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each item, packed in the given order, numbered in the order of opening.

    N[h] is the number of open containers filled to h. An item of size s goes where the
    sum of N[h]^2 over partial fills becomes least: into a container filled to h with
    h + s <= capacity, or into a new one; of equal choices into the fullest. Sizes are
    between 1 and the capacity.
    """
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, opened = np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        h = np.arange(1, capacity - s + 1)
        best, at = 2 * int(count[s]) + 1 if s < capacity else 0, 0  # a new container
        if len(h):
            before, after = count[1 : capacity - s + 1], count[1 + s :].copy()
            rise = 2 * (after - before) + 2
            rise[-1] = 1 - 2 * before[-1]  # a full container is no partial fill
            rise = np.where(before > 0, rise, np.iinfo(np.int64).max)
            k = len(rise) - 1 - int(rise[::-1].argmin())
            if rise[k] <= best:
                at = k + 1
        if at:
            box = stacks[at].pop()
            count[at] -= 1
        else:
            box, opened = opened, opened + 1
        out[i] = box
        if at + s < capacity:
            stacks[at + s].append(box)
            count[at + s] += 1
    return out


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each item, the largest items first, each into the fullest container that has room."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = np.zeros(capacity + 1, bool)
    out, opened = np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = np.flatnonzero(used[: capacity - s + 1])
        if len(fits):
            at = int(fits[-1])
            box = stacks[at].pop()
            used[at] = bool(stacks[at])
        else:
            at, box, opened = 0, opened, opened + 1
        out[i] = box
        if at + s < capacity:
            stacks[at + s].append(box)
            used[at + s] = True
    return out


def _lanes(capacity: int, last: bool):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "lane"):
            lane, size = t.column("lane").to_numpy(), t.column("size").to_numpy()
            box = np.empty(len(lane), np.int64)
            for s, e in runs(lane):
                box[s:e] = (best_fit_decreasing if last else sum_of_squares)(size[s:e], capacity)
            yield from t.append_column("box", pa.array(box)).to_batches()

    return step


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, lane: int = LANE) -> DataFrame:
    """(key, piece_no, size, container) of every item, in containers of at most `capacity`.

    An item larger than the capacity is split into full containers and a remainder, its
    pieces numbered from 0; no other is split. Items without a size, or of size 0 or less,
    need no room and are left out; a null key is a key like others; repeated keys are
    items of their own. An empty table gives no rows; other columns are ignored.

    Items are dealt to lanes of about `lane` by a hash of a number that each gets once,
    so that repeated keys spread like others, and each lane packs online by the sum-of-squares rule. What a lane leaves in containers that are
    not full is dealt again to a sixteenth as many lanes, until one lane remains, which
    packs its rest by best fit, the largest first. So no task holds more than about `lane`
    items, or the rest of sixteen lanes. Container ids are unique, not consecutive.
    """
    rows = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{size}`").cast("long").alias("n")).where("n > 0")
    cap = F.lit(capacity).cast("long")
    pieces = rows.select("key", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / cap)), lambda i: F.least(cap, F.col("n") - i * cap)))).toDF("key", "piece_no", "size")
    state = cut(pieces.withColumn("seq", F.monotonically_increasing_id()))  # written once, so that it stays the same
    whole = state.where(F.col("size") == capacity).select("key", "piece_no", "size", F.concat(F.lit("f-"), "seq").alias("container"))
    left = state.where(F.col("size") < capacity)
    kind = dict(rows.dtypes)["key"]
    out, level, lanes = whole, 0, None
    while True:
        n = left.count()
        if not n:
            return out
        lanes = max(1, -(-n // lane)) if lanes is None else max(1, min(lanes // 16, -(-n // lane)))
        last = lanes == 1 and level > 0
        dealt = left.withColumn("lane", F.pmod(F.xxhash64("seq", F.lit(level)), F.lit(lanes)))
        placed = dealt.select("key", "piece_no", "size", "seq", "lane").repartition(lanes, "lane").sortWithinPartitions("lane", F.xxhash64("seq"))
        done = cut(placed.mapInArrow(_lanes(capacity, last), f"key {kind}, piece_no int, size long, seq long, lane long, box long"))
        boxes = done.groupBy("lane", "box").agg((F.sum("size") >= FULL * capacity).alias("full"))
        done = done.join(boxes, ["lane", "box"])
        named = done.where(F.lit(True) if last else "full")
        out = out.unionByName(named.select("key", "piece_no", "size", F.concat(F.lit(f"{level}-"), "lane", F.lit("-"), "box").alias("container")))
        if last:
            return out
        left, level = done.where("not full").select("key", "piece_no", "size", "seq"), level + 1


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, used): the number of containers, what they hold, and the share of their room in use."""
    boxes = packed.groupBy("container").agg(F.sum("size").alias("n"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count("*") * capacity)).alias("used"))

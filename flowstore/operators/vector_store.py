"""Vectors by similarity: exact search, and an index of centroids with probes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from flowstore.functions.vectors import as_column, cosine, euclidean
from flowstore.operators import mutations
from flowstore.plans.tables import cut

#: Centroids probed first by a query, rows that fit them, rounds and tolerance.
PROBES, SAMPLE, ROUNDS, TOLERANCE = 2, 50_000, 20, 1e-5
#: Centroids that one matrix holds; centroids fitted at most for each row of the sample.
BLOCK, SAMPLE_A_CENTROID = 20_000, 8


def exact(
    df: DataFrame, vector: str, query: Sequence[float] | Column, k: int = 10, where: Column | None = None,
    metric: str = "cosine", tie: str | None = None,
) -> DataFrame:
    """The k rows most similar to one vector, with `score` (a cosine, or a distance), ties by the column
    tie; `where` filters before the ranking. Rows marked as deleted are left out.
    """
    df = live(df)
    score = cosine(vector, query) if metric == "cosine" else euclidean(vector, query)
    rows = (df if where is None else df.where(where)).withColumn("score", score)
    order = [F.desc("score") if metric == "cosine" else F.asc("score"), *([F.col(tie)] if tie else [])]
    return rows.orderBy(*order).limit(k)


def centroids(df: DataFrame, vector: str, k: int | None = None, seed: int = 7, sample: int = SAMPLE) -> DataFrame:
    """(centroid_id from 1, vector) by k-means on a hash sample of at most about `sample` rows; k defaults
    to the root of the rows, as far as the sample has SAMPLE_A_CENTROID rows for each.
    """
    rows = df.select(F.col(f"`{vector}`").alias("v")).where("v is not null")
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    k = k or max(1, min(int(n**0.5), min(n, sample) // SAMPLE_A_CENTROID))
    model = KMeans(k=k, initMode="k-means||", maxIter=ROUNDS, tol=TOLERANCE, seed=seed, featuresCol="f").fit(rows.select(array_to_vector(F.col("v").cast("array<double>")).alias("f")))
    return df.sparkSession.createDataFrame([(i + 1, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "centroid_id int, vector array<double>")


def live(store: DataFrame) -> DataFrame:
    """The rows that are not marked as deleted."""
    return store.where(~F.coalesce(F.col("is_deleted"), F.lit(False))) if "is_deleted" in store.columns else store


def _nearest(data, n: int, vector: str):
    """The batches with `__near`, the (d, id) of the n nearest centroids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres = data.value
        norms = (centres**2).sum(1)
        kind = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))
        for b in batches:
            v = b.column(b.schema.get_field_index(vector))
            size = v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            whole = np.flatnonzero(size == centres.shape[1])
            flat = v.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)
            near: list = [None] * len(v)
            for s in range(0, len(whole), 256):
                x = flat[s : s + 256]
                d = norms - 2 * x @ centres.T  # less the norm of x, which changes no order
                least = np.partition(d, min(n, len(ids)) - 1, axis=1)[:, min(n, len(ids)) - 1]
                close = d <= (least + 1e-9 * (1 + np.abs(least) + norms.max()))[:, None]
                for i, row, mark in zip(whole[s : s + 256], x, close):
                    # exact distances of the few best, ties by id
                    best = np.flatnonzero(mark)
                    far = np.sqrt(((centres[best] - row) ** 2).sum(1))
                    if len(best):
                        near[i] = [{"d": float(far[o]), "id": int(ids[best[o]])} for o in np.lexsort((ids[best], far))[:n]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, kind)], names=[*b.schema.names, "__near"])

    return step


def assign(df: DataFrame, vector: str, centres: DataFrame, n: int = 1) -> DataFrame:
    """df with `centroids`, the ids of its n nearest centroids, the nearest first (ties by id), and `distance` to the first; null for a vector that is null, of another length or not finite.

    The centroids are broadcast as a matrix of at most about BLOCK of them and searched by
    products of blocks. If there are more, the rows pass several matrices, and the bests
    of all are merged, so that any number is possible while none is held whole.
    """
    spark, kind = df.sparkSession, dict(centres.dtypes)["centroid_id"]
    blocks = max(1, -(-centres.count() // BLOCK))
    rows = df.drop("centroids", "distance").withColumn("__best", F.array().cast("array<struct<d:double,id:bigint>>"))
    for k in range(blocks):
        got = centres.where(F.pmod(F.xxhash64("centroid_id"), F.lit(blocks)) == k).select(F.col("centroid_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v")).orderBy("id").collect()
        if got:
            data = spark.sparkContext.broadcast((np.array([r["id"] for r in got]), np.array([r["v"] for r in got])))
            schema = StructType([*rows.schema.fields, StructField("__near", rows.schema["__best"].dataType)])
            best = F.slice(F.array_sort(F.concat("__best", F.coalesce("__near", F.array().cast("array<struct<d:double,id:bigint>>")))), 1, n)
            rows = rows.mapInArrow(_nearest(data, n, vector), schema).withColumn("__best", best).drop("__near")
    ids = F.transform("__best", lambda x: x["id"]).cast(f"array<{kind}>")
    some = F.size("__best") > 0
    return rows.withColumn("centroids", F.when(some, ids)).withColumn("distance", F.when(some, F.col("__best")[0]["d"])).drop("__best")


def reaches(indexed: DataFrame, vector: str, centres: DataFrame) -> DataFrame:
    """The centroids with `reach`, the largest angle of a row to its centroid (pi where a row has another
    length), null for one without rows. It holds until rows are added.
    """
    own = indexed.select("centroid_id", F.col(f"`{vector}`").alias("__v")).join(F.broadcast(centres.select("centroid_id", F.col("vector").alias("__c"))), "centroid_id")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine("__v", "__c"))))
    far = own.groupBy("centroid_id").agg(F.max(F.when(F.size("__v") == F.size("__c"), angle).otherwise(math.pi)).alias("reach"))
    return centres.drop("reach").join(far, "centroid_id", "left")


def query(
    indexed: DataFrame, vector: str, centres: DataFrame, target: Sequence[float], k: int = 10,
    probes: int | None = None, where: Column | None = None,
) -> DataFrame:
    """The k best by cosine. indexed has centroid_id, on which it may be partitioned.

    The PROBES centroids nearest to the target give a k-th score; then every centroid is
    scanned whose rows could reach it, by the angle to the target less its reach, so that
    the result is that of `exact` over the rows with a centroid. The reach is measured
    from the rows, in a pass over all, unless centres come from `reaches`. With `probes`
    just so many centroids are scanned, and neighbours in others are missed.
    """
    ids = [r[0] for r in centres.withColumn("d", euclidean("vector", target)).orderBy("d", "centroid_id").limit(probes or PROBES).select("centroid_id").collect()]
    first = exact(indexed.where(F.col("centroid_id").isin(ids)), vector, target, k, where)
    if probes is not None:
        return first
    scores = [r[0] for r in first.select("score").collect()]
    least = min(scores) if len(scores) == k and None not in scores else -1.0
    known = centres if "reach" in centres.columns else reaches(indexed, vector, centres)
    # at most as many rows as centroids
    rows = known.where("reach is not null").select("centroid_id", "reach", cosine("vector", target).alias("c")).collect()
    best = {r[0]: math.cos(max(0.0, math.acos(max(-1.0, min(1.0, r["c"]))) - r["reach"])) for r in rows}
    return exact(indexed.where(F.col("centroid_id").isin([i for i, s in best.items() if s >= least - 1e-9])), vector, target, k, where)


def mean_vectors(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, vector, n): the mean of the vectors of each group, dimension by dimension."""
    parts = df.select(F.col(f"`{by}`").alias("by"), F.posexplode(F.col(f"`{vector}`").cast("array<double>")).alias("at", "x"))
    means = parts.groupBy("by", "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy("by").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"), F.max("n").alias("n")).withColumnRenamed("by", by)


def drifted(centre: Column | str, n: Column, added: Column | str) -> Column:
    """A centroid after one more vector: (c * n + v) / (n + 1)."""
    return F.zip_with(as_column(centre), as_column(added), lambda c, v: (c * n + v) / (n + 1))


def split_centroid(df: DataFrame, vector: str, centroid_id: int, centres: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(store, centroids) with one centroid replaced by two, fitted on its rows, which are assigned anew;
    the second has the next free id. Other rows stay where they are.
    """
    own = df.where(F.col("centroid_id") == centroid_id)
    two = centroids(live(own), vector, 2, seed)
    top = centres.agg(F.max("centroid_id")).first()[0]
    new = two.select(F.when(F.col("centroid_id") == 1, centroid_id).otherwise(top + 1).cast("int").alias("centroid_id"), "vector")
    moved = placed(own, vector, new).select(*[F.col(f"`{c}`") for c in df.columns])
    rest = df.where(~F.coalesce(F.col("centroid_id") == centroid_id, F.lit(False)))
    return rest.unionByName(moved), centres.select("centroid_id", "vector").where(F.col("centroid_id") != centroid_id).unionByName(new)


def add_centroid(centres: DataFrame, vector: Sequence[float]) -> DataFrame:
    """The centroids with one more, under the next free id; 1 is the first."""
    top = centres.agg(F.coalesce(F.max("centroid_id"), F.lit(0))).first()[0]
    return centres.select("centroid_id", "vector").unionByName(centres.sparkSession.createDataFrame([(top + 1, [float(x) for x in vector])], "centroid_id int, vector array<double>"))


def placed(df: DataFrame, vector: str, centres: DataFrame) -> DataFrame:
    """df with `centroid_id`, the nearest centroid."""
    return assign(df.drop("centroid_id"), vector, centres).withColumn("centroid_id", F.col("centroids")[0]).drop("centroids", "distance")


def upsert(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New vectors take the place of old ones of the same id, the last of an id that repeats; a deletion mark is lifted."""
    marked = store if "is_deleted" in store.columns else store.withColumn("is_deleted", F.lit(False))
    return mutations.upsert(marked, new.withColumn("is_deleted", F.lit(False)), [key])


def upsert_batch(store: DataFrame, new: DataFrame, vector: str, centres: DataFrame | None, key: str = "id", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(store, centroids) after a batch of vectors: each goes to its nearest centroid, and a centroid drifts to the mean of itself, weighted by its `n` rows, and the vectors that it gets.

    Without centroids the batch fits the first ones. Old rows stay where they are, until
    `optimize` fits all anew.
    """
    if centres is None or centres.isEmpty():
        centres = centroids(new, vector, seed=seed)
    come = cut(placed(new, vector, centres))
    counts = live(store).groupBy("centroid_id").agg(F.count("*").alias("n")) if "centroid_id" in store.columns else None
    base = centres.select("centroid_id", F.col("vector").cast("array<double>").alias("vector"))
    base = base.join(counts, "centroid_id", "left") if counts is not None else base.withColumn("n", F.lit(0))
    gets = mean_vectors(come.where("centroid_id is not null"), "centroid_id", vector).select("centroid_id", F.col("vector").alias("m"), F.col("n").alias("k"))
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    moved = F.when(k > 0, F.zip_with("vector", "m", lambda c, m: (c * n + m * k) / (n + k))).otherwise(F.col("vector"))
    drifted_ = cut(base.join(gets, "centroid_id", "left").select("centroid_id", moved.alias("vector")))
    return upsert(store, come, key), drifted_


def mark_deleted(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the ids marked as deleted; searches leave them out, and `optimize` drops them."""
    hit = store.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return hit.withColumn("is_deleted", F.coalesce(F.col("is_deleted"), F.lit(False)) | F.coalesce("__hit", F.lit(False))).drop("__hit")


def optimize(store: DataFrame, vector: str, k: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(store, centroids) fitted anew, without the deleted rows."""
    rows = live(store)
    cents = centroids(rows, vector, k, seed)
    return assign(rows.drop("centroid_id"), vector, cents).withColumn("centroid_id", F.col("centroids")[0]).drop("centroids"), cents


def top_each(scored: DataFrame, by: str, k: int, order: Sequence[Column]) -> DataFrame:
    """The first k rows of each group."""
    return scored.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def get(store: DataFrame, key: object, column: str = "id") -> DataFrame:
    """The row of an id, unless it is marked as deleted."""
    return live(store).where(F.col(column) == key)


def count(store: DataFrame) -> DataFrame:
    """(n): the rows that are not marked as deleted."""
    return live(store).agg(F.count("*").alias("n"))


def consolidate(store: DataFrame, fresh: DataFrame, vector: str, centres: DataFrame, key: str = "id") -> DataFrame:
    """The store with vectors that came in since, each under its nearest centroid."""
    come = placed(fresh, vector, centres)
    return upsert(store, come.select(*[c for c in store.columns if c in come.columns]), key)

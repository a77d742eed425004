"""Knowledge bases: items in categories, found by path, by vector and by words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstore.functions.text import category_name, vector_hash
from flowstore.functions.vectors import euclidean
from flowstore.operators import search as words
from flowstore.operators.mutations import upsert
from flowstore.operators.scans import first_by
from flowstore.operators.vector_store import assign, mean_vectors, top_each
from flowstore.plans.tables import cut

#: Least relevance of a digest's hits, hits a query, and what a category's distance counts against an item's.
MIN_SCORE, PER_QUERY, CATEGORY_WEIGHT = 0.6, 5, 0.1


def list_categories(items: DataFrame, category: str, page_offset: int = 0, page_size: int = 100) -> DataFrame:
    """(category, item_count, total_count): a page of the categories by name, with the number of all."""
    counts = items.groupBy(F.col(f"`{category}`").alias("category")).agg(F.count("*").alias("item_count"))
    total = counts.agg(F.count("*").alias("total_count"))
    return counts.orderBy("category").offset(page_offset * page_size).limit(page_size).crossJoin(F.broadcast(total))


def list_items(items: DataFrame, category: str, value: str, key: str, page_offset: int = 0, page_size: int = 100) -> DataFrame:
    """A page of one category's items by key, with total_count."""
    hit = items.where(F.col(f"`{category}`") == value)
    total = hit.agg(F.count("*").alias("total_count"))
    return hit.orderBy(key).offset(page_offset * page_size).limit(page_size).crossJoin(F.broadcast(total))


def by_path(items: DataFrame, category: str, path: str, text: str | None = None, prefix: str | None = None) -> DataFrame:
    """Items of a category path or one below it; with prefix, those whose text begins with it. Names compare in their one form."""
    parts = [p for p in path.split("/") if p.strip()]
    have = F.transform(F.split(F.col(f"`{category}`"), "/"), lambda p: category_name(p))
    want = F.array(*[category_name(F.lit(p)) for p in parts]) if parts else F.array().cast("array<string>")
    hit = items.where((F.slice(have, 1, len(parts)) == want) if parts else F.lit(True))
    return hit if prefix is None else hit.where(F.lower(F.col(f"`{text}`")).startswith(prefix.lower()))


def closest_category(categories: DataFrame, vector: str, target: Sequence[float], n: int = 1) -> DataFrame:
    """The n categories of least distance, with `distance`, ties by id."""
    return categories.withColumn("distance", euclidean(vector, target)).orderBy("distance", "category").limit(n)


def in_category(items: DataFrame, category: str, name: object, vector: str, target: Sequence[float], k: int = 10, tie: str | None = None) -> DataFrame:
    """The k items of one category of least distance: all are ranked before the limit."""
    ranked = items.where(F.col(f"`{category}`") == name).withColumn("distance", euclidean(vector, target))
    return ranked.orderBy("distance", *([tie] if tie else [])).limit(k)


def hybrid(
    items: DataFrame, categories: DataFrame, key: str, category: str, vector: str, text: str,
    target: Sequence[float], query: str, k: int = 10, category_vector: str = "vector", path: str | None = None,
    index: words.TextIndex | None = None,
) -> DataFrame:
    """(key, score, search_type): each key once, by the first of: items of the path, if one is given (score 0); items near the vector in its closest category, score the distance less CATEGORY_WEIGHT of the category's (least first); hits of the words.

    index: the written postings of the items; without one they are made for this search.
    """
    close = closest_category(categories, category_vector, target).select(F.col("category").alias("__cat"), F.col("distance").alias("__cd"))
    near = items.join(F.broadcast(close), F.col(f"`{category}`") == F.col("__cat"))  # one row
    near = near.select(F.col(f"`{key}`").alias("key"), (euclidean(vector, target) - CATEGORY_WEIGHT * F.col("__cd")).alias("score")).orderBy("score", "key").limit(k)
    found = words.search(index or words.build(items, key, text), query, k).select(F.col("doc").alias("key"), "score")
    both = near.withColumn("search_type", F.lit("semantic")).withColumn("p", F.lit(1)).unionByName(found.withColumn("search_type", F.lit("keyword")).withColumn("p", F.lit(2)))
    if path:
        under = by_path(items, category, path).select(F.col(f"`{key}`").alias("key"), F.lit(0.0).alias("score")).orderBy("key").limit(k)
        both = both.unionByName(under.withColumn("search_type", F.lit("path")).withColumn("p", F.lit(0)))
    return first_by(both, ["key"], [F.asc("p")]).drop("p")


def search_path(
    items: DataFrame, categories: DataFrame, category: str, key: str, path: str, vector: str,
    target: Sequence[float] | None = None, k: int = 10, prefix: str | None = None, text: str | None = None,
) -> DataFrame:
    """The first k items by key of a category path; if there are none and a vector is given, the k nearest of the closest category."""
    hit = by_path(items, category, path, text, prefix).orderBy(F.col(f"`{key}`")).limit(k)
    if target is None or not hit.isEmpty():
        return hit
    close = closest_category(categories, "vector", target).first()
    return in_category(items, category, close["category"], vector, target, k, key).drop("distance") if close else hit


def upsert_categories(categories: DataFrame, new: DataFrame) -> DataFrame:
    """Categories (id, name, parents: array of ids or paths, ...) with new ones in place of those of the same id.

    A parent may be written as the id or as the path of a category, names joined by `/`
    from a root down; paths become ids, and what is neither is dropped, as is a parent
    that is the category itself. A category may have several parents.
    """
    merged = upsert(categories, new, ["id"])
    paths = category_paths(merged).select(F.col("path").alias("__said"), F.col("id").alias("__to"))
    said = merged.select("id", F.posexplode("parents").alias("at", "p")).withColumn("__said", F.array_join(F.transform(F.split("p", "/"), lambda x: category_name(x)), "/"))
    ids = merged.select(F.col("id").cast("string").alias("p"), F.col("id").alias("__same"))
    known = said.join(ids, "p", "left").join(paths, "__said", "left").withColumn("to", F.coalesce("__same", "__to")).where("to is not null and to <> id")
    links = known.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("at", "to"))), lambda x: x["to"].cast("string"))).alias("__parents"))
    out = merged.join(links, "id", "left").withColumn("parents", F.coalesce("__parents", F.array().cast("array<string>")))
    return out.select(*merged.columns)


def category_paths(categories: DataFrame, depth: int = 12) -> DataFrame:
    """(id, path) of each way from a root to a category, names in their one form joined by `/`; a category
    of several parents has several. Ways of more than `depth` names end there, and so do cycles.
    """
    nodes = categories.select("id", category_name(F.col("name")).alias("name"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))
    links = nodes.select(F.col("id").alias("child"), "name", F.explode("parents").alias("parent"))
    now = nodes.where(F.size("parents") == 0).select("id", F.col("name").alias("path"))
    out = now
    for _ in range(depth - 1):
        now = cut(links.join(now.select(F.col("id").cast("string").alias("parent"), "path"), "parent").select(F.col("child").alias("id"), F.concat("path", F.lit("/"), "name").alias("path")).distinct())
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out.distinct()


def vectorize_categories(categories: DataFrame, items: DataFrame, category: str, vector: str) -> DataFrame:
    """Categories with `vector`, the mean of the vectors of their items; one without items keeps what it had."""
    means = mean_vectors(items.where(F.col(f"`{category}`").isNotNull() & F.col(f"`{vector}`").isNotNull()), category, vector).select(F.col(f"`{category}`").cast("string").alias("__id"), F.col("vector").alias("__mean"))
    out = categories.join(means, F.col("id").cast("string") == F.col("__id"), "left")
    old = F.col("vector") if "vector" in categories.columns else F.lit(None).cast("array<double>")
    return out.withColumn("vector", F.coalesce("__mean", old.cast("array<double>"))).drop("__id", "__mean")


def export_document(name: str, categories: DataFrame, items: DataFrame, category: str, config: dict | None = None) -> DataFrame:
    """(value): one JSON document for each category, {"config", "category", "items"}, so that no document
    holds more than one category; items without a known category come under a null one.
    """
    head = F.struct(F.lit(name).alias("name"), *[F.lit(v).alias(k) for k, v in (config or {}).items()])
    held = items.groupBy(F.col(f"`{category}`").cast("string").alias("__c")).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in items.columns])).alias("items"))
    cats = categories.select(F.col("id").cast("string").alias("__c"), F.struct(*[F.col(f"`{c}`") for c in categories.columns]).alias("category"))
    return cats.join(held, "__c", "full").select(F.to_json(F.struct(head.alias("config"), "category", F.coalesce("items", F.array().cast(held.schema["items"].dataType)).alias("items"))).alias("value"))


def import_document(lines: DataFrame, category_schema: str, item_schema: str) -> tuple[DataFrame, DataFrame]:
    """(categories, items) of documents {"config", "category" or "categories", "items"}, of one category each or of a whole space."""
    read = lines.select(F.from_json("value", f"category struct<{category_schema}>, categories array<struct<{category_schema}>>, items array<struct<{item_schema}>>").alias("r")).select("r.*")
    cats = read.select(F.explode(F.array_compact(F.concat(F.array("category"), F.coalesce("categories", F.array().cast(f"array<struct<{category_schema}>>"))))).alias("c")).select("c.*")
    return cats, read.select(F.explode("items").alias("i")).select("i.*")


def relevance(distance) -> object:
    """1 / (1 + distance), 1 at most."""
    return 1 / (1 + F.greatest(distance, F.lit(0.0)))


def digest(hits: DataFrame, key: str, least: float = MIN_SCORE, per_query: int = PER_QUERY, limit: int = PER_QUERY) -> DataFrame:
    """Hits (query, key, category, text, distance) of several queries merged: the nearest per_query of each
    with a relevance of at least `least`, each key by its best, the best first, then by category and
    text; blank texts are left out.
    """
    best = top_each(hits, "query", per_query, [F.asc("distance"), F.asc(key)])
    scored = best.withColumn("score", relevance(F.col("distance"))).where((F.col("score") >= least) & (F.trim("text") != ""))
    one = first_by(scored, [key], [F.desc("score"), F.asc("query")])
    return one.orderBy(F.desc("score"), "category", "text", key).limit(limit)


def stale(items: DataFrame, texts: Sequence[str], dim: int, stored: str) -> DataFrame:
    """Items whose stored hash is not that of their texts: those to embed again."""
    now = vector_hash(dim, *[F.col(f"`{t}`") for t in texts])
    return items.where(~F.col(f"`{stored}`").eqNullSafe(now)).withColumn("new_hash", now)


def export_json(categories: DataFrame, items: DataFrame) -> DataFrame:
    """(value): one JSON line for each category and item, with a field kind."""
    line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    return line(categories, "category").unionByName(line(items, "item"))


def import_json(lines: DataFrame, category_schema: str, item_schema: str) -> tuple[DataFrame, DataFrame]:
    """(categories, items) of lines written by `export_json`."""
    kind = F.get_json_object("value", "$.kind")
    read = lambda k, schema: lines.where(kind == k).select(F.from_json("value", schema).alias("r")).select("r.*")
    return read("category", category_schema), read("item", item_schema)


def resolve_path(categories: DataFrame, targets: Sequence[Sequence[float]], breadth: int = 3) -> DataFrame:
    """(category, distance): categories (category, parent, vector) reached by one vector a level, from the roots down.

    At each level the `breadth` nearest children of each branch go on; distances add up;
    only branches as deep as there are vectors survive, the nearest first. The levels are
    as many as the vectors, each one join.
    """
    nodes = categories.select("category", "parent", "vector")
    now = nodes.where("parent is null").withColumn("distance", euclidean("vector", targets[0])).withColumn("branch", F.lit(0))
    now = top_each(now, "branch", breadth, [F.asc("distance"), F.asc("category")]).select("category", "distance")
    for t in targets[1:]:
        up = now.select(F.col("category").alias("parent"), F.col("distance").alias("before"))
        below = nodes.join(up, "parent").withColumn("step", euclidean("vector", t))
        now = top_each(below, "parent", breadth, [F.asc("step"), F.asc("category")]).select("category", (F.col("before") + F.col("step")).alias("distance"))
    return now.orderBy("distance", "category")


def ingest_thoughts(items: DataFrame, categories: DataFrame, thoughts: DataFrame, vector: str, key: str, category: str) -> DataFrame:
    """The items with new ones, each in the nearest category (vectors of `categories` as centroids, ties by a hash of the name) unless it names one."""
    number = F.xxhash64("category")
    cents = categories.where("category is not null").select(number.alias("centroid_id"), "vector")
    placed = assign(thoughts, vector, cents).withColumn("__n", F.col("centroids")[0])
    named = categories.where("category is not null").select(number.alias("__n"), F.col("category").alias("__name")).distinct()
    placed = placed.join(named, "__n", "left").withColumn(category, F.coalesce(F.col(f"`{category}`"), F.col("__name")))
    return upsert(items, placed.select(*[F.col(f"`{c}`") for c in thoughts.columns]), [key])


def from_vectors(store: DataFrame, key: str, vector: str, payload: str, category: str) -> DataFrame:
    """(id, category, text, vector): the rows of a vector store as items, by fields of their JSON payload; deleted ones are left out."""
    from flowstore.functions.coercion import field

    live = store.where(~F.coalesce(F.col("is_deleted"), F.lit(False))) if "is_deleted" in store.columns else store
    return live.select(F.col(f"`{key}`").alias("id"), F.coalesce(field(payload, category), F.lit("general")).alias("category"), field(payload, "text").alias("text"), F.col(f"`{vector}`").alias("vector"))


def vectorize(items: DataFrame, texts: Sequence[str], dim: int, stored: str, vector: str, embed) -> DataFrame:
    """Items with vectors made anew where the stored hash is not that of the texts; `embed` gives a DataFrame its vector column."""
    old = items.where(F.col(f"`{stored}`").eqNullSafe(vector_hash(dim, *[F.col(f"`{t}`") for t in texts])))
    new = embed(stale(items, texts, dim, stored).drop(vector)).withColumn(stored, F.col("new_hash")).drop("new_hash")
    return old.unionByName(new.select(*items.columns))

"""Queries p1, p2, p3, p5, p8, p9 and p10 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowstore.llm.clusters import describe_groups, similarity_groups
from flowstore.llm.credentials import find_credentials, redact_credentials
from flowstore.llm.mixing import mix_sources, mixture_report, source_name
from flowstore.llm.neighbours import nearest_neighbours
from flowstore.llm.packing import CAPACITY, pack
from flowstore.llm.residue import LEAST, score_residue, without_residue
from flowstore.llm.splitting import split_oversized
from flowstore.llm.tokens import token_counts
from flowstore.plans.tables import cut


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return similarity_groups(_read(spark, sf, "space_items"), "position_ids", "positions").select("vec_id", "group_id").distinct()


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return describe_groups(similarity_groups(_read(spark, sf, "space_items"), "position_ids", "positions"))


def _limits(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with the limit and overlap of their embedder, or of their space's."""
    spaces = _read(spark, sf, "spaces").select("kb_name", F.col("embedder").alias("default_embedder"))
    profiles = _read(spark, sf, "embedder_profiles").select("embedder", "max_context_tokens", "overlap_tokens")
    rows = _read(spark, sf, "mint_requests").select("request_id", "kb_name", "content", "embedder")
    # both tables are fixed, of 40 and 5 rows
    return rows.join(F.broadcast(spaces), "kb_name", "left").withColumn("embedder", F.coalesce("embedder", "default_embedder")).join(F.broadcast(profiles), "embedder")


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_oversized(_limits(spark, sf), "request_id", "content", "max_context_tokens", "overlap_tokens")
    return pieces.withColumnRenamed("key", "request_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Content is larger than its limit just if it came out in more than one piece."""
    return p2_pieces(spark, sf).where("piece_no = 1").select("request_id").distinct()


def p2_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Each request's tokens as its pieces add up to them, without what they share; whether all pieces keep the limit and follow one another."""
    pieces = p2_pieces(spark, sf)
    w = Window.partitionBy("request_id").orderBy("piece_no")
    chained = pieces.withColumn("follows", (F.col("begin") <= F.coalesce(F.lag("end").over(w), F.lit(0))) & (F.col("piece_no") == F.row_number().over(w) - 1))
    limits = _limits(spark, sf).select("request_id", "max_context_tokens").distinct()
    joined = chained.join(limits, "request_id")
    return joined.groupBy("request_id").agg(F.sum(F.col("n_tokens") - F.col("n_shared")).alias("n_tokens"), F.bool_and(F.col("n_tokens") <= F.col("max_context_tokens")).alias("within"), F.bool_and("follows").alias("whole"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = find_credentials(_read(spark, sf, "config_files"), "file_id", "repo", "path", "content")
    return found.select(F.col("key").alias("file_id"), "line_no").distinct()


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every file with the number of values replaced, and whether its lines are as many as before, and its JSON as valid."""
    files = _read(spark, sf, "config_files").dropDuplicates(["file_id"])
    found = cut(find_credentials(files, "file_id", "repo", "path", "content"))
    clean = redact_credentials(files, found, "file_id", "content").withColumnRenamed("key", "file_id")
    both = files.select("file_id", "path", "content").join(clean, "file_id")
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    valid = lambda c: F.expr(f"try_parse_json({c}) is not null")
    json = F.col("path").endswith(".json")
    return both.select("file_id", "n_redacted", F.coalesce(lines("content") == lines("text"), F.lit(True)).alias("same_lines"), (~F.coalesce(json, F.lit(False)) | ~valid("content") | valid("text")).alias("valid"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    sources = [(_read(spark, sf, "space_items"), "position_ids", "positions"), (_read(spark, sf, "export_items"), "vector_ids", "summaries_vectors")]
    pairs = nearest_neighbours(sources).select("id", F.explode("neighbours.id").alias("other"))
    return pairs.select(F.least("id", "other").alias("vec_id"), F.greatest("id", "other").alias("neighbour_id")).distinct()


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    sized = token_counts(_read(spark, sf, "documents"), ["doc_id"], "text")
    return pack(sized, "doc_id", "n_tokens").withColumnRenamed("key", "doc_id")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed; whether no container holds too much, every token is in just one, only documents
    too large are split, and the containers are 98 % full, but for one.
    """
    sized = cut(token_counts(_read(spark, sf, "documents"), ["doc_id"], "text"))
    packed = cut(pack(sized, "doc_id", "n_tokens"))
    boxes = packed.groupBy("container").agg(F.sum("size").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("held"), F.count("*").alias("boxes"))
    docs = packed.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"))
    same = docs.join(sized.where("n_tokens > 0").groupBy("doc_id").agg(F.sum("n_tokens").alias("want"), F.max("n_tokens").alias("longest")), F.col("key") == F.col("doc_id"), "full")
    each = same.agg(F.count("key").alias("n_docs"), F.bool_and(F.col("size").eqNullSafe(F.col("want"))).alias("each_token_once"), F.bool_and((F.col("pieces") == 1) | (F.col("longest") > CAPACITY)).alias("only_large_split"))
    return each.crossJoin(boxes).select("n_docs", (F.col("most") <= CAPACITY).alias("within"), "each_token_once", "only_large_split", (F.col("held") >= 0.98 * CAPACITY * (F.col("boxes") - 1)).alias("full"))


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = _read(spark, sf, "mix_targets")
    sized = cut(token_counts(_read(spark, sf, "documents"), ["doc_id", "source"], "text"))
    return mix_sources(sized, "doc_id", "source", "n_tokens", targets, short=True), targets


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[0].withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture_report(*_mixture(spark, sf))


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Of every target whether its repeats are within the cap, and its share is met within a text, or all it has is used as often as may be."""
    mixture, targets = _mixture(spark, sf)
    mixture = cut(mixture)
    sizes = token_counts(_read(spark, sf, "documents"), ["source"], "text").select(source_name("source").alias("source"), F.col("n_tokens").alias("n")).where("n > 0")
    have = cut(sizes.join(targets.select(source_name("source").alias("source")), "source").groupBy("source").agg(F.sum("n").alias("have"), F.max("n").alias("largest")))
    total = have.agg(F.sum("have").alias("total"))
    got = mixture_report(mixture, targets).join(targets.select(source_name("source").alias("source"), "max_repeats"), "source").join(have, "source", "left").crossJoin(total)
    budget = F.least(F.col("target_share") * F.col("total"), F.col("max_repeats") * F.coalesce("have", F.lit(0)))
    return got.select("source", (F.col("most_uses") <= F.col("max_repeats")).alias("capped"), (F.abs(F.col("size") - budget) <= F.coalesce("largest", F.lit(0)) + 1).alias("met"))


def p10_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without those that show residue."""
    return without_residue(_read(spark, sf, "documents"), "doc_id", "text").select("doc_id", "lang", "n_chars")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_residue(_read(spark, sf, "documents"), "doc_id", "text")
    return scored.where(F.col("score") >= LEAST).select(F.col("key").alias("doc_id")).distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_pieces, p2_coverage, p3_found, p3_redacted, p5_found, p8_packed, p8_report, p9_mixture, p9_shares, p9_kept, p10_found, p10_kept)}

_USABLE = "v IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"

SQL = {
    # a vector is in one group only, so that its group is it and all its neighbours
    "p1_found": f"""
WITH e AS (SELECT unnest(position_ids) AS id, unnest(positions) AS v FROM space_items),
u AS (SELECT id, CAST(v AS DOUBLE[64]) AS v FROM e WHERE {_USABLE}),
p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id AND array_cosine_similarity(a.v, b.v) >= 0.80)
SELECT a AS vec_id, min(least(a, b)) AS group_id FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY a""",
    # ranks by the cosine to the mean direction, to six digits
    "p1_groups": f"""
WITH e AS (SELECT unnest(position_ids) AS id, unnest(positions) AS v FROM space_items),
u AS (SELECT id, CAST(v AS DOUBLE[64]) AS v FROM e WHERE {_USABLE}),
p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id AND array_cosine_similarity(a.v, b.v) >= 0.80),
m AS (SELECT a AS id, min(least(a, b)) AS g FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY a),
n AS (SELECT m.id, m.g, list_transform(CAST(u.v AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(u.v AS DOUBLE[]), CAST(u.v AS DOUBLE[])))) AS v FROM m JOIN u USING (id)),
c AS (SELECT g, list(x ORDER BY i) AS c FROM (SELECT g, i, avg(x) AS x FROM (SELECT g, unnest(range(64)) AS i, unnest(v) AS x FROM n) GROUP BY g, i) GROUP BY g),
r AS (SELECT n.g, n.id, row_number() OVER (PARTITION BY n.g ORDER BY round(list_cosine_similarity(n.v, c.c), 6) DESC, n.id) AS k, count(*) OVER (PARTITION BY n.g) AS size FROM n JOIN c ON n.g = c.g)
SELECT g AS group_id, max(size) AS size, list(id ORDER BY k) FILTER (k <= 3) AS typical FROM r GROUP BY g""",
    "p2_coverage": """
SELECT DISTINCT m.request_id, len(regexp_extract_all(m.content, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]')) AS n_tokens, true AS within, true AS whole
FROM mint_requests m LEFT JOIN spaces s ON m.kb_name = s.kb_name JOIN embedder_profiles e ON e.embedder = coalesce(m.embedder, s.embedder) WHERE m.content IS NOT NULL""",
    # what must hold whatever the tokens are
    "p8_report": "SELECT count(DISTINCT doc_id) AS n_docs, true AS within, true AS each_token_once, true AS only_large_split, true AS full FROM documents WHERE length(text) > 0",
    "p9_kept": "SELECT replace(replace(lower(trim(source)), '-', '_'), ' ', '_') AS source, true AS capped, true AS met FROM mix_targets",
    "p2_found": """
SELECT DISTINCT m.request_id FROM mint_requests m LEFT JOIN spaces s ON m.kb_name = s.kb_name JOIN embedder_profiles e ON e.embedder = coalesce(m.embedder, s.embedder)
WHERE len(regexp_extract_all(m.content, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]')) > e.max_context_tokens""",
    "p5_found": f"""
WITH e AS (SELECT unnest(position_ids) AS id, unnest(positions) AS v FROM space_items UNION ALL SELECT unnest(vector_ids), unnest(summaries_vectors) FROM export_items),
u AS (SELECT id, CAST(v AS DOUBLE[64]) AS v FROM e WHERE {_USABLE}),
p AS (SELECT a.id AS a, b.id AS b, round(array_cosine_similarity(a.v, b.v), 10) AS s FROM u a JOIN u b ON a.id < b.id AND array_cosine_similarity(a.v, b.v) >= 0.80),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM (SELECT a, b, s FROM p UNION ALL SELECT b, a, s FROM p))
SELECT DISTINCT least(a, b) AS vec_id, greatest(a, b) AS neighbour_id FROM r WHERE k <= 5""",
}

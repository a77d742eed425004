"""Queries p4, p6 and p7 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowstore.functions.ids import canonical_uuid, reference_uuid
from flowstore.operators.hierarchy import descendants, resolve_hierarchy
from flowstore.operators.nested import flat_tables, flatten_nested
from flowstore.operators.references import orphan_references, orphan_report


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    """References of two columns, of which each row has one: MATCH PARTIAL looks either up on its own."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    none = F.lit(None).cast("string")
    items = read("space_items")
    refs = items.select("request_id", "received_at", reference_uuid("category_id").alias("category_ref"), none.alias("doc_ref"))
    refs = refs.unionByName(items.select("request_id", "received_at", none.alias("category_ref"), F.explode("doc_id").alias("d")).withColumn("doc_ref", reference_uuid("d")).drop("d"))

    def targets(table: str, own: str, at: str, order: list[str]) -> DataFrame:
        """One row for each id: its earliest time, and whether the newest row is a deletion."""
        newest = F.max_by(F.col("deleted_at").isNotNull(), F.struct(*order, F.col("deleted_at").isNotNull().alias("d")))
        rows = read(table).select(canonical_uuid("id").alias("id"), F.col(at).alias("at"), "deleted_at", *[F.col(o) for o in order])
        rows = rows.where("id is not null").groupBy("id").agg(F.min("at").alias("since"), newest.alias("deleted"))
        return rows.select(*[(F.col("id") if c == own else none).alias(c) for c in ("category", "doc")], "since", "deleted")

    parent = targets("space_categories", "category", "received_at", ["received_at", "request_id"]).unionByName(targets("space_documents", "doc", "uploaded_at", ["uploaded_at"]))
    found = orphan_references(refs, parent, [("category_ref", "category"), ("doc_ref", "doc")], "partial", "deleted", "since", "received_at")
    return found.select("request_id", "received_at", F.when(F.col("doc_ref").isNull(), "category_id").otherwise("doc_id").alias("field_name"), F.coalesce("category_ref", "doc_ref").alias("ref_id"), "reason")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    found = _orphans(spark, sf)
    return found.select("request_id", "field_name", "ref_id", "reason", F.date_format("received_at", "yyyy-MM").alias("period")).distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    distinct = _orphans(spark, sf).select("request_id", "field_name", "ref_id", "reason", "received_at").distinct()
    return orphan_report(distinct, "field_name", "received_at")


def _composite(match: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        """Items whose space and category do not occur together among the categories; either may be null."""
        items = spark.read.parquet(f"{sf}/space_items.parquet").select("request_id", "kb_name", reference_uuid("category_id").alias("category"))
        parent = spark.read.parquet(f"{sf}/space_categories.parquet").select(F.col("kb_name").alias("space"), canonical_uuid("id").alias("id"))
        return orphan_references(items, parent, [("kb_name", "space"), ("category", "id")], match).select("request_id", "kb_name", "category", "reason")

    return query


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    flat = flatten_nested(spark.read.parquet(f"{sf}/kb_exports.parquet"), "export_id", "payload")
    return flat.select(F.col("key").alias("export_id"), "node", "parent").distinct()


def p6_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The flat tables: rows, rows above them, and rows at the top."""
    flat = flatten_nested(spark.read.parquet(f"{sf}/kb_exports.parquet"), "export_id", "payload")
    return flat.groupBy("table_name").agg(F.count("*").alias("n_rows"), F.count_distinct("key", "parent").alias("n_parents"), F.count_if(F.col("parent") == "$").alias("n_top"))


def p6_links(spark: SparkSession, sf: str) -> DataFrame:
    """Changes to an item with who made them: two flat tables joined by key and parent."""
    tables = flat_tables(flatten_nested(spark.read.parquet(f"{sf}/kb_exports.parquet"), "export_id", "payload"))
    made, change = tables["items[].data.attributes.history[]"], tables["items[].data.attributes.history[].changes[]"]
    above = made.select("_key", F.col("_node").alias("_parent"), F.col("by").alias("made_by"))
    return change.join(above, ["_key", "_parent"]).select(F.col("_key").alias("export_id"), F.col("_node").alias("node"), F.col("_idx").alias("idx"), "field", "made_by")


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/space_categories.parquet")
    rows = rows.select(canonical_uuid("id").alias("id"), reference_uuid("parent_id").alias("parent_id"), "name", "received_at", "request_id").where("id is not null")
    newest = rows.groupBy("id").agg(F.max_by(F.struct("parent_id", "name"), F.struct("received_at", "request_id")).alias("r")).select("id", "r.parent_id", "r.name")
    return resolve_hierarchy(newest, "id", "parent_id", "name", " / ")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).select(F.col("id").alias("category_id"), "root_id", "depth")


def p7_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).where("depth >= 0").select(F.col("id").alias("category_id"), F.col("parent").alias("parent_id"), "path")


def p7_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return descendants(_tree(spark, sf))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_simple": _composite("simple"), "p4_partial": _composite("partial"), "p4_full": _composite("full"), "p6_found": p6_found, "p6_tables": p6_tables, "p6_links": p6_links, "p7_found": p7_found, "p7_paths": p7_paths, "p7_descendants": p7_descendants}

def _uuid(c: str) -> str:
    """SQL: the canonical UUID of a text column."""
    s = f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
    body = f"CASE WHEN length({s}) = 36 THEN {s} WHEN length({s}) = 45 AND starts_with({s}, 'urn:uuid:') THEN substr({s}, 10) WHEN length({s}) = 38 THEN substr({s}, 2, 36) WHEN regexp_full_match({s}, '[0-9a-f]{{32}}') THEN concat_ws('-', substr({s}, 1, 8), substr({s}, 9, 4), substr({s}, 13, 4), substr({s}, 17, 4), substr({s}, 21)) END"
    return f"CASE WHEN regexp_full_match({body}, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN {body} END"


def _ref(c: str) -> str:
    return f"nullif({_uuid(c)}, '00000000-0000-0000-0000-000000000000')"


def _p4_pairs(partly: str) -> str:
    """SQL: references of space and category without a target. partly: what a reference with one null is."""
    return f"""
WITH refs AS (SELECT request_id, kb_name, {_ref('category_id')} AS category FROM space_items),
pairs AS (SELECT DISTINCT kb_name, {_uuid('id')} AS id FROM space_categories),
found AS (SELECT r.*, CASE
  WHEN r.kb_name IS NULL AND r.category IS NULL THEN NULL
  WHEN r.kb_name IS NULL OR r.category IS NULL THEN {partly}
  WHEN NOT EXISTS (SELECT 1 FROM pairs p WHERE p.kb_name = r.kb_name AND p.id = r.category) THEN 'missing' END AS reason FROM refs r)
SELECT request_id, kb_name, category, reason FROM found WHERE reason IS NOT NULL"""


_P6 = """
WITH RECURSIVE n AS (
  SELECT export_id, '' AS path, '' AS tab, '$' AS parent, CAST(payload AS JSON) AS v, false AS elem FROM kb_exports WHERE payload IS NOT NULL AND payload <> '' AND json_valid(payload)
  UNION ALL
  SELECT n.export_id,
         CASE WHEN json_type(n.v) = 'ARRAY' THEN n.path || '[' || e.key || ']' WHEN n.path = '' THEN e.key ELSE n.path || '.' || e.key END,
         CASE WHEN json_type(n.v) = 'ARRAY' THEN n.tab || '[]' WHEN n.tab = '' THEN e.key ELSE n.tab || '.' || e.key END,
         CASE WHEN n.elem AND json_type(n.v) = 'OBJECT' THEN n.path ELSE n.parent END, e.value, json_type(n.v) = 'ARRAY'
  FROM n, json_each(n.v) e WHERE json_type(n.v) IN ('ARRAY', 'OBJECT'))
"""

_P7 = f"""
WITH RECURSIVE rows_ AS (SELECT {_uuid('id')} AS id, {_ref('parent_id')} AS p, name, received_at, request_id FROM space_categories),
newest AS (SELECT id, p, coalesce(name, '') AS name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, request_id DESC) AS k FROM rows_ WHERE id IS NOT NULL) WHERE k = 1),
nodes AS (SELECT n.id, n.name, q.id AS p FROM newest n LEFT JOIN newest q ON n.p = q.id),
down AS (
  SELECT id, p, name AS path, CAST([] AS VARCHAR[]) AS above FROM nodes WHERE p IS NULL
  UNION ALL
  SELECT n.id, n.p, d.path || ' / ' || n.name, list_append(d.above, d.id) FROM down d JOIN nodes n ON n.p = d.id)
"""

_P4 = f"""
WITH refs AS (
  SELECT request_id, received_at, 'category_id' AS field_name, {_ref('category_id')} AS ref_id FROM space_items
  UNION SELECT request_id, received_at, 'doc_id', {_ref('d')} FROM (SELECT request_id, received_at, unnest(doc_id) AS d FROM space_items)),
rows_ AS (
  SELECT 'category_id' AS field_name, {_uuid('id')} AS id, received_at AS at_, request_id AS n, deleted_at IS NOT NULL AS d FROM space_categories
  UNION ALL SELECT 'doc_id', {_uuid('id')}, uploaded_at, 0, deleted_at IS NOT NULL FROM space_documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY field_name, id ORDER BY at_ DESC NULLS LAST, n DESC, d DESC) AS k, min(at_) OVER (PARTITION BY field_name, id) AS since FROM rows_ WHERE id IS NOT NULL),
targets AS (SELECT field_name, id, d, since FROM ranked WHERE k = 1),
found AS (
  SELECT r.request_id, r.field_name, r.ref_id, r.received_at,
         CASE WHEN t.id IS NULL THEN 'missing' WHEN t.d THEN 'deleted' WHEN t.since > r.received_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN targets t ON r.field_name = t.field_name AND r.ref_id = t.id WHERE r.ref_id IS NOT NULL)
"""

SQL = {
    "p4_found": _P4 + "SELECT DISTINCT request_id, field_name, ref_id, reason, strftime(received_at, '%Y-%m') AS period FROM found WHERE reason IS NOT NULL",
    "p4_report": _P4 + "SELECT field_name AS table_name, strftime(received_at, '%Y-%m') AS period, reason, count(*) AS n FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p4_simple": _p4_pairs("NULL"),
    "p4_partial": _p4_pairs("CASE WHEN NOT EXISTS (SELECT 1 FROM pairs p WHERE p.kb_name = r.kb_name OR p.id = r.category) THEN 'missing' END"),
    "p4_full": _p4_pairs("'mixed'"),
    "p6_found": _P6 + "SELECT DISTINCT export_id, path AS node, parent FROM n WHERE elem AND json_type(v) = 'OBJECT'",
    "p6_tables": _P6 + "SELECT tab AS table_name, count(*) AS n_rows, count(DISTINCT (export_id, parent)) AS n_parents, count(*) FILTER (parent = '$') AS n_top FROM n WHERE elem AND json_type(v) = 'OBJECT' GROUP BY tab",
    "p6_links": _P6 + """SELECT c.export_id, c.path AS node, CAST(regexp_extract(c.path, '(\\d+)\\]$', 1) AS INTEGER) AS idx, c.v->>'field' AS field, h.v->>'by' AS made_by
FROM n c JOIN n h ON c.export_id = h.export_id AND c.parent = h.path WHERE c.elem AND c.tab = 'items[].data.attributes.history[].changes[]' AND json_type(c.v) = 'OBJECT'""",
    "p7_paths": _P7 + "SELECT id AS category_id, p AS parent_id, path FROM down",
    "p7_descendants": _P7 + "SELECT anc AS ancestor_id, id AS descendant_id, CAST(len(above) - list_position(above, anc) + 1 AS INTEGER) AS distance FROM (SELECT id, above, unnest(above) AS anc FROM down)",
    "p7_found": f"""
WITH RECURSIVE rows_ AS (SELECT {_uuid('id')} AS id, {_ref('parent_id')} AS p, received_at, request_id FROM space_categories),
newest AS (SELECT id, p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, request_id DESC) AS k FROM rows_ WHERE id IS NOT NULL) WHERE k = 1),
nodes AS (SELECT n.id, q.id AS p FROM newest n LEFT JOIN newest q ON n.p = q.id),
up AS (
  SELECT id, id AS anc, p AS nxt, 0 AS d, false AS looped, [id] AS seen FROM nodes
  UNION ALL
  SELECT u.id, n.id, n.p, u.d + 1, list_contains(u.seen, n.p), list_append(u.seen, n.id) FROM up u JOIN nodes n ON u.nxt = n.id WHERE NOT u.looped AND u.nxt IS NOT NULL AND NOT list_contains(u.seen, u.nxt)),
ends AS (SELECT id, anc, nxt, d, seen FROM up WHERE nxt IS NULL OR list_contains(seen, nxt))
SELECT id AS category_id, CASE WHEN nxt IS NULL THEN anc ELSE list_min(seen[list_position(seen, nxt):]) END AS root_id, CAST(CASE WHEN nxt IS NULL THEN d ELSE -1 END AS INTEGER) AS depth FROM ends""",
}

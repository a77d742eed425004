"""Queries of the pipeline, its operators and functions over the test tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowstore.api import Session
from flowstore.functions import text, vectors
from flowstore.functions.predicates import condition, from_phrase
from flowstore.functions.projections import project
from flowstore.operators import aggregates, etl, guard, joins, knowledge, mutations, scans, search, vector_store
from flowstore.plans import pipeline
from flowstore.plans.tables import shared_dir
from flowstore.sources.catalog import Catalog, IndexField, StoreMeta, relations
from flowstore.streaming import retention

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
    "lineitem": "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice",
}
RELATIONS = {
    "nation": {"n_regionkey": "region.r_regionkey"}, "customer": {"c_nationkey": "nation.n_nationkey"}, "supplier": {"s_nationkey": "nation.n_nationkey"}, "orders": {"o_custkey": "customer.c_custkey"},
    "lineitem": {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"},
}
QUERIES: dict = {}
SQL: dict = {}
_ONES = [0.1] * 64


def catalog(spark: SparkSession, sf: str) -> Catalog:
    metas = {n: StoreMeta(n, tuple(IndexField(f) for f in k.split()), relations(RELATIONS.get(n, {}))) for n, k in KEYS.items()}
    # the tables are only read: what is committed goes to the shared folder
    return Catalog(spark, sf, metas, home=f"{shared_dir(spark)}/stores-{uuid.uuid4().hex}")


def query(sql: str | None = None):
    """Registers a function of (spark, directory) under its name, with the SQL that gives the same."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


FLAGSHIP = [
    {"op": "open_store", "args": {"name": "customer"}, "result_var": "c"},
    {"op": "open_store", "args": {"name": "orders"}, "result_var": "o"},
    {"op": "scan", "args": {"store": "c", "condition": {"c_mktsegment": {"$eq": "BUILDING"}}, "stream": True}, "result_var": "m"},
    {"op": "join", "input_var": "m", "args": {"store": "o", "on": {"customer.c_custkey": "o_custkey"}}, "result_var": "j"},
    {"op": "filter", "input_var": "j", "args": {"condition": {"orders.o_totalprice": {"$gt": 100000}}}, "result_var": "f"},
    {"op": "sort", "input_var": "f", "args": {"fields": ["orders.o_totalprice desc", "orders.o_orderkey"]}, "result_var": "s"},
    {"op": "project", "input_var": "s", "args": {"fields": ["customer.c_name as c_name", "orders.o_orderkey as o_orderkey", "orders.o_totalprice as o_totalprice"]}, "result_var": "p"},
    {"op": "return"},
]


@query("SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000")
def pipeline_flagship(spark, sf):
    return pipeline.run(FLAGSHIP, catalog(spark, sf))


# scans and navigation


@query("SELECT * FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 1000")
def scan_asc(spark, sf):
    return scans.scan(_t(spark, sf, "orders"), ["o_orderkey"], {"o_totalprice": {"$gt": 400000}})


@query("SELECT * FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey DESC LIMIT 1000")
def scan_desc(spark, sf):
    return scans.scan(_t(spark, sf, "orders"), ["o_orderkey"], {"o_totalprice": {"$gt": 400000}}, direction="desc")


@query("SELECT * FROM orders WHERE o_orderkey >= 5000 ORDER BY o_orderkey LIMIT 500")
def scan_start_key(spark, sf):
    return scans.scan(_t(spark, sf, "orders"), ["o_orderkey"], start_key=5000, limit=500)


@query("SELECT * FROM lineitem WHERE l_orderkey > 900 OR (l_orderkey = 900 AND l_linenumber >= 3)")
def scan_composite_key(spark, sf):
    return scans.scan(_t(spark, sf, "lineitem"), KEYS["lineitem"].split(), start_key=[900, 3], limit=None)


@query("SELECT * FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def scan_prefix(spark, sf):
    return scans.scan(_t(spark, sf, "customer"), ["c_name"], prefix="Customer#0000001", limit=None)


@query("SELECT r_regionkey AS \"region.r_regionkey\", r_name AS \"region.r_name\" FROM region")
def scan_prefixed_columns(spark, sf):
    return pipeline.run([{"op": "scan", "store": "region"}], catalog(spark, sf))


@query("SELECT * FROM customer WHERE c_custkey = 77")
def fetch_key(spark, sf):
    return Session(catalog(spark, sf)).fetch("customer", 77)


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 123")
def find_exact(spark, sf):
    return scans.find(_t(spark, sf, "orders"), ["o_orderkey"], 123)


@query("SELECT * FROM orders WHERE o_totalprice >= 250000 ORDER BY o_totalprice, o_orderkey LIMIT 1")
def find_nearest_ge(spark, sf):
    return scans.find_nearest(_t(spark, sf, "orders"), "o_totalprice", 250000)


@query("SELECT * FROM orders WHERE o_totalprice <= 250000 ORDER BY o_totalprice DESC LIMIT 1")
def find_nearest_le(spark, sf):
    return scans.find_nearest(_t(spark, sf, "orders"), "o_totalprice", 250000, descending=True)


@query("SELECT * FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def find_nearest_beyond(spark, sf):
    return scans.find_nearest(_t(spark, sf, "orders"), "o_totalprice", 10**12)


@query("SELECT event_id, user_id, lag(event_type) OVER w AS previous_event_type, lead(event_type) OVER w AS next_event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def nav_lead_lag(spark, sf):
    out = scans.neighbours(_t(spark, sf, "events"), ["ts", "event_id"], ["event_type"], ["user_id"])
    return out.select("event_id", "user_id", "previous_event_type", "next_event_type")


@query("(SELECT * FROM orders ORDER BY o_orderkey LIMIT 1) UNION ALL (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 1) UNION ALL (SELECT * FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 1) UNION ALL (SELECT * FROM orders WHERE o_orderkey < 100 ORDER BY o_orderkey DESC LIMIT 1)")
def nav_first_last_next_previous(spark, sf):
    o, k = _t(spark, sf, "orders"), ["o_orderkey"]
    return scans.edge(o, k).unionByName(scans.edge(o, k, True)).unionByName(scans.step(o, k, 100)).unionByName(scans.step(o, k, 100, True))


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def range_between(spark, sf):
    return scans.key_range(_t(spark, sf, "orders"), "o_orderkey", 100, 900)


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 150")
def page_offset(spark, sf):
    return scans.page(_t(spark, sf, "orders"), ["o_orderkey"], 3, 50)


@query("SELECT *, (SELECT count(*) FROM customer) AS total_count FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def page_total(spark, sf):
    return scans.page_with_total(_t(spark, sf, "customer"), ["c_custkey"], 2, 20)


@query("""SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS count, true AS is_unique, '' AS description, c.column_name, c.label
FROM (VALUES ('o_orderkey', 'number'), ('o_custkey', 'number'), ('o_orderstatus', 'string'), ('o_totalprice', 'number'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'string')) AS c(column_name, label)""")
def inspect_store(spark, sf):
    return catalog(spark, sf).inspect("orders").select("name", "count", "is_unique", "description", F.explode("schema").alias("column_name", "label"))


@query()
def list_stores(spark, sf):
    return catalog(spark, sf).list_stores()


# filters


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderpriority <> '1-URGENT'")
def filter_operators(spark, sf):
    o = _t(spark, sf, "orders")
    return o.where(condition(o, {"o_orderstatus": "F", "o_totalprice": {"$gte": 1000, "$lt": 200000}, "o_orderpriority": {"$ne": "1-URGENT"}}))


@query("SELECT * FROM events WHERE event_type IN ('click', 'error') AND user_id NOT IN (1, 2, 3)")
def filter_in_nin(spark, sf):
    e = _t(spark, sf, "events")
    return e.where(condition(e, {"event_type": {"$in": ["click", "error"]}, "user_id": {"$nin": [1, 2, 3]}}))


@query("SELECT * FROM lineitem WHERE (l_quantity > 40 AND l_returnflag = 'R') OR (l_discount < 0.02 AND NOT (l_linestatus = 'O'))")
def filter_and_or(spark, sf):
    x = _t(spark, sf, "lineitem")
    return x.where(condition(x, {"or": [{"and": [{">": [{"var": "l_quantity"}, 40]}, {"==": [{"var": "l_returnflag"}, "R"]}]}, {"l_discount": {"$lt": 0.02}, "not": {"l_linestatus": "O"}}]}))


@query("SELECT * FROM part WHERE regexp_matches(p_brand, '#[1-3]') AND contains(p_name, 'a') AND p_type IS NOT NULL")
def filter_regex_contains_exists(spark, sf):
    p = _t(spark, sf, "part")
    return p.where(condition(p, {"p_brand": {"$regex": "#[1-3]"}, "p_name": {"$contains": "a"}, "p_type": {"$exists": True}}))


_OUTER = "(SELECT c_custkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000)"


def _outer(spark, sf):
    c, o = _t(spark, sf, "customer").select("c_custkey"), _t(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey", "o_totalprice")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_totalprice")


@query(f"SELECT * FROM {_OUTER} WHERE o_totalprice < 350000 OR o_totalprice IS NULL")
def filter_null_lowest(spark, sf):
    x = _outer(spark, sf)
    return x.where(condition(x, {"o_totalprice": {"$lt": 350000}}, nulls="lowest"))


@query(f"SELECT * FROM {_OUTER} WHERE o_totalprice <> 0")
def filter_null_sql(spark, sf):
    x = _outer(spark, sf)
    return x.where(condition(x, {"o_totalprice": {"$ne": 0}}))


@query("SELECT * FROM orders WHERE o_totalprice > 450000")
def filter_from_phrase(spark, sf):
    o = _t(spark, sf, "orders")
    return o.where(condition(o, from_phrase("Which orders are greater than 450,000?", "o_totalprice")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice * 2 - 1000 > 500000 AND o_orderkey % 7 = 3) OR o_orderkey // 100 = 5")
def expr_arithmetic(spark, sf):
    o = _t(spark, sf, "orders")
    return o.where(condition(o, "(o_totalprice * 2.0 - 1000.0 > 500000.0 && o_orderkey % 7 == 3) || o_orderkey / 100 == 5")).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE (starts_with(p_name, 'a') OR contains(p_name, 'green') OR regexp_matches(p_brand, '#2[0-9]$')) AND length(p_name) > 5 AND p_type NOT IN ('X')")
def expr_strings(spark, sf):
    p = _t(spark, sf, "part")
    return p.where(condition(p, "(p_name.startsWith('a') || p_name.contains('green') || p_brand.matches('#2[0-9]$')) && size(p_name) > 5 && !(p_type in ['X'])")).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) - 1 = 2 AND dayofweek(o_orderdate) IN (1, 2, 3) AND o_orderdate < TIMESTAMP '1995-03-20 00:00:00'")
def expr_time(spark, sf):
    o = _t(spark, sf, "orders")
    return o.where(condition(o, "o_orderdate.getFullYear() == 1995 && o_orderdate.getMonth() == 2 && o_orderdate.getDayOfWeek() in [1, 2, 3] && o_orderdate < timestamp('1995-03-20T00:00:00Z')")).select("o_orderkey")


@query("SELECT event_id FROM events WHERE CASE WHEN event_type = 'purchase' THEN value > 50 ELSE value > 90 END")
def expr_ternary(spark, sf):
    e = _t(spark, sf, "events")
    return e.where(condition(e, "event_type == 'purchase' ? value > 50.0 : value > 90.0")).select("event_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def filter_json_props(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return e.where(condition(e, {"k": {"$gt": 50}}))


# projections

_CN = "customer JOIN nation ON c_nationkey = n_nationkey"


def _cn(spark, sf):
    return joins.join(_t(spark, sf, "customer"), _t(spark, sf, "nation"), {"c_nationkey": "n_nationkey"}, "inner", "customer", "nation")


@query(f"SELECT c_name AS name, n_name AS nation, c_acctbal FROM {_CN}")
def project_alias(spark, sf):
    return project(_cn(spark, sf), ["customer.c_name as name", {"field": "n_name", "alias": "nation"}, "left.c_acctbal"], {"left": "customer"})


@query(f"SELECT nation.*, c_name AS who FROM {_CN}")
def project_wildcard(spark, sf):
    return project(_cn(spark, sf), ["b.*", "c_name as who"], {"a": "customer", "b": "nation"})


@query(f"SELECT customer.*, nation.* FROM {_CN}")
def project_collapse(spark, sf):
    from flowstore.functions.names import collapsed

    return collapsed(_cn(spark, sf))


# joins


def _short(df, **names):
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()])


@query("SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(spark, sf):
    return _short(joins.join(_t(spark, sf, "customer"), _t(spark, sf, "orders"), {"c_custkey": "o_custkey"}, "inner", "customer", "orders"), c="customer.c_custkey", o="orders.o_orderkey")


@query("SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def join_left(spark, sf):
    return _short(joins.join(_t(spark, sf, "customer"), _t(spark, sf, "orders").where("o_totalprice > 400000"), {"c_custkey": "o_custkey"}, "left outer", "customer", "orders"), c="customer.c_custkey", o="orders.o_orderkey")


@query("SELECT c_custkey AS c, o_orderkey AS o FROM (SELECT * FROM customer WHERE c_acctbal > 0) RIGHT JOIN orders ON c_custkey = o_custkey")
def join_right(spark, sf):
    steps = [{"op": "scan", "store": "customer", "condition": {"c_acctbal": {"$gt": 0}}, "stream": True}, {"op": "join_right", "store": "orders", "on": {"c_custkey": "o_custkey"}}]
    return _short(pipeline.run(steps, catalog(spark, sf)), c="customer.c_custkey", o="orders.o_orderkey")


@query("SELECT c_custkey AS c, s_suppkey AS s FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 50")
def join_full(spark, sf):
    s = _t(spark, sf, "supplier").withColumn("k", F.col("s_suppkey") * 50)
    return _short(joins.join(_t(spark, sf, "customer"), s, {"c_custkey": "k"}, "full", "customer", "supplier"), c="customer.c_custkey", s="supplier.s_suppkey")


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(spark, sf):
    return joins.join(_t(spark, sf, "customer"), _t(spark, sf, "orders").where("o_totalprice > 400000"), {"c_custkey": "o_custkey"}, "semi")


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_anti(spark, sf):
    return joins.join(_t(spark, sf, "customer"), _t(spark, sf, "orders").where("o_totalprice > 400000"), {"c_custkey": "o_custkey"}, "anti")


@query("SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
def join_self(spark, sf):
    s = _t(spark, sf, "supplier")
    return _short(joins.join(s, s, ["s_nationkey"], "inner", "x", "y").where("`x.s_suppkey` < `y.s_suppkey`"), a="x.s_suppkey", b="y.s_suppkey").distinct()


@query("SELECT l.l_orderkey AS o, l.l_partkey AS p, count(*) AS n FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_partkey = r.l_partkey GROUP BY ALL")
def join_multi_key(spark, sf):
    x = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return _short(joins.join(x, x, ["l_orderkey", "l_partkey"], "inner", "l", "r"), o="l.l_orderkey", p="l.l_partkey").groupBy("o", "p").agg(F.count("*").alias("n"))


@query("SELECT r_name, count(*) AS n, round(sum(l_quantity), 2) AS q FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name")
def join_chain5(spark, sf):
    steps = [{"op": "open_store", "name": "region", "result_var": "r"}, {"op": "scan", "store": "r"}]
    steps += [{"op": "join", "store": s} for s in ("nation", "customer", "orders", "lineitem")]
    steps += [{"op": "group_by", "by": ["region.r_name"], "aggregates": {"n": "count(*)", "q": "sum(l_quantity)"}}]
    return pipeline.run(steps, catalog(spark, sf), collapse=True).withColumn("q", F.round("q", 2))


@query("SELECT o_orderkey AS o, p_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 45")
def join_relation_bridge(spark, sf):
    got = joins.bridge(_t(spark, sf, "orders"), _t(spark, sf, "lineitem"), _t(spark, sf, "part").where("p_size > 45"), "o_orderkey", "p_partkey", ("orders", "lineitem", "part"), ("l_orderkey", "l_partkey"))
    return _short(got, o="orders.o_orderkey", p="part.p_partkey")


@query(f"SELECT a.c_custkey AS c, b.n FROM {_OUTER} a JOIN (SELECT o_totalprice, count(*) AS n FROM {_OUTER} GROUP BY 1) b ON a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice")
def join_null_safe(spark, sf):
    x = _outer(spark, sf)
    return _short(joins.join(x, aggregates.group(x, ["o_totalprice"], {"n": "count(*)"}), ["o_totalprice"], "inner", "a", "b", null_safe=True), c="a.c_custkey", n="b.n")


@query("SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def join_one_call(spark, sf):
    return Session(catalog(spark, sf)).join("customer", "orders", ["c_custkey"], ["o_custkey"], fields=["a.c_name", "b.o_orderkey", "b.o_totalprice"], order_by="b.o_totalprice desc, b.o_orderkey")


@query("SELECT p.event_id, c.event_id AS asof_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
def join_asof_nearest(spark, sf):
    e = _t(spark, sf, "events")
    return joins.asof(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), ["user_id"], "ts", "ts", ["event_id"]).select("event_id", "asof_event_id")


@query("SELECT p.event_id, c.event_id AS asof_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ts) c ON p.ts >= c.ts")
def join_asof_spans(spark, sf):
    """The last click of all users before each purchase: one order of all rows, divided into days."""
    e = _t(spark, sf, "events")
    return joins.asof(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), [], "ts", "ts", ["event_id"], span=86400.0).select("event_id", "asof_event_id")


# sorting and limits


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 100")
def sort_multi(spark, sf):
    return scans.sort(_t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority desc", "o_totalprice", "o_orderkey"]).limit(100)


@query(f"SELECT * FROM {_OUTER} ORDER BY o_totalprice NULLS FIRST, c_custkey LIMIT 50")
def sort_nulls_lowest(spark, sf):
    return scans.sort(_outer(spark, sf), [{"field": "o_totalprice", "direction": "asc"}, {"key": "c_custkey"}]).limit(50)


# aggregates and sets


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10")
def agg_group_having(spark, sf):
    got = aggregates.group(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"sum_qty": "sum(l_quantity)", "n": "count(*)", "avg_disc": {"avg": "l_discount"}}, {"n": {"$gt": 10}})
    return got.withColumn("sum_qty", F.round("sum_qty", 2)).withColumn("avg_disc", F.round("avg_disc", 6))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def agg_distinct(spark, sf):
    return aggregates.distinct(_t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, sf):
    return aggregates.group(_t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": "count(*)"}, kind="cube")


@query("SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, sf):
    return aggregates.group(_t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": "count_distinct(o_custkey)"}, kind="rollup")


@query("SELECT count(*) AS n FROM lineitem")
def agg_count_store(spark, sf):
    return aggregates.group(_t(spark, sf, "lineitem"), [], {"n": "count(*)"})


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def setop_union_all(spark, sf):
    return aggregates.union([_t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))])


@query("SELECT k, max(b) AS b FROM (SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY k")
def setop_union_keep_best(spark, sf):
    c, s = _t(spark, sf, "customer"), _t(spark, sf, "supplier")
    return aggregates.union([_short(c, k="c_nationkey", b="c_acctbal"), _short(s, k="s_nationkey", b="s_acctbal")], ["k"], "b")


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def setop_intersect(spark, sf):
    return aggregates.intersect(_short(_t(spark, sf, "nation"), k="n_nationkey"), _short(_t(spark, sf, "supplier"), k="s_nationkey"))


@query("SELECT ps AS k FROM (SELECT p_partkey AS ps FROM part) EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def setop_except(spark, sf):
    return aggregates.subtract(_short(_t(spark, sf, "part"), k="p_partkey"), _short(_t(spark, sf, "lineitem").where("l_quantity > 45"), k="l_partkey"))


# changes


@query("SELECT * FROM orders UNION ALL SELECT * REPLACE (o_orderkey + 100000000 AS o_orderkey, o_totalprice * 2 AS o_totalprice) FROM orders WHERE o_orderstatus = 'F'")
def mutate_add(spark, sf):
    """Of the rows to add all come twice, the second with another price, and half are there already."""
    o = _t(spark, sf, "orders")
    kind = dict(o.dtypes)["o_orderkey"]
    new = o.where("o_orderstatus = 'F'").withColumns({"o_orderkey": (F.col("o_orderkey") + 100000000).cast(kind), "o_totalprice": F.col("o_totalprice") * 2})
    every = new.unionByName(o).withColumn("at", F.lit(0)).unionByName(new.withColumns({"o_totalprice": F.lit(-1.0), "at": F.lit(1)}))
    return mutations.add(o, every, ["o_orderkey"], order="at")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def mutate_update(spark, sf):
    return Session(catalog(spark, sf)).select("customer", where={"c_mktsegment": "BUILDING"}, action="update", values={"c_acctbal": 0.0})


_KEY = "CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey END"


@query(f"""SELECT * REPLACE (CAST(o_orderkey AS VARCHAR) AS o_orderkey) FROM (SELECT * REPLACE ({_KEY} AS o_orderkey) FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'F'
UNION ALL SELECT * REPLACE (o_totalprice + 1 AS o_totalprice) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'
UNION ALL SELECT * REPLACE (CAST(NULL AS BIGINT) AS o_orderkey, o_totalprice + 1 AS o_totalprice) FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'))""")
def mutate_upsert(spark, sf):
    """A store with many null keys; the new rows repeat every key, the last one counts, and the null key is among them."""
    o = _t(spark, sf, "orders").withColumn("at", F.col("o_orderkey")).withColumn("o_orderkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderkey")))
    new = o.where("o_orderstatus = 'F'")
    both = new.withColumn("at", F.lit(-1).cast("long")).unionByName(new.withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return mutations.upsert(o.drop("at"), both, ["o_orderkey"], "at").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))


def _sure(spark, sf, end: list[dict]):
    """A transaction that deletes from and changes orders that are open, then ends, and what the open store then has."""
    steps = [
        {"op": "open_store", "name": "orders", "result_var": "o"},
        {"op": "begin_tx"},
        {"op": "delete", "store": "o", "condition": {"o_orderstatus": "F"}},
        {"op": "update", "store": "o", "condition": {"o_orderstatus": "P"}, "values": {"o_totalprice": 0.0}},
        *end,
        {"op": "scan", "store": "o", "stream": True, "result_var": "r"},
        {"op": "return", "value": "@r"},
    ]
    cat = catalog(spark, sf)
    return pipeline.run(steps, cat, collapse=True)


@query("SELECT * FROM orders")
def tx_rollback(spark, sf):
    return _sure(spark, sf, [{"op": "rollback_tx"}])


@query("SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderstatus <> 'F'")
def tx_commit(spark, sf):
    return _sure(spark, sf, [{"op": "commit_tx"}])


@query("""SELECT 'applied' AS kind, count(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'exists', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'repeated', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'total', (SELECT count(*) FROM orders) + count(*) FROM orders WHERE o_orderstatus = 'O'""")
def bulk_add_errors(spark, sf):
    """New keys twice each, and known ones."""
    o = _t(spark, sf, "orders")
    new = o.where("o_orderstatus = 'O'").withColumn("o_orderkey", (F.col("o_orderkey") + 100000000).cast(dict(o.dtypes)["o_orderkey"]))
    got = Session(catalog(spark, sf)).bulk("orders", new.unionByName(new).unionByName(o.where("o_orderstatus = 'F'")), "add")
    counts = got.errors.groupBy(F.col("error").alias("kind")).agg(F.count("*").alias("n"))
    return counts.unionByName(got.applied.agg(F.count("*").alias("n")).select(F.lit("applied").alias("kind"), "n")).unionByName(got.table.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), "n"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def bulk_update(spark, sf):
    o = _t(spark, sf, "orders")
    new = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return Session(catalog(spark, sf)).bulk_update("orders", new).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT r_regionkey FROM region)")
def join_delete_left(spark, sf):
    return Session(catalog(spark, sf)).join("customer", "region", ["c_nationkey"], ["r_regionkey"], action="delete_left")


@query("SELECT * REPLACE (CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) THEN 'NEAR' ELSE c_mktsegment END AS c_mktsegment) FROM customer")
def join_update_left(spark, sf):
    cat = catalog(spark, sf)
    cat.register("rich", _t(spark, sf, "supplier").where("s_acctbal > 9000"))
    return Session(cat).join("customer", "rich", ["c_nationkey"], ["s_nationkey"], action="update_left", update_values={"c_mktsegment": "NEAR"})


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate AS s, o_orderdate + to_days(CAST(floor(o_totalprice / 5000) AS INTEGER)) AS e FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o.o_orderkey, r.o_orderkey AS in_o_orderkey FROM orders o JOIN r ON o.o_custkey = r.o_custkey AND o.o_orderdate >= r.s AND o.o_orderdate < r.e""")
def join_within(spark, sf):
    """Orders that fall into the days for which an urgent order of the same customer runs."""
    o = _t(spark, sf, "orders")
    urgent = o.where("o_orderpriority = '1-URGENT'").withColumn("e", F.expr("o_orderdate + make_dt_interval(cast(floor(o_totalprice / 5000) as int))"))
    return joins.within(o, urgent, ["o_custkey"], "o_orderdate", "o_orderdate", "e", ["o_orderkey"], unit=86400.0).select("o_orderkey", "in_o_orderkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark, sf):
    out = aggregates.group(_t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": "count(*)", "total": "sum(o_totalprice)"}, sets=[["o_orderstatus"], ["o_orderpriority"], []])
    return out.withColumn("total", F.round("total", 2))


@query("SELECT * FROM customer WHERE NOT (c_acctbal < 0)")
def mutate_delete(spark, sf):
    steps = [{"op": "open_store", "name": "customer", "result_var": "c"}, {"op": "delete", "store": "c", "condition": {"c_acctbal": {"$lt": 0}}}]
    return pipeline.run(steps, catalog(spark, sf))


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def mutate_delete_left(spark, sf):
    c = _t(spark, sf, "customer")
    hit = joins.join(c, _t(spark, sf, "orders").where("o_totalprice > 450000"), {"c_custkey": "o_custkey"}, "semi")
    return mutations.delete_keys(c, hit, ["c_custkey"])


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def mutate_update_left(spark, sf):
    c = _t(spark, sf, "customer")
    hit = joins.join(c, _t(spark, sf, "orders").where("o_totalprice > 450000"), {"c_custkey": "o_custkey"}, "semi")
    return mutations.update_from(c, hit.select("c_custkey", F.lit("VIP").alias("c_mktsegment")), ["c_custkey"])


@query("SELECT doc_id AS key, text AS value FROM documents WHERE text IS NOT NULL")
def chunk_reassemble(spark, sf):
    return mutations.assemble(mutations.chunk(_t(spark, sf, "documents"), "doc_id", "text", 500))


# control flow


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 3) AND c_acctbal > 100")
def script_control(spark, sf):
    cat = catalog(spark, sf)
    cat.scripts["of_nation"] = [{"op": "scan", "store": "customer", "condition": {"c_nationkey": {"$eq": "{{nation}}"}, "c_acctbal": {"$gt": "{{least}}"}}, "stream": True, "result_var": "r"}, {"op": "return", "value": "@r"}]
    steps = [
        {"op": "assign", "value": 100, "result_var": "least"},
        {"op": "if", "condition": "least > 50", "then": [{"op": "call_script", "name": "of_nation", "params": {"nation": 1, "least": "{{least}}"}, "result_var": "a"}], "else": [{"op": "scan", "store": "region", "result_var": "a"}]},
        {"op": "call_script", "args": {"name": "of_nation", "params": {"nation": 3, "least": "{{least}}"}}, "result_var": "b"},
        {"op": "union", "input_var": "a", "with": "b", "result_var": "u"},
        {"op": "project", "input_var": "u", "fields": ["c_custkey", "c_name"], "result_var": "output"},
    ]
    return pipeline.run(steps, cat)


@query("SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 7")
def slash_command(spark, sf):
    return Session(catalog(spark, sf)).command("/select store=customer c_mktsegment=MACHINERY fields=c_name,c_acctbal limit=7")


# text, vectors and knowledge


def _stop() -> str:
    return ", ".join(f"'{w}'" for w in text.STOP_WORDS)


_TOKENS = f"(SELECT doc_id AS doc, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND t NOT IN ({_stop()}))) AS term FROM documents)"


@query(f"SELECT term, count(DISTINCT doc) AS df, count(*) AS cf FROM {_TOKENS} GROUP BY term")
def token_counts(spark, sf):
    index = search.build(_t(spark, sf, "documents"), "doc_id", "text")
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"""WITH t AS {_TOKENS}, len AS (SELECT d.doc_id AS doc, count(t.term) AS l FROM documents d LEFT JOIN t ON t.doc = d.doc_id GROUP BY 1),
g AS (SELECT count(*) AS n, sum(l) / count(*) AS av FROM len), p AS (SELECT term, doc, count(*) AS tf FROM t WHERE term IN ('vector', 'bucket', 'tombstone') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc, round(sum((CASE WHEN term = 'vector' THEN 2 ELSE 1 END) * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / av))), 6) AS score FROM p JOIN f USING (term) JOIN len USING (doc), g GROUP BY doc""")
def bm25_search(spark, sf):
    index = search.build(_t(spark, sf, "documents"), "doc_id", "text")
    return search.search(index, "vector bucket of the vector tombstone", None).withColumn("score", F.round("score", 6))


_LIST = "[" + ", ".join(["0.1"] * 64) + "]"


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_LIST}), 8) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_LIST}) DESC, vec_id LIMIT 20")
def vec_cosine_topk(spark, sf):
    return vector_store.exact(_t(spark, sf, "embeddings"), "embedding", _ONES, 20, tie="vec_id").select("vec_id", F.round("score", 8).alias("score"))


@query(f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), {_LIST}), 8) AS score FROM embeddings WHERE label <> 3 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_LIST}), vec_id LIMIT 20")
def vec_euclid_topk(spark, sf):
    return vector_store.exact(_t(spark, sf, "embeddings"), "embedding", _ONES, 20, F.col("label") != 3, "euclid", "vec_id").select("vec_id", F.round("score", 8).alias("score"))


_MEANS = "(SELECT label, i, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, i)"


@query(f"SELECT label, i - 1 AS at, round(x, 8) AS x, n FROM {_MEANS}")
def centroid_mean(spark, sf):
    return vector_store.mean_vectors(_t(spark, sf, "embeddings"), "label", "embedding").select("label", F.posexplode("vector").alias("at", "x"), "n").select("label", F.col("at").cast("long").alias("at"), F.round("x", 8).alias("x"), "n")


@query(f"WITH c AS (SELECT label, list(x ORDER BY i) AS v FROM {_MEANS} GROUP BY label), d AS (SELECT vec_id, c.label, list_distance(CAST(embedding AS DOUBLE[]), v) AS d FROM embeddings, c) SELECT vec_id, arg_min(label, d) AS nearest, round(min(d), 8) AS distance FROM d GROUP BY vec_id")
def assign_nearest_label(spark, sf):
    e = _t(spark, sf, "embeddings")
    cents = vector_store.mean_vectors(e, "label", "embedding").select(F.col("label").alias("centroid_id"), "vector")
    return vector_store.assign(e, "embedding", cents).select("vec_id", F.col("centroids")[0].alias("nearest"), F.round("distance", 8).alias("distance"))


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_LIST}), 8) AS score FROM embeddings WHERE label <> 3 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_LIST}) DESC, vec_id LIMIT 10")
def ivf_query(spark, sf):
    """The ten best by the index, which are the true ten; the vectors of one label are marked as deleted."""
    e = _t(spark, sf, "embeddings")
    marked = vector_store.mark_deleted(e.withColumn("is_deleted", F.lit(False)), e.where("label = 3").select("vec_id"), "vec_id")
    store, cents = vector_store.optimize(marked, "embedding", 16)
    return vector_store.query(store, "embedding", cents, _ONES, 10).select("vec_id", F.round("score", 8).alias("score"))


@query("SELECT coalesce(source, '') AS category, count(*) AS item_count, (SELECT count(DISTINCT coalesce(source, '')) FROM documents) AS total_count FROM documents GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 10")
def kb_category_list(spark, sf):
    return knowledge.list_categories(_t(spark, sf, "documents").withColumn("source", F.coalesce("source", F.lit(""))), "source", 1, 10)


@query("SELECT doc_id, title FROM documents WHERE lower(trim(kb_name)) = 'atlas_manuals' AND source = 'glossary' AND starts_with(lower(title), 's')")
def kb_search_path(spark, sf):
    d = _t(spark, sf, "documents").withColumn("path", F.concat_ws("/", "kb_name", "source"))
    return knowledge.by_path(d, "path", "atlas_manuals/glossary", "title", "s").select("doc_id", "title")


@query(f"""WITH h AS (SELECT vec_id AS id, label, list_distance(CAST(embedding AS DOUBLE[]), {_LIST}) AS d FROM embeddings),
q AS (SELECT 'a' AS query, * FROM h WHERE label < 6 UNION ALL SELECT 'b', * FROM h WHERE label > 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS k FROM q), s AS (SELECT id, label, max(1 / (1 + d)) AS score FROM r WHERE k <= 5 AND 1 / (1 + d) >= 0.3 GROUP BY ALL)
SELECT id, CAST(label AS VARCHAR) AS category, round(score, 8) AS score FROM s ORDER BY s.score DESC, category, id LIMIT 6""")
def kb_digest(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", vectors.euclidean("embedding", _ONES).alias("distance"))
    hits = e.where("label < 6").withColumn("query", F.lit("a")).unionByName(e.where("label > 3").withColumn("query", F.lit("b")))
    hits = hits.withColumn("category", F.col("label").cast("string")).withColumn("text", F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 9, "0")))
    return knowledge.digest(hits, "id", 0.3, 5, 6).select("id", "category", F.round("score", 8).alias("score"))


@query(f"""WITH items AS (SELECT d.doc_id AS key, label, CAST(embedding AS DOUBLE[]) AS v, text FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
c AS (SELECT label, list(x ORDER BY i) AS v FROM {_MEANS} GROUP BY label), close AS (SELECT label, list_distance(v, {_LIST}) AS d FROM c ORDER BY d, label LIMIT 1),
near AS (SELECT key, list_distance(v, {_LIST}) - 0.1 * close.d AS score FROM items JOIN close USING (label) ORDER BY score, key LIMIT 10),
t AS (SELECT t.doc, t.term FROM {_TOKENS} t JOIN items ON t.doc = items.key), len AS (SELECT key AS doc, count(t.term) AS l FROM items LEFT JOIN t ON t.doc = key GROUP BY key),
g AS (SELECT count(*) AS n, sum(l) / count(*) AS av FROM len), p AS (SELECT term, doc, count(*) AS tf FROM t WHERE term IN ('vector', 'bucket') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
words AS (SELECT doc AS key, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / av))) AS score FROM p JOIN f USING (term) JOIN len USING (doc), g GROUP BY doc ORDER BY score DESC, doc LIMIT 10)
SELECT key, round(score, 6) AS score, 'semantic' AS search_type FROM near UNION ALL SELECT key, round(score, 6), 'keyword' FROM words WHERE key NOT IN (SELECT key FROM near)""")
def kb_hybrid(spark, sf):
    e, d = _t(spark, sf, "embeddings"), _t(spark, sf, "documents")
    cats = vector_store.mean_vectors(e, "label", "embedding").select(F.col("label").alias("category"), F.col("vector"))
    items = e.join(d, e.vec_id == d.doc_id).select("doc_id", "label", "embedding", "text")
    out = knowledge.hybrid(items, cats, "doc_id", "label", "embedding", "text", _ONES, "vector bucket")
    return out.select("key", F.round("score", 6).alias("score"), "search_type")


# functions


@query("SELECT c_custkey, 'u_' || substr(sha256(c_name), 1, 16) AS hidden FROM customer")
def obfuscate_sha(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", text.obfuscated("c_name", "u").alias("hidden"))


@query("SELECT doc_id, sha256('dim:64::' || coalesce(title, '') || '::' || coalesce(text, '') || '::') AS vector_hash FROM documents")
def vector_hash(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.vector_hash(64, F.col("title"), F.col("text")).alias("vector_hash"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(trim(p_brand || '/' || p_type)), 'c#', 'csharp'), 'c++', 'cpp'), '.net', 'dotnet'), '&', ' and '), '[^\\p{L}\\p{Nd}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def normalize_token(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", text.category_name(F.concat_ws("/", "p_brand", "p_type")).alias("name"))


@query("SELECT vec_id, CASE WHEN list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: 0.1 * x)) - 0.05 >= 0 THEN 1.0 ELSE 0.0 END AS fires FROM embeddings")
def perceptron_predict(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", vectors.perceptron(_ONES, -0.05, "embedding").alias("fires"))


_WORDS = "list_filter(list_transform(string_split_regex(lower(title), '\\s+'), lambda w: trim(w, '.,!?-')), lambda w: w <> '' AND NOT list_contains(['" + "', '".join(text.STOP_WORDS) + "'], w))"


@query(f"""WITH w AS (SELECT doc_id, hex(encode(unnest({_WORDS}))) AS h FROM documents WHERE title IS NOT NULL),
b AS (SELECT doc_id, list_reduce(list_prepend(2166136261, list_transform(range(0, len(h) // 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT))), lambda x, y: (xor(x, y) * 16777619) % 4294967296) % 32 AS place FROM w),
n AS (SELECT doc_id, place, count(*) AS n FROM b GROUP BY ALL)
SELECT doc_id, CAST(place AS INTEGER) AS at, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM n""")
def embed_hash(spark, sf):
    rows = text.embed_by_hashing(_t(spark, sf, "documents").select("doc_id", "title"), "title", "vector", 32, text.STOP_WORDS)
    return rows.select("doc_id", F.posexplode("vector").alias("at", "v")).where("v <> 0").select("doc_id", "at", F.round(F.col("v").cast("double"), 6).alias("x"))


@query("SELECT doc_id, CASE WHEN regexp_matches(coalesce(title, ''), 'cold') THEN ['cold'] ELSE [] END || CASE WHEN regexp_matches(coalesce(title, ''), '[0-9]') THEN ['digit'] ELSE [] END AS labels FROM documents")
def guard_regex(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", guard.labelled(F.coalesce("title", F.lit("")), {"cold": "cold", "digit": "[0-9]"}).alias("labels"))


@query("SELECT event_id, CASE WHEN (event_type = 'error' AND value >= 60) OR (event_type = 'view' AND value >= 95) THEN 'block' ELSE 'allow' END AS decision FROM events")
def guard_threshold(spark, sf):
    return _t(spark, sf, "events").select("event_id", guard.chain(guard.threshold("event_type", "value", ["error"], 60), guard.threshold("event_type", "value", ["view"], 95)).alias("decision"))


@query("""WITH b AS (SELECT event_id, user_id, ts, event_type = 'error' AS v, event_type IN ('error', 'click', 'view') AS i FROM events),
r AS (SELECT *, sum(CASE WHEN i AND NOT v THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM b),
c AS (SELECT *, CAST(sum(CASE WHEN i AND v THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS strikes FROM r),
l AS (SELECT *, bool_or(v AND strikes >= 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS locked FROM c)
SELECT event_id, strikes, locked, CASE WHEN v OR locked THEN 'block' ELSE 'allow' END AS decision FROM l""")
def guard_strikes(spark, sf):
    e = _t(spark, sf, "events")
    out = guard.strikes(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type").isin("error", "click", "view"), 3)
    return out.select("event_id", "strikes", "locked", "decision")


@query("""WITH b AS (SELECT event_id, user_id, ts, event_type = 'error' AS v, event_type IN ('error', 'click', 'view') AS i FROM events),
r AS (SELECT *, sum(CASE WHEN i AND NOT v THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM b),
c AS (SELECT *, CAST(sum(CASE WHEN i AND v THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS strikes FROM r),
l AS (SELECT *, bool_or(v AND strikes >= 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS locked FROM c)
SELECT event_id, strikes, locked, CASE WHEN v OR locked THEN 'block' ELSE 'allow' END AS decision FROM l""")
def guard_strikes_spans(spark, sf):
    """The same with sessions divided into days."""
    e = _t(spark, sf, "events")
    out = guard.strikes(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type").isin("error", "click", "view"), 3, 86400.0)
    return out.select("event_id", "strikes", "locked", "decision")


@query("SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def stm_ttl(spark, sf):
    return retention.retained(_t(spark, sf, "events"), "ts", "2 days")


@query("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def stm_dedupe(spark, sf):
    return retention.first_of_each(_t(spark, sf, "events"), "user_id", "ts")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    return retention.windowed(_t(spark, sf, "events"), "ts", "1 hour", None, "10 minutes", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM n GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    return retention.sessions(_t(spark, sf, "events"), "ts", "6 hours", "10 minutes", "user_id")


@query("""WITH r AS (SELECT trim(p_name) AS text, replace(trim(p_brand), '_', ' ') AS b, replace(trim(p_type), '_', ' ') AS t FROM part WHERE trim(p_name) <> ''),
h AS (SELECT *, list_reduce(list_prepend(2166136261, list_transform(string_split(text || b || t, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS n FROM r)
SELECT lower(replace(text, ' ', '_')) || '_' || printf('%x', n) AS id, text, 'Symptoms: ' || b || ', ' || t AS description FROM h""")
def etl_prepare(spark, sf):
    return etl.prepare(_t(spark, sf, "part"), "p_name", ["p_brand", "p_type"])


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def coerce_json_field(spark, sf):
    from flowstore.functions import coercion

    return _t(spark, sf, "events").select("event_id", coercion.to_number(coercion.field("props", "k")).alias("k"))


@query("SELECT doc_id, title, source, CAST((SELECT count(*) FROM documents WHERE source = 'glossary') AS BIGINT) AS total_count FROM documents WHERE source = 'glossary' ORDER BY doc_id LIMIT 10 OFFSET 10")
def space_items(spark, sf):
    cat = catalog(spark, sf)
    cat.register("space", _t(spark, sf, "documents").select("doc_id", "title", "source"))
    return pipeline.run([{"op": "list_space_items", "space": "space", "category_field": "source", "category": "glossary", "key": "doc_id", "page_offset": 1, "page_size": 10}], cat)


@query(f"""WITH c AS (SELECT label, list(x ORDER BY i) AS v FROM {_MEANS} GROUP BY label),
a AS (SELECT label, list_distance(v, {_LIST}) AS d FROM c WHERE label < 4 ORDER BY d, label LIMIT 2),
b AS (SELECT a.label AS parent, c.label, a.d + list_distance(v, {_LIST}) AS d, row_number() OVER (PARTITION BY a.label ORDER BY list_distance(v, {_LIST}), c.label) AS k FROM a JOIN c ON c.label >= 4 AND c.label % 4 = a.label)
SELECT label AS category, round(d, 8) AS distance FROM b WHERE k <= 2""")
def kb_resolve_path(spark, sf):
    cents = vector_store.mean_vectors(_t(spark, sf, "embeddings"), "label", "embedding")
    cats = cents.select(F.col("label").alias("category"), F.when(F.col("label") >= 4, F.col("label") % 4).alias("parent"), "vector")
    return knowledge.resolve_path(cats, [_ONES, _ONES], 2).withColumn("distance", F.round("distance", 8))

import pytest
from pyspark.sql import functions as F

from flowstore.api import Session
from flowstore.operators import aggregates, joins, mutations, scans
from flowstore.plans import pipeline
from flowstore.sources import files
from flowstore.sources.catalog import Catalog, Conflict, IndexField, StoreMeta, relations


@pytest.fixture
def cat(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    users = [(f"u{i}", "John" if i <= 25 else "Jane", 20 + i) for i in range(1, 36)]
    total = lambda i: 500 + 50 * i if i <= 22 else 100 + 10 * i if i <= 25 else 200 + 30 * i
    c.register("users", spark.createDataFrame(users, "key string, first_name string, age long"))
    c.register("orders", spark.createDataFrame([(f"o{i}", total(i)) for i in range(1, 31)], "key string, total_amount long"))
    c.register("users_orders", spark.createDataFrame([(f"u{i}", f"o{i}") for i in range(1, 31)], "key string, value string"))
    return c


def test_relation_bridge_gives_22_rows(cat):
    steps = [
        {"op": "scan", "args": {"store": "users", "filter": {"first_name": {"$eq": "John"}}}, "result_var": "u"},
        {"op": "join", "input_var": "u", "args": {"relation": "users_orders", "target": "orders"}},
        {"op": "filter", "args": {"condition": {"orders.total_amount": {"$gt": 500}}}},
        {"op": "return"},
    ]
    assert pipeline.run(steps, cat).count() == 22
    steps[0]["args"].pop("filter")
    assert pipeline.run(steps, cat).count() == 27


def test_wrapped_text_and_flat_arguments(cat):
    script = '{"steps": [{"op": "scan", "store": "users", "limit": 3, "direction": "desc"}, {"op": "project", "fields": ["key as k"]}]}'
    assert [r.k for r in pipeline.run(script, cat).collect()] == ["u9", "u8", "u7"]


@pytest.mark.parametrize(
    "steps",
    [
        [{"op": "fly"}],
        [{"op": "filter", "condition": {"a": 1}}],
        [{"op": "scan", "store": "users", "result_var": "a"}, {"op": "filter", "input_var": "b", "condition": {"a": 1}}],
        [{"op": "scan", "store": "users"}, {"op": "return"}, {"op": "limit", "limit": 1}],
        [{"store": "users"}],
    ],
)
def test_scripts_that_cannot_be_compiled(cat, steps):
    with pytest.raises(ValueError):
        pipeline.run(steps, cat)


def test_control_flow_lists_and_cleanup(cat):
    env = pipeline.execute(
        [
            {"op": "list_new", "items": [1, 2], "result_var": "l"},
            {"op": "list_append", "list": "l", "item": 3, "result_var": "l"},
            {"op": "assign", "value": 0, "result_var": "x"},
            {"op": "defer", "step": {"op": "assign", "value": "done", "result_var": "end"}},
            {"op": "loop", "list": "@l", "item_var": "i", "body": [{"op": "assign", "value": "{{i}}", "result_var": "x"}]},
            {"op": "if", "condition": "x == 3", "then": [{"op": "assign", "value": "yes", "result_var": "y"}], "else": [{"op": "assign", "value": "no", "result_var": "y"}]},
            {"op": "map_merge", "maps": [{"a": 1, "b": 1}, {"b": 2}], "result_var": "m"},
        ],
        cat,
    )
    assert env.vars["x"] == 3 and env.vars["y"] == "yes" and env.vars["m"] == {"a": 1, "b": 2} and env.vars["end"] == "done"


def test_transactions_roll_back_and_commit_open_stores(cat, spark, tmp_path):
    n = lambda c=cat: c.read("users").count()
    opened, delete, scan = {"op": "open_store", "name": "users", "result_var": "u"}, {"op": "delete", "store": "u", "condition": {"first_name": "Jane"}}, {"op": "scan", "store": "u", "stream": True}
    got = pipeline.run([opened, {"op": "begin_tx"}, delete, {"op": "rollback_tx"}, scan], cat)
    assert got.count() == n() == 35
    got = pipeline.run([{"op": "begin_tx"}, opened, delete, {"op": "rollback_tx"}, scan], cat)
    assert got.count() == n() == 35
    with pytest.raises(pipeline.ScriptError):
        pipeline.execute([{"op": "begin_tx"}, {"op": "begin_tx"}], cat)
    with pytest.raises(Exception):  # noqa: B017
        pipeline.execute([opened, {"op": "begin_tx"}, delete, {"op": "open_store", "name": "absent"}], cat)
    assert n() == 35  # a step that fails rolls back
    other = Catalog(spark, str(tmp_path), home=cat.home)
    other.register("users", cat.read("users"))
    assert pipeline.run([opened, {"op": "begin_tx"}, delete, {"op": "commit_tx"}, scan], cat).count() == n() == 25
    assert Catalog(spark, str(tmp_path)).read("users").count() == 25
    with pytest.raises(Conflict):
        other.commit(["users"], {})
    assert Catalog(spark, str(tmp_path)).read("users").count() == 25


def test_a_store_is_saved_again_and_read_in_the_session(cat, spark, tmp_path):
    cat.save("users")
    for left in (25, 20):
        cat.register("users", cat.read("users").limit(left), cat.metas["users"])
        cat.save("users")
        assert cat.read("users").count() == Catalog(spark, str(tmp_path)).read("users").count() == left
    assert len(cat.vacuum()) == 2 and cat.read("users").count() == 20


def test_databases_keep_what_was_registered(cat, spark, tmp_path):
    both = Catalog(spark, str(tmp_path), databases={"b": str(tmp_path / "b")})
    both.database("b").register("t", spark.range(3))
    steps = [{"op": "open_db", "name": "b"}, {"op": "begin_tx"}, {"op": "delete", "store": "t", "condition": {"id": 1}}, {"op": "open_db", "name": "current"}, {"op": "rollback_tx"}]
    pipeline.execute(steps, both)
    assert both.database("b").read("t").count() == 3 and both.tables == {}


def test_any_step_can_save_what_it_gives(cat):
    pipeline.execute([{"op": "scan", "store": "users", "stream": True}, {"op": "group_by", "by": ["users.first_name"], "aggregates": {"n": "count(*)"}, "save_to": "names"}], cat)
    assert cat.read("names").count() == cat.read("users").select("first_name").distinct().count()
    lines = [r.line for r in pipeline.run([{"op": "explain_join", "left_store": "users", "right_store": "orders", "on": {"key": "key"}}], cat).collect()]
    assert lines[0] == "users.key = orders.key" and lines[1].startswith("seek")


def test_changes_of_repeated_and_null_keys(spark):
    from flowstore.operators import mutations

    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (None, "m"), (2, "z")], "k int, v string")
    assert sorted(map(str, map(tuple, mutations.upsert(old, new, ["k"]).collect()))) == ["(1, 'y')", "(2, 'z')", "(None, 'm')"]
    assert sorted(map(str, map(tuple, mutations.add(old, new.unionByName(new.where("k = 2").withColumn("v", F.lit("late"))), ["k"]).collect()))) == ["(1, 'a')", "(2, 'z')", "(None, 'n')"]
    assert sorted(map(str, map(tuple, mutations.update_from(old, new, ["k"]).collect()))) == ["(1, 'y')", "(None, 'n')"]
    data = spark.createDataFrame([("a", bytearray(range(256)) * 3), ("b", bytearray())], "k string, v binary")
    assert {r.key: bytes(r.value) for r in mutations.assemble(mutations.chunk(data, "k", "v", 100)).collect()} == {"a": bytes(range(256)) * 3, "b": b""}


def test_bulk_changes_name_their_errors(cat, spark):
    from flowstore.api import BulkError, Session

    cat.register("t", spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int"))
    s = Session(cat)
    new = spark.createDataFrame([(2, "x", 0), (3, "y", 0), (3, "z", 0), (None, "n", 0)], "k int, v string, w int")
    got = s.bulk("t", new, "add")
    assert sorted((r.k or 0, r.error) for r in got.errors.collect()) == [(0, "null key"), (2, "exists"), (3, "repeated")]
    assert tuple(got.counts().first()) == (1, 3) and {r.k: r.v for r in cat.read("t").collect()} == {1: "a", 2: "b", 3: "y"}
    with pytest.raises(BulkError):
        s.bulk("t", new, "add", "single")
    assert s.bulk("t", spark.createDataFrame([(1, None, 9), (8, "q", 9)], "k int, v string, w int"), "update", "explicit").table.where("w = 9").first().v == "a"
    assert cat.read("t").where("w = 9").count() == 0
    assert {r.k: r.v for r in s.bulk_upsert("t", new).collect()} == {1: "a", 2: "x", 3: "z"}
    assert [r.k for r in s.bulk_delete("t", new).collect()] == [1]
    assert s.bulk("t", new.limit(0), "delete").errors.count() == 0


def test_phrases():
    from flowstore.functions.phrases import Phrase, parse_phrase

    assert parse_phrase("kb:Language: Go/page/4 :LLM be short", "KB") == Phrase("Language: Go", "Language/Go", 4, "be short")
    assert parse_phrase("kb:page:3", "kb") == Phrase("", None, 3)
    assert parse_phrase("'cold cats'") == Phrase("cold cats")
    assert parse_phrase("a:llmx page:0") == Phrase("a:llmx page:0", "a/llmx page/0")
    assert parse_phrase("a\\b", "kb") == Phrase("a\\b", "a/b") and parse_phrase("") == Phrase("")


def test_changes_in_scripts(cat):
    pipeline.execute([{"op": "add", "store": "orders", "key": "o99", "value": {"total_amount": 7}}, {"op": "update", "store": "orders", "key": "o99", "values": {"total_amount": 8}}], cat)
    assert cat.read("orders").where("key = 'o99'").first().total_amount == 8
    pipeline.execute([{"op": "scan", "store": "orders", "condition": {"total_amount": {"$lt": 10}}}, {"op": "delete", "store": "orders"}], cat)
    assert cat.read("orders").count() == 30


def test_join_into_a_store(cat):
    pipeline.execute([{"op": "scan", "store": "users"}, {"op": "join", "store": "users_orders", "on": {"users.key": "key"}, "into": "pairs"}], cat)
    assert cat.read("pairs").count() == 30 and cat.read("pairs").select("key").distinct().count() == 30


def test_composite_keys_select(spark, tmp_path):
    rows = [(1, "A", "admin", "Alice"), (2, "A", "user", "Bob"), (3, "B", "admin", "Charlie"), (4, "B", "user", "Dave"), (5, "A", "guest", "Eve")]
    c = Catalog(spark, str(tmp_path))
    c.register("u", spark.createDataFrame(rows, "id long, group string, role string, value string"), StoreMeta("u", (IndexField("id"), IndexField("group"), IndexField("role"))))
    s = Session(c)
    pick = lambda **k: [r.value for r in s.select("u", **k).collect()]
    assert pick(group="A") == ["Alice", "Bob", "Eve"]
    assert pick(key={"role": "admin"}) == ["Alice", "Charlie"]
    assert pick(group="A", role="admin") == ["Alice"]
    assert pick(group="C") == []
    with pytest.raises(ValueError, match="unknown field"):
        pick(group_by="A")
    assert [r.value for r in s.command("/select store=u group=B fields=value").collect()] == ["Charlie", "Dave"]


def test_inner_then_right_join(spark, tmp_path):
    u = spark.createDataFrame([(1.0, "Alice"), (2.0, "Bob")], "uid double, name string")
    o = spark.createDataFrame([(101, 1.0, "Book"), (102, 1.0, "Pen")], "oid long, uid double, item string")
    f = spark.createDataFrame([("F1", 101, "Great"), ("F2", 999, "Unknown")], "fid string, oid long, msg string")
    j = joins.join(joins.join(u, o, ["uid"], "inner", "u", "o"), f, {"o.oid": "oid"}, "right_outer", None, "f")
    assert sorted((r["f.fid"], r["u.name"]) for r in j.collect()) == [("F1", "Alice"), ("F2", None)]


def test_text_meets_numbers_and_nulls_meet_nothing(spark):
    a = spark.createDataFrame([("1",), ("x",), (None,)], "k string")
    b = spark.createDataFrame([(1,), (None,)], "k int")
    assert joins.join(a, b, ["k"], "inner", "a", "b").count() == 1
    c = b.withColumnRenamed("k", "k")
    assert joins.join(b, c, ["k"], "inner", "a", "b", null_safe=True).count() == 2


def test_relations_and_explanations():
    o = StoreMeta("orders", (IndexField("id"),), relations({"user_id": "users.id"}))
    u = StoreMeta("users", (IndexField("id"), IndexField("region")))
    assert joins.relation_of(o, u) == [("user_id", "id")] and joins.relation_of(u, o) == [("id", "user_id")]
    assert joins.explain_join(o, u, ["user_id"], ["id"])[-1].startswith("seek by prefix")
    assert joins.explain_join(o, u, ["user_id"], ["region"])[-1].startswith("hash")


def test_asof_strict_and_ties(spark):
    a = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), (None, 5, "z")], "k string, t int, n string")
    b = spark.createDataFrame([("k", 5, 1), ("k", 5, 2), ("k", 3, 0)], "k string, t int, v int")
    got = {r.n: r.asof_v for r in joins.asof(a, b, ["k"], "t", "t", ["v"]).collect()}
    assert got == {"x": 2, "y": None, "z": None}
    assert {r.n: r.asof_v for r in joins.asof(a, b, ["k"], "t", "t", ["v"], strict=True).collect()}["x"] == 0


def test_nearest_key_rules(spark):
    df = spark.createDataFrame([(10,), (20,), (30,)], "k int")
    near = lambda v, d=False: scans.find_nearest(df, "k", v, d).first()[0]
    assert [near(20), near(15), near(99), near(1)] == [20, 20, 30, 10]
    assert [near(15, True), near(1, True), near(99, True)] == [10, 10, 30]


def test_sets_and_groups(spark):
    a, b = spark.createDataFrame([(1, 5), (1, 9)], "k int, s int"), spark.createDataFrame([(1, 7), (2, 1)], "k int, s int")
    assert sorted(tuple(r) for r in aggregates.union([a, b], ["k"], "s").collect()) == [(1, 9), (2, 1)]
    assert sorted(tuple(r) for r in aggregates.group(a, ["k"], {"n": "count(*)", "m": {"max": "s"}}, {"n": {"$gt": 1}}).collect()) == [(1, 2, 9)]
    with pytest.raises(ValueError):
        aggregates.group(a, ["k"], {"n": "median9(s)"})


def test_mutations_keep_other_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "n"), (3, "m")], "k int, v string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(mutations.add(df, new, ["k"]))[2] == (3, "m") and mutations.add(df, new, ["k"]).count() == 3
    assert rows(mutations.upsert(df, new, ["k"])) == [(1, "a"), (2, "n"), (3, "m")]
    assert rows(mutations.update(df, {"k": 1}, {"v": "z"}))[0] == (1, "z")
    assert mutations.delete(df, {"v": "a"}).count() == 1
    assert rows(mutations.rekey(df, "k", 1, 9))[-1] == (9, "a") and rows(mutations.rekey(df, "k", 1, 2))[0] == (1, "a")
    assert rows(mutations.assemble(mutations.chunk(df.fillna(""), "k", "v", 1))) == [(1, "a"), (2, "")]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, "x\ny")], "i int, t string")
    for kind in ("csv", "jsonl", "parquet", "orc"):
        files.write(df, str(tmp_path / kind), kind)
        back = files.read(spark, str(tmp_path / kind), kind, None if kind in ("parquet", "orc") else "i int, t string")
        assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    with pytest.raises(ValueError):
        files.read(spark, "x", "xml")


def test_saved_store_is_read_back(cat, tmp_path):
    cat.save("users")
    assert Catalog(cat.spark, str(tmp_path)).read("users").count() == 35
    assert {r.store for r in cat.list_stores().collect()} == {"users", "orders", "users_orders"}
    assert cat.inspect("users").first()["count"] == 35
    assert cat.create("empty").count() == 0


def test_pushdown_reaches_the_scan(cat, spark, tmp_path):
    cat.save("orders")
    df = pipeline.run([{"op": "scan", "store": "orders", "condition": {"total_amount": {"$gt": 5}}, "stream": True}, {"op": "project", "fields": ["total_amount"]}], Catalog(spark, str(tmp_path)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(total_amount,5)" in plan and "ReadSchema: struct<total_amount:bigint>" in plan
    assert df.agg(F.count("*")).first()[0] == 30

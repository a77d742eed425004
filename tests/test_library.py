import pytest
from pyspark.sql import functions as F

from flowstore.api import Session
from flowstore.functions import coercion, learning
from flowstore.operators import knowledge, vector_store
from flowstore.plans import pipeline
from flowstore.sources.catalog import Catalog
from flowstore.sources.library import Library, Scripts


def test_models_are_saved_listed_and_deleted(spark, tmp_path):
    lib = Library(str(tmp_path), spark)
    lib.save("nn", "a", {"w": 0})
    lib.save("nn", "a", {"w": [1, 2]})
    assert lib.get("nn", "a") == {"w": [1, 2]} and lib.list("nn") == ["a"] and lib.list("none") == []
    assert lib.delete("nn", "a") and not lib.delete("nn", "a")
    with pytest.raises(KeyError):
        lib.get("nn", "a")
    with pytest.raises(ValueError):
        lib.save("..", "a", 1)


def test_scripts_are_checked_when_they_change(spark, tmp_path):
    s = Scripts(str(tmp_path), spark)
    s.put("top", [{"op": "scan", "store": "t", "limit": 5}, {"op": "project", "fields": ["k"]}])
    s.insert("top", 1, {"op": "filter", "condition": {"k": {"$gt": 1}}})
    with pytest.raises(pipeline.ScriptError):
        s.replace("top", 0, {"op": "fly"})
    with pytest.raises(pipeline.ScriptError):
        s.move("top", 0, 2)
    cat = Catalog(spark, str(tmp_path))
    cat.register("t", spark.createDataFrame([(1,), (2,)], "k int"))
    s.load_into(cat)
    assert [r.k for r in Session(cat).select("top").collect()] == [2]
    assert list(Session(cat).stream([{"op": "call_script", "name": "top"}])) == [{"k": 2}]
    s.remove("top", 1)
    assert len(s.steps("top")) == 2


def test_spaces_in_scripts(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    rows = [(1, "Tech", "cold cats", [0.0, 0.0], None), (2, "Law", "warm dogs", [1.0, 0.0], None)]
    cat.register("s", spark.createDataFrame(rows, "id int, category string, text string, vector array<double>, vector_hash string"))
    run = lambda *steps: [r[0] for r in pipeline.run(list(steps), cat).collect()]
    assert run({"op": "search_space", "space": "s", "query": "dogs"}) == [2]
    assert run({"op": "search_space", "space": "s", "path": "tech"}) == [1]
    assert run({"op": "search_space", "space": "s", "vector": [1.0, 0.0], "limit": 1}) == [2]
    assert run({"op": "search_space", "space": "s", "vector": [1.0, 0.0], "condition": {"category": "Tech"}}) == [1]
    assert run({"op": "search_space", "space": "s", "query": "cold warm", "category": "Tech"}) == [1]
    assert run({"op": "search_space", "space": "s", "query": "dogs", "condition": "id < 2"}) == []
    assert sorted(run({"op": "list_space_categories", "space": "s"})) == ["Law", "Tech"]
    run({"op": "upsert_space_items", "space": "s", "rows": [{"id": 3, "category": "Law", "text": "birds", "vector": [0.0, 1.0]}]})
    run({"op": "vectorize_space", "space": "s", "dim": 8})
    vectors = {r.id: r.vector for r in cat.read("s").collect()}
    assert len(vectors[3]) == 8 and cat.read("s").where("vector_hash is null").count() == 0
    run({"op": "delete_space_categories", "space": "s", "values": ["Law"]})
    assert run({"op": "scan", "store": "s"}) == [1]


def test_steps_of_the_high_level_kind(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.register("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    env = pipeline.execute([{"op": "set", "value": 2, "result_var": "n"}, {"op": "block", "body": [{"op": "fetch", "store": "t", "key": "{{n}}", "result_var": "row"}]}, {"op": "say", "text": "n is {{n}}", "result_var": "said"}, {"op": "command", "command": "/select store=t k=1", "result_var": "one"}], cat)
    assert env.vars["said"] == "n is 2" and env.vars["row"].first().v == "b" and env.vars["one"].first().v == "a"
    assert cat.list_databases().count() == 1


def test_coercion(spark):
    df = spark.sql("select '1.5' as a, 'x' as b, '{\"p\": {\"q\": 7}}' as j, map('k', 1, 'l', 2) as m, map('k', 3) as n, struct(1 as id, 2 as x) as key, struct(9 as x) as value")
    row = df.select(coercion.to_number("a"), coercion.to_number("b"), coercion.field("j", "p.q"), coercion.field("a", "p"), coercion.merged(F.col("m"), F.col("n")), coercion.like("a", "int")).first()
    assert (row[0], row[1], row[2], row[3], row[4]) == (1.5, None, "7", None, {"k": 3, "l": 2})
    assert coercion.flat(df, "key", "value").first().asDict() == {"id": 1, "x": 9}


def test_perceptron_learns_or(spark):
    df = spark.createDataFrame([(i, [float(a), float(b)], float(a or b)) for i, (a, b) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)])], "i int, x array<double>, y double")
    w, b = learning.train(df, "x", "y", "i", rounds=30)
    assert [1.0 if w[0] * r.x[0] + w[1] * r.x[1] + b >= 0 else 0.0 for r in df.orderBy("i").collect()] == [0.0, 1.0, 1.0, 1.0]


def test_vector_store_get_count_consolidate_and_migration(spark):
    store = spark.createDataFrame([(1, [0.0, 0.0], 1, False, '{"text": "a", "cat": "x"}'), (2, [5.0, 5.0], 2, True, "{}")], "id int, v array<double>, centroid_id int, is_deleted boolean, payload string")
    cents = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], "centroid_id int, vector array<double>")
    assert vector_store.get(store, 2).count() == 0 and vector_store.count(store).first().n == 1
    both = vector_store.consolidate(store, spark.createDataFrame([(3, [4.0, 4.0], "{}")], "id int, v array<double>, payload string"), "v", cents)
    assert both.where("id = 3").first().centroid_id == 2
    items = knowledge.from_vectors(store, "id", "v", "payload", "cat")
    assert [tuple(r)[:3] for r in items.collect()] == [(1, "x", "a")]
    cats = spark.createDataFrame([("near", [0.0, 0.0]), ("far", [9.0, 9.0])], "category string, vector array<double>")
    got = knowledge.ingest_thoughts(items, cats, spark.createDataFrame([(7, None, "t", [8.0, 8.0])], "id int, category string, text string, vector array<double>"), "vector", "id", "category")
    assert got.where("id = 7").first().category == "far"


def test_identifiers_are_labelled(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.register("t", spark.createDataFrame([("3f2504e0-4f89-11d3-9a0c-0305e82c3301", "x", 1)], "id string, name string, n int"))
    assert cat.inspect("t").first().schema == {"id": "uuid", "name": "string", "n": "number"}


def test_space_categories_in_scripts(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.register("c", spark.createDataFrame([("1", "Tech", [], None)], "id string, name string, parents array<string>, vector array<double>"))
    cat.register("s", spark.createDataFrame([(1, "2", [1.0, 3.0]), (2, "2", [3.0, 5.0])], "id int, category string, vector array<double>"))
    pipeline.execute([{"op": "upsert_space_categories", "categories": "c", "rows": [{"id": "2", "name": "Go", "parents": ["tech"]}]}, {"op": "vectorize_space_categories", "space": "s", "categories": "c"}], cat)
    got = {r.id: (r.parents, r.vector) for r in cat.read("c").collect()}
    assert got == {"1": ([], None), "2": (["1"], [2.0, 4.0])}


def test_phrases_search_a_space_by_pages(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.register("kb", spark.createDataFrame([(i, "Tech/Go" if i < 5 else "Law", f"cold text {i}") for i in range(9)], "id int, category string, text string"))
    s = Session(cat)
    assert [r.id for r in s.search("kb", "kb:tech:go/page/2 :llm briefly", page_size=3).collect()] == [3, 4]
    assert s.search("kb", "cold", page_size=4).count() == 4 and s.search("kb", "cold:page:3", page_size=4).count() == 1

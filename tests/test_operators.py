import random
import time

import pytest
from pyspark.sql import functions as F

from flowstore.operators import etl, guard, joins, knowledge, search, vector_store
from flowstore.streaming import retention, strikes


def test_bm25_known_scores(spark):
    docs = spark.createDataFrame([("docA", "apple"), ("docB", "apple apple apple"), ("docC", "apple banana cherry date elderberry fig grape honeydew"), ("docD", "banana cherry")], "d string, t string")
    got = [(r.doc, round(r.score, 6)) for r in search.search(search.build(docs, "d", "t"), "apple").collect()]
    assert got == [("docB", 0.578189), ("docA", 0.503926), ("docC", 0.233736)]
    pets = spark.createDataFrame([("doc1", "cat"), ("doc2", "dog"), ("doc3", "cat dog")], "d string, t string")
    got = [(r.doc, round(r.score, 6)) for r in search.search(search.build(pets, "d", "t", persist=True), "cat dog").collect()]
    assert got == [("doc3", 0.780383), ("doc1", 0.523548), ("doc2", 0.523548)]
    assert search.search(search.build(pets, "d", "t"), "the").count() == 0


def test_vector_store_life(spark):
    df = spark.createDataFrame([(1, [0.1, 0.1]), (2, [2.1, 2.1]), (3, [2.2, 2.2]), (4, [9.9, 10.0])], "id int, v array<double>")
    cents = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 2.0]), (3, [10.0, 10.0])], "centroid_id int, vector array<double>")
    near = vector_store.assign(df, "v", cents, 2)
    assert {r.id: r.centroids for r in near.collect()} == {1: [1, 2], 2: [2, 1], 3: [2, 1], 4: [3, 2]}
    stored = near.withColumn("centroid_id", F.col("centroids")[0]).drop("centroids", "distance")
    assert sorted(r.id for r in vector_store.query(stored, "v", cents, [2.0, 2.1], 2, 1).collect()) == [2, 3]
    changed = vector_store.mark_deleted(vector_store.upsert(df.withColumn("is_deleted", F.lit(False)), df.where("id = 1")), df.where("id = 2").select("id"))
    assert sorted((r.id, r.is_deleted) for r in changed.collect()) == [(1, False), (2, True), (3, False), (4, False)]
    store, new = vector_store.optimize(changed, "v", 2)
    assert store.count() == 3 and new.count() == 2
    parted, four = vector_store.split_centroid(stored, "v", 2, cents)
    assert four.count() == 4 and {r.id: r.centroid_id for r in parted.collect()}[1] == 1
    own = {r.centroid_id: r.vector for r in four.collect()}
    assert all(own[r.centroid_id] == r.v for r in parted.where("id in (2, 3)").collect())
    assert vector_store.add_centroid(cents, [5.0, 5.0]).where("centroid_id = 4").count() == 1


def test_deleted_vectors_are_not_found(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 2)], "id int, v array<double>, centroid_id int")
    cents = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "centroid_id int, vector array<double>")
    gone = vector_store.mark_deleted(df.withColumn("is_deleted", F.lit(False)), df.where("id = 1").select("id"))
    assert [r.id for r in vector_store.exact(gone, "v", [1.0, 0.0], 5).collect()] == [2, 3]
    assert [r.id for r in vector_store.query(gone, "v", cents, [1.0, 0.0], 5).collect()] == [2, 3]
    back = vector_store.upsert(gone, df.where("id = 1"))
    assert [r.id for r in vector_store.exact(back, "v", [1.0, 0.0], 1).collect()] == [1]


@pytest.mark.parametrize("block", [3, 20_000])
def test_assignment_in_blocks_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_store, "BLOCK", block)
    rng = random.Random(2)
    v = [[rng.randint(0, 3) * 1.0 for _ in range(3)] for _ in range(60)]
    c = [[rng.randint(0, 3) * 1.0 for _ in range(3)] for _ in range(11)] + [[1.0, 1.0, 1.0]] * 9
    df = spark.createDataFrame([*enumerate(v), (90, None), (91, [1.0]), (92, [float("nan"), 0.0, 0.0])], "id int, v array<double>").withColumn("distance", F.lit("old"))
    cents = spark.createDataFrame(list(enumerate(c, 1)), "centroid_id int, vector array<double>")
    got = {r.id: (r.centroids, r.distance) for r in vector_store.assign(df, "v", cents, 3).collect()}
    for i, x in enumerate(v):
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5, k) for k, y in enumerate(c, 1))[:3]
        assert got[i] == ([k for _, k in near], near[0][0])
    assert got[90] == got[91] == (None, None) and got[92][0] is not None or got[92] == (None, None)
    assert vector_store.assign(df, "v", cents.limit(0)).where("centroids is not null").count() == 0
    assert vector_store.assign(df.limit(0), "v", cents).count() == 0


def test_batches_assign_and_drift_centroids(spark):
    new = spark.createDataFrame([(i, [float(i % 2 * 10), 0.0]) for i in range(40)], "id int, v array<double>")
    none = new.limit(0).withColumn("is_deleted", F.lit(False)).withColumn("centroid_id", F.lit(1))
    store, cents = vector_store.upsert_batch(none, new, "v", None)
    assert store.count() == 40 and cents.count() == 2  # as many as there are different vectors
    cents = spark.createDataFrame([(1, [0.0, 0.0]), (2, [10.0, 0.0])], "centroid_id int, vector array<double>")
    store = vector_store.placed(new, "v", cents)
    later, moved = vector_store.upsert_batch(store, spark.createDataFrame([(100, [2.1, 0.0]), (0, [9.0, 0.0])], "id int, v array<double>"), "v", cents)
    assert later.count() == 41 and later.where("id = 0").first().centroid_id == 2
    got = {r.centroid_id: [round(x, 6) for x in r.vector] for r in moved.collect()}
    assert got == {1: [0.1, 0.0], 2: [round((20 * 10 + 9) / 21, 6), 0.0]}


def test_index_finds_what_exact_search_finds(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(600)], "id int, v array<double>")
    store, cents = vector_store.optimize(df, "v", 12)
    store, cents = store.cache(), vector_store.reaches(store, "v", cents).cache()
    missed = 0
    for n in range(5):
        target = [rng.gauss(0, 1) for _ in range(16)]
        want = [r.id for r in vector_store.exact(df, "v", target, 10).collect()]
        assert [r.id for r in vector_store.query(store, "v", cents if n else cents.drop("reach"), target, 10).collect()] == want
        assert {r.id for r in vector_store.query(store, "v", cents, target, 10, where=F.col("id") % 2 == 0).collect()} == {r.id for r in vector_store.exact(df, "v", target, 10, F.col("id") % 2 == 0).collect()}
        missed += len(set(want) - {r.id for r in vector_store.query(store, "v", cents, target, 10, vector_store.PROBES).collect()})
    assert missed > 0  # the first cells alone are not enough
    # narrow cells that cannot reach the k-th score are not scanned
    tight = spark.createDataFrame([(i, [float(d == i % 4) + rng.gauss(0, 0.01) for d in range(4)]) for i in range(80)], "id int, v array<double>")
    store, cents = vector_store.optimize(tight, "v", 4)
    hit = vector_store.query(store, "v", cents, [1.0, 0.0, 0.0, 0.0], 5)
    assert {r.id % 4 for r in hit.collect()} == {0}


def test_knowledge_paths_and_staleness(spark):
    items = spark.createDataFrame([(1, "Tech/C#", "Intro"), (2, "tech/csharp/Deep", "intro two"), (3, "Law", "Intro")], "id int, cat string, t string")
    assert sorted(r.id for r in knowledge.by_path(items, "cat", "TECH/c#").collect()) == [1, 2]
    assert [r.id for r in knowledge.by_path(items, "cat", "law", "t", "INT").collect()] == [3]
    fresh = knowledge.stale(items.withColumn("h", F.lit(None).cast("string")), ["t"], 8, "h")
    again = knowledge.stale(fresh.withColumn("h", F.col("new_hash")).drop("new_hash"), ["t"], 8, "h")
    assert fresh.count() == 3 and again.count() == 0
    cats = spark.createDataFrame([("Law", [0.0])], "category string, vector array<double>")
    a, b = knowledge.import_json(knowledge.export_json(cats, items), "category string, vector array<double>", "id int, cat string, t string")
    assert a.count() == 1 and sorted(tuple(r) for r in b.collect()) == sorted(tuple(r) for r in items.collect())


_TURNS = [("a", 1, True, True), ("a", 2, True, False), ("a", 3, True, True), ("a", 4, False, True), ("a", 5, True, True), ("a", 6, True, True), ("a", 7, True, True), ("a", 8, False, True), ("b", 1, False, False)]
_WANT = [("a", 1, 1, False, "block"), ("a", 2, 1, False, "block"), ("a", 3, 2, False, "block"), ("a", 4, 0, False, "allow"), ("a", 5, 1, False, "block"), ("a", 6, 2, False, "block"), ("a", 7, 3, True, "block"), ("a", 8, 0, True, "block"), ("b", 1, 0, False, "allow")]


def test_strikes_batch(spark):
    df = spark.createDataFrame(_TURNS, "s string, turn int, violation boolean, is_input boolean")
    got = guard.strikes(df, "s", ["turn"], F.col("violation"), F.col("is_input"), 3).select("s", "turn", "strikes", "locked", "decision")
    assert sorted(tuple(r) for r in got.collect()) == _WANT


def test_strikes_stream_agrees_with_batch(spark, tmp_path):
    df = spark.createDataFrame(_TURNS, "s string, turn int, violation boolean, is_input boolean")
    df.where("turn <= 4").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("turn > 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = strikes.striking(stream, "s", "turn", 3).writeStream.format("memory").queryName("strikes_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("strikes_out").collect()) == _WANT


def test_micro_batches_dedupe_and_windows(spark, tmp_path):
    rows = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00', 1.0), ('a', timestamp'2024-01-01 00:00:30', 2.0), ('b', timestamp'2024-01-01 00:03:00', 3.0) as t(k, at, v)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = []
    q = retention.commit(retention.deduplicated(stream, "k", "at", "1 hour"), lambda b, i: out.extend(tuple(r) for r in b.select("k").collect()), str(tmp_path / "cp"), every=None)
    q.awaitTermination(60)
    assert sorted(out) == [("a",), ("b",)]
    w = retention.windowed(stream, "at", "1 minute", None, "1 minute", ["k"], "v").writeStream.format("memory").queryName("windows_out").outputMode("complete").start()
    w.processAllAvailable()
    w.stop()
    assert sorted((r.k, r.n, r.total) for r in spark.table("windows_out").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
    assert retention.first_of_each(rows, "k", "at").count() == 2 and retention.retained(rows, "at", "1 minute").count() == 1
    assert retention.sessions(rows, "at", "1 minute", "1 minute", "k").count() == 2
    assert time.time() > 0


def test_policies(spark):
    df = spark.createDataFrame([("you Idiot", "x", 0.9), ("hello", "y", 0.1)], "t string, l string, s double")
    assert [r[0] for r in df.select(guard.labelled("t", {"profanity": guard.PROFANITY})).collect()] == [["profanity"], []]
    assert [r[0] for r in df.select(guard.chain(guard.threshold("l", "s", ["x"], 0.9))).collect()] == ["block", "allow"]


def test_etl_prepare_and_workflow(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Disease,S1,S2\nFungal infection, itching,skin_rash\n,x,y\nFlu,,cold hands_x\n")
    out = etl.workflow(spark, [{"kind": "prepare", "source": str(tmp_path / "in.csv"), "replace": {"cold hands": "freezing hands"}, "target": str(tmp_path / "out")}, {"kind": "ingest", "target": str(tmp_path / "store")}], lambda d: d.withColumn("vector", F.array(F.lit(0.0))))
    got = sorted((r.text, r.description) for r in out.collect())
    assert got == [("Flu", "Symptoms: freezing hands x"), ("Fungal infection", "Symptoms: itching, skin rash")]
    assert all(r.id.rsplit("_", 1)[0] == r.text.lower().replace(" ", "_") for r in out.collect())
    with pytest.raises(ValueError):
        etl.workflow(spark, [{"kind": "train"}], lambda d: d)


def test_entry_and_queries_have_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70
    assert len(e.entry(spark).columns) == 3


def test_categories_of_several_parents(spark):
    cats = spark.createDataFrame([("1", "Tech", [], None), ("2", "C#", ["1"], None), ("3", "Law", [], [9.0])], "id string, name string, parents array<string>, vector array<double>")
    new = spark.createDataFrame([("4", "Async", ["TECH/csharp", "3", "4", "none"], None), ("3", "Law", None, [1.0])], "id string, name string, parents array<string>, vector array<double>")
    got = knowledge.upsert_categories(cats, new)
    assert {r.id: r.parents for r in got.collect()} == {"1": [], "2": ["1"], "3": [], "4": ["2", "3"]}
    paths = sorted((r.id, r.path) for r in knowledge.category_paths(got).collect())
    assert paths == [("1", "tech"), ("2", "tech/csharp"), ("3", "law"), ("4", "law/async"), ("4", "tech/csharp/async")]
    items = spark.createDataFrame([(1, "2", [1.0]), (2, "2", [3.0]), (3, None, [7.0])], "id int, category string, vector array<double>")
    assert {r.id: r.vector for r in knowledge.vectorize_categories(got, items, "category", "vector").collect()} == {"1": None, "2": [2.0], "3": [1.0], "4": None}
    assert knowledge.upsert_categories(cats.limit(0), new.limit(0)).count() == 0


def test_documents_of_a_space_come_back(spark):
    cats = spark.createDataFrame([("1", "Tech"), ("2", "Law")], "id string, name string")
    items = spark.createDataFrame([(1, "1", "a"), (2, "1", None), (3, "9", "c")], "id int, category string, text string")
    out = knowledge.export_document("kb", cats, items, "category", {"version": 2})
    c, i = knowledge.import_document(out, "id string, name string", "id int, category string, text string")
    assert sorted(map(tuple, c.collect())) == [("1", "Tech"), ("2", "Law")] and sorted(map(tuple, i.collect())) == [(1, "1", "a"), (2, "1", None), (3, "9", "c")]
    whole = spark.createDataFrame([('{"config": {}, "categories": [{"id": "7", "name": "x"}], "items": [{"id": 5}]}',), ("no json",)], "value string")
    c, i = knowledge.import_document(whole, "id string, name string", "id int, category string, text string")
    assert [r.id for r in c.collect()] == ["7"] and [r.id for r in i.collect()] == [5]


def test_searches_by_category_path_and_fallback(spark):
    items = spark.createDataFrame([(1, "Tech/C#", "cold cats", [0.0]), (2, "Law", "cold dogs", [5.0]), (3, "Law", "warm birds", [6.0])], "id int, category string, text string, vector array<double>")
    index = search.build(items, "id", "text", persist=True, group="category")
    assert [r.doc for r in search.search(index, "cold", group="Law").collect()] == [2] and search.search(index, "cold").count() == 2
    cats = spark.createDataFrame([("Tech/C#", [0.0]), ("Law", [5.0])], "category string, vector array<double>")
    got = knowledge.hybrid(items, cats, "id", "category", "vector", "text", [5.1], "cold", path="tech", index=index)
    assert {r.key: r.search_type for r in got.collect()} == {1: "path", 2: "semantic", 3: "semantic"}
    find = lambda path: [r.id for r in knowledge.search_path(items, cats, "category", "id", path, "vector", [6.0], 1).collect()]
    assert find("tech") == [1] and find("nothing") == [3]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_within_intervals_against_brute_force(spark, how):
    rng = random.Random(6)
    points = [(i, rng.choice("ab"), rng.choice([None, *range(-20, 60)])) for i in range(80)]
    spans = [(j, rng.choice("ab"), s, rng.choice([s, s + 1, s + 3, s + 17, s + 400, s - 2, None])) for j, s in enumerate(rng.choices(range(-30, 60), k=60))]
    left, right = spark.createDataFrame(points, "i int, k string, x int"), spark.createDataFrame(spans, "i int, k string, s int, e int")
    got = sorted((r.i, -1 if r.in_i is None else r.in_i) for r in joins.within(left, right, ["k"], "x", "s", "e", ["i"], how).collect())
    want = [(i, j) for i, k, x in points for j, b, s, e in spans if k == b and x is not None and e is not None and s <= x < e]
    want += [(i, -1) for i, _, _ in points if how == "left" and i not in {a for a, _ in want}]
    assert got == sorted(want)
    assert joins.within(left, right.limit(0), ["k"], "x", "s", "e", ["i"], how).count() == (80 if how == "left" else 0)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_in_spans_is_asof(spark, strict):
    rng = random.Random(3)
    left = spark.createDataFrame([(i, rng.choice(["a", "b", None]), rng.choice([None, *range(100)])) for i in range(150)], "i int, k string, t int")
    right = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 100, 3)]), j) for j in range(60)], "k string, t int, v int")
    get = lambda span: sorted((r.i, -1 if r.asof_v is None else r.asof_v) for r in joins.asof(left, right, ["k"], "t", "t", ["v"], strict, span).collect())
    assert get(None) == get(7.0) == get(1000.0) and len(get(7.0)) == 150


def test_strikes_in_spans_are_strikes(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "b", None]), None if i == 7 else i // 2, rng.random() < 0.55, rng.random() < 0.8) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, s string, t int, v boolean, inp boolean")
    get = lambda most, span: [tuple(r) for r in guard.strikes(df, "s", ["t", "i"], F.col("v"), F.col("inp"), most, span).select("i", "strikes", "locked", "decision").orderBy("i").collect()]
    for most in (3, 6):
        assert get(most, None) == get(most, 4.0) == get(most, 1000.0)

import itertools
import json
import random

import pytest

from flowstore.operators.hierarchy import descendants, resolve_hierarchy
from flowstore.operators.nested import flat_tables, flatten_nested
from flowstore.operators.references import orphan_references, orphan_report


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# references


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_references_by_null_mask_against_brute_force(spark, match):
    values = ["a", "b", "|", None]
    child = [(i, x, y) for i, (x, y) in enumerate(itertools.product(values, values))] * 2
    parent = [("a", "a", 1), ("b", "|", 2), ("a", None, 3), ("a", "a", 4)]
    got = orphan_references(spark.createDataFrame(child, "i int, x string, y string"), spark.createDataFrame(parent, "p string, q string, i int"), [("x", "p"), ("y", "q")], match)
    want = []
    for i, x, y in child:
        if x is None and y is None:
            continue
        if x is not None and y is not None:
            if not any((p, q) == (x, y) for p, q, _ in parent):
                want.append((i, x, y, "missing"))
        elif match == "full":
            want.append((i, x, y, "mixed"))
        elif match == "partial" and not any((x is None or p == x) and (y is None or q == y) for p, q, _ in parent):
            want.append((i, x, y, "missing"))
    assert rows(got) == sorted(want, key=repr)


def test_references_reasons_clashing_names_and_empty_tables(spark):
    child = spark.sql("select * from values (1, 'a', timestamp'2024-01-05'), (2, 'b', timestamp'2024-01-05'), (3, 'c', timestamp'2024-02-05'), (4, 'z', null), (5, null, null) as t(i, k, at)")
    parent = spark.sql("select * from values ('a', true, timestamp'2024-01-01', 'x'), ('b', false, timestamp'2024-01-09', 'x'), ('c', false, null, 'x'), ('c', true, null, 'x') as t(k, gone, at, i)")
    got = orphan_references(child, parent, [("k", "k")], "simple", "gone", "at", "at")
    assert [(r.i, r.reason) for r in got.orderBy("i").collect()] == [(1, "deleted"), (2, "late"), (4, "missing")]
    assert rows(orphan_report(got.selectExpr("'f' as f", "at", "reason"), "f", "at"))[0] == ("f", "2024-01", "deleted", 1)
    assert orphan_references(child, parent.limit(0), [("k", "k")]).count() == 4
    assert orphan_references(child.limit(0), parent, [("k", "k")]).count() == 0
    with pytest.raises(ValueError):
        orphan_references(child, parent, [("k", "k")], "loose")


def test_references_with_a_hot_key(spark):
    child = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) as k")
    parent = spark.createDataFrame([("hot",), ("1",)], "k string")
    bad = orphan_references(child, parent, [("k", "k")])
    assert bad.where("k = 'hot' or k = '1'").count() == 0
    assert bad.count() == child.where("k not in ('hot', '1')").count()


# hierarchies


def brute(nodes):
    parent = {i: p if p in nodes else None for i, p in nodes.items()}
    out = {}
    for i in nodes:
        way, x = [i], i
        while parent[x] is not None and parent[x] not in way:
            x = parent[x]
            way.append(x)
        if parent[x] is None:
            out[i] = (x, len(way) - 1)
        else:
            out[i] = (min(way[way.index(parent[x]) :]), -1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchies_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(60)]
    nodes = {i: rnd.choice([None, "gone", *ids, *ids[:3]]) for i in ids} | {f"c{i:03d}": f"c{i + 1:03d}" for i in range(40)}
    df = spark.createDataFrame(list(nodes.items()), "id string, parent_id string")
    got = {r.id: (r.root_id, r.depth) for r in resolve_hierarchy(df).collect()}
    assert got == brute(nodes)


def test_hierarchy_paths_repeats_and_edges(spark):
    data = [("a", None, "A", 1), ("b", "a", None, 1), ("c", "b", "C", 1), ("c", "b", "C", 2), ("s", "s", "S", 1), (None, "a", "N", 1), ("t", "s", "T", 1)]
    df = spark.createDataFrame(data, "id string, parent_id string, name string, depth int")
    tree = resolve_hierarchy(df, label_col="name")
    got = {r.id: (r.parent, r.root_id, r.depth, r.path, r.ancestors) for r in tree.collect()}
    assert got == {"a": (None, "a", 0, "A", []), "b": ("a", "a", 1, "A/", ["a"]), "c": ("b", "a", 2, "A//C", ["a", "b"]), "s": ("s", "s", -1, None, None), "t": ("s", "s", -1, None, None)}
    assert rows(descendants(tree)) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert resolve_hierarchy(df.limit(0)).count() == 0


def test_long_chain_and_hot_parent(spark):
    n = 300
    chain = spark.createDataFrame([(f"{i:04d}", f"{i - 1:04d}" if i else None) for i in range(n)] + [(f"x{i}", "0005") for i in range(400)], "id string, parent_id string")
    got = {r.id: r.depth for r in resolve_hierarchy(chain).collect()}
    assert got[f"{n - 1:04d}"] == n - 1 and all(got[f"x{i}"] == 6 for i in range(400))


# nested records


def walk(x, path, parent, inside, out):
    if isinstance(x, dict):
        if inside:
            out.append((path, parent))
            parent = path
        for k, v in x.items():
            walk(v, f"{path}.{k}" if path else k, parent, False, out)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            walk(v, f"{path}[{i}]", parent, True, out)


def some_json(rnd, depth):
    kind = rnd.choice(["o", "o", "a", "a", "s"]) if depth else "s"
    if kind == "o":
        return {rnd.choice(["a", "b.c", "d e", "é", ""]) + str(i): some_json(rnd, depth - 1) for i in range(rnd.randint(0, 3))}
    if kind == "a":
        return [some_json(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return rnd.choice([None, 1, 2.5, True, "x", '{"items": [{"a": 1}]}', "[{}]"])


def test_nested_against_brute_force(spark):
    rnd = random.Random(5)
    docs = [(i, json.dumps(some_json(rnd, 8))) for i in range(40)]
    want = []
    for i, d in docs:
        out = []
        walk(json.loads(d), "", "$", False, out)
        want += [(i, *o) for o in out]
    got = flatten_nested(spark.createDataFrame(docs, "i int, j string"), "i", "j").select("key", "node", "parent")
    assert rows(got) == sorted(want, key=repr) and len(want) > 20


def test_nested_bad_texts_types_and_clashing_names(spark):
    data = [(1, None, "v"), (2, "", "v"), (3, '{"a": [{}', "v"), (4, '{"a": [{"x": 1}, 3, null, [{"y": {"z": [{}]}}]]}', "v"), (5, '[{"a": "[{}]"}]', "v"), (5, '[{"a": "[{}]"}]', "v"), (6, '{"a": {"b": 1}}', "v")]
    df = spark.createDataFrame(data, "key int, node string, v string")
    got = flatten_nested(df, "key", "node")
    assert rows(got.select("key", "node", "parent", "table_name")) == [
        (4, "a[0]", "$", "a[]"),
        (4, "a[3][0]", "$", "a[][]"),
        (4, "a[3][0].y.z[0]", "a[3][0]", "a[][].y.z[]"),
        (5, "[0]", "$", "[]"),
        (5, "[0]", "$", "[]"),
    ]
    assert got.where("key = 4 and node = 'a[0]'").first().fields == '{"x":1}'
    assert flatten_nested(df.limit(0), "key", "node").count() == 0


def test_nested_many_elements_in_one_record(spark):
    big = json.dumps({"items": [{"p": [{"q": i}]} for i in range(5000)]})
    assert flatten_nested(spark.createDataFrame([(1, big)], "i int, j string"), "i", "j").count() == 10_000


def test_flat_tables_have_own_values_only_and_the_last_of_repeated_names(spark):
    text = '{"items": [{"a": 1, "A": 0, "a": 2, "_idx": "i", "m": {"x": "s", "subs": [{"q": 1}], "deep": {"l": [1, 2], "o": {"z": 1}}}, "m.x": "other", "tags": ["u"], "it\'s": null, "subs": [{"b": true}, 3, {}]}]}'
    nodes = flatten_nested(spark.createDataFrame([(1, text), (2, '{"items": [{"c": [[1], [2]]}]}'), (3, None)], "k int, j string"), "k", "j")
    tables = flat_tables(nodes)
    assert set(tables) == {"items[]", "items[].m.subs[]", "items[].subs[]"}
    first = {r["_key"]: r.asDict() for r in tables["items[]"].collect()}
    own = {"A": "0", "a_2": "2", "_idx_2": "i", "m.x": "other", "m.deep": '{"l":[1,2],"o":{"z":1}}', "tags": '["u"]', "it's": None, "c": None}
    assert first[1] == {"_key": 1, "_node": "items[0]", "_parent": "$", "_idx": 0, **own}
    assert first[2]["c"] == "[[1],[2]]" and first[2]["tags"] is None
    assert rows(tables["items[].subs[]"].select("_node", "_parent", "b")) == [("items[0].subs[0]", "items[0]", "true"), ("items[0].subs[2]", "items[0]", None)]
    assert flat_tables(nodes.limit(0)) == {}
    with pytest.raises(ValueError):
        flat_tables(nodes, 3)

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowstore.functions import expressions, ids, names, projections, text, vectors
from flowstore.functions.predicates import ConditionError, condition, from_phrase, shorthand, validate


def test_names_resolve_in_order():
    cols = ["users.id", "users.name", "orders.id", "Total"]
    assert names.resolve(cols, "users.id") == "users.id"
    assert names.resolve(cols, "TOTAL") == "Total"
    assert names.resolve(cols, "name") == "users.name"
    assert names.resolve(cols, "x.total") == "Total"
    assert names.find(cols, "id") is None  # two candidates
    with pytest.raises(names.UnknownField, match="did you mean 'users.name'"):
        names.resolve(cols, "users.nmae")


def test_collapse_keeps_prefixes_that_tell_apart(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.id", "b.id", "a.name"])
    assert names.collapsed(df).columns == ["a.id", "b.id", "name"]


@pytest.mark.parametrize(
    "bad",
    [{}, {"a": {}}, {"$gt": 5}, {"a": {"$nope": 1}}, {"a": {"$gt": 1, "b": 2}}, {"and": []}, {"==": [1]}, {"a": "$gt"}, 5],
)
def test_conditions_without_meaning_raise(bad):
    with pytest.raises(ConditionError):
        validate(bad)


def test_shorthand_and_phrases():
    assert shorthand("total > 5") == {"total": {"$gt": 5}}
    assert shorthand("name = 'Bob'") == {"name": {"$eq": "Bob"}}
    assert shorthand("total $lte:2.5") == {"total": {"$lte": 2.5}}
    assert from_phrase("orders greater than or equal to 1,500 please", "t") == {"t": {"$gte": 1500}}
    assert from_phrase("all orders", "t") is None


_LEAF = st.one_of(
    st.tuples(st.sampled_from(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte"]), st.integers(-3, 3)).map(lambda t: {"x": {t[0]: t[1]}}),
    st.lists(st.integers(-3, 3), min_size=1, max_size=3).map(lambda v: {"x": {"$in": v}}),
    st.sampled_from(["a", "b", "c"]).map(lambda v: {"s": v}),
    st.booleans().map(lambda v: {"s": {"$exists": v}}),
)
_TREE = st.recursive(_LEAF, lambda c: st.one_of(st.lists(c, min_size=1, max_size=3).map(lambda p: {"and": p}), st.lists(c, min_size=1, max_size=3).map(lambda p: {"or": p}), c.map(lambda p: {"not": p})), max_leaves=6)


def _where(c) -> str:
    (name, want), = c.items()
    if name in ("and", "or"):
        return "(" + f" {name} ".join(_where(p) for p in want) + ")"
    if name == "not":
        return f"(NOT {_where(want)})"
    if not isinstance(want, dict):
        return f"({name} = '{want}')"
    (op, v), = want.items()
    if op == "$in":
        return f"({name} IN ({', '.join(map(str, v))}))"
    if op == "$exists":
        return f"({name} IS {'NOT ' if v else ''}NULL)"
    return f"({name} {dict(zip(['$eq', '$ne', '$gt', '$gte', '$lt', '$lte'], ['=', '<>', '>', '>=', '<', '<=']))[op]} {v})"


@settings(max_examples=25, deadline=None)
@given(tree=_TREE)
def test_conditions_agree_with_sql(spark, tree):
    rows = [(i, x, s) for i, (x, s) in enumerate([(x, s) for x in (-2, 0, 1, 3, None) for s in ("a", "b", None)])]
    df = spark.createDataFrame(rows, "i int, x int, s string")
    got = sorted(r.i for r in df.where(condition(df, tree)).collect())
    con = duckdb.connect()
    con.execute("create table t (i int, x int, s varchar)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    assert got == sorted(r[0] for r in con.execute(f"select i from t where {_where(tree)}").fetchall())


def test_null_lowest_mode(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "i int, x int")
    pick = lambda c, nulls: sorted(r.i for r in df.where(condition(df, c, nulls)).collect())
    assert pick({"x": {"$lt": 9}}, "sql") == [1]
    assert pick({"x": {"$lt": 9}}, "lowest") == [1, 2]
    assert pick({"x": {"$ne": 5}}, "lowest") == [2]
    assert pick({"x": {"$gt": 1}}, "lowest") == [1]


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("1 + 2 * 3 == 7", True),
        ("-7 / 2 == -3", True),
        ("7 % 3 == 1 && !(2 > 3)", True),
        ("'ab' + 'c' == 'abc'", True),
        ("x > 2 ? true : false", True),
        ("tags.exists(t, t == 'b') && tags.all(t, size(t) == 1)", True),
        ("tags.filter(t, t != 'a').size() == 1", True),
        ("tags.map(t, t + '!')[0] == 'a!'", True),
        ("tags.exists_one(t, t == 'a')", True),
        ("'b' in tags && x in [1, 2, 3]", True),
        ("has(s) && s.matches('^h.*o$') && s.startsWith('he') && s.endsWith('lo') && s.contains('ell')", True),
        ("int('12') + int(2.9) == 14", True),
        ("double('1.5') < 2.0", True),
        ("at.getFullYear() == 2024 && at.getMonth() == 1 && at.getDayOfWeek() == 4", True),
        ("at + duration('1h30m') > timestamp('2024-02-29T13:00:00Z')", True),
        ("x / 0 == 1", None),
        ("r'\\d' == '\\\\d'", True),
    ],
)
def test_expressions(spark, expr, want):
    df = spark.sql("select 3L as x, 'hello' as s, array('a', 'b') as tags, timestamp'2024-02-29 12:00:00' as at")
    assert df.select(condition(df, expr)).first()[0] is want


def test_expressions_that_have_no_column_raise(spark):
    df = spark.range(1)
    for bad in ("id +", "nope(id)", "id.foo(1, 2)", "unknown == 1", "id ~ 2", "(id"):
        with pytest.raises(expressions.ExpressionError):
            condition(df, bad)


def test_names_in_expression():
    assert expressions.names_in(expressions.parse("a.b > 1 && xs.exists(x, x.y == c)")) == {"a.b", "xs", "c"}


def test_projection_grammar(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["l.id", "l.value", "r.id", "r.n"])
    sides = {"left": "l", "a": "l", "right": "r", "b": "r"}
    assert projections.project(df, "*").columns == ["l.id", "r.id", "r.n"]
    assert projections.project(df, ["b.*", "left.id as me", "nothing"], sides).columns == ["id", "n", "me"]
    assert projections.project(df, ["a.id", "b.id"], sides).columns == ["id", "id_2"]
    assert projections.project(df, {"z": "r.n", "a": "l.id"}).columns == ["a", "z"]
    assert projections.sort_keys("a desc, b") == [("a", True), ("b", False)]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("AAAAAAAA-0000-0000-0000-00000000000B", "aaaaaaaa-0000-0000-0000-00000000000b"),
        (" {aaaaaaaa-0000-0000-0000-00000000000b}\t", "aaaaaaaa-0000-0000-0000-00000000000b"),
        ("URN:UUID:aaaaaaaa-0000-0000-0000-00000000000b", "aaaaaaaa-0000-0000-0000-00000000000b"),
        ("aaaaaaaa00000000000000000000000b", "aaaaaaaa-0000-0000-0000-00000000000b"),
        ("aaaaaaaa0-000-0000-0000-00000000000b", None),
        ("https://example.invalid/x", None),
        ("", None),
        (None, None),
    ],
)
def test_uuid_spellings(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "u string")
    assert df.select(ids.canonical_uuid("u")).first()[0] == want
    nil = spark.createDataFrame([(ids.NIL_UUID,)], "u string")
    assert nil.select(ids.reference_uuid("u")).first()[0] is None


def test_text_functions(spark):
    df = spark.createDataFrame([("The C# & .NET/ＡＢ１-tools!", "x")], "t string, e string")
    row = df.select(text.category_name("t"), text.tokens("t"), text.obfuscated("e", "p"), text.replaced("e", {"x": "y"})).first()
    assert row[0] == "the csharp and dotnet ab1 tools"
    assert row[1][:2] == ["c", "net"]
    assert row[2].startswith("p_") and len(row[2]) == 18
    assert row[3] == "y"
    assert text.fnv1a(b"a") == 0xE40C292C


def test_hash_embedding_has_length_one(spark):
    df = spark.createDataFrame([(1, "big Cat, cat"), (2, ""), (3, None)], "i int, t string")
    got = {r.i: r.v for r in text.embed_by_hashing(df, "t", "v", 16, ["big"]).collect()}
    assert max(got[1]) == 1.0 and sum(x != 0 for x in got[1]) == 1
    assert set(got[2]) == {0.0} and got[3] is None


def test_vector_functions(spark):
    df = spark.sql("select array(1.0, 0.0, 0.0) as a, array(1.0) as b, array(0.0, 0.0, 0.0) as z, array(3.0, 4.0) as c, array(0.0, 1.0) as d")
    row = df.select(vectors.cosine("a", "b"), vectors.cosine("a", "z"), vectors.normalized("c"), vectors.euclidean("a", "d"), vectors.perceptron([1.0, -1.0], 1.0, "c")).first()
    assert row[0] == 1.0 and row[1] == 0.0 and row[2] == [0.6, 0.8]
    assert row[3] == pytest.approx(2**0.5) and row[4] == 1.0
    assert df.select(F.size(vectors.normalized("z"))).first()[0] == 3

"""Deeply nested JSON to flat tables that keep parent-child links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstore.plans.tables import cut

#: Levels of nesting that one projection unrolls before the frontier is written and read again.
LEVELS = 3
#: Columns of all flat tables together, at most.
TABLES = 5_000

_NODE = "struct<path:string,table:string,parent:string,idx:int,v:variant>"


def _children(nodes: str) -> str:
    """SQL: the children of an array of nodes. An element of an array that is an object becomes the parent of all below it."""
    own = "if(n.idx is not null, n.path, n.parent)"  # only an object has keys
    by_key = (
        "transform(coalesce(map_entries(try_variant_get(n.v, '$', 'map<string,variant>')), cast(array() as array<struct<key:string,value:variant>>)), "
        f"e -> named_struct('path', concat(n.path, if(n.path = '', '', '.'), e.key), 'table', concat(n.table, if(n.table = '', '', '.'), e.key), 'parent', {own}, 'idx', cast(null as int), 'v', e.value))"
    )
    by_place = (
        "transform(coalesce(try_variant_get(n.v, '$', 'array<variant>'), cast(array() as array<variant>)), "
        "(x, i) -> named_struct('path', concat(n.path, '[', i, ']'), 'table', concat(n.table, '[]'), 'parent', n.parent, 'idx', i, 'v', x))"
    )
    return f"flatten(transform({nodes}, n -> concat({by_key}, {by_place})))"


def _own(v: str) -> str:
    """SQL: (k, x) of an object's own values: scalars and arrays without objects, those of objects in it under dotted names, and objects below these whole."""
    entries = lambda o: f"coalesce(map_entries(try_variant_get({o}, '$', 'map<string,variant>')), cast(array() as array<struct<key:string,value:variant>>))"
    is_object = lambda o: f"try_variant_get({o}, '$', 'map<string,variant>') is not null"
    elements = lambda o: f"coalesce(try_variant_get({o}, '$', 'array<variant>'), cast(array() as array<variant>))"
    rows = f"exists({elements('e.value')}, y -> {is_object('y')} or exists({elements('y')}, z -> {is_object('z')}))"
    plain = lambda o, name: f"transform(filter({entries(o)}, e -> not {is_object('e.value')} and not {rows}), e -> named_struct('k', concat({name}, e.key), 'x', e.value))"
    inner = lambda o: f"filter({entries(o)}, e -> {is_object('e.value')})"
    deeper = f"transform({inner('o.value')}, q -> named_struct('k', concat(o.key, '.', q.key), 'x', q.value))"
    within = f"flatten(transform({inner(v)}, o -> concat({plain('o.value', "o.key, '.'")}, {deeper})))"
    return f"concat({plain(v, "''")}, {within})"


def flatten_nested(rows: DataFrame, key_col: str, json_col: str, levels: int = LEVELS) -> DataFrame:
    """(key, node, parent, table_name, idx, fields) of each object that is an element of an array, at any depth.

    node: the path from the top, such as `items[3].positions[0]`, names as written;
    parent: the path of the nearest enclosing object that is an array element, or `$`;
    table_name: the path without indexes, one flat table for each (`flat_tables`); idx:
    the place in the array; fields: the object's own values as JSON, without its arrays of
    objects, which have rows of their own. Values of objects in it have dotted names, two
    objects deep; what is below comes whole. Of equal names the first holds.

    Text that is null, empty or not valid JSON gives no rows, and so does JSON held inside
    a string, and JSON nested more than 1,000 deep, which the parser refuses. Of a name
    that an object has twice the last value holds. Null elements and scalars
    in arrays are no objects; an object may be empty. Rows that repeat give repeated
    nodes. An empty table gives no rows; other columns are ignored.

    Each level of nesting is one nested `transform` over the nodes of the level above:
    it attaches the parent's path and the index to every child, `flatten` combines the
    arrays, `inline` emits the rows. `levels` levels are unrolled in one projection; the
    frontier that is left is written and read again, spread over all tasks, until it is
    empty. Fields of changing type need no schema, as values stay variants.
    """
    spark = rows.sparkSession
    repeats = spark.conf.get(_REPEATS, "false")
    spark.conf.set(_REPEATS, "true")  # read when the expression is made
    try:
        read = rows.select(F.col(f"`{key_col}`").alias("key"), F.expr(f"try_parse_json(`{json_col}`)").alias("v")).where("v is not null")
    finally:
        spark.conf.set(_REPEATS, repeats)
    frontier = read.select("key", F.expr(f"cast(array(named_struct('path', '', 'table', '', 'parent', '$', 'idx', cast(null as int), 'v', v)) as array<{_NODE}>)").alias("nodes"))
    out = None
    while True:
        step, names = frontier, []
        for i in range(levels):
            step = step.withColumn(f"l{i}", F.expr(_children("nodes" if not i else f"l{i - 1}")))
            names.append(f"l{i}")
        every = f"flatten(array({', '.join(names)}))"
        last = names[-1]
        rest = f"filter({last}, n -> try_variant_get(n.v, '$', 'map<string,variant>') is not null or try_variant_get(n.v, '$', 'array<variant>') is not null)"
        found = f"filter({every}, n -> n.idx is not null and try_variant_get(n.v, '$', 'map<string,variant>') is not null)"
        done = step.select("key", F.expr(found).alias("found"), F.expr(rest).alias("rest"))
        done = done.select("key", F.expr("inline(concat(transform(found, n -> named_struct('more', false, 'n', n)), transform(rest, n -> named_struct('more', true, 'n', n))))")).select("key", "more", "n.*")
        done = cut(done)
        part = done.where("not more").select("key", F.col("path").alias("node"), "parent", F.col("table").alias("table_name"), "idx", F.expr(_fields("v")).alias("fields"))
        out = part if out is None else out.unionByName(part)
        again = done.where("more")
        if again.isEmpty():
            return out
        # elements of one record go to different tasks
        frontier = again.repartition(F.xxhash64("key", "path")).select("key", F.expr("array(named_struct('path', path, 'table', table, 'parent', parent, 'idx', idx, 'v', v))").alias("nodes"))


#: Whether the parser takes an object that has one name twice.
_REPEATS = "spark.sql.variant.allowDuplicateKeys"


def _fields(v: str) -> str:
    """SQL: an object's own values as JSON text."""
    return f"transform(array({_own(v)}), own -> to_json(map_from_entries(filter(own, (e, i) -> array_position(transform(own, x -> x.k), e.k) = i + 1))))[0]"


def flat_tables(nodes: DataFrame, most: int = TABLES) -> dict[str, DataFrame]:
    """Table name -> (_key, _node, _parent, _idx and a column of text for each own value) of the result of `flatten_nested`.

    `_parent` is the `_node` of the row above under the same `_key`, `$` at the top. A
    column that some rows lack is null there; lists and objects are JSON. A name that
    differs from one before in case only, or is one of the four, gets a number. What
    comes to the driver is the names; more than `most` of tables and columns together are
    refused, as they are data and no schema.
    """
    named = nodes.select("table_name", F.explode_outer(F.json_object_keys("fields")).alias("field")).distinct().limit(most + 1).collect()
    if len(named) > most:
        raise ValueError(f"more than {most} columns")
    out = {}
    for table in sorted({r.table_name for r in named}):
        taken, columns = {"_key", "_node", "_parent", "_idx"}, []
        for name in sorted(r.field for r in named if r.table_name == table and r.field is not None):
            label, k = name, 2
            while label.lower() in taken:
                label, k = f"{name}_{k}", k + 1
            taken.add(label.lower())
            columns.append(F.element_at("__m", F.lit(name)).alias(label))
        rows = nodes.where(F.col("table_name") == table).withColumn("__m", F.from_json("fields", "map<string,string>"))
        out[table] = rows.select(F.col("key").alias("_key"), F.col("node").alias("_node"), F.col("parent").alias("_parent"), F.col("idx").alias("_idx"), *columns)
    return out

"""JSON pipelines: steps in, one DataFrame out.

A script is a list of steps `{"op", "args", "input_var", "result_var"}`. It is brought
into one form, checked, and compiled step by step into an environment of variables; plans
stay lazy, so that the optimiser sees the whole pipeline. Only control flow runs on the
driver.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstore.functions.names import collapsed, find, prefixed, quoted
from flowstore.functions.predicates import condition, shorthand, validate
from flowstore.functions.projections import project
from flowstore.functions.text import embed_by_hashing
from flowstore.operators import aggregates, joins, knowledge, mutations, scans, search, vector_store
from flowstore.sources.catalog import Catalog


class ScriptError(ValueError):
    """A script that cannot be compiled."""


@dataclass(frozen=True)
class Step:
    op: str
    args: Mapping[str, object] = field(default_factory=dict)
    name: str | None = None
    input_var: str | None = None
    result_var: str | None = None


#: Other names of opcodes.
SYNONYMS = {"where": "filter", "order_by": "sort", "take": "limit", "top": "limit", "rightjoin": "join_right", "script": "call_script", "group": "group_by", "aggregate": "group_by", "begin": "begin_tx", "commit": "commit_tx", "rollback": "rollback_tx", "open": "open_store"}
_OUTER = ("op", "operation", "name", "args", "input_var", "input", "result_var", "as", "result")
#: Steps that take the result of the step before, unless they name an input.
TAKES_INPUT = {"filter", "sort", "limit", "project", "join", "join_right", "group_by", "distinct", "update", "delete", "map_merge", "offset"}


def parse(script: object) -> list[Step]:
    """Steps of JSON text, a list, one step, or a map with steps, script or pipeline; what stands beside op and the variables becomes an argument."""
    if isinstance(script, str):
        script = json.loads(script)
    if isinstance(script, Mapping):
        for wrap in ("steps", "script", "pipeline", "operations"):
            if isinstance(script.get(wrap), (list, str)):
                return parse(script[wrap])
        script = [script]
    out = []
    for raw in script:
        if isinstance(raw, Step):
            out.append(raw)
            continue
        if not isinstance(raw, Mapping) or not (raw.get("op") or raw.get("operation")):
            raise ScriptError(f"a step needs an op: {raw!r}")
        op = str(raw.get("op") or raw.get("operation")).lower()
        args = dict(raw.get("args") or {}) | {k: v for k, v in raw.items() if k not in _OUTER}
        if raw.get("name") and raw.get("op"):
            args.setdefault("name", raw["name"])
        out.append(Step(SYNONYMS.get(op, op), args, raw.get("name"), raw.get("input_var") or raw.get("input"), raw.get("result_var") or raw.get("as") or raw.get("result")))
    return out


def normalize(steps: list[Step]) -> list[Step]:
    """Inputs made explicit, conditions under one name, expressions of the form `a > 5` as field maps, a commit before a return, loops and branches inside."""
    out: list[Step] = []
    last = None
    for i, s in enumerate(steps):
        args = dict(s.args)
        if s.op in ("filter", "scan", "select"):
            for other in ("filter", "where", "match"):
                if other in args and "condition" not in args:
                    args["condition"] = args.pop(other)
        if s.op == "filter" and isinstance(args.get("condition"), str) and re.fullmatch(r"\s*[\w.]+\s*\$\w+:.*", args["condition"]):
            args["condition"] = shorthand(args["condition"])
        if s.op in ("join", "join_right") and not args.get("store"):
            args["store"] = next((args.pop(k) for k in ("with", "right_store", "right") if args.get(k)), None)
        if s.op == "join_right":
            args.setdefault("type", "right")
        if s.op == "limit" and "limit" not in args:
            args["limit"] = args.get("count", 1000)
        for body in ("then", "else", "body"):
            if isinstance(args.get(body), list):
                args[body] = normalize(parse(args[body]))
        given = s.input_var.lstrip("@") if s.input_var else None
        taken = given or (last if s.op in TAKES_INPUT else None)
        result = s.result_var or f"_{i}"
        out.append(replace(s, args=args, input_var=taken, result_var=result))
        if s.op not in ("open_db", "begin_tx", "commit_tx", "rollback_tx", "defer", "open_store"):
            last = result
        elif s.op == "open_store" and last is None:
            last = result
    if len(out) > 1 and out[-1].op == "commit_tx" and out[-2].op == "return":
        out[-2:] = [out[-1], out[-2]]
    return out


def check(steps: list[Step], known: set[str] = frozenset()) -> set[str]:
    """The variables that are set at the end. Raises for unknown ops, variables used before they are set,
    steps after a return, and conditions without a meaning.
    """
    seen = set(known)
    for i, s in enumerate(steps):
        if s.op not in OPS:
            raise ScriptError(f"step {i}: unknown op {s.op!r}")
        if i and steps[i - 1].op == "return":
            raise ScriptError(f"step {i}: {s.op} comes after return")
        if s.input_var and s.input_var not in seen:
            raise ScriptError(f"step {i}: {s.op} reads {s.input_var!r} before it is set")
        if s.op in TAKES_INPUT and not s.input_var and s.op not in ("update", "delete"):
            raise ScriptError(f"step {i}: {s.op} has no input")
        if s.op in ("filter", "scan", "select") and s.args.get("condition") is not None:
            validate(s.args["condition"])
        inside: set[str] = set()
        for body in ("then", "else", "body"):
            if isinstance(s.args.get(body), list):
                inside |= check(s.args[body], seen | {str(s.args.get("item_var", "item"))})
        seen |= inside | {s.result_var}
    return seen


@dataclass
class Env:
    """Variables of a run: DataFrames and plain values; which store a DataFrame came from."""

    catalog: Catalog
    vars: dict[str, object] = field(default_factory=dict)
    origin: dict[str, str] = field(default_factory=dict)
    cleanup: list[Step] = field(default_factory=list)
    returned: object = None
    done: bool = False
    last: str | None = None
    database: Catalog | None = None
    transaction: Snapshot | None = None

    @property
    def db(self) -> Catalog:
        return self.database or self.catalog

    def frame(self, name: str | None) -> DataFrame:
        v = self.vars.get((name or "").lstrip("@"))
        if isinstance(v, Opened):
            return v.df
        if isinstance(v, DataFrame):
            return v
        raise ScriptError(f"{name!r} is no table")

    def store(self, name: object) -> Opened:
        """A store by variable or name."""
        key = str(name).lstrip("@")
        v = self.vars.get(key)
        if isinstance(v, Opened):
            return v
        if isinstance(v, DataFrame):
            return Opened(key, v)
        if key in self.db.scripts:
            return Opened(key, run(self.db.scripts[key], self.db))
        return Opened(key, self.db.read(key))


@dataclass(frozen=True)
class Opened:
    """A store that is open: its name and its unprefixed rows."""

    name: str
    df: DataFrame


def fill(value: object, env: Env) -> object:
    """`{{var.field}}` and `@var` in arguments, replaced by plain values."""
    if isinstance(value, str):
        whole = re.fullmatch(r"\{\{\s*\.?([\w.]+)\s*\}\}", value)
        if whole:
            return _dig(env, whole[1])
        return re.sub(r"\{\{\s*\.?([\w.]+)\s*\}\}", lambda m: str(_dig(env, m[1])), value)
    if isinstance(value, Mapping):
        return {k: fill(v, env) for k, v in value.items()}
    if isinstance(value, list) and not any(isinstance(v, Step) for v in value):
        return [fill(v, env) for v in value]
    return value


def _dig(env: Env, path: str) -> object:
    head, *rest = path.split(".")
    v = env.vars.get(head)
    for r in rest:
        v = v.get(r) if isinstance(v, Mapping) else getattr(v, r, None)
    return v


def _keys(env: Env, opened: Opened) -> tuple[list[str], list[bool]]:
    m = env.db.metas.get(opened.name)
    if m is None and opened.name in env.db.stores():
        m = env.db.meta(opened.name)
    keys = [k for k in m.key if k.name in opened.df.columns] if m else []
    return ([k.name for k in keys], [k.descending for k in keys]) if keys else ([opened.df.columns[0]], [False])


def _open_db(env: Env, s: Step, a: dict) -> object:
    env.database = env.catalog.database(next((a[k] for k in ("name", "database", "db") if a.get(k)), None))
    return None


def _open_store(env: Env, s: Step, a: dict) -> Opened:
    name = next((a[k] for k in ("name", "store", "store_name") if a.get(k)), None)
    db = env.db.database(a["database"]) if a.get("database") else env.db
    if a.get("create") and name not in db.stores():
        return Opened(name, db.create(name))
    return Opened(name, db.read(name))


def _scan(env: Env, s: Step, a: dict) -> DataFrame:
    opened = env.store(a.get("store") or s.input_var)
    keys, _ = _keys(env, opened)
    limit = a.get("limit", scans.LIMITS["scan"])
    out = scans.scan(opened.df, keys, a.get("condition"), a.get("direction") or "asc", a.get("start_key"), a.get("prefix"), None if a.get("stream") and "limit" not in a else limit)
    return prefixed(out, opened.name)


def _join(env: Env, s: Step, a: dict) -> DataFrame:
    left = env.frame(s.input_var)
    right = env.store(a.get("store") or a.get("target"))
    name = a.get("alias") or a.get("right_alias") or right.name
    if a.get("left_alias"):
        left = left.toDF(*[f"{a['left_alias']}.{c.rsplit('.', 1)[-1]}" for c in left.columns])
    left_name = a.get("left_alias") or (env.vars[s.input_var].name if isinstance(env.vars.get(s.input_var), Opened) else None)
    on = a.get("on")
    if a.get("relation"):
        link = env.store(a["relation"])
        target = env.store(a.get("target") or a["store"])
        key = find(left.columns, "key") or next(c for c in left.columns if c.endswith(".key"))
        out = joins.bridge(left, link.df, target.df, key, "key", (left_name, link.name, target.name), how=a.get("type") or "inner")
    else:
        if on is None:
            metas = env.db.metas
            of = {c.split(".")[0] for c in left.columns if "." in c} | ({left_name} if left_name else set())
            on = next((dict(joins.relation_of(metas[l], env.db.meta(right.name))) for l in of if l in metas and _related(metas[l], env.db.meta(right.name))), None)  # noqa: E741
            if on is None:
                raise ScriptError(f"join with {right.name!r} has no fields to join on")
        out = joins.join(left, right.df, on, a.get("type") or "inner", left_name, name, bool(a.get("null_safe")))
    if a.get("into"):
        out = env.db.materialize(a["into"], out.withColumn("key", F.concat(F.lit("row_"), F.monotonically_increasing_id().cast("string"))))
    return out


def _related(a, b) -> bool:
    return any(r.target_store == b.name for r in a.relations) or any(r.target_store == a.name for r in b.relations)


def _assign(env: Env, s: Step, a: dict) -> object:
    return a["value"] if "value" in a else env.vars.get(s.input_var or "")


def _if(env: Env, s: Step, a: dict) -> object:
    test = a.get("condition")
    if isinstance(test, str):
        named = env.vars.get(test.lstrip("@"))
        test = named if isinstance(named, bool) else _plain_test(test, env)
    if isinstance(test, DataFrame):
        row = test.first()
        test = bool(row and row[0])
    if not isinstance(test, bool):
        raise ScriptError(f"if takes a truth value, not {test!r}")
    _block(env, a.get("then") if test else a.get("else"))
    return env.vars.get(env.last or "")


def _plain_test(text: str, env: Env) -> bool:
    """An expression over plain variables, evaluated as a row of one."""
    from flowstore.functions import expressions

    def get(name: str):
        v = _dig(env, name)
        if v is None or isinstance(v, (DataFrame, Opened)):
            return None
        kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "double" if isinstance(v, float) else "string" if isinstance(v, str) else "list"
        return expressions.Typed(F.lit(v), kind, v)

    return bool(env.catalog.spark.range(1).select(expressions.to_column(text, get)).first()[0])


def _loop(env: Env, s: Step, a: dict) -> object:
    over = a.get("list", a.get("over", a.get("items", s.input_var)))
    over = env.vars.get(over.lstrip("@"), over) if isinstance(over, str) else over
    if not isinstance(over, (list, tuple)):
        raise ScriptError("loop goes over a list; join or explode to go over rows")
    for item in over:
        env.vars[str(a.get("item_var", "item"))] = item
        _block(env, a.get("body"))
        if env.done:
            break
    return env.vars.get(env.last or "")


def _block(env: Env, steps: object) -> None:
    for s in steps or []:
        if env.done:
            return
        _one(env, s)


def _return(env: Env, s: Step, a: dict) -> object:
    v = a.get("value", s.input_var or env.last)
    if isinstance(v, str) and v.lstrip("@") in env.vars:
        v = env.vars[v.lstrip("@")]
    elif isinstance(v, list):
        v = [env.vars.get(x.lstrip("@"), x) if isinstance(x, str) else x for x in v]
    env.returned, env.done = v, True
    return v


def _call(env: Env, s: Step, a: dict) -> object:
    name = a.get("name") or a.get("script") or s.name
    if name not in env.catalog.scripts:
        raise ScriptError(f"unknown script {name!r}")
    return run(env.catalog.scripts[name], env.catalog, {k: v for k, v in (a.get("params") or a.get("args") or {}).items()})


def _function(env: Env, s: Step, a: dict) -> object:
    held = dict(env.vars)
    env.vars |= a.get("params") or {}
    got = _call(env, s, a | {"params": (a.get("params") or {})})
    env.vars = held
    return got


def _target(env: Env, s: Step, a: dict) -> Opened:
    return env.store(a.get("store") or s.input_var)


def _save(env: Env, name: str, df: DataFrame) -> DataFrame:
    env.db.register(name, df, env.db.metas.get(name))
    for var, v in env.vars.items():
        if isinstance(v, Opened) and v.name == name:
            env.vars[var] = Opened(name, df)
    return df


def _add(env: Env, s: Step, a: dict) -> DataFrame:
    t = _target(env, s, a)
    keys, _ = _keys(env, t)
    rows = a.get("rows") or [{**(a["key"] if isinstance(a.get("key"), Mapping) else {keys[0]: a.get("key")}), **(a["value"] if isinstance(a.get("value"), Mapping) else {"value": a.get("value")})}]
    new = env.catalog.spark.createDataFrame([tuple(r.get(c) for c in t.df.columns) for r in rows], t.df.schema)
    return _save(env, t.name, mutations.add(t.df, new, keys))


def _update(env: Env, s: Step, a: dict) -> DataFrame:
    t = _target(env, s, a)
    keys, _ = _keys(env, t)
    where = a.get("condition") or (({keys[0]: a["key"]}) if "key" in a else None)
    if where is None and s.input_var and not isinstance(env.vars.get(s.input_var), Opened):
        hit = _key_rows(env.frame(s.input_var), t.name, keys)
        flagged = t.df.join(hit.withColumn("__hit", F.lit(True)), keys, "left")
        values = a.get("values") or {}
        types = dict(t.df.dtypes)
        return _save(env, t.name, flagged.select(*[F.when(F.col("__hit"), F.lit(values[c]).cast(types[c])).otherwise(quoted(c)).alias(c) if c in values else quoted(c) for c in t.df.columns]))
    return _save(env, t.name, mutations.update(t.df, where, a.get("values") or {}))


def _delete(env: Env, s: Step, a: dict) -> DataFrame:
    t = _target(env, s, a)
    keys, _ = _keys(env, t)
    where = a.get("condition") or (({keys[0]: a["key"]}) if "key" in a else None)
    if where is None and s.input_var and not isinstance(env.vars.get(s.input_var), Opened):
        return _save(env, t.name, mutations.delete_keys(t.df, _key_rows(env.frame(s.input_var), t.name, keys), keys))
    return _save(env, t.name, mutations.delete(t.df, where))


def _key_rows(df: DataFrame, store: str, keys: list[str]) -> DataFrame:
    return df.select(*[quoted(find(df.columns, f"{store}.{k}") or find(df.columns, k)).alias(k) for k in keys]).distinct()


def _navigate(back: bool | None, last: bool = False) -> Callable:
    def go(env: Env, s: Step, a: dict) -> DataFrame:
        t = _target(env, s, a)
        keys, _ = _keys(env, t)
        return scans.edge(t.df, keys, last) if back is None else scans.step(t.df, keys, a["key"], back)

    return go


def _find(env: Env, s: Step, a: dict) -> DataFrame:
    t = _target(env, s, a)
    return scans.find(t.df, _keys(env, t)[0], a["key"])


def _current(values: bool) -> Callable:
    def get(env: Env, s: Step, a: dict) -> DataFrame:
        df = env.frame(s.input_var or env.last)
        t = env.store(a["store"]) if a.get("store") else Opened("", df)
        keys = _keys(env, t)[0]
        return df.select(*[quoted(c) for c in df.columns if (c.rsplit(".", 1)[-1] in keys) != values])

    return get


def _list_append(env: Env, s: Step, a: dict) -> list:
    base = env.vars.get(str(a.get("list", s.input_var)).lstrip("@")) or []
    item = a.get("item", a.get("value"))
    return [*base, env.vars.get(item.lstrip("@"), item) if isinstance(item, str) else item]


def _map_merge(env: Env, s: Step, a: dict) -> dict:
    out: dict = {}
    for part in a.get("maps") or [a.get("left"), a.get("right")]:
        out |= (env.vars.get(part.lstrip("@")) if isinstance(part, str) else part) or {}
    return out


def _group(env: Env, s: Step, a: dict) -> DataFrame:
    by = a.get("by") or a.get("group_by") or a.get("fields") or []
    return aggregates.group(env.frame(s.input_var), [by] if isinstance(by, str) else by, a.get("aggregates") or a.get("aggs") or {"count": "count(*)"}, a.get("having"), a.get("kind", "plain"), a.get("sets"))


def _space(env: Env, s: Step, a: dict) -> Opened:
    return env.store(a.get("space") or a.get("store") or s.input_var)


def _search_space(env: Env, s: Step, a: dict) -> DataFrame:
    """Hits of a space by path, by vector or by words, among the items that meet a condition if one is given."""
    space = _space(env, s, a)
    if a.get("condition"):
        space = Opened(space.name, space.df.where(condition(space.df, a["condition"])))
    key, text = a.get("key", "id"), a.get("text_field", "text")
    if a.get("path"):
        return knowledge.by_path(space.df, a.get("category_field", "category"), a["path"], text, a.get("prefix")).orderBy(key).limit(a.get("limit", 10))
    if a.get("vector"):
        return knowledge.in_category(space.df, a["category_field"], a["category"], a.get("vector_field", "vector"), a["vector"], a.get("limit", 10), key) if a.get("category") else vector_store.exact(space.df, a.get("vector_field", "vector"), a["vector"], a.get("limit", 10), tie=key)
    index = search.build(space.df, key, text, group=a.get("category_field", "category") if a.get("category") else None)
    return search.search(index, a["query"], a.get("limit", 10), a.get("category"))


def _space_lists(items: bool) -> Callable:
    def go(env: Env, s: Step, a: dict) -> DataFrame:
        df, at, n = _space(env, s, a).df, a.get("page_offset", 0), a.get("page_size", 100)
        field = a.get("category_field", "category")
        return knowledge.list_items(df, field, a["category"], a.get("key", "id"), at, n) if items else knowledge.list_categories(df, field, at, n)

    return go


def _space_delete(field: str) -> Callable:
    def go(env: Env, s: Step, a: dict) -> DataFrame:
        space = _space(env, s, a)
        name = a.get(f"{field}_field", "id" if field == "item" else "category")
        return _save(env, space.name, mutations.delete(space.df, {name: {"$in": a["values"]}}))

    return go


def _space_upsert(env: Env, s: Step, a: dict) -> DataFrame:
    space = _space(env, s, a)
    new = env.catalog.spark.createDataFrame([tuple(r.get(c) for c in space.df.columns) for r in a["rows"]], space.df.schema)
    return _save(env, space.name, mutations.upsert(space.df, new, [a.get("key", "id")]))


def _vectorize(env: Env, s: Step, a: dict) -> DataFrame:
    """Vectors of a space by hashed words, where the texts have changed."""
    space, dim, vector = _space(env, s, a), int(a.get("dim", 64)), a.get("vector_field", "vector")
    texts = a.get("texts") or ["text"]

    def embed(df: DataFrame) -> DataFrame:
        joined = embed_by_hashing(df.withColumn("__t", F.concat_ws(" ", *texts)), "__t", vector, dim)
        return joined.drop("__t").withColumn(vector, F.col(vector).cast(dict(space.df.dtypes)[vector]))

    return _save(env, space.name, knowledge.vectorize(space.df, texts, dim, a.get("hash_field", "vector_hash"), vector, embed))


def _vectorize_categories(env: Env, s: Step, a: dict) -> DataFrame:
    """Vectors of a space's categories (a store of their own) from those of its items."""
    space, cats = _space(env, s, a), env.store(a["categories"])
    return _save(env, cats.name, knowledge.vectorize_categories(cats.df, space.df, a.get("category_field", "category"), a.get("vector_field", "vector")))


def _upsert_categories(env: Env, s: Step, a: dict) -> DataFrame:
    cats = env.store(a.get("categories") or a.get("space") or s.input_var)
    new = env.catalog.spark.createDataFrame([tuple(r.get(c) for c in cats.df.columns) for r in a["rows"]], cats.df.schema)
    return _save(env, cats.name, knowledge.upsert_categories(cats.df, new))


def _explain_join(env: Env, s: Step, a: dict) -> DataFrame:
    """(line): what a join of two stores can use."""
    left, right = (env.db.meta(str(a[k])) for k in ("left_store", "right_store"))
    on = dict(a["on"]) if a.get("on") else dict(joins.relation_of(left, right))
    return env.catalog.spark.createDataFrame([(x,) for x in joins.explain_join(left, right, list(on), list(on.values()))], "line string")


def _fetch(env: Env, s: Step, a: dict) -> DataFrame:
    t = _target(env, s, a)
    return scans.fetch(t.df, _keys(env, t)[0], a.get("key"), a.get("prefix"), a.get("condition"), a.get("limit", scans.LIMITS["fetch"]))


def _command(env: Env, s: Step, a: dict) -> DataFrame:
    from flowstore.api import Session

    return Session(env.db).command(str(a["command"]))


def _block_op(env: Env, s: Step, a: dict) -> object:
    _block(env, a.get("body"))
    return env.vars.get(env.last or "")


def _sets(how: str) -> Callable:
    def go(env: Env, s: Step, a: dict) -> DataFrame:
        left = env.frame(s.input_var or env.last)
        others = a.get("with") if isinstance(a.get("with"), list) else [a.get("with")]
        rights = [env.frame(o) for o in others]
        if how == "union":
            return aggregates.union([left, *rights], a.get("dedupe") or (), a.get("best"))
        return (aggregates.intersect if how == "intersect" else aggregates.subtract)(left, rights[0])

    return go


OPS: dict[str, Callable[[Env, Step, dict], object]] = {
    "open_db": _open_db,
    "open_store": _open_store,
    "scan": _scan,
    "select": _scan,
    "filter": lambda e, s, a: (df := e.frame(s.input_var)).where(condition(df, a.get("condition"), a.get("nulls", "sql"))),
    "sort": lambda e, s, a: scans.sort(e.frame(s.input_var), a.get("fields") or a.get("by")),
    "limit": lambda e, s, a: e.frame(s.input_var).limit(int(a["limit"])),
    "offset": lambda e, s, a: e.frame(s.input_var).offset(int(a["offset"])),
    "project": lambda e, s, a: project(e.frame(s.input_var), a.get("fields"), a.get("sides")),
    "join": _join,
    "join_right": _join,
    "group_by": _group,
    "distinct": lambda e, s, a: aggregates.distinct(e.frame(s.input_var), a.get("fields")),
    "union": _sets("union"),
    "intersect": _sets("intersect"),
    "except": _sets("except"),
    "assign": _assign,
    "if": _if,
    "loop": _loop,
    "return": _return,
    "defer": lambda e, s, a: e.cleanup.append(parse([a.get("step") or a])[0]),
    "call_script": _call,
    "call_function": _function,
    "add": _add,
    "update": _update,
    "delete": _delete,
    "inspect": lambda e, s, a: e.db.inspect(str(a.get("store") or a.get("name") or e.vars[s.input_var].name)),
    "list_stores": lambda e, s, a: e.db.list_stores(),
    "begin_tx": lambda e, s, a: _begin(e),
    "commit_tx": lambda e, s, a: _commit(e),
    "rollback_tx": lambda e, s, a: _rollback(e),
    "first": _navigate(None),
    "last": _navigate(None, True),
    "next": _navigate(False),
    "previous": _navigate(True),
    "find": _find,
    "get_current_key": _current(False),
    "get_current_value": _current(True),
    "list_new": lambda e, s, a: list(a.get("items") or []),
    "list_append": _list_append,
    "map_merge": _map_merge,
    "set": _assign,
    "say": lambda e, s, a: str(a.get("text", a.get("message", ""))),
    "block": _block_op,
    "fetch": _fetch,
    "command": _command,
    "search_space": _search_space,
    "list_space_categories": _space_lists(False),
    "list_space_items": _space_lists(True),
    "upsert_space_items": _space_upsert,
    "delete_space_items": _space_delete("item"),
    "delete_space_categories": _space_delete("category"),
    "vectorize_space": _vectorize,
    "vectorize_space_categories": _vectorize_categories,
    "upsert_space_categories": _upsert_categories,
    "explain_join": _explain_join,
    "vectorize_space_items": _vectorize,
}


@dataclass(frozen=True)
class Snapshot:
    """What a transaction began with: its database, the tables and what is known of them, the open stores, the committed versions."""

    db: Catalog
    tables: dict[str, DataFrame]
    metas: dict
    handles: dict[str, Opened]
    versions: dict[str, str]


def _begin(env: Env) -> None:
    if env.transaction is not None:
        raise ScriptError("a transaction is open")
    handles = {k: v for k, v in env.vars.items() if isinstance(v, Opened)}
    env.transaction = Snapshot(env.db, dict(env.db.tables), dict(env.db.metas), handles, env.db.versions())


def _commit(env: Env) -> None:
    """Stores changed since begin_tx are written and become current together, then the open ones read what
    was written. Without a transaction nothing happens.
    """
    held, env.transaction = env.transaction, None
    if held is None:
        return
    changed = [n for n, df in held.db.tables.items() if held.tables.get(n) is not df]
    try:
        held.db.commit(changed, held.versions)
    except Exception:
        _restore(env, held)
        raise
    _reopen(env, held.db, changed)


def _rollback(env: Env) -> None:
    """Stores, also open ones, as they were at begin_tx. Without a transaction nothing happens."""
    held, env.transaction = env.transaction, None
    if held is not None:
        _restore(env, held)


def _restore(env: Env, held: Snapshot) -> None:
    changed = [n for n, df in held.db.tables.items() if held.tables.get(n) is not df]
    for own, old in ((held.db.tables, held.tables), (held.db.metas, held.metas)):
        own.clear()
        own.update(old)
    known = set(held.db.stores())
    for var, v in list(env.vars.items()):
        if var in held.handles and isinstance(v, Opened):
            env.vars[var] = held.handles[var]
        elif isinstance(v, Opened) and v.name in changed:  # opened within the transaction
            if v.name in known:
                env.vars[var] = Opened(v.name, held.db.read(v.name))
            else:
                del env.vars[var]


def _reopen(env: Env, db: Catalog, names: list[str]) -> None:
    for var, v in env.vars.items():
        if isinstance(v, Opened) and v.name in names:
            env.vars[var] = Opened(v.name, db.read(v.name))


def _one(env: Env, s: Step) -> None:
    args = fill(dict(s.args), env)
    keep = args.pop("save_to", None)
    got = OPS[s.op](env, s, args)
    if keep and isinstance(got, (DataFrame, Opened)):
        # written once, so that later steps read it; a store of the session
        got = env.db.materialize(str(keep), got.df if isinstance(got, Opened) else got)
    if s.op not in ("if", "loop", "block", "open_db", "begin_tx", "commit_tx", "rollback_tx", "defer", "return"):
        env.vars[s.result_var] = got
        env.last = s.result_var


_COMPILED: dict[str, list[Step]] = {}


def prepare(script: object, known: set[str] = frozenset()) -> list[Step]:
    """Parsed, normalised and checked steps, kept by the SHA-256 of their JSON."""
    key = hashlib.sha256(json.dumps([script if not isinstance(script, list) else [x.__dict__ if isinstance(x, Step) else x for x in script], sorted(known)], sort_keys=True, default=str).encode()).hexdigest()
    if key not in _COMPILED:
        steps = normalize(parse(script))
        check(steps, set(known))
        _COMPILED[key] = steps
    return _COMPILED[key]


def execute(script: object, catalog: Catalog, params: Mapping[str, object] | None = None) -> Env:
    """Runs the steps; deferred steps run last, in reverse, whatever happens."""
    env = Env(catalog, dict(params or {}))
    steps = prepare(script, set(env.vars))
    try:
        _block(env, steps)
    except Exception:
        _rollback(env)
        raise
    finally:
        for s in reversed(env.cleanup):
            _one(env, replace(s, result_var=s.result_var or "__deferred"))
    return env


def run(script: object, catalog: Catalog, params: Mapping[str, object] | None = None, collapse: bool = False) -> DataFrame:
    """The table a script gives: a variable output, final_result or result; what it returns; or its last
    table. With collapse, without prefixes where names stay unique.
    """
    env = execute(script, catalog, params)
    got = next((env.vars[k] for k in ("output", "final_result", "result") if isinstance(env.vars.get(k), (DataFrame, Opened))), None)
    if got is None:
        got = env.returned if env.returned is not None else env.vars.get(env.last or "")
    if isinstance(got, Opened):
        got = got.df
    if not isinstance(got, DataFrame):
        raise ScriptError("the script gives no table")
    return collapsed(got) if collapse else got

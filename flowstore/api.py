"""One-call queries over a catalog: select, join, fetch, scripts, slash commands and bulk changes."""

from __future__ import annotations

import shlex
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstore.functions.names import quoted
from flowstore.functions.phrases import parse_phrase
from flowstore.functions.predicates import condition, value_of
from flowstore.functions.projections import project
from flowstore.operators import joins, knowledge, mutations, scans, search
from flowstore.plans import pipeline
from flowstore.plans.tables import cut
from flowstore.sources.catalog import Catalog, StoreMeta


class BulkError(ValueError):
    """Items of a bulk change in error, with `errors`: their keys and what is wrong."""

    def __init__(self, errors: DataFrame):
        super().__init__("items in error: nothing was changed")
        self.errors = errors


@dataclass(frozen=True)
class Bulk:
    """The changed store, (key, error) of the items left out, and the items applied."""

    table: DataFrame
    errors: DataFrame
    applied: DataFrame

    def counts(self) -> DataFrame:
        """(applied, failed)."""
        return self.applied.agg(F.count("*").alias("applied")).crossJoin(self.errors.agg(F.count("*").alias("failed")))


def _with_all(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The rows with the columns of another table, null where they have none."""
    return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in like.dtypes if c not in rows.columns])


class Session:
    """Queries by store name; every method gives a DataFrame."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def select(
        self, store: str, fields: object = None, where: object = None, key: object = None, order_by: object = None,
        limit: int | None = scans.LIMITS["select"], action: str | None = None,
        values: Mapping[str, object] | None = None, database: str | None = None, **more: object,
    ) -> DataFrame:
        """Rows of a store or of a saved script that match; further arguments are equalities and must name
        columns. action is update (with values) or delete: the changed store.
        """
        db = self.catalog.database(database)
        df = pipeline.run(db.scripts[store], db) if store in db.scripts else db.read(store)
        meta = db.metas.get(store) or StoreMeta(store, db.meta(store).key if store in db.stores() else ())
        keys = [k for k in meta.key_fields if k in df.columns] or [df.columns[0]]
        hit = condition(df, where)
        if key is not None:
            hit = hit & condition(df, key if isinstance(key, Mapping) else {keys[0]: key})
        if more:
            hit = hit & condition(df, more)
        if action == "delete":
            return df.where(~F.coalesce(hit, F.lit(False)))
        if action == "update":
            types = dict(df.dtypes)
            return df.select(*[F.when(hit, F.lit(values[c]).cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in (values or {}) else F.col(f"`{c}`") for c in df.columns])
        out = scans.sort(df.where(hit), order_by) if order_by else scans.ordered(df.where(hit), keys)
        out = out if limit is None else out.limit(limit)
        return project(out, fields) if fields else out

    def join(
        self, left_store: str, right_store: str, left_fields: Sequence[str] | None = None,
        right_fields: Sequence[str] | None = None, how: str = "inner", fields: object = None, order_by: object = None,
        limit: int | None = scans.LIMITS["join"], right_database: str | None = None, action: str | None = None,
        update_values: Mapping[str, object] | None = None,
    ) -> DataFrame:
        """Two stores on equal fields; without fields on a declared relation. action: the left store without
        the rows that have a match (delete_left), or with update_values in them (update_left).
        """
        other = self.catalog.database(right_database)
        if not left_fields:
            pairs = joins.relation_of(self.catalog.meta(left_store), other.meta(right_store))
            left_fields, right_fields = [a for a, _ in pairs], [b for _, b in pairs]
        right_fields = right_fields or list(other.meta(right_store).key_fields)
        if action is not None:
            if action not in ("delete_left", "update_left"):
                raise ValueError(f"unknown action {action!r}")
            left = self.catalog.read(left_store)
            keys = other.read(right_store).select(*[quoted(f).alias(f"__k{i}") for i, f in enumerate(right_fields)]).distinct()
            same = reduce(lambda a, b: a & b, [quoted(f) == F.col(f"__k{i}") for i, f in enumerate(left_fields)])
            if action == "delete_left":
                return self._keep(left_store, left.join(keys, same, "left_anti"))
            hit, types, values = F.col("__k0").isNotNull(), dict(left.dtypes), update_values or {}
            joined = left.join(keys, same, "left")  # one row a key at most on the right
            return self._keep(left_store, joined.select(*[F.when(hit, F.lit(values[c]).cast(types[c])).otherwise(quoted(c)).alias(c) if c in values else quoted(c) for c in left.columns]))
        return joins.select_join(self.catalog.read(left_store), other.read(right_store), left_store, right_store, left_fields, right_fields, how, fields, order_by, limit)

    def fetch(self, store: str, key: object = None, prefix: str | None = None, where: object = None, limit: int = scans.LIMITS["fetch"]) -> DataFrame:
        return scans.fetch(self.catalog.read(store), self.catalog.meta(store).key_fields, key, prefix, where, limit)

    def script(self, steps: object, params: Mapping[str, object] | None = None) -> DataFrame:
        return pipeline.run(steps, self.catalog, params, collapse=True)

    def stream(self, steps: object, params: Mapping[str, object] | None = None):
        """The rows of a script one by one as dicts, partition by partition, so that the driver never holds them all."""
        for row in self.script(steps, params).toLocalIterator(prefetchPartitions=True):
            yield row.asDict(recursive=True)

    def bulk(self, store: str, rows: DataFrame, op: str = "add", mode: str = "auto_batch", order: str | None = None) -> Bulk:
        """Many changes as one write: add (new keys), update (columns of known keys; null ones stay), upsert or delete (known keys).

        An item in error is one with a null in its key, an add of a known key or of one that
        came before in the batch, an update or delete of an unknown key. mode: auto_batch
        applies all others; single applies nothing if there is any, and raises BulkError;
        explicit applies all others to the result only, and leaves the store to the caller.
        Of items of one key the last counts (the first to be added), by `order` or as they come.
        """
        if op not in ("add", "update", "upsert", "delete") or mode not in ("auto_batch", "single", "explicit"):
            raise ValueError(f"unknown {op!r} or {mode!r}")
        now, keys = self.catalog.read(store), list(self.catalog.meta(store).key_fields)
        at = quoted(order) if order else F.monotonically_increasing_id()
        numbered = cut(rows.withColumn("__at", at))  # written once, so that the order stays
        known = now.select(*[quoted(k) for k in keys]).distinct().withColumn("__known", F.lit(True))
        first = numbered.groupBy(*[quoted(k) for k in keys]).agg(F.min("__at").alias("__first"))
        tested = numbered.join(known, keys, "left").join(first, keys, "left")
        null = reduce(lambda a, b: a | b, [quoted(k).isNull() for k in keys])
        wrong = {"add": F.when(F.col("__known"), "exists").when(F.col("__at") > F.col("__first"), "repeated"), "upsert": F.lit(None).cast("string")}.get(op, F.when(F.col("__known").isNull(), "missing"))
        tested = cut(tested.withColumn("error", F.when(null, "null key").otherwise(wrong)))
        errors = tested.where("error is not null").select(*[quoted(k) for k in keys], "error")
        good = tested.where("error is null").select(*[quoted(c) for c in rows.columns], "__at")
        if mode == "single" and not errors.isEmpty():
            raise BulkError(errors)
        if op == "add":
            out = now.unionByName(good.drop("__at"), allowMissingColumns=True).select(*[quoted(c) for c in now.columns])
        elif op == "delete":
            out = mutations.delete_keys(now, good, keys)
        else:
            out = (mutations.update_from if op == "update" else mutations.upsert)(now, good if op == "update" else _with_all(good, now), keys, "__at")
        out = out.select(*[quoted(c) for c in now.columns])
        return Bulk(out if mode == "explicit" else self._keep(store, out), errors, good.drop("__at"))

    def bulk_add(self, store: str, rows: DataFrame, mode: str = "auto_batch") -> DataFrame:
        return self.bulk(store, rows, "add", mode).table

    def bulk_update(self, store: str, rows: DataFrame, mode: str = "auto_batch") -> DataFrame:
        return self.bulk(store, rows, "update", mode).table

    def bulk_upsert(self, store: str, rows: DataFrame, mode: str = "auto_batch") -> DataFrame:
        return self.bulk(store, rows, "upsert", mode).table

    def bulk_delete(self, store: str, keys: DataFrame, mode: str = "auto_batch") -> DataFrame:
        return self.bulk(store, keys, "delete", mode).table

    def search(self, space: str, phrase: str, category: str = "category", key: str = "id", text: str = "text", page_size: int = 10) -> DataFrame:
        """A page of the items that a phrase names: by category path if it has one, else by words."""
        said, items = parse_phrase(phrase, space), self.catalog.read(space)
        if said.path:
            return knowledge.by_path(items, category, said.path).orderBy(quoted(key)).offset((said.page - 1) * page_size).limit(page_size)
        return search.search(search.build(items, key, text), said.text, None).offset((said.page - 1) * page_size).limit(page_size)

    def _keep(self, store: str, df: DataFrame) -> DataFrame:
        self.catalog.register(store, df, self.catalog.metas.get(store))
        return df

    def command(self, text: str) -> DataFrame:
        """`/select store=users age=30 limit=5`, `/join left_store=a right_store=b`, `/fetch`, `/call_script name=x`."""
        head, *rest = shlex.split(text.lstrip("/"))
        args = {k: value_of(v) for k, v in (r.split("=", 1) for r in rest)}
        for many in ("left_fields", "right_fields"):
            if isinstance(args.get(many), str):
                args[many] = args[many].split(",")
        if head in ("call_script", "run"):
            return self.script(self.catalog.scripts[str(args.pop("name"))], args)
        if head not in ("select", "join", "fetch"):
            raise ValueError(f"unknown command {head!r}")
        return getattr(self, head)(**args)

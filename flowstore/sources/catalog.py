"""Databases, stores and what is known about them."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowstore.plans.tables import cut
from flowstore.sources import filesystem


@dataclass(frozen=True)
class Relation:
    """Columns that refer to the columns of another store."""

    source_fields: tuple[str, ...]
    target_store: str
    target_fields: tuple[str, ...]


@dataclass(frozen=True)
class IndexField:
    name: str
    descending: bool = False


@dataclass(frozen=True)
class StoreMeta:
    """What is known of a store: its key columns in index order, relations, uniqueness."""

    name: str
    key: tuple[IndexField, ...] = ()
    relations: tuple[Relation, ...] = ()
    unique: bool = True
    description: str = ""

    @property
    def key_fields(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.key)


#: Labels of types in an inferred schema.
LABELS = {"string": "string", "boolean": "boolean", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime"}

UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def label(dtype: str) -> str:
    if dtype.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) and not dtype.startswith("interval"):
        return "number"
    return LABELS.get(dtype) or ("list" if dtype.startswith("array") else "bytes" if dtype == "binary" else "object")


class Conflict(RuntimeError):
    """Another transaction committed a store since this one began."""


@dataclass
class Catalog:
    """Stores by name: tables of a directory, and those registered in the session.

    databases maps further names to directories. Scripts are saved pipelines; a script of
    one `select` or `scan` step can be read as a store (a view).

    Committed stores are written below `home` (the directory if none is given) as
    versions of their own; one small file there, replaced in one step, says which version
    of each store is the current one. They come before tables of the directory.
    """

    spark: SparkSession
    directory: str
    metas: dict[str, StoreMeta] = field(default_factory=dict)
    databases: dict[str, str] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    scripts: dict[str, list] = field(default_factory=dict)
    home: str | None = None
    opened: dict[str, Catalog] = field(default_factory=dict)

    def database(self, name: str | None) -> Catalog:
        """A database by name; the same object each time, with what was registered in it."""
        if name in (None, "", "current"):
            return self
        if name not in self.databases:
            raise KeyError(f"unknown database {name!r}")
        if name not in self.opened:
            home = f"{self.home}/{name}" if self.home != self.directory else None
            self.opened[name] = Catalog(self.spark, self.databases[name], dict(self.metas), self.databases, {}, self.scripts, home, self.opened)
        return self.opened[name]

    def __post_init__(self) -> None:
        self.home = self.home or self.directory

    def _manifest(self) -> str:
        return f"{self.home}/current.json"

    def versions(self) -> dict[str, str]:
        """Store -> folder of its current version, of those that were committed."""
        return json.loads(filesystem.read_text(self.spark, self._manifest()) or "{}")

    def commit(self, names: Iterable[str], since: Mapping[str, str] | None = None) -> dict[str, str]:
        """Writes registered stores as new versions, then makes all of them current in one step; the session reads what was written.

        since: the versions when the work began; a store that has another by now raises
        Conflict, and nothing changes. A crash before the last step leaves the old
        versions current. Old versions stay, as others may read them (`vacuum`).
        """
        names, manifest = sorted(set(names)), self._manifest()
        fresh = {n: f"{self.home}/{n}-{uuid.uuid4().hex}" for n in names}
        for n, path in fresh.items():
            self.tables[n].write.parquet(path)
        now = self.versions()
        if since is not None and (moved := [n for n in names if now.get(n) != since.get(n)]):
            for path in fresh.values():
                filesystem.delete(self.spark, path)
            raise Conflict(f"committed by others: {', '.join(moved)}")
        filesystem.write_text(self.spark, manifest, json.dumps(now | fresh, indent=1))
        for n, path in fresh.items():
            self.tables[n] = self.spark.read.schema(self.tables[n].schema).parquet(path)
        return fresh

    def vacuum(self) -> list[str]:
        """Deletes the versions that are not current; only where no other session reads them."""
        live = {p.rsplit("/", 1)[-1] for p in self.versions().values()}
        gone = [n for n in filesystem.names(self.spark, self.home) if n not in live and re.search(r"-[0-9a-f]{32}$", n)]
        for n in gone:
            filesystem.delete(self.spark, f"{self.home}/{n}")
        return gone

    def read(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return self.spark.read.parquet(self.versions().get(name) or f"{self.directory}/{name}.parquet")

    def meta(self, name: str) -> StoreMeta:
        """What was declared, or the first column as the key."""
        if name not in self.metas:
            self.metas[name] = StoreMeta(name, (IndexField(self.read(name).columns[0]),))
        return self.metas[name]

    def register(self, name: str, df: DataFrame, meta: StoreMeta | None = None) -> None:
        self.tables[name] = df
        self.metas[name] = replace(meta, name=name) if meta else StoreMeta(name, (IndexField(df.columns[0]),))

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)
        self.metas.pop(name, None)

    def create(self, name: str, schema: str = "key string, value string") -> DataFrame:
        """An empty store."""
        self.register(name, self.spark.createDataFrame([], schema))
        return self.tables[name]

    def materialize(self, name: str, df: DataFrame) -> DataFrame:
        """Registers df as written to the shared folder, so that later reads do not compute it again."""
        self.register(name, cut(df))
        return self.tables[name]

    def save(self, name: str) -> str:
        """Commits one store; the folder of the version."""
        return self.commit([name])[name]

    def stores(self) -> list[str]:
        found = {f[: -len(".parquet")] for f in filesystem.names(self.spark, self.directory) if f.endswith(".parquet")}
        return sorted(found | set(self.tables) | set(self.versions()))

    def list_stores(self) -> DataFrame:
        """(store, columns, key, relations, is_unique) of every store."""
        rows = []
        for s in self.stores():
            m = self.meta(s)
            rows.append((s, [f"{c}:{label(t)}" for c, t in self.read(s).dtypes], list(m.key_fields), [f"{','.join(r.source_fields)}->{r.target_store}.{','.join(r.target_fields)}" for r in m.relations], m.unique))
        return self.spark.createDataFrame(rows, "store string, columns array<string>, key array<string>, relations array<string>, is_unique boolean")

    def list_databases(self) -> DataFrame:
        """(database, directory) of the current database and those known by name."""
        return self.spark.createDataFrame([("current", self.directory), *sorted(self.databases.items())], "database string, directory string")

    def inspect(self, name: str) -> DataFrame:
        """(name, count, is_unique, description, schema: map of column to label) of one store; a text column is labelled by its value in some row."""
        df, m = self.read(name), self.meta(name)
        texts = [c for c, t in df.dtypes if t == "string"]
        one = df.select(*[F.col(f"`{c}`").rlike(UUID).alias(c) for c in texts]).first() if texts else None
        ids = {c for c in texts if one and one[c]}
        schema = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, "uuid" if c in ids else label(t))])
        return df.agg(F.count("*").alias("count")).select(F.lit(name).alias("name"), "count", F.lit(m.unique).alias("is_unique"), F.lit(m.description).alias("description"), schema.alias("schema"))


def relations(pairs: Mapping[str, str]) -> tuple[Relation, ...]:
    """Relations of {"column": "store.column"}."""
    return tuple(Relation((c,), t.split(".")[0], (t.split(".")[1],)) for c, t in pairs.items())

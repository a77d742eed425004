"""Preparing and ingesting items."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowstore.functions.text import fnv1a_hash
from flowstore.sources import files


def prepare(
    rows: DataFrame, name: str, parts: Sequence[str], title: str = "Symptoms",
    replace: Mapping[str, str] | None = None, extra: DataFrame | None = None,
) -> DataFrame:
    """(id, text, description) of items: the name, and its other columns trimmed, underscores as blanks,
    joined. id is the name in lower case and the FNV-1a hash of name and parts; rows without a name are
    left out; `extra` rows are appended.
    """
    clean = []
    for p in parts:
        c = F.replace(F.trim(F.col(f"`{p}`").cast("string")), F.lit("_"), F.lit(" "))
        for old, new in (replace or {}).items():
            c = F.replace(c, F.lit(old), F.lit(new))
        clean.append(F.when(c != "", c))
    base = rows.select(F.trim(F.col(f"`{name}`")).alias("text"), F.array_compact(F.array(*clean)).alias("p")).where("text <> ''")
    base = base.withColumn("h", F.concat("text", F.array_join("p", "")))
    hashed = fnv1a_hash(base, "h", "n")
    out = hashed.select(F.concat(F.lower(F.replace("text", F.lit(" "), F.lit("_"))), F.lit("_"), F.lower(F.hex("n"))).alias("id"), "text", F.concat(F.lit(f"{title}: "), F.array_join("p", ", ")).alias("description"))
    return out if extra is None else out.unionByName(extra)


def ingest(items: DataFrame, store: DataFrame, embed: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """The store with the items embedded and put in by key, in one write."""
    from flowstore.operators.mutations import upsert

    return upsert(store, embed(items).select(*store.columns), [key])


def workflow(spark: SparkSession, steps: Sequence[Mapping[str, object]], embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs steps {"kind": "prepare" | "ingest", ...}; files are read and written by `flowstore.sources.files`. The last step's table."""
    out = None
    for s in steps:
        if s["kind"] == "prepare":
            raw = files.read(spark, str(s["source"]), str(s.get("format", "csv")))
            out = prepare(raw, raw.columns[0], raw.columns[1:], str(s.get("title", "Symptoms")), s.get("replace"))
            if s.get("target"):
                files.write(out, str(s["target"]), "json", "overwrite")
        elif s["kind"] == "ingest":
            items = files.read(spark, str(s["source"]), "jsonl") if s.get("source") else out
            out = embed(items)
            if s.get("target"):
                files.write(out, str(s["target"]), "parquet", "overwrite")
        else:
            raise ValueError(f"unknown step {s['kind']!r}")
    return out

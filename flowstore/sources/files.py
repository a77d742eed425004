"""Files in and out: CSV, JSON arrays and lines, Parquet, ORC and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json", "jsonl", "text")


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """A table of one of FORMATS. CSV has a header, and text columns without a schema; json is an array or one object a file, jsonl one object a line."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(path, header=True, multiLine=True, escape='"')
    if kind == "json":
        return reader.json(path, multiLine=True)
    if kind == "jsonl":
        return reader.json(path)
    if kind in ("parquet", "orc", "text"):
        return getattr(reader, kind)(path)
    raise ValueError(f"no format {kind!r}; there are {FORMATS}")


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.csv(path, header=True, escape='"')
    elif kind in ("json", "jsonl"):
        writer.json(path)
    elif kind in ("parquet", "orc", "text"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"no format {kind!r}; there are {FORMATS}")

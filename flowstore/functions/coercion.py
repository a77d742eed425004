"""Values of one type as another, null where that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_number(c: Column | str) -> Column:
    """A double of a number, of text that is one, of a truth value (1 or 0)."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def like(c: Column | str, dtype: str) -> Column:
    """Cast to the type of a sample."""
    return (F.col(c) if isinstance(c, str) else c).try_cast(dtype)


def field(c: Column | str, path: str) -> Column:
    """A field inside JSON text, by a dotted path; null where the text is no object or has no such field."""
    return F.try_variant_get(F.try_parse_json(F.col(c) if isinstance(c, str) else c), "$." + path, "string")


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; the second wins."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))), F.map_entries(b)))


def flat(df: DataFrame, key: str, value: str) -> DataFrame:
    """The fields of two struct columns side by side; where both have a name, that of the value."""
    k, v = (df.schema[c].dataType.names for c in (key, value))
    return df.select(*[F.col(f"`{key}`.`{n}`").alias(n) for n in k if n not in v], *[F.col(f"`{value}`.`{n}`").alias(n) for n in v])

"""Text as Columns: tokens, names of categories, hashes and obfuscation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are no search terms.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

#: Spellings of category names that are replaced before punctuation is.
CATEGORY_NAMES = (("c#", "csharp"), ("c++", "cpp"), (".net", "dotnet"), ("&", " and "), ("＆", " and "))


def tokens(c: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case runs of letters and numbers of any script, without stop words."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*stop_words))


def category_name(c: Column | str) -> Column:
    """A category name in one form: lower case, a few spellings replaced, full-width letters and digits narrow, everything else blanks, single."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lower(F.trim(c))
    for old, new in CATEGORY_NAMES:
        out = F.replace(out, F.lit(old), F.lit(new))
    wide = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF41 + i) for i in range(26))
    out = F.translate(out, wide, "0123456789abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{Nd}\s]", " "), r"\s+", " "))


def join_key(*cols: Column) -> Column:
    """Values joined by `|`, for display; joins compare columns one by one."""
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def vector_hash(dim: int, *texts: Column) -> Column:
    """SHA-256 of the dimension and the texts: a change means that vectors are stale."""
    return F.sha2(F.concat(F.lit(f"dim:{dim}::"), *[F.concat(F.coalesce(t, F.lit("")), F.lit("::")) for t in texts]), 256)


def obfuscated(c: Column | str, prefix: str) -> Column:
    """prefix_ and the first 16 hexadecimal digits of the SHA-256; empty stays empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "", "").otherwise(F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(c, 256), 1, 16)))


def replaced(c: Column | str, names: Mapping[str, str]) -> Column:
    """Names in a text replaced, the longest first; for dictionaries of a few hundred."""
    out = F.col(c) if isinstance(c, str) else c
    for old in sorted(names, key=len, reverse=True):
        out = F.replace(out, F.lit(old), F.lit(names[old]))
    return out


def fnv1a(data: bytes) -> int:
    """The 32-bit FNV-1a hash."""
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def fnv1a_hash(df: DataFrame, c: str, out: str) -> DataFrame:
    """df with the 32-bit FNV-1a of a text column."""

    @F.pandas_udf("long")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fnv1a(t.encode()))

    return df.withColumn(out, of(F.col(f"`{c}`")))


def embed_by_hashing(df: DataFrame, text: str, out: str, dim: int, stop_words: Sequence[str] = (), synonyms: Mapping[str, str] | None = None) -> DataFrame:
    """df with a bag-of-words vector of length 1: each word adds 1 at its FNV-1a hash modulo dim. Stop
    words do not count, synonyms stand for each other; a text without words is all zero.
    """
    stop, same = frozenset(stop_words), dict(synonyms or {})

    def vector(t: str | None, places: dict[str, int]) -> list[float] | None:
        if t is None:
            return None
        v = [0.0] * dim
        for w in t.lower().split():
            at = places.get(w)
            if at is None:
                bare = w.strip(".,!?-")
                at = places[w] = fnv1a(same.get(bare, bare).encode()) % dim if bare and bare not in stop else -1
            if at >= 0:
                v[at] += 1.0
        size = sum(x * x for x in v) ** 0.5
        return [x / size for x in v] if size else v

    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + f", `{out}` array<float>"

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            places: dict[str, int] = {}  # each word of a batch is hashed once
            yield b.assign(**{out: [vector(t, places) for t in b[text]]})

    return df.mapInPandas(step, schema)

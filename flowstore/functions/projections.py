"""Field lists to columns: names, aliases and wildcards."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from flowstore.functions.names import find, quoted

#: Prefixes that name a side of a join and never become part of an output name.
SIDES = ("left.", "right.", "a.", "b.", "left_", "right_")


def fields_of(fields: object) -> list[tuple[str, str | None]]:
    """(source, alias or None) of a list of names, `name as alias`, maps with field and alias (or as), or
    src and dst; of `{alias: source}`, by sorted alias; or of a text with commas.
    """
    if isinstance(fields, str):
        fields = [p for p in (x.strip() for x in fields.split(",")) if p]
    if isinstance(fields, Mapping):
        return [(str(fields[k]), k) for k in sorted(fields)]
    out = []
    for f in fields:
        if isinstance(f, str):
            m = re.fullmatch(r"\s*(.+?)\s+as\s+(\S+)\s*", f, re.I)
            out.append((m[1], m[2]) if m else (f.strip(), None))
        elif isinstance(f, Mapping):
            low = {str(k).lower(): v for k, v in f.items()}
            if "field" in low:
                out.append((low["field"], low.get("alias", low.get("as"))))
            elif "src" in low:
                out.append((low["src"], low.get("dst")))
            else:
                out += [(str(v), k) for k, v in sorted(f.items())]
        else:
            raise ValueError(f"no field: {f!r}")
    return out


def _star(columns: Sequence[str], side: str | None, sides: Mapping[str, str]) -> list[tuple[str, str]]:
    if side is None:
        names = [(c, c) for c in columns]
    else:
        prefix = sides.get(side, side) + "."
        names = [(c, c[len(prefix) :]) for c in columns if c.lower().startswith(prefix.lower())]
    rest = [n for n in names if n[1].rsplit(".", 1)[-1] != "value"]
    return rest or names


def project(df: DataFrame, fields: object, sides: Mapping[str, str] | None = None) -> DataFrame:
    """The columns of a field list, in its order.

    `*` is every column but a system column `value` beside others; `store.*`, `left.*` and
    `a.*` the columns of one store, without its prefix (`sides` says which stores left,
    right, a and b are). An alias is kept as given; without one, the name less a side's
    prefix. A name without a column is left out. Names that meet are told apart by _2, _3.
    """
    sides, columns, picked = dict(sides or {}), df.columns, []
    for source, alias in fields_of(fields):
        if source == "*":
            picked += _star(columns, None, sides)
        elif source.endswith((".*", ".")):
            picked += _star(columns, source.rstrip("*").rstrip("."), sides)
        else:
            name = source
            for short, store in sides.items():
                if source.startswith(short + "."):
                    name = f"{store}.{source[len(short) + 1:]}"
            got = find(columns, name) or find(columns, source)
            if got is not None:
                plain = next((source[len(p) :] for p in SIDES if source.startswith(p)), source)
                picked.append((got, alias or plain))
    seen: dict[str, int] = {}
    out = []
    for source, name in picked:
        seen[name.lower()] = seen.get(name.lower(), 0) + 1
        out.append(quoted(source).alias(name if seen[name.lower()] == 1 else f"{name}_{seen[name.lower()]}"))
    return df.select(*out)


def sort_keys(fields: object) -> list[tuple[str, bool]]:
    """(name, descending) of `"a desc, b"`, lists of such, or maps with field (or key) and direction (or desc)."""
    if isinstance(fields, str):
        fields = fields.split(",")
    if isinstance(fields, Mapping):
        fields = [fields]
    out = []
    for f in fields:
        if isinstance(f, Mapping):
            name = f.get("field", f.get("key"))
            out.append((name, bool(f.get("desc")) or str(f.get("direction", "")).lower().startswith("desc")))
        else:
            m = re.fullmatch(r"\s*(\S+?)(?:\s+(asc|desc|ascending|descending))?\s*", f, re.I)
            if not m:
                raise ValueError(f"no sort key: {f!r}")
            out.append((m[1], (m[2] or "").lower().startswith("desc")))
    return out

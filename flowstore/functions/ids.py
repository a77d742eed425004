"""UUID columns in any spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NIL_UUID = "00000000-0000-0000-0000-000000000000"


def canonical_uuid(c: Column | str) -> Column:
    """The UUID in lower case with hyphens, or null where the text is none.

    Accepted, with white space around: the hyphenated form, the same after `urn:uuid:` in
    any case, the same between two enclosing characters, and 32 bare hexadecimal digits.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    body = (
        F.when(F.length(s) == 36, s)
        .when((F.length(s) == 45) & s.startswith("urn:uuid:"), F.substring(s, 10, 36))
        .when(F.length(s) == 38, F.substring(s, 2, 36))
        .when((F.length(s) == 32) & s.rlike("^[0-9a-f]{32}$"), F.regexp_replace(s, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    )
    return F.when(body.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), body)


def reference_uuid(c: Column | str) -> Column:
    """As `canonical_uuid`, with the nil UUID as null: the value of a reference."""
    u = canonical_uuid(c)
    return F.when(u != NIL_UUID, u)

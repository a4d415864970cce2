"""Deterministic identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS namespace of name-based identifiers.
DNS = "6ba7b8109dad11d180b400c04fd430c8"
#: Templates by rule name; each {field} is a column.
RULES = {"sop/plain": "{lang}:{book_code}:{para_key}", "sop/seq": "{lang}:{book_code}:{para_key}#{seq}", "bible/v1": "bible:{bible}:{osis}"}


def uid(template: str, **columns: Column) -> Column:
    """Fill a template; a null field is an error, as an identifier must never be built from a gap."""
    parts = []
    for literal, field in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if field:
            value = columns[field] if field in columns else F.col(field)
            parts.append(F.coalesce(rendered(value), F.raise_error(F.lit(f"missing field {field}")).cast("string")))
    return F.concat(*parts)


def rendered(value: Column) -> Column:
    """A field as it stands in an identifier: truth values are written True and False."""
    return F.when(F.typeof(value) == "boolean", F.initcap(value.cast("string"))).otherwise(value.cast("string"))


def uuid5(name: Column) -> Column:
    """Name-based identifier, version 5, in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def sequence_of(uid_: Column) -> Column:
    """The number after the last '#', 0 if there is none."""
    return F.coalesce(F.regexp_extract(uid_, "#([^#]*)$", 1).try_cast("int"), F.lit(0))

"""Canonical JSON and fingerprints, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegralType, StringType, StructType

#: Control characters whose escapes are written with hex letters, and in lower case here.
_LETTERED = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object's JSON with sorted keys, no spaces, nulls kept and only what must be escaped escaped: one text for one value.

    Values are texts, whole numbers, booleans, arrays of these, or structs made by `nested`. Numbers with fractions
    have no one text and are refused by fingerprint_of.
    """
    out = F.to_json(nested(fields), {"ignoreNullFields": "false"})
    for code in _LETTERED:  # an escape counts only after an even number of backslashes
        out = F.regexp_replace(out, rf"((?<!\\)(?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    return out


def nested(fields: dict[str, Column]) -> Column:
    return F.struct(*[fields[name].alias(name) for name in sorted(fields)])


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON, in lower-case hex."""
    return F.sha2(canonical_json(fields), 256)


def fingerprint_of(schema: StructType, names: list[str]) -> Column:
    """The fingerprint of some columns of a table, whose kinds are checked."""
    for name in names:
        if not _exact(schema[name].dataType):
            raise TypeError(f"{name} has no canonical text: {schema[name].dataType.simpleString()}")
    return fingerprint({name: F.col(name) for name in names})


def _exact(kind: DataType) -> bool:
    element = getattr(kind, "elementType", None)
    return isinstance(kind, StringType | IntegralType | BooleanType) or (element is not None and _exact(element))

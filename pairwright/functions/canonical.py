"""Canonical JSON text and content-derived identities as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex letters of control-character escapes. Spark writes them in upper case, canonical
# JSON wants lower case (\b \t \n \f \r have short escapes and never reach this form).
_ESCAPE_LETTERS = ("A", "B", "C", "D", "E", "F")


def body(fields: Mapping[str, Any]) -> Column:
    """A struct whose fields are in canonical (code unit) order; nested mappings nest."""
    parts = []
    for name in sorted(fields, key=lambda key: key.encode("utf-16-be")):
        value = fields[name]
        column = body(value) if isinstance(value, Mapping) else value
        parts.append(column.alias(name))
    return F.struct(*parts)


def canonical_json(fields: Mapping[str, Any] | Column) -> Column:
    """Canonical JSON of an object given as ``{name: Column or nested mapping}``.

    Arrays of objects are passed as columns whose element structs were made with ``body``.
    Numbers must be integers: the data model has no fractional values.
    """
    struct = fields if isinstance(fields, Column) else body(fields)
    text = F.to_json(struct, {"ignoreNullFields": "false"})
    lowered = text
    for letter in _ESCAPE_LETTERS:
        # an even run of backslashes before the escape means the escape itself is real
        lowered = F.regexp_replace(
            lowered, r"(?<!\\)((?:\\\\)*)\\u00([01])" + letter, r"$1\\u00$2" + letter.lower()
        )
    return F.when(text.contains("\\u00"), lowered).otherwise(text)


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def reference(content: Column, media_type: Column | str, version: int = 1) -> Column:
    """Artifact reference struct of a text payload."""
    media = media_type if isinstance(media_type, Column) else F.lit(media_type)
    return F.struct(
        sha256_hex(content).alias("sha256"),
        byte_length(content).alias("byte_length"),
        media.alias("media_type"),
        F.lit(version).alias("format_version"),
    )


def domain_id(prefix: str, domain: str, canonical_body: Column) -> Column:
    """``prefix`` + sha256(domain, NUL, canonical body): equal bodies in two domains never meet."""
    return F.concat(F.lit(prefix), sha256_hex(F.concat(F.lit(domain + "\0"), canonical_body)))


def hash_bucket(value: Column, buckets: int) -> Column:
    """Stable bucket in ``0..buckets-1`` from the first 32 bits of an md5."""
    return (F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def is_canonical(text: Column, schema: str, fields) -> Column:
    """Parse with a closed schema, write again, compare: false for any other spelling.

    ``fields`` maps the parsed struct to canonical fields, as in ``lambda o: {"k": o["k"]}``.
    """
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.coalesce(canonical_json(fields(parsed)) == text, F.lit(False))

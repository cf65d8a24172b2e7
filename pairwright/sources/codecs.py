"""Canonicalising codecs run once per distinct payload."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.canonical import sha256_hex
from pairwright.functions.jsontext import nfc
from pairwright.operators.keyed import attach
from pairwright.operators.rules import outside, violations

Codec = Callable[[Column], Column]


def whitespace_codec(text: Column) -> Column:
    """Runs of blanks become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def nfc_whitespace_codec(text: Column) -> Column:
    return whitespace_codec(nfc(text))


def canonicalize(payloads: DataFrame, key: str, payload: str, codec: Codec) -> DataFrame:
    """``(key, sha256, canonical_sha256, stored_is_canonical, idempotent)``.

    The codec sees each distinct digest once, whatever the number of copies; results are attached
    back by digest.
    """
    named = payloads.select(key, sha256_hex(F.col(payload)).alias("sha256"))
    unique = payloads.select(sha256_hex(F.col(payload)).alias("sha256"), payload).dropDuplicates(["sha256"])
    once = unique.withColumn("_once", codec(F.col(payload)))
    twice = once.withColumn("_twice", codec(F.col("_once")))
    results = twice.select(
        "sha256",
        sha256_hex(F.col("_once")).alias("canonical_sha256"),
        (F.col("_once") == F.col(payload)).alias("stored_is_canonical"),
        (F.col("_twice") == F.col("_once")).alias("idempotent"),
    )
    return attach(named, results, ["sha256"], spread=[key])


def codec_by_media_type(media_type: Column, codecs: Mapping[str, Codec]) -> Codec:
    """One codec that dispatches on the media type; an unregistered media type gives null."""

    def apply(payload: Column) -> Column:
        chosen = F.lit(None).cast("string")
        for name, codec in codecs.items():
            chosen = F.when(media_type == name, codec(payload)).otherwise(chosen)
        return chosen

    return apply


def codec_issues(payloads: DataFrame, key: str, media_type: str, payload: str, codecs: Mapping[str, Codec]) -> DataFrame:
    """``(key, code)``: unregistered media types, payloads not stored canonically, codecs that are not idempotent."""
    codec = codec_by_media_type(F.col(media_type), codecs)
    once = payloads.select(key, media_type, payload, codec(F.col(payload)).alias("_once"))
    both = once.withColumn("_twice", codec(F.col("_once")))
    return violations(
        both,
        [key],
        {
            "codec.unregistered": outside(F.col(media_type), list(codecs)),
            "codec.noncanonical": F.col("_once") != F.col(payload),
            "codec.idempotence": F.col("_twice") != F.col("_once"),
        },
    )

"""Keys, pseudonyms, buckets and calendar keys."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmetry.functions import vocab


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer key blocks of HMAC with a 64-byte block."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def pseudonymise(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of the text of `value` as 64 hex digits; NULL stays NULL."""
    inner, outer = hmac_pads(key)
    text = F.encode(value.cast("string"), "UTF-8")
    digest = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), text), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), digest), 256)


def mask_columns(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """Pseudonymise those of `columns` that exist."""
    return df.withColumns({c: pseudonymise(F.col(c), key) for c in columns if c in df.columns})


def pii_leaks(df: DataFrame, forbidden: list[str] | None = None) -> DataFrame:
    """One row per forbidden column that holds plain values, with their count."""
    present = [c for c in (forbidden or vocab.PII_FIELDS) if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "field string, n_values long")
    counts = df.agg(*[F.count(c).alias(c) for c in present])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_values")) for c in present])
    )
    return counts.select(pairs.alias("hit")).select("hit.*").where("n_values > 0")


def ab_bucket(user: Column, experiment: Column) -> Column:
    """Stable bucket 0..99 of a user in an experiment."""
    digest = F.md5(F.encode(F.concat_ws(":", user.cast("string"), experiment), "UTF-8"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100).cast("int")


def model_uri(name: Column, stage: Column) -> Column:
    return F.concat(F.lit("models:/"), name, F.lit("/"), stage)


def uuid5_id(kind: str, value: Column) -> Column:
    """Name-based UUID (version 5, DNS namespace) of `kind.value`."""
    name = F.encode(F.concat(F.lit(kind + "."), value.cast("string")), "UTF-8")
    h = F.sha1(F.concat(F.lit(bytearray(uuid.NAMESPACE_DNS.bytes)), name))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def date_key(day: Column) -> Column:
    """Date or timestamp as the integer YYYYMMDD; NULL stays NULL."""
    return F.date_format(day.cast("date"), "yyyyMMdd").cast("int")


def daily_rotation(day: Column) -> Column:
    """Difficulty of the daily puzzle by weekday, Sunday first."""
    return F.element_at(F.array(*[F.lit(d) for d in vocab.DAILY_ROTATION]), F.dayofweek(day))

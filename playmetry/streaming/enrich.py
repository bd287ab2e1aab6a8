"""Parsing and scoring of the two event streams. All functions also work on static frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playmetry.functions.scoring import anomaly_features_session, anomaly_heuristic
from playmetry.sources.events import CLIENT_BATCH, CORRUPT, MATCH_EVENT, SESSION_EVENT


def parse(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns of a stream with a JSON `value` (bytes or text), and the bad text if any."""
    with_bad = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    body = F.from_json(
        F.col("value").cast("string"),
        with_bad,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    return raw.select(body.alias("e")).select("e.*")


def _good(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def enrich_sessions(sessions: DataFrame) -> DataFrame:
    """Score session columns: defaults stand in for missing fields, the row always stays."""
    features = anomaly_features_session(
        F.coalesce("time_elapsed_ms", F.lit(60_000)),
        F.coalesce("cells_filled", F.lit(45)),
        F.coalesce("errors_count", F.lit(0)),
        F.coalesce("hints_used", F.lit(0)),
        F.coalesce("difficulty", F.lit("medium")),
    )
    scored = sessions.withColumn("__f", features).withColumn("__a", anomaly_heuristic(F.col("__f")))
    return (
        scored.withColumn("anomaly_score", F.col("__a.anomaly_score"))
        .withColumn("reconstruction_error", F.col("__a.reconstruction_error"))
        .withColumn("is_anomalous", F.col("__a.is_anomalous"))
        .drop("__f", "__a")
    )


def enrich_sessions_stream(raw: DataFrame) -> DataFrame:
    """Session events, scored and stamped."""
    sessions = _good(parse(raw, SESSION_EVENT)).withColumn(
        "completed_at", F.try_to_timestamp("completed_at")
    )
    return enrich_sessions(sessions).withColumn("enriched_at", F.current_timestamp())


def matches_stream(raw: DataFrame) -> DataFrame:
    """Match events, typed and stamped."""
    return (
        _good(parse(raw, MATCH_EVENT))
        .withColumn("completed_at", F.try_to_timestamp("completed_at"))
        .withColumn("consumed_at", F.current_timestamp())
    )


def bad_events(raw: DataFrame, schema: T.StructType = MATCH_EVENT) -> DataFrame:
    """Text of the events that are not valid JSON, for a quarantine sink."""
    return parse(raw, schema).where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("value"))


def explode_client_batches(raw: DataFrame) -> DataFrame:
    """One row per client event of each batch envelope."""
    batches = _good(parse(raw, CLIENT_BATCH))
    return batches.select("user_id", "device_id", F.explode("events").alias("e")).select(
        "user_id",
        "device_id",
        F.col("e.name").alias("name"),
        F.col("e.properties").alias("properties"),
        F.try_to_timestamp("e.timestamp").alias("ts"),
    )


def dedup_events(df: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Each id once. A stream remembers ids for `delay` of event time."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])

"""Registered queries of event lines, streams over static rows, logs, ids and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from playmetry.functions import text
from playmetry.operators import privacy
from playmetry.operators.boards import let
from playmetry.plans import binding as b
from playmetry.plans.oracle import hmac_sql
from playmetry.plans.queries_rules import KEY
from playmetry.plans.registry import register
from playmetry.sources import events as ev
from playmetry.streaming import enrich

_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _broken(value, key: str):
    """Every seventh line is cut short and no JSON any more, every eleventh is blank."""
    return F.when(F.col(key) % 11 == 0, "  ").when(F.col(key) % 7 == 0, F.substring(value, 1, 30)).otherwise(value)


def _match_lines(spark, d):
    m = b.matches(spark, d)
    body = F.to_json(
        F.struct(
            *[F.col(c).cast("string").alias(c) for c in ("match_id", "room_id", "winner_id", "loser_id")],
            "winner_elo_before", "winner_elo_after", "loser_elo_before", "loser_elo_after", "elo_delta", "difficulty", "end_reason",
            F.col("duration_ms").cast("int").alias("duration_ms"),
            F.date_format("completed_at", _TIME).alias("completed_at"),
        )
    )
    return m.select(_broken(body, "match_id").alias("value"))


def _session_lines(spark, d):
    s = b.sessions(spark, d)
    body = F.to_json(
        F.struct(
            F.col("id").cast("string").alias("session_id"),
            F.col("user_id").cast("string").alias("user_id"),
            "difficulty",
            F.col("time_elapsed_ms").cast("int").alias("time_elapsed_ms"),
            F.col("hints_used").cast("int").alias("hints_used"),
            F.col("errors_count").cast("int").alias("errors_count"),
            "cells_filled",
            F.date_format("started_at", _TIME).alias("completed_at"),
        )
    )
    return s.select(_broken(body, "id").alias("value"))


register(
    "read_event_jsonl",
    """SELECT count(*) FILTER (WHERE match_id % 7 <> 0) AS good, count(*) FILTER (WHERE match_id % 7 = 0) AS bad
       FROM matches WHERE match_id % 11 <> 0""",
)(lambda spark, d: ev.corrupt_count(ev.event_lines(_match_lines(spark, d), "matches", keep_corrupt=True)))
register(
    "project_match_events",
    """SELECT CAST(match_id AS VARCHAR) AS match_id, CAST(winner_id AS VARCHAR) AS winner_id, CAST(loser_id AS VARCHAR) AS loser_id,
              winner_elo_after, elo_delta, difficulty, end_reason, completed_at
       FROM matches WHERE match_id % 7 <> 0 AND match_id % 11 <> 0""",
)(
    lambda spark, d: ev.project_match_events(ev.event_lines(_match_lines(spark, d), "matches")).select(
        "match_id", "winner_id", "loser_id", "winner_elo_after", "elo_delta", "difficulty", "end_reason", "completed_at"
    )
)
register(
    "project_session_events",
    """SELECT CAST(id AS VARCHAR) AS session_id, CAST(user_id AS VARCHAR) AS user_id, difficulty, CAST(hints_used AS INTEGER) AS hints_used,
              started_at AS completed_at FROM sessions WHERE id % 7 <> 0 AND id % 11 <> 0""",
)(
    lambda spark, d: ev.project_session_events(ev.event_lines(_session_lines(spark, d), "sessions")).select(
        "session_id", "user_id", "difficulty", "hints_used", "completed_at"
    )
)
register(
    "enrich_sessions_stream",
    "SELECT CAST(id AS VARCHAR) AS session_id, started_at AS completed_at, anomaly_score, is_anomalous FROM enriched WHERE id % 7 <> 0 AND id % 11 <> 0",
    "anomaly_score",
)(
    lambda spark, d: enrich.enrich_sessions_stream(_session_lines(spark, d).where(F.trim("value") != "")).select(
        "session_id", "completed_at", "anomaly_score", "is_anomalous"
    )
)
register(
    "matches_stream",
    "SELECT CAST(match_id AS VARCHAR) AS match_id, duration_ms::INTEGER AS duration_ms, completed_at FROM matches WHERE match_id % 7 <> 0 AND match_id % 11 <> 0",
)(lambda spark, d: enrich.matches_stream(_match_lines(spark, d).where(F.trim("value") != "")).select("match_id", "duration_ms", "completed_at"))
register(
    "bad_events",
    """SELECT substr('{"match_id":"' || match_id || '","room_id":"' || room_id || '"', 1, 30) AS value
       FROM matches WHERE match_id % 7 = 0 AND match_id % 11 <> 0""",
)(lambda spark, d: enrich.bad_events(_match_lines(spark, d).where(F.trim("value") != "")))
register(
    "dedup_events",
    "SELECT event_id, user_id, event_type FROM events",
)(
    lambda spark, d: enrich.dedup_events(
        b.events(spark, d).union(b.events(spark, d).where("event_id % 3 = 0")), "event_id", "ts"
    ).select("event_id", "user_id", "event_type")
)


def _client_batches(spark, d):
    """Envelopes of up to fifty client events of one user."""
    event = F.struct(F.col("event_type").alias("name"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("properties"), F.date_format("ts", _TIME).alias("timestamp"))
    batch = b.events(spark, d).groupBy("user_id", F.floor(F.col("event_id") / 50).alias("n")).agg(F.collect_list(event).alias("events"))
    return batch.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"), F.col("n").cast("string").alias("device_id"), "events")).alias("value"))


register(
    "explode_client_batches",
    "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id // 50 AS VARCHAR) AS device_id, event_type AS name, CAST(event_id AS VARCHAR) AS id, ts FROM events",
)(
    lambda spark, d: enrich.explode_client_batches(_client_batches(spark, d)).select(
        "user_id", "device_id", "name", F.col("properties")["id"].alias("id"), "ts"
    )
)


def _grids(spark, d):
    """Boards as nine rows of cells, each with a value that is null where the cell is blank."""
    cell = lambda v: F.struct(F.nullif(v, F.lit(0)).alias("value"))
    rows = lambda board: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda r: F.transform(F.slice(board, r * 9 + 1, 9), cell))
    return b.boards(spark, d).select("puzzle_id", let(F.col("board"), rows).alias("grid"))


register(
    "flatten_grid",
    "SELECT puzzle_id, string_agg(CAST(v AS VARCHAR), '' ORDER BY idx) AS cells FROM boards GROUP BY 1",
)(
    lambda spark, d: _grids(spark, d).select(
        "puzzle_id", F.array_join(text.flatten_grid(F.col("grid")).cast("array<string>"), "").alias("cells")
    )
)


def _log_lines(spark, d):
    """Events as lines of the services' logs."""
    e = b.events(spark, d)
    kind = F.col("event_type")
    n = F.col("event_id").cast("string")
    service = F.when(kind == "view", "game-service").when(kind == "click", "multiplayer").when(kind == "signup", "ml-service").otherwise("airflow-worker")
    line = (
        F.when(kind == "view", F.to_json(F.struct(F.lit("info").alias("level"), F.lit("seen").alias("message"), n.alias("requestId"), F.col("user_id").cast("string").alias("userId"))))
        .when(kind == "click", F.to_json(F.struct(F.lit("warn").alias("level"), F.lit("moved").alias("msg"), n.alias("room_id"))))
        .when(kind == "signup", F.concat(F.lit("INFO  row "), n))
        .otherwise(F.concat(F.lit("[2024] {task.py:1} ERROR - row "), n))
    )
    return e.select("event_id", service.alias("service"), line.alias("line"))


register(
    "parse_service_log",
    """SELECT event_id,
              CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'warn' WHEN 'signup' THEN 'INFO' ELSE 'ERROR' END AS level,
              CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'moved' ELSE 'row ' || event_id END AS message,
              CASE WHEN event_type = 'view' THEN CAST(event_id AS VARCHAR) END AS request_id,
              CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) END AS user_id,
              CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) END AS room,
              CASE WHEN event_type NOT IN ('view', 'click', 'signup') THEN '2024' END AS ts
       FROM events""",
)(
    lambda spark, d: _log_lines(spark, d)
    .select("event_id", text.parse_service_log(F.col("service"), F.col("line")).alias("p"))
    .select("event_id", "p.level", "p.message", "p.request_id", "p.user_id", "p.room", "p.ts")
)
register(
    "erasure_audit",
    f"SELECT DISTINCT {hmac_sql('id', KEY)} AS user_hash, TIMESTAMP '2024-01-01' AS requested_at, TIMESTAMP '2024-01-02' AS erased_at FROM users WHERE NOT is_active",
)(lambda spark, d: privacy.erasure_audit(b.people(spark, d).where("NOT is_active").select("id"), "2024-01-01", "2024-01-02", KEY))
register(
    "read_id_list",
    "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 5 NOT IN (0, 1)",
)(
    lambda spark, d: ev.id_list(
        b.table(spark, d, "customer").select(
            F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" # "), F.col("c_name")))
            .when(F.col("c_custkey") % 5 == 1, "  ")
            .otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")))
            .alias("value")
        )
    )
)
register(
    "expire_event_partitions",
    """SELECT '/data/sessions/' || strftime(o_orderdate, '%Y-%m-%d') || '.jsonl' AS path, CAST(o_orderdate AS DATE) AS date
       FROM (SELECT DISTINCT o_orderdate FROM orders) WHERE o_orderdate < DATE '1999-01-01'""",
)(
    lambda spark, d: ev.expired_files(
        b.orders(spark, d)
        .select(F.concat(F.lit("/data/sessions/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".jsonl")).alias("path"))
        .distinct()
        .union(b.table(spark, d, "nation").select(F.concat(F.lit("/data/sessions/"), F.col("n_name"), F.lit(".jsonl")))),
        "1999-01-01",
    )
)

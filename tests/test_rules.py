"""Literal cases of the rules."""

import datetime as dt
import hashlib
import hmac
import uuid

import pytest
from pyspark.sql import functions as F

from playmetry.functions import ids, scoring, text
from playmetry.operators import experiments as ex
from playmetry.operators import features, frames, joins, metrics, quality, ranking
from playmetry.streaming.enrich import enrich_sessions


def ts(s):
    return dt.datetime.fromisoformat(s)


@pytest.fixture(scope="module")
def day_matches(spark):
    return spark.createDataFrame(
        [
            ("m1", "r1", "u1", "u2", 1200, 1216, 1200, 1184, 16, "medium", "completed", 120000, ts("2026-03-13 11:00:00")),
            ("m2", "r2", "u3", "u1", 1300, 1312, 1216, 1204, 12, "hard", "completed", 240000, ts("2026-03-13 15:00:00")),
        ],
        "match_id string, room_id string, winner_id string, loser_id string, winner_elo_before int, winner_elo_after int, "
        "loser_elo_before int, loser_elo_after int, elo_delta int, difficulty string, end_reason string, duration_ms int, "
        "completed_at timestamp",
    )


def test_full_day(spark, day_matches, rows):
    trends = metrics.elo_trends(day_matches, "2026-03-13")
    got = rows(trends, "user_id", "matches_played", "wins", "losses", "elo_start", "elo_end", "elo_delta")
    assert got == [("u1", 2, 1, 1, 1200, 1204, 4), ("u2", 1, 0, 1, 1200, 1184, -16), ("u3", 1, 1, 0, 1300, 1312, 12)]
    stats = metrics.match_stats_daily(day_matches).first()
    assert (stats["total_matches"], stats["avg_elo_delta"], stats["avg_duration_ms"]) == (2, 14.0, 180000.0)
    assert stats["difficulty_breakdown"] == '{"hard":1,"medium":1}'
    board = ranking.leaderboard_snapshot(trends, "2026-03-13")
    assert rows(board, "rank", "user_id", "elo_rating", "wins", "losses") == [
        (1, "u3", 1312, 1, 0), (2, "u1", 1204, 1, 1), (3, "u2", 1184, 0, 1),
    ]
    rates = board.select(F.round(scoring.win_rate(F.col("wins"), F.col("losses")), 4), "rank").collect()
    assert {r[1]: r[0] for r in rates} == {1: 1.0, 2: 0.5, 3: 0.0}


def test_snapshot_modes(spark, rows):
    trends = spark.createDataFrame(
        [(dt.date(2026, 3, 1), "a", 1, 0, 1500), (dt.date(2026, 3, 2), "a", 0, 1, 1300), (dt.date(2026, 3, 2), "b", 1, 0, 1400)],
        "date date, user_id string, wins long, losses long, elo_end int",
    )
    latest = ranking.leaderboard_snapshot(trends, "2026-03-02")
    assert rows(latest, "rank", "user_id", "elo_rating") == [(1, "b", 1400), (2, "a", 1300)]
    reference = ranking.leaderboard_snapshot(trends, "2026-03-02", mode="reference")
    assert rows(reference, "rank", "user_id", "elo_rating") == [(1, "a", 1500), (2, "b", 1400), (3, "a", 1300)]


def test_empty_date(day_matches):
    assert metrics.match_stats_daily(day_matches, "2026-03-14").count() == 0
    assert metrics.elo_trends(day_matches, "2026-03-14").count() == 0


def test_anomaly_report(spark):
    sessions = spark.createDataFrame(
        [("s1", 0.2, False, ts("2026-03-13 10:00:00")), ("s2", 2.8, True, ts("2026-03-13 12:00:00")),
         ("s3", None, None, ts("2026-03-14 12:00:00"))],
        "session_id string, anomaly_score double, is_anomalous boolean, completed_at timestamp",
    )
    first = metrics.anomaly_report_daily(sessions, "2026-03-13").first()
    assert (first["flagged_count"], first["flag_rate"], first["avg_anomaly_score"]) == (1, 0.5, 1.5)
    unscored = metrics.anomaly_report_daily(sessions, "2026-03-14").first()
    assert (unscored["flagged_count"], unscored["avg_anomaly_score"], unscored["avg_scored"]) == (0, 0.0, None)


@pytest.mark.parametrize(
    ("w", "l", "winner", "loser", "delta"),
    [(1300, 1300, 1316, 1284, 16), (1600, 1600, 1612, 1588, 12), (1900, 1900, 1908, 1892, 8), (1200, 1200, 1216, 1184, 16),
     (2000, 100, 2001, 100, 1)],
)
def test_elo(spark, w, l, winner, loser, delta):
    row = spark.range(1).select(scoring.elo_update(F.lit(w), F.lit(l)).alias("e")).first()["e"]
    assert tuple(row) == (winner, loser, delta)


def test_expected_scores_sum_to_one(spark):
    frame = spark.range(100, 2500, 77).select(
        (scoring.elo_expected(F.col("id"), F.lit(1500)) + scoring.elo_expected(F.lit(1500), F.col("id"))).alias("s")
    )
    assert all(abs(r["s"] - 1) < 1e-12 for r in frame.collect())


def test_model_metrics(spark):
    rows = [
        ("m", "easy", "easy" if i == 0 else None, 0.95, float(10 * (i + 1))) for i in range(9)
    ] + [("m", "hard", "easy", 0.5, 100.0)]
    frame = spark.createDataFrame(rows, "model string, predicted string, actual string, confidence double, latency_ms double")
    m = metrics.model_metrics(frame).first()
    assert (m["mean_ms"], m["p50_ms"], m["p95_ms"], m["p99_ms"], m["max_ms"]) == (55.0, 55.0, 95.5, 99.1, 100.0)
    assert m["accuracy"] == 0.5 and m["below_70_pct"] == 0.1


def test_alerts(spark):
    frame = spark.createDataFrame(
        [(1, "m", ts("2026-01-01 00:00:00"), 600.0, 0.9), (2, "m", ts("2026-01-01 00:01:00"), 10.0, 0.1),
         (3, "m", ts("2026-01-01 00:02:00"), 500.0, 0.3)],
        "prediction_id long, model string, ts timestamp, latency_ms double, confidence double",
    )
    assert [(r["prediction_id"], r["alert"]) for r in metrics.alert_rows(frame).collect()] == [(2, "confidence"), (1, "latency")]


def shares(spark, values):
    return spark.createDataFrame(list(values.items()), "class string, share double")


def test_drift(spark):
    empty = shares(spark, {"easy": 1.0}).limit(0)
    assert tuple(ex.psi_drift(empty, shares(spark, {"easy": 1.0})).first()) == (0.0, False, "no_data")
    same = ex.psi_drift(shares(spark, {"a": 0.5, "b": 0.5}), shares(spark, {"a": 0.5, "b": 0.5})).first()
    assert tuple(same) == (0.0, False, "no_drift")
    moved = ex.psi_drift(shares(spark, {"easy": 1.0}), shares(spark, {"easy": 0.2, "medium": 0.4, "hard": 0.4})).first()
    assert moved["psi"] == pytest.approx(6.0687, abs=1e-4) and moved["status"] == "significant_drift"


def test_profile(spark):
    times = {"hard": [400000, 350000, 450000, 500000], "medium": [400000], "super_hard": [520000]}
    order = [("hard", 400000), ("hard", 350000), ("medium", 400000), ("hard", 450000), ("hard", 500000), ("super_hard", 520000)]
    rows = [(1, i, d, t, 1, "completed", ts(f"2026-01-0{i + 1} 00:00:00")) for i, (d, t) in enumerate(order)]
    frame = spark.createDataFrame(
        rows, "user_id long, id long, difficulty string, time_elapsed_ms long, hints_used long, status string, started_at timestamp"
    )
    p = features.user_profile(frame).first()
    assert (p["preferred_difficulty"], p["hint_usage_rate"], p["skill_level"]) == ("hard", 1.0, "beginner")
    assert p["improvement_trend"] == "declining"
    assert p["avg_solve_times_ms"]["hard"] == sum(times["hard"]) / 4
    better = spark.createDataFrame(
        [(1, i, "hard", 600000 - 50000 * i, 0, "completed", ts(f"2026-01-0{i + 1} 00:00:00")) for i in range(8)], frame.schema
    )
    assert features.improvement_trend(better).first()["improvement_trend"] == "improving"


def test_session_features(spark):
    frame = spark.createDataFrame(
        [("slow", 300000, 45, 4, 2, "medium", None), ("fast", 3000, 50, 0, 0, "hard", [60] * 50)],
        "id string, ms int, cells int, errors int, hints int, difficulty string, times array<int>",
    )
    f = scoring.anomaly_features_session(*[F.col(c) for c in ("ms", "cells", "errors", "hints", "difficulty", "times")])
    got = {r["id"]: r for r in frame.select("id", f.alias("f")).select("id", scoring.anomaly_heuristic(F.col("f")).alias("a"), "f").collect()}
    assert not got["slow"]["a"]["is_anomalous"] and got["slow"]["a"]["suspicion"] == 0
    assert got["fast"]["a"]["is_anomalous"] and got["fast"]["a"]["suspicion"] == pytest.approx(1.1)
    assert all(0 <= v <= 1 for r in got.values() for v in r["f"])


def test_enrich_defaults(spark):
    frame = spark.createDataFrame(
        [(None, None, None, None, None)],
        "time_elapsed_ms int, cells_filled int, errors_count int, hints_used int, difficulty string",
    )
    row = enrich_sessions(frame).first()
    assert row["anomaly_score"] is not None and row["is_anomalous"] is False


@pytest.mark.parametrize(
    ("value", "category"),
    [("Good game, well played!", "clean"), ("You are such an idiot!", "toxic"), ("kill yourself", "severe_toxic"), ("", "clean"),
     ("   ", "clean"), (None, "clean"), ("I will kill you", "severe_toxic"), ("i will find you", "threat"), ("skill matters", "clean"),
     ("éidiot", "clean"), ("x " * 600 + "idiot", "toxic")],
)
def test_moderation(spark, value, category):
    frame = spark.createDataFrame([(value,)], "t string")
    assert frame.select(text.toxicity_keywords(F.col("t")).alias("r")).first()["r"]["category"] == category


def test_moderation_cut(spark):
    frame = spark.createDataFrame([("x " * 600 + "idiot",)], "t string")
    assert frame.select(text.toxicity_keywords(F.col("t"), max_chars=512).alias("r")).first()["r"]["category"] == "clean"


def test_profanity(spark):
    frame = spark.createDataFrame([("Damn, what a classic LOSER",)], "t string")
    assert frame.select(text.mask_profanity(F.col("t"))).first()[0] == "****, what a classic *****"


def test_mute(spark, rows):
    chat = [("r", "a", i, "you idiot") for i in range(1, 5)] + [("r", "b", 5, "hello"), ("r", "a", 6, "hi"), ("r", "b", 7, "  ")]
    got = ranking.mute_after_warnings(spark.createDataFrame(chat, "room_id string, user_id string, seq long, text string"))
    assert {r["seq"]: r["fate"] for r in got.collect()} == {
        1: "blocked", 2: "blocked", 3: "muted", 4: "dropped", 5: "delivered", 6: "dropped",
    }


def test_mute_reads_whole_messages(spark):
    chat = [("r", "a", 1, "word " * 200 + "idiot"), ("r", "a", 2, "word " * 200)]
    got = ranking.mute_after_warnings(spark.createDataFrame(chat, "room_id string, user_id string, seq long, text string"))
    assert {r["seq"]: r["fate"] for r in got.collect()} == {1: "blocked", 2: "delivered"}


def test_page_limits(spark):
    for number, size in ((0, 5), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            frames.page(spark.range(3), [F.col("id")], number, size)


def test_first_and_last_at_one_time(spark):
    """Whole-number and text keys decide between matches of one time, by their order."""
    for kind in ("long", "string"):
        rows = [(i, 1, 2, 100 + i, 101 + i, 5, 5) for i in (3, 20, 100)]
        frame = spark.createDataFrame(rows, "match_id long, winner_id int, loser_id int, winner_elo_before int, winner_elo_after int, loser_elo_before int, loser_elo_after int")
        frame = frame.withColumn("match_id", F.col("match_id").cast(kind)).withColumn("completed_at", F.lit("2026-01-01").cast("timestamp"))
        got = {r["user_id"]: (r["elo_start"], r["elo_end"]) for r in ranking.first_touch_features(frame).collect()}
        assert got[1] == ((103, 201) if kind == "long" else (200, 104))


def test_pseudonym_is_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([("user-1",), (None,)], "v string").select(ids.pseudonymise(F.col("v"), key)).collect()
        assert got[0][0] == hmac.new(key, b"user-1", hashlib.sha256).hexdigest() and got[1][0] is None


def test_bucket_and_uuid(spark):
    row = spark.range(1).select(
        ids.ab_bucket(F.lit("user-1"), F.lit("exp")).alias("b"), ids.uuid5_id("puzzle", F.lit("abc")).alias("u")
    ).first()
    assert row["b"] == int(hashlib.md5(b"user-1:exp").hexdigest()[:8], 16) % 100 == 0
    assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "puzzle.abc"))


def test_variant(spark, rows):
    users = spark.createDataFrame(
        [("user-1", "exp"), ("user-1", "paused"), ("user-1", "none"), ("user-1", "over")], "user_id string, experiment_name string"
    )
    config = spark.createDataFrame(
        [("exp", "m", "Production", "Staging", 0.29, "active", None), ("paused", "m", "Production", "Staging", 1.0, "paused", None),
         ("over", "m", "Production", "Staging", 1.0, "active", ts("2020-01-01 00:00:00"))],
        "experiment_name string, model_name string, control_variant string, treatment_variant string, traffic_split double, "
        "status string, end_date timestamp",
    )
    got = rows(ex.assign_variant(users, config, "2024-01-01"), "experiment_name", "variant", "model_uri")
    assert got == [
        ("exp", "treatment", "models:/m/Staging"), ("none", "control", ""), ("over", "control", "models:/m/Production"),
        ("paused", "control", "models:/m/Production"),
    ]


def test_split_truncates(spark):
    assert spark.range(1).select(F.floor(F.lit(0.29) * 100)).first()[0] == 28


def test_rotation(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-01-07', date'2024-01-13')) AS d")
    got = [r[0] for r in days.orderBy("d").select(ids.daily_rotation(F.col("d"))).collect()]
    assert got == ["easy", "medium", "hard", "medium", "expert", "hard", "easy"]


@pytest.mark.parametrize("value", [1.125, 1.535, 1.545, 0.25, 0.35, 2.5, 0.045, 1.005, 7.0, 0.615])
def test_fixed_digits(spark, value):
    row = spark.range(1).select(text.fixed(F.lit(value), 2), text.fixed(F.lit(value), 1)).first()
    assert tuple(row) == (f"{value:.2f}", f"{value:.1f}")


def test_difficulty_from_score(spark):
    got = {
        v: spark.range(1).select(scoring.difficulty_from_score(F.lit(v)).alias("r")).first()["r"]["difficulty"]
        for v in (-1.0, 0.5, 1.5, 2.6, 9.0)
    }
    assert got == {-1.0: "super_easy", 0.5: "super_easy", 1.5: "medium", 2.6: "hard", 9.0: "extreme"}


def test_flatten_grid(spark):
    frame = spark.createDataFrame([([[{"value": 3}, {"value": None}], [{"value": 0}, {"value": 9}]],)], "g array<array<struct<value:int>>>")
    assert frame.select(text.flatten_grid(F.col("g"))).first()[0] == [3, 0, 0, 9]
    plain = spark.createDataFrame([([[1, 2], [3, None]],)], "g array<array<int>>")
    assert plain.select(text.flatten_grid(F.col("g"), None)).first()[0] == [1, 2, 3, 0]


def test_service_log(spark):
    frame = spark.createDataFrame(
        [("game-service", '{"level":"info","message":"ok","requestId":"r1","status":"200","durationMs":12.5}'),
         ("ml-service", "WARNING model is slow"), ("multiplayer", '{"level":"error","msg":"gone","room_id":"x"}'),
         ("airflow-worker", "[2024-01-01] {dag.py:3} INFO - done"), ("other", "text")],
        "service string, line string",
    )
    got = {r["service"]: r["p"] for r in frame.select("service", text.parse_service_log(F.col("service"), F.col("line")).alias("p")).collect()}
    assert (got["game-service"]["message"], got["game-service"]["duration_ms"]) == ("ok", 12.5)
    assert (got["ml-service"]["level"], got["ml-service"]["message"]) == ("WARNING", "model is slow")
    assert (got["multiplayer"]["room"], got["airflow-worker"]["ts"]) == ("x", "2024-01-01")
    assert got["airflow-worker"]["message"] == "done" and got["other"]["level"] is None


def test_reconnect(spark, rows):
    gone = spark.createDataFrame([("r", "a", ts("2026-01-01 00:00:10")), ("r", "b", ts("2026-01-01 00:00:10"))], "room_id string, user_id string, ts timestamp")
    back = spark.createDataFrame([("r", "a", ts("2026-01-01 00:00:40")), ("r", "b", ts("2026-01-01 00:00:41"))], gone.schema)
    rooms = spark.createDataFrame([("r", "a", "b")], "room_id string, player_a string, player_b string")
    got = rows(joins.reconnect_or_forfeit(gone, back, rooms), "user_id", "outcome", "winner_id")
    assert got == [("a", "reconnected", None), ("b", "forfeited", "a")]


def test_suite_raises_once(spark):
    frame = spark.createDataFrame([(None, -1), ("x", 2)], "k string, v int")
    report = quality.run_suite([quality.expect_not_null(frame, "k"), quality.expect_non_negative(frame, "v")])
    with pytest.raises(quality.QualityError, match="2 check"):
        quality.raise_on_failure(report)
    quality.raise_on_failure(quality.run_suite([quality.expect_not_null(frame, "v")]))


def test_registry(spark):
    log = [
        ("m", "1", "register", None, 1), ("m", "2", "register", None, 2), ("m", "2", "promote", "production", 3),
        ("m", "2", "promote", "staging", 4), ("m", "3", "register", None, 5), ("m", "3", "promote", "production", 6),
    ]
    frame = spark.createDataFrame(
        [(n, v, a, t, ts(f"2026-01-0{i} 00:00:00"), i) for n, v, a, t, i in log],
        "name string, version string, action string, target_stage string, ts timestamp, event_id long",
    )
    got = {r["version"]: (r["stage"], r["is_production"]) for r in ex.registry_promote(frame).collect()}
    assert got == {"1": ("archived", False), "2": ("archived", False), "3": ("production", True)}


def test_histogram_edges(spark):
    buckets = spark.createDataFrame(
        [("a", 1.0, 50), ("a", 2.0, 90), ("a", float("inf"), 100), ("b", 1.0, 0), ("b", float("inf"), 10)],
        "service string, le double, count long",
    )
    got = {r["service"]: r["value"] for r in metrics.histogram_quantile(buckets, 0.99, ["service"]).collect()}
    assert got == {"a": 2.0, "b": 1.0}
    half = {r["service"]: r["value"] for r in metrics.histogram_quantile(buckets, 0.5, ["service"]).collect()}
    assert half["a"] == 1.0

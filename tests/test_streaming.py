"""Streams from files: parsing, duplicates, late rows, windows and state, against batch."""

import datetime as dt
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from playmetry.operators import joins
from playmetry.sources import events as ev
from playmetry.streaming import enrich, stateful, windows

BASE = dt.datetime(2026, 1, 1)


class Feed:
    """A folder of JSON files read one file per batch, in order of writing."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.schema, self.n = spark, tmp_path / "in", schema, 0
        self.path.mkdir(parents=True)

    def add(self, rows):
        file = self.path / f"{self.n:04d}.json"
        file.write_text("".join(json.dumps(r, default=str) + "\n" for r in rows))
        os.utime(file, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.path))


@pytest.fixture()
def text_folder(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    session = {"session_id": "s1", "user_id": "u", "time_elapsed_ms": 3000, "cells_filled": 50, "difficulty": "hard", "completed_at": "2026-01-01T10:00:00Z"}
    (folder / "a.txt").write_text("\n".join([json.dumps(session), "{broken", json.dumps({"session_id": "s2", "user_id": "v"})]) + "\n")
    return folder


def collect(df, tmp_path, name, mode="append"):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    return df.sparkSession.table(name).collect()


def test_enriched_stream(spark, text_folder, tmp_path):
    raw = ev.event_file_stream(spark, str(text_folder), "game.session.completed")
    got = {r["session_id"]: r for r in collect(enrich.enrich_sessions_stream(raw), tmp_path, "enriched")}
    assert set(got) == {"s1", "s2"}
    assert got["s1"]["is_anomalous"] and got["s2"]["is_anomalous"] is False
    assert got["s1"]["completed_at"] == dt.datetime(2026, 1, 1, 10) and got["s1"]["enriched_at"] is not None


def test_bad_events(spark, text_folder, tmp_path):
    raw = ev.event_file_stream(spark, str(text_folder), "x")
    assert [r["value"] for r in collect(enrich.bad_events(raw), tmp_path, "bad")] == ["{broken"]


def test_matches_stream_to_partitions(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    rows = [{"match_id": f"m{i}", "winner_id": "a", "loser_id": "b", "completed_at": f"2026-01-0{i}T23:59:00Z"} for i in (1, 2)]
    (folder / "a.txt").write_text("\n".join(map(json.dumps, rows)) + "\n")
    for _ in range(2):  # the second start finds nothing new
        stream = enrich.matches_stream(ev.event_file_stream(spark, str(folder), "m"))
        ev.event_stream_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "completed_at").awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 2 and stored.select("event_date").distinct().count() == 2


def test_client_batches(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    batch = {"user_id": "u", "device_id": "d", "events": [{"name": "open", "properties": {"a": "1"}, "timestamp": "2026-01-01T00:00:00Z"}, {"name": "close"}]}
    (folder / "a.txt").write_text(json.dumps(batch) + "\n")
    got = collect(enrich.explode_client_batches(ev.event_file_stream(spark, str(folder), "c")), tmp_path, "client")
    assert sorted(r["name"] for r in got) == ["close", "open"]
    assert {r["name"]: r["properties"] for r in got}["open"] == {"a": "1"}


def test_dedup(spark, tmp_path):
    feed = Feed(spark, tmp_path, "id string, ts timestamp")
    feed.add([{"id": "a", "ts": "2026-01-01T00:00:00Z"}, {"id": "a", "ts": "2026-01-01T00:00:00Z"}])
    feed.add([{"id": "a", "ts": "2026-01-01T00:05:00Z"}, {"id": "b", "ts": "2026-01-01T00:06:00Z"}])
    got = collect(enrich.dedup_events(feed.stream(), "id", "ts"), tmp_path, "dedup")
    assert sorted(r["id"] for r in got) == ["a", "b"]


def _events(n=200, seed=1):
    rng = random.Random(seed)
    rows, t = [], BASE
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([3, 40, 400, 1799, 1800, 4000]))
        rows.append(
            {"id": i, "user_id": rng.randrange(3), "ts": t.isoformat() + "Z", "failed": rng.random() < 0.3, "difficulty": rng.choice(["easy", "hard"]),
             "service": rng.choice("ab"), "latency_ms": rng.uniform(1, 900), "predicted": rng.choice(["x", "y"])}
        )
    return rows


SCHEMA = "id long, user_id long, ts timestamp, failed boolean, difficulty string, service string, latency_ms double, predicted string"


@pytest.fixture()
def feed(spark, tmp_path):
    f = Feed(spark, tmp_path, SCHEMA)
    rows = _events()
    for i in range(0, len(rows), 50):
        f.add(rows[i : i + 50])
    # Far later, so every earlier window is finished.
    f.add([{**rows[0], "id": -1, "user_id": 99, "service": "z", "ts": "2027-01-01T00:00:00Z"}])
    return f


def finished(df, column):
    return df.where(F.col(column) < "2026-12-01")


@pytest.mark.parametrize("name", ["games", "errors", "sessions"])
def test_windows_equal_batch(spark, feed, tmp_path, name):
    make = {
        "games": lambda df: windows.games_per_hour(df, "ts"),
        "errors": lambda df: windows.error_rate(df, by=["service"]),
        "sessions": windows.client_sessions,
    }[name]
    column = {"games": "hour", "errors": "window_start", "sessions": "started_at"}[name]
    collect(make(feed.stream().withWatermark("ts", "10 minutes")), tmp_path, f"w_{name}")
    batch = make(spark.read.schema(SCHEMA).json(str(feed.path)))
    stream = spark.table(f"w_{name}").select(*batch.columns)
    want = sorted(map(tuple, finished(batch, column).collect()))
    assert want and sorted(map(tuple, finished(stream, column).collect())) == want


def test_latency_stream(spark, feed, tmp_path):
    """Sketched quantiles lie within the stated error of the ranks; requests are exact."""
    got = {(r.window_end, r.service): r for r in collect(windows.latency_quantiles(feed.stream().withWatermark("ts", "10 minutes"), "10 days", "1 day"), tmp_path, "latency")}
    log = spark.read.schema(SCHEMA).json(str(feed.path))
    want = finished(windows.latency_quantiles(log, "10 days", "1 day"), "window_end").collect()
    assert want and {(r.window_end, r.service) for r in want} <= set(got)
    for r in want:
        values = sorted(v[0] for v in log.where((F.col("service") == r.service) & (F.col("ts") < r.window_end) & (F.col("ts") >= r.window_end - dt.timedelta(days=10))).select("latency_ms").collect())
        mine = got[(r.window_end, r.service)]
        assert mine.requests == r.requests == len(values)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert abs(values.index(mine[name]) + 1 - p * len(values)) <= 1 + windows.SKETCH_ERROR * len(values)


def test_sketch_error_on_many_rows(spark):
    log = spark.range(200_000).selectExpr("timestamp_seconds(1767225600 + id % 3600) ts", "'a' service", "cast(pmod(xxhash64(id), 1000003) as double) latency_ms")
    exact = {r.window_end: r for r in windows.latency_quantiles(log).collect()}
    panes = windows.latency_panes(log)
    assert panes.count() == 60  # one sketch a minute, where windows overlap five times
    values = sorted(r[0] for r in log.select("latency_ms").collect())
    for r in windows.latency_of_panes(panes).collect():
        assert r.requests == exact[r.window_end].requests
        for name in ("p50", "p95", "p99"):
            apart = np.searchsorted(values, r[name]) - np.searchsorted(values, exact[r.window_end][name])
            assert abs(apart) <= 0.01 * len(values)


def test_dau_stream(spark, feed, tmp_path):
    got = collect(windows.dau_stream(feed.stream()), tmp_path, "dau")
    batch = {r["day"]: r["users"] for r in windows.dau_stream(spark.read.schema(SCHEMA).json(str(feed.path))).collect()}
    assert got and all(batch[r["day"]] == r["users"] for r in got)


def test_late_rows_are_left_out(spark, tmp_path):
    feed = Feed(spark, tmp_path, SCHEMA)
    base = _events(1)[0]
    feed.add([{**base, "ts": "2026-01-01T00:30:00Z"}])
    feed.add([{**base, "ts": "2026-01-03T00:30:00Z"}])
    feed.add([{**base, "ts": "2026-01-03T00:40:00Z"}])  # rows are late against the batch before
    feed.add([{**base, "ts": "2026-01-01T00:40:00Z"}])
    feed.add([{**base, "ts": "2026-01-05T00:30:00Z"}])
    got = collect(windows.games_per_hour(feed.stream().withWatermark("ts", "1 day"), "ts"), tmp_path, "late")
    assert {r["hour"]: r["games"] for r in got}[dt.datetime(2026, 1, 1)] == 1


def test_drift_stream(spark, feed, tmp_path):
    reference = spark.createDataFrame([("x", 0.5), ("y", 0.3), ("w", 0.2)], "class string, share double")
    seen = []
    query = windows.drift_stream(feed.stream(), reference, lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck"), "1 day")
    query.awaitTermination(180)
    batch = windows.psi_per_window(windows.class_counts(spark.read.schema(SCHEMA).json(str(feed.path)), "1 day"), reference)
    want = {r["window_start"]: r["psi"] for r in batch.collect()}
    assert seen and all(want[r["window_start"]] == pytest.approx(r["psi"]) for r in seen)


def plays_of(hours):
    return [BASE + dt.timedelta(hours=h) for h in hours]


def fold(spark, times, **kw):
    frame = spark.createDataFrame([(1, t) for t in times], "user_id long, ts timestamp")
    return stateful.streaks_stateful(frame, **kw).first()


@pytest.mark.parametrize(
    ("hours", "streak", "freeze", "breaks"),
    [
        ([10], 1, 0, 0),
        ([10, 12], 1, 1, 0),
        ([10, 34], 2, 1, 0),
        ([10, 34.9], 2, 1, 0),
        ([8, 46], 2, 1, 0),
        ([10, 58], 2, 0, 0),
        ([10, 58, 106], 1, 0, 1),
        ([10, 34, 58, 82, 106, 130, 154], 7, 1, 0),
    ],
)
def test_streak_transitions(spark, hours, streak, freeze, breaks):
    row = fold(spark, plays_of(hours))
    assert (row["current_streak"], row["freeze_count"], row["breaks"]) == (streak, freeze, breaks)


def test_streak_without_initial_freeze(spark):
    row = fold(spark, plays_of([10, 58]), initial_freeze=False)
    assert (row["current_streak"], row["breaks"]) == (1, 1)


def test_weekly_grant_and_milestones(spark):
    row = fold(spark, plays_of([10 + 24 * i for i in range(31)]))
    assert row["milestones"] == "7,30" and row["current_streak"] == 31


@pytest.mark.parametrize("rows_in_batch", [10_000, 7])
def test_streak_fold_equals_transitions(spark, rows_in_batch):
    rng = random.Random(11)
    rows = []
    for user in range(5):
        t = BASE
        for _ in range(60):
            t += dt.timedelta(hours=rng.choice([0.5, 5, 22.9, 23, 24, 25, 25.1, 30, 49]))
            rows.append((user, t))
    frame = spark.createDataFrame(rows, "user_id long, ts timestamp")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(setting)
    spark.conf.set(setting, rows_in_batch)
    folded = stateful.streaks_stateful(frame)
    got = {r["user_id"]: r for r in folded.collect()}
    spark.conf.set(setting, held)
    plan = folded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and len(got) == 5
    for user, g in got.items():
        state = None
        for r in sorted(frame.where(F.col("user_id") == user).select(F.unix_millis("ts")).collect()):
            state = stateful.streak_transition(state, r[0])
        assert (g["current_streak"], g["longest_streak"], g["freeze_count"], g["breaks"], g["freezes_used"]) == (
            state[0], state[1], state[3], state[6], state[7],
        )
        assert g["milestones"] == ",".join(map(str, state[5]))


def test_reconnect_stream(spark, tmp_path):
    gone, back = Feed(spark, tmp_path / "a", SCHEMA2), Feed(spark, tmp_path / "b", SCHEMA2)
    for feed, secs in ((gone, 10), (back, 40)):
        feed.add([{"room_id": "r", "user_id": "a", "ts": (BASE + dt.timedelta(seconds=secs)).isoformat() + "Z"}])
    gone.add([{"room_id": "r", "user_id": "b", "ts": (BASE + dt.timedelta(seconds=20)).isoformat() + "Z"}])
    back.add([{"room_id": "r", "user_id": "b", "ts": (BASE + dt.timedelta(seconds=51)).isoformat() + "Z"}])
    for feed in (gone, back):
        for hour in (1, 2):
            feed.add([{"room_id": "z", "user_id": "z", "ts": (BASE + dt.timedelta(hours=hour)).isoformat() + "Z"}])
    got = collect(stateful.reconnect_stream(gone.stream(), back.stream()), tmp_path, "reconnect")
    outcome = {r["user_id"]: r["back_at"] for r in got}
    rooms = spark.createDataFrame([("r", "a", "b"), ("z", "z", "y")], "room_id string, player_a string, player_b string")
    batch = joins.reconnect_or_forfeit(
        spark.read.schema(SCHEMA2).json(str(gone.path)), spark.read.schema(SCHEMA2).json(str(back.path)), rooms
    )
    want = {r["user_id"]: r["back_at"] for r in batch.collect() if r["user_id"] != "z"}
    assert want == {"a": BASE + dt.timedelta(seconds=40), "b": None}
    assert {u: outcome[u] for u in want} == want


SCHEMA2 = "room_id string, user_id string, ts timestamp"


def test_latency_quantiles_count_requests_without_a_latency(spark):
    rows = [("2024-01-01 00:00:10", "a", 5.0), ("2024-01-01 00:00:20", "a", None), ("2024-01-01 00:00:30", "a", 9.0), ("2024-01-01 00:00:40", "b", None)]
    log = spark.createDataFrame(rows, "t string, service string, latency_ms double").selectExpr("timestamp(t) ts", "service", "latency_ms")
    got = windows.latency_quantiles(log, "5 minutes", "5 minutes").collect()
    assert sorted((r.service, r.requests, r.p50, r.p95, r.p99) for r in got) == [("a", 3, 5.0, 9.0, 9.0), ("b", 1, None, None, None)]

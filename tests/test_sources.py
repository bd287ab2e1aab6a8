"""Files: readers, rerun-safe writers, late data, retention."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from playmetry.operators import metrics, privacy, warehouse
from playmetry.sources import events as ev
from playmetry.sources import tables as tb

MATCH = {
    "match_id": "m1", "room_id": "r1", "winner_id": "u1", "loser_id": "u2", "winner_elo_before": 1200,
    "winner_elo_after": 1216, "loser_elo_before": 1200, "loser_elo_after": 1184, "elo_delta": 16, "difficulty": "medium",
    "end_reason": "completed", "duration_ms": 1000, "completed_at": "2026-03-13T11:00:00Z", "extra": 1,
}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "matches").mkdir()
    lines = [json.dumps(MATCH), "", "{not json", json.dumps({"match_id": "m2", "room_id": "r"}), json.dumps(MATCH)]
    (tmp_path / "matches" / "2026-03-13.jsonl").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_read_jsonl(spark, folder):
    good = ev.read_event_jsonl(spark, str(folder), "matches", "2026-03-13")
    assert good.count() == 3
    both = ev.read_event_jsonl(spark, str(folder), "matches", "2026-03-13", keep_corrupt=True).cache()
    assert tuple(ev.corrupt_count(both).first()) == (3, 1)
    absent = ev.read_event_jsonl(spark, str(folder), "matches", "2026-03-14")
    assert absent.count() == 0 and "match_id" in absent.columns


def test_projection_and_double_load(spark, folder):
    typed = ev.project_match_events(ev.read_event_jsonl(spark, str(folder), "matches", "2026-03-13"))
    assert typed.count() == 2 and dict(typed.dtypes)["completed_at"] == "timestamp"
    first = tb.insert_ignore(typed, typed.limit(0), ["match_id"], [F.col("completed_at")])
    assert first.count() == 1
    assert tb.insert_ignore(typed, first, ["match_id"], [F.col("completed_at")]).count() == 0


def test_project_sessions_tolerates_missing(spark):
    frame = spark.createDataFrame([("s", "u", "bad time")], "session_id string, user_id string, completed_at string")
    row = ev.project_session_events(frame).first()
    assert row["completed_at"] is None and row["score"] is None


def test_overwrite_partition_rerun(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "d string, v int").withColumn("d", F.to_date("d"))
    tb.overwrite_partition(frame, path, "d")
    tb.overwrite_partition(frame, path, "d")
    assert spark.read.parquet(path).count() == 2
    tb.overwrite_partition(frame.where("v = 2").withColumn("v", F.lit(5)), path, "d")
    assert rows(spark.read.parquet(path), "v") == [(1,), (5,)]


def test_late_events_touch_their_own_day(spark, tmp_path, rows):
    path = str(tmp_path / "events")
    schema = "id long, ts timestamp"
    day1 = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 10)), (2, dt.datetime(2026, 1, 2, 9))], schema)
    tb.overwrite_partition(day1.withColumn("d", F.to_date("ts")), path, "d")
    late = spark.createDataFrame([(3, dt.datetime(2026, 1, 1, 23, 59)), (1, dt.datetime(2026, 1, 1, 10))], schema)
    dates = tb.recompute_dates(late, "ts")
    assert rows(dates) == [(dt.date(2026, 1, 1),)]
    stored = spark.read.parquet(path)
    touched = stored.join(dates.withColumnRenamed("date", "d"), "d", "left_semi").select("id", "ts")
    merged = tb.upsert_replace(late, touched, ["id"], [F.col("ts")])
    tb.overwrite_partition(spark.createDataFrame(merged.collect(), schema).withColumn("d", F.to_date("ts")), path, "d")
    assert rows(spark.read.parquet(path), "id") == [(1,), (2,), (3,)]


def test_id_list(spark, tmp_path, rows):
    (tmp_path / "ids.txt").write_text("# header\n\n u1 \nu2\n  # note\n")
    assert rows(ev.read_id_list(spark, str(tmp_path / "ids.txt"))) == [("u1",), ("u2",)]


def test_expired_files(spark, tmp_path):
    for name in ("2026-01-01.jsonl", "2026-02-01.jsonl", "notes.jsonl", "2026-13-45.jsonl"):
        (tmp_path / name).write_text("{}\n")
    got = ev.expire_event_partitions(spark, str(tmp_path), "2026-01-15").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["2026-01-01.jsonl"]


def test_dim_date(spark):
    frame = tb.build_dim_date(spark)
    assert frame.count() == 2557
    row = frame.where("date_key = 20241230").first()
    assert (row["week_of_year"], row["day_of_week"], row["is_weekend"], row["day_name"], row["month_name"]) == (1, 0, False, "Monday", "December")
    assert tb.build_dim_difficulty(spark).count() == 6


def test_filter_reaches_the_scan(spark, sf):
    plan = ev.incremental_extract(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderdate", "2000-01-01")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text


def test_fact_load_counts(spark):
    schema = "id int, user_id int, puzzle_id int, difficulty string, started_at timestamp, completed_at timestamp, status string, time_elapsed_ms int, errors_count int, hints_used int, score int"
    data = [(1, 1, None, None, dt.datetime(2026, 1, 1), None, None, 5, None, None, 1), (2, 1, 3, "easy", None, None, "completed", 5, 0, 0, 1)]
    frame = spark.createDataFrame(data, schema)
    added, counts = warehouse.load_fact_sessions(frame, None, b"k")
    row = added.first()
    assert tuple(counts.first()) == (1, 0, 1)
    assert (row["difficulty_key"], row["status"], row["errors_count"], row["puzzle_hash"]) == ("medium", "completed", 0, None)
    again, counts = warehouse.load_fact_sessions(frame, added, b"k")
    assert again.count() == 0 and tuple(counts.first()) == (0, 1, 1)


def test_erasure(spark, rows):
    tables = {
        "users": spark.createDataFrame([("a",), ("b",)], "id string"),
        "friendships": spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "requester_id string, addressee_id string"),
        "other": spark.createDataFrame([("a",)], "user_id string"),
    }
    wanted = spark.createDataFrame([("a",), ("a",)], "id string")
    rest = {t for t, _ in privacy.SOURCE_TARGETS + privacy.WAREHOUSE_TARGETS} - set(tables)
    with pytest.raises(ValueError, match="streaks.user_id"):
        privacy.erase_users(tables, wanted, b"k", absent=rest - {"streaks"})
    plan = rows(privacy.erasure_dry_run(tables, wanted, b"k", rest))
    assert plan == [("friendships", "addressee_id", 0), ("friendships", "requester_id", 1), ("users", "id", 1)]
    kept = privacy.erase_users(tables, wanted, b"k", rest)
    assert rows(kept["friendships"]) == [("b", "c"), ("c", "d")] and rows(kept["users"]) == [("b",)]
    assert kept["other"].count() == 1
    audit = privacy.erasure_audit(wanted, "2026-01-01", "2026-01-02", b"k")
    assert audit.count() == 1 and len(audit.first()["user_hash"]) == 64
    assert rows(privacy.resync_guard(tables["users"], audit, b"k", "id")) == [("b",)]


def test_erasure_write(spark, rows, tmp_path):
    """A date of erased users alone goes, one with others keeps these, the rest is not touched."""
    path = str(tmp_path / "sessions")
    data = [("u1", "2026-01-01"), ("u1", "2026-01-02"), ("u2", "2026-01-02"), ("u2", "2026-01-03"), ("u1", None), ("u2", None)]
    spark.createDataFrame(data, "user_id string, day string").write.partitionBy("day").parquet(path)
    before = spark.read.parquet(path)
    rest = {t for t, _ in privacy.SOURCE_TARGETS + privacy.WAREHOUSE_TARGETS} - {"game_sessions"}
    kept = privacy.erase_users({"game_sessions": before}, spark.createDataFrame([("u1",)], "id string"), b"k", rest)["game_sessions"]
    privacy.rewrite_erased(before, kept, path, "day")
    assert rows(spark.read.parquet(path).selectExpr("user_id", "string(day)")) == [("u2", "2026-01-02"), ("u2", "2026-01-03"), ("u2", None)]
    assert not (tmp_path / "sessions" / "day=2026-01-01").exists() and len(list(tmp_path.iterdir())) == 1


def test_erasure_write_after_a_crash(spark, rows, tmp_path, monkeypatch):
    """A crash between the overwrite and the removal of an emptied date: running again completes it."""
    path = str(tmp_path / "sessions")
    data = [("u1", "2026-01-01"), ("u1", "2026-01-02"), ("u2", "2026-01-02")]
    spark.createDataFrame(data, "user_id string, day string").write.partitionBy("day").parquet(path)
    rest = {t for t, _ in privacy.SOURCE_TARGETS + privacy.WAREHOUSE_TARGETS} - {"game_sessions"}

    def erase():
        before = spark.read.parquet(path)
        kept = privacy.erase_users({"game_sessions": before}, spark.createDataFrame([("u1",)], "id string"), b"k", rest)["game_sessions"]
        privacy.rewrite_erased(before, kept, path, "day")

    monkeypatch.setattr(privacy, "_remove", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        erase()
    monkeypatch.undo()
    assert rows(spark.read.parquet(path).where("user_id = 'u1'").selectExpr("string(day)")) == [("2026-01-01",)]
    erase()
    assert rows(spark.read.parquet(path).selectExpr("user_id", "string(day)")) == [("u2", "2026-01-02")]


def test_retention_keys(spark, rows):
    facts = spark.createDataFrame([(20260101,), (20260301,), (None,)], "date_key int")
    kept = privacy.retention_apply({"fact_match": (facts, "date_key")}, {"fact_match": 30}, "2026-03-10")["fact_match"]
    assert rows(kept) == [(20260301,), (None,)]
    assert metrics.retention_purge_plan({"fact_match": (facts, "date_key")}, {"fact_match": 30}, "2026-03-10").first()["n_expired"] == 1


def test_retention(spark, rows):
    frame = spark.createDataFrame([("2026-01-01",), ("2026-03-01",), (None,)], "d string").withColumn("d", F.to_date("d"))
    kept = privacy.retention_apply({"t": (frame, "d")}, {"t": 30}, "2026-03-10")["t"]
    plan = metrics.retention_purge_plan({"t": (frame, "d")}, {"t": 30}, "2026-03-10").first()
    assert kept.count() == plan["n_kept"] == 2 and plan["n_expired"] == 1

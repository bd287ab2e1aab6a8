"""Tables written more than once: late and repeated batches, upserts by bucket, counts of a load."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F
from test_streaming import Feed

from playmetry.operators import experiments, learning, warehouse
from playmetry.sources.stores import DailyTable, KeyedTable, append_counted

KEY = b"k"
EVENTS = "id long, v string, ts timestamp"


def event(i, day, v="a"):
    return {"id": i, "v": v, "ts": f"2026-01-0{day}T{i % 24:02d}:00:00Z"}


def frame(spark, rows):
    return spark.createDataFrame([(r["id"], r["v"], r["ts"]) for r in rows], "id long, v string, t string").selectExpr("id", "v", "timestamp(t) ts")


def stored(table, spark):
    return sorted(map(tuple, table.read(spark).collect()))


def test_late_and_repeated_batches(spark, tmp_path):
    table, clean = (DailyTable(str(tmp_path / n), EVENTS, ["id"], "ts") for n in ("many", "one"))
    first = [event(i, 1 + i % 3) for i in range(30)]
    late = [event(100, 1), event(101, 2), event(3, 1), event(5, 3)]  # a day late, and two copies
    table.apply(frame(spark, first), 0)
    names = {f for f in glob.glob(f"{tmp_path}/many/table/event_date=2026-01-03/*.parquet")}
    table.apply(frame(spark, first), 0)  # delivered again: nothing happens
    assert names == {f for f in glob.glob(f"{tmp_path}/many/table/event_date=2026-01-03/*.parquet")}
    table.apply(frame(spark, late[:2]), 1)
    assert names == {f for f in glob.glob(f"{tmp_path}/many/table/event_date=2026-01-03/*.parquet")}  # untouched date
    table.apply(frame(spark, late[2:]), 2)
    clean.apply(frame(spark, first + late), 0)
    assert stored(table, spark) == stored(clean, spark) and len(stored(table, spark)) == 32


def test_a_crash_before_the_mark(spark, tmp_path, monkeypatch):
    table, clean = (DailyTable(str(tmp_path / n), EVENTS, ["id"], "ts") for n in ("many", "one"))
    rows = [event(i, 1 + i % 2) for i in range(10)]
    table.apply(frame(spark, rows[:5]), 0)
    monkeypatch.setattr("playmetry.sources.stores.overwrite_partition", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.apply(frame(spark, rows[5:]), 1)
    monkeypatch.undo()
    table.apply(frame(spark, rows[5:]), 1)
    clean.apply(frame(spark, rows), 0)
    assert stored(table, spark) == stored(clean, spark)
    table.apply(frame(spark, []), 2)
    assert stored(table, spark) == stored(clean, spark)


def test_stream_of_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    rows = [event(i, 1 + i % 3) for i in range(12)]
    feed.add(rows[:6])
    feed.add(rows[6:] + rows[:2] + [{"id": 50, "v": "x", "ts": None}])
    table = DailyTable(str(tmp_path / "t"), EVENTS, ["id"], "ts")
    for _ in range(2):
        query = table.stream(feed.stream(), str(tmp_path / "ck"))
        query.awaitTermination(120)
        assert query.exception() is None
    assert [r[0] for r in stored(table, spark)] == list(range(12))


def test_upsert_leaves_other_buckets(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "k"), "id long, v string", ["id"], 64)
    assert table.read(spark).count() == 0
    assert len(table.upsert(spark.range(2000).select("id", F.lit("old").alias("v")), [F.col("v")])) == 64
    files = set(glob.glob(f"{tmp_path}/k/key_bucket=*/*.parquet"))
    new = spark.createDataFrame([(i, v) for i in range(0, 40, 2) for v in ("b", "a")] + [(9000, "new")], "id long, v string")
    touched = table.upsert(new, [F.col("v")])
    after = set(glob.glob(f"{tmp_path}/k/key_bucket=*/*.parquet"))
    assert 0 < len(touched) <= 21
    assert {f for f in files if int(f.split("key_bucket=")[1].split("/")[0]) not in touched} == files & after
    got = dict(map(tuple, table.read(spark).collect()))
    assert len(got) == 2001 and got[9000] == "new" and got[2] == "a" and got[3] == "old"
    assert table.upsert(new, [F.col("v")]) == touched and dict(map(tuple, table.read(spark).collect())) == got
    assert table.upsert(new.limit(0), [F.col("v")]) == []


def test_upsert_of_users(spark, tmp_path):
    users = spark.createDataFrame([(1, 2, "2024-01-05", None), (2, 1, "2024-01-06", False)], "id long, skill_cluster int, t string, is_active boolean")
    users = users.selectExpr("id", "skill_cluster", "timestamp(t) created_at", "is_active")
    whole = warehouse.load_dim_user(users, None, KEY)
    fields = ", ".join(f"{n} {t}" for n, t in whole.dtypes)
    table = KeyedTable(str(tmp_path / "u"), fields, ["user_hash"], 8)
    warehouse.upsert_dim_user(users, table, KEY)
    warehouse.upsert_dim_user(users.where("id = 2"), table, KEY)
    assert sorted(map(tuple, table.read(spark).collect())) == sorted(map(tuple, whole.collect()))


def _plans(spark):
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [listed.apply(i).physicalPlanDescription() for i in range(listed.size())]


def test_counts_come_from_the_write(spark, tmp_path):
    rows = [(i, f"u{i % 5}", None if i % 9 == 0 else f"2024-01-{1 + i % 28:02d}") for i in range(200)] + [(4, "u4", "2024-01-01")] * 50 + [(None, "u", "2024-01-02")] * 2
    made = spark.createDataFrame(rows, "id long, user_id string, t string").selectExpr(
        "id", "user_id", "id % 7 puzzle_id", "'hard' difficulty", "timestamp(t) started_at", "timestamp(t) completed_at", "'completed' status", "1L time_elapsed_ms", "0 errors_count", "0 hints_used", "5 score"
    )
    made.write.parquet(str(tmp_path / "in"))
    sessions = spark.read.parquet(str(tmp_path / "in"))
    old = warehouse.fact_session_rows(sessions.where("id < 20 and started_at is not null"), KEY).dropDuplicates(["session_hash"])
    old.write.parquet(str(tmp_path / "old"))
    old = spark.read.parquet(str(tmp_path / "old"))
    for known in (None, old):
        added, counts = warehouse.load_fact_sessions(sessions, known, KEY)
        want = counts.first().asDict()
        before = len(_plans(spark))
        out = str(tmp_path / f"out-{known is None}")
        got = warehouse.append_fact_sessions(sessions, known, KEY, lambda df, out=out: df.write.parquet(out))
        plans = _plans(spark)[before:]
        assert got == want and got["inserted"] == spark.read.parquet(out).count() == added.count() and got["skipped"] == 23
        reads = [p.count(f"{tmp_path}/in]") for p in plans]
        assert sum(reads) == 1, reads
    none = append_counted(warehouse.fact_session_rows(sessions.limit(0), KEY), None, "session_hash", "date_key", "started_at", lambda df: df.write.parquet(str(tmp_path / "none")))
    assert none == {"inserted": 0, "duplicates": 0, "skipped": 0}


def _snapshots(spark, rows):
    return spark.createDataFrame([(e, "user", g, f"f{n}", t, 1) for n, (e, g, t) in enumerate(rows)], "entity_id string, entity_type string, feature_group string, features string, t string, row_count int").selectExpr(
        "entity_id", "entity_type", "feature_group", "features", "timestamp(t) computed_at", "row_count"
    )


def test_feature_log_is_append_only(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(f"e{rng.randrange(40)}", "g", f"2024-01-{day:02d} {rng.randrange(24):02d}:{n % 60:02d}:00") for n in range(size)] for day, size in ((1, 60), (2, 4), (3, 1))]
    schema = "id string, entity_id string, entity_type string, feature_group string, feature_version int, features string, is_current boolean, pipeline_name string, computed_at timestamp"
    store, log = spark.createDataFrame([], schema), spark.createDataFrame([], schema + ", entry string")
    for n, rows in enumerate(batches):
        new = _snapshots(spark, rows)
        store, lineage = experiments.write_feature_version(new, store, "t", "f", "p")
        before = experiments.feature_view(log)
        current = before.where("is_current").join(new.select("entity_id").distinct(), "entity_id", "left_semi").count()
        added, same = experiments.append_feature_versions(new, log, "t", "f", "p")
        assert added.count() == len(rows) + current <= 2 * len(rows)
        assert sorted(map(tuple, lineage.collect())) == sorted(map(tuple, same.collect()))
        log = log.unionByName(added)
        if n == 1:
            log = log.unionByName(added)  # an append that a retry made twice
        log.write.parquet(str(tmp_path / f"log{n}"))
        log = spark.read.parquet(str(tmp_path / f"log{n}"))
        assert sorted(map(tuple, experiments.feature_view(log).select(*store.columns).collect())) == sorted(map(tuple, store.collect()))


def test_exact_split(spark):
    rows = [(i, c) for c, n in (("a", 1003), ("b", 7), ("c", 2), (None, 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "puzzle_id long, difficulty string").withColumn("x", F.col("puzzle_id") * 2)
    train, test = learning.stratified_split(df, "difficulty", "puzzle_id")
    got = {r["difficulty"]: r["count"] for r in test.groupBy("difficulty").count().collect()}
    assert got == {"a": 201, "b": 1, None: 3}  # round(0.2 n) of 1003, 7, 2 and 13
    assert train.columns == df.columns and train.count() + test.count() == len(rows)
    again = learning.stratified_split(df.repartition(7), "difficulty", "puzzle_id")[1]
    assert sorted(map(str, again.collect())) == sorted(map(str, test.collect()))
    assert train.join(test, ["difficulty", "puzzle_id"]).count() == 0

"""Rules in event order: state processors against batch, out of order, over restarts, by timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_streaming import BASE, Feed

from playmetry.operators import experiments, joins
from playmetry.streaming import ordered, stateful, windows

LATER = "2027-01-01T00:00:00Z"


def at(seconds):
    return (BASE + dt.timedelta(seconds=seconds)).isoformat() + "Z"


def run(df, tmp_path, name, until=None):
    """Runs what the source holds now; the checkpoint goes on where the last run ended."""
    out = str(tmp_path / f"out-{name}")
    query = (
        df.writeStream.format("parquet").option("path", out).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    if query.exception():
        raise query.exception()
    return sorted((tuple(r) for r in df.sparkSession.read.schema(df.schema).parquet(out).collect()), key=str)


QUEUE = "difficulty string, entry_id long, user_id long, ts timestamp, action string"


def queue_rows(n, seed, cancels=0.0):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 5])
        rows.append({"difficulty": rng.choice(["easy", "hard"]), "entry_id": i, "user_id": rng.randrange(6), "ts": at(t), "action": "cancel" if rng.random() < cancels else "join"})
    return rows


def pairs_by_hand(rows):
    waiting, out = [], []  # one list for all difficulties, as players wait in it
    for r in sorted(rows, key=lambda r: (r["ts"], r["entry_id"])):
        if r["action"] == "cancel":
            mine = [w for w in waiting if w["user_id"] == r["user_id"] and w["difficulty"] == r["difficulty"]]
            if mine:
                waiting.remove(mine[0])
            continue
        met = [w for w in waiting if w["difficulty"] == r["difficulty"] and w["user_id"] != r["user_id"]]
        if met:
            waiting.remove(met[0])
            out.append((r["difficulty"], met[0]["entry_id"], met[0]["user_id"], r["entry_id"], r["user_id"]))
        else:
            waiting.append(r)
    return sorted(out, key=str)


@pytest.mark.parametrize("cancels", [0.0, 0.3])
def test_waiting_list(spark, tmp_path, cancels):
    """Ten Arrow batches a key, out of order inside and across micro-batches, with a restart."""
    rows = queue_rows(300, 4, cancels)
    feed = Feed(spark, tmp_path, QUEUE)
    shuffled = rows[:150]
    random.Random(1).shuffle(shuffled)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(setting)
    spark.conf.set(setting, 8)
    try:
        feed.add(shuffled)
        stream = ordered.match_fifo_stream(feed.stream(), delay="1 hour")
        assert run(stream, tmp_path, "fifo") == []  # nothing is past the watermark yet
        feed.add(rows[150:])
        feed.add([{**rows[0], "difficulty": "end", "ts": LATER}])
        got = run(ordered.match_fifo_stream(feed.stream(), delay="1 hour"), tmp_path, "fifo")
    finally:
        spark.conf.set(setting, held)
    assert got == pairs_by_hand(rows)
    assert run(ordered.match_fifo_stream(feed.stream(), delay="1 hour"), tmp_path, "fifo") == got  # a restart adds nothing
    if not cancels:
        joined = spark.read.schema(QUEUE).json(str(feed.path)).where("difficulty != 'end'").withColumnRenamed("ts", "enqueued_at")
        batch = joins.match_fifo(joined, F.date_trunc("minute", "enqueued_at"), chunk_rows=50)
        names = ["difficulty", "first_entry", "first_user", "second_entry", "second_user"]
        if set(names) <= set(batch.columns):
            assert sorted((tuple(r) for r in batch.select(*names).collect()), key=str) == got


def test_waiting_ends_by_a_timer(spark, tmp_path):
    feed = Feed(spark, tmp_path, QUEUE)
    row = {"difficulty": "easy", "entry_id": 1, "user_id": 1, "ts": at(0), "action": "join"}
    feed.add([row, {**row, "difficulty": "hard", "entry_id": 2}])
    feed.add([{**row, "entry_id": 3, "user_id": 2, "ts": at(59)}, {**row, "difficulty": "hard", "entry_id": 4, "user_id": 2, "ts": at(60)}])
    feed.add([{**row, "difficulty": "end", "ts": LATER}])
    got = run(ordered.match_fifo_stream(feed.stream(), wait_secs=60), tmp_path, "wait")
    assert got == [("easy", 1, 1, 3, 2)]


def test_streaks_equal_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user_id long, ts timestamp")
    rng, rows, t = random.Random(3), [], BASE
    for _ in range(90):
        t += dt.timedelta(hours=rng.choice([3, 11, 23, 26]))
        rows.append({"user_id": rng.randrange(2), "ts": t.isoformat() + "Z"})
    for i in range(0, 90, 30):
        part = rows[i : i + 30]
        rng.shuffle(part)
        feed.add(part)
    feed.add([{"user_id": 9, "ts": LATER}])
    got = run(ordered.streaks_stream(feed.stream(), delay="3 days"), tmp_path, "streaks")
    last = {}
    for r in got:
        last[r[0]] = max(last.get(r[0], r), r, key=lambda x: x[3])
    batch = stateful.streaks_stateful(spark.read.schema("user_id long, ts timestamp").json(str(feed.path))).where("user_id < 9")
    want = {b["user_id"]: b for b in batch.collect()}
    assert set(want) == {0, 1} <= set(last)
    for user, b in want.items():
        assert last[user][1:3] + last[user][4:] == (b["current_streak"], b["longest_streak"], b["freeze_count"], b["freezes_used"], b["breaks"], b["milestones"])


EVALUATIONS = "key string, at timestamp, breached boolean"


def evaluations(pattern, key="a"):
    return [{"key": key, "at": at(60 * i), "breached": c == "1"} for i, c in enumerate(pattern) if c != " "]


def test_alerts_equal_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVALUATIONS)
    rows = evaluations("0111110111111111001111110")
    for i in range(0, len(rows), 7):
        feed.add(rows[i : i + 7][::-1])
    feed.add([{"key": "z", "at": LATER, "breached": False}])
    got = run(ordered.sustained_alert_stream(feed.stream(), 60, 300, delay="10 minutes"), tmp_path, "alerts")
    batch = windows.sustained_alert(spark.read.schema(EVALUATIONS).json(str(feed.path)), ["key"], 60, 300)
    want = sorted((r["key"], int(r["since"].timestamp()), int(r["fired_at"].timestamp())) for r in batch.collect())
    assert len(want) == 2 and got == want


def test_alert_by_watermark_alone_and_once(spark, tmp_path):
    """Key a falls silent one step before its hold time ends, b two steps, c is contradicted at its end."""
    feed = Feed(spark, tmp_path, EVALUATIONS)
    feed.add(evaluations("11111") + evaluations("1111", "b") + evaluations("111110", "c"))
    stream = lambda: ordered.sustained_alert_stream(feed.stream(), 60, 300)
    assert run(stream(), tmp_path, "silent") == []
    feed.add([{"key": "z", "at": at(900), "breached": False}])
    start = int(dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    assert run(stream(), tmp_path, "silent") == [("a", start, start + 300)]
    feed.add([{"key": "z", "at": LATER, "breached": False}])
    assert run(stream(), tmp_path, "silent") == [("a", start, start + 300)]  # not again after a restart


PREDICTIONS = "model string, number long, predicted string, ts timestamp"


def test_drift_of_the_last_predictions(spark, tmp_path):
    rng, rows = random.Random(8), []
    for i in range(400):
        rows.append({"model": rng.choice("ab"), "number": i, "predicted": rng.choice("xxxyw") if i < 200 else rng.choice("yyw"), "ts": at(7 * i)})
    reference = spark.createDataFrame([("x", 0.5), ("y", 0.3), ("q", 0.2)], "class string, share double")
    feed = Feed(spark, tmp_path, PREDICTIONS)
    for i in range(0, 400, 100):
        part = rows[i : i + 100]
        rng.shuffle(part)
        feed.add(part)
    feed.add([{"model": "z", "number": 0, "predicted": "x", "ts": LATER}])
    sink, seen = ordered.drift_table(str(tmp_path / "drift")), []

    def twice(result, batch_id):
        seen.append(batch_id)
        sink(result, batch_id)
        sink(result, batch_id)  # a batch that is delivered again

    query = ordered.latest_drift_stream(feed.stream(), reference, twice, str(tmp_path / "ck"), 50, delay="5 minutes")
    query.awaitTermination(300)
    assert query.exception() is None and seen
    got = spark.read.parquet(str(tmp_path / "drift")).where("model != 'z'").collect()
    assert len({(r.model, r.upto_ms) for r in got}) == len(got) > 20
    all_rows = spark.read.schema(PREDICTIONS).json(str(feed.path)).withColumn("ms", F.unix_millis("ts"))
    for r in rng.sample(got, 6) + [max(got, key=lambda r: r.upto_ms)]:
        newest = all_rows.where((F.col("model") == r.model) & (F.col("ms") <= r.upto_ms)).orderBy(F.desc("ms"), F.desc("number")).limit(50)
        shares = newest.groupBy(F.col("predicted").alias("class")).agg((F.count(F.lit(1)) / newest.count()).alias("share"))
        want = experiments.psi_drift(shares, reference).first()
        assert (r.psi, r.drift_detected, r.status) == (want.psi, want.drift_detected, want.status)

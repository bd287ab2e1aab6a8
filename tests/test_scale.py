"""Balanced building blocks against brute force, with one key holding much of the data."""

import datetime as dt
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from playmetry.operators import experiments as ex
from playmetry.operators import joins, ranking, vectors
from playmetry.scale import exact_quantiles, ordered_positions
from playmetry.sources.tables import insert_ignore, upsert_replace
from playmetry.streaming import windows

BASE = dt.datetime(2026, 1, 1)


def skewed(n, keys=6, seed=3):
    rng = random.Random(seed)
    return [0 if rng.random() < 0.4 else rng.randrange(keys) for _ in range(n)]


@pytest.mark.parametrize("fine", [False, True])
def test_positions(spark, fine):
    rng = random.Random(1)
    data = [(k, rng.randrange(50), i) for i, k in enumerate(skewed(400))] + [(None, 3, 1000), (None, 2, 1001)]
    frame = spark.createDataFrame(data, "k int, v int, id int")
    got = ordered_positions(
        frame, ["k"], F.floor(F.col("v") / 10), [F.col("v"), F.col("id")], "pos", fine=F.col("v") % 10 if fine else None
    ).collect()
    assert len(got) == len(data)
    for key in {d[0] for d in data}:
        mine = sorted((r["v"], r["id"], r["pos"]) for r in got if r["k"] == key)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))


def test_positions_without_key(spark):
    frame = spark.range(100).select(F.col("id"), (F.col("id") * 7 % 10).alias("v"))
    got = ordered_positions(frame, [], -F.col("v"), [F.col("id")], "pos", fine=F.floor(F.col("id") / 9)).collect()
    want = sorted(((-r["v"], r["id"]) for r in got))
    assert [(-r["v"], r["id"]) for r in sorted(got, key=lambda r: r["pos"])] == want


@pytest.mark.parametrize("kind", ["mixed", "negative", "ties", "single"])
def test_quantiles(spark, kind):
    rng = random.Random(5)
    values = {
        "mixed": lambda: rng.choice([0.0, rng.uniform(-50, 50), rng.expovariate(0.01)]),
        "negative": lambda: -rng.expovariate(0.1),
        "ties": lambda: float(rng.randrange(3)),
        "single": lambda: 7.5,
    }[kind]
    data = [(k, values()) for k in skewed(300)] + [(None, 1.0), (1, None)]
    frame = spark.createDataFrame(data, "k int, v double")
    probs = {"lo": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "hi": 1.0}
    got = {r["k"]: r for r in exact_quantiles(frame, ["k"], "v", probs).collect()}
    for key in {k for k, v in data if v is not None}:
        mine = [v for k, v in data if k == key and v is not None]
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(mine, p * 100), abs=1e-9), (key, name)


def brute_pairs(rows):
    waiting, out = {}, []
    for difficulty, entry, user, _ in sorted(rows, key=lambda r: (r[3], r[1])):
        queue = waiting.setdefault(difficulty, deque())
        if queue and queue[0][1] != user:
            first = queue.popleft()
            out.append((difficulty, first[0], first[1], entry, user))
        else:
            queue.append((entry, user))
    return sorted(out)


@pytest.mark.parametrize(("users", "chunk"), [(40, 25), (3, 17), (2, 20), (40, 10_000)])
def test_match_fifo(spark, users, chunk):
    rng = random.Random(users)
    hot = lambda: 0 if rng.random() < 0.34 else rng.randrange(users)
    rows = [(rng.choice(["easy", "easy", "hard"]), i, hot(), BASE + dt.timedelta(minutes=rng.randrange(4000))) for i in range(160)]
    frame = spark.createDataFrame(rows, "difficulty string, entry_id long, user_id long, enqueued_at timestamp")
    ran = []
    got = joins.match_fifo(frame, F.date_trunc("hour", "enqueued_at"), chunk_rows=chunk, on_pass=lambda number, chunks: ran.append(chunks))
    assert sorted(tuple(r) for r in got.collect()) == brute_pairs(rows)
    assert sum(ran) <= 2 * ran[0]  # every chunk runs twice at most


def test_match_fifo_nobody_waits(spark):
    rows = [("easy", i, 5, BASE) for i in range(9)]
    frame = spark.createDataFrame(rows, "difficulty string, entry_id long, user_id long, enqueued_at timestamp")
    assert joins.match_fifo(frame, F.date_trunc("hour", "enqueued_at"), chunk_rows=2).count() == 0


def test_rolling_blocks(spark):
    rng = random.Random(9)
    models = skewed(2500, 3)
    rows = [(i, str(m), BASE + dt.timedelta(seconds=i * 60), rng.uniform(1, 900), rng.random(), "a", "a" if i % 3 else None) for i, m in enumerate(models)]
    frame = spark.createDataFrame(
        rows, "prediction_id long, model string, ts timestamp, latency_ms double, confidence double, predicted string, actual string"
    )
    got = ranking.rolling_model_metrics(frame, F.date_trunc("hour", "ts"), 30).collect()
    assert len(got) == len(rows)
    for model in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == model]
        place = {r[0]: i for i, r in enumerate(mine)}
        for g in (g for g in got if g["model"] == model):
            i = place[g["prediction_id"]]
            window = mine[max(0, i - 29) : i + 1]
            assert (g["place"], g["window_rows"]) == (i + 1, len(window))
            assert g["mean_ms"] == pytest.approx(sum(r[3] for r in window) / len(window))


@pytest.mark.parametrize("cell_bytes", [1 << 25, 1000, 400])
def test_items_for_users(spark, cell_bytes):
    rng = np.random.default_rng(4)
    items = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(80)]
    users = [(int(1000 + i), [float(x) for x in rng.normal(size=6)]) for i in range(12)]
    items.append((90, items[3][1]))
    seen = [(1000, int(i)) for i in range(60)] + [(1003, 5), (1004, 3)]
    got = vectors.items_for_users(
        spark.createDataFrame(users, "id long, embedding array<double>"),
        spark.createDataFrame(items, "id long, embedding array<double>"),
        spark.createDataFrame(seen, "user_id long, item_id long"),
        5,
        cell_bytes=cell_bytes,
    ).collect()
    for user, u in users:
        best = sorted(
            (-round(float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)), 9), i)
            for i, v in items
            if (user, i) not in set(seen)
        )[:5]
        assert [r["item_id"] for r in sorted((r for r in got if r["user_id"] == user), key=lambda r: r["rank"])] == [i for _, i in best]


def test_items_for_users_sends_little(spark):
    """What is sent grows as the input, and blocks stay within a task's memory."""
    kb = 1 << 10
    assert [vectors._blocks(n, 128 * kb) for n in (0, 1, 128 * kb, 129 * kb)] == [1, 1, 1, 2]
    sizes = [2**n for n in range(10, 40)]
    for asked in (400, 128 * kb, vectors.CELL_BYTES, 4 * vectors.CELL_BYTES):
        for n in sizes:
            blocks = vectors._blocks(n, asked)
            assert blocks <= vectors.BLOCKS or n / blocks > vectors.CELL_BYTES / 2
            assert n / blocks <= max(asked, vectors.CELL_BYTES)
    rng = np.random.default_rng(6)
    made = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(3000)] + [(3000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    frame = spark.createDataFrame(made, "id long, embedding array<float>")
    seen = spark.createDataFrame([(i, i) for i in range(0, 3040, 2)], "user_id long, item_id long")
    got = defaultdict(list)
    for cell_bytes in (512, 1 << 25):
        for r in vectors.items_for_users(frame, frame, seen, 5, cell_bytes=cell_bytes).orderBy("user_id", "rank").collect():
            got[cell_bytes].append((r["user_id"], r["item_id"], round(r["score"], 6)))
    assert got[512] == got[1 << 25] and len(got[512]) == 5 * 3040
    m = np.array([v for _, v in made], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for user in (0, 1, 1501, 3001, 3002):
        scores = np.round(m @ m[user], 9)
        want = sorted((-s, i) for i, s in enumerate(scores) if not (i == user and user % 2 == 0))[:5]
        assert [i for u, i, _ in got[512] if u == user] == [i for _, i in want]


def test_client_sessions_like_windows(spark):
    rng = random.Random(2)
    rows, t = [], BASE
    for _ in range(400):
        t += dt.timedelta(seconds=rng.choice([5, 200, 1799, 1800, 1801, 4000]))
        rows.append((rng.choice([1, 1, 2]), t))
    frame = spark.createDataFrame(rows, "user_id long, ts timestamp")
    got = sorted((r["user_id"], r["started_at"], r["ended_at"], r["n_events"]) for r in windows.client_sessions(frame).collect())
    want = (
        frame.groupBy(F.session_window("ts", "1799999999 microseconds").alias("w"), "user_id")
        .agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    assert got == sorted((r["user_id"], r["a"], r["b"], r["n"]) for r in want)


def test_auc(spark):
    rng = random.Random(8)
    rows = [(round(rng.random(), 2), rng.randrange(2)) for _ in range(300)]
    odd = [(None, 1), (0.3, None), (None, None)]
    got = ex.auc(spark.createDataFrame(rows + odd, "s double, y int"), "s", "y").first()["auc"]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert got == pytest.approx(want)


def test_keyed_writes(spark, rows):
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1), (2, "c", 1)], "k int, v string, o int")
    old = spark.createDataFrame([(2, "old", 0), (3, "keep", 0)], "k int, v string, o int")
    added = insert_ignore(new, old, ["k"], [F.col("o")])
    assert rows(added, "k", "v") == [(1, "a")]
    assert insert_ignore(new, old.unionByName(added), ["k"], [F.col("o")]).count() == 0
    replaced = upsert_replace(new, old, ["k"], [F.col("o")])
    assert rows(replaced, "k", "v") == [(1, "a"), (2, "c"), (3, "keep")]
    assert rows(upsert_replace(new, replaced, ["k"], [F.col("o")])) == rows(replaced)


def test_global_rank_ties(spark):
    frame = spark.range(60).select(
        F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, 1200).otherwise(1200 + F.col("id") % 4).cast("int").alias("elo_rating"),
        F.lit(1).cast("long").alias("wins"), F.lit(1).cast("long").alias("losses"),
    )
    got = ranking.global_rank(frame, F.floor(F.col("user_id") / 7)).orderBy("rank").collect()
    assert [r["user_id"] for r in got] == [r["user_id"] for r in sorted(got, key=lambda r: (-r["elo_rating"], r["user_id"]))]
    assert [r["rank"] for r in got] == list(range(1, 61))

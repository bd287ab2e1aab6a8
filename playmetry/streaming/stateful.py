"""Play streaks in one sorted pass, and outer joins of two streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetry.functions import vocab

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
MIN_GAP_MS = 23 * HOUR_MS
MAX_GAP_MS = 25 * HOUR_MS
GRANT_GAP_MS = 7 * DAY_MS

STREAK_FIELDS = [
    ("current_streak", "int"),
    ("longest_streak", "int"),
    ("last_ms", "bigint"),
    ("freeze_count", "int"),
    ("last_grant_ms", "bigint"),
    ("milestones", "array<int>"),
    ("breaks", "int"),
    ("freezes_used", "int"),
]


def streaks_stateful(plays: DataFrame, initial_freeze: bool = True) -> DataFrame:
    """Streak state of every user after all plays (user_id, ts), by the full rule.

    The rule needs a user's plays in order: one shuffle by user, a sort inside the
    partitions (which spills), and one pass that folds the plays as they stream by. Only the
    state of the current user is held, whatever the number of plays. A play without a time
    is left out, a user without any has no row.
    """
    ordered = (
        plays.where(F.col("ts").isNotNull())
        .select("user_id", F.unix_millis("ts").alias("ms"))
        .repartition("user_id")
        .sortWithinPartitions("user_id", "ms")
    )
    user = plays.schema["user_id"].dataType

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            ready = []
            for who, ms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if begun and who != now:
                    ready.append((now, state))
                    state = None
                now, begun = who, True
                state = streak_transition(state, ms, initial_freeze)
            yield _streak_batch(ready, batch.schema.field(0).type)
            kind = batch.schema.field(0).type
        if begun:
            yield _streak_batch([(now, state)], kind)

    fields = ", ".join(f"{n} {t}" for n, t in STREAK_FIELDS)
    folded = ordered.mapInArrow(fold, f"user_id {user.simpleString()}, {fields}")
    return folded.select(
        "user_id",
        "current_streak",
        "longest_streak",
        F.timestamp_millis("last_ms").alias("last_played"),
        "freeze_count",
        "freezes_used",
        "breaks",
        F.array_join(F.col("milestones").cast("array<string>"), ",").alias("milestones"),
    )


def _streak_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32())}
    columns = [pa.array([who for who, _ in rows], kind)]
    columns += [pa.array([state[i] for _, state in rows], kinds[t]) for i, (_, t) in enumerate(STREAK_FIELDS)]
    return pa.RecordBatch.from_arrays(columns, names=["user_id", *(n for n, _ in STREAK_FIELDS)])


def streak_transition(state: tuple | None, ms: int, initial_freeze: bool = True) -> tuple:
    """One play on a state tuple (fields as in STREAK_FIELDS). Without an initial freeze the first
    grant has to be earned: the grant clock starts at the first play."""
    if state is None:
        return (1, 1, ms, 0, None if initial_freeze else ms, [], 0, 0)
    current, longest, last, freeze, granted, milestones, breaks, used = state
    if freeze < 1 and (granted is None or ms - granted >= GRANT_GAP_MS):
        freeze, granted = 1, ms
    gap = ms - last
    if gap < MIN_GAP_MS:
        return (current, longest, last, freeze, granted, milestones, breaks, used)
    if not (gap <= MAX_GAP_MS or ms // DAY_MS - last // DAY_MS == 1):
        if freeze < 1:
            return (1, longest, ms, freeze, granted, milestones, breaks + 1, used)
        freeze, used = freeze - 1, used + 1
    current += 1
    reached = [m for m in vocab.STREAK_MILESTONES if current >= m and m not in milestones]
    if reached:
        milestones = [*milestones, reached[-1]]
    return (current, max(longest, current), ms, freeze, granted, milestones, breaks, used)


def reconnect_stream(disconnects: DataFrame, reconnects: DataFrame, secs: int = 30, delay: str = "1 minute") -> DataFrame:
    """Each disconnect with its reconnect inside `secs`, or NULL once the watermark has passed."""
    gone = disconnects.withWatermark("ts", delay).alias("d")
    back = reconnects.withWatermark("ts", delay).alias("r")
    within = F.expr(
        f"d.room_id = r.room_id AND d.user_id = r.user_id AND r.ts > d.ts "
        f"AND r.ts <= d.ts + INTERVAL {secs} SECONDS"
    )
    return gone.join(back, within, "left_outer").select(
        F.col("d.room_id").alias("room_id"),
        F.col("d.user_id").alias("user_id"),
        F.col("d.ts").alias("ts"),
        F.col("r.ts").alias("back_at"),
    )

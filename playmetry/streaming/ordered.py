"""Per-key rules that need event order: state processors with timers on the RocksDB store.

Rows of a key arrive in any order. A processor of this module puts them aside in state, by
slots of event time, one batch at a time, and a timer replays a slot once the watermark has
passed it. So a rule sees every key's rows in event order, whatever the number of batches and
restarts, and a task holds one batch or one slot of a key. Rows behind the watermark are late
and left out, as in event-time windows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from playmetry.streaming.stateful import STREAK_FIELDS, streak_transition

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Replays a key's rows by event time. `fields` are the columns of a row, the first one its
    time in milliseconds; rows of one millisecond go by the other fields."""

    fields: tuple[str, ...] = ("ms",)
    out: tuple[str, ...] = ()

    def __init__(self, slot_ms: int):
        self.slot_ms = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.aside = handle.getMapState("aside", "slot long", "rows string")
        self.open_state(handle)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        """State of the rule."""

    def replay(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        """What the rows of one slot give, in order."""
        raise NotImplementedError

    def at_time(self, key: tuple, ms: int) -> list[tuple]:
        """What time alone gives once all rows before `ms`, the watermark, are replayed."""
        return []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in rows:
            waiting = waiting if waiting is not None else set(self.handle.listTimers())
            times = batch[self.fields[0]]
            for slot, part in batch.groupby(times // self.slot_ms):
                slot = int(slot)
                held = json.loads(self.aside.getValue((slot,))[0]) if self.aside.containsKey((slot,)) else []
                held += [[None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for v in r] for r in part[list(self.fields)].itertuples(index=False)]
                self.aside.updateValue((slot,), (json.dumps(held),))
                if (slot + 1) * self.slot_ms not in waiting:
                    waiting.add((slot + 1) * self.slot_ms)
                    self.handle.registerTimer((slot + 1) * self.slot_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The first timer of a batch replays all finished slots, later ones find none left.
        now = timerValues.getCurrentWatermarkInMs()
        for slot in sorted(k[0] for k in self.aside.keys() if (k[0] + 1) * self.slot_ms <= now):
            rows = json.loads(self.aside.getValue((slot,))[0])
            self.aside.removeKey((slot,))
            yield from self._frame(self.replay(key, sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))))
        yield from self._frame(self.at_time(key, now))

    def _frame(self, rows: list[tuple]) -> list[pd.DataFrame]:
        return [pd.DataFrame(rows, columns=list(self.out))] if rows else []

    def wake_at(self, ms: int) -> None:
        """Sees to it that `at_time` is called once all rows up to `ms` (itself included) are replayed."""
        end = (ms // self.slot_ms + 1) * self.slot_ms
        if end not in set(self.handle.listTimers()):
            self.handle.registerTimer(end)


def in_event_order(rows: DataFrame, ts: str, delay: str, key: str, columns: list, processor: InOrder, schema: str) -> DataFrame:
    """`processor` over the rows of a stream, keyed by `key`, `delay` behind the newest event."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    watched = rows.where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    timed = watched.select(key, ts, F.unix_millis(ts).alias("ms"), *columns)
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


class WaitingList(InOrder):
    """The waiting list of one difficulty: by the pairing rule all its entries belong to one player."""

    fields = ("ms", "entry_id", "user_id", "action")
    out = ("difficulty", "first_entry", "first_user", "second_entry", "second_user")

    def __init__(self, slot_ms: int, wait_ms: int | None):
        super().__init__(slot_ms)
        self.wait_ms = wait_ms

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "entry_id long, since long")
        self.player = handle.getValueState("player", "user_id long")

    def replay(self, key, rows):
        waiting = [tuple(e) for e in self.entries.get()] if self.entries.exists() else []
        player = self.player.get()[0] if self.player.exists() else None
        out = []
        for ms, entry, user, action in rows:
            if self.wait_ms is not None:
                waiting = [e for e in waiting if ms - e[1] < self.wait_ms]
            if action == "cancel":
                if waiting and user == player:
                    waiting.pop(0)
            elif waiting and user != player:
                out.append((key[0], waiting.pop(0)[0], player, entry, user))
            else:
                player = user
                waiting.append((entry, ms))
                if self.wait_ms is not None:
                    self.wake_at(ms + self.wait_ms)
        self._keep(waiting, player)
        return out

    def at_time(self, key, ms):
        if self.wait_ms is not None and self.entries.exists():
            waiting = [tuple(e) for e in self.entries.get()]
            self._keep([e for e in waiting if ms - e[1] < self.wait_ms], self.player.get()[0])
        return []

    def _keep(self, waiting: list[tuple], player: int | None) -> None:
        if waiting:
            self.entries.put(waiting)
            self.player.update((player,))
        else:  # an empty list keeps nothing in the store
            self.entries.clear()
            self.player.clear()


def match_fifo_stream(queue: DataFrame, ts: str = "ts", delay: str = "0 seconds", slot_ms: int = 1000, wait_secs: int | None = None) -> DataFrame:
    """Pairs of the waiting queue as they form. Rows are (difficulty, entry_id, user_id, ts,
    action), action `join` or `cancel`; a cancel removes the user's first waiting entry.

    Entries are paired in the order of time and id. With `wait_secs` an entry that nobody met
    for so long leaves the list by a timer, whether or not rows arrive.
    """
    processor = WaitingList(slot_ms, None if wait_secs is None else wait_secs * 1000)
    schema = "difficulty string, first_entry long, first_user long, second_entry long, second_user long"
    return in_event_order(queue, ts, delay, "difficulty", ["entry_id", "user_id", "action"], processor, schema)


class Streak(InOrder):
    """One user's streak, a play at a time."""

    out = ("user_id", "current_streak", "longest_streak", "last_ms", "freeze_count", "freezes_used", "breaks", "milestones")

    def __init__(self, slot_ms: int, initial_freeze: bool):
        super().__init__(slot_ms)
        self.initial_freeze = initial_freeze

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"array<int>": "string"}
        self.held = handle.getValueState("streak", ", ".join(f"{n} {kinds.get(t, t)}" for n, t in STREAK_FIELDS))

    def replay(self, key, rows):
        state = None
        if self.held.exists():
            state = dict(zip((n for n, _ in STREAK_FIELDS), self.held.get()))
            state["milestones"] = [int(x) for x in state["milestones"].split(",") if x]
            state = tuple(state.values())
        for (ms,) in rows:
            state = streak_transition(state, ms, self.initial_freeze)
        now = dict(zip((n for n, _ in STREAK_FIELDS), state))
        now["milestones"] = ",".join(map(str, now["milestones"]))
        self.held.update(tuple(now.values()))
        return [(key[0], *(now[n] for n in self.out[1:]))]


def streaks_stream(plays: DataFrame, initial_freeze: bool = True, ts: str = "ts", delay: str = "0 seconds", slot_ms: int = 3_600_000) -> DataFrame:
    """Streak state of each user after every hour with plays (user_id, ts), once the hour is over.

    Plays of one user count in event order, across batches too, by the rule of `streaks_stateful`.
    """
    schema = "user_id long, current_streak int, longest_streak int, last_ms long, freeze_count int, freezes_used int, breaks int, milestones string"
    return in_event_order(plays, ts, delay, "user_id", [], Streak(slot_ms, initial_freeze), schema)


class HeldAlert(InOrder):
    """The open run of breaches of one key, and a timer at the end of its hold time."""

    fields = ("ms", "breached")
    out = ("key", "since_s", "fired_s")

    def __init__(self, slot_ms: int, step_ms: int, hold_ms: int):
        super().__init__(slot_ms)
        self.step_ms, self.hold_ms = step_ms, hold_ms

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "since long, last long, fired boolean")

    def replay(self, key, rows):
        since, last, fired = self.run.get() if self.run.exists() else (None, None, False)
        out = []
        for ms, breached in rows:
            if since is not None and not fired and self._stood(since, last, ms):
                fired = True
                out.append(self._alert(key, since))
            if not breached:
                since = None
                continue
            if since is None or ms - last > self.step_ms:
                since, fired = ms, False
                self.wake_at(ms + self.hold_ms)
            last = ms
            if not fired and ms - since >= self.hold_ms:
                fired = True
                out.append(self._alert(key, since))
        if since is None:
            self.run.clear()
        else:
            self.run.update((since, last, fired))
        return out

    def at_time(self, key, ms):
        if not self.run.exists():
            return []
        since, last, fired = self.run.get()
        if fired or not self._stood(since, last, ms):
            return []
        self.run.update((since, last, True))
        return [self._alert(key, since)]

    def _stood(self, since: int, last: int, now: int) -> bool:
        """Whether the hold time ended before `now` while the run's last evaluation still spoke."""
        return now > since + self.hold_ms and last + self.step_ms >= since + self.hold_ms

    def _alert(self, key, since: int) -> tuple:
        return key[0], since // 1000, (since + self.hold_ms) // 1000


def sustained_alert_stream(evaluations: DataFrame, step_secs: int, hold_secs: int, ts: str = "at", delay: str = "0 seconds", slot_ms: int = 1000) -> DataFrame:
    """Alerts of a stream of evaluations (key, at, breached), once per run of breaches.

    An evaluation speaks for `step_secs`; a longer pause ends the run. When the watermark
    reaches the end of the hold time of a run that still stands, a timer fires the alert, with
    or without another evaluation; the state of the run remembers that it has fired.
    """
    processor = HeldAlert(slot_ms, step_secs * 1000, hold_secs * 1000)
    return in_event_order(evaluations, ts, delay, "key", ["breached"], processor, "key string, since_s long, fired_s long")


# ---------------------------------------------------------------- drift of the last predictions


class LastPredictions(InOrder):
    """A ring of one model's newest `n` predictions, oldest first."""

    fields = ("ms", "number", "predicted")
    out = ("model", "class", "n", "upto_ms")

    def __init__(self, slot_ms: int, n: int):
        super().__init__(slot_ms)
        self.n = n

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "place long", "class string")
        self.counts = handle.getMapState("counts", "class string", "n long")
        self.seen = handle.getValueState("seen", "n long")

    def replay(self, key, rows):
        seen = self.seen.get()[0] if self.seen.exists() else 0
        change: dict[str, int] = {}
        for _, _, name in rows:
            place = (seen % self.n,)
            if seen >= self.n:
                left = self.ring.getValue(place)[0]
                change[left] = change.get(left, 0) - 1
            self.ring.updateValue(place, (name,))
            change[name] = change.get(name, 0) + 1
            seen += 1
        for name, more in change.items():
            now = more + (self.counts.getValue((name,))[0] if self.counts.containsKey((name,)) else 0)
            if now:
                self.counts.updateValue((name,), (now,))
            elif self.counts.containsKey((name,)):
                self.counts.removeKey((name,))
        self.seen.update((seen,))
        return [(key[0], c[0], n[0], rows[-1][0]) for c, n in self.counts.iterator()]


def last_class_counts(predictions: DataFrame, n: int = 1000, ts: str = "ts", delay: str = "0 seconds", slot_ms: int = 60_000) -> DataFrame:
    """(model, class, n, upto_ms): class counts of each model's newest `n` predictions after every
    slot with predictions (model, number, predicted, ts). Predictions of one time go by number;
    those without a class are left out. State per model: `n` classes and one count per class."""
    known = predictions.where(F.col("predicted").isNotNull())
    return in_event_order(known, ts, delay, "model", ["number", "predicted"], LastPredictions(slot_ms, n), "model string, class string, n long, upto_ms long")


def latest_drift_stream(
    predictions: DataFrame, reference: DataFrame, on_result: Callable[[DataFrame, int], None], checkpoint: str, n: int = 1000, **how
):
    """Start a query that hands each model's drift over its newest `n` predictions to `on_result`,
    as (model, upto_ms, psi, drift_detected, status), once per batch of the stream that finished a slot.

    `reference` has (class, share). The batch id given along is the same when a batch is
    delivered again after a failure, so a sink that overwrites by it holds each result once.
    """
    from playmetry.streaming.windows import psi_per_window

    counts = last_class_counts(predictions, n, **how)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the stateful step runs once, whatever the sink does
        keyed = batch.select(F.struct("model", "upto_ms").alias("window_start"), "class", "n")
        psi = psi_per_window(keyed, reference)
        status = F.when(F.col("psi") > 0.25, "significant_drift").when(F.col("psi") > 0.1, "moderate_drift").otherwise("no_drift")
        result = psi.select("window_start.*", "psi", "drift_detected", status.alias("status"))
        if not batch.isEmpty():
            on_result(result, batch_id)
        batch.unpersist()

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def drift_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for `latest_drift_stream`: one folder per batch id, overwritten when a batch comes again."""

    def write(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return write

"""Event-time windows. The grouped ones are the same plan in batch and streaming; a stream
needs a watermark on its time column first."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playmetry.scale import null_safe_join, values_at_ranks


def _n() -> Column:
    return F.count(F.lit(1))


def games_per_hour(df: DataFrame, ts: str = "completed_at") -> DataFrame:
    """Completed games per hour and difficulty."""
    grouped = df.where(F.col(ts).isNotNull()).groupBy(F.window(ts, "1 hour").alias("w"), "difficulty")
    return grouped.agg(_n().alias("games")).select(F.col("w.start").alias("hour"), "difficulty", "games")


def error_rate(
    df: DataFrame, win: str = "5 minutes", slide: str = "1 minute", by: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Failed share of requests in a sliding window: columns `failed` (boolean) and `ts`."""
    # Each request counts once, in its pane; a window adds up panes.
    panes = df.groupBy(F.window(ts, slide).alias("p"), *by).agg(_n().alias("requests"), F.count_if("failed").alias("errors"))
    counted = panes.groupBy(F.window("p", win, slide).alias("w"), *by).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))
    return counted.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *by,
        "requests",
        "errors",
        (F.col("errors") / F.col("requests")).alias("error_rate"),
    )


#: Size of a pane's sketch: quantiles are off by at most this share of the ranks, with odds of 99 %.
SKETCH_K, SKETCH_ERROR = 1600, 0.0025


def latency_quantiles(
    df: DataFrame, win: str = "5 minutes", slide: str = "1 minute", by: Sequence[str] = ("service",), k: int = SKETCH_K
) -> DataFrame:
    """p50, p95 and p99 in a sliding window: values of rank ceil(p * n).

    In batch they are exact at every size. A stream has to bound its state: it keeps one
    sketch per pane of `slide` and merges finished panes into windows, off by at most
    SKETCH_ERROR of the ranks. A request goes into one sketch, however many windows overlap.
    """
    if not df.isStreaming:
        return _exact_latency(df, win, slide, by)
    return latency_of_panes(latency_panes(df, slide, by, k), win, slide, by, k)


def latency_panes(df: DataFrame, slide: str = "1 minute", by: Sequence[str] = ("service",), k: int = SKETCH_K) -> DataFrame:
    """One mergeable sketch of the latencies per pane: p (the pane), keys, sketch, requests."""
    grouped = df.groupBy(F.window("ts", slide).alias("p"), *by)
    return grouped.agg(F.kll_sketch_agg_double("latency_ms", F.lit(k)).alias("sketch"), _n().alias("requests"))


def latency_of_panes(panes: DataFrame, win: str = "5 minutes", slide: str = "1 minute", by: Sequence[str] = ("service",), k: int = SKETCH_K) -> DataFrame:
    """Quantiles of sliding windows from the sketches of their panes, of a stream or a stored table."""
    merged = panes.groupBy(F.window("p", win, slide).alias("w"), *by).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("requests").alias("requests")
    )
    some = F.kll_sketch_get_n_double("sketch") > 0  # a window may hold requests without a latency alone
    at = lambda p: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    return merged.select(F.col("w.end").alias("window_end"), *by, "requests", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def _exact_latency(df: DataFrame, win: str, slide: str, by: Sequence[str]) -> DataFrame:
    """Values are counted per pane of `slide` first, so a window adds up counts, not requests;
    the asked ranks are found bucket by bucket. A request without a latency counts as a
    request and has no rank."""
    pane = df.groupBy(F.window("ts", slide).alias("p"), *by, "latency_ms").agg(_n().alias("n"))
    counted = pane.groupBy(F.window("p.start", win, slide)["end"].alias("window_end"), *by, "latency_ms").agg(F.sum("n").alias("n"))
    keys = ["window_end", *by]
    valued = F.sum(F.when(F.col("latency_ms").isNotNull(), F.col("n")))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("requests"), valued.alias("of"))
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), (F.ceil(F.lit(p) * F.col("of")) - 1).alias("rank")) for n, p in probs.items()])
    ranks = totals.where("of > 0").select(*keys, F.explode(wanted).alias("w")).select(*keys, "w.name", "w.rank")
    found = values_at_ranks(counted.where(F.col("latency_ms").isNotNull()), keys, "latency_ms", "n", ranks)
    picked = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in probs])
    return null_safe_join(totals.drop("of"), picked, keys, "left").select(*keys, "requests", *probs)


def sustained_alert(windows: DataFrame, by: Sequence[str], step_secs: int, hold_secs: int) -> DataFrame:
    """Alerts whose condition held at every evaluation for the whole hold time.

    `windows` has one row per evaluation: `by`, `at` (timestamp) and `breached`. A missing
    evaluation ends a run. Rows per key are evaluations, not events, so they are bounded
    by time.
    """
    bad = windows.where("breached").select(*by, "at").distinct()
    w = Window.partitionBy(*by).orderBy("at")
    tick = F.floor(F.unix_seconds("at") / step_secs)
    runs = (
        bad.withColumn("__run", tick - F.row_number().over(w))
        .groupBy(*by, "__run")
        .agg(F.min("at").alias("since"), F.max("at").alias("last_at"), _n().alias("evaluations"))
    )
    held = F.unix_seconds("last_at") - F.unix_seconds("since") >= hold_secs
    return runs.where(held).select(
        *by,
        "since",
        F.timestamp_seconds(F.unix_seconds("since") + F.lit(hold_secs)).alias("fired_at"),
        "last_at",
        "evaluations",
    )


def client_sessions(df: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions of each user: a pause of the gap or more starts a new one.

    A stream uses session windows; they still join events exactly one gap apart, so their
    gap is a microsecond shorter. In batch, events within a third of the gap always
    belong together, so they collapse to one row (first, last, count) before the shuffle
    and a busy user adds only so many rows per day, whatever the number of events.
    """
    if df.isStreaming:
        gap = f"{gap_minutes * 60_000_000 - 1} microseconds"
        grouped = df.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        return grouped.agg(
            F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), _n().alias("n_events")
        ).drop("w")
    slot = F.floor(F.unix_seconds("ts") / (gap_minutes * 20))
    slots = df.groupBy("user_id", slot.alias("__slot")).agg(
        F.min("ts").alias("__first"), F.max("ts").alias("__last"), _n().alias("__n")
    )
    w = Window.partitionBy("user_id").orderBy("__slot")
    fresh = F.unix_micros("__first") - F.unix_micros(F.lag("__last").over(w)) >= gap_minutes * 60_000_000
    starts = F.coalesce(fresh, F.lit(True)).cast("int")
    numbered = slots.withColumn("__new", starts).withColumn("__session", F.sum("__new").over(w))
    return numbered.groupBy("user_id", "__session").agg(
        F.min("__first").alias("started_at"), F.max("__last").alias("ended_at"), F.sum("__n").alias("n_events")
    ).drop("__session")


def dau_stream(df: DataFrame, delay: str = "1 day") -> DataFrame:
    """Distinct users per day: each (user, day) once, then a count per day."""
    keyed = df.withColumn("day", F.to_date("ts"))
    if not df.isStreaming:
        return keyed.groupBy("day").agg(F.count_distinct("user_id").alias("users"))
    once = keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "day"])
    counted = once.groupBy(F.window("ts", "1 day").alias("w")).agg(_n().alias("users"))
    return counted.select(F.to_date("w.start").alias("day"), "users")


def class_counts(predictions: DataFrame, win: str = "1 hour") -> DataFrame:
    """Predicted classes per window."""
    grouped = predictions.groupBy(F.window("ts", win).alias("w"), F.col("predicted").alias("class"))
    return grouped.agg(_n().alias("n")).select(F.col("w.start").alias("window_start"), "class", "n")


def psi_per_window(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """Drift of every window in `counts` against the reference shares (class, share).

    A class of the reference that a window lacks adds its term at the floor. The sum of
    those terms over the whole reference is one number; the classes a window does have
    take theirs off again, so windows and classes are never multiplied out.
    """
    floor = F.lit(0.001)

    def term(cur: Column, ref: Column) -> Column:
        return (cur - ref) * F.ln(cur / ref)

    known = reference.select("class", F.greatest(F.col("share"), floor).alias("__ref"))
    absent = known.agg(F.sum(term(floor, F.col("__ref"))).alias("__absent"))
    total = F.sum("n").over(Window.partitionBy("window_start"))  # one row per class by now
    cur = F.greatest(F.col("n") / F.col("__all"), floor)
    joined = counts.withColumn("__all", total).join(known, "class", "left")
    here = term(cur, F.coalesce("__ref", floor))
    undo = F.coalesce(term(floor, F.col("__ref")), F.lit(0.0))
    sums = joined.groupBy("window_start").agg(F.sum(here - undo).alias("__here"))
    return sums.select(
        "window_start", F.round(F.col("__here") + absent.scalar(), 4).alias("psi")
    ).withColumn("drift_detected", F.col("psi") > 0.1)


def drift_stream(
    predictions: DataFrame,
    reference: DataFrame,
    on_result: Callable[[DataFrame, int], None],
    checkpoint: str,
    win: str = "1 hour",
    delay: str = "10 minutes",
):
    """Start a query that hands the drift of finished windows to `on_result`."""
    counts = class_counts(predictions.withWatermark("ts", delay), win)

    def each(batch: DataFrame, batch_id: int) -> None:
        on_result(psi_per_window(batch, reference), batch_id)

    return (
        counts.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )


def counter_rate(df: DataFrame, by: Sequence[str], win_secs: int, ts: str = "ts") -> DataFrame:
    """Increase and per-second rate of a counter of rows, per window and group."""
    grouped = df.groupBy(F.window(ts, f"{win_secs} seconds").alias("w"), *by)
    return grouped.agg(_n().alias("increase")).select(
        F.col("w.start").alias("window_start"),
        *by,
        "increase",
        (F.col("increase") / F.lit(float(win_secs))).alias("rate"),
    )


def moving_average(daily: DataFrame, n: int = 7, value: str = "rate") -> DataFrame:
    """Mean of a daily value over `n` calendar days; days without a row count as absent.

    `daily` has one row per date, so the ordered window is as long as the calendar.
    """
    span = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    calendar = span.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    w = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    return calendar.join(daily.select("date", value), "date", "left").select(
        "date", value, F.avg(value).over(w).alias("moving_avg")
    )

"""Aggregates and reports."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from playmetry.functions import vocab
from playmetry.functions.scoring import risk_level, streak_bucket
from playmetry.operators.frames import both_sides, latest_snapshot
from playmetry.scale import exact_quantiles, moment, null_safe_join


def _n() -> Column:
    return F.count(F.lit(1))


def _day(value) -> Column:
    return F.lit(str(value)).cast("date")


def _on(df: DataFrame, col: str, day) -> DataFrame:
    return df if day is None else df.where(F.to_date(col) == _day(day))


def key_days_before(as_of, n: int) -> Column:
    """Date key of the day `n` days before `as_of`."""
    return F.date_format(F.date_sub(_day(as_of), n), "yyyyMMdd").cast("int")


def daily_active_users(fact: DataFrame, date_key: int | None = None, approx: bool = False) -> DataFrame:
    """Distinct users per date key; `approx` trades exactness for one sketch per date."""
    rows = fact if date_key is None else fact.where(F.col("date_key") == date_key)
    users = F.approx_count_distinct("user_hash") if approx else F.count_distinct("user_hash")
    return rows.groupBy("date_key").agg(users.alias("user_count"))


def completion_rates(fact: DataFrame, date_key: int | None = None) -> DataFrame:
    rows = fact if date_key is None else fact.where(F.col("date_key") == date_key)
    done = F.col("status") == "completed"
    return rows.groupBy("difficulty_key").agg(
        _n().alias("started_count"),
        F.count_if(done).alias("completed_count"),
        F.coalesce(F.avg(F.when(done, F.col("time_elapsed_ms"))), F.lit(0.0)).alias("avg_time_ms"),
        (F.count_if(done) / _n()).alias("completion_rate"),
    )


def popularity_per_day(fact: DataFrame) -> DataFrame:
    return fact.groupBy("date_key", "difficulty_key").agg(_n().alias("play_count"))


def difficulty_popularity(fact: DataFrame, n_days: int, as_of) -> DataFrame:
    """Plays per difficulty over the last `n_days`, most played first."""
    recent = fact.where(F.col("date_key") >= key_days_before(as_of, n_days))
    return (
        recent.groupBy("difficulty_key")
        .agg(_n().alias("total_plays"))
        .orderBy(F.col("total_plays").desc(), "difficulty_key")
    )


def streak_distribution(streaks: DataFrame, day) -> DataFrame:
    return (
        streaks.groupBy(streak_bucket(F.col("current_streak")).alias("streak_bucket"))
        .agg(_n().alias("user_count"))
        .select(_day(day).alias("date"), "streak_bucket", "user_count")
    )


def daily_sessions(fact: DataFrame, n_days: int, as_of, difficulty: str | None = None) -> DataFrame:
    rows = fact.where(F.col("date_key") >= key_days_before(as_of, n_days))
    if difficulty is not None:
        rows = rows.where(F.col("difficulty_key") == difficulty)
    done = F.col("status") == "completed"
    return (
        rows.groupBy("date_key")
        .agg(
            _n().alias("total_sessions"),
            F.count_if(done).alias("completed"),
            F.count_distinct("user_hash").alias("unique_users"),
            F.avg("time_elapsed_ms").alias("avg_time_ms"),
        )
        .withColumn("completion_rate", F.round(F.col("completed") / F.col("total_sessions"), 4))
        .orderBy(F.col("date_key").desc())
    )


def elo_trends(matches: DataFrame, day=None) -> DataFrame:
    """Per date and player: games, wins, losses, first rating before and last rating after.

    First and last are taken by time inside the aggregation, so both sides of a match
    are combined on the map side and no group is sorted or collected.
    """
    sides = both_sides(
        _on(matches, "completed_at", day).select(
            "match_id",
            "completed_at",
            "winner_id",
            "loser_id",
            "winner_elo_before",
            "winner_elo_after",
            "loser_elo_before",
            "loser_elo_after",
        )
    )
    at = moment(sides, "completed_at", "match_id")
    return (
        sides.groupBy(F.to_date("completed_at").alias("date"), "user_id")
        .agg(
            _n().alias("matches_played"),
            F.sum("is_win").alias("wins"),
            (_n() - F.sum("is_win")).alias("losses"),
            F.min_by("elo_before", at).alias("elo_start"),
            F.max_by("elo_after", at).alias("elo_end"),
        )
        .withColumn("elo_delta", F.col("elo_end") - F.col("elo_start"))
    )


def match_stats_daily(matches: DataFrame, day=None) -> DataFrame:
    """Per date: matches, means and the two breakdowns; dates without matches have no row.

    One pre-aggregation on (date, difficulty, end reason) feeds all of it.
    """
    cube = (
        _on(matches, "completed_at", day)
        .groupBy(F.to_date("completed_at").alias("date"), "difficulty", "end_reason")
        .agg(
            _n().alias("n"),
            F.sum("duration_ms").alias("ms"),
            F.count("duration_ms").alias("n_ms"),
            F.sum("elo_delta").alias("delta"),
            F.count("elo_delta").alias("n_delta"),
        )
    )
    totals = cube.groupBy("date").agg(
        F.sum("n").alias("total_matches"),
        (F.sum("ms") / F.nullif(F.sum("n_ms"), F.lit(0))).alias("avg_duration_ms"),
        (F.sum("delta") / F.nullif(F.sum("n_delta"), F.lit(0))).alias("avg_elo_delta"),
    )

    def breakdown(value: str, out: str) -> DataFrame:
        entries = F.array_sort(
            F.collect_list(F.struct(F.coalesce(value, F.lit("null")).alias("key"), F.col("n")))
        )
        per_value = cube.groupBy("date", value).agg(F.sum("n").alias("n"))
        return per_value.groupBy("date").agg(F.to_json(F.map_from_entries(entries)).alias(out))

    return totals.join(breakdown("difficulty", "difficulty_breakdown"), "date").join(
        breakdown("end_reason", "end_reason_breakdown"), "date"
    )


def anomaly_report_daily(sessions: DataFrame, day=None) -> DataFrame:
    """Per date: scored sessions. An unscored session counts as 0 in the mean; `avg_scored`
    leaves it out."""
    flagged = F.count_if(F.col("is_anomalous"))
    return (
        _on(sessions, "completed_at", day)
        .where(F.col("completed_at").isNotNull())
        .groupBy(F.to_date("completed_at").alias("date"))
        .agg(
            _n().alias("total_sessions"),
            flagged.alias("flagged_count"),
            (flagged / _n()).alias("flag_rate"),
            F.avg(F.coalesce("anomaly_score", F.lit(0.0))).alias("avg_anomaly_score"),
            F.avg("anomaly_score").alias("avg_scored"),
        )
    )


def skill_segments(dim_user: DataFrame) -> DataFrame:
    return (
        dim_user.where("is_active")
        .groupBy("skill_segment")
        .agg(_n().alias("user_count"))
        .orderBy(F.col("skill_segment").asc_nulls_last())
    )


def cluster_distribution(users: DataFrame, run_date) -> DataFrame:
    return (
        users.groupBy(F.coalesce("skill_cluster", F.lit("Unassigned")).alias("cluster"))
        .agg(_n().alias("user_count"))
        .select(_day(run_date).alias("date"), "cluster", "user_count")
    )


def _measure(df: DataFrame, name: str, value: Column, detail: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(name).alias("measure"),
        (F.lit("") if detail is None else detail).cast("string").alias("detail"),
        value.cast("double").alias("value"),
    )


def warehouse_summary(tables: dict[str, DataFrame], as_of) -> DataFrame:
    """Row counts, date range, top three difficulties of 30 days, completion rate of 7 days."""
    fact = tables["fact_game_session"]
    parts = [
        _measure(df.agg(_n().alias("n")), "row_count", F.col("n"), F.lit(name))
        for name, df in tables.items()
    ]
    span = fact.agg(F.min("date_key").alias("lo"), F.max("date_key").alias("hi"))
    parts.append(_measure(span, "min_date_key", F.col("lo")))
    parts.append(_measure(span, "max_date_key", F.col("hi")))
    top = (
        fact.where(F.col("date_key") >= key_days_before(as_of, 30))
        .groupBy("difficulty_key")
        .agg(_n().alias("n"))
        .orderBy(F.col("n").desc(), "difficulty_key")
        .limit(3)
    )
    parts.append(_measure(top, "top_difficulty_30d", F.col("n"), F.col("difficulty_key")))
    week = fact.where(F.col("date_key") >= key_days_before(as_of, 7)).agg(
        F.round(
            F.count_if(F.col("status") == "completed") / F.nullif(_n(), F.lit(0)), 4
        ).alias("rate")
    )
    parts.append(_measure(week, "completion_rate_7d", F.col("rate")))
    return reduce(DataFrame.unionByName, parts)


def competitive_summary(leaderboard: DataFrame, stats: DataFrame, reports: DataFrame, as_of) -> DataFrame:
    """Top ten of the newest snapshot, matches and flagged sessions of seven days."""
    top = latest_snapshot(leaderboard, "snapshot_date", 10, [F.col("rank").asc()])
    since = F.date_sub(_day(as_of), 7)
    return reduce(
        DataFrame.unionByName,
        [
            _measure(top, "top_player", F.col("elo_rating"), F.col("user_id")),
            _measure(
                stats.where(F.col("date") >= since).agg(F.sum("total_matches").alias("n")),
                "matches_7d",
                F.coalesce("n", F.lit(0)),
            ),
            _measure(
                reports.where(F.col("date") >= since).agg(F.sum("flagged_count").alias("n")),
                "anomalies_7d",
                F.coalesce("n", F.lit(0)),
            ),
        ],
    )


def feature_store_stats(features: DataFrame) -> DataFrame:
    return features.groupBy("feature_group").agg(
        F.count_if("is_current").alias("current_features"),
        _n().alias("total_versions"),
        F.max("computed_at").alias("last_written"),
    )


def experiment_summary(results: DataFrame, experiment: str | None = None) -> DataFrame:
    rows = results if experiment is None else results.where(F.col("experiment_name") == experiment)
    value = F.col("metric_value")
    return rows.groupBy("experiment_name", "variant", "metric_name").agg(
        _n().alias("n"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("stddev"),
    )


def total_xp(progress: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """XP per user; with `users`, those without lessons get 0."""
    sums = progress.groupBy("user_id").agg(F.coalesce(F.sum("xp_awarded"), F.lit(0)).alias("total_xp"))
    if users is None:
        return sums
    everyone = users.select(F.col("id").alias("user_id"))
    return everyone.join(sums, "user_id", "left").select(
        "user_id", F.coalesce("total_xp", F.lit(0).cast("long")).alias("total_xp")
    )


def lessons(spark: SparkSession) -> DataFrame:
    """The fifteen fixed lessons."""
    rows = [(name, tier, vocab.TIER_XP[tier], i) for i, (name, tier) in enumerate(vocab.LESSONS)]
    return spark.createDataFrame(rows, "lesson_id string, tier int, xp_reward int, position int")


def lesson_badges(progress: DataFrame, lesson_list: DataFrame) -> DataFrame:
    """Badges each user has earned: first step, one per finished tier, master, speed."""
    done = (
        progress.where("completed")
        .join(F.broadcast(lesson_list.select("lesson_id", "tier")), "lesson_id")
        .groupBy("user_id", "lesson_id", "tier")
        .agg(
            F.min(
                F.unix_micros("completed_at") - F.unix_micros("started_at")
            ).alias("micros")
        )
    )
    sizes = {tier: sum(1 for _, t in vocab.LESSONS if t == tier) for tier in vocab.TIER_BADGES}
    per_user = done.groupBy("user_id").agg(
        _n().alias("__all"),
        F.min("micros").alias("__fastest"),
        *[F.count_if(F.col("tier") == tier).alias(f"__t{tier}") for tier in sizes],
    )
    earned = [F.when(F.col("__all") == 1, "first-step")]
    earned += [
        F.when(F.col(f"__t{tier}") == size, vocab.TIER_BADGES[tier]) for tier, size in sizes.items()
    ]
    earned.append(F.when(F.col("__all") == len(vocab.LESSONS), "master"))
    earned.append(F.when(F.col("__fastest") < 3 * 60 * 1_000_000, "speed-learner"))
    return per_user.select(
        "user_id", F.explode(F.array_compact(F.array(*earned))).alias("badge_id")
    )


def lesson_progress_view(users: DataFrame, lesson_list: list[str], progress: DataFrame) -> DataFrame:
    """Every lesson of every user with the user's progress, NULL when not started.

    The list of lessons is fixed, so each user row is expanded in place.
    """
    grid = users.select(
        F.col("id").alias("user_id"),
        F.explode(F.array(*[F.lit(x) for x in lesson_list])).alias("lesson_id"),
    )
    columns = ["user_id", "lesson_id", "steps_complete", "completed", "xp_awarded"]
    return grid.join(progress.select(*columns), ["user_id", "lesson_id"], "left")


def onboarding_status(users: DataFrame, progress: DataFrame) -> DataFrame:
    joined = users.select(F.col("id").alias("user_id")).join(progress, "user_id", "left")
    return joined.select(
        "user_id",
        F.col("started_at").isNotNull().alias("started"),
        F.coalesce("steps_seen", F.lit(0).cast("long")).alias("steps_seen"),
        F.coalesce("completed", F.lit(False)).alias("completed"),
        F.coalesce("skipped", F.lit(False)).alias("skipped"),
    )


def model_metrics(predictions: DataFrame) -> DataFrame:
    """Latency quantiles (exact), confidence and accuracy per model."""
    conf, latency = F.col("confidence"), F.col("latency_ms")
    labelled = F.count_if(F.col("actual").isNotNull())
    correct = F.count_if(F.col("predicted") == F.col("actual"))
    plain = predictions.groupBy("model").agg(
        _n().alias("total_predictions"),
        F.round(F.avg(latency), 2).alias("mean_ms"),
        F.round(F.max(latency).cast("double"), 2).alias("max_ms"),
        F.round(F.avg(conf), 4).alias("mean_confidence"),
        F.round(F.min(conf), 4).alias("min_confidence"),
        F.round(F.count_if(conf < 0.7) / _n(), 4).alias("below_70_pct"),
        F.round(F.when(labelled > 0, correct / labelled), 4).alias("accuracy"),
    )
    quantiles = exact_quantiles(
        predictions, ["model"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    )
    rounded = quantiles.select(
        "model", *[F.round(c, 2).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")]
    )
    return null_safe_join(plain, rounded, ["model"], "left")


def class_distribution(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Predicted classes with count and share, per group of `by` or overall."""
    by = by or []
    counts = predictions.groupBy(*by, F.col("predicted").alias("class")).agg(_n().alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))  # one row per class by now
    return counts.withColumn("share", F.col("n") / total)


def alert_rows(predictions: DataFrame, n: int = 10) -> DataFrame:
    """The newest `n` alerts: slow (over 500 ms) or unsure (confidence under 0.3) predictions."""
    slow, unsure = F.col("latency_ms") > 500, F.col("confidence") < 0.3
    kinds = F.array_compact(F.array(F.when(slow, "latency"), F.when(unsure, "confidence")))
    alerts = predictions.where(slow | unsure).select(
        "prediction_id", "model", "ts", "latency_ms", "confidence", F.explode(kinds).alias("alert")
    )
    return alerts.orderBy(F.col("ts").desc(), F.col("prediction_id").desc(), "alert").limit(n)


def retention_report(facts: dict[str, DataFrame]) -> DataFrame:
    """Rows and date range per fact table."""
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(
                _n().alias("n_rows"),
                F.min("date_key").alias("min_date_key"),
                F.max("date_key").alias("max_date_key"),
            ).select(F.lit(name).alias("table_name"), "n_rows", "min_date_key", "max_date_key")
            for name, df in facts.items()
        ],
    )


def retention_cutoff(df: DataFrame, col: str, as_of, days: int) -> Column:
    """First day that is kept, as a literal of the column's own type, so the comparison reaches
    the file scan. A whole-number column holds day keys like 20240131."""
    day = date.fromisoformat(str(as_of)[:10]) - timedelta(days=days)
    if isinstance(df.schema[col].dataType, IntegralType):
        return F.lit(int(day.strftime("%Y%m%d"))).cast(df.schema[col].dataType)
    return F.lit(day).cast(df.schema[col].dataType)


def retention_purge_plan(
    tables: dict[str, tuple[DataFrame, str]], policy: dict[str, int], as_of
) -> DataFrame:
    """Per table: cutoff, rows older than it and rows kept. Values are (table, date column)."""
    parts = []
    for name, (df, col) in tables.items():
        expired = F.col(col) < retention_cutoff(df, col, as_of, policy[name])
        parts.append(
            df.agg(
                F.count_if(expired).alias("n_expired"),
                F.count_if(~F.coalesce(expired, F.lit(False))).alias("n_kept"),
            ).select(
                F.lit(name).alias("table_name"),
                F.date_sub(_day(as_of), policy[name]).alias("cutoff"),
                "n_expired",
                "n_kept",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile of a cumulative histogram per `by`: columns `le` (upper bound, may be
    infinite) and `count` (rows up to it), linear inside the bucket.

    A rank in the infinite bucket gives the highest finite bound; the lowest bucket
    starts at 0 unless its bound is not positive.
    """
    w = Window.partitionBy(*by).orderBy("le")
    total = F.max("count").over(Window.partitionBy(*by))
    infinite = F.lit(float("inf"))
    marked = buckets.select(
        *by,
        "le",
        "count",
        F.coalesce(F.max("le").over(w.rowsBetween(-1, -1)), F.least(F.lit(0.0), F.col("le"))).alias("__low"),
        F.coalesce(F.max("count").over(w.rowsBetween(-1, -1)), F.lit(0)).alias("__below"),
        total.alias("__total"),
        (F.lit(float(q)) * total).alias("__rank"),
    )
    hit = marked.where(
        (F.col("count") >= F.col("__rank"))
        & ((F.col("__below") < F.col("__rank")) | ((F.col("__below") == 0) & (F.col("__rank") == 0)))
        & (F.col("__total") > 0)
    )
    inside = F.col("count") - F.col("__below")
    value = F.when(F.col("le") == infinite, F.col("__low")).otherwise(
        F.col("__low")
        + (F.col("le") - F.col("__low"))
        * F.coalesce((F.col("__rank") - F.col("__below")) / F.nullif(inside, F.lit(0)), F.lit(0.0))
    )
    return hit.groupBy(*by).agg(F.min(value).alias("value"))


def user_badges(badges: DataFrame) -> DataFrame:
    """Badges joined to their titles; unknown ids are dropped."""
    definitions = badges.sparkSession.createDataFrame(
        list(vocab.BADGES.items()), "badge_id string, title string"
    )
    return badges.join(F.broadcast(definitions), "badge_id")


def churn_band_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy(risk_level(F.col("churn_prob")).alias("risk_band")).agg(_n().alias("user_count"))


def active_streak_users(streaks: DataFrame) -> DataFrame:
    return streaks.agg(F.count_if(F.col("current_streak") > 0).alias("active_users"))

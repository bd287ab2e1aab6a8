"""Feature tables per user. Sessions are aggregated per user before any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmetry.functions import vocab
from playmetry.functions.scoring import lookup
from playmetry.functions.text import user_text
from playmetry.scale import exact_quantiles, ordered_positions

EASY = ["super_easy", "easy"]
HARD = ["hard", "super_hard"]


def _n() -> Column:
    return F.count(F.lit(1))


def _ts(as_of) -> Column:
    return F.lit(str(as_of)).cast("timestamp")


def _done() -> Column:
    return F.col("status") == "completed"


def _ratio(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0))


def _double(col: Column, default: float) -> Column:
    return F.coalesce(col.cast("double"), F.lit(float(default)))


def _with_users(users: DataFrame, per_user: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("user_id")).join(per_user, "user_id", "left")


def churn_features(users: DataFrame, streaks: DataFrame, sessions: DataFrame, as_of) -> DataFrame:
    """Ten engagement features per user, with defaults for users without sessions.

    The two trend windows are half open, so the 14-day boundary counts once.
    """
    now, started = _ts(as_of), F.col("started_at")
    d14, d28, d30 = (now - F.expr(f"INTERVAL {n} DAYS") for n in (14, 28, 30))
    recent = started >= d14
    earlier = (started >= d28) & (started < d14)
    per_user = sessions.groupBy("user_id").agg(
        (F.count_if(started >= d30) / F.lit(4.3)).alias("session_frequency"),
        (F.avg("time_elapsed_ms") / F.lit(60000.0)).alias("avg_session_duration"),
        _n().alias("total_games_played"),
        (
            _ratio(F.count_if(_done() & recent), F.count_if(recent))
            - _ratio(F.count_if(_done() & earlier), F.count_if(earlier))
        ).alias("win_rate_trend"),
        F.count_distinct("difficulty").alias("difficulty_variety"),
        _ratio(F.count_if(_done()), _n()).alias("completion_rate"),
    )
    idle = (F.unix_micros(now) - F.unix_micros("last_played_date")) / F.lit(86_400_000_000.0)
    flames = streaks.select("user_id", "last_played_date", "longest_streak")
    joined = _with_users(users, per_user).join(flames, "user_id", "left")
    return joined.select(
        "user_id",
        _double(idle, 999).alias("days_since_last_play"),
        _double(F.col("session_frequency"), 0).alias("session_frequency"),
        _double(F.col("avg_session_duration"), 20).alias("avg_session_duration"),
        _double(F.col("total_games_played"), 0).alias("total_games_played"),
        _double(F.col("win_rate_trend"), 0).alias("win_rate_trend"),
        F.lit(0.0).alias("hint_usage_trend"),
        _double(F.col("difficulty_variety"), 0).alias("difficulty_variety"),
        _double(F.col("completion_rate"), 0.7).alias("completion_rate"),
        F.lit(0.0).alias("error_rate_trend"),
        _double(F.col("longest_streak"), 0).alias("longest_streak"),
    )


def _solve_times() -> list[Column]:
    seconds = F.col("time_elapsed_ms") / F.lit(1000.0)

    def mean(levels: list[str]) -> Column:
        return F.avg(F.when(_done() & F.col("difficulty").isin(levels), seconds))

    return [
        mean(EASY).alias("avg_solve_time_easy"),
        mean(["medium"]).alias("avg_solve_time_medium"),
        mean(HARD).alias("avg_solve_time_hard"),
        _ratio(F.count_if(_done() & (F.col("hints_used") > 0)), F.count_if(_done())).alias("hint_rate"),
    ]


def _solve_defaults() -> list[Column]:
    return [
        _double(F.col("avg_solve_time_easy"), 120).alias("avg_solve_time_easy"),
        _double(F.col("avg_solve_time_medium"), 300).alias("avg_solve_time_medium"),
        _double(F.col("avg_solve_time_hard"), 600).alias("avg_solve_time_hard"),
        _double(F.col("hint_rate"), 0.2).alias("hint_rate"),
    ]


def most_frequent(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent value per key; ties go to the smaller value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(_n().alias("__n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(out))


def skill_features_weekly(users: DataFrame, sessions: DataFrame, as_of) -> DataFrame:
    """Eight solve features for the weekly clustering."""
    since = _ts(as_of) - F.expr("INTERVAL 30 DAYS")
    per_user = sessions.groupBy("user_id").agg(
        *_solve_times(),
        _ratio(F.count_if(_done() & (F.col("errors_count") > 0)), F.count_if(_done())).alias("error_rate"),
        F.avg(F.when(_done(), F.col("time_elapsed_ms") / F.lit(60000.0))).alias("session_length_avg"),
        F.count_distinct(F.when(F.col("started_at") >= since, F.to_date("started_at"))).alias(
            "days_active_last_30"
        ),
    )
    ranks = {d: i for i, d in enumerate(vocab.DIFFICULTY_ORDER)}
    mode = most_frequent(sessions, "user_id", "difficulty", "mode")
    joined = _with_users(users, per_user).join(mode, "user_id", "left")
    return joined.select(
        "user_id",
        *_solve_defaults(),
        _double(F.col("error_rate"), 0.15).alias("error_rate"),
        F.coalesce(lookup(F.col("mode"), ranks), F.lit(2)).cast("int").alias("difficulty_preference_mode"),
        _double(F.col("session_length_avg"), 20).alias("session_length_avg"),
        F.coalesce("days_active_last_30", F.lit(0)).cast("int").alias("days_active_last_30"),
    )


def skill_features_store(users: DataFrame, sessions: DataFrame, as_of) -> DataFrame:
    """The feature-store variant: mean errors, completion, spread and games of 30 days."""
    since = _ts(as_of) - F.expr("INTERVAL 30 DAYS")
    per_user = sessions.groupBy("user_id").agg(
        *_solve_times(),
        F.avg("errors_count").alias("error_rate"),
        _ratio(F.count_if(_done()), _n()).alias("completion_rate"),
        F.count_distinct("difficulty").alias("difficulty_spread"),
        F.count_if(F.col("started_at") >= since).alias("games_last_30d"),
    )
    return _with_users(users, per_user).select(
        "user_id",
        *_solve_defaults(),
        _double(F.col("error_rate"), 0).alias("error_rate"),
        _double(F.col("completion_rate"), 0.7).alias("completion_rate"),
        _double(F.col("difficulty_spread"), 0).alias("difficulty_spread"),
        _double(F.col("games_last_30d"), 0).alias("games_last_30d"),
    )


def anomaly_features_user(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """Ten timing features per user. Ratios divide by NULLIF(mean, 1), as the rule is written."""
    timed = sessions.withColumn("seconds", F.col("time_elapsed_ms") / F.lit(1000.0))
    per_user = timed.groupBy("user_id").agg(
        F.avg("seconds").alias("mean"),
        F.stddev_samp("seconds").alias("std"),
        F.min("seconds").alias("low"),
        F.max("seconds").alias("high"),
        F.avg("errors_count").alias("errors"),
        F.avg("hints_used").alias("hints"),
        F.avg(F.col("time_elapsed_ms") / F.lit(60000.0)).alias("minutes"),
        _n().alias("n"),
        F.count_if(_done()).alias("done"),
    )
    p10 = exact_quantiles(timed, ["user_id"], "seconds", {"p10": 0.1})
    mean = F.nullif(F.col("mean"), F.lit(1.0))
    completion = _ratio(F.col("done"), F.col("n"))
    joined = _with_users(users, per_user).join(p10, "user_id", "left")
    return joined.select(
        "user_id",
        _double(_ratio(F.col("mean"), F.col("high")), 0.5).alias("time_mean_norm"),
        _double(F.col("std") / mean, 0.2).alias("time_std_norm"),
        _double(F.col("low") / mean, 0.1).alias("time_min_norm"),
        _double(F.col("p10") / mean, 0.1).alias("time_p10_norm"),
        _double(_ratio(F.col("errors"), F.col("minutes")), 0).alias("error_rate"),
        _double(_ratio(F.col("hints"), F.col("n")), 0).alias("hint_rate"),
        _double(completion, 0.7).alias("fill_rate_norm"),
        _double(F.col("mean") / F.lit(1800.0), 0.5).alias("duration_ratio"),
        _double(completion, 0.7).alias("completion_ratio"),
        _double(F.lit(1.0) - F.col("std") / mean, 0.5).alias("consistency_score"),
    )


def improvement_trend(sessions: DataFrame) -> DataFrame:
    """Per user: mean solve time of the later half of completed games against the earlier half.

    Halves need each game's place in time. Days number the games, so a user with very
    many games is spread over days.
    """
    played = sessions.where(_done()).select("user_id", "id", "started_at", "time_elapsed_ms")
    placed = ordered_positions(
        played, ["user_id"], F.to_date("started_at"), [F.col("started_at"), F.col("id")], "place"
    )
    totals = played.groupBy("user_id").agg(_n().alias("games"))
    half = F.floor(F.col("games") / 2)
    ms = F.coalesce("time_elapsed_ms", F.lit(0))
    means = (
        placed.join(totals, "user_id")
        .groupBy("user_id", "games")
        .agg(
            F.avg(F.when(F.col("place") <= half, ms)).alias("early_ms"),
            F.avg(F.when(F.col("place") > half, ms)).alias("late_ms"),
        )
    )
    change = (F.col("early_ms") - F.col("late_ms")) / F.nullif(F.col("early_ms"), F.lit(0.0))
    enough = F.col("games") >= 6
    return means.select(
        "user_id",
        "games",
        "early_ms",
        "late_ms",
        F.when(enough & (change > 0.15), "improving")
        .when(enough & (change < -0.15), "declining")
        .otherwise("stable")
        .alias("improvement_trend"),
    )


def user_profile(sessions: DataFrame) -> DataFrame:
    """Preference profile per user: most played level, shares, mean times, skill, trend.

    Sessions are reduced to one row per (user, level) first; the maps hold one entry per
    level. Ties of the most played level go to the easier one.
    """
    rows = sessions.withColumn("difficulty", F.coalesce("difficulty", F.lit("medium")))
    per_level = rows.groupBy("user_id", "difficulty").agg(
        _n().alias("n"),
        F.sum(F.coalesce("hints_used", F.lit(0))).alias("hints"),
        F.avg(F.when(_done(), F.coalesce("time_elapsed_ms", F.lit(0)))).alias("mean_ms"),
    )
    order = {d: i for i, d in enumerate(vocab.DIFFICULTY_ORDER)}
    rank = lookup(F.col("difficulty"), order, 2)
    tie = lookup(F.col("difficulty"), order, 99)
    entries = F.array_sort(F.collect_list(F.struct("difficulty", "n", "mean_ms")))
    folded = per_level.groupBy("user_id").agg(
        F.sum("n").alias("session_count"),
        F.sum("hints").alias("hints"),
        F.min_by(
            F.struct("difficulty", rank.alias("rank")),
            F.struct(-F.col("n"), tie, F.col("difficulty")),
        ).alias("top"),
        entries.alias("levels"),
    )
    rate = F.col("hints") / F.col("session_count")
    profile = folded.select(
        "user_id",
        "session_count",
        F.col("top.difficulty").alias("preferred_difficulty"),
        F.when((F.col("top.rank") <= 1) | (rate > 0.5), "beginner")
        .when(F.col("top.rank") <= 2, "intermediate")
        .when(F.col("top.rank") <= 3, "advanced")
        .otherwise("expert")
        .alias("skill_level"),
        F.round(rate, 3).alias("hint_usage_rate"),
        F.map_from_entries(
            F.transform("levels", lambda e: F.struct(e["difficulty"], e["n"] / F.col("session_count")))
        ).alias("difficulty_distribution"),
        F.map_from_entries(
            F.transform(
                F.filter("levels", lambda e: e["mean_ms"].isNotNull()),
                lambda e: F.struct(e["difficulty"], e["mean_ms"]),
            )
        ).alias("avg_solve_times_ms"),
    )
    trend = improvement_trend(sessions).select("user_id", "improvement_trend")
    return profile.join(trend, "user_id", "left").withColumn(
        "improvement_trend", F.coalesce("improvement_trend", F.lit("stable"))
    )


def profile_text(profile: DataFrame) -> DataFrame:
    """Descriptor text of each profile."""
    return profile.select(
        "user_id",
        user_text(
            F.col("skill_level"),
            F.col("preferred_difficulty"),
            F.col("session_count"),
            F.col("avg_solve_times_ms"),
            F.col("hint_usage_rate"),
            F.col("improvement_trend"),
            F.col("preferred_difficulty"),
        ).alias("text"),
    )

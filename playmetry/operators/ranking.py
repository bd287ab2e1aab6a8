"""Ranks, versions, rolling metrics, streaks and running counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from playmetry.functions.scoring import win_rate
from playmetry.functions.text import message_prep, toxicity_keywords
from playmetry.operators.frames import both_sides, top_per_key
from playmetry.operators.joins import DEFAULT_RATING, friend_edges
from playmetry.scale import moment, ordered_positions


def _n() -> Column:
    return F.count(F.lit(1))


def _day(value) -> Column:
    return F.lit(str(value)).cast("date")


def _top_ranked(df: DataFrame, order: Sequence[Column], top: int) -> DataFrame:
    """Number the first `top` rows. The sort is a distributed top-n; only its `top`
    rows reach the unpartitioned window."""
    best = df.orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def leaderboard_snapshot(trends: DataFrame, day, top: int = 100, mode: str = "latest") -> DataFrame:
    """Top players by rating up to `day`.

    `latest` ranks each player once, at the rating of the last date. `reference` groups
    by (player, end-of-day rating), so an old high rating of a player keeps its place.
    """
    until = trends.where(F.col("date") <= _day(day))
    if mode == "latest":
        grouped = until.groupBy("user_id").agg(
            F.max_by("elo_end", "date").alias("elo_rating"),
            F.sum("wins").alias("wins"),
            F.sum("losses").alias("losses"),
        )
    elif mode == "reference":
        grouped = until.groupBy("user_id", F.col("elo_end").alias("elo_rating")).agg(
            F.sum("wins").alias("wins"), F.sum("losses").alias("losses")
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    order = [F.col("elo_rating").desc(), F.col("user_id").asc()]
    return _top_ranked(grouped, order, top).select(
        _day(day).alias("snapshot_date"), "rank", "user_id", "elo_rating", "wins", "losses"
    )


def global_rank(ratings: DataFrame, id_bucket: Column | None = None) -> DataFrame:
    """Rank and win rate of every player, by rating and then id.

    Players are counted per rating, and per `id_bucket` inside a rating; only those
    counts are summed in order. A rating that a third of the players share (the starting
    value) is numbered in many tasks. The default bucket suits numeric ids.
    """
    bucket = F.floor(F.col("user_id") / 10_000) if id_bucket is None else id_bucket
    ranked = ordered_positions(
        ratings, [], -F.col("elo_rating"), [F.col("user_id").asc()], "rank", fine=bucket
    )
    return ranked.select(
        "user_id",
        "elo_rating",
        "wins",
        "losses",
        win_rate(F.col("wins"), F.col("losses")).alias("win_rate"),
        F.col("rank").cast("long").alias("rank"),
    )


def friends_leaderboard(friendships: DataFrame, users: DataFrame, ratings: DataFrame) -> DataFrame:
    """Each user with their friends, ranked by rating."""
    me = users.select(F.col("id").alias("user_id"), F.col("id").alias("member_id"))
    circle = me.unionByName(friend_edges(friendships).withColumnRenamed("friend_id", "member_id"))
    people = users.select(F.col("id").alias("member_id"), "username")
    rated = ratings.select(F.col("user_id").alias("member_id"), "elo_rating", "wins", "losses")
    zero = F.lit(0).cast("long")
    board = (
        circle.join(people, "member_id")
        .join(rated, "member_id", "left")
        .select(
            "user_id",
            "member_id",
            "username",
            F.coalesce("elo_rating", F.lit(DEFAULT_RATING)).alias("elo_rating"),
            F.coalesce("wins", zero).alias("wins"),
            F.coalesce("losses", zero).alias("losses"),
        )
    )
    # A popular player's board is numbered per rating and stretch of ids, not in one task:
    # everybody without a rating has the same one.
    numeric = isinstance(board.schema["member_id"].dataType, IntegralType)
    ranked = ordered_positions(
        board,
        ["user_id"],
        -F.col("elo_rating"),
        [F.col("elo_rating").desc(), F.col("member_id").asc()],
        "rank",
        fine=F.floor(F.col("member_id") / 256) if numeric else F.substring("member_id", 1, 2),
    )
    return ranked.select(
        "user_id",
        "rank",
        "member_id",
        "username",
        "elo_rating",
        win_rate(F.col("wins"), F.col("losses")).alias("win_rate"),
        (F.col("member_id") == F.col("user_id")).alias("is_me"),
    )


def score_leaderboard(scores: DataFrame, difficulty: str | None = None, k: int = 10) -> DataFrame:
    """Best `k` scores per difficulty."""
    rows = scores if difficulty is None else scores.where(F.col("difficulty") == difficulty)
    order = [F.col("points").desc(), F.col("time_elapsed_ms").asc(), F.col("id").asc()]
    return top_per_key(rows, ["difficulty"], order, k)


FEATURE_KEY = ["entity_id", "entity_type", "feature_group"]


def next_feature_version(features: DataFrame) -> DataFrame:
    return features.groupBy(*FEATURE_KEY).agg(
        (F.coalesce(F.max("feature_version"), F.lit(0)) + 1).cast("int").alias("next_version")
    )


def current_features(features: DataFrame) -> DataFrame:
    """Newest version of each entity and group."""
    rest = [c for c in features.columns if c not in FEATURE_KEY and c != "is_current"]
    # An aggregate, not a window: versions combine on the map side.
    newest = F.max_by(F.struct(*rest), "feature_version").alias("__row")
    return features.groupBy(*FEATURE_KEY).agg(newest).select(*FEATURE_KEY, "__row.*", F.lit(True).alias("is_current"))


def feature_history(features: DataFrame, entity_id, entity_type: str, group: str, n: int = 10) -> DataFrame:
    """Newest `n` versions of one entity."""
    mine = features.where(
        (F.col("entity_id") == F.lit(entity_id))
        & (F.col("entity_type") == entity_type)
        & (F.col("feature_group") == group)
    )
    return mine.orderBy(F.col("feature_version").desc()).limit(n)


def rolling_model_metrics(predictions: DataFrame, bucket: Column, n: int = 1000) -> DataFrame:
    """Means over the last `n` predictions of the model, at every prediction.

    `bucket` is an ascending time bucket. Predictions get their place within the model,
    places are cut into blocks of several windows, and each block takes the n - 1 rows
    before it along, so one busy model runs in many tasks.
    """
    block_rows = max(20 * n, 1000)
    order = [F.col("ts"), F.col("prediction_id")]
    slim = predictions.select(
        "prediction_id", "model", "ts", "latency_ms", "confidence", "predicted", "actual"
    )
    placed = ordered_positions(slim, ["model"], bucket, order, "place")
    block = F.floor((F.col("place") - 1) / block_rows)
    next_block = F.floor((F.col("place") - 1 + (n - 1)) / block_rows)
    spread = placed.withColumn("__own", block).withColumn(
        "__block", F.explode(F.array_distinct(F.array(block, next_block)))
    )
    # Sums over a window are differences of running sums. Its maximum is that of two runs in
    # stretches of n places: up to the row in its own, and from the window's start on in the one before.
    w = Window.partitionBy("model", "__block").orderBy("place")
    stretch = Window.partitionBy("model", "__block", "__stretch")
    upto = (Window.unboundedPreceding, 0)
    summed = {
        "latency": F.col("latency_ms"),
        "latencies": F.col("latency_ms").isNotNull().cast("int"),
        "confidence": F.col("confidence"),
        "confidences": F.col("confidence").isNotNull().cast("int"),
        "labelled": F.col("actual").isNotNull().cast("int"),
        "right": F.coalesce((F.col("predicted") == F.col("actual")).cast("int"), F.lit(0)),
    }
    running = spread.withColumn("__stretch", F.floor((F.col("place") - 1) / n)).select(
        "prediction_id",
        "model",
        "place",
        "__block",
        (F.col("__own") == F.col("__block")).alias("__keep"),
        F.max("latency_ms").over(stretch.orderBy("place").rowsBetween(*upto)).alias("__front"),
        F.max("latency_ms").over(stretch.orderBy(F.col("place").desc()).rowsBetween(*upto)).alias("__back"),
        *[F.coalesce(F.sum(v).over(w.rowsBetween(*upto)), F.lit(0)).alias(f"__{name}") for name, v in summed.items()],
    )

    def total(name: str) -> Column:
        return F.col(f"__{name}") - F.coalesce(F.lag(f"__{name}", n).over(w), F.lit(0))

    rolled = running.select(
        "prediction_id",
        "model",
        "place",
        "__keep",
        F.least("place", F.lit(n)).cast("long").alias("window_rows"),
        (total("latency") / F.nullif(total("latencies"), F.lit(0))).alias("mean_ms"),
        F.greatest("__front", F.lag("__back", n - 1).over(w)).alias("max_ms"),
        (total("confidence") / F.nullif(total("confidences"), F.lit(0))).alias("mean_confidence"),
        (total("right") / F.nullif(total("labelled"), F.lit(0))).alias("accuracy"),
    )
    return rolled.where("__keep").drop("__keep")


def calendar_streaks(play_days: DataFrame, as_of) -> DataFrame:
    """Per user: current and longest run of consecutive days, and the last day played.

    Days are made distinct first, so a user adds at most one row per calendar day. A run
    is current while its last day is `as_of` or the day before.
    """
    days = play_days.select("user_id", F.col("day").cast("date").alias("day")).distinct()
    w = Window.partitionBy("user_id").orderBy("day")
    runs = (
        days.withColumn("__run", F.date_sub("day", F.row_number().over(w)))
        .groupBy("user_id", "__run")
        .agg(_n().alias("length"), F.max("day").alias("last_day"))
    )
    now = _day(as_of)
    alive = F.col("last_day") >= F.date_sub(now, 1)
    return runs.groupBy("user_id").agg(
        F.coalesce(F.max(F.when(alive, F.col("length"))), F.lit(0).cast("long")).alias("current_streak"),
        F.max("length").alias("longest_streak"),
        F.max("last_day").alias("last_day"),
    )


def mute_after_warnings(messages: DataFrame, limit: int = 3) -> DataFrame:
    """Fate of every chat message: delivered, blocked with its warning number, the one that
    mutes, or dropped because its sender is muted already. Blank messages are ignored.

    Only the first `limit` toxic messages of a (room, user) matter. They are found by a
    ranked limit that runs before the shuffle, folded to one row, and joined back, so no
    sender's messages have to meet in one window.
    """
    text = message_prep(F.col("text"))
    prepared = (
        messages.withColumn("text", text)
        .where(F.col("text").isNotNull())
        .withColumn("is_toxic", toxicity_keywords(F.col("text"))["is_toxic"])
    )
    firsts = top_per_key(
        prepared.where("is_toxic").select("room_id", "user_id", "seq"),
        ["room_id", "user_id"],
        [F.col("seq").asc()],
        limit,
        "warning",
    )
    warnings = firsts.groupBy("room_id", "user_id").agg(
        *[F.max(F.when(F.col("warning") == i, F.col("seq"))).alias(f"__w{i}") for i in range(1, limit + 1)]
    )
    joined = prepared.join(warnings, ["room_id", "user_id"], "left")
    muted_at = F.col(f"__w{limit}")
    given = F.lit(0)
    for i in range(1, limit + 1):
        given = given + F.coalesce((F.col(f"__w{i}") <= F.col("seq")).cast("int"), F.lit(0))
    fate = (
        F.when(F.col("seq") > muted_at, "dropped")
        .when(F.col("seq") == muted_at, "muted")
        .when(F.col("is_toxic"), "blocked")
        .otherwise("delivered")
    )
    return joined.select("room_id", "user_id", "seq", "is_toxic", given.alias("warnings"), fate.alias("fate"))


def last_messages(messages: DataFrame, n: int = 50) -> DataFrame:
    return top_per_key(messages, ["room_id"], [F.col("seq").desc()], n)


def elo_trend_for_player(trends: DataFrame, user, n_days: int, as_of) -> DataFrame:
    mine = trends.where((F.col("user_id") == F.lit(user)) & (F.col("date") >= F.date_sub(_day(as_of), n_days)))
    return mine.orderBy("date")


def first_touch_features(matches: DataFrame) -> DataFrame:
    """First rating before and last rating after of each player over the whole history."""
    sides = both_sides(matches)
    at = moment(sides, "completed_at", "match_id")
    return (
        sides.groupBy("user_id")
        .agg(
            F.min_by("elo_before", at).alias("elo_start"),
            F.max_by("elo_after", at).alias("elo_end"),
            _n().alias("matches_played"),
        )
    )

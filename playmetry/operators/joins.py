"""Joins. Many-row sides are reduced to one row per key before they meet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmetry.functions import vocab
from playmetry.functions.scoring import cluster_difficulties, lookup, win_rate
from playmetry.operators.frames import recommend_recent_puzzles, top_per_key
from playmetry.scale import ordered_positions

DEFAULT_RATING = 1200


def dau_with_new_users(sessions: DataFrame, users: DataFrame, day=None) -> DataFrame:
    """Per date: distinct active users, and those of them created that day."""
    days = sessions.select(F.to_date("started_at").alias("date"), "user_id")
    if day is not None:
        days = days.where(F.col("date") == F.lit(str(day)).cast("date"))
    active = days.distinct()
    known = users.select(F.col("id").alias("user_id"), F.to_date("created_at").alias("__created"))
    return (
        active.join(known, "user_id")
        .groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("user_count"),
            F.count_if(F.col("__created") == F.col("date")).alias("new_user_count"),
        )
    )


def user_session_left(users: DataFrame, streaks: DataFrame, session_aggs: DataFrame) -> DataFrame:
    """Every user with streak and pre-aggregated session columns, NULL where there are none."""
    return (
        users.select(F.col("id").alias("user_id"))
        .join(streaks, "user_id", "left")
        .join(session_aggs, "user_id", "left")
    )


def enrich_leaderboard(ids: DataFrame, users: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ids with user and rating columns; ids missing in either are dropped."""
    return (
        ids.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
        .join(ratings.select("user_id", "elo_rating", "wins", "losses"), "user_id")
        .withColumn("win_rate", win_rate(F.col("wins"), F.col("losses")))
    )


def batch_read(features: DataFrame, ids: DataFrame, entity_type: str, group: str) -> DataFrame:
    """Current features of the listed entities."""
    current = features.where(
        F.col("is_current")
        & (F.col("entity_type") == entity_type)
        & (F.col("feature_group") == group)
    )
    return current.join(ids, "entity_id", "left_semi")


def queue_if_absent(scored: DataFrame, queue: DataFrame, threshold: float = 0.7) -> DataFrame:
    """High-risk users without a waiting, un-notified entry."""
    waiting = queue.where(~F.col("notified")).select("user_id")
    return scored.where(F.col("churn_prob") >= threshold).join(waiting, "user_id", "left_anti")


def friend_edges(friendships: DataFrame) -> DataFrame:
    """Accepted edges in both directions, from one scan."""
    both = F.array(
        F.struct(F.col("requester_id").alias("user_id"), F.col("addressee_id").alias("friend_id")),
        F.struct(F.col("addressee_id").alias("user_id"), F.col("requester_id").alias("friend_id")),
    )
    accepted = friendships.where(F.col("status") == "accepted")
    return accepted.select(F.explode(both).alias("e")).select("e.*").distinct()


def friends_of(friendships: DataFrame, users: DataFrame, ratings: DataFrame) -> DataFrame:
    """(user, friend) with the friend's name and rating."""
    names = users.select(F.col("id").alias("friend_id"), F.col("username").alias("friend_name"))
    rated = ratings.select(F.col("user_id").alias("friend_id"), "elo_rating")
    return (
        friend_edges(friendships)
        .join(names, "friend_id")
        .join(rated, "friend_id", "left")
        .select(
            "user_id",
            "friend_id",
            "friend_name",
            F.coalesce("elo_rating", F.lit(DEFAULT_RATING)).alias("elo_rating"),
        )
    )


def fan_out_activity(activities: DataFrame, friendships: DataFrame) -> DataFrame:
    """Each activity to its owner and to every accepted friend of its actor, once per user."""
    edges = friend_edges(friendships).select(
        F.col("user_id").alias("actor_id"), F.col("friend_id").alias("audience_id")
    )
    core = activities.select("activity_id", "actor_id", "owner_id", "type")
    # Edges are distinct, so only the owner can occur twice: a friend equal to the owner is left out.
    to_friends = core.join(edges, "actor_id").where(F.col("audience_id") != F.col("owner_id"))
    to_owner = core.withColumn("audience_id", F.col("owner_id"))
    columns = ["activity_id", "actor_id", "type", "audience_id"]
    return to_friends.select(*columns).unionByName(to_owner.select(*columns))


def exclude_seen(candidates: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Best `k` candidates of each user that the user has not had yet."""
    fresh = candidates.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return top_per_key(fresh, ["user_id"], [F.col("score").desc(), F.col("item_id").asc()], k)


def session_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_games"),
        F.count_if(F.col("status") == "completed").alias("completed_games"),
    )


def user_drilldown(users: DataFrame, streaks: DataFrame, sessions: DataFrame, cluster=None) -> DataFrame:
    """Users with streak columns and game counts, optionally of one skill label."""
    chosen = users if cluster is None else users.where(F.col("skill_cluster") == cluster)
    chosen = chosen.select(F.col("id").alias("user_id"), "username", "skill_cluster", "created_at")
    flames = streaks.select("user_id", "current_streak", "longest_streak")
    return (
        chosen.join(flames, "user_id", "left")
        .join(session_counts(sessions), "user_id", "left")
        .select(
            *chosen.columns,
            *[
                F.coalesce(c, F.lit(0).cast("long")).alias(c)
                for c in ("current_streak", "longest_streak", "total_games", "completed_games")
            ],
        )
    )


def self_join_ratings(matches: DataFrame, ratings: DataFrame, default: int = DEFAULT_RATING) -> DataFrame:
    """Matches with both players' current ratings."""

    def of(side: str) -> DataFrame:
        return ratings.select(
            F.col("user_id").alias(f"{side}_id"), F.col("elo_rating").alias(f"{side}_rating")
        )

    joined = matches.select("match_id", "winner_id", "loser_id")
    for side in ("winner", "loser"):
        joined = joined.join(of(side), f"{side}_id", "left").withColumn(
            f"{side}_rating", F.coalesce(f"{side}_rating", F.lit(default))
        )
    return joined


def reconnect_or_forfeit(
    disconnects: DataFrame, reconnects: DataFrame, rooms: DataFrame, secs: int = 30
) -> DataFrame:
    """Outcome of each disconnect: reconnected within `secs`, else the opponent wins.

    The range condition becomes an equi-join: both sides are cut into slots of `secs`
    seconds, and a disconnect looks into its own slot and the next one. The slot is part
    of the key, so a busy player is spread over time.
    """
    slot = F.floor(F.unix_micros("ts") / F.lit(secs * 1_000_000)).cast("long")
    returned = reconnects.select(
        "room_id", "user_id", F.col("ts").alias("back_at"), slot.alias("slot")
    )
    gone = disconnects.select("room_id", "user_id", "ts").distinct()
    probe = gone.withColumn("slot", F.explode(F.array(slot, slot + 1)))
    hits = (
        probe.join(returned, ["room_id", "user_id", "slot"])
        .where(
            (F.col("back_at") > F.col("ts"))
            & (F.col("back_at") <= F.col("ts") + F.expr(f"INTERVAL {secs} SECONDS"))
        )
        .groupBy("room_id", "user_id", "ts")
        .agg(F.min("back_at").alias("back_at"))
    )
    joined = gone.join(hits, ["room_id", "user_id", "ts"], "left").join(
        rooms.select("room_id", "player_a", "player_b"), "room_id", "left"
    )
    opponent = F.when(F.col("player_a") == F.col("user_id"), F.col("player_b")).otherwise(F.col("player_a"))
    lost = F.col("back_at").isNull()
    return joined.select(
        "room_id",
        "user_id",
        "ts",
        "back_at",
        F.when(lost, "forfeited").otherwise("reconnected").alias("outcome"),
        F.when(lost, opponent).alias("winner_id"),
    )


def match_fifo(
    queue: DataFrame, bucket: Column, chunk_rows: int = 200_000, on_pass: Callable[[int, int], None] | None = None
) -> DataFrame:
    """Pairs of the waiting queue: an arrival is matched with the longest-waiting other
    player of its difficulty, or waits.

    `bucket` is an ascending time bucket of `enqueued_at` used to number the arrivals.
    Each difficulty is cut into chunks of `chunk_rows` arrivals that run in parallel from
    an empty queue. Then, per difficulty, the first chunk whose predecessor left somebody
    waiting is run again with that start, and so on down the chunks, so a chunk runs twice
    at most. A rerun usually leaves what the first run left, and then the chunks after it
    stand. One count per chunk comes to the driver. `on_pass(number, chunks)` is told how many
    chunks each pass ran.
    """
    numbered = (
        ordered_positions(
            queue.select("difficulty", "entry_id", "user_id", "enqueued_at"),
            ["difficulty"],
            bucket,
            [F.col("enqueued_at"), F.col("entry_id")],
        )
        .withColumn("chunk", F.floor((F.col("position") - 1) / chunk_rows).cast("long"))
        .select("difficulty", "chunk", "position", "entry_id", "user_id")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    tell = on_pass or (lambda number, chunks: None)

    def among(cells: set) -> Column:
        """Rows of these (difficulty, chunk) cells, one per difficulty at most."""
        return reduce(lambda a, b: a | b, [F.col("difficulty").eqNullSafe(F.lit(d)) & (F.col("chunk") == c) for d, c in cells])

    def left_by(run: DataFrame) -> dict:
        """Who each chunk leaves waiting, as a hash; chunks that leave nobody have none."""
        mark = F.when(F.col("kind") == "waiting", F.xxhash64("position", "first_entry", "first_user").cast("decimal(38,0)"))
        rows = run.groupBy("difficulty", "chunk").agg(F.sum(mark).alias("left")).collect()
        return {(r["difficulty"], r["chunk"]): r["left"] for r in rows}

    run = numbered.groupBy("difficulty", "chunk").applyInPandas(_pair_chunk, _PAIR_SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
    left = left_by(run)
    tell(1, len(left))
    started: dict = {}  # what each chunk was started with, where that was not an empty queue
    passes = 1
    while True:
        due: dict = {}
        for d, c in sorted(left, key=lambda k: (str(k[0]), k[1])):
            if c and d not in due and left.get((d, c - 1)) != started.get((d, c)):
                due[d] = c
        if not due:
            break
        cells = {(d, c) for d, c in due.items()}
        # Entries still waiting from the chunk before keep their earlier position.
        starts = run.where("kind = 'waiting'").where(among({(d, c - 1) for d, c in cells})).select(
            "difficulty",
            (F.col("chunk") + 1).alias("chunk"),
            "position",
            F.col("first_entry").alias("entry_id"),
            F.col("first_user").alias("user_id"),
        )
        fed = numbered.where(among(cells)).unionByName(starts)
        again = fed.groupBy("difficulty", "chunk").applyInPandas(_pair_chunk, _PAIR_SCHEMA)
        again = again.persist(StorageLevel.MEMORY_AND_DISK)
        for d, c in cells:
            started[(d, c)] = left.get((d, c - 1))
        left |= left_by(again)
        run = run.where(~among(cells)).unionByName(again)
        passes += 1
        tell(passes, len(cells))
    return run.where("kind = 'pair'").select(
        "difficulty", "first_entry", "first_user", "second_entry", "second_user"
    )


_PAIR_SCHEMA = (
    "difficulty string, chunk long, position long, kind string, first_entry long, first_user long, "
    "second_entry long, second_user long"
)


def _pair_chunk(key, rows):
    """Pair one chunk in arrival order. Everyone waiting at a time is the same player,
    because any other arrival would have been paired at once."""
    from collections import deque

    import pandas as pd

    difficulty, chunk = key
    rows = rows.sort_values("position")
    waiting: deque = deque()
    out = []
    for position, entry, user in zip(rows["position"], rows["entry_id"], rows["user_id"]):
        if waiting and waiting[0][2] != user:
            _, first_entry, first_user = waiting.popleft()
            out.append((difficulty, chunk, position, "pair", first_entry, first_user, entry, user))
        else:
            waiting.append((position, entry, user))
    out += [(difficulty, chunk, p, "waiting", e, u, None, None) for p, e, u in waiting]
    columns = [c.split()[0] for c in _PAIR_SCHEMA.split(", ")]
    return pd.DataFrame(out, columns=columns).astype(
        {c: "Int64" for c in columns if c.endswith(("entry", "user"))}
    )


def pending_requests(friendships: DataFrame, users: DataFrame) -> DataFrame:
    """Open requests to each user with the requester's name, newest first."""
    names = users.select(F.col("id").alias("requester_id"), F.col("username").alias("requester_name"))
    pending = friendships.where(F.col("status") == "pending")
    return (
        pending.join(names, "requester_id")
        .select(F.col("addressee_id").alias("user_id"), "friendship_id", "requester_id", "requester_name", "created_at")
        .orderBy(F.col("created_at").desc(), F.col("friendship_id"))
    )


def home_view(users: DataFrame, streaks: DataFrame, daily: DataFrame, puzzles: DataFrame, day) -> DataFrame:
    """Start page of every user: label, message, levels, streak, daily puzzle, suggestions."""
    today = (
        daily.where(F.col("date") == F.lit(str(day)).cast("date"))
        .select(F.struct("puzzle_id", "difficulty"))
        .limit(1)  # one puzzle per date
        .scalar()
    )
    # Suggestions: at most six rows per user.
    picks = (
        recommend_recent_puzzles(users, puzzles)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "puzzle_id"))).alias("picks"))
    )
    label = F.col("skill_cluster")
    message = F.when(label.isNull(), vocab.CLUSTER_MESSAGE_NONE).otherwise(
        lookup(label, vocab.CLUSTER_MESSAGES, vocab.CLUSTER_MESSAGE_OTHER)
    )
    return (
        users.select(
            F.col("id").alias("user_id"),
            "skill_cluster",
            message.alias("cluster_message"),
            F.array_join(cluster_difficulties(label), ",").alias("recommended"),
        )
        .join(streaks.select("user_id", "current_streak", "longest_streak"), "user_id", "left")
        .join(picks, "user_id", "left")
        .withColumn("__today", today)
        .withColumn("daily_puzzle_id", F.col("__today.puzzle_id"))
        .withColumn("daily_difficulty", F.col("__today.difficulty"))
        .withColumn(
            "picks",
            F.array_join(F.transform("picks", lambda p: p["puzzle_id"].cast("string")), ","),
        )
        .drop("__today")
    )


def friendship_state(requests: DataFrame) -> DataFrame:
    """Current status of each unordered pair from its request log.

    A block is final, an acceptance outlives later requests, and a declined pair may be
    opened again by a later request; otherwise the latest entry counts.
    """
    pair = [
        F.least("requester_id", "addressee_id").alias("user_a"),
        F.greatest("requester_id", "addressee_id").alias("user_b"),
    ]
    status = F.col("status")
    newest = F.max_by(status, F.struct("ts", "request_id"))
    return (
        requests.groupBy(*pair)
        .agg(
            F.bool_or(status == "blocked").alias("__blocked"),
            F.bool_or(status == "accepted").alias("__accepted"),
            newest.alias("__latest"),
            F.max("ts").alias("updated_at"),
        )
        .select(
            "user_a",
            "user_b",
            F.when(F.col("__blocked"), "blocked")
            .when(F.col("__accepted"), "accepted")
            .otherwise(F.col("__latest"))
            .alias("status"),
            "updated_at",
        )
    )

"""The provided tables under the names and types of the game schema.

Each function takes (spark, folder) and is lazy; a query reads only the columns and rows
it uses. `VIEWS` in `oracle.py` states the same bindings in plain SQL.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playmetry.functions.ids import ab_bucket, daily_rotation, date_key, pseudonymise
from playmetry.functions.scoring import elo_update, lookup, risk_level, session_score
from playmetry.functions.text import toxicity_keywords
from playmetry.functions.vocab import LESSONS, TIER_XP
from playmetry.operators.boards import let
from playmetry.operators.ranking import calendar_streaks
from playmetry.scale import moment
from playmetry.streaming.enrich import enrich_sessions

SESSIONS_AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-31"
HASH_KEY = b"binding-key"

STATUS = {"F": "completed", "O": "in_progress", "P": "abandoned"}
PRIORITY_LEVEL = {
    "1-URGENT": "super_hard",
    "2-HIGH": "hard",
    "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "easy",
    "5-LOW": "super_easy",
}
SEGMENT_LABEL = {
    "AUTOMOBILE": "Beginner",
    "BUILDING": "Casual",
    "FURNITURE": "Intermediate",
    "HOUSEHOLD": "Advanced",
    "MACHINERY": "Expert",
}
PART_LEVEL = {
    "ECONOMY": "super_easy",
    "PROMO": "easy",
    "STANDARD": "medium",
    "SMALL": "hard",
    "MEDIUM": "super_hard",
    "LARGE": "extreme",
}
EVENT_LEVEL = {
    "view": "super_easy",
    "click": "easy",
    "signup": "medium",
    "purchase": "hard",
    "error": "super_hard",
}
END_REASONS = ["completed", "forfeit", "disconnect", "timeout"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(spark: SparkSession, name: str) -> str:
    """A new path in the folder that `spark.checkpoint.dir` names, for tables a query writes and reads.

    Only a local session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        named = "file://" + tempfile.mkdtemp(prefix="tables-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    first = orders(spark, folder).groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("created_at"))
    people = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_custkey") % 11 != 0, lookup(F.col("c_mktsegment"), SEGMENT_LABEL)).alias("skill_cluster"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("tok-"), F.col("c_custkey").cast("string"))).alias("fcm_token"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )
    return people.join(first, "id", "left")


def people(spark: SparkSession, folder: str) -> DataFrame:
    """Users without the first-session date: no order scan."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.when(F.col("c_custkey") % 11 != 0, lookup(F.col("c_mktsegment"), SEGMENT_LABEL)).alias("skill_cluster"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("tok-"), F.col("c_custkey").cast("string"))).alias("fcm_token"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def plain_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions without hint and error counts: no line item scan."""
    status = lookup(F.col("o_orderstatus"), STATUS)
    ms = F.col("o_totalprice").cast("long")
    started = F.col("o_orderdate")
    return orders(spark, folder).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        lookup(F.col("o_orderpriority"), PRIORITY_LEVEL).alias("difficulty"),
        ms.alias("time_elapsed_ms"),
        started.alias("started_at"),
        F.when(status == "completed", F.timestamp_millis(F.unix_millis(started) + ms)).alias("completed_at"),
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with puzzle, cells, hints, errors and score from the line items."""
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.min("l_partkey").alias("puzzle_id"),
            F.count_if(F.col("l_returnflag") == "A").alias("hints_used"),
            F.count_if(F.col("l_returnflag") == "R").alias("errors_count"),
            F.least(F.lit(60), F.sum("l_quantity").cast("long")).cast("int").alias("cells_filled"),
        )
    )
    joined = plain_sessions(spark, folder).join(lines, "id", "left")
    zero = F.lit(0).cast("long")
    counted = joined.withColumns(
        {
            "hints_used": F.coalesce("hints_used", zero),
            "errors_count": F.coalesce("errors_count", zero),
            "cells_filled": F.coalesce("cells_filled", F.lit(0)),
        }
    )
    return counted.withColumn(
        "score",
        session_score(
            F.col("difficulty"), F.col("time_elapsed_ms"), F.col("hints_used"), F.col("errors_count")
        ),
    )


def enriched_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return enrich_sessions(sessions(spark, folder))


def session_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Fact rows with the plain user id as hash column: for the aggregates, which do not care."""
    return plain_sessions(spark, folder).select(
        date_key(F.col("started_at")).alias("date_key"),
        F.col("user_id").alias("user_hash"),
        F.col("difficulty").alias("difficulty_key"),
        "status",
        "time_elapsed_ms",
    )


def session_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """Streaks of session days, with the time of the last session."""
    played = plain_sessions(spark, folder).select("user_id", F.col("started_at").alias("day"))
    return calendar_streaks(played, SESSIONS_AS_OF).withColumn(
        "last_played_date", F.col("last_day").cast("timestamp")
    )


def puzzles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        lookup(F.col("p_type"), PART_LEVEL).alias("difficulty"),
        (F.col("p_size") + 17).alias("clue_count"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 3600).alias("created_at"),
    )


def daily_puzzles(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 60).cast("int"))
    return (
        table(spark, folder, "part")
        .groupBy(day.alias("date"))
        .agg(F.min("p_partkey").alias("puzzle_id"))
        .withColumn("difficulty", daily_rotation(F.col("date")))
    )


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """Events paired by id: the larger value wins, equal values go to the earlier event."""
    larger = F.struct(F.col("value"), -F.col("event_id"))
    pairs = (
        events(spark, folder)
        .groupBy(F.floor(F.col("event_id") / 2).alias("match_id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by("user_id", larger).alias("winner_id"),
            F.min_by("user_id", larger).alias("loser_id"),
            F.max_by("event_type", larger).alias("kind"),
            F.max("ts").alias("completed_at"),
            F.min("ts").alias("__from"),
        )
        .where((F.col("n") == 2) & (F.col("winner_id") != F.col("loser_id")))
    )

    def before(who: str) -> Column:
        return (F.lit(1200) + (F.col(who) * 37) % 900).cast("int")

    reasons = F.array(*[F.lit(r) for r in END_REASONS])
    rated = pairs.withColumns(
        {"winner_elo_before": before("winner_id"), "loser_elo_before": before("loser_id")}
    ).withColumn("__elo", elo_update(F.col("winner_elo_before"), F.col("loser_elo_before")))
    return rated.select(
        "match_id",
        F.concat(F.lit("room-"), F.col("match_id").cast("string")).alias("room_id"),
        "winner_id",
        "loser_id",
        "winner_elo_before",
        F.col("__elo.winner_after").alias("winner_elo_after"),
        "loser_elo_before",
        F.col("__elo.loser_after").alias("loser_elo_after"),
        F.col("__elo.delta").alias("elo_delta"),
        lookup(F.col("kind"), EVENT_LEVEL).alias("difficulty"),
        reasons[(F.col("match_id") % 4).cast("int")].alias("end_reason"),
        (F.unix_millis("completed_at") - F.unix_millis("__from")).alias("duration_ms"),
        "completed_at",
    )


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Current rating, wins and losses of each player."""
    from playmetry.operators.frames import both_sides

    sides = both_sides(matches(spark, folder))
    return (
        sides.groupBy("user_id")
        .agg(
            F.max_by("elo_after", moment(sides, "completed_at", "match_id")).alias("elo_rating"),
            F.sum("is_win").alias("wins"),
            F.sum(F.lit(1) - F.col("is_win")).alias("losses"),
        )
    )


def friendships(spark: SparkSession, folder: str) -> DataFrame:
    """One row per pair of players that met."""
    a, b = F.least("winner_id", "loser_id"), F.greatest("winner_id", "loser_id")
    pairs = matches(spark, folder).groupBy(a.alias("a"), b.alias("b")).agg(F.min("completed_at").alias("created_at"))
    statuses = F.array(*[F.lit(s) for s in ("pending", "accepted", "declined", "blocked")])
    flip = (F.col("a") + F.col("b")) % 2 == 1
    return pairs.select(
        (F.col("a") * 1_000_000 + F.col("b")).alias("friendship_id"),
        F.when(flip, F.col("b")).otherwise(F.col("a")).alias("requester_id"),
        F.when(flip, F.col("a")).otherwise(F.col("b")).alias("addressee_id"),
        statuses[((F.col("a") * 31 + F.col("b")) % 4).cast("int")].alias("status"),
        "created_at",
    )


def friend_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A request log: one entry per match, its status by match id."""
    statuses = F.array(*[F.lit(s) for s in ("pending", "declined", "pending", "accepted", "pending", "blocked")])
    return matches(spark, folder).select(
        F.col("match_id").alias("request_id"),
        F.col("winner_id").alias("requester_id"),
        F.col("loser_id").alias("addressee_id"),
        statuses[(F.col("match_id") % 6).cast("int")].alias("status"),
        F.col("completed_at").alias("ts"),
    )


def event_streaks(spark: SparkSession, folder: str) -> DataFrame:
    played = events(spark, folder).select("user_id", F.col("ts").alias("day"))
    return calendar_streaks(played, EVENTS_AS_OF)


def api_log(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        F.col("event_id"),
        F.col("event_type").alias("service"),
        F.col("ts"),
        (F.get_json_object("props", "$.k").cast("int") % 10 == 0).alias("failed"),
        F.col("value").alias("latency_ms"),
    )


def chat(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("room_id"),
        F.col("role").alias("user_id"),
        F.col("turn").alias("seq"),
        "text",
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Texts for rules that are heavy per row."""
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword moderation of the documents against their labels; one model per language."""
    docs = documents(spark, folder).select(
        "doc_id", "lang", "n_chars", toxicity_keywords(F.col("text")).alias("t")
    )
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("prediction_id"),
        F.col("lang").alias("model"),
        F.when(F.col("t.is_toxic"), "toxic").otherwise("clean").alias("predicted"),
        name.alias("actual"),
        (F.col("t.confidence") - (F.col("doc_id") % 10) * F.lit(0.08)).alias("confidence"),
        F.col("n_chars").cast("double").alias("latency_ms"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("ts"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.array(
        F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string")),
        F.concat(F.lit("u"), (F.col("vec_id") % 5).cast("string")),
    )
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label", (F.col("label") % 5 + 1).alias("level"), tags.alias("tags")
    )


def experiment_config(spark: SparkSession, folder: str) -> DataFrame:
    """One experiment per region; one is paused, one has ended."""
    key = F.col("r_regionkey")
    name = F.lower("r_name")
    return table(spark, folder, "region").where(key != 2).select(
        F.concat(F.lit("exp_"), name).alias("experiment_name"),
        F.concat(F.lit("model_"), name).alias("model_name"),
        F.lit("Production").alias("control_variant"),
        F.lit("Staging").alias("treatment_variant"),
        (key * 0.2 + 0.09).alias("traffic_split"),
        F.when(key == 3, "paused").otherwise("active").alias("status"),
        F.when(key == 4, F.lit("2020-01-01").cast("timestamp")).alias("end_date"),
    )


def experiment_users(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return (
        table(spark, folder, "customer")
        .select("c_custkey", "c_nationkey")
        .join(nation, "c_nationkey")
        .join(region, "n_regionkey")
        .select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("exp_"), F.lower("r_name")).alias("experiment_name"))
    )


def experiment_results(spark: SparkSession, folder: str) -> DataFrame:
    name = F.lit("exp_events")
    return events(spark, folder).select(
        name.alias("experiment_name"),
        "user_id",
        F.when(ab_bucket(F.col("user_id"), name) < 50, "treatment").otherwise("control").alias("variant"),
        F.col("event_type").alias("metric_name"),
        F.col("value").alias("metric_value"),
    )


def feature_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Unversioned snapshots: one per user, event type and day."""
    return (
        events(spark, folder)
        .groupBy(
            F.col("user_id").alias("entity_id"),
            F.lit("user").alias("entity_type"),
            F.col("event_type").alias("feature_group"),
            F.date_trunc("day", "ts").alias("computed_at"),
        )
        .agg(F.count(F.lit(1)).alias("row_count"), F.max("value").alias("peak"))
        .withColumn(
            "features", F.to_json(F.create_map(F.lit("n"), F.col("row_count").cast("double"), F.lit("peak"), F.col("peak")))
        )
    )


def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Versioned snapshots; days are few per entity."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id", "entity_type", "feature_group")
    return feature_snapshots(spark, folder).select(
        "entity_id",
        "entity_type",
        "feature_group",
        F.row_number().over(w.orderBy("computed_at")).alias("feature_version"),
        "features",
        (F.col("computed_at") == F.max("computed_at").over(w)).alias("is_current"),
        "computed_at",
    )


def re_engagement_queue(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    prob = (key * 7919 % 1000) / F.lit(1000.0)
    return table(spark, folder, "customer").where(key % 5 == 0).select(
        key.alias("id"),
        key.alias("user_id"),
        prob.alias("churn_prob"),
        risk_level(prob).alias("risk_level"),
        (key % 10 == 0).alias("notified"),
        F.timestamp_seconds(F.lit(1704067200) + key * 60).alias("created_at"),
    )


def lesson_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Lessons by session id; a lesson is complete when one of its sessions was."""
    index = (F.col("id") % len(LESSONS)).cast("int")
    names = F.array(*[F.lit(n) for n, _ in LESSONS])
    rewards = F.array(*[F.lit(TIER_XP[t]) for _, t in LESSONS])
    done = F.col("status") == "completed"
    return (
        plain_sessions(spark, folder)
        .groupBy("user_id", index.alias("i"))
        .agg(
            F.count(F.lit(1)).alias("steps_complete"),
            F.bool_or(done).alias("completed"),
            F.min(F.when(done, F.col("started_at"))).alias("started_at"),
            F.min("completed_at").alias("completed_at"),
        )
        .select(
            "user_id",
            names[F.col("i")].alias("lesson_id"),
            "steps_complete",
            "completed",
            "started_at",
            "completed_at",
            F.when(F.col("completed"), rewards[F.col("i")]).otherwise(0).cast("int").alias("xp_awarded"),
        )
    )


def onboarding(spark: SparkSession, folder: str) -> DataFrame:
    return plain_sessions(spark, folder).where("user_id % 4 <> 0").groupBy("user_id").agg(
        F.min("started_at").alias("started_at"),
        F.count(F.lit(1)).alias("steps_seen"),
        F.bool_or(F.col("status") == "completed").alias("completed"),
        F.bool_and(F.col("status") == "abandoned").alias("skipped"),
    )


def queue_events(spark: SparkSession, folder: str) -> DataFrame:
    return plain_sessions(spark, folder).select(
        F.col("id").alias("entry_id"), "user_id", "difficulty", F.col("started_at").alias("enqueued_at")
    )


def histogram_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative latency histogram per service, from one scan."""
    bounds = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, float("inf")]
    counts = api_log(spark, folder).groupBy("service").agg(
        *[F.count_if(F.col("latency_ms") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    )
    entries = F.array(
        *[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)]
    )
    return counts.select("service", F.explode(entries).alias("e")).select("service", "e.le", "e.count")


def boards(spark: SparkSession, folder: str) -> DataFrame:
    """Board and solution per part. Blanks and wrong cells follow the digits of a checksum of
    the part's name, so boards differ row by row: every fourth one may conflict, every
    sixteenth is full, every thirty-second is full and right."""
    k = F.col("p_partkey").cast("int")
    # Row 3 * (r % 3) + r / 3 of the first column's digits, moved on by the column; the part moves it on.
    moved = F.expr(f"array({', '.join(f'{3 * (i // 9 % 3) + i // 27 + i % 9}L' for i in range(81))})")
    solution = F.transform(moved, lambda v: ((v + F.col("p_partkey")) % 9 + 1).cast("int"))
    digits = F.transform(F.split("checksum", ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    # What a row has once is bound outside the loop over its cells.
    once = F.struct(solution.alias("solution"), digits.alias("digits"), (k % 4 == 0).alias("wrong"), (k % 16 != 0).alias("blank"))

    def shown(x: Column) -> Column:
        def cell(v: Column, i: Column) -> Column:
            wrong = x["digits"][(i * 5).bitwiseAND(31)] == 15
            blank = (x["digits"][i.bitwiseAND(31)] + F.shiftright(i, 5) * 5) % 16 < 7
            return F.when(x["wrong"] & wrong, v % 9 + 1).when(x["blank"] & blank, 0).otherwise(v)

        return F.transform(x["solution"], cell)

    checksum = F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("-"), F.col("p_name"))).alias("checksum")
    # The rules are heavy per row and a key with its checksum is small, so they are dealt out first,
    # into as many tasks as any shuffle has; without a number adaptive execution would gather them again.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, folder, "part").select("p_partkey", checksum).repartition(tasks, "p_partkey").select(
        F.col("p_partkey").alias("puzzle_id"),
        F.when(k % 32 == 0, solution).otherwise(let(once, shown)).alias("board"),
        solution.alias("solution"),
    )


def fact_sessions(spark: SparkSession, folder: str, key: bytes = HASH_KEY) -> DataFrame:
    from playmetry.operators.warehouse import fact_session_rows

    return fact_session_rows(sessions(spark, folder), key)


def hashed(col: str, key: bytes = HASH_KEY) -> Column:
    return pseudonymise(F.col(col), key)



"""Star-schema load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmetry.functions import vocab
from playmetry.functions.ids import date_key, pseudonymise
from playmetry.functions.scoring import lookup
from playmetry.sources.stores import KeyedTable, append_counted
from playmetry.sources.tables import insert_ignore, upsert_replace


def load_dim_user(users: DataFrame, existing: DataFrame | None, key: bytes) -> DataFrame:
    """Pseudonymised users after the upsert."""
    new = dim_user_rows(users, key)
    if existing is None:
        existing = new.limit(0)
    return upsert_replace(new, existing, ["user_hash"], _first_created())


def dim_user_rows(users: DataFrame, key: bytes) -> DataFrame:
    """Pseudonymised users as the dimension holds them, before the upsert."""
    return users.select(
        pseudonymise(F.col("id"), key).alias("user_hash"),
        F.col("skill_cluster").alias("skill_segment"),
        date_key(F.col("created_at")).alias("created_date_key"),
        F.coalesce(F.col("is_active"), F.lit(True)).alias("is_active"),
    )


def _first_created() -> list[Column]:
    return [F.col("created_date_key").asc_nulls_last()]


def upsert_dim_user(users: DataFrame, table: KeyedTable, key: bytes) -> list[int]:
    """The same upsert into a stored table; only the buckets of these users are rewritten."""
    return table.upsert(dim_user_rows(users, key), _first_created())


def load_dim_puzzle(
    puzzles: DataFrame, existing: DataFrame | None, key: bytes, default_created: Column
) -> DataFrame:
    """Puzzle rows to append."""
    new = puzzles.select(
        pseudonymise(F.col("id"), key).alias("puzzle_hash"),
        F.col("difficulty").alias("difficulty_key"),
        F.col("clue_count"),
        F.coalesce(F.col("created_at"), default_created).alias("created_at"),
    )
    if existing is None:
        existing = new.limit(0)
    return insert_ignore(new, existing, ["puzzle_hash"], [F.col("created_at"), F.col("clue_count")])


def fact_session_rows(sessions: DataFrame, key: bytes) -> DataFrame:
    """Session rows as the fact table holds them, before the insert."""
    return sessions.select(
        pseudonymise(F.col("id"), key).alias("session_hash"),
        date_key(F.col("started_at")).alias("date_key"),
        pseudonymise(F.col("user_id"), key).alias("user_hash"),
        pseudonymise(F.col("puzzle_id"), key).alias("puzzle_hash"),
        F.coalesce("difficulty", F.lit("medium")).alias("difficulty_key"),
        "started_at",
        "completed_at",
        F.coalesce("status", F.lit("completed")).alias("status"),
        "time_elapsed_ms",
        F.coalesce("errors_count", F.lit(0)).alias("errors_count"),
        F.coalesce("hints_used", F.lit(0)).alias("hints_used"),
        "score",
    )


def load_fact_sessions(
    sessions: DataFrame, existing: DataFrame | None, key: bytes
) -> tuple[DataFrame, DataFrame]:
    """Session rows to append, and one row of counts: inserted, duplicates (of stored rows or
    within the batch) and skipped (without a date)."""
    rows = fact_session_rows(sessions, key)
    return _load(rows, existing, "session_hash", "started_at")


def fact_match_rows(matches: DataFrame, key: bytes) -> DataFrame:
    after, before = F.col("winner_elo_after"), F.col("winner_elo_before")
    return matches.select(
        pseudonymise(F.col("match_id"), key).alias("match_hash"),
        date_key(F.col("completed_at")).alias("date_key"),
        F.col("room_id").cast("string").alias("room_id"),
        pseudonymise(F.col("winner_id"), key).alias("winner_hash"),
        pseudonymise(F.col("loser_id"), key).alias("loser_hash"),
        F.coalesce("difficulty", F.lit("medium")).alias("difficulty_key"),
        "end_reason",
        "duration_ms",
        "winner_elo_before",
        "winner_elo_after",
        "loser_elo_before",
        "loser_elo_after",
        F.when((after != 0) & (before != 0), after - before).alias("elo_delta"),
        "completed_at",
    )


def load_fact_matches(
    matches: DataFrame, existing: DataFrame | None, key: bytes
) -> tuple[DataFrame, DataFrame]:
    """Match rows to append, and one row of the same counts."""
    return _load(fact_match_rows(matches, key), existing, "match_hash", "completed_at")


def append_fact_sessions(
    sessions: DataFrame, stored: DataFrame | None, key: bytes, write: Callable[[DataFrame], None]
) -> dict[str, int]:
    """Hands the session rows to append to `write`, which has to run them, and returns the counts
    that this run observed: one scan of the sessions."""
    return append_counted(fact_session_rows(sessions, key), stored, "session_hash", "date_key", "started_at", write)


def append_fact_matches(
    matches: DataFrame, stored: DataFrame | None, key: bytes, write: Callable[[DataFrame], None]
) -> dict[str, int]:
    """The same for matches."""
    return append_counted(fact_match_rows(matches, key), stored, "match_hash", "date_key", "completed_at", write)


def _load(rows, existing, key_col, ts_col) -> tuple[DataFrame, DataFrame]:
    dated = rows.where(F.col("date_key").isNotNull())
    if existing is None:
        existing = dated.limit(0)
    per_key = rows.groupBy(key_col).agg(F.count("date_key").alias("dated"), F.count_if(F.col("date_key").isNull()).alias("undated"))
    stored = existing.select(key_col).distinct().withColumn("stored", F.lit(1))
    fresh = (F.col("dated") > 0) & F.col("stored").isNull()
    counts = per_key.join(stored, key_col, "left").agg(
        F.count_if(fresh).alias("inserted"),
        (F.coalesce(F.sum("dated"), F.lit(0)) - F.count_if(fresh)).alias("duplicates"),
        F.coalesce(F.sum("undated"), F.lit(0)).alias("skipped"),
    )
    return insert_ignore(dated, existing, [key_col], [F.col(ts_col)]), counts


def conform_difficulty(df: DataFrame, col: str, out: str = "difficulty_key") -> DataFrame:
    """Both difficulty vocabularies on one key; unknown words become NULL."""
    return df.withColumn(out, lookup(F.lower(F.col(col)), vocab.CONFORMED_DIFFICULTY))


def orphan_keys(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Distinct fact keys that the dimension lacks, with their row counts.

    Rows are counted per key before the join, so a frequent key is one row in it.
    """
    counted = (
        fact.where(F.col(fact_key).isNotNull()).groupBy(fact_key).agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return counted.join(dim.select(F.col(dim_key).alias(fact_key)), fact_key, "left_anti")


def star_join(
    fact: DataFrame, users: DataFrame, puzzles: DataFrame, dates: DataFrame, difficulties: DataFrame
) -> DataFrame:
    """Fact rows with their dimension attributes; the optimizer picks how each side moves."""
    return (
        fact.join(difficulties.select("difficulty_key", "display_name", "sort_order"), "difficulty_key", "left")
        .join(dates.select("date_key", "month_name", "is_weekend"), "date_key", "left")
        .join(users.select("user_hash", "skill_segment"), "user_hash", "left")
        .join(puzzles.select("puzzle_hash", "clue_count"), "puzzle_hash", "left")
    )

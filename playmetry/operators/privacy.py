"""Erasure, its dry run and audit, and retention."""

from __future__ import annotations

import uuid
from collections.abc import Collection
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetry.functions.ids import pseudonymise
from playmetry.operators.metrics import retention_cutoff
from playmetry.sources.tables import overwrite_partition

# Source (table, id column) targets, and warehouse targets keyed by hash.
SOURCE_TARGETS = [
    ("feature_store", "entity_id"),
    ("ab_test_result", "user_id"),
    ("game_sessions", "user_id"),
    ("streaks", "user_id"),
    ("daily_puzzle_attempts", "user_id"),
    ("lesson_progress", "user_id"),
    ("friendships", "requester_id"),
    ("friendships", "addressee_id"),
    ("player_ratings", "user_id"),
    ("multiplayer_matches", "winner_id"),
    ("multiplayer_matches", "loser_id"),
    ("activity_feed", "user_id"),
    ("notifications", "user_id"),
    ("users", "id"),
]
WAREHOUSE_TARGETS = [
    ("fact_game_session", "user_hash"),
    ("fact_match", "winner_hash"),
    ("fact_match", "loser_hash"),
    ("dim_user", "user_hash"),
]


def _targets(tables: dict[str, DataFrame], ids: DataFrame, key: bytes, absent: Collection[str]):
    """(table, column, ids as `__erase` in the column's type) of every target.

    A target that is not given and whose table is not in `absent` is an error: an erasure
    that forgets a table must not look complete.
    """
    plain = ids.select(F.col("id").alias("__erase")).distinct()
    hashed = ids.select(pseudonymise(F.col("id"), key).alias("__erase")).distinct()
    missing = []
    for targets, wanted in ((SOURCE_TARGETS, plain), (WAREHOUSE_TARGETS, hashed)):
        for table, column in targets:
            if table in tables and column in tables[table].columns:
                kind = tables[table].schema[column].dataType
                yield table, column, wanted.select(F.col("__erase").try_cast(kind).alias("__erase"))
            elif table in tables or table not in absent:
                missing.append(f"{table}.{column}")
    if missing:
        raise ValueError(f"erasure targets not given: {', '.join(missing)}")


def erase_users(tables: dict[str, DataFrame], ids: DataFrame, key: bytes, absent: Collection[str] = ()) -> dict[str, DataFrame]:
    """The tables without any row of the given users; warehouse tables are matched by hash.

    Each result is a lazy anti-join; write it with `rewrite_erased` per date-partitioned
    table. Every target has to be given, or its table named in `absent`. The id list is cast
    to the column's type; the optimizer broadcasts it only while its size allows it.
    """
    kept = dict(tables)
    for table, column, wanted in list(_targets(tables, ids, key, absent)):
        kept[table] = kept[table].join(wanted, kept[table][column] == wanted["__erase"], "left_anti")
    return kept


def rewrite_erased(before: DataFrame, kept: DataFrame, path: str, date_col: str, fmt: str = "parquet") -> None:
    """Write an erasure to the date-partitioned files at `path`, which `before` was read from.

    Only dates that lost rows are rewritten, from a copy beside the table, and a date that
    lost all of its rows has its files removed, which a dynamic overwrite would leave alone.
    The list of dates is bounded by the calendar. The steps are not one transaction: after a
    crash erased rows may still be there, and running the same erasure again, over the table
    as it then is, completes it. A copy left beside the table holds rows to keep alone.
    """
    spark = before.sparkSession
    had = before.groupBy(date_col).agg(F.count(F.lit(1)).alias("n"))
    has = kept.groupBy(F.col(date_col).alias("__date")).agg(F.count(F.lit(1)).alias("m"))
    changed = had.join(has, had[date_col].eqNullSafe(has["__date"]), "left").where("m IS NULL OR m < n")
    lost = changed.select(date_col, F.col("m").isNull().alias("emptied")).collect()
    partial = [r[date_col] for r in lost if not r["emptied"]]
    if partial:
        staged = f"{path.rstrip('/')}-erased-{uuid.uuid4().hex}"
        kept.where(reduce(lambda a, b: a | b, [F.col(date_col).eqNullSafe(F.lit(d)) for d in partial])).write.format(fmt).save(staged)
        overwrite_partition(spark.read.format(fmt).load(staged), path, date_col, fmt)
        _remove(spark, staged)
    for r in lost:
        if r["emptied"]:
            name = "__HIVE_DEFAULT_PARTITION__" if r[date_col] is None else str(r[date_col])
            _remove(spark, f"{path.rstrip('/')}/{date_col}={name}")


def _remove(spark, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def erasure_dry_run(tables: dict[str, DataFrame], ids: DataFrame, key: bytes, absent: Collection[str] = ()) -> DataFrame:
    """Rows each (table, column) target would lose; nothing is changed."""
    parts = []
    for table, column, wanted in list(_targets(tables, ids, key, absent)):
        df = tables[table].select(F.col(column).alias("__id"))
        hit = df.join(wanted, df["__id"] == wanted["__erase"], "left_semi")
        parts.append(
            hit.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "n_rows"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def erasure_audit(ids: DataFrame, requested_at, erased_at, key: bytes) -> DataFrame:
    """One audit row per erased user: hash and times, never the plain id."""
    return ids.select(
        pseudonymise(F.col("id"), key).alias("user_hash"),
        F.lit(requested_at).cast("timestamp").alias("requested_at"),
        F.lit(erased_at).cast("timestamp").alias("erased_at"),
    ).distinct()


def resync_guard(df: DataFrame, audit: DataFrame, key: bytes, id_col: str = "user_id") -> DataFrame:
    """Rows whose user has not been erased: apply before every later load."""
    erased = audit.select(F.col("user_hash").alias("__hash")).distinct()
    return df.join(erased, pseudonymise(df[id_col], key) == erased["__hash"], "left_anti")


def retention_apply(
    tables: dict[str, tuple[DataFrame, str]], policy: dict[str, int], as_of
) -> dict[str, DataFrame]:
    """Each table without the rows past its cutoff, by a date, a timestamp or a day key like
    20240131. The comparison is in the column's own type, so it prunes partitions and reaches
    the file scan. A row without a date is kept."""
    return {
        name: df.where(F.col(col).isNull() | (F.col(col) >= retention_cutoff(df, col, as_of, policy[name])))
        for name, (df, col) in tables.items()
    }

"""Filters, paging, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playmetry.functions import vocab
from playmetry.functions.scoring import cluster_difficulties


def _day(value) -> Column:
    return F.lit(str(value)).cast("date")


def last_n_days(df: DataFrame, date_col: str, n: int, as_of, order: Sequence[Column] = ()) -> DataFrame:
    """Rows from `as_of` - n days on, newest first."""
    kept = df.where(F.col(date_col) >= F.date_sub(_day(as_of), n))
    return kept.orderBy(F.col(date_col).desc(), *order)


def at_date(df: DataFrame, date_col: str, day) -> DataFrame:
    return df.where(F.col(date_col) == _day(day))


def latest_snapshot(df: DataFrame, date_col: str, n: int, order: Sequence[Column]) -> DataFrame:
    """The first `n` rows of the newest date."""
    newest = df.agg(F.max(date_col)).scalar()
    return df.where(F.col(date_col) == newest).orderBy(*order).limit(n)


def optional_filter(df: DataFrame, col: str, value=None) -> DataFrame:
    return df if value is None else df.where(F.col(col) == F.lit(value))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """One page (1-based) with the totals on every row. `order` must end in a unique key.

    A size over `most`, a size or a number under 1 is an error. A page brings number * size
    rows to one task; `page_after` goes on from a key instead and suits deep pages.
    """
    if number < 1 or not 1 <= size <= most:
        raise ValueError(f"page {number} of size {size}: numbers begin at 1, sizes are 1 to {most}")
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("total_rows", total).withColumn(
        "total_pages", F.ceil(F.col("total_rows") / F.lit(size)).cast("long")
    )


def page_after(df: DataFrame, ts_col: str, id_col: str, cursor, n: int) -> DataFrame:
    """Up to `n` rows older than `cursor`, newest first; the rows tell whether more follow."""
    older = df if cursor is None else df.where(F.col(ts_col) < F.lit(cursor).cast("timestamp"))
    taken = older.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(n + 1)
    # The window runs over the n + 1 taken rows only.
    numbered = taken.withColumn(
        "__rn", F.row_number().over(Window.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()))
    ).withColumn("__got", F.count(F.lit(1)).over(Window.partitionBy()))
    return (
        numbered.where(F.col("__rn") <= n)
        .withColumn("has_more", F.col("__got") > n)
        .drop("__rn", "__got")
    )


def top_groups(df: DataFrame, key: str, n: int, out: str = "sessions") -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return counts.orderBy(F.col(out).desc(), F.col(key).asc_nulls_last()).limit(n)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First `n` rows per key. Spark applies the rank limit before the shuffle too, so each
    map task sends at most `n` rows of a hot key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def recent_scores(scores: DataFrame, n: int = 50) -> DataFrame:
    """Newest `n` scores of each user."""
    return top_per_key(scores, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], n)


def both_sides(matches: DataFrame) -> DataFrame:
    """One row per player and match.

    The two sides come from one scan: each match row is expanded to its winner and loser.
    """

    def side(mine: str, other: str, won: int) -> Column:
        return F.struct(
            F.col(f"{mine}_id").alias("user_id"),
            F.col(f"{other}_id").alias("opponent_id"),
            F.col(f"{mine}_elo_before").alias("elo_before"),
            F.col(f"{mine}_elo_after").alias("elo_after"),
            F.lit(won).alias("is_win"),
        )

    keep = [
        c
        for c in matches.columns
        if not c.startswith(("winner_", "loser_"))
    ]
    sides = F.array(side("winner", "loser", 1), side("loser", "winner", 0))
    return matches.select(*keep, F.explode(sides).alias("__s")).select(*keep, "__s.*")


def recent_matches(matches: DataFrame, n: int = 100) -> DataFrame:
    """Newest `n` matches of each user, won or lost."""
    order = [F.col("completed_at").desc(), F.col("match_id").desc()]
    return top_per_key(both_sides(matches), ["user_id"], order, n)


def recommend_recent_puzzles(users: DataFrame, puzzles: DataFrame, k: int = 6) -> DataFrame:
    """The `k` newest puzzles among each user's recommended difficulties.

    Users fall into few difficulty lists. The lists are ranked once (at most `k` puzzles
    per difficulty can matter), then joined back to the users.
    """
    listed = users.select(
        F.col("id").alias("user_id"), cluster_difficulties(F.col("skill_cluster")).alias("levels")
    )
    newest = [F.col("created_at").desc(), F.col("puzzle_id").desc()]
    candidates = top_per_key(
        puzzles.select(F.col("id").alias("puzzle_id"), "difficulty", "clue_count", "created_at"),
        ["difficulty"],
        newest,
        k,
        "__r",
    ).drop("__r")
    options = [*vocab.CLUSTER_DIFFICULTIES.values(), vocab.DEFAULT_DIFFICULTIES]
    lists = users.sparkSession.createDataFrame(
        [(levels,) for levels in options], "levels array<string>"
    ).withColumn("difficulty", F.explode("levels"))
    per_list = top_per_key(
        candidates.join(F.broadcast(lists), "difficulty"), ["levels"], newest, k
    )  # at most six lists x k rows
    return listed.join(F.broadcast(per_list), "levels").drop("levels")


def outreach_batch(queue: DataFrame, users: DataFrame, n: int = 100) -> DataFrame:
    """Waiting entries of users with a push token, riskiest first, with their message."""
    waiting = queue.where(~F.col("notified"))
    tokens = users.where(F.col("fcm_token").isNotNull()).select(F.col("id").alias("user_id"), "fcm_token")
    batch = (
        waiting.join(tokens, "user_id")
        .orderBy(F.col("churn_prob").desc(), F.col("created_at").asc(), F.col("id").asc())
        .limit(n)
    )
    titles = {k: v[0] for k, v in vocab.OUTREACH_MESSAGES.items()}
    bodies = {k: v[1] for k, v in vocab.OUTREACH_MESSAGES.items()}

    def message(table: dict[str, str]) -> Column:
        column = F.when(F.lit(False), "")
        for level, text in table.items():
            column = column.when(F.col("risk_level") == level, text)
        return column.otherwise(table["high"])

    return batch.withColumn("title", message(titles)).withColumn("body", message(bodies))


def audience(owners: DataFrame, friends: DataFrame) -> DataFrame:
    """Distinct (activity, user) of owners and friends."""
    return owners.unionByName(friends).distinct()


def class_union(reference: DataFrame, current: DataFrame, floor: float = 0.001) -> DataFrame:
    """Every class of either side with both shares, missing or tiny ones at the floor."""
    joined = reference.select("class", F.col("share").alias("ref_share")).join(
        current.select("class", F.col("share").alias("cur_share")), "class", "full_outer"
    )

    def floored(col: str) -> Column:
        return F.greatest(F.coalesce(F.col(col), F.lit(floor)), F.lit(floor)).alias(col)

    seen = F.col("cur_share").isNotNull().alias("in_current")
    return joined.select("class", floored("ref_share"), floored("cur_share"), seen)


def missing(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of `expected` that `present` lacks."""
    return expected.subtract(present)

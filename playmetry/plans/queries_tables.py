"""Queries of sources, warehouse load, quality gates, filters and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from playmetry.functions import vocab
from playmetry.functions.ids import date_key, mask_columns, pii_leaks
from playmetry.functions.scoring import cluster_difficulties, streak_bucket
from playmetry.operators import frames, quality, warehouse
from playmetry.operators.joins import friend_edges
from playmetry.operators.metrics import class_distribution
from playmetry.plans import binding as b
from playmetry.plans.oracle import case, day_key, hmac_sql, quote
from playmetry.plans.registry import register
from playmetry.sources import events as ev
from playmetry.sources import tables as tb
from playmetry.sources.stores import DailyTable, KeyedTable

KEY = b.HASH_KEY

LINE_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


def _lines(spark, folder):
    return b.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate", "l_returnflag",
    )


def _line_order():
    return [F.col(c.strip()) for c in LINE_ORDER.split(",")]


@register(
    "insert_ignore",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS rn
          FROM lineitem WHERE l_returnflag <> 'A')
        WHERE rn = 1 AND (l_orderkey, l_linenumber) NOT IN
          (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'A')""",
    "l_quantity",
)
def _(spark, folder):
    lines = _lines(spark, folder)
    new, stored = lines.where("l_returnflag <> 'A'"), lines.where("l_returnflag = 'A'")
    added = tb.insert_ignore(new, stored, ["l_orderkey", "l_linenumber"], _line_order())
    return added.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@register(
    "upsert_replace",
    f"""WITH fresh AS (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS rn
          FROM lineitem WHERE l_returnflag = 'A')
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM fresh WHERE rn = 1
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem
        WHERE l_returnflag <> 'A' AND (l_orderkey, l_linenumber) NOT IN
          (SELECT (l_orderkey, l_linenumber) FROM fresh)""",
    "l_quantity",
)
def _(spark, folder):
    lines = _lines(spark, folder)
    new, stored = lines.where("l_returnflag = 'A'"), lines.where("l_returnflag <> 'A'")
    table = tb.upsert_replace(new, stored, ["l_orderkey", "l_linenumber"], _line_order())
    return table.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")


@register(
    "keyed_upsert",
    f"""WITH fresh AS (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS rn
          FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey % 100 < 7)
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM fresh WHERE rn = 1
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS rn
          FROM lineitem WHERE l_returnflag <> 'A')
        WHERE rn = 1 AND (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM fresh)""",
    "l_quantity",
)
def _(spark, folder):
    """A stored table of all other lines after an upsert of returned lines of some orders."""
    lines = _lines(spark, folder)
    table = KeyedTable(b.stored(spark, "lines"), ", ".join(f"{n} {t}" for n, t in lines.dtypes), ["l_orderkey", "l_linenumber"], 32)
    table.upsert(lines.where("l_returnflag <> 'A'"), _line_order())
    table.upsert(lines.where("l_returnflag = 'A' AND l_orderkey % 100 < 7"), _line_order())
    return table.read(spark).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")


@register(
    "daily_table",
    """SELECT event_id, user_id, CAST(ts AS DATE) AS event_date, value FROM events""",
    "value",
)
def _(spark, folder):
    """Events that arrive in four batches across all dates, the second twice and the third with copies of the first."""
    events = b.events(spark, folder).select("event_id", "user_id", "ts", "value")
    part = F.col("event_id") % 3
    table = DailyTable(b.stored(spark, "events"), ", ".join(f"{n} {t}" for n, t in events.dtypes), ["event_id"], "ts")
    for batch_id, rows in ((0, events.where(part == 0)), (1, events.where(part == 1)), (1, events.where(part == 1)), (2, events.where((part == 2) | (F.col("event_id") % 9 == 0)))):
        table.apply(rows, batch_id)
    return table.read(spark).select("event_id", "user_id", "event_date", "value")


@register(
    "incremental_extract",
    "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'",
)
def _(spark, folder):
    # The stored column type is kept, so the predicate reaches the file scan.
    rows = ev.incremental_extract(
        b.table(spark, folder, "orders"), "o_orderdate", "2000-01-01"
    )
    return rows.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))


@register(
    "decode_json_column",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
)
def _(spark, folder):
    rows = b.table(spark, folder, "events").select("event_id", "props")
    return ev.decode_json_column(rows, "props", "k int").select("event_id", "props.k")


@register(
    "build_dim_date",
    f"""SELECT {day_key('d')} AS date_key, CAST(d AS DATE) AS full_date, CAST(year(d) AS INTEGER) AS year,
               CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month,
               CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(day(d) AS INTEGER) AS day_of_month,
               CAST(isodow(d) - 1 AS INTEGER) AS day_of_week, isodow(d) >= 6 AS is_weekend,
               monthname(d) AS month_name, dayname(d) AS day_name, coalesce(n, 0) AS sessions
        FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS d)
        LEFT JOIN (SELECT CAST(started_at AS DATE) AS day, count(*) AS n FROM plain_sessions GROUP BY 1)
               ON day = CAST(d AS DATE)""",
)
def _(spark, folder):
    dates = tb.build_dim_date(spark, "1995-01-01", "2001-12-31")
    counts = b.session_facts(spark, folder).groupBy("date_key").agg(F.count(F.lit(1)).alias("n"))
    joined = dates.join(counts, "date_key", "left")
    return joined.withColumn("sessions", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


_LEVELS = ", ".join(
    f"({quote(k)}, {quote(n)}, {o}, {lo}, {hi}, TRUE)" for k, n, o, lo, hi in vocab.DIFFICULTY_LEVELS
)


@register(
    "build_dim_difficulty",
    f"""SELECT v.*, coalesce(n, 0) AS n_puzzles
        FROM (VALUES {_LEVELS}) AS v(difficulty_key, display_name, sort_order, min_clues, max_clues, is_active)
        LEFT JOIN (SELECT difficulty, count(*) AS n FROM puzzles GROUP BY 1) ON difficulty = difficulty_key""",
)
def _(spark, folder):
    counts = b.puzzles(spark, folder).groupBy(F.col("difficulty").alias("difficulty_key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = tb.build_dim_difficulty(spark).join(counts, "difficulty_key", "left")
    return joined.withColumn("n_puzzles", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


# --- warehouse -----------------------------------------------------------------


@register(
    "load_dim_user",
    f"""SELECT {hmac_sql('id')} AS user_hash, skill_cluster AS skill_segment,
               {day_key('created_at')} AS created_date_key, is_active FROM users""",
)
def _(spark, folder):
    users = b.users(spark, folder)
    stored = warehouse.load_dim_user(users.where("is_active"), None, KEY)
    return warehouse.load_dim_user(users, stored, KEY)


@register(
    "load_dim_puzzle",
    f"""SELECT {hmac_sql('id')} AS puzzle_hash, difficulty AS difficulty_key, clue_count, created_at
        FROM puzzles WHERE difficulty <> 'easy'""",
)
def _(spark, folder):
    puzzles = b.puzzles(spark, folder)
    default = F.lit("2024-01-01").cast("timestamp")
    stored = warehouse.load_dim_puzzle(puzzles.where("difficulty = 'easy'"), None, KEY, default)
    return warehouse.load_dim_puzzle(puzzles, stored, KEY, default)


_FACT_SESSION = f"""
    SELECT {hmac_sql('id')} AS session_hash, {day_key('started_at')} AS date_key,
           {hmac_sql('user_id')} AS user_hash, {hmac_sql('puzzle_id')} AS puzzle_hash,
           coalesce(difficulty, 'medium') AS difficulty_key, status, time_elapsed_ms, errors_count, hints_used, score, started_at, completed_at
    FROM sessions"""


@register("load_fact_sessions", _FACT_SESSION + " WHERE status <> 'abandoned'")
def _(spark, folder):
    sessions = b.sessions(spark, folder)
    stored = warehouse.fact_session_rows(sessions.where("status = 'abandoned'"), KEY)
    added, _counts = warehouse.load_fact_sessions(sessions, stored, KEY)
    return added


@register(
    "load_counts",
    """SELECT count(*) FILTER (WHERE status <> 'abandoned') AS inserted,
              CAST(count(*) + count(*) FILTER (WHERE id % 3 = 0) - count(*) FILTER (WHERE status <> 'abandoned') AS BIGINT) AS duplicates,
              CAST(0 AS BIGINT) AS skipped
       FROM plain_sessions""",
)
def _(spark, folder):
    """Every third session comes twice, and abandoned ones are stored already."""
    sessions = b.sessions(spark, folder)
    stored = warehouse.fact_session_rows(sessions.where("status = 'abandoned'"), KEY)
    _added, counts = warehouse.load_fact_sessions(sessions.union(sessions.where("id % 3 = 0")), stored, KEY)
    return counts


@register(
    "load_fact_matches",
    f"""SELECT {hmac_sql('match_id')} AS match_hash, {day_key('completed_at')} AS date_key, room_id,
               {hmac_sql('winner_id')} AS winner_hash, {hmac_sql('loser_id')} AS loser_hash,
               difficulty AS difficulty_key, end_reason, duration_ms, winner_elo_before, winner_elo_after,
               loser_elo_before, loser_elo_after, elo_delta, completed_at
        FROM matches""",
)
def _(spark, folder):
    added, _counts = warehouse.load_fact_matches(b.matches(spark, folder), None, KEY)
    return added


@register(
    "conform_difficulty",
    f"""SELECT word, {case('word', vocab.CONFORMED_DIFFICULTY)} AS difficulty_key, count(*) AS n
        FROM (SELECT CASE difficulty WHEN 'super_easy' THEN 'beginner' WHEN 'super_hard' THEN 'expert'
                                     ELSE difficulty END AS word FROM plain_sessions
              UNION ALL SELECT difficulty FROM puzzles) GROUP BY 1, 2""",
)
def _(spark, folder):
    old = F.col("difficulty")
    words = (
        b.plain_sessions(spark, folder)
        .select(F.when(old == "super_easy", "beginner").when(old == "super_hard", "expert").otherwise(old).alias("word"))
        .unionByName(b.puzzles(spark, folder).select(old.alias("word")))
    )
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return warehouse.conform_difficulty(counted, "word")


@register(
    "orphan_keys",
    """SELECT l_orderkey AS id, count(*) AS n_rows FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""",
)
def _(spark, folder):
    lines = b.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"))
    kept = b.table(spark, folder, "orders").where("o_orderstatus <> 'P'")
    return warehouse.orphan_keys(lines, kept, "id", "o_orderkey")


@register(
    "star_join",
    f"""SELECT display_name, skill_segment, month_name, is_weekend, count(*) AS n,
               coalesce(CAST(sum(clue_count) AS BIGINT), 0) AS clues
        FROM sessions s
        LEFT JOIN (VALUES {_LEVELS}) AS v(difficulty_key, display_name, sort_order, min_clues, max_clues, a)
               ON v.difficulty_key = s.difficulty
        LEFT JOIN (SELECT id AS uid, skill_cluster AS skill_segment FROM users) u ON u.uid = s.user_id
        LEFT JOIN (SELECT id AS pid, clue_count FROM puzzles) p ON p.pid = s.puzzle_id,
        LATERAL (SELECT monthname(s.started_at) AS month_name, isodow(s.started_at) >= 6 AS is_weekend) d
        GROUP BY 1, 2, 3, 4""",
)
def _(spark, folder):
    fact = warehouse.fact_session_rows(b.sessions(spark, folder), KEY)
    users = warehouse.load_dim_user(b.users(spark, folder), None, KEY)
    puzzles = warehouse.load_dim_puzzle(b.puzzles(spark, folder), None, KEY, F.lit(None).cast("timestamp"))
    joined = warehouse.star_join(
        fact, users, puzzles, tb.build_dim_date(spark, "1995-01-01", "2001-12-31"), tb.build_dim_difficulty(spark)
    )
    return joined.groupBy("display_name", "skill_segment", "month_name", "is_weekend").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("clue_count"), F.lit(0)).alias("clues")
    )


# --- quality -------------------------------------------------------------------


def _check_sql(name: str, column: str, count: str, source: str, severity: str = "error") -> str:
    return (
        f"SELECT '{name}' AS \"check\", '{column}' AS \"column\", n AS n_failed, n = 0 AS passed, "
        f"'{severity}' AS severity FROM (SELECT CAST({count} AS BIGINT) AS n FROM {source})"
    )


NOT_NULL_SQL = _check_sql("not_null", "completed_at", "count(*) FILTER (WHERE completed_at IS NULL)", "plain_sessions")
IN_SET_SQL = _check_sql(
    "in_set", "status", "count(*) FILTER (WHERE status NOT IN ('completed', 'in_progress'))", "plain_sessions"
)
NON_NEGATIVE_SQL = _check_sql("non_negative", "c_acctbal", "count(*) FILTER (WHERE c_acctbal < 0)", "customer")
UNIQUE_SQL = _check_sql(
    "unique",
    "l_orderkey+l_linenumber",
    "count(*)",
    "(SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
)
ROWS_SQL = _check_sql(
    "rows_for_date", "date_key", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END",
    "(SELECT 1 FROM session_facts WHERE date_key = 20010801)", "warning",
)


def _checks(spark, folder):
    sessions = b.plain_sessions(spark, folder)
    return [
        quality.expect_not_null(sessions, "completed_at"),
        quality.expect_in_set(sessions, "status", ["completed", "in_progress"]),
        quality.expect_non_negative(b.table(spark, folder, "customer"), "c_acctbal"),
        quality.expect_unique(b.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]),
        quality.expect_rows_for_date(b.session_facts(spark, folder), "date_key", 20010801),
    ]


register("expect_not_null", NOT_NULL_SQL)(lambda spark, folder: _checks(spark, folder)[0])
register("expect_in_set", IN_SET_SQL)(lambda spark, folder: _checks(spark, folder)[1])
register("expect_non_negative", NON_NEGATIVE_SQL)(lambda spark, folder: _checks(spark, folder)[2])
register("expect_unique", UNIQUE_SQL)(lambda spark, folder: _checks(spark, folder)[3])
register("expect_rows_for_date", ROWS_SQL)(lambda spark, folder: _checks(spark, folder)[4])
register(
    "bad_values",
    "SELECT status, count(*) AS n_rows FROM plain_sessions WHERE status NOT IN ('completed', 'in_progress') GROUP BY 1",
)(lambda spark, folder: quality.bad_values(b.plain_sessions(spark, folder), "status", ["completed", "in_progress"]))
register(
    "expect_coverage",
    """SELECT 'coverage' AS "check", 'skill_cluster' AS "column", CAST(CASE WHEN coverage < 0.8 THEN 1 ELSE 0 END AS BIGINT) AS n_failed,
              coverage >= 0.8 AS passed, 'error' AS severity, coverage
       FROM (SELECT count(skill_cluster) / count(*)::DOUBLE AS coverage FROM users)""",
    "coverage",
)(lambda spark, folder: quality.expect_coverage(b.people(spark, folder), "skill_cluster"))
register(
    "expect_tables",
    """SELECT 'orders' AS table_name, TRUE AS present, (SELECT count(*) FROM orders) AS n_rows
       UNION ALL SELECT 'events', TRUE, (SELECT count(*) FROM events) UNION ALL SELECT 'fact_match', FALSE, 0""",
)(
    lambda spark, folder: quality.expect_tables(
        spark,
        ["orders", "events", "fact_match"],
        {name: b.table(spark, folder, name) for name in ("orders", "events")},
    )
)
register("run_suite", " UNION ALL ".join([NOT_NULL_SQL, IN_SET_SQL, NON_NEGATIVE_SQL, UNIQUE_SQL, ROWS_SQL]))(
    lambda spark, folder: quality.run_suite(_checks(spark, folder))
)


# --- filters and paging --------------------------------------------------------


def _daily(spark, folder):
    """Events per day and kind: a small dated table."""
    return (
        b.events(spark, folder)
        .groupBy(F.to_date("ts").alias("date"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


DAILY_SQL = "(SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY 1, 2)"

register("last_n_days", f"SELECT * FROM {DAILY_SQL} WHERE date >= DATE '2024-01-31' - 7")(
    lambda spark, folder: frames.last_n_days(_daily(spark, folder), "date", 7, b.EVENTS_AS_OF, [F.col("event_type")])
)
register("at_date", f"SELECT * FROM {DAILY_SQL} WHERE date = DATE '2024-01-15'")(
    lambda spark, folder: frames.at_date(_daily(spark, folder), "date", "2024-01-15")
)
register(
    "latest_snapshot",
    f"SELECT * FROM {DAILY_SQL} WHERE date = (SELECT max(CAST(ts AS DATE)) FROM events) ORDER BY n DESC, event_type LIMIT 3",
)(
    lambda spark, folder: frames.latest_snapshot(
        _daily(spark, folder), "date", 3, [F.col("n").desc(), F.col("event_type")]
    )
)
register(
    "optional_filter",
    "SELECT difficulty, count(*) AS n FROM plain_sessions WHERE status = 'completed' GROUP BY 1",
)(
    lambda spark, folder: frames.optional_filter(
        frames.optional_filter(b.plain_sessions(spark, folder), "status", "completed"), "difficulty", None
    )
    .groupBy("difficulty")
    .agg(F.count(F.lit(1)).alias("n"))
)
register(
    "page",
    """SELECT id, score, (SELECT count(*) FROM orders) AS total_rows,
              CAST(ceil((SELECT count(*) FROM orders) / 20.0) AS BIGINT) AS total_pages
       FROM sessions ORDER BY score DESC, id LIMIT 20 OFFSET 40""",
)(
    lambda spark, folder: frames.page(
        b.sessions(spark, folder).select("id", "score"), [F.col("score").desc(), F.col("id")], 3, 20
    )
)
register(
    "page_after",
    """SELECT event_id, ts, TRUE AS has_more FROM events WHERE ts < TIMESTAMP '2024-01-20'
       ORDER BY ts DESC, event_id DESC LIMIT 30""",
)(
    lambda spark, folder: frames.page_after(
        b.events(spark, folder).select("event_id", "ts"), "ts", "event_id", "2024-01-20", 30
    )
)
register(
    "top_groups",
    """SELECT difficulty, count(*) AS sessions FROM plain_sessions WHERE started_at >= DATE '2001-08-01' - 30
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
)(
    lambda spark, folder: frames.top_groups(
        b.plain_sessions(spark, folder).where(
            F.col("started_at") >= F.date_sub(F.lit(b.SESSIONS_AS_OF).cast("date"), 30)
        ),
        "difficulty",
        3,
    )
)
register(
    "recent_scores",
    """SELECT user_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, id, score,
         row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) AS rank FROM sessions)
       WHERE rank <= 5""",
)(
    lambda spark, folder: frames.recent_scores(
        b.sessions(spark, folder).select("user_id", "id", "score", F.col("started_at").alias("created_at")), 5
    ).drop("created_at")
)
register(
    "recent_matches",
    """SELECT user_id, match_id, is_win, CAST(rank AS INTEGER) AS rank FROM (SELECT *,
         row_number() OVER (PARTITION BY user_id ORDER BY completed_at DESC, match_id DESC) AS rank FROM sides)
       WHERE rank <= 20""",
)(
    lambda spark, folder: frames.recent_matches(b.matches(spark, folder), 20).select(
        "user_id", "match_id", "is_win", "rank"
    )
)
register(
    "streak_bucket",
    """SELECT user_id, CASE WHEN current_streak = 0 THEN '0' WHEN current_streak <= 7 THEN '1-7'
         WHEN current_streak <= 30 THEN '8-30' WHEN current_streak <= 100 THEN '31-100' ELSE '100+' END AS bucket
       FROM event_streaks""",
)(
    lambda spark, folder: b.event_streaks(spark, folder).select(
        "user_id", streak_bucket(F.col("current_streak")).alias("bucket")
    )
)
_LISTS = {k: ",".join(v) for k, v in vocab.CLUSTER_DIFFICULTIES.items()}
RECOMMENDED = case("skill_cluster", _LISTS, quote(",".join(vocab.DEFAULT_DIFFICULTIES)))
register("cluster_difficulties", f"SELECT id, {RECOMMENDED} AS levels FROM users")(
    lambda spark, folder: b.people(spark, folder).select(
        "id", F.array_join(cluster_difficulties(F.col("skill_cluster")), ",").alias("levels")
    )
)
PICKS_SQL = f"""
    SELECT u.id AS user_id, p.id AS puzzle_id, p.difficulty, p.clue_count, p.created_at,
           row_number() OVER (PARTITION BY u.id ORDER BY p.created_at DESC, p.id DESC) AS rank
    FROM users u JOIN (SELECT * FROM (SELECT *, row_number() OVER
           (PARTITION BY difficulty ORDER BY created_at DESC, id DESC) AS r FROM puzzles) WHERE r <= 6) p
      ON list_contains(string_split({RECOMMENDED}, ','), p.difficulty)"""
register(
    "recommend_recent_puzzles",
    f"SELECT user_id, puzzle_id, difficulty, clue_count, CAST(rank AS INTEGER) AS rank FROM ({PICKS_SQL}) WHERE rank <= 6",
)(
    lambda spark, folder: frames.recommend_recent_puzzles(
        b.people(spark, folder), b.puzzles(spark, folder)
    ).drop("created_at")
)


def _message(index: int) -> str:
    texts = {k: v[index] for k, v in vocab.OUTREACH_MESSAGES.items()}
    return case("risk_level", texts, quote(texts["high"]))


register(
    "outreach_batch",
    f"""SELECT q.id, user_id, churn_prob, risk_level, u.fcm_token, {_message(0)} AS title, {_message(1)} AS body
        FROM queue q JOIN users u ON u.id = q.user_id WHERE NOT notified AND u.fcm_token IS NOT NULL
        ORDER BY churn_prob DESC, q.created_at, q.id LIMIT 100""",
    "churn_prob",
)(
    lambda spark, folder: frames.outreach_batch(
        b.re_engagement_queue(spark, folder), b.people(spark, folder)
    ).drop("notified", "created_at")
)

# --- sets ----------------------------------------------------------------------

register("both_sides", "SELECT user_id, opponent_id, match_id, elo_before, elo_after, is_win FROM sides")(
    lambda spark, folder: frames.both_sides(b.matches(spark, folder)).select(
        "user_id", "opponent_id", "match_id", "elo_before", "elo_after", "is_win"
    )
)
register(
    "audience",
    """SELECT user_id AS owner_id, friend_id AS audience_id FROM edges
       UNION SELECT id, id FROM users""",
)(
    lambda spark, folder: frames.audience(
        b.people(spark, folder).select(F.col("id").alias("owner_id"), F.col("id").alias("audience_id")),
        friend_edges(b.friendships(spark, folder)).toDF("owner_id", "audience_id"),
    )
)
SHARES = "SELECT {c} AS class, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM {t} GROUP BY 1"
UNION_SQL = f"""
    SELECT coalesce(r.class, c.class) AS class, greatest(coalesce(r.share, 0.001), 0.001) AS ref_share,
           greatest(coalesce(c.share, 0.001), 0.001) AS cur_share, c.share IS NOT NULL AS in_current
    FROM ({SHARES.format(c='difficulty', t='plain_sessions')}) r
    FULL JOIN ({SHARES.format(c='difficulty', t='puzzles')}) c ON r.class = c.class"""


def level_shares(df):
    return class_distribution(df.select(F.col("difficulty").alias("predicted"))).select("class", "share")


register("class_union", UNION_SQL, "ref_share cur_share")(
    lambda spark, folder: frames.class_union(
        level_shares(b.plain_sessions(spark, folder)), level_shares(b.puzzles(spark, folder))
    )
)
register("missing", "SELECT difficulty FROM puzzles EXCEPT SELECT difficulty FROM plain_sessions")(
    lambda spark, folder: frames.missing(
        b.puzzles(spark, folder).select("difficulty"), b.plain_sessions(spark, folder).select("difficulty")
    )
)

# --- masking -------------------------------------------------------------------

register(
    "mask_columns",
    f"SELECT id, {hmac_sql('username')} AS username, {hmac_sql('email')} AS email, skill_cluster FROM users",
)(
    lambda spark, folder: mask_columns(
        b.users(spark, folder).select("id", "username", "email", "skill_cluster"), ["username", "email", "phone"], KEY
    )
)
register(
    "pii_leaks",
    """SELECT 'user_id' AS field, count(user_id) AS n_values FROM sessions
       UNION ALL SELECT 'session_id', count(*) FROM sessions WHERE status = 'completed'""",
)(
    lambda spark, folder: pii_leaks(
        b.plain_sessions(spark, folder).select(
            "user_id", F.when(F.col("status") == "completed", F.col("id")).alias("session_id"), "difficulty",
            F.lit(None).cast("string").alias("email"),
        )
    )
)
register(
    "date_key",
    f"SELECT id, {day_key('started_at')} AS started_key, {day_key('completed_at')} AS completed_key FROM plain_sessions WHERE completed_at IS NOT NULL",
)(
    lambda spark, folder: b.plain_sessions(spark, folder)
    .where("completed_at IS NOT NULL")
    .select("id", date_key(F.col("started_at")).alias("started_key"), date_key(F.col("completed_at")).alias("completed_key"))
)

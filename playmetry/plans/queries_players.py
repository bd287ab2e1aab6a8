"""Queries of joins, metrics, feature tables and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from playmetry.functions import vocab
from playmetry.functions.scoring import churn_heuristic
from playmetry.operators import experiments as ex
from playmetry.operators import features as ft
from playmetry.operators import joins, metrics, ranking
from playmetry.plans import binding as b
from playmetry.plans.oracle import case, category_sql, quote, risk_sql, strip_sql
from playmetry.plans.queries_tables import PICKS_SQL, RECOMMENDED
from playmetry.plans.registry import register

AS_OF = b.SESSIONS_AS_OF
EVENTS_AS_OF = b.EVENTS_AS_OF

# --- joins ---------------------------------------------------------------------

register(
    "dau_with_new_users",
    """SELECT CAST(s.started_at AS DATE) AS date, count(DISTINCT user_id) AS user_count,
              count(DISTINCT u.id) FILTER (WHERE CAST(u.created_at AS DATE) = CAST(s.started_at AS DATE)) AS new_user_count
       FROM plain_sessions s JOIN users u ON u.id = s.user_id GROUP BY 1""",
)(lambda spark, d: joins.dau_with_new_users(b.plain_sessions(spark, d), b.users(spark, d)))

register(
    "user_session_left",
    """SELECT u.id AS user_id, coalesce(current_streak, -1) AS current_streak, coalesce(longest_streak, -1) AS longest_streak,
              coalesce(total_games, -1) AS total_games
       FROM users u LEFT JOIN event_streaks s ON s.user_id = u.id
       LEFT JOIN (SELECT user_id, count(*) AS total_games FROM plain_sessions GROUP BY 1) g ON g.user_id = u.id""",
)(
    lambda spark, d: joins.user_session_left(
        b.people(spark, d),
        b.event_streaks(spark, d).drop("last_day"),
        joins.session_counts(b.plain_sessions(spark, d)).drop("completed_games"),
    ).na.fill(-1)
)

register(
    "enrich_leaderboard",
    """SELECT i.user_id, username, elo_rating, wins, losses, wins / (wins + losses)::DOUBLE AS win_rate
       FROM (SELECT DISTINCT user_id FROM events) i JOIN users u ON u.id = i.user_id
       JOIN ratings r ON r.user_id = i.user_id""",
    "win_rate",
)(
    lambda spark, d: joins.enrich_leaderboard(
        b.events(spark, d).select("user_id").distinct(), b.people(spark, d), b.ratings(spark, d)
    )
)

register(
    "batch_read",
    """SELECT entity_id, CAST(feature_version AS INTEGER) AS feature_version, computed_at FROM feature_rows
       WHERE is_current AND feature_group = 'purchase' AND entity_id IN (SELECT winner_id FROM matches)""",
)(
    lambda spark, d: joins.batch_read(
        b.feature_rows(spark, d),
        b.matches(spark, d).select(F.col("winner_id").alias("entity_id")),
        "user",
        "purchase",
    ).select("entity_id", "feature_version", "computed_at")
)

CHURN_SQL = """
    SELECT u.id AS user_id,
      coalesce(epoch(TIMESTAMP '2001-08-01' - s.last_played_date) / 86400, 999)::DOUBLE AS days_since_last_play,
      coalesce(g.n30 / 4.3, 0)::DOUBLE AS session_frequency,
      coalesce(g.ms / 60000.0, 20)::DOUBLE AS avg_session_duration,
      coalesce(g.n, 0)::DOUBLE AS total_games_played,
      coalesce(g.c14 / nullif(g.n14, 0)::DOUBLE - g.c28 / nullif(g.n28, 0)::DOUBLE, 0)::DOUBLE AS win_rate_trend,
      0.0::DOUBLE AS hint_usage_trend,
      coalesce(g.levels, 0)::DOUBLE AS difficulty_variety,
      coalesce(g.c / nullif(g.n, 0)::DOUBLE, 0.7)::DOUBLE AS completion_rate,
      0.0::DOUBLE AS error_rate_trend,
      coalesce(s.longest_streak, 0)::DOUBLE AS longest_streak
    FROM users u LEFT JOIN session_streaks s ON s.user_id = u.id
    LEFT JOIN (SELECT user_id, count(*) AS n, avg(time_elapsed_ms) AS ms, count(DISTINCT difficulty) AS levels,
        count(*) FILTER (WHERE status = 'completed') AS c,
        count(*) FILTER (WHERE started_at >= DATE '2001-08-01' - 30) AS n30,
        count(*) FILTER (WHERE started_at >= DATE '2001-08-01' - 14) AS n14,
        count(*) FILTER (WHERE started_at >= DATE '2001-08-01' - 14 AND status = 'completed') AS c14,
        count(*) FILTER (WHERE started_at >= DATE '2001-08-01' - 28 AND started_at < DATE '2001-08-01' - 14) AS n28,
        count(*) FILTER (WHERE started_at >= DATE '2001-08-01' - 28 AND started_at < DATE '2001-08-01' - 14
                         AND status = 'completed') AS c28
      FROM plain_sessions GROUP BY 1) g ON g.user_id = u.id"""
CHURN_COLUMNS = (
    "days_since_last_play session_frequency avg_session_duration total_games_played win_rate_trend "
    "hint_usage_trend difficulty_variety completion_rate error_rate_trend longest_streak"
)


def churn_table(spark, d):
    return ft.churn_features(b.people(spark, d), b.session_streaks(spark, d), b.plain_sessions(spark, d), AS_OF)


CHURN_POINTS = """least(0.95, (CASE WHEN days_since_last_play > 30 THEN 0.4 WHEN days_since_last_play > 14 THEN 0.25
      WHEN days_since_last_play > 7 THEN 0.1 ELSE 0.0 END) + (CASE WHEN session_frequency < 0.5 THEN 0.3
      WHEN session_frequency < 1.5 THEN 0.15 ELSE 0.0 END))::DOUBLE"""
SCORED_SQL = f"""SELECT user_id, churn_prob, {risk_sql('churn_prob')} AS risk_level, churn_prob >= 0.7 AS queued
                 FROM (SELECT user_id, {CHURN_POINTS} AS churn_prob FROM ({CHURN_SQL}))"""

register("churn_features", CHURN_SQL, CHURN_COLUMNS, digits=9)(churn_table)
register("churn_heuristic", f"SELECT user_id, {CHURN_POINTS} AS churn_prob FROM ({CHURN_SQL})", "churn_prob")(
    lambda spark, d: churn_table(spark, d).select(
        "user_id", churn_heuristic(F.col("days_since_last_play"), F.col("session_frequency")).alias("churn_prob")
    )
)
register("score_users", SCORED_SQL, "churn_prob")(lambda spark, d: ex.score_users(churn_table(spark, d)))
register(
    "queue_if_absent",
    f"""SELECT user_id, churn_prob FROM ({SCORED_SQL}) WHERE queued
        AND user_id NOT IN (SELECT user_id FROM queue WHERE NOT notified)""",
    "churn_prob",
)(
    lambda spark, d: joins.queue_if_absent(
        ex.score_users(churn_table(spark, d)), b.re_engagement_queue(spark, d)
    ).select("user_id", "churn_prob")
)
register(
    "churn_band_counts",
    f"SELECT risk_level AS risk_band, count(*) AS user_count FROM ({SCORED_SQL}) GROUP BY 1",
)(lambda spark, d: metrics.churn_band_counts(ex.score_users(churn_table(spark, d))))

register(
    "friends_of",
    """SELECT e.user_id, e.friend_id, u.username AS friend_name, coalesce(r.elo_rating, 1200) AS elo_rating
       FROM edges e JOIN users u ON u.id = e.friend_id LEFT JOIN ratings r ON r.user_id = e.friend_id""",
)(lambda spark, d: joins.friends_of(b.friendships(spark, d), b.people(spark, d), b.ratings(spark, d)))


def _activities(spark, d):
    return b.matches(spark, d).select(
        F.col("match_id").alias("activity_id"),
        F.col("winner_id").alias("actor_id"),
        F.col("loser_id").alias("owner_id"),
        F.lit("match_won").alias("type"),
    )


register(
    "fan_out_activity",
    """SELECT activity_id, actor_id, 'match_won' AS type, audience_id FROM (
         SELECT match_id AS activity_id, winner_id AS actor_id, loser_id AS audience_id FROM matches
         UNION SELECT match_id, winner_id, friend_id FROM matches JOIN edges ON edges.user_id = winner_id)""",
)(lambda spark, d: joins.fan_out_activity(_activities(spark, d), b.friendships(spark, d)))

register(
    "exclude_seen",
    """SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
           SELECT user_id, puzzle_id AS item_id, max(score) AS score FROM sessions WHERE puzzle_id IS NOT NULL GROUP BY 1, 2)
         WHERE (user_id, item_id) NOT IN (SELECT (user_id, puzzle_id) FROM sessions
           WHERE status = 'abandoned' AND puzzle_id IS NOT NULL))
       WHERE rank <= 3""",
)(
    lambda spark, d: joins.exclude_seen(
        b.sessions(spark, d)
        .where("puzzle_id IS NOT NULL")
        .groupBy("user_id", F.col("puzzle_id").alias("item_id"))
        .agg(F.max("score").alias("score")),
        b.sessions(spark, d).where("status = 'abandoned'").select("user_id", F.col("puzzle_id").alias("item_id")),
        3,
    )
)

register(
    "user_drilldown",
    """SELECT u.id AS user_id, username, skill_cluster, created_at, coalesce(current_streak, 0) AS current_streak,
              coalesce(longest_streak, 0) AS longest_streak, coalesce(n, 0) AS total_games, coalesce(c, 0) AS completed_games
       FROM users u LEFT JOIN event_streaks s ON s.user_id = u.id
       LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS c
                  FROM plain_sessions GROUP BY 1) g ON g.user_id = u.id
       WHERE skill_cluster = 'Expert'""",
)(
    lambda spark, d: joins.user_drilldown(
        b.users(spark, d), b.event_streaks(spark, d), b.plain_sessions(spark, d), "Expert"
    )
)

register(
    "self_join_ratings",
    """SELECT match_id, winner_id, loser_id, coalesce(w.elo_rating, 1200) AS winner_rating,
              coalesce(l.elo_rating, 1200) AS loser_rating
       FROM matches LEFT JOIN (SELECT * FROM ratings WHERE wins > losses) w ON w.user_id = winner_id
       LEFT JOIN (SELECT * FROM ratings WHERE wins > losses) l ON l.user_id = loser_id""",
)(lambda spark, d: joins.self_join_ratings(b.matches(spark, d), b.ratings(spark, d).where("wins > losses")))

RECONNECT_SECS = 6 * 3600


def _connection_events(spark, d):
    rows = b.events(spark, d).select(F.col("user_id").alias("room_id"), "user_id", "ts", "event_type")
    gone = rows.where("event_type = 'error'").drop("event_type")
    back = rows.where("event_type = 'click'").drop("event_type")
    rooms = rows.select("room_id").distinct().select(
        "room_id", F.col("room_id").alias("player_a"), (F.col("room_id") + 1).alias("player_b")
    )
    return gone, back, rooms


register(
    "reconnect_or_forfeit",
    f"""SELECT room_id, user_id, ts, back_at, CASE WHEN back_at IS NULL THEN 'forfeited' ELSE 'reconnected' END AS outcome,
               coalesce(CASE WHEN back_at IS NULL THEN user_id + 1 END, -1) AS winner_id
        FROM (SELECT g.user_id AS room_id, g.user_id, g.ts, min(r.ts) AS back_at
              FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error') g
              LEFT JOIN events r ON r.user_id = g.user_id AND r.event_type = 'click' AND r.ts > g.ts
                   AND r.ts <= g.ts + INTERVAL {RECONNECT_SECS} SECONDS
              GROUP BY 1, 2, 3)""",
)(
    lambda spark, d: joins.reconnect_or_forfeit(*_connection_events(spark, d), secs=RECONNECT_SECS).na.fill(
        -1, ["winner_id"]
    )
)

FIFO_SQL = """
    WITH RECURSIVE q AS (SELECT difficulty, id, user_id, row_number() OVER (PARTITION BY difficulty ORDER BY started_at, id) AS rn
                         FROM plain_sessions),
    st AS (
      SELECT difficulty, rn, user_id AS waiting, [id] AS entries, CAST(NULL AS BIGINT) AS first_entry,
             CAST(NULL AS BIGINT) AS first_user, id AS second_entry, user_id AS second_user FROM q WHERE rn = 1
      UNION ALL
      SELECT q.difficulty, q.rn,
             CASE WHEN len(entries) > 0 AND waiting <> q.user_id THEN waiting ELSE q.user_id END,
             CASE WHEN len(entries) > 0 AND waiting <> q.user_id THEN entries[2:] ELSE list_append(entries, q.id) END,
             CASE WHEN len(entries) > 0 AND waiting <> q.user_id THEN entries[1] END,
             CASE WHEN len(entries) > 0 AND waiting <> q.user_id THEN waiting END, q.id, q.user_id
      FROM st s JOIN q ON q.difficulty = s.difficulty AND q.rn = s.rn + 1)
    SELECT difficulty, first_entry, first_user, second_entry, second_user FROM st WHERE first_entry IS NOT NULL"""
register("match_fifo", FIFO_SQL)(
    lambda spark, d: joins.match_fifo(b.queue_events(spark, d), F.date_trunc("minute", "enqueued_at"), chunk_rows=700)
)

register(
    "pending_requests",
    """SELECT addressee_id AS user_id, friendship_id, requester_id, username AS requester_name, f.created_at
       FROM friendships f JOIN users u ON u.id = requester_id WHERE status = 'pending'""",
)(lambda spark, d: joins.pending_requests(b.friendships(spark, d), b.people(spark, d)))

HOME_DAY = "2024-01-15"
register(
    "home_view",
    f"""SELECT u.id AS user_id, skill_cluster,
               CASE WHEN skill_cluster IS NULL THEN {quote(vocab.CLUSTER_MESSAGE_NONE)}
                    ELSE {case('skill_cluster', vocab.CLUSTER_MESSAGES, quote(vocab.CLUSTER_MESSAGE_OTHER))} END AS cluster_message,
               {RECOMMENDED} AS recommended, coalesce(current_streak, -1) AS current_streak,
               coalesce(longest_streak, -1) AS longest_streak, picks, p.puzzle_id AS daily_puzzle_id,
               p.difficulty AS daily_difficulty
        FROM users u LEFT JOIN event_streaks s ON s.user_id = u.id
        LEFT JOIN (SELECT user_id, string_agg(puzzle_id, ',' ORDER BY rank) AS picks
                   FROM ({PICKS_SQL}) WHERE rank <= 6 GROUP BY 1) k ON k.user_id = u.id
        LEFT JOIN (SELECT * FROM daily_puzzles WHERE date = DATE '{HOME_DAY}') p ON TRUE""",
)(
    lambda spark, d: joins.home_view(
        b.people(spark, d), b.event_streaks(spark, d), b.daily_puzzles(spark, d), b.puzzles(spark, d), HOME_DAY
    ).na.fill(-1, ["current_streak", "longest_streak"])
)

register(
    "friendship_state",
    """SELECT least(requester_id, addressee_id) AS user_a, greatest(requester_id, addressee_id) AS user_b,
              CASE WHEN bool_or(status = 'blocked') THEN 'blocked' WHEN bool_or(status = 'accepted') THEN 'accepted'
                   ELSE last(status ORDER BY ts, request_id) END AS status, max(ts) AS updated_at
       FROM requests GROUP BY 1, 2""",
)(lambda spark, d: joins.friendship_state(b.friend_requests(spark, d)))

# --- metrics -------------------------------------------------------------------

register("daily_active_users", "SELECT date_key, count(DISTINCT user_hash) AS user_count FROM session_facts GROUP BY 1")(
    lambda spark, d: metrics.daily_active_users(b.session_facts(spark, d))
)
register(
    "completion_rates",
    """SELECT difficulty_key, count(*) AS started_count, count(*) FILTER (WHERE status = 'completed') AS completed_count,
              coalesce(avg(time_elapsed_ms) FILTER (WHERE status = 'completed'), 0) AS avg_time_ms,
              count(*) FILTER (WHERE status = 'completed') / count(*)::DOUBLE AS completion_rate
       FROM session_facts GROUP BY 1""",
    "avg_time_ms completion_rate",
)(lambda spark, d: metrics.completion_rates(b.session_facts(spark, d)))
register(
    "popularity_per_day", "SELECT date_key, difficulty_key, count(*) AS play_count FROM session_facts GROUP BY 1, 2"
)(lambda spark, d: metrics.popularity_per_day(b.session_facts(spark, d)))
register(
    "difficulty_popularity",
    "SELECT difficulty_key, count(*) AS total_plays FROM session_facts WHERE date_key >= 20010601 GROUP BY 1",
)(lambda spark, d: metrics.difficulty_popularity(b.session_facts(spark, d), 61, AS_OF))
register(
    "streak_distribution",
    """SELECT DATE '2024-01-31' AS date, CASE WHEN current_streak = 0 THEN '0' WHEN current_streak <= 7 THEN '1-7'
         WHEN current_streak <= 30 THEN '8-30' WHEN current_streak <= 100 THEN '31-100' ELSE '100+' END AS streak_bucket,
         count(*) AS user_count FROM event_streaks GROUP BY 2""",
)(lambda spark, d: metrics.streak_distribution(b.event_streaks(spark, d), EVENTS_AS_OF))
register(
    "daily_sessions",
    """SELECT date_key, count(*) AS total_sessions, count(*) FILTER (WHERE status = 'completed') AS completed,
              count(DISTINCT user_hash) AS unique_users, avg(time_elapsed_ms) AS avg_time_ms,
              round(count(*) FILTER (WHERE status = 'completed') / count(*)::DOUBLE, 4) AS completion_rate
       FROM session_facts WHERE date_key >= 20000801 GROUP BY 1""",
    "avg_time_ms completion_rate",
)(lambda spark, d: metrics.daily_sessions(b.session_facts(spark, d), 365, AS_OF))
register(
    "elo_trends",
    "SELECT * FROM trends",
)(lambda spark, d: metrics.elo_trends(b.matches(spark, d)))
# Times cut to the day: the match number decides between matches of one time.
register(
    "elo_trends_ties",
    """WITH s AS (SELECT *, CAST(completed_at AS DATE) AS date FROM sides)
       SELECT date, user_id, count(*) AS matches_played, CAST(sum(is_win) AS BIGINT) AS wins, CAST(count(*) - sum(is_win) AS BIGINT) AS losses,
              first(elo_before ORDER BY match_id) AS elo_start, last(elo_after ORDER BY match_id) AS elo_end,
              last(elo_after ORDER BY match_id) - first(elo_before ORDER BY match_id) AS elo_delta FROM s GROUP BY 1, 2""",
)(lambda spark, d: metrics.elo_trends(b.matches(spark, d).withColumn("completed_at", F.date_trunc("day", "completed_at"))))


def _breakdown_sql(column: str) -> str:
    return f"""(SELECT date, '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' AS j
                FROM (SELECT CAST(completed_at AS DATE) AS date, {column} AS k, count(*) AS n FROM matches GROUP BY 1, 2)
                GROUP BY 1)"""


STATS_SQL = f"""
    SELECT t.*, d.j AS difficulty_breakdown, e.j AS end_reason_breakdown
    FROM (SELECT CAST(completed_at AS DATE) AS date, count(*) AS total_matches, avg(duration_ms) AS avg_duration_ms,
                 avg(elo_delta) AS avg_elo_delta FROM matches GROUP BY 1) t
    JOIN {_breakdown_sql('difficulty')} d ON d.date = t.date
    JOIN {_breakdown_sql('end_reason')} e ON e.date = t.date"""
register("match_stats_daily", STATS_SQL, "avg_duration_ms avg_elo_delta")(
    lambda spark, d: metrics.match_stats_daily(b.matches(spark, d))
)
REPORT_SQL = """
    SELECT CAST(completed_at AS DATE) AS date, count(*) AS total_sessions,
           count(*) FILTER (WHERE is_anomalous) AS flagged_count,
           count(*) FILTER (WHERE is_anomalous) / count(*)::DOUBLE AS flag_rate,
           avg(coalesce(anomaly_score, 0)) AS avg_anomaly_score, avg(anomaly_score) AS avg_scored
    FROM enriched WHERE completed_at IS NOT NULL GROUP BY 1"""
register("anomaly_report_daily", REPORT_SQL, "flag_rate avg_anomaly_score avg_scored")(
    lambda spark, d: metrics.anomaly_report_daily(b.enriched_sessions(spark, d))
)
register(
    "skill_segments",
    "SELECT skill_cluster AS skill_segment, count(*) AS user_count FROM users WHERE is_active GROUP BY 1",
)(lambda spark, d: metrics.skill_segments(b.people(spark, d).withColumnRenamed("skill_cluster", "skill_segment")))
register(
    "cluster_distribution",
    """SELECT DATE '2024-01-31' AS date, coalesce(skill_cluster, 'Unassigned') AS cluster, count(*) AS user_count
       FROM users GROUP BY 2""",
)(lambda spark, d: metrics.cluster_distribution(b.people(spark, d), EVENTS_AS_OF))
register(
    "warehouse_summary",
    """SELECT 'row_count' AS measure, 'fact_game_session' AS detail, count(*)::DOUBLE AS value FROM orders
       UNION ALL SELECT 'row_count', 'dim_user', count(*) FROM customer
       UNION ALL SELECT 'min_date_key', '', min(date_key) FROM session_facts
       UNION ALL SELECT 'max_date_key', '', max(date_key) FROM session_facts
       UNION ALL (SELECT 'top_difficulty_30d', difficulty_key, count(*) FROM session_facts WHERE date_key >= 20010702
                  GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3)
       UNION ALL SELECT 'completion_rate_7d', '', round(count(*) FILTER (WHERE status = 'completed') / count(*)::DOUBLE, 4)
                  FROM session_facts WHERE date_key >= 20010725""",
    "value",
)(
    lambda spark, d: metrics.warehouse_summary(
        {"fact_game_session": b.session_facts(spark, d), "dim_user": b.people(spark, d)}, AS_OF
    )
)

LATEST_SQL = """
    SELECT DATE '2024-01-31' AS snapshot_date, row_number() OVER (ORDER BY elo_rating DESC, user_id) AS rank, *
    FROM (SELECT user_id, last(elo_end ORDER BY date) AS elo_rating, CAST(sum(wins) AS BIGINT) AS wins,
                 CAST(sum(losses) AS BIGINT) AS losses FROM trends GROUP BY 1)"""
REFERENCE_SQL = """
    SELECT DATE '2024-01-31' AS snapshot_date, row_number() OVER (ORDER BY elo_rating DESC, user_id) AS rank, *
    FROM (SELECT user_id, elo_end AS elo_rating, CAST(sum(wins) AS BIGINT) AS wins,
                 CAST(sum(losses) AS BIGINT) AS losses FROM trends GROUP BY 1, 2)"""


def leaderboard(spark, d, mode="latest"):
    return ranking.leaderboard_snapshot(metrics.elo_trends(b.matches(spark, d)), EVENTS_AS_OF, 100, mode)


register(
    "leaderboard_snapshot",
    f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({LATEST_SQL}) WHERE rank <= 100",
)(leaderboard)
register(
    "leaderboard_snapshot_by_rating",
    f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({REFERENCE_SQL}) WHERE rank <= 100",
)(lambda spark, d: leaderboard(spark, d, "reference"))
register(
    "competitive_summary",
    f"""SELECT 'top_player' AS measure, CAST(user_id AS VARCHAR) AS detail, elo_rating::DOUBLE AS value
        FROM ({LATEST_SQL}) WHERE rank <= 10
        UNION ALL SELECT 'matches_7d', '', coalesce(sum(total_matches), 0) FROM ({STATS_SQL}) WHERE date >= DATE '2024-01-31' - 7
        UNION ALL SELECT 'anomalies_7d', '', coalesce(sum(flagged_count), 0) FROM ({REPORT_SQL}) WHERE date >= DATE '2024-01-31' - 7""",
    "value",
)(
    lambda spark, d: metrics.competitive_summary(
        leaderboard(spark, d),
        metrics.match_stats_daily(b.matches(spark, d)),
        metrics.anomaly_report_daily(b.enriched_sessions(spark, d)),
        EVENTS_AS_OF,
    )
)
register(
    "feature_store_stats",
    """SELECT feature_group, count(*) FILTER (WHERE is_current) AS current_features, count(*) AS total_versions,
              max(computed_at) AS last_written FROM feature_rows GROUP BY 1""",
)(lambda spark, d: metrics.feature_store_stats(b.feature_rows(spark, d)))
register(
    "experiment_summary",
    """SELECT experiment_name, variant, metric_name, count(*) AS n, avg(metric_value) AS mean, min(metric_value) AS min,
              max(metric_value) AS max, stddev_samp(metric_value) AS stddev FROM experiment_results GROUP BY 1, 2, 3""",
    "mean min max stddev",
)(lambda spark, d: metrics.experiment_summary(b.experiment_results(spark, d)))
register(
    "total_xp",
    """SELECT u.id AS user_id, CAST(coalesce(sum(xp_awarded), 0) AS BIGINT) AS total_xp
       FROM users u LEFT JOIN lesson_progress p ON p.user_id = u.id GROUP BY 1""",
)(lambda spark, d: metrics.total_xp(b.lesson_progress(spark, d), b.people(spark, d)))
BADGES_SQL = """
    WITH done AS (SELECT user_id, p.lesson_id, tier, completed_at - started_at AS took
                  FROM lesson_progress p JOIN lessons USING (lesson_id) WHERE completed),
         per AS (SELECT user_id, count(*) AS n, min(took) AS fastest FROM done GROUP BY 1)
    SELECT user_id, 'first-step' AS badge_id FROM per WHERE n = 1
    UNION ALL SELECT user_id, 'master' FROM per WHERE n = 15
    UNION ALL SELECT user_id, 'speed-learner' FROM per WHERE fastest < INTERVAL 3 MINUTES
    UNION ALL
    SELECT user_id, CASE tier WHEN 1 THEN 'solid-foundation' WHEN 2 THEN 'intermediate' WHEN 3 THEN 'advanced' ELSE 'expert' END
    FROM (SELECT user_id, tier, count(*) AS n FROM done GROUP BY 1, 2) d
    JOIN (SELECT tier AS t, count(*) AS size FROM lessons GROUP BY 1) s ON s.t = d.tier AND s.size = d.n
    WHERE tier <= 4"""
register("lesson_badges", BADGES_SQL)(
    lambda spark, d: metrics.lesson_badges(b.lesson_progress(spark, d), metrics.lessons(spark))
)
register(
    "user_badges",
    f"SELECT b.badge_id, b.user_id, {case('b.badge_id', vocab.BADGES)} AS title FROM ({BADGES_SQL}) b",
)(
    lambda spark, d: metrics.user_badges(
        metrics.lesson_badges(b.lesson_progress(spark, d), metrics.lessons(spark)).unionByName(
            b.people(spark, d).select(F.col("id").alias("user_id"), F.lit("retired-badge").alias("badge_id"))
        )
    )
)
register(
    "lesson_progress_view",
    """SELECT u.id AS user_id, l.lesson_id, coalesce(steps_complete, -1) AS steps_complete, completed,
              coalesce(xp_awarded, -1) AS xp_awarded
       FROM users u CROSS JOIN lessons l LEFT JOIN lesson_progress p ON p.user_id = u.id AND p.lesson_id = l.lesson_id""",
)(
    lambda spark, d: metrics.lesson_progress_view(
        b.people(spark, d), [n for n, _ in vocab.LESSONS], b.lesson_progress(spark, d)
    ).na.fill(-1, ["steps_complete", "xp_awarded"])
)
register(
    "onboarding_status",
    """SELECT u.id AS user_id, started_at IS NOT NULL AS started, coalesce(steps_seen, 0) AS steps_seen,
              coalesce(completed, FALSE) AS completed, coalesce(skipped, FALSE) AS skipped
       FROM users u LEFT JOIN onboarding o ON o.user_id = u.id""",
)(lambda spark, d: metrics.onboarding_status(b.people(spark, d), b.onboarding(spark, d)))
register(
    "model_metrics",
    """SELECT model, count(*) AS total_predictions, round(avg(latency_ms), 2) AS mean_ms, round(max(latency_ms), 2) AS max_ms,
              round(avg(confidence), 4) AS mean_confidence, round(min(confidence), 4) AS min_confidence,
              round(count(*) FILTER (WHERE confidence < 0.7) / count(*)::DOUBLE, 4) AS below_70_pct,
              round(count(*) FILTER (WHERE predicted = actual) / nullif(count(actual), 0)::DOUBLE, 4) AS accuracy,
              round(quantile_cont(latency_ms, 0.5), 2) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 2) AS p95_ms,
              round(quantile_cont(latency_ms, 0.99), 2) AS p99_ms
       FROM predictions GROUP BY 1""",
    "mean_ms max_ms mean_confidence min_confidence below_70_pct accuracy p50_ms p95_ms p99_ms",
)(lambda spark, d: metrics.model_metrics(b.predictions(spark, d)))
register(
    "class_distribution",
    """SELECT model, predicted AS class, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY model)::DOUBLE AS share
       FROM predictions GROUP BY 1, 2""",
    "share",
)(lambda spark, d: metrics.class_distribution(b.predictions(spark, d), ["model"]))
register(
    "alert_rows",
    """SELECT * FROM (SELECT prediction_id, model, ts, latency_ms, confidence, 'latency' AS alert FROM predictions WHERE latency_ms > 500
         UNION ALL SELECT prediction_id, model, ts, latency_ms, confidence, 'confidence' FROM predictions WHERE confidence < 0.3)
       ORDER BY ts DESC, prediction_id DESC, alert LIMIT 10""",
    "latency_ms confidence",
)(lambda spark, d: metrics.alert_rows(b.predictions(spark, d)))


def _match_keys(spark, d):
    return b.matches(spark, d).select(F.date_format("completed_at", "yyyyMMdd").cast("int").alias("date_key"))


register(
    "retention_report",
    """SELECT 'fact_game_session' AS table_name, count(*) AS n_rows, min(date_key) AS min_date_key, max(date_key) AS max_date_key
       FROM session_facts
       UNION ALL SELECT 'fact_match', count(*), min(k), max(k) FROM
         (SELECT CAST(strftime(completed_at, '%Y%m%d') AS INTEGER) AS k FROM matches)""",
)(
    lambda spark, d: metrics.retention_report(
        {"fact_game_session": b.session_facts(spark, d), "fact_match": _match_keys(spark, d)}
    )
)
register(
    "retention_purge_plan",
    """SELECT 'game_sessions' AS table_name, DATE '2001-08-01' - 365 AS cutoff, count(*) FILTER (WHERE started_at < DATE '2001-08-01' - 365) AS n_expired,
              count(*) FILTER (WHERE started_at >= DATE '2001-08-01' - 365) AS n_kept FROM plain_sessions
       UNION ALL SELECT 'anomaly_reports_daily', DATE '2001-08-01' - 180, count(*) FILTER (WHERE d < DATE '2001-08-01' - 180),
              count(*) FILTER (WHERE d >= DATE '2001-08-01' - 180)
              FROM (SELECT DISTINCT CAST(completed_at AS DATE) AS d FROM plain_sessions WHERE completed_at IS NOT NULL)
       UNION ALL SELECT 'fact_game_session', DATE '2001-08-01' - 730, count(*) FILTER (WHERE date_key < 19990802),
              count(*) FILTER (WHERE date_key >= 19990802) FROM session_facts""",
)(
    lambda spark, d: metrics.retention_purge_plan(
        {
            "game_sessions": (b.plain_sessions(spark, d), "started_at"),
            "anomaly_reports_daily": (
                b.plain_sessions(spark, d).where("completed_at IS NOT NULL").select(F.to_date("completed_at").alias("date")).distinct(),
                "date",
            ),
            "fact_game_session": (b.session_facts(spark, d), "date_key"),
        },
        vocab.RETENTION_DAYS,
        AS_OF,
    )
)
BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
register(
    "histogram_quantile",
    f"""WITH h AS (SELECT service, le, count(*) FILTER (WHERE latency_ms <= le) AS n, count(*) AS total
                   FROM api_log, unnest({BOUNDS}::DOUBLE[]) AS t(le) GROUP BY 1, 2),
             s AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY service ORDER BY le) AS below,
                          lag(le, 1, 0.0) OVER (PARTITION BY service ORDER BY le) AS low, 0.95 * total AS rank FROM h)
        SELECT service, CASE WHEN max(n) < max(rank) THEN max(le) ELSE
               min(low + (le - low) * (rank - below) / nullif(n - below, 0)) FILTER (WHERE n >= rank AND below < rank) END AS value
        FROM s GROUP BY 1""",
    "value",
)(lambda spark, d: metrics.histogram_quantile(b.histogram_buckets(spark, d), 0.95, ["service"]))
register("active_streak_users", "SELECT count(*) FILTER (WHERE current_streak > 0) AS active_users FROM event_streaks")(
    lambda spark, d: metrics.active_streak_users(b.event_streaks(spark, d))
)

# --- features ------------------------------------------------------------------

SOLVE_SQL = """coalesce(avg(time_elapsed_ms / 1000.0) FILTER (WHERE difficulty IN ('super_easy', 'easy') AND status = 'completed'), 120)::DOUBLE AS avg_solve_time_easy,
    coalesce(avg(time_elapsed_ms / 1000.0) FILTER (WHERE difficulty = 'medium' AND status = 'completed'), 300)::DOUBLE AS avg_solve_time_medium,
    coalesce(avg(time_elapsed_ms / 1000.0) FILTER (WHERE difficulty IN ('hard', 'super_hard') AND status = 'completed'), 600)::DOUBLE AS avg_solve_time_hard,
    coalesce(count(*) FILTER (WHERE hints_used > 0 AND status = 'completed') / nullif(count(*) FILTER (WHERE status = 'completed'), 0)::DOUBLE, 0.2)::DOUBLE AS hint_rate"""
FROM_USERS = "FROM users u LEFT JOIN sessions s ON s.user_id = u.id"
WEEKLY_SQL = f"""
    SELECT u.id AS user_id, {SOLVE_SQL},
      coalesce(count(*) FILTER (WHERE errors_count > 0 AND status = 'completed') / nullif(count(*) FILTER (WHERE status = 'completed'), 0)::DOUBLE, 0.15)::DOUBLE AS error_rate,
      any_value(coalesce(m.rank, 2)) AS difficulty_preference_mode,
      coalesce(avg(time_elapsed_ms / 60000.0) FILTER (WHERE status = 'completed'), 20)::DOUBLE AS session_length_avg,
      CAST(count(DISTINCT CAST(started_at AS DATE)) FILTER (WHERE started_at >= DATE '2001-08-01' - 30) AS INTEGER) AS days_active_last_30
    {FROM_USERS}
    LEFT JOIN (SELECT user_id AS uid, CAST(CASE difficulty WHEN 'super_easy' THEN 0 WHEN 'easy' THEN 1 WHEN 'medium' THEN 2
                      WHEN 'hard' THEN 3 WHEN 'super_hard' THEN 4 ELSE 5 END AS INTEGER) AS rank
               FROM (SELECT user_id, difficulty, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, difficulty) AS rn
                     FROM plain_sessions GROUP BY 1, 2) WHERE rn = 1) m ON m.uid = u.id
    GROUP BY 1"""
SKILL_COLUMNS = "avg_solve_time_easy avg_solve_time_medium avg_solve_time_hard hint_rate"
register("skill_features_weekly", WEEKLY_SQL, SKILL_COLUMNS + " error_rate session_length_avg", digits=9)(
    lambda spark, d: ft.skill_features_weekly(b.people(spark, d), b.sessions(spark, d), AS_OF)
)
STORE_SQL = f"""
    SELECT u.id AS user_id, {SOLVE_SQL}, coalesce(avg(errors_count), 0)::DOUBLE AS error_rate,
      coalesce(count(*) FILTER (WHERE status = 'completed') / nullif(count(s.id), 0)::DOUBLE, 0.7)::DOUBLE AS completion_rate,
      count(DISTINCT difficulty)::DOUBLE AS difficulty_spread,
      (count(s.id) FILTER (WHERE started_at >= DATE '2001-08-01' - 30))::DOUBLE AS games_last_30d
    {FROM_USERS} GROUP BY 1"""
register(
    "skill_features_store",
    STORE_SQL,
    SKILL_COLUMNS + " error_rate completion_rate difficulty_spread games_last_30d",
    digits=9,
)(lambda spark, d: ft.skill_features_store(b.people(spark, d), b.sessions(spark, d), AS_OF))
TIMING_COLUMNS = (
    "time_mean_norm time_std_norm time_min_norm time_p10_norm error_rate hint_rate fill_rate_norm duration_ratio "
    "completion_ratio consistency_score"
)
TIMING_SQL = f"""
    SELECT user_id, coalesce(m / nullif(hi, 0), 0.5) AS time_mean_norm, coalesce(sd / nullif(m, 1), 0.2) AS time_std_norm,
      coalesce(lo / nullif(m, 1), 0.1) AS time_min_norm, coalesce(p10 / nullif(m, 1), 0.1) AS time_p10_norm,
      coalesce(errors / nullif(minutes, 0), 0) AS error_rate, coalesce(hints / nullif(n, 0), 0) AS hint_rate,
      coalesce(done / nullif(n, 0)::DOUBLE, 0.7) AS fill_rate_norm, coalesce(m / 1800.0, 0.5) AS duration_ratio,
      coalesce(done / nullif(n, 0)::DOUBLE, 0.7) AS completion_ratio, coalesce(1.0 - sd / nullif(m, 1), 0.5) AS consistency_score
    FROM (SELECT u.id AS user_id, avg(t) AS m, stddev_samp(t) AS sd, min(t) AS lo, max(t) AS hi, quantile_cont(t, 0.1) AS p10,
                 avg(errors_count) AS errors, avg(hints_used) AS hints, avg(t) / 60 AS minutes, count(s.id) AS n,
                 count(*) FILTER (WHERE status = 'completed') AS done
          FROM users u LEFT JOIN (SELECT *, time_elapsed_ms / 1000.0::DOUBLE AS t FROM sessions) s ON s.user_id = u.id GROUP BY 1)"""
register("anomaly_features_user", TIMING_SQL, TIMING_COLUMNS, digits=9)(
    lambda spark, d: ft.anomaly_features_user(b.people(spark, d), b.sessions(spark, d))
)
TREND_SQL = """
    SELECT user_id, max(games) AS games, avg(ms) FILTER (WHERE place <= games // 2) AS early_ms,
           avg(ms) FILTER (WHERE place > games // 2) AS late_ms,
           CASE WHEN max(games) >= 6 AND (avg(ms) FILTER (WHERE place <= games // 2) - avg(ms) FILTER (WHERE place > games // 2))
                  / avg(ms) FILTER (WHERE place <= games // 2) > 0.15 THEN 'improving'
                WHEN max(games) >= 6 AND (avg(ms) FILTER (WHERE place <= games // 2) - avg(ms) FILTER (WHERE place > games // 2))
                  / avg(ms) FILTER (WHERE place <= games // 2) < -0.15 THEN 'declining' ELSE 'stable' END AS improvement_trend
    FROM (SELECT user_id, time_elapsed_ms AS ms, count(*) OVER (PARTITION BY user_id) AS games,
                 row_number() OVER (PARTITION BY user_id ORDER BY started_at, id) AS place
          FROM plain_sessions WHERE status = 'completed') GROUP BY 1"""
register("improvement_trend", TREND_SQL, "early_ms late_ms")(
    lambda spark, d: ft.improvement_trend(b.plain_sessions(spark, d))
)
PROFILE_SQL = f"""
    WITH lv AS (SELECT user_id, difficulty, count(*) AS n, CAST(sum(hints_used) AS BIGINT) AS h,
                       avg(time_elapsed_ms) FILTER (WHERE status = 'completed') AS ms,
                       list_position({vocab.DIFFICULTY_ORDER}, difficulty) - 1 AS rank FROM sessions GROUP BY 1, 2)
    SELECT f.*, round(rate, 3) AS hint_usage_rate,
           CASE WHEN rank <= 1 OR rate > 0.5 THEN 'beginner' WHEN rank <= 2 THEN 'intermediate' WHEN rank <= 3 THEN 'advanced'
                ELSE 'expert' END AS skill_level, coalesce(t.improvement_trend, 'stable') AS improvement_trend
    FROM (SELECT user_id, CAST(sum(n) AS BIGINT) AS session_count, first(difficulty ORDER BY n DESC, rank) AS preferred_difficulty,
                 coalesce(string_agg(difficulty || '=' || CAST(round(ms) AS BIGINT), ',' ORDER BY difficulty) FILTER (WHERE ms IS NOT NULL), '') AS times,
                 string_agg(difficulty || '=' || n, ',' ORDER BY difficulty) AS counts
          FROM lv GROUP BY 1) f
    JOIN (SELECT user_id, sum(h) / sum(n)::DOUBLE AS rate, first(rank ORDER BY n DESC, rank) AS rank FROM lv GROUP BY 1) r ON r.user_id = f.user_id
    LEFT JOIN ({TREND_SQL}) t ON t.user_id = f.user_id"""


def _profile(spark, d):
    levels = F.array_sort(F.map_keys("avg_solve_times_ms"))
    shares = F.array_sort(F.map_keys("difficulty_distribution"))
    return ft.user_profile(b.sessions(spark, d)).select(
        "user_id",
        "session_count",
        "preferred_difficulty",
        F.array_join(
            F.transform(levels, lambda k: F.concat(k, F.lit("="), F.round(F.col("avg_solve_times_ms")[k]).cast("long").cast("string"))), ","
        ).alias("times"),
        F.array_join(
            F.transform(
                shares,
                lambda k: F.concat(
                    k, F.lit("="),
                    F.round(F.col("difficulty_distribution")[k] * F.col("session_count")).cast("long").cast("string"),
                ),
            ),
            ",",
        ).alias("counts"),
        "hint_usage_rate",
        "skill_level",
        "improvement_trend",
    )


register("user_profile", PROFILE_SQL, "hint_usage_rate")(_profile)
USER_TEXT_SQL = f"""SELECT user_id, 'Player profile: skill_level=' || skill_level || ', preferred_difficulty=' || preferred_difficulty
          || '. session_count=' || session_count || coalesce('. avg solve times: ' || nullif(
             (SELECT string_agg(difficulty || ' ' || printf('%.1f', ms / 60000.0::DOUBLE) || 'min', ', ' ORDER BY list_position({vocab.DIFFICULTY_ORDER}, difficulty))
              FROM (SELECT user_id AS uid, difficulty, avg(time_elapsed_ms) FILTER (WHERE status = 'completed') AS ms FROM sessions GROUP BY 1, 2)
              WHERE ms IS NOT NULL AND uid = p.user_id), ''), '')
          || '. hint usage rate: ' || printf('%.2f', hint_usage_rate) || '. improvement trend: ' || improvement_trend
          || '. most played: ' || preferred_difficulty || '.' AS text
        FROM ({PROFILE_SQL}) p"""
register("user_text", USER_TEXT_SQL)(lambda spark, d: ft.profile_text(ft.user_profile(b.sessions(spark, d))))

# --- ranks ---------------------------------------------------------------------

register(
    "global_rank",
    """SELECT user_id, elo_rating, wins, losses, wins / (wins + losses)::DOUBLE AS win_rate,
              row_number() OVER (ORDER BY elo_rating DESC, user_id) AS rank FROM ratings""",
    "win_rate",
)(lambda spark, d: ranking.global_rank(b.ratings(spark, d)))
register(
    "friends_leaderboard",
    """SELECT c.user_id, row_number() OVER (PARTITION BY c.user_id ORDER BY coalesce(r.elo_rating, 1200) DESC, c.member_id) AS rank,
              c.member_id, u.username, coalesce(r.elo_rating, 1200) AS elo_rating,
              coalesce(r.wins / nullif(r.wins + r.losses, 0)::DOUBLE, 0) AS win_rate, c.user_id = c.member_id AS is_me
       FROM (SELECT id AS user_id, id AS member_id FROM users UNION ALL SELECT user_id, friend_id FROM edges) c
       JOIN users u ON u.id = c.member_id LEFT JOIN ratings r ON r.user_id = c.member_id""",
    "win_rate",
)(lambda spark, d: ranking.friends_leaderboard(b.friendships(spark, d), b.people(spark, d), b.ratings(spark, d)))
register(
    "score_leaderboard",
    """SELECT difficulty, id, user_id, points, time_elapsed_ms, CAST(rank AS INTEGER) AS rank FROM (
         SELECT difficulty, id, user_id, score AS points, time_elapsed_ms,
                row_number() OVER (PARTITION BY difficulty ORDER BY score DESC, time_elapsed_ms, id) AS rank FROM sessions)
       WHERE rank <= 10""",
)(
    lambda spark, d: ranking.score_leaderboard(
        b.sessions(spark, d).select("difficulty", "id", "user_id", F.col("score").alias("points"), "time_elapsed_ms")
    )
)
register(
    "next_feature_version",
    """SELECT entity_id, entity_type, feature_group, CAST(max(feature_version) + 1 AS INTEGER) AS next_version
       FROM feature_rows GROUP BY 1, 2, 3""",
)(lambda spark, d: ranking.next_feature_version(b.feature_rows(spark, d)))
register(
    "current_features",
    """SELECT entity_id, entity_type, feature_group, CAST(feature_version AS INTEGER) AS feature_version, computed_at, is_current
       FROM feature_rows WHERE is_current""",
)(lambda spark, d: ranking.current_features(b.feature_rows(spark, d)).drop("features"))
register(
    "feature_history",
    """SELECT entity_id, feature_group, CAST(feature_version AS INTEGER) AS feature_version, computed_at FROM feature_rows
       WHERE entity_id = 8 AND feature_group = 'error' ORDER BY feature_version DESC LIMIT 10""",
)(
    lambda spark, d: ranking.feature_history(b.feature_rows(spark, d), 8, "user", "error").select(
        "entity_id", "feature_group", "feature_version", "computed_at"
    )
)
register(
    "rolling_model_metrics",
    """SELECT prediction_id, model, row_number() OVER m AS place, count(*) OVER w AS window_rows, avg(latency_ms) OVER w AS mean_ms,
              max(latency_ms) OVER w AS max_ms, avg(confidence) OVER w AS mean_confidence,
              CAST(sum(CASE WHEN predicted = actual THEN 1 ELSE 0 END) OVER w AS DOUBLE) / nullif(count(actual) OVER w, 0) AS accuracy
       FROM predictions
       WINDOW m AS (PARTITION BY model ORDER BY ts, prediction_id),
              w AS (PARTITION BY model ORDER BY ts, prediction_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
    "mean_ms max_ms mean_confidence accuracy",
    digits=9,
)(lambda spark, d: ranking.rolling_model_metrics(b.predictions(spark, d), F.date_trunc("hour", "ts"), 100))
register("calendar_streaks", "SELECT user_id, current_streak, longest_streak, last_day FROM event_streaks")(
    lambda spark, d: b.event_streaks(spark, d)
)
TOXIC = "{} <> 'clean'".format(category_sql("text"))
register(
    "mute_after_warnings",
    f"""WITH m AS (SELECT room_id, user_id, seq, {strip_sql('text')} AS text FROM chat WHERE {strip_sql('text')} <> ''),
             t AS (SELECT room_id, user_id, seq, {TOXIC} AS is_toxic FROM m),
             r AS (SELECT *, coalesce(sum(CAST(is_toxic AS INTEGER)) OVER (PARTITION BY room_id, user_id ORDER BY seq), 0) AS running FROM t)
        SELECT room_id, user_id, seq, is_toxic, CAST(least(running, 3) AS INTEGER) AS warnings,
               CASE WHEN running - CAST(is_toxic AS INTEGER) >= 3 THEN 'dropped' WHEN is_toxic AND running = 3 THEN 'muted'
                    WHEN is_toxic THEN 'blocked' ELSE 'delivered' END AS fate FROM r""",
)(lambda spark, d: ranking.mute_after_warnings(b.chat(spark, d)))
register(
    "last_messages",
    """SELECT room_id, seq, CAST(rank AS INTEGER) AS rank FROM (SELECT conv_id AS room_id, turn AS seq,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 4""",
)(lambda spark, d: ranking.last_messages(b.chat(spark, d), 4).select("room_id", "seq", "rank"))
register(
    "elo_trend_for_player",
    "SELECT * FROM trends WHERE user_id = 8 AND date >= DATE '2024-01-31' - 20",
)(lambda spark, d: ranking.elo_trend_for_player(metrics.elo_trends(b.matches(spark, d)), 8, 20, EVENTS_AS_OF))
register(
    "first_touch_features",
    """SELECT DISTINCT user_id, first_value(elo_before) OVER w AS elo_start, last_value(elo_after) OVER w AS elo_end,
              count(*) OVER (PARTITION BY user_id) AS matches_played
       FROM sides WINDOW w AS (PARTITION BY user_id ORDER BY completed_at, match_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)(lambda spark, d: ranking.first_touch_features(b.matches(spark, d)))

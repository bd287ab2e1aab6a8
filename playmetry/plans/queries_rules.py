"""Queries of column rules, boards, privacy, experiments, models, vectors and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from playmetry.functions import ids, scoring, text, vocab
from playmetry.operators import boards as bd
from playmetry.operators import experiments as ex
from playmetry.operators import learning, privacy, vectors
from playmetry.operators.metrics import class_distribution
from playmetry.plans import binding as b
from playmetry.plans import oracle as o
from playmetry.plans.queries_players import USER_TEXT_SQL, WEEKLY_SQL
from playmetry.plans.queries_tables import SHARES, UNION_SQL, level_shares
from playmetry.plans.registry import register
from playmetry.streaming import stateful, windows

KEY = b.HASH_KEY

# --- column rules --------------------------------------------------------------

register("pseudonymise", f"SELECT id, {o.hmac_sql('email')} AS email_hash FROM users")(
    lambda spark, d: b.users(spark, d).select("id", ids.pseudonymise(F.col("email"), KEY).alias("email_hash"))
)
register("ab_bucket", f"SELECT user_id, {o.bucket_sql('user_id', 'experiment_name')} AS bucket FROM experiment_users")(
    lambda spark, d: b.experiment_users(spark, d).select(
        "user_id", ids.ab_bucket(F.col("user_id"), F.col("experiment_name")).alias("bucket")
    )
)
register(
    "assign_variant",
    f"""SELECT user_id, experiment_name, bucket, CASE WHEN chosen THEN 'treatment' ELSE 'control' END AS variant,
               coalesce('models:/' || model_name || '/' || CASE WHEN chosen THEN treatment_variant ELSE control_variant END, '') AS model_uri
        FROM (SELECT u.*, c.* EXCLUDE (experiment_name), {o.bucket_sql('u.user_id', 'u.experiment_name')} AS bucket,
                     coalesce(c.status = 'active' AND coalesce(TIMESTAMP '2024-01-31' <= c.end_date, TRUE)
                     AND {o.bucket_sql('u.user_id', 'u.experiment_name')} < floor(c.traffic_split * 100), FALSE) AS chosen
              FROM experiment_users u LEFT JOIN experiment_config c ON c.experiment_name = u.experiment_name)""",
)(lambda spark, d: ex.assign_variant(b.experiment_users(spark, d), b.experiment_config(spark, d), b.EVENTS_AS_OF))
register("model_uri", "SELECT model, 'models:/moderation-' || model || '/Production' AS uri, count(*) AS n FROM predictions GROUP BY 1, 2")(
    lambda spark, d: b.table(spark, d, "documents")
    .groupBy(F.col("lang").alias("model"))
    .agg(F.count(F.lit(1)).alias("n"))
    .withColumn("uri", ids.model_uri(F.concat(F.lit("moderation-"), F.col("model")), F.lit("Production")))
)
_H = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('puzzle.' || p_partkey))"
register(
    "uuid5_id",
    f"""SELECT p_partkey AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
               || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uid
        FROM (SELECT p_partkey, {_H} AS h FROM part)""",
)(
    lambda spark, d: b.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), ids.uuid5_id("puzzle", F.col("p_partkey")).alias("uid")
    )
)
register(
    "elo_expected",
    f"SELECT match_id, {o.elo_gain('winner_elo_before', 'loser_elo_before')} AS expected FROM matches",
    "expected",
)(
    lambda spark, d: b.matches(spark, d).select(
        "match_id", scoring.elo_expected(F.col("winner_elo_before"), F.col("loser_elo_before")).alias("expected")
    )
)
register("elo_k", f"SELECT user_id, {o.elo_k_sql('elo_rating')} AS k FROM ratings")(
    lambda spark, d: b.ratings(spark, d).select("user_id", scoring.elo_k(F.col("elo_rating")).alias("k"))
)
register(
    "elo_update",
    """SELECT match_id, winner_elo_after, loser_elo_after, elo_delta FROM matches""",
)(lambda spark, d: b.matches(spark, d).select("match_id", "winner_elo_after", "loser_elo_after", "elo_delta"))
register(
    "session_score",
    "SELECT id, score FROM sessions",
)(lambda spark, d: b.sessions(spark, d).select("id", "score"))
register(
    "win_rate",
    "SELECT user_id, round(coalesce(wins / nullif(wins + losses, 0)::DOUBLE, 0), 4) AS win_rate FROM ratings",
    "win_rate",
)(
    lambda spark, d: b.ratings(spark, d).select(
        "user_id", F.round(scoring.win_rate(F.col("wins"), F.col("losses")), 4).alias("win_rate")
    )
)
FS = [f"f{i}" for i in range(10)]


def _session_features(spark, d):
    args = ("time_elapsed_ms", "cells_filled", "errors_count", "hints_used", "difficulty")
    features = scoring.anomaly_features_session(*[F.col(c) for c in args])
    return b.sessions(spark, d).select("id", "status", features.alias("f"))


register("anomaly_features_session", f"SELECT id, {', '.join(FS)} FROM enriched", " ".join(FS), digits=9)(
    lambda spark, d: _session_features(spark, d).select("id", "f.*")
)


def _cell_times(spark, d):
    """Sizes of the vector entries stand in for the stored per-cell times of a session."""
    times = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 10_000)
    total = F.aggregate(times, F.lit(0.0), lambda a, x: a + x).cast("long")
    return b.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), times.alias("times"), total.alias("ms"), F.size("embedding").alias("cells")
    )


register(
    "anomaly_features_cells",
    """SELECT id, least(1.0, m / 10000) AS f0, least(1.0, sd / 10000) AS f1, least(1.0, lo / 10000) AS f2,
              least(1.0, p10 / 10000) AS f3, least(1.0, sd / greatest(1.0, m)) AS f9
       FROM (SELECT id, avg(t) AS m, stddev_pop(t) AS sd, min(t) AS lo, quantile_cont(t, 0.1) AS p10
             FROM (SELECT vec_id AS id, abs(unnest(embedding)::DOUBLE) * 10000 AS t FROM embeddings) GROUP BY 1)""",
    "f0 f1 f2 f3 f9",
)(
    lambda spark, d: _cell_times(spark, d)
    .select(
        "id",
        scoring.anomaly_features_session(
            F.col("ms"), F.col("cells"), F.lit(0), F.lit(0), F.lit("medium"), F.col("times")
        ).alias("f"),
    )
    .select("id", "f.f0", "f.f1", "f.f2", "f.f3", "f.f9")
)
register(
    "anomaly_heuristic",
    "SELECT id, anomaly_score, reconstruction_error, is_anomalous FROM enriched",
    "anomaly_score reconstruction_error",
)(
    lambda spark, d: _session_features(spark, d)
    .select("id", scoring.anomaly_heuristic(F.col("f")).alias("a"))
    .select("id", "a.anomaly_score", "a.reconstruction_error", "a.is_anomalous")
)
register("risk_level", f"SELECT user_id, {o.risk_sql('churn_prob')} AS level FROM queue")(
    lambda spark, d: b.re_engagement_queue(spark, d).select(
        "user_id", scoring.risk_level(F.col("churn_prob")).alias("level")
    )
)


def _solve(spark, d):
    from playmetry.operators.features import skill_features_weekly

    return skill_features_weekly(b.people(spark, d), b.sessions(spark, d), b.SESSIONS_AS_OF)


register(
    "skill_heuristic",
    f"""SELECT user_id, CASE WHEN t < 40 AND h < 0.05 THEN 'Expert' WHEN t < 80 AND h < 0.1 THEN 'Advanced'
          WHEN t < 120 AND h < 0.2 THEN 'Intermediate' WHEN t < 200 THEN 'Casual' ELSE 'Beginner' END AS label
        FROM (SELECT user_id, avg_solve_time_easy AS t, hint_rate AS h FROM ({WEEKLY_SQL}))""",
)(
    lambda spark, d: _solve(spark, d).select(
        "user_id", scoring.skill_heuristic(F.col("avg_solve_time_easy"), F.col("hint_rate")).alias("label")
    )
)
register(
    "difficulty_by_clues",
    """SELECT id, CASE WHEN clue_count >= 45 THEN 'super_easy' WHEN clue_count >= 36 THEN 'easy' WHEN clue_count >= 30 THEN 'medium'
         WHEN clue_count >= 26 THEN 'hard' WHEN clue_count >= 22 THEN 'super_hard' ELSE 'extreme' END AS level FROM puzzles""",
)(
    lambda spark, d: b.puzzles(spark, d).select(
        "id", scoring.difficulty_by_clues(F.col("clue_count")).alias("level")
    )
)
register(
    "difficulty_from_score",
    f"""SELECT id, s AS score, {o.pick('round_even(s, 0)', vocab.DIFFICULTY_ORDER)} AS difficulty,
               round(1.0 - abs(s - round_even(s, 0)), 3) AS confidence
        FROM (SELECT p_partkey AS id, greatest(0.0, least(5.0, p_size / 8.0::DOUBLE - 0.5)) AS s FROM part)""",
    "score confidence",
)(
    lambda spark, d: b.table(spark, d, "part")
    .select(F.col("p_partkey").alias("id"), scoring.difficulty_from_score(F.col("p_size") / 8.0 - 0.5).alias("r"))
    .select("id", "r.*")
)
register(
    "toxicity_keywords",
    f"SELECT doc_id, cat AS category, cat <> 'clean' AS is_toxic, CASE WHEN cat <> 'clean' THEN 1.0 ELSE 0.95 END AS confidence "
    f"FROM (SELECT doc_id, {o.category_sql('text')} AS cat FROM documents)",
    "confidence",
)(
    lambda spark, d: b.documents(spark, d)
    .select("doc_id", text.toxicity_keywords(F.col("text")).alias("t"))
    .select("doc_id", "t.*")
)


def _mask_sql(column: str) -> str:
    for n in sorted({len(w) for w in vocab.BLOCKED_WORDS}):
        group = "|".join(w for w in vocab.BLOCKED_WORDS if len(w) == n)
        column = rf"regexp_replace({column}, '(?i)\b({group})\b', '{'*' * n}', 'g')"
    return column


register(
    "mask_profanity",
    f"SELECT doc_id, md5(masked) AS digest, masked <> text AS changed FROM (SELECT doc_id, text, {_mask_sql('text')} AS masked FROM documents)",
)(
    lambda spark, d: b.documents(spark, d)
    .select("doc_id", "text", text.mask_profanity(F.col("text")).alias("masked"))
    .select("doc_id", F.md5(F.encode("masked", "UTF-8")).alias("digest"), (F.col("masked") != F.col("text")).alias("changed"))
)
register(
    "puzzle_text",
    """SELECT id, 'Sudoku puzzle: difficulty=' || difficulty || ', clues=' || clue_count ||
              CASE WHEN clue_count % 2 = 0 THEN '. techniques required: naked-pairs, x-wing, colouring' ELSE '' END ||
              '. avg candidates per cell: ' || printf('%.2f', clue_count / 7.0::DOUBLE) || '. source: archive.' AS text FROM puzzles""",
)(
    lambda spark, d: b.puzzles(spark, d).select(
        "id",
        text.puzzle_text(
            F.col("difficulty"),
            F.col("clue_count"),
            F.when(
                F.col("clue_count") % 2 == 0, F.array(F.lit("x-wing"), F.lit("colouring"), F.lit("naked-pairs"))
            ),
            F.col("clue_count") / F.lit(7.0),
            source=F.lit("archive"),
        ).alias("text"),
    )
)
register(
    "daily_rotation",
    f"SELECT date, difficulty FROM daily_puzzles",
)(lambda spark, d: b.daily_puzzles(spark, d).select("date", "difficulty"))
register(
    "message_prep",
    f"SELECT room_id, seq, md5({o.strip_sql('substr(text, 1, 500)')}) AS digest FROM chat WHERE {o.strip_sql('text')} <> ''",
)(
    lambda spark, d: b.chat(spark, d)
    .select("room_id", "seq", text.message_prep(F.col("text"), 500).alias("t"))
    .where("t IS NOT NULL")
    .select("room_id", "seq", F.md5(F.encode("t", "UTF-8")).alias("digest"))
)

# --- boards --------------------------------------------------------------------

register("explode_cells", 'SELECT puzzle_id, idx, r AS "row", c AS col, box, v AS "value" FROM boards')(
    lambda spark, d: bd.explode_cells(b.boards(spark, d))
)
register(
    "board_conflicts",
    """SELECT puzzle_id, idx, r AS "row", c AS col, v AS "value" FROM (SELECT *,
         count(*) OVER (PARTITION BY puzzle_id, r, v) AS nr, count(*) OVER (PARTITION BY puzzle_id, c, v) AS nc,
         count(*) OVER (PARTITION BY puzzle_id, box, v) AS nb FROM boards WHERE v <> 0)
       WHERE nr > 1 OR nc > 1 OR nb > 1""",
)(lambda spark, d: bd.board_conflicts(b.boards(spark, d)))
register("candidates", "SELECT puzzle_id, idx, d AS digit FROM cands")(lambda spark, d: bd.candidates(b.boards(spark, d)))
register(
    "grid_complete",
    """SELECT puzzle_id, bool_and(v <> 0) AS complete, bool_and(v = sol) AS correct, bool_and(sol <> 0) AS solution_complete
       FROM boards GROUP BY 1""",
)(
    lambda spark, d: b.boards(spark, d).select(
        "puzzle_id",
        bd.grid_complete(F.col("board")).alias("complete"),
        bd.grid_correct(F.col("board"), F.col("solution")).alias("correct"),
        bd.grid_complete(F.col("solution")).alias("solution_complete"),
    )
)
_UNITS = "(SELECT *, 'r' || r AS unit FROM cands UNION ALL SELECT *, 'c' || c FROM cands UNION ALL SELECT *, 'b' || box FROM cands)"
ANALYSIS_SQL = f"""
    cells AS (SELECT puzzle_id, idx, r, c, box, count(*) AS n, string_agg(d, '' ORDER BY d) AS ds FROM cands GROUP BY ALL),
    hidden AS (SELECT DISTINCT puzzle_id, idx FROM (
        SELECT puzzle_id, min(idx) AS idx FROM {_UNITS} GROUP BY puzzle_id, unit, d HAVING count(*) = 1)),
    pairs AS (SELECT puzzle_id, count(*) AS n FROM (SELECT puzzle_id, unit, ds FROM (
        SELECT *, 'r' || r AS unit FROM cells UNION ALL SELECT *, 'c' || c FROM cells UNION ALL SELECT *, 'b' || box FROM cells)
        WHERE n = 2 GROUP BY 1, 2, 3 HAVING count(*) = 2) GROUP BY 1),
    crossing AS (SELECT puzzle_id, box, d, min(r) AS r, min(c) AS c, count(DISTINCT r) = 1 AS one_r, count(DISTINCT c) = 1 AS one_c
        FROM cands GROUP BY 1, 2, 3),
    reach AS (SELECT x.puzzle_id, sum(CAST(one_r AS INT)) + sum(CAST(one_c AS INT)) AS pointing,
        sum(CASE WHEN one_r THEN (SELECT count(*) FROM cands k WHERE k.puzzle_id = x.puzzle_id AND k.d = x.d AND k.r = x.r AND k.box <> x.box) ELSE 0 END)
        + sum(CASE WHEN one_c THEN (SELECT count(*) FROM cands k WHERE k.puzzle_id = x.puzzle_id AND k.d = x.d AND k.c = x.c AND k.box <> x.box) ELSE 0 END) AS lined
        FROM crossing x GROUP BY 1),
    easy AS (SELECT puzzle_id, count(*) AS n FROM (SELECT puzzle_id, idx FROM hidden UNION SELECT puzzle_id, idx FROM cells WHERE n = 1) GROUP BY 1),
    fill AS (SELECT e.puzzle_id, count(*) FILTER (WHERE p.v <> 0) AS m, count(*) FILTER (WHERE p.v <> 0) / 20.0::DOUBLE AS f
        FROM boards e JOIN boards p ON p.puzzle_id = e.puzzle_id AND p.idx <> e.idx AND (p.r = e.r OR p.c = e.c OR p.box = e.box)
        WHERE e.v = 0 GROUP BY e.puzzle_id, e.idx),
    tot AS (SELECT b.puzzle_id, count(*) FILTER (WHERE b.v <> 0) AS clues, count(*) FILTER (WHERE b.v = 0) AS empty,
        count(*) FILTER (WHERE b.v <> 0 AND m.v <> 0) AS mirrored
        FROM boards b JOIN boards m ON m.puzzle_id = b.puzzle_id AND m.idx = 80 - b.idx GROUP BY 1)"""
FEATURES_SQL = f"""
    WITH {ANALYSIS_SQL}
    SELECT t.puzzle_id, clues::DOUBLE AS clue_count, coalesce(s.n1, 0)::DOUBLE AS naked_singles, coalesce(h.n, 0)::DOUBLE AS hidden_singles,
           coalesce(p.n, 0)::DOUBLE AS naked_pairs, coalesce(pointing, 0)::DOUBLE AS pointing_pairs, coalesce(lined, 0)::DOUBLE AS box_line_reduction,
           (greatest(0, empty - coalesce(e.n, 0)) // 5)::DOUBLE AS backtrack_depth, round(coalesce(f.f, 0), 4) AS constraint_density,
           round(coalesce(mirrored / nullif(clues, 0)::DOUBLE, 0), 4) AS symmetry_score,
           round(coalesce(coalesce(s.total, 0) / nullif(empty, 0)::DOUBLE, 0), 4) AS avg_candidate_count
    FROM tot t
    LEFT JOIN (SELECT puzzle_id, count(*) FILTER (WHERE n = 1) AS n1, sum(n) AS total FROM cells GROUP BY 1) s ON s.puzzle_id = t.puzzle_id
    LEFT JOIN (SELECT puzzle_id, count(*) AS n FROM hidden GROUP BY 1) h ON h.puzzle_id = t.puzzle_id
    LEFT JOIN pairs p ON p.puzzle_id = t.puzzle_id LEFT JOIN reach x ON x.puzzle_id = t.puzzle_id
    LEFT JOIN easy e ON e.puzzle_id = t.puzzle_id
    LEFT JOIN (SELECT puzzle_id, CAST(sum(m) AS DOUBLE) / 20.0::DOUBLE / count(*) AS f FROM fill GROUP BY 1) f ON f.puzzle_id = t.puzzle_id"""
register("puzzle_features", FEATURES_SQL, " ".join(bd.FEATURES))(lambda spark, d: bd.puzzle_features(b.boards(spark, d)))
WEIGHTS = {name: 0.1 * (i + 1) for i, name in enumerate(bd.FEATURES)}
_W = {name: f"CAST({abs(value)!r} AS DOUBLE)" for name, value in WEIGHTS.items()}
_BOTH = f"CAST({WEIGHTS['pointing_pairs'] + WEIGHTS['box_line_reduction']!r} AS DOUBLE)"
IMPORTANCE_SQL = f"""
    WITH {ANALYSIS_SQL},
    twins AS (SELECT puzzle_id, r, ds FROM cells WHERE n = 2 GROUP BY ALL HAVING count(*) = 2),
    crossed AS (SELECT DISTINCT k.puzzle_id, k.idx FROM cands k JOIN crossing x ON x.puzzle_id = k.puzzle_id AND x.box = k.box AND x.d = k.d
                WHERE one_r OR one_c),
    peers AS (SELECT e.puzzle_id, e.idx, count(*) FILTER (WHERE p.v <> 0) AS f
        FROM boards e JOIN boards p ON p.puzzle_id = e.puzzle_id AND p.idx <> e.idx AND (p.r = e.r OR p.c = e.c OR p.box = e.box)
        WHERE e.v = 0 GROUP BY 1, 2),
    base AS (SELECT b.puzzle_id, b.idx, b.v = 0 AS hole, coalesce(c.n, 0) AS n, h.idx IS NOT NULL AS hid, t.r IS NOT NULL AS twin,
                    x.idx IS NOT NULL AS cross_cell, coalesce(p.f, 0) AS f,
                    min(c.n) OVER w AS fewest, greatest(1, max(coalesce(p.f, 0)) OVER w) AS densest,
                    greatest(1, sum(CAST(b.v <> 0 AS INTEGER)) OVER w) AS given
             FROM boards b LEFT JOIN cells c ON c.puzzle_id = b.puzzle_id AND c.idx = b.idx
             LEFT JOIN hidden h ON h.puzzle_id = b.puzzle_id AND h.idx = b.idx
             LEFT JOIN twins t ON t.puzzle_id = c.puzzle_id AND t.r = c.r AND t.ds = c.ds
             LEFT JOIN crossed x ON x.puzzle_id = b.puzzle_id AND x.idx = b.idx
             LEFT JOIN peers p ON p.puzzle_id = b.puzzle_id AND p.idx = b.idx
             WINDOW w AS (PARTITION BY b.puzzle_id)),
    scored AS (SELECT puzzle_id, idx, CASE WHEN n = 1 THEN {_W['naked_singles']} ELSE 0 END + CASE WHEN hid THEN {_W['hidden_singles']} ELSE 0 END
        + CASE WHEN twin THEN {_W['naked_pairs']} ELSE 0 END + CASE WHEN cross_cell THEN {_BOTH} ELSE 0 END
        + CASE WHEN hole AND n <= fewest + 1 THEN {_W['backtrack_depth']} ELSE 0 END
        + CASE WHEN n > 0 THEN {_W['avg_candidate_count']} / greatest(n, 1) ELSE 0 END
        + CASE WHEN hole THEN {_W['constraint_density']} * (CAST(f AS DOUBLE) / densest) ELSE 0 END
        + CASE WHEN NOT hole THEN {_W['clue_count']} / given ELSE 0 END + {_W['symmetry_score']} / 81.0 AS s FROM base),
    scaled AS (SELECT puzzle_id, idx, round(coalesce((s - min(s) OVER w) / nullif(max(s) OVER w - min(s) OVER w, 0), 0), 4) AS importance
               FROM scored WINDOW w AS (PARTITION BY puzzle_id))
    SELECT puzzle_id, CAST(rank AS INTEGER) AS rank, idx, importance
    FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_id ORDER BY importance DESC, idx) AS rank FROM scaled)
    WHERE rank <= 9 AND importance > 0"""
register("cell_importance", IMPORTANCE_SQL, "importance")(lambda spark, d: bd.cell_importance(b.boards(spark, d), WEIGHTS))

# --- privacy -------------------------------------------------------------------


def _erase_ids(spark, d):
    return b.people(spark, d).where("NOT is_active").select("id")


def _private_tables(spark, d):
    """Every table that erasure touches, from the bindings."""
    sessions, matches = b.plain_sessions(spark, d), b.matches(spark, d)
    own = lambda name, df: df.select(F.col(name).alias("user_id"))
    hashed = lambda name: ids.pseudonymise(F.col(name), KEY)
    return {
        "feature_store": b.orders(spark, d).select(F.col("o_custkey").alias("entity_id")),
        "ab_test_result": own("o_custkey", b.orders(spark, d).where("o_orderstatus = 'F'")),
        "game_sessions": sessions,
        "streaks": own("id", b.people(spark, d)),
        "daily_puzzle_attempts": own("user_id", sessions.where("status = 'completed'")),
        "lesson_progress": own("user_id", b.events(spark, d).where("event_type = 'signup'")),
        "friendships": b.friendships(spark, d),
        "player_ratings": own("winner_id", matches),
        "multiplayer_matches": matches,
        "activity_feed": own("user_id", b.events(spark, d)),
        "notifications": own("user_id", b.events(spark, d).where("event_type = 'click'")),
        "users": b.people(spark, d),
        "fact_game_session": sessions.select(hashed("user_id").alias("user_hash"), "difficulty"),
        "fact_match": matches.select(hashed("winner_id").alias("winner_hash"), hashed("loser_id").alias("loser_hash")),
        "dim_user": b.people(spark, d).select(hashed("id").alias("user_hash")),
    }


GONE = "(SELECT id FROM users WHERE NOT is_active)"
#: (table, id column, source in SQL) of every erasure target.
ERASED = [
    ("feature_store", "entity_id", "(SELECT o_custkey AS k FROM orders)"),
    ("ab_test_result", "user_id", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')"),
    ("game_sessions", "user_id", "(SELECT user_id AS k FROM plain_sessions)"),
    ("streaks", "user_id", "(SELECT id AS k FROM users)"),
    ("daily_puzzle_attempts", "user_id", "(SELECT user_id AS k FROM plain_sessions WHERE status = 'completed')"),
    ("lesson_progress", "user_id", "(SELECT user_id AS k FROM events WHERE event_type = 'signup')"),
    ("friendships", "requester_id", "(SELECT requester_id AS k, addressee_id AS l FROM friendships)"),
    ("friendships", "addressee_id", "(SELECT addressee_id AS k, requester_id AS l FROM friendships)"),
    ("player_ratings", "user_id", "(SELECT winner_id AS k FROM matches)"),
    ("multiplayer_matches", "winner_id", "(SELECT winner_id AS k, loser_id AS l FROM matches)"),
    ("multiplayer_matches", "loser_id", "(SELECT loser_id AS k, winner_id AS l FROM matches)"),
    ("activity_feed", "user_id", "(SELECT user_id AS k FROM events)"),
    ("notifications", "user_id", "(SELECT user_id AS k FROM events WHERE event_type = 'click')"),
    ("users", "id", "(SELECT id AS k FROM users)"),
    ("fact_game_session", "user_hash", "(SELECT user_id AS k FROM plain_sessions)"),
    ("fact_match", "winner_hash", "(SELECT winner_id AS k, loser_id AS l FROM matches)"),
    ("fact_match", "loser_hash", "(SELECT loser_id AS k, winner_id AS l FROM matches)"),
    ("dim_user", "user_hash", "(SELECT id AS k FROM users)"),
]
ERASE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {s} AS s WHERE k NOT IN {GONE}" + (f" AND l NOT IN {GONE}" if " AS l " in s else "")
    for i, (t, _, s) in enumerate(ERASED)
    if t not in {x for x, _, _ in ERASED[:i]}
)
DRY_RUN_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows FROM {s} AS s WHERE k IN {GONE}" for t, c, s in ERASED
)
register(
    "erase_users",
    ERASE_SQL,
)(lambda spark, d: _row_counts(privacy.erase_users(_private_tables(spark, d), _erase_ids(spark, d), KEY)))


def _row_counts(tables):
    from functools import reduce

    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


register(
    "erase_sessions",
    f"SELECT id, user_id, status FROM plain_sessions WHERE user_id NOT IN {GONE}",
)(
    lambda spark, d: privacy.erase_users(
        {"game_sessions": b.plain_sessions(spark, d)}, _erase_ids(spark, d), KEY,
        absent={t for t, _ in privacy.SOURCE_TARGETS + privacy.WAREHOUSE_TARGETS} - {"game_sessions"},
    )["game_sessions"].select("id", "user_id", "status")
)
register(
    "erasure_dry_run",
    DRY_RUN_SQL,
)(lambda spark, d: privacy.erasure_dry_run(_private_tables(spark, d), _erase_ids(spark, d), KEY))
register(
    "resync_guard",
    f"SELECT id, user_id FROM plain_sessions WHERE user_id NOT IN {GONE}",
)(
    lambda spark, d: privacy.resync_guard(
        b.plain_sessions(spark, d).select("id", "user_id"),
        privacy.erasure_audit(_erase_ids(spark, d), "2024-01-01", "2024-01-02", KEY),
        KEY,
    )
)
register(
    "retention_apply",
    "SELECT id, started_at FROM plain_sessions WHERE started_at >= DATE '2001-08-01' - 365",
)(
    lambda spark, d: privacy.retention_apply(
        {"game_sessions": (b.plain_sessions(spark, d).select("id", "started_at"), "started_at")},
        vocab.RETENTION_DAYS,
        b.SESSIONS_AS_OF,
    )["game_sessions"]
)
register(
    "retention_apply_facts",
    "SELECT date_key, difficulty_key, count(*) AS n FROM session_facts WHERE date_key >= 19990802 GROUP BY 1, 2",
)(
    lambda spark, d: privacy.retention_apply(
        {"fact_game_session": (b.session_facts(spark, d), "date_key")}, vocab.RETENTION_DAYS, b.SESSIONS_AS_OF
    )["fact_game_session"]
    .groupBy("date_key", "difficulty_key")
    .agg(F.count(F.lit(1)).alias("n"))
)
register(
    "retention_apply_daily",
    """SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS dau FROM events GROUP BY 1
       HAVING CAST(ts AS DATE) >= DATE '2024-07-15' - 180""",
)(
    lambda spark, d: privacy.retention_apply(
        {"daily_active_users": (
            b.events(spark, d).groupBy(F.to_date("ts").alias("date")).agg(F.count_distinct("user_id").alias("dau")), "date"
        )},
        vocab.RETENTION_DAYS,
        "2024-07-15",
    )["daily_active_users"]
)

# --- drift, gates, registry ----------------------------------------------------

register(
    "psi_drift",
    f"""SELECT psi, psi > 0.1 AS drift_detected, CASE WHEN psi > 0.25 THEN 'significant_drift' WHEN psi > 0.1 THEN 'moderate_drift'
               ELSE 'no_drift' END AS status
        FROM (SELECT round(sum((cur_share - ref_share) * ln(cur_share / ref_share)), 4) AS psi FROM ({UNION_SQL}))""",
    "psi",
)(lambda spark, d: ex.psi_drift(level_shares(b.puzzles(spark, d)), level_shares(b.plain_sessions(spark, d))))


def _measured(spark, d):
    """Accuracy per language model as two service-level metrics."""
    from playmetry.operators.metrics import model_metrics

    names = {"en": "difficulty-classifier", "fr": "churn-predictor", "de": "skill-clustering", "es": "adaptive-regression"}
    acc = model_metrics(b.predictions(spark, d))
    name = scoring.lookup(F.col("model"), names)
    metric = scoring.lookup(F.col("model"), {"en": "test_accuracy", "fr": "test_f1", "de": "silhouette_score", "es": "test_r2"})
    return acc.select(
        name.alias("model_id"),
        metric.alias("metric"),
        F.when(F.col("model") != "de", F.col("accuracy")).alias("value"),
        F.when(F.col("model") == "de", "training failed").alias("error"),
    )


_SLA_ROWS = ", ".join(
    f"({', '.join(o.quote(x) if not isinstance(x, bool) else str(x) for x in row)})" for row in vocab.SLA_TABLE
)
SLA_SQL = f"""
    SELECT s.model_id, s.metric, CASE WHEN s.full_only OR s.model_id = 'skill-clustering' THEN NULL ELSE round(m.value, 4) END AS value,
           s.threshold::DOUBLE AS threshold, s.comparison,
           CASE WHEN s.full_only THEN TRUE WHEN s.model_id = 'skill-clustering' THEN FALSE
                ELSE coalesce(CASE WHEN s.comparison = 'gte' THEN m.value >= s.threshold ELSE m.value <= s.threshold END, FALSE) END AS passed,
           s.full_only AS skipped,
           CASE WHEN s.full_only THEN 'full check only'
                WHEN s.model_id NOT IN ('difficulty-classifier', 'churn-predictor', 'skill-clustering', 'adaptive-regression') THEN 'not evaluated'
                WHEN s.model_id = 'skill-clustering' THEN 'training failed'
                WHEN m.value IS NULL THEN 'missing metric ' || s.metric END AS reason
    FROM (VALUES {_SLA_ROWS}) AS s(model_id, metric, threshold, comparison, full_only)
    LEFT JOIN (SELECT CASE model WHEN 'en' THEN 'difficulty-classifier' WHEN 'fr' THEN 'churn-predictor' ELSE 'adaptive-regression' END AS model_id,
                      CASE model WHEN 'en' THEN 'test_accuracy' WHEN 'fr' THEN 'test_f1' ELSE 'test_r2' END AS metric,
                      round(count(*) FILTER (WHERE predicted = actual) / nullif(count(actual), 0)::DOUBLE, 4) AS value
               FROM predictions WHERE model IN ('en', 'fr', 'es') GROUP BY model) m ON m.model_id = s.model_id AND m.metric = s.metric"""
register("sla_check", SLA_SQL, "value threshold")(lambda spark, d: ex.sla_check(_measured(spark, d), ex.sla_table(spark)))
register(
    "promotion_gate",
    f"SELECT model_id, bool_and(passed) AS promotable, count(*) FILTER (WHERE NOT passed) AS n_failed FROM ({SLA_SQL}) GROUP BY 1",
)(lambda spark, d: ex.promotion_gate(ex.sla_check(_measured(spark, d), ex.sla_table(spark))))


def _baselines(spark, d):
    return (
        b.api_log(spark, d)
        .groupBy(F.col("service").alias("script"))
        .agg((F.avg("latency_ms") * 2.4).alias("baseline_ms"))
    )


register(
    "baseline_regression_gate",
    """SELECT service AS script, avg(latency_ms) * 2.4 AS baseline_ms, quantile_cont(latency_ms, 0.95) AS p95_ms,
              avg(latency_ms) * 2.4 * 1.2 AS limit_ms, quantile_cont(latency_ms, 0.95) <= avg(latency_ms) * 2.4 * 1.2 AS passed
       FROM api_log GROUP BY 1""",
    "baseline_ms p95_ms limit_ms",
)(
    lambda spark, d: ex.baseline_regression_gate(
        b.api_log(spark, d).select(F.col("service").alias("script"), "latency_ms"), _baselines(spark, d)
    )
)


def _registry_log(spark, d):
    """Orders as a registry log: customer = model, priority = version. A completed order is a
    promotion to production, an open one to staging, a pending one a registration."""
    status = F.col("o_orderstatus")
    return b.orders(spark, d).select(
        F.col("o_custkey").alias("name"),
        F.col("o_orderpriority").alias("version"),
        F.when(status == "P", "register").otherwise("promote").alias("action"),
        F.when(status == "F", "production").when(status == "O", "staging").alias("target_stage"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("event_id"),
    )


register(
    "registry_promote",
    """WITH log AS (SELECT o_custkey AS name, o_orderpriority AS version, o_orderstatus AS s, o_orderdate AS ts, o_orderkey AS id FROM orders
                    WHERE (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'P')),
            born AS (SELECT name, first(version ORDER BY ts, id) AS v FROM log WHERE s = 'P' GROUP BY 1),
            applied AS (SELECT l.*, CASE WHEN s = 'F' OR (s = 'P' AND version = v) THEN 'production' WHEN s = 'O' THEN 'staging' ELSE 'development' END AS stage
                        FROM log l JOIN born USING (name)),
            own AS (SELECT name, version, last(stage ORDER BY ts, id) AS stage, max((ts, id)) AS moment FROM applied GROUP BY 1, 2),
            prod AS (SELECT name, version, (ts, id) AS moment FROM applied WHERE stage = 'production'),
            last_prod AS (SELECT name, version, max(moment) AS moment FROM prod GROUP BY 1, 2),
            pointer AS (SELECT name, last(version ORDER BY moment) AS version FROM prod GROUP BY 1),
            nxt AS (SELECT l.name, l.version, min(p.moment) AS moment FROM last_prod l JOIN prod p ON p.name = l.name AND p.moment > l.moment GROUP BY 1, 2)
       SELECT o.name, o.version, CASE WHEN n.moment IS NOT NULL AND o.moment < n.moment AND o.version IS DISTINCT FROM p.version THEN 'archived'
                                      ELSE o.stage END AS stage, coalesce(o.version = p.version, FALSE) AS is_production
       FROM own o LEFT JOIN nxt n ON n.name = o.name AND n.version = o.version LEFT JOIN pointer p ON p.name = o.name""",
)(lambda spark, d: ex.registry_promote(_registry_log(spark, d)))
register(
    "classification_report",
    """WITH c AS (SELECT actual AS y, predicted AS p, count(*) AS n FROM predictions WHERE actual IS NOT NULL GROUP BY 1, 2),
            k AS (SELECT y AS class FROM c UNION SELECT p FROM c),
            m AS (SELECT class, coalesce((SELECT sum(n) FROM c WHERE y = class AND p = class), 0) AS hit,
                         coalesce((SELECT sum(n) FROM c WHERE y = class), 0) AS support,
                         coalesce((SELECT sum(n) FROM c WHERE p = class), 0) AS claimed FROM k),
            r AS (SELECT class, coalesce(hit / nullif(claimed, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall,
                         coalesce(2.0 * hit / nullif(claimed + support, 0), 0)::DOUBLE AS f1, CAST(support AS BIGINT) AS support FROM m)
       SELECT * FROM r UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r""",
    "precision recall f1",
)(lambda spark, d: ex.classification_report(b.predictions(spark, d)))
register(
    "auc",
    """WITH s AS (SELECT confidence AS s, CAST(actual = 'toxic' AS INTEGER) AS y FROM predictions WHERE actual IS NOT NULL),
            r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM s)
       SELECT (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))::DOUBLE AS auc,
              CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives FROM r""",
    "auc",
)(
    lambda spark, d: ex.auc(
        b.predictions(spark, d).withColumn("y", (F.col("actual") == "toxic").cast("int")), "confidence", "y"
    )
)


def _versions(spark, d):
    """January's first half is stored; the second half arrives as new snapshots."""
    snaps = b.feature_snapshots(spark, d)
    base = snaps.where("computed_at < '2024-01-16'")
    empty = base.limit(0).select(
        F.lit("").alias("id"), "entity_id", "entity_type", "feature_group", F.lit(0).alias("feature_version"), "features",
        F.lit(True).alias("is_current"), F.lit("").alias("pipeline_name"), "computed_at",
    )
    stored, _ = ex.write_feature_version(base, empty, "events", "first half", "daily")
    return ex.write_feature_version(snaps.where("computed_at >= '2024-01-16'"), stored, "events", "second half", "daily")


_FEATURE_ID = "sha256(entity_id || '|' || entity_type || '|' || feature_group || '|' || feature_version)"
register(
    "write_feature_version",
    f"""SELECT {_FEATURE_ID} AS id, entity_id, feature_group, CAST(feature_version AS INTEGER) AS feature_version, is_current, computed_at
        FROM feature_rows""",
)(lambda spark, d: _versions(spark, d)[0].select("id", "entity_id", "feature_group", "feature_version", "is_current", "computed_at"))


def _version_log(spark, d):
    """The log after both halves of January were appended."""
    snaps = b.feature_snapshots(spark, d)
    first, second = snaps.where("computed_at < '2024-01-16'"), snaps.where("computed_at >= '2024-01-16'")
    log = first.limit(0).select(
        F.lit("").alias("id"), "entity_id", "entity_type", "feature_group", F.lit(0).alias("feature_version"), "features",
        F.lit(True).alias("is_current"), F.lit("").alias("pipeline_name"), "computed_at", F.lit("").alias("entry"),
    )
    log = log.unionByName(ex.append_feature_versions(first, log, "events", "first half", "daily")[0])
    return log.unionByName(ex.append_feature_versions(second, log, "events", "second half", "daily")[0])


register(
    "feature_view",
    f"""SELECT {_FEATURE_ID} AS id, entity_id, feature_group, CAST(feature_version AS INTEGER) AS feature_version, is_current, computed_at
        FROM feature_rows""",
)(lambda spark, d: ex.feature_view(_version_log(spark, d)).select("id", "entity_id", "feature_group", "feature_version", "is_current", "computed_at"))
LINEAGE_SQL = f"""
    SELECT {_FEATURE_ID} AS feature_id, 'events' AS source_table, 'second half' AS source_filter, row_count, computed_at
    FROM feature_rows WHERE computed_at >= TIMESTAMP '2024-01-16'"""
register("feature_lineage", LINEAGE_SQL)(lambda spark, d: _versions(spark, d)[1].drop("id"))


def _one_lineage(spark, d):
    lineage = _versions(spark, d)[1]
    wanted = lineage.agg(F.min("feature_id")).scalar()
    return ex.feature_lineage_of(lineage, wanted).drop("id")


register(
    "feature_lineage_of",
    f"SELECT * FROM ({LINEAGE_SQL}) WHERE feature_id = (SELECT min(feature_id) FROM ({LINEAGE_SQL}))",
)(_one_lineage)


# --- models --------------------------------------------------------------------


def _reconstructed(spark, d):
    features = _session_features(spark, d).select("id", "status", "f.*")
    return learning.reconstruction_anomaly(features, FS, k=3)


def _split_sizes(spark, d):
    train, test = learning.stratified_split(b.puzzles(spark, d).select(F.col("id").alias("puzzle_id"), "difficulty"), "difficulty", "puzzle_id")
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("difficulty", "side").agg(F.count(F.lit(1)).alias("n"))


register(
    "stratified_split",
    """WITH c AS (SELECT difficulty, count(*) AS n, CAST(round(count(*) * 20 / 100.0) AS BIGINT) AS t FROM puzzles GROUP BY 1)
       SELECT difficulty, 'train' AS side, n - t AS n FROM c WHERE n > t UNION ALL SELECT difficulty, 'test', t FROM c WHERE t > 0""",
)(_split_sizes)
register("reconstruction_anomaly")(
    lambda spark, d: _reconstructed(spark, d).select("id", "reconstruction_error", "threshold", "anomaly_score", "is_anomalous")
)
# A fitted model as given: means and two components over three features.
_GIVEN = learning.Reconstruction(["f0", "f4", "f7"], [0.3, 0.1, 0.5], [[0.8, 0.1], [0.6, -0.2], [0.0, 0.9]], 0.02)
_X = [f"({f} - {m})" for f, m in zip(_GIVEN.features, _GIVEN.means)]
_Z = ["(" + " + ".join(f"{p[j]} * {x}" for x, p in zip(_X, _GIVEN.parts)) + ")" for j in range(2)]
_GAPS = " + ".join(f"pow({x} - ({p[0]} * {_Z[0]} + {p[1]} * {_Z[1]}), 2)" for x, p in zip(_X, _GIVEN.parts))
_APPLIED = f"(SELECT id, status, ({_GAPS}) / 3 AS reconstruction_error FROM enriched)"


def _applied(spark, d):
    features = _session_features(spark, d).select("id", "status", "f.*")
    return learning.apply_reconstruction(features, _GIVEN)


register(
    "reconstruction_apply",
    f"SELECT id, reconstruction_error, reconstruction_error / 0.02 AS anomaly_score, reconstruction_error > 0.02 AS is_anomalous FROM {_APPLIED}",
    "reconstruction_error anomaly_score",
)(lambda spark, d: _applied(spark, d).select("id", "reconstruction_error", "anomaly_score", "is_anomalous"))
register(
    "anomaly_ratio",
    f"SELECT id, reconstruction_error / 0.02 AS ratio, reconstruction_error > 0.02 AS flagged FROM {_APPLIED}",
    "ratio",
)(
    lambda spark, d: _applied(spark, d)
    .select("id", scoring.anomaly_ratio(F.col("reconstruction_error"), F.col("threshold")).alias("r"))
    .select("id", "r.*")
)
register(
    "detection_rates",
    f"""SELECT status AS truth, count(*) AS n, avg(CASE WHEN reconstruction_error > 0.02 THEN 1.0 ELSE 0.0 END) AS flagged_share
        FROM {_APPLIED} GROUP BY 1""",
    "flagged_share",
)(lambda spark, d: learning.detection_rates(_applied(spark, d), "status"))
_CENTERS = [[60.0, 0.1], [150.0, 0.3], [240.0, 0.6]]
_DIST = "sqrt((avg_solve_time_easy - {0})^2 + (hint_rate - {1})^2)"
register(
    "cluster_confidence",
    f"""SELECT user_id, round(greatest(0.0, least(1.0, 1.0 - least(a, b, c) / ((a + b + c) / 3))), 3) AS confidence
        FROM (SELECT user_id, {_DIST.format(*_CENTERS[0])} AS a, {_DIST.format(*_CENTERS[1])} AS b, {_DIST.format(*_CENTERS[2])} AS c
              FROM ({WEEKLY_SQL}))""",
    "confidence",
)(
    lambda spark, d: learning.centroid_distances(
        _vector(_solve(spark, d), ["avg_solve_time_easy", "hint_rate"]), _CENTERS
    ).select("user_id", scoring.cluster_confidence(F.col("distances")).alias("confidence"))
)


def _vector(df, columns):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="scaled").transform(df)


# --- vectors -------------------------------------------------------------------

QUERY = [((i * 37) % 11 - 5) / 10.0 for i in range(64)]
_Q = f"{QUERY}::DOUBLE[]"
_SCORE = f"round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 9)"
register("top_k_cosine", f"SELECT id, label, {_SCORE} AS score FROM vectors ORDER BY 3 DESC, 1 LIMIT 10", "score")(
    lambda spark, d: vectors.top_k_cosine(b.vectors(spark, d).select("id", "embedding", "label"), QUERY, 10)
)
register(
    "similar_items",
    """SELECT id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM vectors WHERE id = 7)), 9) AS score
       FROM vectors WHERE id <> 7 AND label = (SELECT label FROM vectors WHERE id = 7) ORDER BY 3 DESC, 1 LIMIT 5""",
    "score",
)(
    lambda spark, d: vectors.similar_items(
        b.vectors(spark, d).select("id", "embedding", "label"), 7, 5,
        F.col("label") == b.vectors(spark, d).where("id = 7").select("label").scalar(),
    )
)
register(
    "filtered_search",
    f"SELECT id, level, {_SCORE} AS score FROM vectors WHERE level <= 3 AND list_has_any(tags, ['t1', 'u4']) ORDER BY 3 DESC, 1 LIMIT 10",
    "score",
)(
    lambda spark, d: vectors.filtered_search(
        b.vectors(spark, d).select("id", "embedding", "level", "tags"), QUERY, 10, 3, ["t1", "u4"]
    ).drop("tags")
)
register(
    "items_for_users",
    """SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
         FROM (SELECT u.id AS user_id, i.id AS item_id, round(list_cosine_similarity(u.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS score
               FROM vectors u, vectors i
               WHERE (u.id, i.id) NOT IN (SELECT (id, id + 13 * k) FROM vectors, unnest(range(5)) AS t(k))))
       WHERE rank <= 5""",
    "score",
)(
    lambda spark, d: vectors.items_for_users(
        b.vectors(spark, d),
        b.vectors(spark, d),
        _seen_items(spark, d),
        5,
        cell_bytes=1 << 17,
    )
)


register("items_for_users_hashed")(
    lambda spark, d: vectors.items_for_users_hashed(b.vectors(spark, d), b.vectors(spark, d), _seen_items(spark, d), 5)
)


def _seen_items(spark, d):
    """Seen pairs: the user's own item and four more."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return b.vectors(spark, d).select(F.col("id").alias("user_id"), steps.alias("k")).select(
        "user_id", (F.col("user_id") + 13 * F.col("k")).alias("item_id")
    )


def _vector_sql(source: str, key: str, text: str, dim: int) -> str:
    """Non-zero entries of word-hash vectors."""
    return rf"""
        SELECT {key}, CAST(bucket AS INTEGER) AS bucket,
               CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS value
        FROM (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim} AS bucket, CAST(count(*) AS DOUBLE) AS n
              FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[^\x20\x09-\x0D]+')) AS w FROM {source}) GROUP BY 1, 2)"""


def _entries(df, key: str):
    return df.select(key, F.posexplode("embedding").alias("bucket", "v")).where("v > 0").select(key, "bucket", F.col("v").cast("double").alias("value"))


register("embed_text", _vector_sql("documents", "doc_id", "text", 64), "value")(
    lambda spark, d: _entries(vectors.embed_text(b.documents(spark, d).select("doc_id", "text"), "text", 64), "doc_id")
)
register("aggregate_profile_vector", _vector_sql(f"({USER_TEXT_SQL}) AS profiles", "user_id", "text", 64), "value")(
    lambda spark, d: _entries(vectors.aggregate_profile_vector(b.sessions(spark, d), 64), "user_id")
)
_ASKED = "Sudoku puzzle: difficulty=easy, techniques=the, of, and"
register(
    "search_by_technique",
    f"""WITH docs AS (SELECT doc_id AS id, text, CASE WHEN doc_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty FROM documents
                      UNION ALL SELECT -1, '{_ASKED}', 'asked'),
             v AS (SELECT id, bucket, value FROM ({_vector_sql('docs', 'id', 'text', 64)})),
             s AS (SELECT a.id, sum(a.value * q.value) / sqrt(any_value(n.na)) / sqrt(any_value(n2.na)) AS score
                   FROM v a JOIN v q ON q.bucket = a.bucket AND q.id = -1 JOIN (SELECT id, sum(value * value) AS na FROM v GROUP BY 1) n ON n.id = a.id
                   JOIN (SELECT id, sum(value * value) AS na FROM v GROUP BY 1) n2 ON n2.id = -1 GROUP BY a.id)
        SELECT id, difficulty, score FROM s JOIN docs USING (id) WHERE difficulty = 'easy' ORDER BY round(score, 9) DESC, id LIMIT 10""",
    "score",
)(
    lambda spark, d: vectors.search_by_technique(
        vectors.embed_text(b.documents(spark, d).select(F.col("doc_id").alias("id"), "text"), "text", 64)
        .withColumn("difficulty", F.when(F.col("id") % 2 == 0, "easy").otherwise("hard"))
        .drop("text"),
        ["the", "of", "and"],
        10,
        "easy",
        64,
    )
)

# --- event-time windows --------------------------------------------------------

register(
    "games_per_hour",
    """SELECT CAST(date_trunc('hour', completed_at) AS TIMESTAMP) AS hour, difficulty, count(*) AS games FROM matches GROUP BY 1, 2""",
)(lambda spark, d: windows.games_per_hour(b.matches(spark, d)))
_SLIDES = """(SELECT *, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k::INTEGER) AS w FROM api_log, unnest(range(5)) AS t(k))"""
register(
    "error_rate",
    f"""SELECT w AS window_start, w + INTERVAL 5 MINUTES AS window_end, count(*) AS requests, count(*) FILTER (WHERE failed) AS errors,
               count(*) FILTER (WHERE failed) / count(*)::DOUBLE AS error_rate FROM {_SLIDES} GROUP BY 1""",
    "error_rate",
)(lambda spark, d: windows.error_rate(b.api_log(spark, d)))
register(
    "latency_quantiles",
    f"""SELECT w + INTERVAL 5 MINUTES AS window_end, service, count(*) AS requests, quantile_disc(latency_ms, 0.5) AS p50,
               quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99 FROM {_SLIDES} GROUP BY 1, 2""",
    "p50 p95 p99",
)(lambda spark, d: windows.latency_quantiles(b.api_log(spark, d)))


def _evaluations(spark, d):
    hours = windows.error_rate(b.api_log(spark, d), "6 hours", "1 hour", ["service"])
    return hours.select("service", F.col("window_end").alias("at"), (F.col("error_rate") > 0.05).alias("breached"))


register(
    "sustained_alert",
    """WITH w AS (SELECT service, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k::INTEGER) + INTERVAL 6 HOURS AS tick,
                         count(*) FILTER (WHERE failed) / count(*)::DOUBLE > 0.05 AS bad
                  FROM api_log, unnest(range(6)) AS t(k) GROUP BY 1, 2),
            r AS (SELECT service, tick, epoch(tick)::BIGINT // 3600 - row_number() OVER (PARTITION BY service ORDER BY tick) AS run FROM w WHERE bad),
            g AS (SELECT service, min(tick) AS since, max(tick) AS last_at, count(*) AS evaluations FROM r GROUP BY service, run)
       SELECT service, since, since + INTERVAL 5 HOURS AS fired_at, last_at, evaluations FROM g WHERE last_at - since >= INTERVAL 5 HOURS""",
)(lambda spark, d: windows.sustained_alert(_evaluations(spark, d), ["service"], 3600, 5 * 3600))
register(
    "client_sessions",
    """SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events
       FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
             FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh
                   FROM events)) GROUP BY user_id, s""",
)(lambda spark, d: windows.client_sessions(b.events(spark, d)))
register("dau_by_day", "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1")(
    lambda spark, d: windows.dau_stream(b.events(spark, d))
)
register(
    "counter_rate",
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS increase, count(*) / 86400.0::DOUBLE AS rate
       FROM events GROUP BY 1, 2""",
    "rate",
)(lambda spark, d: windows.counter_rate(b.events(spark, d), ["event_type"], 86400))
register(
    "moving_average",
    """WITH r AS (SELECT CAST(started_at AS DATE) AS date, count(*) FILTER (WHERE status = 'completed') / count(*)::DOUBLE AS rate
                  FROM plain_sessions GROUP BY 1),
            c AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM r), (SELECT max(date) FROM r), INTERVAL 1 DAY)) AS DATE) AS date)
       SELECT c.date, rate, avg(rate) OVER (ORDER BY c.date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS moving_avg
       FROM c LEFT JOIN r ON r.date = c.date""",
    "rate moving_avg",
)(
    lambda spark, d: windows.moving_average(
        b.plain_sessions(spark, d)
        .groupBy(F.to_date("started_at").alias("date"))
        .agg((F.count_if(F.col("status") == "completed") / F.count(F.lit(1))).alias("rate"))
    )
)
register(
    "psi_per_window",
    f"""WITH h AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS w, event_type AS class, count(*) AS n FROM events GROUP BY 1, 2),
             ref AS ({SHARES.format(c='event_type', t='events')}),
             g AS (SELECT t.w, t.total, k.class, k.share FROM (SELECT w, sum(n) AS total FROM h GROUP BY 1) t CROSS JOIN ref k),
             p AS (SELECT g.w, greatest(coalesce(n / total::DOUBLE, 0.001), 0.001) AS cur, greatest(share, 0.001) AS ref
                   FROM g LEFT JOIN h ON h.w = g.w AND h.class = g.class)
        SELECT w AS window_start, psi, psi > 0.1 AS drift_detected FROM (SELECT w, round(sum((cur - ref) * ln(cur / ref)), 4) AS psi FROM p GROUP BY 1)""",
    "psi",
)(
    lambda spark, d: windows.psi_per_window(
        windows.class_counts(b.events(spark, d).withColumnRenamed("event_type", "predicted"), "1 day"),
        class_distribution(b.events(spark, d).withColumnRenamed("event_type", "predicted")).select("class", "share"),
    )
)
_HOUR = 3_600_000
STREAK_SQL = f"""
    WITH RECURSIVE p AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn
                         FROM (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS t FROM events)),
    st AS (
      SELECT user_id, rn, t AS last, 1 AS cur, 1 AS longest, 0 AS fr, CAST(NULL AS BIGINT) AS lg, '' AS ms, 0 AS br, 0 AS fu
      FROM p WHERE rn = 1
      UNION ALL
      SELECT user_id, rn, CASE WHEN again THEN last ELSE t END,
             CASE WHEN again THEN cur WHEN grows THEN cur + 1 ELSE 1 END,
             CASE WHEN NOT again AND grows THEN greatest(longest, cur + 1) ELSE longest END,
             CASE WHEN NOT again AND NOT extend AND held > 0 THEN held - 1 ELSE held END,
             lg2,
             CASE WHEN again OR NOT grows THEN ms
                  WHEN cur + 1 >= 30 AND NOT contains(ms, '30') THEN CASE WHEN ms = '' THEN '30' ELSE ms || ',30' END
                  WHEN cur + 1 >= 7 AND NOT contains(ms, '7') THEN CASE WHEN ms = '' THEN '7' ELSE ms || ',7' END ELSE ms END,
             br + CASE WHEN NOT again AND NOT grows THEN 1 ELSE 0 END,
             fu + CASE WHEN NOT again AND NOT extend AND held > 0 THEN 1 ELSE 0 END
      FROM (SELECT *, extend OR held > 0 AS grows FROM (
        SELECT s.user_id, p.rn, p.t, last, cur, longest, ms, br, fu,
               CASE WHEN fr < 1 AND (lg IS NULL OR p.t - lg >= {7 * 24 * _HOUR}) THEN 1 ELSE fr END AS held,
               CASE WHEN fr < 1 AND (lg IS NULL OR p.t - lg >= {7 * 24 * _HOUR}) THEN p.t ELSE lg END AS lg2,
               p.t - last < {23 * _HOUR} AS again,
               p.t - last <= {25 * _HOUR} OR p.t // {24 * _HOUR} - last // {24 * _HOUR} = 1 AS extend
        FROM st s JOIN p ON p.user_id = s.user_id AND p.rn = s.rn + 1)))
    SELECT user_id, cur AS current_streak, longest AS longest_streak, make_timestamp(last * 1000) AS last_played,
           fr AS freeze_count, fu AS freezes_used, br AS breaks, ms AS milestones
    FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1"""
register("streaks_stateful", STREAK_SQL)(lambda spark, d: stateful.streaks_stateful(b.events(spark, d)))
# Order dates span seven years.
register("streaks_of_orders", STREAK_SQL.replace("epoch_us(ts) // 1000 AS t FROM events", "epoch_us(started_at) // 1000 AS t FROM plain_sessions"))(
    lambda spark, d: stateful.streaks_stateful(b.plain_sessions(spark, d).select("user_id", F.col("started_at").alias("ts")))
)

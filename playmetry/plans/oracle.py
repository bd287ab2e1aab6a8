"""The bindings of `binding.py` in plain SQL, for checking results with another engine."""

from __future__ import annotations

import re

from playmetry.functions import vocab
from playmetry.functions.ids import hmac_pads
from playmetry.plans import binding as b


def case(column: str, table: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


def quote(value) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def hmac_sql(text: str, key: bytes = b.HASH_KEY) -> str:
    inner, outer = (f"unhex('{pad.hex()}')" for pad in hmac_pads(key))
    return f"sha256({outer} || unhex(sha256({inner} || encode(CAST({text} AS VARCHAR)))))"


def elo_gain(mine: str, theirs: str) -> str:
    return f"(1.0 / (1.0 + pow(10.0, ({theirs} - {mine}) / 400.0)))"


def elo_k_sql(r: str) -> str:
    return f"(CASE WHEN {r} < 1400 THEN 32 WHEN {r} < 1800 THEN 24 ELSE 16 END)"


def winner_after(w: str, l: str) -> str:
    return f"greatest({w} + 1, CAST(floor({w} + {elo_k_sql(w)} * (1.0 - {elo_gain(w, l)}) + 0.5) AS INTEGER))"


def loser_after(w: str, l: str) -> str:
    return f"greatest(100, CAST(floor({l} - {elo_k_sql(l)} * {elo_gain(l, w)} + 0.5) AS INTEGER))"


def score_sql(difficulty: str, ms: str, hints: str, errors: str) -> str:
    points = case(difficulty, vocab.SESSION_POINTS, "200")
    return f"greatest(0, CAST({points} - floor({ms} / 60000) - {hints} * 50 - {errors} * 25 AS BIGINT))"


_EDGE = r"[^\p{L}\p{N}_]"


def words_sql(text: str, words: list[str]) -> str:
    return f"regexp_matches({text}, '(?i)(^|{_EDGE})({'|'.join(words)})({_EDGE}|$)')"


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def category_sql(text: str) -> str:
    t = strip_sql(text)
    return (
        f"CASE WHEN {text} IS NULL OR {t} = '' THEN 'clean' "
        f"WHEN {words_sql(t, vocab.SEVERE_PHRASES)} THEN 'severe_toxic' "
        f"WHEN regexp_matches({t}, '(?i){vocab.THREAT_PATTERN}') THEN 'threat' "
        f"WHEN {words_sql(t, vocab.TOXIC_WORDS)} THEN 'toxic' ELSE 'clean' END"
    )


def pick(index: str, values: list) -> str:
    return f"([{', '.join(quote(v) for v in values)}])[CAST({index} AS BIGINT) + 1]"


def day_key(expr: str) -> str:
    return f"CAST(strftime({expr}, '%Y%m%d') AS INTEGER)"


def risk_sql(p: str) -> str:
    return f"CASE WHEN {p} < 0.25 THEN 'low' WHEN {p} < 0.5 THEN 'medium' WHEN {p} < 0.75 THEN 'high' ELSE 'critical' END"


def bucket_sql(user: str, experiment: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({user} AS VARCHAR) || ':' || {experiment}), 1, 8))::BIGINT % 100 AS INTEGER)"


def anomaly_struct(ms: str, cells: str, errors: str, hints: str, difficulty: str) -> str:
    """Ten comma-separated feature columns f0..f9 from session totals."""
    mean = f"(CAST({ms} AS DOUBLE) / greatest(1, {cells}))"
    ctf = case(difficulty, vocab.CELLS_TO_FILL, "45")
    base = case(difficulty, vocab.BASELINE_MS, "300000")
    return f"""
      least(1.0, {mean} / 10000) AS f0,
      least(1.0, {mean} * 0.4 / 10000) AS f1,
      least(1.0, greatest(50.0, {mean} * 0.2) / 10000) AS f2,
      least(1.0, greatest(50.0, {mean} * 0.3) / 10000) AS f3,
      least(1.0, CAST({errors} AS DOUBLE) / greatest(1, {cells} + {errors})) AS f4,
      least(1.0, CAST({hints} AS DOUBLE) / ({ctf})) AS f5,
      least(1.0, {cells} / greatest(1.0, {ms} / 1000.0) / 2.0) AS f6,
      least(1.0, CAST({ms} AS DOUBLE) / ({base})) AS f7,
      least(1.0, CAST({cells} AS DOUBLE) / ({ctf})) AS f8,
      least(1.0, {mean} * 0.4 / greatest(1.0, {mean})) AS f9"""


SUSPICION = (
    "(CASE WHEN f6 > 0.8 AND f0 < 0.02 THEN 0.6 ELSE 0.0 END"
    " + CASE WHEN f4 < 0.02 AND f6 > 0.5 THEN 0.3 ELSE 0.0 END"
    " + CASE WHEN f9 < 0.05 THEN 0.2 ELSE 0.0 END)"
)


def streaks_sql(days: str, as_of: str) -> str:
    return f"""
      SELECT user_id,
             coalesce(max(CASE WHEN last_day >= DATE '{as_of}' - 1 THEN length END), 0) AS current_streak,
             max(length) AS longest_streak, max(last_day) AS last_day
      FROM (SELECT user_id, run, count(*) AS length, max(day) AS last_day
            FROM (SELECT user_id, day,
                         day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run
                  FROM (SELECT DISTINCT user_id, CAST(day AS DATE) AS day FROM {days}))
            GROUP BY user_id, run)
      GROUP BY user_id"""


VIEWS: dict[str, str] = {
    "users": f"""
      SELECT c_custkey AS id, c_name AS username, lower(c_name) || '@example.com' AS email,
             CASE WHEN c_custkey % 11 <> 0 THEN {case('c_mktsegment', b.SEGMENT_LABEL)} END AS skill_cluster,
             CASE WHEN c_custkey % 3 <> 0 THEN 'tok-' || c_custkey END AS fcm_token,
             c_acctbal >= 0 AS is_active, f.created_at
      FROM customer
      LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY 1) f
             ON f.o_custkey = c_custkey""",
    "plain_sessions": f"""
      SELECT o_orderkey AS id, o_custkey AS user_id,
             {case('o_orderstatus', b.STATUS)} AS status,
             {case('o_orderpriority', b.PRIORITY_LEVEL)} AS difficulty,
             CAST(trunc(o_totalprice) AS BIGINT) AS time_elapsed_ms,
             o_orderdate AS started_at,
             CASE WHEN o_orderstatus = 'F'
                  THEN o_orderdate + to_milliseconds(CAST(trunc(o_totalprice) AS BIGINT)) END AS completed_at
      FROM orders""",
    "sessions": f"""
      SELECT s.*, l.puzzle_id, coalesce(l.hints_used, 0) AS hints_used,
             coalesce(l.errors_count, 0) AS errors_count, coalesce(l.cells_filled, 0) AS cells_filled,
             {score_sql('s.difficulty', 's.time_elapsed_ms', 'coalesce(l.hints_used, 0)', 'coalesce(l.errors_count, 0)')} AS score
      FROM plain_sessions s
      LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS puzzle_id,
                        count(*) FILTER (WHERE l_returnflag = 'A') AS hints_used,
                        count(*) FILTER (WHERE l_returnflag = 'R') AS errors_count,
                        least(60, CAST(trunc(sum(l_quantity)) AS INTEGER)) AS cells_filled
                 FROM lineitem GROUP BY 1) l ON l.l_orderkey = s.id""",
    "enriched": f"""
      SELECT *, {SUSPICION} * 0.1 / 0.05 AS anomaly_score, {SUSPICION} * 0.1 AS reconstruction_error,
             {SUSPICION} >= 0.6 AS is_anomalous
      FROM (SELECT *, {anomaly_struct('time_elapsed_ms', 'cells_filled', 'errors_count', 'hints_used', 'difficulty')}
            FROM sessions)""",
    "session_facts": f"""
      SELECT {day_key('started_at')} AS date_key, user_id AS user_hash, difficulty AS difficulty_key,
             status, time_elapsed_ms FROM plain_sessions""",
    "session_streaks": "SELECT *, CAST(last_day AS TIMESTAMP) AS last_played_date FROM ("
    + streaks_sql("(SELECT user_id, started_at AS day FROM plain_sessions)", b.SESSIONS_AS_OF)
    + ")",
    "event_streaks": streaks_sql("(SELECT user_id, ts AS day FROM events)", b.EVENTS_AS_OF),
    "puzzles": f"""
      SELECT p_partkey AS id, {case('p_type', b.PART_LEVEL)} AS difficulty, p_size + 17 AS clue_count,
             TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey AS INTEGER)) AS created_at FROM part""",
    "daily_puzzles": f"""
      SELECT d AS date, min(p_partkey) AS puzzle_id, {pick('dayofweek(d)', vocab.DAILY_ROTATION)} AS difficulty
      FROM (SELECT p_partkey, DATE '2024-01-01' + CAST(p_partkey % 60 AS INTEGER) AS d FROM part) GROUP BY d""",
    "matches": f"""
      SELECT match_id, 'room-' || match_id AS room_id, winner_id, loser_id,
             wb AS winner_elo_before, {winner_after('wb', 'lb')} AS winner_elo_after,
             lb AS loser_elo_before, {loser_after('wb', 'lb')} AS loser_elo_after,
             {winner_after('wb', 'lb')} - wb AS elo_delta,
             {case('kind', b.EVENT_LEVEL)} AS difficulty,
             {pick('match_id % 4', b.END_REASONS)} AS end_reason,
             epoch_us(t1) // 1000 - epoch_us(t0) // 1000 AS duration_ms, t1 AS completed_at
      FROM (SELECT w.match_id, w.user_id AS winner_id, l.user_id AS loser_id, w.event_type AS kind,
                   CAST(1200 + (w.user_id * 37) % 900 AS INTEGER) AS wb,
                   CAST(1200 + (l.user_id * 37) % 900 AS INTEGER) AS lb,
                   greatest(w.ts, l.ts) AS t1, least(w.ts, l.ts) AS t0
            FROM ranked_events w JOIN ranked_events l
              ON w.match_id = l.match_id AND w.rn = 1 AND l.rn = 2 AND w.n = 2
            WHERE w.user_id <> l.user_id)""",
    "ranked_events": """
      SELECT *, event_id // 2 AS match_id, count(*) OVER (PARTITION BY event_id // 2) AS n,
             row_number() OVER (PARTITION BY event_id // 2 ORDER BY value DESC, event_id) AS rn
      FROM events""",
    "sides": """
      SELECT match_id, completed_at, winner_id AS user_id, loser_id AS opponent_id, winner_elo_before AS elo_before,
             winner_elo_after AS elo_after, 1 AS is_win FROM matches
      UNION ALL
      SELECT match_id, completed_at, loser_id, winner_id, loser_elo_before, loser_elo_after, 0 FROM matches""",
    "trends": """
      SELECT CAST(completed_at AS DATE) AS date, user_id, count(*) AS matches_played,
             CAST(sum(is_win) AS BIGINT) AS wins, CAST(count(*) - sum(is_win) AS BIGINT) AS losses,
             first(elo_before ORDER BY completed_at, match_id) AS elo_start,
             last(elo_after ORDER BY completed_at, match_id) AS elo_end,
             last(elo_after ORDER BY completed_at, match_id)
               - first(elo_before ORDER BY completed_at, match_id) AS elo_delta
      FROM sides GROUP BY 1, 2""",
    "ratings": """
      SELECT user_id, last(elo_after ORDER BY completed_at, match_id) AS elo_rating,
             CAST(sum(is_win) AS BIGINT) AS wins, CAST(sum(1 - is_win) AS BIGINT) AS losses
      FROM sides GROUP BY 1""",
    "friendships": f"""
      SELECT a * 1000000 + b AS friendship_id, CASE WHEN (a + b) % 2 = 1 THEN b ELSE a END AS requester_id,
             CASE WHEN (a + b) % 2 = 1 THEN a ELSE b END AS addressee_id,
             {pick('(a * 31 + b) % 4', ['pending', 'accepted', 'declined', 'blocked'])} AS status, created_at
      FROM (SELECT least(winner_id, loser_id) AS a, greatest(winner_id, loser_id) AS b,
                   min(completed_at) AS created_at FROM matches GROUP BY 1, 2)""",
    "edges": """
      SELECT requester_id AS user_id, addressee_id AS friend_id FROM friendships WHERE status = 'accepted'
      UNION
      SELECT addressee_id, requester_id FROM friendships WHERE status = 'accepted'""",
    "requests": f"""
      SELECT match_id AS request_id, winner_id AS requester_id, loser_id AS addressee_id,
             {pick('match_id % 6', ['pending', 'declined', 'pending', 'accepted', 'pending', 'blocked'])} AS status,
             completed_at AS ts FROM matches""",
    "api_log": """
      SELECT event_id, event_type AS service, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 AS failed,
             value AS latency_ms FROM events""",
    "chat": "SELECT conv_id AS room_id, role AS user_id, turn AS seq, text FROM conversations",
    "predictions": f"""
      SELECT doc_id AS prediction_id, lang AS model, CASE WHEN cat = 'clean' THEN 'clean' ELSE 'toxic' END AS predicted,
             CASE toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'clean' END AS actual,
             CASE WHEN cat <> 'clean' OR blank THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END - (doc_id % 10) * 0.08::DOUBLE AS confidence,
             CAST(n_chars AS DOUBLE) AS latency_ms,
             TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS ts
      FROM (SELECT d.*, l.toxic, {category_sql('d.text')} AS cat,
                   d.text IS NULL OR {strip_sql('d.text')} = '' AS blank
            FROM documents d LEFT JOIN labels l USING (doc_id))""",
    "vectors": """
      SELECT vec_id AS id, embedding, label, label % 5 + 1 AS level,
             ['t' || (vec_id % 3), 'u' || (vec_id % 5)] AS tags FROM embeddings""",
    "experiment_config": """
      SELECT 'exp_' || lower(r_name) AS experiment_name, 'model_' || lower(r_name) AS model_name,
             'Production' AS control_variant, 'Staging' AS treatment_variant,
             r_regionkey * 0.2::DOUBLE + 0.09::DOUBLE AS traffic_split,
             CASE WHEN r_regionkey = 3 THEN 'paused' ELSE 'active' END AS status,
             CASE WHEN r_regionkey = 4 THEN TIMESTAMP '2020-01-01' END AS end_date
      FROM region WHERE r_regionkey <> 2""",
    "experiment_users": """
      SELECT c_custkey AS user_id, 'exp_' || lower(r_name) AS experiment_name
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "experiment_results": f"""
      SELECT 'exp_events' AS experiment_name, user_id,
             CASE WHEN {bucket_sql('user_id', "'exp_events'")} < 50 THEN 'treatment' ELSE 'control' END AS variant,
             event_type AS metric_name, value AS metric_value FROM events""",
    "feature_snapshots": """
      SELECT user_id AS entity_id, 'user' AS entity_type, event_type AS feature_group,
             CAST(date_trunc('day', ts) AS TIMESTAMP) AS computed_at, count(*) AS row_count, max(value) AS peak
      FROM events GROUP BY 1, 2, 3, 4""",
    "feature_rows": """
      SELECT *, row_number() OVER (PARTITION BY entity_id, feature_group ORDER BY computed_at) AS feature_version,
             computed_at = max(computed_at) OVER (PARTITION BY entity_id, feature_group) AS is_current
      FROM feature_snapshots""",
    "queue": f"""
      SELECT c_custkey AS id, c_custkey AS user_id, churn_prob, {risk_sql('churn_prob')} AS risk_level,
             c_custkey % 10 = 0 AS notified, TIMESTAMP '2024-01-01' + to_minutes(CAST(c_custkey AS INTEGER)) AS created_at
      FROM (SELECT c_custkey, (c_custkey * 7919 % 1000) / 1000.0::DOUBLE AS churn_prob FROM customer WHERE c_custkey % 5 = 0)""",
    "lesson_progress": f"""
      SELECT user_id, {pick('i', [n for n, _ in vocab.LESSONS])} AS lesson_id, steps_complete, completed,
             started_at, completed_at,
             CASE WHEN completed THEN {pick('i', [vocab.TIER_XP[t] for _, t in vocab.LESSONS])} ELSE 0 END AS xp_awarded
      FROM (SELECT user_id, id % 15 AS i, count(*) AS steps_complete, bool_or(status = 'completed') AS completed,
                   min(started_at) FILTER (WHERE status = 'completed') AS started_at, min(completed_at) AS completed_at
            FROM plain_sessions GROUP BY 1, 2)""",
    "lessons": "SELECT unnest(["
    + ", ".join(f"{{'lesson_id': '{n}', 'tier': {t}}}" for n, t in vocab.LESSONS)
    + "], recursive := true)",
    "onboarding": """
      SELECT user_id, min(started_at) AS started_at, count(*) AS steps_seen,
             bool_or(status = 'completed') AS completed, bool_and(status = 'abandoned') AS skipped
      FROM plain_sessions WHERE user_id % 4 <> 0 GROUP BY 1""",
    "boards": """
      SELECT p_partkey AS puzzle_id, CAST(i AS INTEGER) AS idx, CAST(i // 9 AS INTEGER) AS r, CAST(i % 9 AS INTEGER) AS c,
             CAST((i // 27) * 3 + (i % 9) // 3 AS INTEGER) AS box, CAST(sol AS INTEGER) AS sol,
             CAST(CASE WHEN k % 32 = 0 THEN sol
                  WHEN k % 4 = 0 AND instr('0123456789abcdef', substr(h, i * 5 % 32 + 1, 1)) = 16 THEN sol % 9 + 1
                  WHEN k % 16 <> 0 AND (instr('0123456789abcdef', substr(h, i % 32 + 1, 1)) - 1 + i // 32 * 5) % 16 < 7 THEN 0
                  ELSE sol END AS INTEGER) AS v
      FROM (SELECT p_partkey, p_partkey AS k, md5(p_partkey || '-' || p_name) AS h, i,
                   (3 * ((i // 9) % 3) + (i // 9) // 3 + i % 9 + p_partkey) % 9 + 1 AS sol
            FROM part, unnest(range(81)) AS t(i))""",
    "cands": """
      SELECT b.puzzle_id, b.idx, b.r, b.c, b.box, CAST(d AS INTEGER) AS d
      FROM boards b, unnest(range(1, 10)) AS t(d)
      WHERE b.v = 0
        AND NOT EXISTS (SELECT 1 FROM boards x WHERE x.puzzle_id = b.puzzle_id AND x.v = d AND x.r = b.r)
        AND NOT EXISTS (SELECT 1 FROM boards x WHERE x.puzzle_id = b.puzzle_id AND x.v = d AND x.c = b.c)
        AND NOT EXISTS (SELECT 1 FROM boards x WHERE x.puzzle_id = b.puzzle_id AND x.v = d AND x.box = b.box)""",
}


def with_views(sql: str) -> str:
    """Put the views a statement uses in front of it, dependencies first."""
    if sql.lstrip().upper().startswith("WITH"):
        sql = f"SELECT * FROM ({sql}) AS statement"
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b(FROM|JOIN)\s+\(?\s*{name}\b|,\s*{name}\b(?!\s*[,.(])", text):
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order) + "\n" + sql

"""Fixed vocabularies and thresholds. They must equal the published rules."""

from __future__ import annotations

# Warehouse difficulty levels (key, name, order, fewest clues, most clues).
DIFFICULTY_LEVELS = [
    ("super_easy", "Super Easy", 1, 45, 55),
    ("easy", "Easy", 2, 36, 44),
    ("medium", "Medium", 3, 28, 35),
    ("hard", "Hard", 4, 23, 27),
    ("super_hard", "Super Hard", 5, 20, 22),
    ("extreme", "Extreme", 6, 17, 19),
]
DIFFICULTY_ORDER = [level[0] for level in DIFFICULTY_LEVELS]

# Our choice: the second vocabulary mapped onto the warehouse keys.
CONFORMED_DIFFICULTY = {
    "beginner": "super_easy",
    "super_easy": "super_easy",
    "easy": "easy",
    "medium": "medium",
    "hard": "hard",
    "expert": "super_hard",
    "super_hard": "super_hard",
    "evil": "extreme",
    "extreme": "extreme",
}

# Points per difficulty; anything else scores 200.
SESSION_POINTS = {
    "beginner": 100,
    "easy": 200,
    "medium": 400,
    "hard": 800,
    "expert": 1500,
    "evil": 3000,
}

# Expected solve time in ms; anything else 300000.
BASELINE_MS = {
    "super_easy": 90000,
    "beginner": 120000,
    "easy": 180000,
    "medium": 300000,
    "hard": 480000,
    "expert": 720000,
    "evil": 1200000,
}

# Cells to fill; anything else 45.
CELLS_TO_FILL = {
    "super_easy": 30,
    "beginner": 35,
    "easy": 40,
    "medium": 45,
    "hard": 50,
    "expert": 55,
    "evil": 60,
}

# Skill label to recommended difficulties.
CLUSTER_DIFFICULTIES = {
    "Beginner": ["super_easy", "easy"],
    "Casual": ["easy", "medium"],
    "Intermediate": ["medium", "hard"],
    "Advanced": ["hard", "super_hard"],
    "Expert": ["super_hard", "extreme"],
}
DEFAULT_DIFFICULTIES = ["easy", "medium", "hard"]

# Daily difficulty, Sunday first.
DAILY_ROTATION = ["easy", "medium", "hard", "medium", "expert", "hard", "easy"]

# Home screen message per skill label.
CLUSTER_MESSAGES = {
    "Beginner": "Start with confidence — these puzzles are perfect for building your skills.",
    "Casual": "A great mix to keep things fun and challenging.",
    "Intermediate": "You're making great progress. Ready to push your limits?",
    "Advanced": "Hard puzzles await. You've earned this.",
    "Expert": "Elite-level challenges for elite players.",
}
CLUSTER_MESSAGE_OTHER = "Here are some puzzles for you."
CLUSTER_MESSAGE_NONE = "Complete a few games to unlock personalised recommendations."

# Outreach title and body per risk level; other levels use `high`.
OUTREACH_MESSAGES = {
    "medium": (
        "Your puzzles miss you 🧩",
        "It's been a few days. Keep your streak alive with today's challenge!",
    ),
    "high": (
        "Don't let your streak slip! ⚡",
        "A quick puzzle is all it takes. Come back and keep your skills sharp.",
    ),
    "critical": (
        "We haven't seen you in a while 👋",
        "Your progress is waiting. Jump back in — today's puzzle takes under 5 minutes!",
    ),
}

# Lessons in order (id, tier) and XP per tier.
LESSONS = [
    ("naked-singles", 1),
    ("hidden-singles", 1),
    ("naked-pairs", 2),
    ("hidden-pairs", 2),
    ("pointing-pairs", 2),
    ("box-line-reduction", 2),
    ("naked-triples", 3),
    ("x-wing", 3),
    ("xy-wing", 3),
    ("unique-rectangle", 3),
    ("swordfish", 4),
    ("xyz-wing", 4),
    ("w-wing", 4),
    ("bug-plus-1", 4),
    ("aic", 5),
]
TIER_XP = {1: 100, 2: 200, 3: 350, 4: 500, 5: 750}

# Badge ids and titles; tier badges by lesson tier.
BADGES = {
    "first-step": "First Step",
    "solid-foundation": "Solid Foundation",
    "intermediate": "Intermediate",
    "advanced": "Advanced",
    "expert": "Expert",
    "master": "Master",
    "speed-learner": "Speed Learner",
}
TIER_BADGES = {1: "solid-foundation", 2: "intermediate", 3: "advanced", 4: "expert"}

# Solving techniques, easiest first.
TECHNIQUE_ORDER = [
    "naked-singles",
    "hidden-singles",
    "naked-pairs",
    "hidden-pairs",
    "naked-triples",
    "pointing-pairs",
    "box-line-reduction",
    "x-wing",
    "swordfish",
    "xy-wing",
    "xyz-wing",
    "skyscraper",
    "2-string-kite",
    "w-wing",
    "jellyfish",
    "unique-rectangle",
    "bug-plus-1",
    "finned-x-wing",
    "aic",
    "forcing-chains",
]

# Moderation word lists.
TOXIC_WORDS = [
    "fuck",
    "shit",
    "bitch",
    "asshole",
    "bastard",
    "cunt",
    "damn",
    "idiot",
    "moron",
    "retard",
    "kill",
    "die",
    "hate",
    "racist",
    "nigger",
    "faggot",
    "slut",
    "whore",
]
SEVERE_PHRASES = ["kill yourself", "kys", "go die", "i will kill"]
THREAT_PATTERN = "i (will|ll) (kill|hurt|destroy|find) you"

# Chat filter word list.
BLOCKED_WORDS = [
    "idiot",
    "moron",
    "stupid",
    "retard",
    "loser",
    "noob",
    "suck",
    "sucks",
    "dumb",
    "crap",
    "damn",
    "hell",
    "ass",
    "bitch",
    "bastard",
    "cunt",
    "fuck",
    "fucking",
    "shit",
    "shitty",
    "piss",
    "cock",
    "dick",
    "pussy",
]

# Column names that may not reach the warehouse in plain text.
PII_FIELDS = [
    "user_id",
    "session_id",
    "match_id",
    "winner_id",
    "loser_id",
    "email",
    "username",
    "display_name",
    "ip_address",
    "device_id",
]

# Allowed session statuses (union of the model and the source check).
SESSION_STATUSES = ["in_progress", "paused", "completed", "abandoned", "timed_out"]

# Model service levels (model, metric, threshold, comparison, full check only).
SLA_TABLE = [
    ("difficulty-classifier", "test_accuracy", 0.85, "gte", False),
    ("difficulty-classifier", "test_f1_macro", 0.82, "gte", False),
    ("adaptive-regression", "test_rmse", 0.30, "lte", False),
    ("adaptive-regression", "test_r2", 0.75, "gte", False),
    ("skill-clustering", "silhouette_score", 0.40, "gte", False),
    ("churn-predictor", "test_auc_roc", 0.75, "gte", False),
    ("churn-predictor", "test_f1", 0.65, "gte", False),
    ("digit-scanner", "best_val_accuracy", 0.95, "gte", True),
    ("gan-generator", "best_g_loss", 1.0, "lte", True),
]

# Streak milestones in days.
STREAK_MILESTONES = [7, 30, 100, 365]

# Retention in days per kind of table.
RETENTION_DAYS = {"game_sessions": 365, "fact_game_session": 730, "fact_match": 730, "anomaly_reports_daily": 180, "daily_active_users": 180}

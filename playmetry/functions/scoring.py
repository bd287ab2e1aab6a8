"""Rating, scoring and heuristic rules as native columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from playmetry.functions import vocab


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table, with a default for unknown or NULL keys."""
    found = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


# --- ratings -------------------------------------------------------------------


def elo_expected(mine: Column, theirs: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (theirs - mine) / F.lit(400.0)))


def elo_k(rating: Column) -> Column:
    return F.when(rating < 1400, 32).when(rating < 1800, 24).otherwise(16)


def elo_update(winner: Column, loser: Column) -> Column:
    """New ratings of one match: the winner gains at least 1, the loser keeps at least 100."""

    def rounded(x: Column) -> Column:
        return F.floor(x + F.lit(0.5)).cast("int")

    gain = F.greatest(
        (winner + 1).cast("int"),
        rounded(winner + elo_k(winner) * (F.lit(1.0) - elo_expected(winner, loser))),
    )
    loss = F.greatest(
        F.lit(100), rounded(loser - elo_k(loser) * elo_expected(loser, winner))
    )
    return F.struct(
        gain.alias("winner_after"),
        loss.alias("loser_after"),
        (gain - winner).cast("int").alias("delta"),
    )


def win_rate(wins: Column, losses: Column) -> Column:
    total = wins + losses
    return F.when(total > 0, wins / total).otherwise(F.lit(0.0))


def session_score(difficulty: Column, elapsed_ms: Column, hints: Column, errors: Column) -> Column:
    points = lookup(difficulty, vocab.SESSION_POINTS, 200)
    score = points - F.floor(elapsed_ms / 60000) - hints * 50 - errors * 25
    return F.greatest(F.lit(0).cast("long"), score.cast("long"))


# --- session anomaly -----------------------------------------------------------


def _share(value: Column, cap) -> Column:
    return F.least(F.lit(1.0), value / cap)


def _quantile_of_array(values: Column, p: float) -> Column:
    """Linear interpolation between the sorted neighbours."""
    ordered = F.array_sort(values)
    rank = F.lit(p) * (F.size(values) - 1)
    low = F.floor(rank).cast("int")
    below = F.element_at(ordered, low + 1)
    above = F.element_at(ordered, F.least(low + 2, F.size(values)))
    return below + (above - below) * (rank - low)


def _population_std(values: Column) -> Column:
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(
        values, F.lit(0.0), lambda a, x: a + (x - total / n) * (x - total / n)
    )
    return F.sqrt(squares / n)


def anomaly_features_session(
    elapsed_ms: Column,
    cells_filled: Column,
    errors: Column,
    hints: Column,
    difficulty: Column,
    cell_times_ms: Column | None = None,
    cells_to_fill: Column | None = None,
) -> Column:
    """Ten features in [0, 1] of one session as a struct f0..f9."""
    ctf = lookup(difficulty, vocab.CELLS_TO_FILL, 45)
    if cells_to_fill is not None:
        ctf = F.when(F.coalesce(cells_to_fill, F.lit(0)) != 0, cells_to_fill).otherwise(ctf)
    ctf = F.greatest(F.lit(1), ctf)
    baseline = lookup(difficulty, vocab.BASELINE_MS, 300000)
    mean = elapsed_ms / F.greatest(F.lit(1), cells_filled)
    std = mean * F.lit(0.4)
    low = F.greatest(F.lit(50.0), mean * F.lit(0.2))
    p10 = F.greatest(F.lit(50.0), mean * F.lit(0.3))
    if cell_times_ms is not None:
        times = F.transform(cell_times_ms, lambda x: x.cast("double"))
        many = F.coalesce(F.size(times) >= 2, F.lit(False))
        n = F.size(times)
        mean_t = F.aggregate(times, F.lit(0.0), lambda a, x: a + x) / n
        std = F.when(many, _population_std(times)).otherwise(std)
        low = F.when(many, F.array_min(times)).otherwise(low)
        p10 = F.when(many, _quantile_of_array(times, 0.1)).otherwise(p10)
        mean = F.when(many, mean_t).otherwise(mean)
    attempts = F.greatest(F.lit(1), cells_filled + errors)
    fill_rate = cells_filled / F.greatest(F.lit(1.0), elapsed_ms / F.lit(1000.0))
    return F.struct(
        _share(mean, 10000).alias("f0"),
        _share(std, 10000).alias("f1"),
        _share(low, 10000).alias("f2"),
        _share(p10, 10000).alias("f3"),
        _share(errors, attempts).alias("f4"),
        _share(hints, ctf).alias("f5"),
        _share(fill_rate, 2.0).alias("f6"),
        _share(elapsed_ms, baseline).alias("f7"),
        _share(cells_filled, ctf).alias("f8"),
        F.least(F.lit(1.0), std / F.greatest(F.lit(1.0), mean)).alias("f9"),
    )


def anomaly_heuristic(features: Column, threshold: float = 0.05) -> Column:
    """Additive suspicion, flag at 0.6, and the error and ratio it stands for."""
    f4, f6, f9, f0 = features["f4"], features["f6"], features["f9"], features["f0"]
    suspicion = (
        F.when((f6 > 0.8) & (f0 < 0.02), 0.6).otherwise(0.0)
        + F.when((f4 < 0.02) & (f6 > 0.5), 0.3).otherwise(0.0)
        + F.when(f9 < 0.05, 0.2).otherwise(0.0)
    )
    error = suspicion * F.lit(0.1)
    return F.struct(
        suspicion.alias("suspicion"),
        (suspicion >= 0.6).alias("is_anomalous"),
        error.alias("reconstruction_error"),
        anomaly_ratio(error, F.lit(threshold))["ratio"].alias("anomaly_score"),
    )


def anomaly_ratio(error: Column, threshold: Column) -> Column:
    return F.struct((error / threshold).alias("ratio"), (error > threshold).alias("flagged"))


# --- churn, skill, difficulty --------------------------------------------------


def churn_heuristic(days_idle: Column, sessions_per_week: Column) -> Column:
    points = F.when(days_idle > 30, 0.4).when(days_idle > 14, 0.25).when(days_idle > 7, 0.1).otherwise(0.0)
    points = points + F.when(sessions_per_week < 0.5, 0.3).when(sessions_per_week < 1.5, 0.15).otherwise(0.0)
    return F.least(F.lit(0.95), points)


def risk_level(probability: Column) -> Column:
    return (
        F.when(probability < 0.25, "low")
        .when(probability < 0.5, "medium")
        .when(probability < 0.75, "high")
        .otherwise("critical")
    )


def skill_heuristic(easy_seconds: Column, hint_rate: Column) -> Column:
    return (
        F.when((easy_seconds < 40) & (hint_rate < 0.05), "Expert")
        .when((easy_seconds < 80) & (hint_rate < 0.10), "Advanced")
        .when((easy_seconds < 120) & (hint_rate < 0.20), "Intermediate")
        .when(easy_seconds < 200, "Casual")
        .otherwise("Beginner")
    )


def difficulty_by_clues(clues: Column) -> Column:
    return (
        F.when(clues >= 45, "super_easy")
        .when(clues >= 36, "easy")
        .when(clues >= 30, "medium")
        .when(clues >= 26, "hard")
        .when(clues >= 22, "super_hard")
        .otherwise("extreme")
    )


def difficulty_from_score(score: Column) -> Column:
    """Clamp to 0..5, round half to even, confidence falls with the distance."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(5.0), score))
    nearest = F.rint(clamped)
    names = F.array(*[F.lit(d) for d in vocab.DIFFICULTY_ORDER])
    return F.struct(
        clamped.alias("score"),
        F.element_at(names, nearest.cast("int") + 1).alias("difficulty"),
        F.round(F.lit(1.0) - F.abs(clamped - nearest), 3).alias("confidence"),
    )


def cluster_confidence(distances: Column) -> Column:
    """1 - nearest / mean centroid distance, kept within 0..1."""
    mean = F.aggregate(distances, F.lit(0.0), lambda a, x: a + x) / F.size(distances)
    ratio = F.array_min(distances) / F.nullif(mean, F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - ratio)), 3)


def streak_bucket(days: Column) -> Column:
    return (
        F.when(days == 0, "0")
        .when(days <= 7, "1-7")
        .when(days <= 30, "8-30")
        .when(days <= 100, "31-100")
        .otherwise("100+")
    )


def cluster_difficulties(cluster: Column) -> Column:
    """Recommended difficulties of a skill label; unknown or NULL gets the default list."""
    options = F.create_map(
        *chain.from_iterable(
            (F.lit(name), F.array(*[F.lit(d) for d in levels]))
            for name, levels in vocab.CLUSTER_DIFFICULTIES.items()
        )
    )
    default = F.array(*[F.lit(d) for d in vocab.DEFAULT_DIFFICULTIES])
    return F.coalesce(options[cluster], default)

"""Text rules: moderation, chat preparation, descriptors, log lines, grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playmetry.functions import vocab

_NOT_BEFORE = r"(?<![\p{L}\p{N}_])"
_NOT_AFTER = r"(?![\p{L}\p{N}_])"


def _any_word(words: list[str]) -> str:
    return f"(?iu){_NOT_BEFORE}({'|'.join(words)}){_NOT_AFTER}"


# A whole word of every severe phrase, and of every form of the threat pattern.
_SEVERE_MARKS = [phrase.split()[-1] if " " in phrase else phrase for phrase in vocab.SEVERE_PHRASES]
_THREAT_MARKS = ["kill", "hurt", "destroy", "find"]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def toxicity_keywords(
    text: Column, words: list[str] | None = None, max_chars: int | None = None
) -> Column:
    """Keyword category of the whole text, most serious first; `max_chars` cuts it when set.

    Every pattern holds one of a few whole words. One pass looks for those; only texts that
    have one go through the patterns in order.
    """
    words = words or vocab.TOXIC_WORDS
    cleaned = text if max_chars is None else F.substring(strip(text), 1, max_chars)
    blank = text.isNull() | ~cleaned.rlike(r"[^\s\p{Z}]")
    needed = sorted({*words, *_SEVERE_MARKS, *_THREAT_MARKS})
    category = (
        F.when(blank | ~cleaned.rlike(_any_word(needed)), "clean")
        .when(cleaned.rlike(_any_word(vocab.SEVERE_PHRASES)), "severe_toxic")
        .when(cleaned.rlike("(?iu)" + vocab.THREAT_PATTERN), "threat")
        .when(cleaned.rlike(_any_word(words)), "toxic")
        .otherwise("clean")
    )
    return F.struct(
        (category != "clean").alias("is_toxic"),
        F.when(blank | (category != "clean"), 1.0).otherwise(0.95).alias("confidence"),
        category.alias("category"),
    )


def mask_profanity(text: Column, words: list[str] | None = None) -> Column:
    """Replace blocked whole words (ASCII word borders) with as many asterisks."""
    words = words or vocab.BLOCKED_WORDS

    def pattern(group: list[str]) -> str:
        return f"(?i)(?<![A-Za-z0-9_])({'|'.join(group)})(?![A-Za-z0-9_])"

    by_length: dict[int, list[str]] = {}
    for word in words:
        by_length.setdefault(len(word), []).append(word)
    masked = text
    for length, group in by_length.items():
        masked = F.regexp_replace(masked, pattern(group), "*" * length)
    # Most texts have none of the words and need one pass only.
    return F.when(text.rlike(pattern(words)), masked).otherwise(text)


def message_prep(text: Column, n: int | None = None) -> Column:
    """Chat text as the room sees it: trimmed, cut to `n` characters where a room asks for it;
    blank becomes NULL."""
    blank = strip(text) == ""
    return F.when(~blank, strip(text if n is None else F.substring(text, 1, n)))


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with `digits` places, rounded on the exact binary value, ties to even.

    The product with the power of ten is taken in two exact halves, so the place of the
    value against the midpoint is known without rounding error.
    """
    scale = float(10**digits)
    x = value.cast("double")
    low = F.floor(x * scale).cast("double")
    carrier = x * F.lit(134217729.0)
    high_part = carrier - (carrier - x)
    side = (high_part * scale - (low + 0.5)) + (x - high_part) * scale
    up = (side > 0) | ((side == 0) & (low % 2 == 1))
    return F.format_string(f"%.{digits}f", (low + up.cast("double")) / scale)


def puzzle_text(
    difficulty: Column,
    clues: Column,
    techniques: Column | None = None,
    avg_candidates: Column | None = None,
    backtrack_depth: Column | None = None,
    constraint_density: Column | None = None,
    symmetry: Column | None = None,
    source: Column | None = None,
) -> Column:
    """Descriptor of a puzzle; a NULL part is left out."""

    def part(label: str, value: Column | None, digits: int) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        text = fixed(value, digits) if digits else value.cast("string")
        return F.when(value.isNotNull(), F.concat(F.lit(label), text))

    head = F.concat(
        F.lit("Sudoku puzzle: difficulty="), difficulty, F.lit(", clues="), clues.cast("string")
    )
    if techniques is None:
        tech = F.lit(None).cast("string")
    else:
        known = F.array(*[F.lit(t) for t in vocab.TECHNIQUE_ORDER])
        listed = F.concat(
            F.filter(known, lambda t: F.array_contains(techniques, t)),
            F.filter(techniques, lambda t: ~F.array_contains(known, t)),
        )
        tech = F.when(
            F.size(techniques) > 0,
            F.concat(F.lit("techniques required: "), F.array_join(listed, ", ")),
        )
    origin = (
        F.lit(None).cast("string")
        if source is None
        else F.when(source != "engine", F.concat(F.lit("source: "), source))
    )
    return F.concat(
        F.concat_ws(
            ". ",
            head,
            tech,
            part("avg candidates per cell: ", avg_candidates, 2),
            part("backtrack depth: ", backtrack_depth, 0),
            part("constraint density: ", constraint_density, 2),
            part("symmetry: ", symmetry, 2),
            origin,
        ),
        F.lit("."),
    )


def user_text(
    skill_level: Column,
    preferred: Column,
    session_count: Column,
    avg_ms: Column,
    hint_rate: Column,
    trend: Column,
    most_played: Column,
) -> Column:
    """Descriptor of a player profile; `avg_ms` maps difficulty to mean solve time."""
    times = F.array_join(
        F.filter(
            F.array(
                *[
                    F.when(
                        avg_ms[d].isNotNull(),
                        F.concat(F.lit(d + " "), fixed(avg_ms[d] / F.lit(60000.0), 1), F.lit("min")),
                    )
                    for d in vocab.DIFFICULTY_ORDER
                ]
            ),
            lambda t: t.isNotNull(),
        ),
        ", ",
    )
    return F.concat(
        F.concat_ws(
            ". ",
            F.concat(
                F.lit("Player profile: skill_level="),
                skill_level,
                F.lit(", preferred_difficulty="),
                preferred,
            ),
            F.concat(F.lit("session_count="), session_count.cast("string")),
            F.when(times != "", F.concat(F.lit("avg solve times: "), times)),
            F.concat(F.lit("hint usage rate: "), fixed(hint_rate, 2)),
            F.concat(F.lit("improvement trend: "), trend),
            F.concat(F.lit("most played: "), most_played),
        ),
        F.lit("."),
    )


def flatten_grid(grid: Column, field: str | None = "value") -> Column:
    """Nine rows of cells as 81 ints; `field` names the value of a struct cell."""
    cell = (lambda c: F.coalesce(c[field], F.lit(0)).cast("int")) if field else (
        lambda c: F.coalesce(c, F.lit(0)).cast("int")
    )
    return F.flatten(F.transform(grid, lambda row: F.transform(row, cell)))


def parse_service_log(service: Column, line: Column) -> Column:
    """Fields of one log line, by service: JSON for the two API services, patterns for the rest."""
    api = F.from_json(
        line,
        "level string, message string, requestId string, userId string, status string, durationMs double",
    )
    game = F.from_json(line, "level string, msg string, room_id string")
    plain = r"^(\w+)\s+(.+)$"
    flow = r"^\[([^\]]+)\] \{[^}]+\} (\w+) - (.+)$"
    is_api, is_game = service == "game-service", service == "multiplayer"
    is_plain, is_flow = service == "ml-service", service.rlike("^airflow.*$")

    def extract(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))

    return F.struct(
        F.when(is_api, api["level"])
        .when(is_game, game["level"])
        .when(is_plain, extract(plain, 1))
        .when(is_flow, extract(flow, 2))
        .alias("level"),
        F.when(is_api, api["message"])
        .when(is_game, game["msg"])
        .when(is_plain, extract(plain, 2))
        .when(is_flow, extract(flow, 3))
        .alias("message"),
        F.when(is_api, api["requestId"]).alias("request_id"),
        F.when(is_api, api["userId"]).alias("user_id"),
        F.when(is_api, api["status"]).alias("status"),
        F.when(is_api, api["durationMs"]).alias("duration_ms"),
        F.when(is_game, game["room_id"]).alias("room"),
        F.when(is_flow, extract(flow, 1)).alias("ts"),
    )

"""Puzzle-table jobs. A board is one row of 81 ints (0 = empty), so every rule is a column
expression over that row: millions of boards need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = [[9 * r + c for c in range(9)] for r in range(9)]
COLUMNS = [[9 * r + c for r in range(9)] for c in range(9)]
BOXES = [
    [9 * (3 * br + dr) + 3 * bc + dc for dr in range(3) for dc in range(3)]
    for br in range(3)
    for bc in range(3)
]
HOUSES = ROWS + COLUMNS + BOXES
PEERS = [
    sorted({j for house in HOUSES if i in house for j in house} - {i}) for i in range(81)
]
# Positions in HOUSES of the row, column and box of each cell.
HOUSES_OF = [[n for n, house in enumerate(HOUSES) if i in house] for i in range(81)]
# Where a box meets a line: the cells of both, of the box only, and of the line only.
CROSSINGS = [
    ([i for i in line if i in box], [i for i in box if i not in line], [i for i in line if i not in box])
    for line in ROWS + COLUMNS
    for box in BOXES
    if set(line) & set(box)
]
CROSSINGS_OF = [[n for n, (both, _, _) in enumerate(CROSSINGS) if i in both] for i in range(81)]
FEATURES = [
    "clue_count",
    "naked_singles",
    "hidden_singles",
    "naked_pairs",
    "pointing_pairs",
    "box_line_reduction",
    "backtrack_depth",
    "constraint_density",
    "symmetry_score",
    "avg_candidate_count",
]


def _table(rows: list[list[int]]) -> Column:
    inner = ",".join(f"array({','.join(map(str, row))})" for row in rows)
    return F.expr(f"array({inner})")


def let(value: Column, body) -> Column:
    """`body` of a value computed once per row. A plain alias read inside a lambda may be
    inlined by the optimizer and then computed again at every step of the loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cells() -> Column:
    return F.sequence(F.lit(0), F.lit(80))


def explode_cells(boards: DataFrame) -> DataFrame:
    """Long form: one row per cell."""
    # An inner explode of a column lets the optimizer test that column's size below the exchange
    # that dealt the boards, which makes every board twice, the first time in the tasks of the scan.
    cell = boards.select("puzzle_id", F.posexplode_outer("board").alias("idx", "value")).where("idx IS NOT NULL")
    row, col = F.floor(F.col("idx") / 9), F.col("idx") % 9
    return cell.select(
        "puzzle_id",
        "idx",
        row.cast("int").alias("row"),
        col.cast("int").alias("col"),
        (F.floor(row / 3) * 3 + F.floor(col / 3)).cast("int").alias("box"),
        F.col("value").cast("int").alias("value"),
    )


def conflict_cells(board: Column) -> Column:
    """Indexes of filled cells whose value also stands in a peer cell."""
    peers = _table(PEERS)
    return F.filter(
        _cells(),
        lambda i: (board[i] != 0) & F.exists(peers[i], lambda p: board[p] == board[i]),
    )


def board_conflicts(boards: DataFrame) -> DataFrame:
    """One row per conflicting cell."""
    hits = boards.select("puzzle_id", "board", F.explode(conflict_cells(F.col("board"))).alias("idx"))
    return hits.select(
        "puzzle_id",
        "idx",
        F.floor(F.col("idx") / 9).cast("int").alias("row"),
        (F.col("idx") % 9).cast("int").alias("col"),
        F.col("board")[F.col("idx")].cast("int").alias("value"),
    )


def _any_bits(cells: Column, bits: Column) -> Column:
    return F.aggregate(cells, F.lit(0), lambda a, i: a.bitwiseOR(bits[i]))


def _digit_bit(digit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), (digit - 1).cast("int"))


def candidate_masks(board: Column) -> Column:
    """Allowed digits of every cell as a bit mask (bit d-1 for digit d); 0 for filled cells."""
    bits = F.transform(board, lambda v: F.when(v == 0, F.lit(0)).otherwise(_digit_bit(v)))

    def of_board(s: Column) -> Column:
        used = F.transform(_table(HOUSES), lambda house: _any_bits(house, s["bits"]))
        return let(F.struct(s["board"].alias("board"), used.alias("used")), of_houses)

    def of_houses(s: Column) -> Column:
        return F.transform(
            _table(HOUSES_OF),
            lambda hs, i: F.when(s["board"][i] != 0, F.lit(0)).otherwise(
                F.lit(511).bitwiseAND(F.bitwise_not(_any_bits(hs, s["used"])))
            ),
        )

    return let(F.struct(board.alias("board"), bits.alias("bits")), of_board)


def candidates(boards: DataFrame) -> DataFrame:
    """Allowed digits of each empty cell, one row per (cell, digit)."""
    masks = candidate_masks(F.col("board"))
    per_cell = boards.select("puzzle_id", F.posexplode(masks).alias("idx", "mask"))
    digits = F.filter(F.sequence(F.lit(1), F.lit(9)), lambda d: _has(F.col("mask"), d))
    return per_cell.where("mask <> 0").select("puzzle_id", "idx", F.explode(digits).alias("digit"))


def _has(mask: Column, digit: Column) -> Column:
    return mask.bitwiseAND(_digit_bit(digit)) != 0


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x.cast("int"))


def _size(mask: Column) -> Column:
    return F.bit_count(mask).cast("int")


def _analysis(board: Column) -> Column:
    """What the rules share, as one struct:

    `masks` candidates per cell; `once` per house the digits with a single place in it;
    `only` per crossing the digits whose places in the box all lie on the line.
    """

    def once_in(house: Column, masks: Column) -> Column:
        start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("again"))
        return F.aggregate(
            house,
            start,
            lambda s, i: F.struct(
                s["seen"].bitwiseOR(masks[i]).alias("seen"),
                s["again"].bitwiseOR(s["seen"].bitwiseAND(masks[i])).alias("again"),
            ),
            lambda s: s["seen"].bitwiseAND(F.bitwise_not(s["again"])),
        )

    def of_masks(masks: Column) -> Column:
        box_rest = _table([rest for _, rest, _ in CROSSINGS])
        return F.struct(
            masks.alias("masks"),
            F.transform(_table(HOUSES), lambda house: once_in(house, masks)).alias("once"),
            F.transform(
                _table([both for both, _, _ in CROSSINGS]),
                lambda both, n: _any_bits(both, masks).bitwiseAND(
                    F.bitwise_not(_any_bits(box_rest[n], masks))
                ),
            ).alias("only"),
        )

    return let(candidate_masks(board), of_masks)


def _in_once(a: Column, i: Column) -> Column:
    """Cell holds a digit that has no other place in its row, column or box."""
    return a["masks"][i].bitwiseAND(_any_bits(_table(HOUSES_OF)[i], a["once"])) != 0


def _twins(masks: Column, house: Column, i: Column) -> Column:
    """Cell has two candidates, and exactly one other cell of the house has the same two."""
    return (_size(masks[i]) == 2) & (F.size(F.filter(house, lambda j: masks[j] == masks[i])) == 2)


def _filled_peers(board: Column, i: Column) -> Column:
    return F.size(F.filter(_table(PEERS)[i], lambda p: board[p] != 0))


def _puzzle(boards: DataFrame) -> Column:
    """The original board; it is the board itself where there is no such column."""
    return F.col("puzzle") if "puzzle" in boards.columns else F.col("board")


def puzzle_features(boards: DataFrame) -> DataFrame:
    """Ten difficulty features of each board."""
    mean_zero = F.lit(0.0)

    def of_board(x: Column) -> Column:
        board, puzzle, a = x["board"], x["puzzle"], x["a"]
        masks, only = a["masks"], a["only"]
        line_rest = _table([rest for _, _, rest in CROSSINGS])
        clues = F.size(F.filter(puzzle, lambda v: v != 0))
        empty = F.size(F.filter(board, lambda v: v == 0))
        mirrored = F.size(
            F.filter(_cells(), lambda i: (puzzle[i] != 0) & (puzzle[F.lit(80) - i] != 0))
        )
        simple = F.size(F.filter(_cells(), lambda i: (_size(masks[i]) == 1) | _in_once(a, i)))
        twins = F.transform(
            _table(HOUSES), lambda house: F.size(F.filter(house, lambda i: _twins(masks, house, i)))
        )
        lined = F.transform(
            only,
            lambda digits, n: F.when(digits == 0, F.lit(0)).otherwise(
                F.aggregate(
                    line_rest[n], F.lit(0), lambda t, i: t + _size(masks[i].bitwiseAND(digits))
                )
            ),
        )
        filled = F.aggregate(
            _cells(), F.lit(0), lambda t, i: t + F.when(board[i] == 0, _filled_peers(board, i)).otherwise(F.lit(0))
        )
        no_zero = F.nullif(empty, F.lit(0))
        values = {
            "clue_count": clues,
            "naked_singles": F.size(F.filter(masks, lambda m: _size(m) == 1)),
            "hidden_singles": F.size(F.filter(_cells(), lambda i: _in_once(a, i))),
            "naked_pairs": _sum(twins) / 2,
            "pointing_pairs": _sum(F.transform(only, _size)),
            "box_line_reduction": _sum(lined),
            "backtrack_depth": F.floor(F.greatest(F.lit(0), empty - simple) / 5),
            "constraint_density": F.round(F.coalesce(filled / F.lit(20.0) / no_zero, mean_zero), 4),
            "symmetry_score": F.round(F.coalesce(mirrored / F.nullif(clues, F.lit(0)), mean_zero), 4),
            "avg_candidate_count": F.round(
                F.coalesce(_sum(F.transform(masks, _size)) / no_zero, mean_zero), 4
            ),
        }
        return F.struct(*[values[name].cast("double").alias(name) for name in FEATURES])

    shared = F.struct(
        F.col("board").alias("board"), _puzzle(boards).alias("puzzle"), _analysis(F.col("board")).alias("a")
    )
    return boards.select("puzzle_id", let(shared, of_board).alias("f")).select("puzzle_id", "f.*")


def grid_complete(board: Column) -> Column:
    return F.forall(board, lambda v: v != 0)


def grid_correct(board: Column, solution: Column) -> Column:
    return board == solution


def cell_importance(boards: DataFrame, weights: dict[str, float], top: int = 9) -> DataFrame:
    """Feature weights spread over the cells, scaled to 0..1; the `top` positive cells.

    A weight counts by its size. Naked pairs are those of rows only, as the rule has it.
    """
    w = {name: abs(weights.get(name, 0.0)) for name in FEATURES}

    def of_board(x: Column) -> Column:
        board, masks = x["board"], x["a"]["masks"]
        sizes = F.filter(F.transform(masks, _size), lambda n: n > 0)
        fills = F.transform(
            _cells(), lambda i: F.when(board[i] == 0, _filled_peers(board, i)).otherwise(F.lit(0))
        )
        bound = F.struct(
            board.alias("board"),
            x["puzzle"].alias("puzzle"),
            x["a"].alias("a"),
            F.array_min(sizes).alias("fewest"),
            F.size(F.filter(x["puzzle"], lambda v: v != 0)).alias("given"),
            fills.alias("fills"),
        )
        return let(bound, lambda y: F.transform(_cells(), lambda i: score(y, i)))

    def score(y: Column, i: Column) -> Column:
        a, masks = y["a"], y["a"]["masks"]
        n = _size(masks[i])
        rows = _table(ROWS)
        row = rows[F.floor(i / 9).cast("int")]
        crossing = masks[i].bitwiseAND(_any_bits(_table(CROSSINGS_OF)[i], a["only"])) != 0
        densest = F.greatest(F.array_max(y["fills"]), F.lit(1))

        def when(condition: Column, weight) -> Column:
            return F.when(condition, weight).otherwise(F.lit(0.0))

        is_empty = y["board"][i] == 0
        return (
            when(n == 1, F.lit(w["naked_singles"]))
            + when(_in_once(a, i), F.lit(w["hidden_singles"]))
            + when(_twins(masks, row, i), F.lit(w["naked_pairs"]))
            + when(crossing, F.lit(w["pointing_pairs"] + w["box_line_reduction"]))
            + when(is_empty & (n <= y["fewest"] + 1), F.lit(w["backtrack_depth"]))
            + when(n > 0, F.lit(w["avg_candidate_count"]) / F.greatest(n, F.lit(1)))
            + when(is_empty, F.lit(w["constraint_density"]) * (y["fills"][i] / densest))
            + when(y["puzzle"][i] != 0, F.lit(w["clue_count"]) / F.greatest(y["given"], F.lit(1)))
            + F.lit(w["symmetry_score"] / 81.0)
        )

    def best(scores: Column) -> Column:
        span = F.struct(scores.alias("s"), F.array_min(scores).alias("lo"), F.array_max(scores).alias("hi"))

        def scaled(x: Column) -> Column:
            spread = F.nullif(x["hi"] - x["lo"], F.lit(0.0))
            return F.transform(
                x["s"],
                lambda v, i: F.struct(
                    (-F.round(F.coalesce((v - x["lo"]) / spread, F.lit(0.0)), 4)).alias("neg"), i.alias("idx")
                ),
            )

        return F.slice(F.array_sort(let(span, scaled)), 1, top)

    shared = F.struct(
        F.col("board").alias("board"), _puzzle(boards).alias("puzzle"), _analysis(F.col("board")).alias("a")
    )
    ranked = let(let(shared, of_board), best)
    return (
        boards.select("puzzle_id", F.posexplode(ranked).alias("pos", "cell"))
        .select(
            "puzzle_id",
            (F.col("pos") + 1).alias("rank"),
            F.col("cell.idx").alias("idx"),
            (-F.col("cell.neg")).alias("importance"),
        )
        .where("importance > 0")
    )

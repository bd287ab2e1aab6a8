"""Board rules against a plain reading of them, on small fixtures."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from playmetry.operators import boards as bd
from playmetry.plans import QUERIES, binding

SOLVED = [(3 * (i // 9 % 3) + i // 27 + i % 9) % 9 + 1 for i in range(81)]


def puzzle(seed, blanks):
    rng = random.Random(seed)
    cells = list(SOLVED)
    for i in rng.sample(range(81), blanks):
        cells[i] = 0
    return cells


BOARDS = {1: puzzle(1, 30), 2: puzzle(2, 45), 3: puzzle(3, 58), 4: list(SOLVED), 5: [0] * 81}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(BOARDS.items()), "puzzle_id int, board array<int>").withColumn("puzzle", F.col("board"))


def options(cells):
    return [
        set() if cells[i] else set(range(1, 10)) - {cells[p] for p in bd.PEERS[i]} for i in range(81)
    ]


def expected_features(cells):
    cand = options(cells)
    empty = [i for i in range(81) if not cells[i]]
    single = {i for i in empty if len(cand[i]) == 1}
    hidden = set()
    for house in bd.HOUSES:
        for digit in range(1, 10):
            places = [i for i in house if digit in cand[i]]
            if len(places) == 1:
                hidden.add(places[0])
    pairs = 0
    for house in bd.HOUSES:
        sets = [frozenset(cand[i]) for i in house if len(cand[i]) == 2]
        pairs += sum(sets.count(s) == 2 for s in set(sets))
    pointing = lined = 0
    for box in bd.BOXES:
        for digit in range(1, 10):
            places = [i for i in box if digit in cand[i]]
            for lines in (bd.ROWS, bd.COLUMNS):
                if places and len({n for n, line in enumerate(lines) for p in places if p in line}) == 1:
                    line = next(x for x in lines if places[0] in x)
                    pointing += 1
                    lined += sum(i not in box and digit in cand[i] for i in line)
    clues = 81 - len(empty)
    return {
        "clue_count": clues,
        "naked_singles": len(single),
        "hidden_singles": len(hidden),
        "naked_pairs": pairs,
        "pointing_pairs": pointing,
        "box_line_reduction": lined,
        "backtrack_depth": max(0, len(empty) - len(single | hidden)) // 5,
        "constraint_density": round(sum(sum(cells[p] > 0 for p in bd.PEERS[i]) / 20 for i in empty) / len(empty), 4) if empty else 0,
        "symmetry_score": round(sum(bool(cells[i] and cells[80 - i]) for i in range(81)) / clues, 4) if clues else 0,
        "avg_candidate_count": round(sum(len(cand[i]) for i in empty) / len(empty), 4) if empty else 0,
    }


def test_features(frame):
    got = {r["puzzle_id"]: r.asDict() for r in bd.puzzle_features(frame).collect()}
    for key, cells in BOARDS.items():
        for name, value in expected_features(cells).items():
            assert got[key][name] == pytest.approx(value, abs=1e-4), (key, name)


def test_candidates(frame):
    got = {(r["puzzle_id"], r["idx"], r["digit"]) for r in bd.candidates(frame).collect()}
    assert got == {(k, i, d) for k, cells in BOARDS.items() for i, c in enumerate(options(cells)) for d in c}


@pytest.mark.parametrize(
    ("other", "name"), [(5, "row"), (36, "column"), (10, "box")]
)
def test_conflicts(spark, other, name):
    cells = [0] * 81
    cells[0] = cells[other] = 5
    cells[80] = 5
    frame = spark.createDataFrame([(1, cells)], "puzzle_id int, board array<int>")
    assert {r["idx"] for r in bd.board_conflicts(frame).collect()} == {0, other}


def test_no_conflicts(spark):
    frame = spark.createDataFrame([(1, SOLVED), (2, [0] * 81)], "puzzle_id int, board array<int>")
    assert bd.board_conflicts(frame).count() == 0
    row = frame.select(bd.grid_complete(F.col("board")).alias("c"), bd.grid_correct(F.col("board"), F.array(*[F.lit(v) for v in SOLVED])).alias("ok")).collect()
    assert [tuple(r) for r in row] == [(True, True), (False, False)]


def expected_importance(cells, weights):
    w = {n: abs(weights.get(n, 0.0)) for n in bd.FEATURES}
    cand = options(cells)
    empty = [i for i in range(81) if not cells[i]]
    scores = [w["symmetry_score"] / 81] * 81
    hidden, pairs, cross = set(), set(), set()
    for house in bd.HOUSES:
        for digit in range(1, 10):
            places = [i for i in house if digit in cand[i]]
            if len(places) == 1:
                hidden.add(places[0])
    for house in bd.ROWS:
        for s in {frozenset(cand[i]) for i in house if len(cand[i]) == 2}:
            same = [i for i in house if cand[i] == s]
            if len(same) == 2:
                pairs.update(same)
    for box in bd.BOXES:
        for digit in range(1, 10):
            places = [i for i in box if digit in cand[i]]
            if places and (len({p // 9 for p in places}) == 1 or len({p % 9 for p in places}) == 1):
                cross.update(places)
    fewest = min((len(cand[i]) for i in empty if cand[i]), default=99)
    fill = {i: sum(cells[p] > 0 for p in bd.PEERS[i]) / 20 for i in empty}
    densest = max(fill.values(), default=0) or 1.0
    given = [i for i in range(81) if cells[i]]
    for i in range(81):
        if i in fill:
            n = len(cand[i])
            scores[i] += w["naked_singles"] * (n == 1) + w["backtrack_depth"] * (n <= fewest + 1)
            scores[i] += w["avg_candidate_count"] / n if n else 0
            scores[i] += w["constraint_density"] * fill[i] / densest
        else:
            scores[i] += w["clue_count"] / max(len(given), 1)
        scores[i] += w["hidden_singles"] * (i in hidden) + w["naked_pairs"] * (i in pairs)
        scores[i] += (w["pointing_pairs"] + w["box_line_reduction"]) * (i in cross)
    lo, hi = min(scores), max(scores)
    scaled = [round((s - lo) / (hi - lo), 4) if hi > lo else 0.0 for s in scores]
    best = sorted(range(81), key=lambda i: (-scaled[i], i))[:9]
    return [(i, scaled[i]) for i in best if scaled[i] > 0]


@pytest.mark.parametrize("weights", [{n: 0.07 * (i + 1) for i, n in enumerate(bd.FEATURES)}, {"hidden_singles": -1.0}, {}])
def test_importance(frame, weights):
    got = bd.cell_importance(frame, weights).collect()
    for key, cells in BOARDS.items():
        mine = sorted((r["rank"], r["idx"], r["importance"]) for r in got if r["puzzle_id"] == key)
        want = expected_importance(cells, weights)
        assert [m[2] for m in mine] == pytest.approx([s for _, s in want], abs=2e-4)
        assert len(mine) == len(want)


def test_boards_are_made_once(spark, tmp_path):
    rows = [(k, f"name {k}") for k in range(200)] + [(200, None), (None, "x"), (7, "name 7")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        made = binding.boards(spark, str(tmp_path))
        assert made.rdd.getNumPartitions() == 9
        cells, flat = (QUERIES[name](spark, str(tmp_path)) for name in ("explode_cells", "flatten_grid"))
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (cells, flat)]
        assert "Filter" not in plans[0].split("Repartition")[1]
        assert "slice(transform" not in plans[1] and "slice(lambda" in plans[1]
        got = {}
        for r in cells.where("puzzle_id IS NOT NULL").distinct().collect():
            got[r["puzzle_id"], r["idx"]] = r["value"]
        texts = {r["puzzle_id"]: r["cells"] for r in flat.where("puzzle_id IS NOT NULL").collect()}
        assert cells.count() == 81 * len(rows) and flat.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k, name in rows:
        if k is None:
            continue
        right = [(3 * (i // 9 % 3) + i // 27 + i % 9 + k) % 9 + 1 for i in range(81)]
        digits = [int(c, 16) for c in hashlib.md5(f"{k}-{name}".encode()).hexdigest()]
        want = [
            v if k % 32 == 0 or name is None
            else v % 9 + 1 if k % 4 == 0 and digits[i * 5 % 32] == 15
            else 0 if k % 16 and (digits[i % 32] + i // 32 * 5) % 16 < 7
            else v
            for i, v in enumerate(right)
        ]
        assert [got[k, i] for i in range(81)] == want and texts[k] == "".join(map(str, want))


def test_no_board_no_cells(spark):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [5, None])], "puzzle_id long, board array<int>")
    got = sorted((r["puzzle_id"], r["idx"], r["value"]) for r in bd.explode_cells(frame).collect())
    assert [g[:2] for g in got] == [(3, 0), (3, 1)]


def test_explode_cells(spark):
    frame = spark.createDataFrame([(1, SOLVED)], "puzzle_id int, board array<int>")
    got = {r["idx"]: tuple(r)[2:] for r in bd.explode_cells(frame).collect()}
    assert got[0] == (0, 0, 0, SOLVED[0]) and got[40] == (4, 4, 4, SOLVED[40]) and got[80] == (8, 8, 8, SOLVED[80])

import numpy as np
import pytest

from playmetry.llm.ann import nearest
from playmetry.llm.queries import QUERIES


def test_recall_against_brute_force(llm, sf):
    rows = llm.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    units = x / np.linalg.norm(x, axis=1)[:, None]
    got = QUERIES["op1_nearest_neighbours"](llm, sf).toPandas()
    met = wanted = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = units @ units[q]
        score[q] = -9
        best = ids[np.lexsort((ids, -score))[:5]]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        order = {int(i): n for n, i in enumerate(ids)}
        assert np.allclose(mine.score, [score[order[int(i)]] for i in mine.vec_id], atol=1e-12)
        met += len(set(best) & set(mine.vec_id))
        wanted += 5
    assert met / wanted >= 0.9


def test_unusable_ties_and_small(llm):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 1.0]), (8, [1.0]), (9, [-1.0, 0.5]), (None, [1.0, 1.0]), (9, [-1.0, 0.5])]
    vectors = llm.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest(vectors, vectors.where("vec_id in (0, 3)"), k=5).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 9)]
    assert got[0][3] == got[1][3] == 1.0
    assert nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    assert nearest(vectors, vectors.limit(0)).count() == 0


def test_hot_vector_over_blocks(llm):
    rng = np.random.default_rng(0)
    rows = [(i, ([1.0] * 8 if i % 3 == 0 else rng.normal(size=8).tolist())) for i in range(600)]
    vectors = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(vectors, vectors.where("vec_id in (0, 300)"), k=4, block=64, ask=1).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [3, 6, 9, 12, 0, 3, 6, 9]


def test_sizes_and_lengths_of_any_kind(llm):
    rows = [(0, [1e200, 2e200]), (1, [1e-200, 2e-200]), (2, [1.0, 2.0]), (3, [-1e300, 1e-300]), (4, [1.0, 0.0, 0.0]), (5, [1e-310, 1e-310, 0.0]), (6, [3.0])]
    vectors = llm.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, query_id string, id int")
    got = nearest(vectors, vectors.where("vec_id in (0, 3, 4, 6)")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 3), (3, 0), (3, 1), (3, 2), (4, 5)]
    want = [1, 1, -1 / 5**0.5, -1 / 5**0.5, -1 / 5**0.5, -1 / 5**0.5, 0.5**0.5]
    assert np.allclose([r.score for r in got], want, rtol=1e-12)
    many = llm.createDataFrame([(n, [1.0] * n) for n in range(1, 19)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        nearest(many, many)

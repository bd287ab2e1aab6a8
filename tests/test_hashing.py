"""Large x large recommendations by hashing, against the exact grid."""

import numpy as np
import pyarrow as pa

from playmetry.operators import vectors

N, DIM = 20_000, 32


def table(spark, matrix, name="id"):
    return spark.createDataFrame(pa.table({name: np.arange(len(matrix)), "embedding": pa.array(list(matrix), pa.list_(pa.float64()))}))


def near(users, items, k, skip=()):
    units = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (users, items)]
    out = {}
    for u in range(len(users)):
        s = np.round(units[0][u] @ units[1].T, 9)
        s[[i for a, i in skip if a == u]] = -2
        out[u] = set(np.lexsort((np.arange(len(items)), -s))[:k].tolist())
    return out


def test_recall_and_share_of_pairs(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(500, DIM))
    items = centres[rng.integers(0, 500, N)] + 0.4 * rng.normal(size=(N, DIM))
    users = centres[rng.integers(0, 500, N)] + 0.4 * rng.normal(size=(N, DIM))
    u, i = table(spark, users), table(spark, items)
    asked = rng.choice(N, 400, replace=False)
    seen = spark.createDataFrame([(int(a), int(x)) for a in asked[:50] for x in rng.choice(N, 3)], "user_id long, item_id long")
    got = vectors.items_for_users_hashed(u, i, seen, 10).toPandas()
    counts = got.groupby("user_id").size()
    assert counts.max() == 10 and len(counts) > 0.99 * N
    skip = {(r.user_id, r.item_id) for r in seen.collect()}
    assert not skip & set(zip(got.user_id, got.item_id))
    want = near(users[asked], items, 10, {(n, x) for n, a in enumerate(asked) for b, x in skip if a == b})
    mine = got.groupby("user_id").item_id.agg(set)
    recall = np.mean([len(mine.get(a, set()) & want[n]) / 10 for n, a in enumerate(asked)])
    share = vectors.pairs_looked_at(u, i).first()
    print("recall", recall, "share", share.looked_at / share.all_pairs)
    assert recall >= 0.9 and share.looked_at < 0.1 * share.all_pairs


def test_small_and_hot(spark):
    """One bucket that holds everything is dealt into cells and equals the exact way."""
    rng = np.random.default_rng(1)
    same = np.tile(rng.normal(size=8), (300, 1)) * rng.uniform(1, 2, (300, 1))
    u, i = table(spark, same[:100]), table(spark, same)
    seen = spark.createDataFrame([(3, x) for x in range(40)] + [(4, 1)], "user_id long, item_id long")
    got = vectors.items_for_users_hashed(u, i, seen, 5, cell_rows=16)
    exact = vectors.items_for_users(u, i, seen, 5)
    assert sorted(map(tuple, got.select(*exact.columns).collect())) == sorted(map(tuple, exact.collect()))
    assert vectors.items_for_users_hashed(u.limit(0), i, seen, 5).count() == 0
    assert vectors.items_for_users_hashed(u, i.limit(0), seen, 5).count() == 0

import math

from playmetry.llm.mixing import mix


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    free, stopped = set(names), {}
    while free:
        rest = 1.5 * sum(sizes.values()) - sum(stopped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return share | stopped
        stopped |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return stopped


def test_against_resharing(llm):
    rows, n = [], 0
    for source, many in (("a", 400), ("b", 30), (None, 50), ("", 120), ("é", 60)):
        for i in range(many):
            rows.append((n, "w " * (1 + (i * 7919) % (900 if i % 10 == 0 else 40)), source))
            n += 1
    rows += [(n, None, "a"), (n + 1, "", "empty"), (None, "one two", "a"), (n + 2, "same same", "b"), (n + 2, "same same", "b")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).toPandas()
    again = mix(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    got["source"] = ["a" if math.isnan(i) else source[int(i)] for i in got.doc_id]
    assert (got.taken <= 2 * got["size"]).all() and set(got.copies) <= {0, 1, 2}
    for s in sizes:
        mine = got[got.source.isna()] if s is None else got[got.source == s]
        assert set(mine.source_size) == {sizes[s]}
        assert math.isclose(mine.target.iloc[0], want[s], abs_tol=1e-6)
        assert abs(mine.taken.sum() - want[s]) <= max(12, 0.01 * want[s]), s


def test_tilt_follows_length(llm):
    docs = llm.createDataFrame([(i, "w " * (10 if i % 2 else 200), "a" if i < 300 else "b") for i in range(600)], "doc_id long, text string, source string")
    got = mix(docs, weights=(1, 2), share=1.0).toPandas()
    up, down = got[got.doc_id >= 300], got[got.doc_id < 300]
    rate = lambda f, n: f[f["size"] == n].copies.mean()
    assert rate(up, 200) > rate(up, 10) >= 1.0
    assert rate(down, 200) < rate(down, 10) <= 1.0


def test_empty(llm):
    assert mix(llm.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    none = llm.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.taken, r.target) for r in mix(none).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]

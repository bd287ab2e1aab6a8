import hashlib
import math

import numpy as np
import pytest

from playmetry.llm.codes import Codebook, codebooks_sha256, compress, decode, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, id string, entries int, error string"


def plain(rows, parts=4, entries=256, rounds=4):
    """The same codes by plain loops."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted((i, v) for i, v, _ in kept if i is not None)
    first = [v for k, (i, v) in enumerate(first) if k == 0 or first[k - 1][0] != i][:entries]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for c in cut:
                held[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(h) for col in zip(*h)] if h else y for h, y in zip(held, books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    label = {}
    for (_, _, lab), e in zip(kept, errors):
        label[lab] = label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), err, label[lab], sha) for (i, _, lab), f, err in zip(kept, found, errors)]


def frame(llm, rows):
    return llm.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA)


def told(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_against_plain_loops(llm):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)], int(i) % 3 if i % 4 else None) for i in rng.permutation(400)]
    rows += [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [1.0] * 7 + [float("nan")], 1), (903, [float("-inf")] * 8, 1)]
    rows += [(904, [-0.5] * 8, None), (904, [-0.5] * 8, None), (None, [0.25] * 8, 2), (905, [0.0] * 8, 2), (3, [0.125] * 8, 1)]
    assert told(vector_codes(frame(llm, rows))) == sorted(plain(rows), key=str)


def test_few_and_no_rows(llm):
    few = [(i, [float(i), 1.0, -1.0, 0.5], 1) for i in range(3)] * 2
    assert told(vector_codes(frame(llm, few))) == sorted(plain(few), key=str)
    assert vector_codes(frame(llm, [(1, None, 1)])).count() == 0
    assert vector_codes(frame(llm, few).limit(0)).count() == 0


def test_refusals(llm):
    for rows in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(ValueError):
            compress(frame(llm, rows))


def test_search_is_exact_and_leaves_entries_out():
    rng = np.random.default_rng(1)
    entries = rng.integers(-50, 50, (64, 4)) + rng.integers(-400, 400, (64, 1))
    entries[40] = entries[3]  # a tie goes to the lower index
    parts = np.concatenate([entries, rng.integers(-400, 400, (500, 4))])
    found = Codebook(entries).nearest(parts)
    apart = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (found.entry == apart.argmin(axis=1)).all() and (found.distance == apart.min(axis=1)).all()
    assert found.looked_at < 0.6 * apart.size


def test_decode(llm):
    rows = [(i, [float(i), 2.0 * i, 0.0, 1.0], 1) for i in range(5)]
    codes, books = compress(frame(llm, rows))
    for r in codes.collect():
        want = [math.floor(1024 * x) for x in rows[r.id][1]]
        assert decode(r.entries, books).tolist() == want and r.error == 0
    assert len(codebooks_sha256(books)) == 64

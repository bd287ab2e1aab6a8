import random

from playmetry.llm.nearcopies import circulant_signature, components, near_copies, shingle_set


def brute(docs, percent):
    sets = {i: set(shingle_set(t).tolist()) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_group_of_near_copies(llm, documents):
    """A large group whose members are spread around the threshold, so links come and go."""
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") + rng.choice("klmnopqr") + rng.choice("stuvw") for _ in range(150)]
    texts = []
    for _ in range(220):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 8])):
            words[rng.randrange(150)] = f"edit{rng.random()}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts += [None, "", " ", texts[0].upper(), texts[0]]
    for percent in (80, 85):
        want = brute(list(enumerate(texts)), percent)
        got = {r.doc_id: r for r in near_copies(documents(*texts), percent=percent).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_keys(documents):
    frame = documents("a b c d e f", "a b c d e f", "a b c d e f", None, ids=[4, 4, None, 8])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_copies(frame).collect()), key=lambda r: (r[0] is None, r))
    assert got == [(4, 4, True), (4, 4, True), (8, 8, True), (None, None, True)]
    assert near_copies(frame.limit(0)).count() == 0


def test_long_chain(llm):
    edges = llm.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_signature_estimates_similarity():
    rng = random.Random(2)
    words = [f"w{rng.random()}" for _ in range(400)]
    a, b = shingle_set(" ".join(words)), shingle_set(" ".join(words[:200] + ["new"] + words[200:]))
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    same = (circulant_signature(a, 512) == circulant_signature(b, 512)).mean()
    assert abs(same - true) < 0.05

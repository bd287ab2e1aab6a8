import hashlib
import random

from playmetry.llm.substrings import maximal_repeats, remove_repeats


def brute(docs, length):
    words = {i: (t or "").encode().split() for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        left = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(left).hexdigest(), sorted(gone))
    return out


def fixture():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    text = lambda n: " ".join(word() for _ in range(n))
    passage, whole = text(24), text(60)
    docs = []
    for i in range(120):
        kind = i % 6
        if kind == 0:
            docs.append(whole)
        elif kind == 1:
            docs.append(f"{text(rng.randint(0, 30))} {passage}\n{text(rng.randint(0, 30))}")
        elif kind == 2:
            w = whole.split()
            w[rng.randrange(60)] = "changed"
            docs.append("  ".join(w))
        elif kind == 3:
            docs.append(passage + " " + passage)
        elif kind == 4:
            docs.append(("x " * 50).strip())
        else:
            docs.append(text(rng.randint(0, 40)))
    docs += [None, "", " \n ", passage[:-1], "word " * 5000 + passage]
    return list(enumerate(docs))


def test_against_brute_force(llm, documents):
    docs = fixture()
    want = brute(docs, 20)
    frame = documents(*[t for _, t in docs])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(frame, length=20, anchor=6).collect()}
    assert got == {i: w[:3] for i, w in want.items()}
    spans = {}
    for r in maximal_repeats(frame, length=20, anchor=6).collect():
        for k in range(r.first_word, r.last_word + 1):
            assert k not in spans.setdefault(r.doc_id, set())
            spans[r.doc_id].add(k)
    assert {i: sorted(s) for i, s in spans.items()} == {i: w[3] for i, w in want.items() if w[3]}


def test_keys(llm, documents):
    text = " ".join(f"w{i}" for i in range(30))
    frame = documents(text, text, text, "other", text, ids=[5, 5, None, 5, 9])
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in remove_repeats(frame, length=20, anchor=6).collect())
    assert got == [("5", 1, 0), ("5", 30, 0), ("5", 30, 0), ("9", 30, 30), ("None", 30, 0)]
    assert remove_repeats(frame.limit(0), length=20).count() == 0

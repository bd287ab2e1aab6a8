import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from playmetry.llm import pieces as p
from playmetry.llm.common import mix64

VOCABULARY = p.load_vocabulary()
LATTICES = p.Lattices(VOCABULARY)


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_lossless(text, key):
    (ids,) = p.encode_batch(LATTICES, [key], [text], 1)
    assert p.decode_ids(VOCABULARY.texts, ids.tolist()) == text


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "\n\n\t x", "▁ ▁▁", "日本 😀 \x00", "x" * 70_000, "é" * 3])
def test_edges(text):
    (ids,) = p.encode_batch(LATTICES, [1], [text], 1)
    assert p.decode_ids(VOCABULARY.texts, ids.tolist()) == text
    assert bool(len(ids)) == bool(text)


def segmentations(word):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in VOCABULARY.pieces:
            for rest in segmentations(word[k:]):
                yield (VOCABULARY.pieces[word[:k]], *rest)


@pytest.mark.parametrize("word", [" there", "onanen", " a"])
def test_drawn_by_weight(word):
    every = list(segmentations(word))
    weight = np.array([math.exp(sum(VOCABULARY.weights[i] for i in s)) for s in every])
    n = 40_000
    out, counts = LATTICES.sample(LATTICES.numbers([word] * n), mix64(np.arange(n, dtype=np.uint64)))
    drawn = Counter(tuple(x.tolist()) for x in np.split(out, np.cumsum(counts)[:-1]))
    assert set(drawn) <= set(every)
    for s, share in zip(every, weight / weight.sum()):
        assert abs(drawn[s] / n - share) < 5 * math.sqrt(share / n) + 1e-4


def test_both_samplers_agree():
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdeinorst 日é▁"))
    words = [" " + "".join(rng.choice(letters, rng.integers(1, 40))).replace(" ", "") for _ in range(400)]
    seeds = mix64(np.arange(len(words), dtype=np.uint64))
    lattices = p.Lattices(VOCABULARY)
    out, counts = lattices.sample(lattices.numbers(words), seeds)
    for word, seed, ids in zip(words, seeds, np.split(out, np.cumsum(counts)[:-1])):
        assert lattices.sample_long(word, seed).tolist() == ids.tolist()


def test_chances_are_the_same_in_any_company():
    rng = np.random.default_rng(6)
    words = sorted({" " + "".join(rng.choice(list("abcdeinorst"), rng.integers(1, 14))) for _ in range(3000)})
    one, other = p.Lattices(VOCABULARY), p.Lattices(VOCABULARY)
    for lattices, some in ((one, [words]), (other, [words[::-1][k : k + 7] for k in range(0, len(words), 7)])):
        for part in some:
            lattices.numbers(part)
    for word in words:
        a, b = ((x, int(x.numbers([word])[0])) for x in (one, other))
        spans = [slice(x.first[x.base[n]], x.first[x.base[n] + x.length[n]] + 1) for x, n in (a, b)]
        assert (one.chance[spans[0]] == other.chance[spans[1]]).all() and (one.piece[spans[0]] == other.piece[spans[1]]).all()


def test_names_that_clash(llm):
    docs = llm.createDataFrame([(1, "the anea", "x", "y", "z", "w")], "doc_id long, text string, key string, ids string, __text string, KEY_ string")
    coded = p.encode(docs, VOCABULARY)
    row = p.decode(coded, VOCABULARY).first()
    assert row.decoded == row.text and row.key == "x" and row.ids == "y" and row["__text"] == "z"


def test_frames(llm, documents):
    docs = documents("the anea thing", None, "", "the anea thing", "z ▁", ids=[1, 2, 3, 1, None])
    coded = p.encode(docs, VOCABULARY)
    assert coded.columns == [*docs.columns, "pieces"]
    rows = p.decode(coded, VOCABULARY).collect()
    assert all(r.decoded == r.text for r in rows)
    again = {str(r.pieces) for r in p.encode(docs.repartition(3), VOCABULARY).where("doc_id = 1").collect()}
    assert again == {str(r.pieces) for r in rows if r.doc_id == 1} and len(again) == 1
    trip = p.round_trip(docs, VOCABULARY).collect()
    assert all(r.lossless for r in trip) and sorted(r.n_pieces for r in trip)[:2] == [0, 0]
    assert p.encode(docs.limit(0), VOCABULARY).count() == 0


def test_round_trip_returns_the_pieces(llm, documents):
    docs = documents("the anea thing", None, "", "日本 😀 z ▁", ids=[1, 2, 3, None])
    coded = {r.doc_id: r.pieces for r in p.encode(docs, VOCABULARY).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in p.round_trip(docs, VOCABULARY).collect():
        assert r.pieces == coded[r.doc_id] and r.lossless and r.n_pieces == len(r.pieces or [])
        assert r.n_byte_pieces == sum(i in VOCABULARY.byte_ids for i in r.pieces or [])
        assert (r.pieces is None) == (r.pieces_hash is None) == (texts[r.doc_id] is None)
        assert r.pieces is None or p.decode_ids(VOCABULARY.texts, r.pieces) == texts[r.doc_id]


def test_long_words_are_one_lattice(monkeypatch):
    word = " there"
    every = list(segmentations(word))
    weight = np.array([math.exp(sum(VOCABULARY.weights[i] for i in s)) for s in every])
    monkeypatch.setattr(p, "RUN", 4)
    n = 2_000
    drawn = Counter(tuple(x.tolist()) for x in p.encode_batch(LATTICES, list(range(n)), [word[1:]] * n, 1))
    assert set(drawn) <= set(every)
    for s, share in zip(every, weight / weight.sum()):
        assert abs(drawn[s] / n - share) < 5 * math.sqrt(share / n) + 2e-3


def test_blocks_do_not_change_the_draws(monkeypatch):
    text = "thereonanen日本😀" * 40 + "a" + " " * 90 + "b\nc"
    runs = []
    for run in (1, 5, 64, 90):
        monkeypatch.setattr(p, "RUN", run)
        runs.append(p.encode_batch(LATTICES, ["k"], [text], 1)[0].tolist())
    assert all(r == runs[0] for r in runs) and p.decode_ids(VOCABULARY.texts, runs[0]) == text


def test_by_share_is_a_sort_by_three_keys():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 3000):
        to, share, piece = rng.integers(0, n // 4 + 1, n).astype(np.int32), np.round(rng.random(n), 1), rng.integers(-5, 5, n)
        got, want = p.by_share(to, share, piece), np.lexsort((piece, -share, to))
        assert sorted(got.tolist()) == list(range(n))
        for values in (to, share, piece):
            assert (values[got] == values[want]).all()


def new_words(n):
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdeinorst"))
    return " ".join("".join(w) for w in letters[rng.integers(0, len(letters), (n, 9))])


def test_memory_does_not_follow_the_new_words_of_a_batch(monkeypatch):
    monkeypatch.setattr(p, "KEPT_EDGES", 1 << 16)  # else lattices are kept, which is not what is measured
    lattices, text = p.Lattices(VOCABULARY), new_words(100_000)
    cut = range(0, len(text), len(text) // 50)
    texts = [text[a : a + len(text) // 50] for a in cut]
    tracemalloc.start()
    ids = p.encode_batch(lattices, list(cut), texts, 1)
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert [p.decode_ids(VOCABULARY.texts, i.tolist()) for i in ids] == texts
    assert peak < 120, f"{peak:.0f} MB for {len(text) / 2**20:.1f} MB of text"


def test_portions_do_not_change_the_draws(monkeypatch):
    texts = [new_words(300), None, "", "x" * 50 + "日本 ▁\n\n  b", new_words(20)]
    drawn = []
    for portion in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(p, "PORTION", portion)
        monkeypatch.setattr(p, "RUN", 40)
        drawn.append([i.tolist() for i in p.encode_batch(p.Lattices(VOCABULARY), list(range(5)), texts, 1)])
    assert all(d == drawn[0] for d in drawn)
    assert [p.decode_ids(VOCABULARY.texts, i) for i in drawn[0]] == [t or "" for t in texts]


def test_portions_hold_all_rows(monkeypatch):
    texts = ["ab", None, "", "abcdefghijkl", "é", "abc", None, "abcd", ""]
    made = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["id", "text"])
    for portion, most in ((1, 3), (4, 5), (100, 9)):
        monkeypatch.setattr(p, "PORTION", portion)
        cut = list(p.portions(iter([made, made.slice(0, 0), made.slice(2, 5)]), 1))
        assert [x for b in cut for x in b.column(1).to_pylist()] == texts + texts[2:7]
        assert max(b.num_rows for b in cut) <= most
        for b in cut:
            sizes = [len((t or "").encode()) for t in b.column(1).to_pylist()]
            assert sum(sizes) <= portion or sum(map(bool, sizes)) == 1

import hashlib
import random

import numpy as np
import pytest

from playmetry.llm import suffixes as m

SCHEMA = "doc_id long, text string, id int, seq string, run int"


def plain(docs, length):
    raw = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in raw:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if i is not None and (w not in first or i < first[w]):
                first[w] = i
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), [(a, z - 1) for a, z in zip(edges[::2].tolist(), edges[1::2].tolist())], hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def told(df):
    rows = df.collect()
    for r in rows:
        assert (r.kept is None) == (r.n_removed == 0)
        assert r.kept is None or hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, [(s.first, s.last) for s in r.spans], r.kept_sha256) for r in rows), key=str)


def fixture():
    rng = random.Random(5)
    text = lambda n, letters="abcdefgh é\n": "".join(rng.choices(letters, k=n))
    line, whole, hot = text(34), text(150), text(60)
    docs = []
    for i in range(160):
        kind = i % 8
        if kind == 0:
            docs.append(whole)
        elif kind == 1:
            docs.append(text(rng.randint(0, 60)) + line + text(rng.randint(0, 60)))
        elif kind == 2:
            w = list(whole)
            w[rng.randrange(len(w))] = "Z"
            docs.append("".join(w))
        elif kind == 3:
            docs.append(line + line[5:] + line)
        elif kind == 4:
            docs.append("ab" * rng.randint(5, 60))
        elif kind == 5:
            docs.append(text(3) + hot + text(200, "xy"))
        elif kind == 6:
            docs.append(hot[7:50] + whole[20:90])
        else:
            docs.append(text(rng.randint(0, 300), "ab"))
    docs += [None, "", "x", line[:-1], "word " * 3000 + line, "\x00" * 40 + line, line + "\x00" * 40]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    return rows + [(5, whole), (5, whole), (5, line + "5"), (None, whole), (None, line), (70, line + "q" + whole)]


@pytest.mark.parametrize("more", [{}, {"crowd": 0}, {"crowd": 12, "run_bytes": 2000, "ranges": 5}, {"run_bytes": 900, "ranges": 3}, {"gram": 8}])
def test_against_plain_loops(llm, more):
    docs = fixture()
    frame = llm.createDataFrame([(i, t, 1, "s", 2) for i, t in docs], SCHEMA)
    assert told(m.byte_repeats(frame, length=24, **({"gram": 12} | more))) == plain(docs, 24)


def test_empty(llm):
    frame = llm.createDataFrame([(1, None, 1, "s", 2)], SCHEMA)
    assert told(m.byte_repeats(frame)) == plain([(1, None)], 50)
    assert m.byte_repeats(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        m.byte_repeats(frame, length=10, gram=16)


def test_merge_reads_no_known_byte_again(monkeypatch):
    rng = random.Random(2)
    runs = [sorted("".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(rng.choice([0, 1, 50, 200]))) for _ in range(11)]
    read = []
    common = m.common_prefix
    coded = [m.front_coded(r) for r in runs]

    def watched(a, b, known):
        assert a[:known] == b[:known]
        out = common(a, b, known)
        read.append(out - known + 1)
        return out

    monkeypatch.setattr(m, "common_prefix", watched)
    got = list(m.merge([m.decoded(*c) for c in coded]))
    strings = [s for _, _, s in got]
    assert strings == sorted(s for r in runs for s in r)
    assert [n for n, _, _ in got[1:]] == [common(a, b, 0) for a, b in zip(strings, strings[1:])]
    levels = 4
    assert sum(read) <= sum(map(len, strings)) + levels * len(strings) + len(runs) * 12
    assert list(m.merge([])) == []


def test_front_coding_round_trip():
    strings = sorted({bytes(random.Random(k).choices(b"ab\x00", k=k % 9)) for k in range(200)})
    assert [s for _, s in m.decoded(*m.front_coded(strings))] == strings


def test_equal_windows_choose_equal_anchors(monkeypatch):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 4000).astype(np.uint8).tobytes() + b"a" * 300
    ends = np.array([0, 1000, 1000, 2500, len(text)])
    whole = m.anchors_of(text, ends, 30, 10)
    monkeypatch.setattr(m, "BLOCK", 333)
    seen = {}
    for a in (whole, m.anchors_of(text, ends, 30, 10)):
        starts = set()
        for key, at, first, last, t in zip(a.key, a.at, a.first, a.last, a.text):
            for j in range(first, last + 1):
                assert j <= at and at + 10 <= j + 30 <= ends[t] and (t == 0 or j >= ends[t - 1])
                assert seen.setdefault(text[j : j + 30], (key, at - j)) == (key, at - j)
                starts.add(j)
        lows = np.concatenate([[0], ends[:-1]])
        assert starts == {j for lo, hi in zip(lows, ends) for j in range(lo, hi - 29)}

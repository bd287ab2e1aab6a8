import math
import random
import re
from collections import Counter

import numpy as np

from playmetry.llm import lexical as m

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))


def plain(docs, items, k=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, some in asked.items():
        scored = []
        for d, c, n in counted:
            s = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms))) for t in some if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, rank + 1, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def told(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def fixture():
    rng = random.Random(7)
    words = [f"w{n}" for n in range(60)] + ["Ärger", "ärger", "ÉTÉ", "x_y", "İ", "a1", "日本", "don't"]
    text = lambda n: " ".join(rng.choices(words, range(len(words), 0, -1), k=n))
    docs = [(i, text(rng.choice([1, 3, 20, 80, 400]))) for i in range(300)]
    docs += [(i, docs[5][1]) for i in range(300, 420)]  # a large group of equal texts
    docs += [(500, None), (501, ""), (502, " .,- \n"), (None, "w1 w59 日本"), (7, "w59 W59 w59"), (7, "w59 W59 w59"), (503, "w58 " * 30_000)]
    items = [(k, text(12)) for k in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (23, docs[5][1]), (None, "日本 İ"), (3, "w59 more"), (4, "W1.W2\x00w3")]
    return docs, items


def frames(llm, docs, items):
    return llm.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], "doc_id long, text string, score int, item_id string, id string"), llm.createDataFrame(
        [(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, rank int"
    )


def test_against_plain_loops(llm):
    docs, items = fixture()
    d, i = frames(llm, docs, items)
    want = plain(docs, items)
    assert told(m.lexical_search(d, i)) == want
    assert told(m.lexical_search(d, i, pass_terms=20)) == want  # several passes
    assert told(m.lexical_search(d, i, k=3)) == plain(docs, items, 3)


def test_any_bucket_size_gives_the_same(llm, monkeypatch):
    docs, items = fixture()
    d, i = frames(llm, docs, items)
    monkeypatch.setattr(m, "BUCKET_ROWS", 16)
    monkeypatch.setattr(m, "LONGEST", 8)
    assert told(m.lexical_search(d, i)) == plain(docs, items)


def test_empty_tables(llm):
    docs, items = frames(llm, *fixture())
    assert m.lexical_search(docs.limit(0), items).count() == 0
    assert m.lexical_search(docs, items.limit(0)).count() == 0
    assert m.lexical_search(docs.where("doc_id in (500, 501, 502)"), items).count() == 0


def test_bounds_leave_most_pairs_unscored(llm):
    sf = "/root/testdata/sf0.01"
    docs, items = llm.read.parquet(f"{sf}/documents.parquet"), llm.read.parquet(f"{sf}/benchmark.parquet")
    rows = m.term_table(items, "item_id", "text").toPandas().groupby("item").term.agg(list)
    numbers = {t: n for n, t in enumerate(sorted({t for r in rows for t in r}))}
    asked = m.Items(list(rows.index), [np.array(sorted(numbers[t] for t in r)) for r in rows])
    seen = m.answer(docs, asked, numbers, 10, "doc_id", "text")[1].groupBy().sum().first()
    assert 0 < seen["sum(scored)"] < 0.1 * seen["sum(pairs)"]
    assert seen["sum(looked_into)"] <= seen["sum(pairs)"]


def test_a_short_bucket_is_skipped():
    bucket = m.Bucket(np.arange(3), np.array([5.0, 4.0, 3.0]), np.array([2, 1, 1]), np.array([0, 1, 1, 0]), np.array([3, 4, 4, 3]), 2)
    assert bucket.survivors(np.array([0, 1]), 8).tolist() == []
    assert bucket.survivors(np.array([0, 1]), 7).tolist() == [0]
    assert bucket.scores(np.array([0, 2]), np.array([1, 1])).tolist() == [7, 3]

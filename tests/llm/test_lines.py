import itertools
import re
from collections import defaultdict

import numpy as np

from playmetry.llm import lines as m
from playmetry.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen, dups, where = set(), 0, defaultdict(list)
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    again = {k for v in where.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(again), n < 20 or 100 * len(again) > 30 * n


def test_base_counts(llm, sf, documents):
    odd = [None, "", " \n ", "a\u00a0b\u2003c\n\na\u00a0b\u2003c", "x " * 30, "é😀 #|<> \x0b\x1c z\r\nz\r\n", "word " * 20_000, "\n".join(["same line here"] * 9)]
    docs = documents(*odd).select("doc_id", "text").union(llm.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 100", "text"))
    docs = docs.union(docs.limit(1))
    field = m.Field(np.zeros((len(m.FEATURES), 2)), np.zeros((2, 2)))
    got = {r.doc_id: r for r in m.quality_rules(docs, field).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(r.text)
        assert g.kept == (not g.base_failed)
    assert m.quality_rules(docs.limit(0), field).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        field = m.Field(rng.normal(size=(len(m.FEATURES), 2)), rng.normal(size=(2, 2)))
        x = rng.integers(0, 2, (n, len(m.FEATURES))).astype(float)
        e = x @ field.emission
        value = lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(field.transition[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(field.viterbi(x)) == best


def test_field_learns_and_keeps_clean_documents(llm):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_rules"](llm, folder).join(llm.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.3


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    k = len(m.FEATURES)
    texts = [rng.integers(0, 2, (n, k)).astype(float) for n in (1, 3, 7, 9, 300)]
    groups = m._chains(texts, [rng.integers(0, 2, len(t)) for t in texts])
    assert sum(int(there.sum()) for *_, there in groups) == 320
    field = m.Field(rng.normal(size=(k, 2)), rng.normal(size=(2, 2)))
    for g in groups:
        _, by_e, by_t = m.likelihood(field, *g)
        for part, grad in ((field.emission, by_e), (field.transition, by_t)):
            for at in [(0, 0), (1, 1), (0, 1), (part.shape[0] - 1, 0)]:
                held = part[at]
                ends = []
                for step in (1e-5, -1e-5):
                    part[at] = held + step
                    ends.append(m.likelihood(field, *g)[0])
                part[at] = held
                assert abs((ends[0] - ends[1]) / 2e-5 - grad[at]) < 1e-4 * max(1, abs(grad[at]))


def test_labels_keep_the_bounds():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 12))
        field = m.Field(rng.normal(size=(len(m.FEATURES), 2)), rng.normal(size=(2, 2)))
        x, words = rng.integers(0, 2, (n, len(m.FEATURES))).astype(float), rng.integers(1, 20, n)
        free = field.viterbi(x)
        for kind in (m.BOILERPLATE, m.CONTENT):
            got = m.constrained_labels(field, x, words, kind)
            assert words[got == kind].sum() >= words.sum() / 2
            if words[free == kind].sum() >= words.sum() / 2:
                assert (got == free).all()


def test_lines_of_one_text_differ(llm, documents):
    """A text of half clean prose and half menu lines is told apart line by line."""
    folder = "/root/testdata/sf0.01"
    docs, labels = llm.read.parquet(f"{folder}/documents.parquet"), llm.read.parquet(f"{folder}/labels.parquet")
    field = m.learn_lines(docs, labels)
    clean = [r.text for r in docs.join(labels, "doc_id").where("quality = 1").orderBy("doc_id").limit(3).collect()]
    junk = [r.text for r in docs.join(labels, "doc_id").where("quality = 0").orderBy("doc_id").collect()]
    junk = [t for t in junk if " | " in t][0].split("\n")[-2:]
    planted = []
    for text in clean:
        lines, n = [], 0
        for line in text.split("\n"):
            lines.append(line)
            n += len(line.split())
        menu = []
        while sum(len(x.split()) for x in menu) < n:
            menu += junk
        planted += ["\n".join(lines + menu), "\n".join(menu + lines)]
    shares = [r.content_share for r in m.quality_rules(documents(*planted), field).collect()]
    assert all(0.2 < s < 0.8 for s in shares), shares


def test_training_agrees_on_repeated_ids(llm):
    rows = [(k % 5, f"line {k} of text.\nmenu | {k}\n" * (k % 4 + 1)) for k in range(60)]
    labels = llm.createDataFrame([(k, k % 2) for k in range(5)] * 2 + [(None, 1), (2, None)], "doc_id long, quality int")
    fields = [m.learn_lines(llm.createDataFrame(some, "doc_id long, text string").repartition(n), labels) for some, n in ((rows, 1), (rows[::-1], 7))]
    assert (fields[0].emission == fields[1].emission).all() and (fields[0].transition == fields[1].transition).all()


def test_no_labels_keep_all(llm, documents):
    docs = documents("a b c.")
    field = m.learn_lines(docs, llm.createDataFrame([], "doc_id long, quality int"))
    assert field.viterbi(np.zeros((3, len(m.FEATURES)))).tolist() == [m.CONTENT] * 3

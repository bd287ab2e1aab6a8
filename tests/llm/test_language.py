import numpy as np
import pytest

from playmetry.llm import language as m
from playmetry.llm.language import Profiler, identify, learn_profiles
from playmetry.llm.queries import QUERIES


def test_held_out_accuracy(llm, sf):
    got = QUERIES["op2_language_id"](llm, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_edges(llm, documents):
    docs = documents("the cat sat on the mat and the hat", "le chat est sur le tapis et la table", None, "", "12 ... 34", "the cat", "x" * 50_000, "the cat")
    model = learn_profiles(docs.where("doc_id < 2").selectExpr("text", "if(doc_id = 0, 'en', 'fr') lang"))
    out = {r.doc_id: r for r in identify(docs, model).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und", "en"]
    assert out[2].score == out[4].score == 0.0 and 0 < out[5].score == out[7].score <= 1
    assert out[6].lang_pred in ("en", "fr") and out[0].id == 7
    nothing = learn_profiles(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        learn_profiles(docs.where("doc_id < 2").selectExpr("text", "text lang"), max_languages=1)


def test_long_texts_are_counted_whole(monkeypatch):
    text = "Abc dé, fgh; " * 50
    whole = Profiler().grams(text)
    monkeypatch.setattr("playmetry.llm.language.SEGMENT", 7)
    parts = Profiler().grams(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def plain_bundle(profiler, text):
    """The bundle of a text letter by letter, without numpy's sums."""
    marks, gap = [0], True
    for c in text.lower():
        if c.isalpha():
            marks.append(ord(c))
            gap = False
        elif not gap:
            marks.append(0)
            gap = True
    if not gap:
        marks.append(0)
    letters = {m: [int(x) for x in profiler.letter_vectors(np.array([m], np.uint64))[0]] for m in set(marks)}
    orders = [[int(x) for x in o] for o in profiler.orders]
    total = [0] * profiler.width
    for k in range(len(marks) - 2):
        gram = marks[k : k + 3]
        if any(gram):
            for i in range(profiler.width):
                total[i] += letters[gram[0]][orders[2][i]] * letters[gram[1]][orders[1][i]] * letters[gram[2]][orders[0][i]]
    return total


def test_bundles_and_cosines_by_plain_loops(llm):
    profiler = m.Profiler(width=128)
    known = [("the cat sat on the mat", "en"), ("a dog and the cat", "en"), ("der hund und die katze", "de"), ("ein Hund!", "de"), ("le chat noir est ici", "fr"), (None, "fr"), ("orphan", None)]
    texts = ["the dog", "die Katze", "le chien est là", "zzz", "Ünd", "x", "", "12", None, "the the the", "日本 語", "cat-katze chat"]
    labelled = llm.createDataFrame(known, "text string, lang string")
    profiles = m.learn_profiles(labelled, profiler=profiler)
    sums = {}
    for text, lang in known:
        if text and lang:
            sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * 128), plain_bundle(profiler, text))]
    assert profiles.names == sorted(sums)
    for name, vector in zip(profiles.names, profiles.vectors):
        assert vector.tolist() == sums[name]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    got = {r.text: r for r in m.identify(llm.createDataFrame([(t,) for t in texts], "text string"), profiles).collect()}
    for text in texts:
        bundle = plain_bundle(profiler, text or "")
        if not any(c.isalpha() for c in text or ""):
            assert (got[text].lang_pred, got[text].score) == (m.UNDETERMINED, 0.0)
            continue
        cosines = {n: sum(a * b for a, b in zip(bundle, sums[n])) / (norm(bundle) * norm(sums[n])) for n in sums}
        best = min(cosines, key=lambda n: (-round(cosines[n], 12), n))
        assert got[text].lang_pred == best and abs(got[text].score - min(max(cosines[best], 0), 1)) < 1e-9


def test_a_tie_goes_to_the_first_name_and_names_may_clash(llm):
    same = llm.createDataFrame([("one text here", "b"), ("one text here", "a")], "text string, lang string")
    frame = llm.createDataFrame([("one text", "x", "y")], "text string, __judged string, judged string")
    row = m.identify(frame, m.learn_profiles(same)).first()
    assert row.lang_pred == "a" and row["__judged"] == "x" and row.judged == "y"

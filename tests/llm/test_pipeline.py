import random

import corpus_pipeline as pipeline
from playmetry.llm import pieces


def test_stages(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("n_chars", "n").selectExpr("*", "n n_chars", "'x' seq").drop("n")
    extra = llm.createDataFrame([(9001, None, None, None, None, "x"), (9002, "123 ...", "en", "s", 7, "x"), (None, "the and of words here", "en", None, 21, "x"), (9003, "word " * 3000, "en", "s", 15000, "x")], docs.select("doc_id", "text", "lang", "source", "n_chars", "seq").schema)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", "seq").union(extra)
    seen = [docs.count()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(llm, docs, sf).cache()
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == list(pipeline.COLUMNS), name
        if k == 0:
            assert docs.where("doc_id in (9001, 9002, 9003)").count() == 0 and seen[0] - 10 <= seen[1] <= seen[0] - 3
        if k == 2:
            for r in docs.collect():
                assert r.n_chars == len(r.text) or r.text == texts[r.doc_id]
    assert 0 < seen[3] <= seen[2] < seen[1]
    vocabulary = pieces.load_vocabulary()
    assert all(r.n_pieces == len(r.pieces) for r in docs.collect())
    assert "".join(pieces.decode_ids(vocabulary.texts, r.pieces) for r in docs.limit(3).collect())


def words(rng, n):
    return " ".join("".join(rng.choices("abdeinorst", k=rng.randint(2, 9))) for _ in range(n))


def frame(llm, rows):
    return llm.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")


def test_texts_under_a_shared_id(llm, sf):
    """Two texts bear one id: one is a copy of an earlier document, the other holds a passage of a third."""
    rng = random.Random(1)
    first, own, passage = words(rng, 120), words(rng, 90), words(rng, 70)
    holder, tail = words(rng, 40) + " " + passage, words(rng, 60)
    rows = [(1, first), (2, first + " end"), (2, passage + " " + tail), (3, holder), (4, own), (4, own), (None, first), (5, own + " x y z " + words(rng, 30))]
    docs = frame(llm, rows)
    kept = pipeline.near_duplicates(llm, docs, sf)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, first), (2, passage + " " + tail), (3, holder), (4, own), (None, first), (5, rows[-1][1])], key=str)
    cut = {(r.doc_id, r.text) for r in pipeline.repeated_passages(llm, kept, sf).collect()}
    rest = " ".join(rows[-1][1].split()[90:])
    assert cut == {(1, first), (2, passage + " " + tail), (3, " ".join(holder.split()[:40])), (4, own), (None, first), (5, rest)}
    # An id of its own counts as the earlier one, so a text under a shared id loses the passage.
    cut = {(r.doc_id, r.text) for r in pipeline.repeated_passages(llm, docs, sf).collect()}
    assert cut == {(1, first), (2, "end"), (2, tail), (3, holder), (4, own), (None, first), (5, rest)}


def test_language_rejects_what_was_not_learned(llm):
    folder = "/root/testdata/sf0.01"
    docs = llm.read.parquet(f"{folder}/documents.parquet")
    rng = random.Random(2)
    texts = [r.text for r in docs.where("length(text) > 1500").orderBy("doc_id").limit(8).collect()]
    shuffled = ["".join(rng.sample(t, len(t))) for t in texts]
    foreign = ["".join(rng.choices("αβγδεζηθικλμνξοπρστυφχψω ", k=2000)) for _ in range(4)] + ["".join(rng.choices("我的是不了人在有他这 ", k=900)) for _ in range(2)]
    planted = [(100_000 + k, t, "en", "s", 0) for k, t in enumerate(shuffled + foreign + ["123 - ...", None])]
    whole = docs.select(*pipeline.COLUMNS).union(llm.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long").select(*pipeline.COLUMNS))
    kept = {r.doc_id for r in pipeline.languages(llm, whole, folder).select("doc_id").collect()}
    assert not [i for i in kept if i >= 100_000]
    clean = {r.doc_id for r in llm.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    assert len(kept & clean) >= 0.99 * len(clean) and len(kept) >= 0.98 * docs.count()


def test_run_and_empty(llm, sf, tmp_path):
    assert pipeline.run(llm, sf).count() > 100
    llm.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(llm, str(tmp_path)).count() == 0

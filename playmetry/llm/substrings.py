"""Substring dedup by seed and extend: winnowed anchors, matches to both sides, maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetry.llm.common import join_hot, mix64, run_hashes, settle, split_words, word_hashes

#: Words of an anchor. Shorter anchors are shared by chance, longer ones are denser.
ANCHOR = 12


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """For every run of `window` anchors hashes, the index of the smallest one (the first on a tie).

    Two texts that share the words under a run choose the same word positions in it.
    """
    best = np.arange(len(grams))
    width = 1
    while width * 2 <= window:
        a, b = best[:-width], best[width:]
        best = np.where(grams[b] < grams[a], b, a)
        width *= 2
    if width < window:
        a, b = best[: len(best) - (window - width)], best[window - width :]
        best = np.where(grams[b] < grams[a], b, a)
    return best


def anchors_of(hashes: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: hash, and the first and last window that each anchor stands for.

    Every window of `length` words belongs to exactly one anchor that lies inside it, chosen
    by the window's words alone, so equal windows meet at equal anchors.
    """
    grams = run_hashes(hashes, anchor)
    if len(hashes) < length:
        return grams[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = winnowed(grams, length - anchor + 1)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(first[1:], len(chosen)) - 1
    return grams[chosen[first]], first, last


def covered(starts: np.ndarray, n_words: int, length: int) -> np.ndarray:
    """Words under any window that begins at one of `starts`."""
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + length, n_words), -1)
    return np.cumsum(marks[:-1]) > 0


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def repeats(docs: DataFrame, length: int = 50, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Repeated passages of every text: (`facts`, `spans`).

    `facts` has one row per input row: key, n_words, seq (SHA-256 of the words joined by one
    space), s (its first eight bytes), whole (true when all words go because an equal text has a smaller key).
    `spans` has one row per text with repeats that is not `whole`: key, s (its sequence, short),
    text, starts (windows of `length` words whose words also begin under a smaller key).

    Seed: every window belongs to one winnowed anchor, and anchors meet by hash; anchors of
    one distinct text alone end here. Extend: the words on both sides of a shared anchor are
    taken in as windows of `length` words around it, keyed by anchor and words, so n holders
    of an anchor cost n rows and never n * n pairs. The smallest key that holds a window is
    found by a map-side minimum. Windows that touch or overlap merge into maximal repeats.

    Null keys are never smaller than another and lose nothing; null and empty texts have no
    words. Rows with equal key and text get equal results. Equal texts keep the smallest key.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seqs, counts, anchors = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split_words(t)
                ids.append(i)
                counts.append(len(words))
                seqs.append(hashlib.sha256(b" ".join(words)).digest())
                usable = len(words) >= length and i is not None
                anchors.append(np.unique(_signed(anchors_of(word_hashes(words), length, anchor)[0])) if usable else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(a) for a in anchors])])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(seqs, pa.binary()),
                    pa.array([_short(s) for s in seqs], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *anchors]))),
                ],
                names=["id", "seq", "s", "n_words", "anchors"],
            )

    looked = settle(source.mapInArrow(look, "id long, seq binary, s long, n_words long, anchors array<long>"), "passages")
    # Equal texts: all but the smallest key are repeats from end to end.
    copies = (
        looked.where((F.col("n_words") >= length) & F.col("id").isNotNull())
        .groupBy("seq")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("seq", "first_id")
    )
    facts = settle(
        join_hot(looked, copies, ["seq"], "left").select(
            "id", "seq", "s", "n_words", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)).alias("whole"), "anchors"
        ),
        "facts",
    )
    # Seeds: anchors that two different texts hold.
    held = facts.where("not whole").select("id", "s", F.explode("anchors").alias("anchor"))
    seeds = held.groupBy("anchor").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a != b").select("anchor")
    wanted = join_hot(held, seeds, ["anchor"]).groupBy("id", "s").agg(F.collect_set("anchor").alias("shared"))
    near = settle(
        source.where(F.col("id").isNotNull() & F.col("text").isNotNull()).join(wanted, "id").select("id", "s", "text", "shared"),
        "near",
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s, t, shared in zip(*[batch.column(c).to_pylist() for c in ("id", "s", "text", "shared")]):
                words = split_words(t)
                if _short(hashlib.sha256(b" ".join(words)).digest()) != s:
                    continue  # another text under the same key
                hashes = word_hashes(words)
                grams, first, last = anchors_of(hashes, length, anchor)
                take = np.isin(_signed(grams), np.array(shared, np.int64))
                at = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b + 1) for a, b in zip(first[take], last[take]))])
                around = run_hashes(mix64(hashes + np.uint64(7)), length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(_signed(grams)[take], (last - first + 1)[take]), pa.int64()),
                        pa.array(_signed(around[at]), pa.int64()),
                        pa.array(np.full(len(at), i, np.int64)),
                        pa.array(np.full(len(at), s, np.int64)),
                        pa.array(at.astype(np.int32)),
                    ],
                    names=["anchor", "words", "id", "s", "at"],
                )

    windows = settle(near.mapInArrow(extend, "anchor long, words long, id long, s long, at int"), "windows")
    firsts = (
        windows.groupBy("anchor", "words")
        .agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        .where("first_id < last_id")
        .select("anchor", "words", "first_id")
    )
    spans = (
        join_hot(windows, firsts, ["anchor", "words"])
        .where(F.col("id") > F.col("first_id"))
        .groupBy("id", "s")
        .agg(F.collect_set("at").alias("starts"))
    )
    return facts.drop("anchors"), near.select("id", "s", "text").join(spans, ["id", "s"])


def maximal_repeats(docs: DataFrame, length: int = 50, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal repeats as rows (key, first_word, last_word): windows that touch or overlap, merged.

    A text equal to one with a smaller key is one repeat from its first to its last word.
    """
    facts, spans = repeats(docs, length, anchor, key, text)
    ordered = F.array_sort("starts")
    # An array of (first, last) built by one pass over the sorted window starts.
    merged = F.aggregate(
        ordered,
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] + 1 >= s),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), (s + F.lit(length - 1)).alias("b"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s.alias("a"), (s + F.lit(length - 1)).alias("b"))))),
    )
    some = spans.select(F.col("id").alias(key), F.explode(merged).alias("m")).select(key, F.col("m.a").cast("long").alias("first_word"), F.col("m.b").cast("long").alias("last_word"))
    whole = facts.where("whole").select(F.col("id").alias(key), F.lit(0).cast("long").alias("first_word"), (F.col("n_words") - 1).alias("last_word"))
    return some.union(whole)


def remove_repeats(docs: DataFrame, length: int = 50, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Facts of every row after its repeats are gone: key, n_words, n_removed, kept_text, kept_sha256.

    `kept_text` joins the words left by one space and is null where nothing was removed (the
    text stands as it was); `kept_sha256` is of the words left, joined by one space, in UTF-8.
    """
    facts, spans = repeats(docs, length, anchor, key, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, s, t, starts in zip(*[batch.column(c).to_pylist() for c in ("id", "s", "text", "starts")]):
                words = split_words(t)
                if _short(hashlib.sha256(b" ".join(words)).digest()) != s:
                    continue
                gone = covered(np.array(starts, np.int64), len(words), length)
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((i, s, int(gone.sum()), left.decode(), hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["id", "s", "gone", "left", "sha"])

    changed = spans.select("id", "s", "text", "starts").mapInArrow(cut, "id long, s long, gone long, left string, sha string").dropDuplicates(["id", "s"])
    empty = F.sha2(F.lit(""), 256)
    return facts.join(changed, ["id", "s"], "left").select(
        F.col("id").alias(key),
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), F.lit("")).otherwise(F.col("left")).alias("kept_text"),
        F.when(F.col("whole"), empty).otherwise(F.coalesce("sha", F.lower(F.hex("seq")))).alias("kept_sha256"),
    )

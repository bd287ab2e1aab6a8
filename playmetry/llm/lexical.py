"""Ranked lexical search: impact vectors in buckets of like length, pruned by exact bounds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playmetry.llm.common import settle

#: A term: a run of ASCII letters and digits and of all other characters beyond ASCII.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Item terms that one pass over the documents answers; they are what its tasks hold besides their rows.
PASS_TERMS = 1 << 20
#: Documents of a bucket, and entries of its vectors, at most (a longer vector is a bucket by itself).
BUCKET_ROWS, BUCKET_ENTRIES = 4096, 1 << 21
#: Documents with the longest vectors, which are searched first and set the bars for all others.
LONGEST = 4096
#: The filter reads an item's coordinates until the others can add this share of its bar; room for rounding.
REST, ROOM = 1 / 8, 1 + 1e-9

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Items:
    """Items of one pass and their terms as numbers; as vectors they hold a 1 for every term."""

    ids: list
    terms: list[np.ndarray]

    def lengths(self) -> np.ndarray:
        return np.sqrt([float(len(t)) for t in self.terms])


def term_table(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term), each pair once; rows under one item key are one item with all their terms."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lowered, F.lit(TERM_PATTERN), F.lit(0))
    return items.select(F.col(key).alias("item"), F.explode(found).alias("term")).distinct()


def term_counts(docs: DataFrame, numbers: dict[str, int], key: str, text: str) -> DataFrame:
    """(id, n, terms, tfs) of every row with a term: its number of terms with repeats, and counts of those in `numbers`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM_PATTERN).findall
        for batch in batches:
            ids, sizes, terms, tfs, ends = [], [], [], [], [0]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = find(t.translate(LOWER)) if t else []
                if not found:
                    continue
                seen = [(numbers[w], c) for w, c in Counter(found).items() if w in numbers]
                ids.append(i)
                sizes.append(len(found))
                terms.extend(a for a, _ in seen)
                tfs.extend(c for _, c in seen)
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))],
                names=["id", "n", "terms", "tfs"],
            )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(count, "id long, n long, terms array<int>, tfs array<long>")


def impact_vectors(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(id, terms, impacts, length) of the rows that hold a term of the items; length is rounded up.

    An impact is what the term adds to the score of an item that has it, weight included, so
    a score is the inner product with an item's vector of ones. Only coordinates that some
    item has matter for inner products, so vectors stop there.
    """

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            m = np.repeat(_smoothing(batch.column(1).to_pylist(), n_docs, n_terms), sizes)
            impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            squares = np.add.reduceat(impact.astype(float) ** 2, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(terms)), pa.ListArray.from_arrays(ends, pa.array(impact)), pa.array(np.sqrt(squares) * ROOM)],
                names=["id", "terms", "impacts", "length"],
            )

    return counted.where(F.size("terms") > 0).mapInArrow(impacts, "id long, terms array<int>, impacts array<long>, length double")


def _smoothing(sizes: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 90 + (90 * n * N) div L of every size, in Python's whole numbers, which cannot overflow."""
    return np.array([10 + 90 * n * n_docs // n_terms for n in sizes], np.int64)


class Best:
    """The `k` best documents of every item so far: higher scores first, equal scores by the smaller id."""

    def __init__(self, n: int, k: int, bars: np.ndarray):
        self.k, self.bars, self.scores, self.ids = k, bars.copy(), [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        some = (scores > 0) & (scores >= self.bars[item])
        s, i = np.concatenate([self.scores[item], scores[some]]), np.concatenate([self.ids[item], ids[some]])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[item], self.ids[item] = s[order], i[order]
        if len(order) == self.k:
            self.bars[item] = max(self.bars[item], s[order[-1]])


class Bucket:
    """Documents of like length: vectors row by row, and the entries of each coordinate."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.ids, self.lengths, self.longest = ids, lengths, float(lengths.max())
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.impacts = terms, impacts
        order = np.argsort(terms, kind="stable")
        self.owner = np.repeat(np.arange(len(ids)), sizes)[order]
        self.sorted = impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.tops = np.zeros(n_terms, np.int64)
        some = self.starts[1:] > self.starts[:-1]
        self.tops[some] = np.maximum.reduceat(self.sorted, self.starts[:-1][some]) if len(terms) else 0

    def survivors(self, terms: np.ndarray, bar: int) -> np.ndarray:
        """Rows whose score may reach `bar`.

        Coordinates are read by their largest impact in the bucket, the largest first, and
        added up exactly, until the others can add at most REST of the bar. What these can
        add is bounded twice: by the sum of their largest impacts, and by Cauchy-Schwarz on
        what is left of both lengths. Rows below the bar under either bound drop out, and so
        does the bucket if all largest impacts together stay below the bar.
        """
        begin, end = self.starts[terms], self.starts[terms + 1]
        held = np.flatnonzero(end > begin)
        tops = self.tops[terms[held]]
        order = np.argsort(-tops, kind="stable")
        after = np.cumsum(tops[order][::-1])[::-1]
        if not len(held) or after[0] < bar:
            return np.zeros(0, np.int64)
        read = int((after > REST * bar).sum())
        partial, squares = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for k in held[order[:read]].tolist():
            rows, impact = self.owner[begin[k] : end[k]], self.sorted[begin[k] : end[k]]
            partial[rows] += impact
            squares[rows] += impact.astype(float) ** 2
        rest = len(held) - read
        left = np.sqrt(np.maximum(self.lengths**2 - squares, 0) * rest) * ROOM + 1
        return np.flatnonzero(partial + np.minimum(left, float(after[read]) if rest else 0.0) >= max(bar, 1))

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of some rows in 64-bit integers; `wanted` has a 1 for every term of the item."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        at = np.repeat(self.ends[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.add.reduceat(wanted[self.terms[at]] * self.impacts[at], np.cumsum(sizes) - sizes) if len(rows) else np.zeros(0, np.int64)


def search(vectors: DataFrame, items: Items, n_terms: int, bars: np.ndarray, k: int, counts: bool = False) -> DataFrame:
    """(item number, id, score): every task's `k` best documents for every item, none below the item's bar.

    Each task sorts its vectors by length, longest first, and cuts them into buckets. A bucket
    whose longest vector times the item's length stays below the item's bar is skipped, and
    all later ones with it; inside a bucket `Bucket.survivors` filters; survivors are scored
    exactly. Bars rise as a task finds documents. With `counts` there is one row per task
    instead: pairs of item and document in all, past the buckets, past the filter.
    """
    lengths = items.lengths() * ROOM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, wanted, tally = Best(len(items.ids), k, bars), np.zeros(n_terms, np.int64), np.zeros(3, np.int64)
        for bucket in _buckets(batches, n_terms):
            tally[0] += len(items.ids) * len(bucket.ids)
            for item in np.flatnonzero(lengths * bucket.longest * ROOM + 1 >= best.bars):
                terms = items.terms[item]
                rows = bucket.survivors(terms, int(best.bars[item]))
                tally[1] += len(bucket.ids)
                tally[2] += len(rows)
                wanted[terms] = 1
                best.add(item, bucket.scores(rows, wanted), bucket.ids[rows])
                wanted[terms] = 0
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(tally[j : j + 1]) for j in range(3)], names=["pairs", "looked_into", "scored"])
        elif best.ids:
            numbers = np.repeat(np.arange(len(items.ids), dtype=np.int64), [len(x) for x in best.ids])
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], names=["number", "id", "score"])

    ordered = vectors.sortWithinPartitions(F.desc("length"), "id").select("id", "length", "terms", "impacts")
    return ordered.mapInArrow(run, "pairs long, looked_into long, scored long" if counts else "number long, id long, score long")


def _buckets(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[Bucket]:
    held, rows, entries = [], 0, 0

    def close() -> Bucket:
        return Bucket(*(np.concatenate(c) for c in zip(*held)), n_terms)

    for batch in batches:
        if not batch.num_rows:
            continue
        terms, impacts = batch.column(2), batch.column(3)
        sizes = np.diff(terms.offsets.to_numpy())
        if held and (rows + batch.num_rows > BUCKET_ROWS or entries + int(sizes.sum()) > BUCKET_ENTRIES):
            yield close()
            held, rows, entries = [], 0, 0
        ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
        held.append((ids, batch.column(1).to_numpy(), sizes, terms.flatten().to_numpy(), impacts.flatten().to_numpy()))
        rows, entries = rows + batch.num_rows, entries + int(sizes.sum())
    if held:
        yield close()


def ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The `k` best rows per key: first within 64 shares of the ids, then of what these hand on."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    share = F.pmod(F.xxhash64("id"), F.lit(64))
    some = found.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy(*keys, "share").orderBy(*order))).where(F.col("place") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("share", "place")


def answer(docs: DataFrame, items: Items, numbers: dict[str, int], k: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """One pass: (hits as number, id, score, rank; counts of pairs as `search` gives them)."""
    counted = settle(term_counts(docs, numbers, key, text), "terms")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(numbers), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most PASS_TERMS rows
        df[r.t] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    vectors = settle(impact_vectors(counted, weights, n_docs, n_terms), "impacts")
    size = len(numbers)
    # Lengths are counted in steps of a sixteenth of a doubling; the longest steps with LONGEST rows go first.
    step = F.floor(F.log2(F.col("length") + 1) * 16)
    steps = vectors.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    cut, seen = -math.inf, 0
    for r in steps:
        cut, seen = r.step, seen + r["count"]
        if seen >= LONGEST:
            break
    bars = np.zeros(len(items.ids), np.int64)
    first = ranked(search(vectors.where(step >= cut), items, size, bars, k), k, "number")
    for r in first.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).where(F.col("n") >= k).collect():  # one row per item
        bars[r.number] = r.bar
    return ranked(search(vectors, items, size, bars, k), k, "number"), search(vectors, items, size, bars, k, counts=True)


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 10, pass_terms: int = PASS_TERMS, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(<item_key>, rank int, <key>, score): the `k` documents with the highest scores above 0 for every item.

    Items are dealt into passes of about `pass_terms` terms by a hash of their key; each pass
    reads the documents once, so what a task or the driver holds is bounded by a pass. Terms
    are counted in tasks against the pass's terms, document counts per term are combined by
    Spark, and `search` finds the best documents of every task.

    Every row with a term counts as a document; null and empty texts have none. Repeated rows
    rank one after the other; equal scores go by the smaller id, null ids last. Items without
    terms, or whose terms no document holds, have no rows; rows under one item key (null is
    one key) are one item with all their terms. Scores are the same under any bucket sizes.
    """
    spark = docs.sparkSession
    pairs = settle(term_table(items, item_key, item_text), "items")
    n_passes = max(1, -(-pairs.count() // pass_terms))
    share = F.pmod(F.xxhash64("item"), F.lit(n_passes))
    kind = items.schema[item_key].dataType
    out = spark.createDataFrame([], f"`{item_key}` {kind.simpleString()}, rank int, `{key}` long, score long")
    for number in range(n_passes):
        rows = pairs.where(share == number).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()
        numbers = {t: n for n, t in enumerate(sorted({t for r in rows for t in r.terms}))}
        asked = Items([r.item for r in rows], [np.array(sorted(numbers[t] for t in r.terms), np.int64) for r in rows])
        if not rows:
            continue
        hits, _ = answer(docs, asked, numbers, k, key, text)
        names = spark.createDataFrame([(n, i) for n, i in enumerate(asked.ids)], f"number long, `{item_key}` {kind.simpleString()}")
        null_last = F.when(F.col("id") != np.iinfo(np.int64).max, F.col("id"))
        out = out.unionByName(hits.join(names, "number").select(item_key, F.col("rank").cast("int"), null_last.alias(key), "score"))
    return out

"""Vector code compression: product codes in whole numbers, entries found by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetry.llm.common import join_hot, settle

#: Rows and bytes of vectors that are searched side by side.
BLOCK_ROWS, BLOCK_BYTES = 8192, 16 << 20
#: Equal parts of a vector, entries of a codebook, rounds that move the entries, steps per unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


@dataclass
class Found:
    """Nearest entry of every part vector, its squared distance, and how many entries were looked at."""

    entry: np.ndarray
    distance: np.ndarray
    looked_at: int


class Codebook:
    """Entries of one part position in the order of their component sums."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums, self.sorted, self.dim = sums[self.order], entries[self.order], entries.shape[1]

    def nearest(self, parts: np.ndarray) -> Found:
        """Equal-average search, all rows of `parts` side by side.

        By Cauchy-Schwarz the squared gap of two component sums, over the dimension, never
        exceeds the squared distance. Each row starts where its own sum falls among the
        sorted sums and walks outward to both sides; a side is closed once its next entry's
        bound strictly exceeds the best distance so far, since all entries beyond lie farther
        off. Equal distances go to the lower index, so an equal bound is still looked at.
        """
        n, k = len(parts), len(self.sums)
        best, at, looked = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64), 0
        own = parts.sum(axis=1)
        start = np.searchsorted(self.sums, own)
        open_rows = {1: np.arange(n), -1: np.arange(n)}
        place = {1: start, -1: start - 1}
        while any(len(rows) for rows in open_rows.values()):
            for side in (1, -1):
                rows, here = open_rows[side], place[side]
                inside = (here >= 0) & (here < k)
                rows, here = rows[inside], here[inside]
                near = self._within(own[rows] - self.sums[here], best[rows])
                rows, here = rows[near], here[near]
                apart = parts[rows] - self.sorted[here]
                distance, index = np.einsum("ij,ij->i", apart, apart), self.order[here]
                better = (distance < best[rows]) | ((distance == best[rows]) & (index < at[rows]))
                best[rows[better]], at[rows[better]] = distance[better], index[better]
                looked += len(rows)
                open_rows[side], place[side] = rows, here + side
        return Found(at, best, looked)

    def _within(self, gap: np.ndarray, best: np.ndarray) -> np.ndarray:
        """gap * gap / dim <= best, in whole numbers: the square is compared with best * dim."""
        return best >= -(-(gap * gap) // self.dim)


def whole_vectors(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v) of the rows that take part, components as floor(SCALE * x)."""
    v = F.col(vector).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & good)
    return kept.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE)))))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to BLOCK_ROWS rows or BLOCK_BYTES, so that one step of a search serves many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS or sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _cut(column: pa.ListArray, dim: int, parts: int) -> np.ndarray:
    """A batch's vectors as (rows, parts, components)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, dim // parts)


def learn_codebooks(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, dim / parts) after `rounds` passes over all of `rows`.

    The start is the vectors of the `entries` smallest ids (of rows under one id the smallest
    vector; null ids take no part in the start). In each round every task adds up its parts by
    entry, so one row per part, entry and task is shuffled, and the sums of parts * entries
    rows reach the driver whatever the input's size. An entry becomes the floor of its mean;
    one without parts stays.
    """
    width = dim // parts
    first = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):

        def add_up(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            searchers = [Codebook(b) for b in books]
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in _blocks(batches):
                cut = _cut(batch.column(0), dim, parts)
                for p, searcher in enumerate(searchers):
                    entry = searcher.nearest(cut[:, p]).entry
                    np.add.at(sums[p], entry, cut[:, p])
                    counts[p] += np.bincount(entry, minlength=books.shape[1])
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "s"],
            )

        added = rows.select("v").mapInArrow(add_up, "part int, entry int, n long, s array<long>")
        moved = books.copy()
        for r in added.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[k]) for k in range(width)]).alias("s")).collect():
            moved[r.part, r.entry] = [x // r.n for x in r.s]
        books = moved
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): per vector <key>, <label>, entries array<int>, error long, looked_at long.

    `entries` holds the index of the nearest entry for each part in turn, `error` the squared
    distances summed over the parts, `looked_at` how many entries the batch's search met on
    average. Vectors that are null or hold a null or non-finite component are dropped. All
    others must have one length that `parts` divides, and components small enough for 64-bit
    squares; else a ValueError names the reason. Rows are coded one by one, so repeated rows
    get equal codes; null keys and labels are kept. An empty table gives no rows and empty
    codebooks, fewer than `entries` ids give as many entries.
    """
    rows = settle(whole_vectors(vectors, key, vector, label), "whole")
    size = F.size("v")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    shortest, longest, reach = rows.agg(F.min(size), F.max(size), largest).first()
    kind, label_kind = "long", vectors.schema[label].dataType.simpleString()
    schema = f"id {kind}, label {label_kind}, entries array<int>, error long, looked_at long"
    if shortest is None:
        return vectors.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    dim = longest
    if shortest != longest or dim == 0 or dim % parts:
        raise ValueError(f"vectors have {shortest} to {longest} components; {parts} equal parts need one length that {parts} divides")
    if 4 * dim * dim * reach * reach >= 1 << 62:
        raise ValueError(f"components up to {reach} steps are too large for squared distances in 64 bits")
    books = learn_codebooks(rows, dim, parts, entries, rounds)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = [Codebook(b) for b in books]
        for batch in _blocks(batches):
            cut = _cut(batch.column(2), dim, parts)
            found = [s.nearest(cut[:, p]) for p, s in enumerate(searchers)]
            chosen = np.stack([f.entry for f in found], axis=1).astype(np.int32)
            ends = np.arange(len(chosen) + 1, dtype=np.int32) * parts
            looked = sum(f.looked_at for f in found) // max(len(chosen), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(chosen.ravel())),
                    pa.array(sum(f.distance for f in found)),
                    pa.array(np.full(len(chosen), looked, np.int64)),
                ],
                names=["id", "label", "entries", "error", "looked_at"],
            )

    return rows.mapInArrow(code, schema), books


def codebooks_sha256(books: np.ndarray) -> str:
    """Checksum of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(entries: list[int], books: np.ndarray) -> np.ndarray:
    """The whole-number vector that a code stands for."""
    return np.concatenate([books[p][e] for p, e in enumerate(entries)])


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """<key>, code, error, label_error, codebooks_sha256 of every vector that takes part.

    `code` writes each entry as two hex digits. `label_error` sums the errors of all vectors
    with an equal label, null labels together: labels are summed on the map side, and the sum
    of a hot label is joined back without moving its rows into one task.
    """
    codes, books = compress(vectors, key=key, vector=vector, label=label)
    coded = settle(codes, "codes")
    named = coded.withColumn("named", F.col("label").isNotNull()).withColumn("value", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = named.groupBy("value", "named").agg(F.sum("error").alias("label_error"))
    return join_hot(named, sums, ["value", "named"]).select(
        F.col("id").alias(key),
        F.concat_ws("", F.transform("entries", lambda e: F.lower(F.lpad(F.hex(e.cast("long")), 2, "0")))).alias("code"),
        "error",
        "label_error",
        F.lit(codebooks_sha256(books)).alias("codebooks_sha256"),
    )

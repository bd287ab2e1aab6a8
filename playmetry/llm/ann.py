"""Approximate nearest neighbours by multi-index hashing of learned rotated codes."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playmetry.llm.common import settle

#: Bits of a code and of each of its substrings, and the radius that is searched.
BITS, PART, RADIUS = 128, 8, 55
#: Rows of a block of the index, queries of a block, rows that fit the rotation, and bytes of these.
BLOCK, ASK, SAMPLE, SAMPLE_BYTES = 8192, 2048, 20_000, 32 << 20
#: Different lengths of vectors that one call answers.
LENGTHS = 16


@dataclass
class Rotations:
    """Codes of a vector: signs of its centred, rotated components, one rotation per `dim` bits."""

    mean: np.ndarray
    turns: list[np.ndarray]
    bits: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of bits / 8 bytes; a byte is one substring of the code."""
        centred = vectors - self.mean
        signs = np.concatenate([centred @ t > 0 for t in self.turns], axis=1)[:, : self.bits]
        return np.packbits(signs, axis=1)


def learn_rotations(sample: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 3) -> Rotations:
    """Iterative quantisation: turn the vectors until their signs lose as little as can be.

    Vectors of d components give d bits per rotation; longer codes take several rotations,
    each learned from another random start.
    """
    dim = sample.shape[1]
    mean = sample.mean(axis=0)
    centred = sample - mean
    turns, rng = [], np.random.default_rng(seed)
    for _ in range(-(-bits // dim)):
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(centred.T @ np.where(centred @ turn > 0, 1.0, -1.0))
            turn = u @ v
        turns.append(turn)
    return Rotations(mean, turns, bits)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part: a key, finite components without nulls, not all zero."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & good & F.exists("v", lambda x: x != 0)
    )


def tame(vectors: np.ndarray) -> np.ndarray:
    """The same directions with squares that neither overflow nor vanish: rows of extreme size are
    multiplied by a power of two, which leaves every cosine as it is."""
    power = np.frexp(np.abs(vectors).max(axis=1))[1]
    return np.ldexp(vectors, np.where(np.abs(power) > 200, -power, 0)[:, None])


def stacked(column: pd.Series) -> np.ndarray:
    return tame(np.stack(column.to_numpy()).astype(np.float64))


def exact_cosines(query: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed row by row, so equal vectors get equal values."""
    dots = (found * query[None, :]).sum(axis=1)
    return dots / (np.sqrt((found * found).sum(axis=1)) * np.sqrt((query * query).sum()))


class Index:
    """A block of the index: for each substring, the rows in the order of its value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotations: Rotations):
        self.ids, self.vectors = ids, vectors
        self.units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        codes = rotations.codes(vectors)
        self.parts = codes.shape[1]
        self.words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -self.parts % 8)))).view(np.uint64)
        self.rows = [np.argsort(codes[:, m], kind="stable") for m in range(self.parts)]
        self.starts = [np.searchsorted(codes[r, m], np.arange(257)) for m, r in enumerate(self.rows)]

    def within(self, code: np.ndarray, masks: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from `code` in at most `radius` bits.

        Such a code differs in at most radius // parts bits in one substring at least; `masks`
        are all such differences, so looking up every substring under every mask finds it.
        """
        met = np.zeros(len(self.ids), bool)
        for m in range(self.parts):
            values = code[m] ^ masks
            lists = [self.rows[m][a:b] for a, b in zip(self.starts[m][values].tolist(), self.starts[m][values + 1].tolist()) if a < b]
            if lists:
                met[np.concatenate(lists)] = True
        rows = np.flatnonzero(met)
        word = np.ascontiguousarray(np.pad(code.astype(np.uint8), (0, -self.parts % 8))).view(np.uint64)
        return rows[np.bitwise_count(self.words[rows] ^ word).sum(axis=1) <= radius]


def probe_masks(most: int) -> np.ndarray:
    """All differences of a substring in at most `most` bits."""
    return np.array([sum(1 << b for b in bits) for k in range(min(most, PART) + 1) for bits in combinations(range(PART), k)], np.int64)


def search_block(index: Index, ids: np.ndarray, queries: np.ndarray, rotations: Rotations, radius: int, k: int) -> list[tuple]:
    """The `k` nearest of a block for every query: (query id, id, cosine).

    The radius grows while a block gives fewer than `k` rows, up to all bits. Rows found are
    ranked by cosine; those as near as the k-th are ranked once more by exact sums, equal
    cosines by the smaller id.
    """
    out = []
    codes = rotations.codes(queries).astype(np.int64)
    bits = index.parts * PART
    own = {int(i): n for n, i in enumerate(index.ids.tolist())}
    for qid, q, code in zip(ids.tolist(), queries, codes):
        want, reach = min(k, len(index.ids) - (qid in own)), radius
        while True:
            rows = index.within(code, probe_masks(reach // index.parts), reach)
            rows = rows[index.ids[rows] != qid]
            if len(rows) >= want or reach >= bits:
                break
            reach = min(bits, reach + index.parts)
        if not len(rows):
            continue
        near = index.units[rows] @ (q / np.linalg.norm(q))
        if len(rows) > k:
            bar = np.partition(near, len(near) - k)[len(near) - k] - 1e-9
            rows = rows[near >= bar]
        exact = exact_cosines(q, index.vectors[rows])
        order = np.lexsort((index.ids[rows], -exact))[:k]
        out.extend((qid, int(i), float(s)) for i, s in zip(index.ids[rows][order], exact[order]))
    return out


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = BITS, radius: int = RADIUS, block: int = BLOCK, ask: int = ASK,
    sample: int = SAMPLE, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, <key>, score): the `k` nearest rows found for every query, by cosine.

    Rotations are fitted on at most `sample` vectors and SAMPLE_BYTES, those first by a hash of
    their key. All
    vectors are indexed, in blocks of about `block` rows by a hash of the key; every block of
    `ask` queries meets every block of the index once. Each pair of blocks looks codes up by
    substrings (`Index.within`) and hands on at most `k` rows per query, so what is shuffled
    are the blocks and k rows per query and block.

    Vectors that are null, zero or hold a null or non-finite component take no part, and
    neither does a pair of different lengths: vectors of each length are an index of their
    own, LENGTHS at most, or a ValueError. Rows with one key count once, the smallest vector
    of them; a query never finds its own key. With fewer than `k` candidates all are returned,
    and an empty table gives no rows.
    """
    rows = settle(usable(vectors, key, vector).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    lengths = [r.d for r in rows.select(F.size("v").alias("d")).distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    asked = usable(queries, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    out = vectors.sparkSession.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    for dim in sorted(lengths):
        same = F.size("v") == dim
        out = out.unionByName(_nearest_of(rows.where(same), asked.where(same), dim, k, bits, radius, block, ask, sample, key))
    return out


def _nearest_of(rows: DataFrame, asked: DataFrame, dim: int, k: int, bits: int, radius: int, block: int, ask: int, sample: int, key: str) -> DataFrame:
    """`nearest` over (id, v) of one length."""
    fit = rows.orderBy(F.xxhash64("id"), "id").limit(min(sample, SAMPLE_BYTES // (8 * max(dim, 1)))).select("v").toPandas()
    rotations = learn_rotations(stacked(fit["v"]), bits)
    # The cells: how many blocks there are follows from the counts alone.
    n_blocks, n_asks = -(-rows.count() // block), max(1, -(-asked.count() // ask))
    index = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))
    probes = asked.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(n_asks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            held = Index(left["id"].to_numpy(), stacked(left["v"]), rotations)
            found = search_block(held, right["id"].to_numpy(), stacked(right["v"]), rotations, radius, k)
        return pd.DataFrame(found, columns=["query_id", "id", "score"])

    cells = index.groupBy("a", "b").cogroup(probes.groupBy("a", "b")).applyInPandas(meet, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("id").alias(key), "score")

"""Near-duplicate texts by circulant MinHash, banding, exact Jaccard and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from playmetry.llm.common import join_hot, mix64, run_hashes, settle, word_hashes

#: Words of a shingle.
SHINGLE = 5
#: Bands and coordinates in a band. At a similarity of 0.85 all bands miss with odds of 2e-8,
#: at 0.8 of 3e-6.
BANDS, ROWS = 24, 4


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; A-Z are lower-cased, words as elsewhere.

    A text with fewer than `n` words is one shingle; one without words has none.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(run_hashes(hashes, min(n, len(words))))


def permuted(x: np.ndarray, c1: int, c2: int) -> np.ndarray:
    """A permutation of the 32-bit numbers: xor-shifts and odd factors can all be undone."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(c1)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(c2)
    return x ^ (x >> np.uint32(16))


def circulant_signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """`size` MinHash coordinates of a set, from two permutations.

    The first one places every shingle on the circle of 2**32 positions. The second one gives
    the order of the positions; coordinate k is the least order after a turn of the circle by k.
    """
    places = permuted((shingles >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    least = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    turns = np.arange(size, dtype=np.uint32)[:, None]
    for at in range(0, len(places), 512):
        block = permuted(places[None, at : at + 512] + turns, 0x21F0AAAD, 0xD35A2D97)
        np.minimum(least, block.min(axis=1), out=least)
    return least


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, made of the band's number and its coordinates."""
    parts = signature.reshape(bands, rows).astype(np.uint64)
    key = mix64(np.arange(1, bands + 1, dtype=np.uint64))
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, r])
    return key


def signatures(docs: DataFrame, key: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, n_shingles, same (hash of the whole set; null for none), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            keys = [band_keys(circulant_signature(s, bands * rows), bands, rows).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))),
                ],
                names=["id", "n_shingles", "same", "bands"],
            )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_shingles long, same binary, bands array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, text) to (id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))],
                names=["id", "shingles"],
            )

    return texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return pairs.join(left, "a").join(right, "b").where(100 * common >= percent * union).select("a", "b")


def possible(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may still link, from (id, component, shingles).

    No link is lost: order all shingles from the rarest; a link needs so large an
    intersection that the first shingle both sets share stands near the front of both. So
    only the front of each set is looked up, and a pair counts where the shingles after that
    place still suffice. Shingles that an edit made are rare and come first, which is why
    members of a large group of copies that differ too much rarely meet.
    """
    n = F.size("shingles")
    each = rest.select("id", "component", n.alias("n"), F.explode("shingles").alias("shingle"))
    counted = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"))
    fronts = (
        join_hot(each, counted, ["shingle"])
        .groupBy("id", "component", "n")
        .agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("all"))
        .select("id", "component", "n", F.posexplode(F.slice("all", F.lit(1), F.expr(f"n - cast((n * {percent} + 99) div 100 as int) + 1"))).alias("at", "s"))
        .select("id", "component", "n", (F.col("at") + 1).alias("at"), F.col("s.shingle").alias("shingle"))
    )
    fronts = settle(fronts, "fronts")
    across = fronts.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    shared = settle(fronts.join(across, "shingle", "left_semi"), "shared")
    x, y = shared.alias("x"), shared.alias("y")
    left = 1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    meet = (
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
        & ((100 + percent) * left >= percent * (F.col("x.n") + F.col("y.n")))
    )
    return x.join(y, meet).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in `edges` (a, b).

    Each round takes the least label among neighbours and then the label's own label, so
    the number of rounds grows with the logarithm of the longest chain. Rounds end at files
    in the shared folder; only a count of changes comes to the driver.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        parents = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        moved = settle(hooked.join(parents, "label", "left").select("id", "old", F.least("label", "up").alias("label")), "labels")
        changed = moved.where("label != old").limit(1).count()
        labels = moved.select("id", "label")
        if not changed:
            return labels.select("id", F.col("label").alias("component"))


def near_copies(
    docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable over links), kept.

    Texts link when 100 * |A and B| >= percent * |A or B| over their shingle sets. Sets equal
    as a whole are one node from the start, so a group of copies costs one row. Candidates
    share a band. First every member of a band's bucket meets its smallest and its largest
    member; what that links becomes components. Buckets with several components are looked at
    again, by an exact search for links between components (`possible`). All links are
    confirmed on the full sets. Nothing is capped or sampled.

    A null key takes no part (component null, kept); null texts and texts without words are
    alone. Rows with one key are one node; equal rows get equal results.
    """
    looked = settle(signatures(docs, key, text, shingle, bands, rows), "signatures")
    usable = looked.where(F.col("id").isNotNull() & F.col("same").isNotNull())
    nodes = settle(usable.groupBy("same").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    entries = nodes.select("id", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    member = settle(join_hot(entries, buckets, ["band"]), "members")
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))  # noqa: E731  a bound on the similarity
    size = nodes.select("id", "n")

    def sized(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
            .join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
            .where(fits(F.col("na"), F.col("nb")))
            .select("a", "b")
        )

    stars = member.select(F.col("low").alias("a"), F.col("id").alias("b")).union(member.select(F.col("id").alias("a"), F.col("high").alias("b")))
    stars = settle(sized(stars.where("a < b").distinct()), "stars")
    # Sets are kept for members of buckets alone, since all pairs come from these.
    inside = member.select("id").distinct()
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sets = settle(shingle_sets(texts.join(inside, "id"), shingle).dropDuplicates(["id"]), "sets")
    first = settle(linked(stars, sets, percent), "links")
    found = components(first)
    part = member.join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    mixed = part.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    apart = part.join(mixed, "band", "left_semi").select("id", "component").distinct()
    rest = settle(sets.join(apart, "id"), "rest")
    later = possible(rest, percent).join(stars, ["a", "b"], "left_anti")
    second = linked(later, sets, percent)
    final = components(first.union(second))
    of_set = nodes.select("same", "id").join(final, "id", "left").select("same", F.coalesce("component", "id").alias("component"))
    return join_hot(looked.drop("bands"), of_set, ["same"], "left").select(
        F.col("id").alias(key),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )

"""Sharding by minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetry.llm.common import settle
from playmetry.scale import ordered_positions

#: Hex digits of a group's key that the first look and every closer look tell apart.
FIRST_DIGITS, MORE_DIGITS = 3, 2


@dataclass
class Stretch:
    """Groups whose keys share a beginning: total size and number of groups."""

    prefix: str
    size: int
    groups: int


class Order:
    """Sizes of all groups in the order of their keys, in stretches, as fine as was asked for.

    The driver holds 16**FIRST_DIGITS stretches at first, and 16**MORE_DIGITS more for each
    one that a cut may fall into; never a row per group of the whole corpus.
    """

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.stretches = self._look([], FIRST_DIGITS)
        self.largest = groups.agg(F.max("w")).first()[0] or 0

    def _look(self, prefixes: list[str], digits: int) -> list[Stretch]:
        rows = self.groups
        if prefixes:
            rows = rows.where(F.substring("g", 1, len(prefixes[0])).isin(prefixes))
        found = rows.groupBy(F.substring("g", 1, digits).alias("p")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        return [Stretch(r.p, r.w, r.n) for r in sorted(found, key=lambda r: r.p)]

    def refine(self, places: set[int]) -> None:
        """Split the stretches at these places that hold more than one group."""
        by_length: dict[int, list[str]] = {}
        for i in places:
            if self.stretches[i].groups > 1:
                by_length.setdefault(len(self.stretches[i].prefix), []).append(self.stretches[i].prefix)
        finer = {}
        for length, prefixes in by_length.items():
            for s in self._look(prefixes, min(length + MORE_DIGITS, 32)):
                finer.setdefault(s.prefix[:length], []).append(s)
        self.stretches = [x for s in self.stretches for x in finer.get(s.prefix, [s])]

    def walk(self, capacity: int, split: bool) -> tuple[int, list[int]]:
        """Shards that greedy filling needs, and the stretch at which each new one begins.

        `split`: a stretch of several groups may be cut anywhere (a bound from below);
        otherwise a stretch stays whole if it fits a shard at all (a bound from above).
        """
        ends = np.cumsum([s.size for s in self.stretches])
        cuts, start, total = [], 0, int(ends[-1]) if len(ends) else 0
        while start + capacity < total:
            i = int(np.searchsorted(ends, start + capacity, side="right"))
            before = int(ends[i - 1]) if i else 0
            if split and self.stretches[i].groups > 1:
                start = start + capacity
            elif before > start:
                start = before
            else:
                start = start + capacity  # larger than a shard: only a closer look can tell
            cuts.append(i)
        return len(cuts) + 1, cuts


def smallest_capacity(order: Order, shards: int) -> tuple[int, list[str]]:
    """The least capacity that `shards` contiguous runs of whole groups need, and each later run's first key.

    Binary search brackets it from both sides on the stretches known so far; stretches that a
    cut may fall into are looked at more closely, until both sides agree and every cut lies
    between two groups.
    """
    total = sum(s.size for s in order.stretches)
    if not total:
        return 0, []
    least = max(-(-total // shards), order.largest)

    def search(low: int, split: bool) -> int:
        high = total
        while low < high:
            middle = (low + high) // 2
            if order.walk(middle, split)[0] <= shards:
                high = middle
            else:
                low = middle + 1
        return low

    while True:
        coarse = max([least, *(s.size for s in order.stretches)])
        low, high = search(least, True), search(coarse, False)
        if low == high:
            cuts = order.walk(low, False)[1]
            open_cuts = {i for i in cuts if order.stretches[i].groups > 1}
            if not open_cuts:
                return low, [order.stretches[i].prefix for i in cuts]
        near = set()
        for capacity in {low, high}:
            a, b = order.walk(capacity, True)[1], order.walk(capacity, False)[1]
            for k in range(max(len(a), len(b))):
                x, y = a[min(k, len(a) - 1)] if a else 0, b[min(k, len(b) - 1)] if b else 0
                near.update(range(min(x, y), max(x, y) + 1))
        first, last = order.walk(low, False)[1], order.walk(high, True)[1]
        for x, y in zip(first, last):
            near.update(range(min(x, y), max(x, y) + 1))
        near.update(i for i, s in enumerate(order.stretches) if s.groups > 1 and s.size > low)
        order.refine({i for i in near if order.stretches[i].groups > 1})


def shard_texts(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: sizes are UTF-8 bytes plus 1, equal texts stay together, and the largest
    shard is as small as contiguous runs of groups in the order of their MD5 allow. A group is
    atomic, so one of a third of all bytes makes its shard that large. Slots count the rows of
    a shard from 0, in the order of a hash of the row. A null text has size 1, a null checksum
    and is a group of its own; an empty table gives no rows. `grown_shard` is null under this law.
    """
    group = F.coalesce(F.md5(F.col(text)), F.md5(F.concat(F.lit("\x00"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    rows = settle(
        docs.select(F.col(key), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), group.alias("g")),
        "sizes",
    )
    groups = settle(rows.groupBy("g").agg(F.sum("size").alias("w")), "groups")
    _, firsts = smallest_capacity(Order(groups), shards)
    shard = F.lit(0)
    for i, prefix in enumerate(firsts, 1):
        shard = F.when(F.col("g") >= prefix, F.lit(i)).otherwise(shard)
    placed = rows.withColumn("shard", shard).withColumn("__h", F.xxhash64(key, "g", "size"))
    numbered = ordered_positions(
        placed, ["shard"], F.shiftrightunsigned("__h", 52), [F.col("__h"), F.col(key), F.col("g")], "slot",
        fine=F.shiftrightunsigned("__h", 40).bitwiseAND(F.lit(0xFFF)),
    )
    return numbered.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

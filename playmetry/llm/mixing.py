"""Mixing sources to target weights by entropy balancing. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playmetry.llm.common import WORD_PATTERN, join_hot, settle
from playmetry.scale import ordered_positions

#: Copies that a document may get at most.
MOST = 2.0
#: Size classes for every doubling of a size; sizes under 64 are classes of their own. So a
#: source has fewer than 64 + 64 * 58 classes, whatever its number of documents.
STEPS = 64


def source_key(source: str) -> Column:
    """A key that is never null, one for each source and one for none."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, most: float = MOST) -> DataFrame:
    """(src, source, source_size) plus weight and target: words that each source should give.

    Sources by code point, null last, weigh `weights` in turn and share `share` times all
    words. A target stops at `most` times its source's size and the excess is reshared by
    weight until none is above: that is min(most * size, level * weight) at the one level
    where the targets add up, found by taking sources in the order of size over weight (past the
    first source that stays under its stop, the formula only falls). The windows hold one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    stops = weighed.withColumn("__level", level).withColumn("__open", most * F.col("source_size") >= F.col("__level") * F.col("weight"))
    reached = F.max(F.when(F.col("__open"), F.col("__level"))).over(everything)
    return stops.withColumn("target", F.least(most * F.col("source_size"), F.coalesce(reached * F.col("weight"), most * F.col("source_size")))).select(
        "src", "source", "source_size", "weight", "target"
    )


def rate(tilt: Column, most: float = MOST) -> Column:
    """Expected copies under a tilt: exp(tilt) / (1 + exp(tilt)) of `most`, one copy at no tilt."""
    return F.lit(most) / (1 + F.exp(-tilt))


def balanced(classes: DataFrame, targets: DataFrame, most: float = MOST, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """(src, lam): the dual variable of every source, by guarded Newton steps.

    Copies r of a document with s words minimise the sum of sqrt(s) * h(r), where h is the
    relative entropy of r between 0 and `most` against one copy, under one constraint per
    source: the sum of s * r is its target. The minimum has r = most / (1 + exp(-lam * sqrt(s))),
    so odds are tilted exponentially, and its dual in `lam` is convex, with one variable per
    source. The base weight sqrt(s) keeps long documents from carrying the whole change.

    Each step sums value and slope over the table of (source, size, count) and moves every
    source at once; a step that leaves the bracket of signs seen so far halves it instead.
    Three steps go between files in the shared folder. A target at an end of its range
    needs no variable: all copies or none.
    """
    root = F.sqrt(F.col("size").cast("double"))
    between = targets.where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))).select(
        "src", "target", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("off")
    )
    state = settle(between.coalesce(1), "dual")
    work = settle(classes.where("size > 0").select("src", "size", "n").join(between.select("src"), "src", "left_semi"), "classes")
    for step in range(1, rounds + 1):
        r = rate(F.col("lam") * root, most)
        sums = (
            work.join(state.select("src", "lam"), "src")
            .groupBy("src")
            .agg(F.sum(F.col("n") * F.col("size") * r).alias("value"), F.sum(F.col("n") * F.col("size") * root * r * (1 - r / most)).alias("slope"))
        )
        now = state.join(sums, "src").withColumn("gap", F.col("value") - F.col("target"))
        now = now.withColumn("low", F.when(F.col("gap") <= 0, F.greatest("low", "lam")).otherwise(F.col("low"))).withColumn(
            "high", F.when(F.col("gap") >= 0, F.least("high", "lam")).otherwise(F.col("high"))
        )
        newton = F.col("lam") - F.col("gap") / F.col("slope")
        inside = F.col("slope").isNotNull() & (F.col("slope") > 0) & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        halved = (F.col("low") + F.col("high")) / 2
        outward = F.when(F.col("high").isNull(), 2 * F.col("low") + 1).otherwise(2 * F.col("high") - 1)
        state = now.select(
            "src", "target",
            F.when(F.col("gap") == 0, F.col("lam")).when(inside, newton).otherwise(F.coalesce(halved, outward)).alias("lam"),
            "low", "high", F.abs(F.col("gap") / F.col("target")).alias("off"),
        )
        if step % 3 == 0:
            state = settle(state.coalesce(1), "dual")
            if not state.where(F.col("off") > tolerance).limit(1).count():
                break
    return state.select("src", "lam")


def class_of(size: Column) -> Column:
    return F.when(size < 64, size).otherwise(64 + F.floor(STEPS * (F.log2(size.cast("double")) - 6))).cast("int")


def allotted(rated: DataFrame, most: float = MOST) -> DataFrame:
    """(src, cls, copies, docs): whole copies for every size class, rounding errors carried along.

    `rated` has (src, size, n, r). Classes of a source go from the largest sizes to the
    smallest; what rounding leaves over of a class's words is handed to the next, so the
    source ends within about half of its shortest documents. An array of a source's classes
    has fewer than 64 + 64 * 58 entries.
    """
    per_class = rated.groupBy("src", class_of(F.col("size")).alias("cls")).agg(
        F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("words"), F.sum(F.col("n") * F.col("size") * F.col("r")).alias("wish")
    )
    ordered = per_class.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("cls", "docs", "words", "wish")), asc=False).alias("rows"))
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<cls:int,docs:bigint,copies:bigint>>").alias("done"))

    def add(acc: Column, row: Column) -> Column:
        mean = row["words"] / row["docs"]
        want = row["wish"] + acc["left"]
        copies = F.least(F.greatest(F.round(want / mean), F.lit(0.0)), F.lit(most) * row["docs"])
        return F.struct(
            (want - copies * mean).alias("left"),
            F.concat(acc["done"], F.array(F.struct(row["cls"].alias("cls"), row["docs"].alias("docs"), copies.cast("bigint").alias("copies")))).alias("done"),
        )

    return ordered.select("src", F.explode(F.aggregate("rows", start, add, lambda acc: acc["done"])).alias("d")).select("src", "d.cls", "d.docs", "d.copies")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, seed: int = 5, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: key, size, source_size, target, copies, taken.

    Size is the number of words, 0 for a null text. `copies` is 0, 1 or 2 and `taken` is
    copies * size. Sources of any name mix, null among them; empty documents get one copy of
    nothing. Within a size class the rows that get one copy more are those first by a hash of
    seed, key and size, so reruns agree and equal rows may differ; the class's count is kept.
    A source with a third of all rows is spread over its size classes and their hash buckets.
    """
    count = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = settle(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), source_key(source).alias("src"), count.alias("size")), "sizes")
    classes = settle(rows.groupBy("src", "source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    totals = classes.groupBy("src", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = settle(source_targets(totals, weights, share).coalesce(1), "targets")
    dual = balanced(classes, targets)
    goal = targets.join(dual, "src", "left")
    whole = F.when(F.col("lam").isNotNull(), rate(F.col("lam") * F.sqrt(F.col("size").cast("double")))).when(F.col("target") > 0, F.lit(MOST)).otherwise(F.lit(0.0))
    rated = classes.where("size > 0").join(goal.select("src", "lam", "target"), "src").select("src", "size", "n", whole.alias("r"))
    given = allotted(rated)
    hashed = rows.withColumn("cls", class_of(F.col("size"))).withColumn("__h", F.xxhash64(F.lit(seed), "id", "size"))
    ranked = ordered_positions(
        hashed, ["src", "cls"], F.shiftrightunsigned("__h", 52), [F.col("__h"), F.col("id")], "place", fine=F.shiftrightunsigned("__h", 40).bitwiseAND(F.lit(0xFFF))
    )
    even = F.floor(F.col("copies") / F.col("docs"))
    more = (F.col("place") <= F.col("copies") - even * F.col("docs")).cast("long")
    out = join_hot(ranked, given, ["src", "cls"], "left").join(targets.select("src", "source_size", "target"), "src")
    copies = F.when(F.col("size") > 0, even + more).otherwise(1).cast("long")
    return out.select(F.col("id").alias(key), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

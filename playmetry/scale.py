"""Building blocks that stay whole and balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `on` that also matches NULL keys; keeps the left copy of the keys."""
    renamed = right.select(
        *[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns]
    )
    if not on:
        condition = F.lit(True)
    else:
        condition = reduce(
            lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__{c}"]) for c in on]
        )
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__{c}" for c in on]) if how not in ("left_semi", "left_anti") else joined


def ordered_positions(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Column,
    order: Sequence[Column],
    out: str = "position",
    fine: Column | None = None,
) -> DataFrame:
    """1-based position of every row within `keys`, without one task per key.

    `coarse` (and `fine` inside it) are ascending buckets of the ordering: rows of a
    lower bucket come first. Only bucket counts are summed per key; the rows
    themselves are numbered per (key, bucket), so a key with a third of all rows is
    spread over its buckets.
    """
    buckets = ["__coarse", "__fine"] if fine is not None else ["__coarse"]
    marked = df.withColumn("__coarse", coarse)
    if fine is not None:
        marked = marked.withColumn("__fine", fine)
    counts = marked.groupBy(*keys, *buckets).agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.unboundedPreceding, -1)
    if fine is None:
        offsets = counts.select(
            *keys,
            "__coarse",
            F.coalesce(
                F.sum("__n").over(Window.partitionBy(*keys).orderBy("__coarse").rowsBetween(*before)),
                F.lit(0),
            ).alias("__offset"),
        )
    else:
        inner = counts.withColumn(
            "__inner",
            F.coalesce(
                F.sum("__n").over(
                    Window.partitionBy(*keys, "__coarse").orderBy("__fine").rowsBetween(*before)
                ),
                F.lit(0),
            ),
        )
        outer = (
            counts.groupBy(*keys, "__coarse")
            .agg(F.sum("__n").alias("__n"))
            .select(
                *keys,
                "__coarse",
                F.coalesce(
                    F.sum("__n").over(
                        Window.partitionBy(*keys).orderBy("__coarse").rowsBetween(*before)
                    ),
                    F.lit(0),
                ).alias("__outer"),
            )
        )
        offsets = null_safe_join(inner, outer, [*keys, "__coarse"]).select(
            *keys, *buckets, (F.col("__inner") + F.col("__outer")).alias("__offset")
        )
    numbered = marked.withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*keys, *buckets).orderBy(*order))
    )
    return (
        null_safe_join(numbered, offsets, [*keys, *buckets])
        .withColumn(out, F.col("__rn") + F.col("__offset"))
        .drop("__rn", "__offset", *buckets)
    )


def moment(df: DataFrame, ts: str, unique: str) -> Column:
    """Total order by time, equal times by `unique`.

    First and last by a struct would make Spark sort every task's rows before it can
    combine them; a number made of time and a whole-number key keeps `min_by` and `max_by`
    in the hash aggregate. Keys of other kinds need the struct.
    """
    if not isinstance(df.schema[unique].dataType, IntegralType):
        return F.struct(F.col(ts), F.col(unique))
    micros = F.unix_micros(F.col(ts)).cast("decimal(18,0)")
    return micros * F.lit(Decimal(10**19)) + F.col(unique).cast("decimal(19,0)")


#: Fine buckets of a coarse one.
FINE = 4096


def value_buckets(value: str) -> tuple[Column, Column]:
    """Two levels of ascending buckets of a double: a 64th of a doubling, and FINE parts of it."""
    steps = F.log2(F.abs(value)) * 64
    sign, zero = F.signum(value), F.col(value) == 0
    coarse = F.when(zero, F.lit(0)).otherwise(sign * (F.floor(steps) + 100_000)).cast("long")
    fine = F.when(zero, F.lit(0)).otherwise(sign * F.floor((steps - F.floor(steps)) * FINE)).cast("long")
    return coarse, fine


def values_at_ranks(counted: DataFrame, keys: Sequence[str], value: str, n: str, ranks: DataFrame) -> DataFrame:
    """(keys, name, value): the value at every asked rank of a key's values in order.

    `counted` has distinct values with their counts `n`; `ranks` has (keys, name, rank), ranks
    from 0, and a few names per key, all in `names`. Coarse buckets are summed per key, fine
    ones inside the coarse buckets that hold an asked rank, and single values inside fine
    ones, so no task orders more than the buckets of a key or the values of a fine bucket.
    """
    coarse, fine = value_buckets("__v")
    rows = counted.select(*keys, F.col(value).cast("double").alias("__v"), F.col(n).alias("__n"))
    source = rows.withColumn("__coarse", coarse).withColumn("__fine", fine)
    found, held = ranks.select(*keys, "name", "rank"), list(keys)
    for level in ("__coarse", "__fine", "__v"):
        if level != "__coarse":
            source = null_safe_join(source, found.select(*held).distinct(), held, "left_semi")
        sums = source.groupBy(*held, level).agg(F.sum("__n").alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy(*held).orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
        spans = sums.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__n"))
        # A key has a few asked ranks, and they meet its buckets as one list.
        asked = found.groupBy(*held).agg(F.collect_list(F.struct("name", "rank")).alias("__asked"))
        met = null_safe_join(spans, asked, held).withColumn(
            "__hits", F.filter("__asked", lambda a: (a["rank"] >= F.col("__from")) & (a["rank"] < F.col("__to")))
        )
        held = [*held, level]
        hits = met.where(F.size("__hits") > 0).select(*held, "__from", F.explode("__hits").alias("__hit"))
        found = hits.select(*held, F.col("__hit.name").alias("name"), (F.col("__hit.rank") - F.col("__from")).alias("rank"))
    return found.select(*keys, "name", F.col("__v").alias("value"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
) -> DataFrame:
    """Exact linearly interpolated quantiles per key: one row per key, one column per name.

    Values are counted first, then only counts are summed in order (`values_at_ranks`), so
    no group's values meet in one task.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__value"))
        .agg(F.count(F.lit(1)).alias("__count"))
    )
    totals = counted.groupBy(*keys).agg(F.sum("__count").alias("__total"))
    # Ranks are 0-based; each quantile needs the values at floor and floor + 1.
    place = lambda p: F.lit(float(p)) * (F.col("__total") - 1)
    wanted = [
        F.struct(F.lit(f"{name}{side}").alias("name"), F.least(F.floor(place(p)) + k, F.col("__total") - 1).alias("rank"))
        for name, p in probs.items()
        for k, side in enumerate(("<", ">"))
    ]
    ranks = totals.select(*keys, F.explode(F.array(*wanted)).alias("__w")).select(*keys, "__w.name", "__w.rank")
    names = [f"{name}{side}" for name in probs for side in "<>"]
    found = values_at_ranks(counted, keys, "__value", "__count", ranks)
    both = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"__{n}") for n in names])

    def between(name: str, p: float) -> Column:
        low, high, part = F.col(f"`__{name}<`"), F.col(f"`__{name}>`"), place(p) - F.floor(place(p))
        return (low + F.when(part > 0, (high - low) * part).otherwise(F.lit(0.0))).alias(name)

    return null_safe_join(both, totals, keys).select(*keys, *[between(name, p) for name, p in probs.items()])

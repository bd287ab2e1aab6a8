"""Keyed writes on plain files, and the two fixed dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playmetry.functions import vocab
from playmetry.functions.ids import date_key


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. The rank limit runs before the shuffle, so copies of a
    hot key are dropped where they are read."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("__rn = 1").drop("__rn")


def insert_ignore(
    new: DataFrame, existing: DataFrame, key: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Rows to append: keys not yet stored, first copy within the batch."""
    return first_per_key(new, key, order).join(existing.select(*key), list(key), "left_anti")


def upsert_replace(
    new: DataFrame, existing: DataFrame, key: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """The table after the batch: a new row replaces the stored one of its key."""
    latest = first_per_key(new, key, order)
    kept = existing.join(latest.select(*key), list(key), "left_anti")
    return kept.unionByName(latest.select(*existing.columns))


def overwrite_partition(df: DataFrame, path: str, date_col: str, fmt: str = "parquet") -> None:
    """Replace exactly the dates present in `df`; a rerun gives the same table."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(date_col).format(fmt).save(path)


def recompute_dates(df: DataFrame, ts_col: str) -> DataFrame:
    """Event dates a batch touches: the partitions to rebuild after late events."""
    return df.select(F.to_date(ts_col).alias("date")).distinct()


def build_dim_date(spark: SparkSession, start: str = "2024-01-01", end: str = "2030-12-31") -> DataFrame:
    """Calendar with ISO week and Monday = 0."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date")
    )
    return calendar_columns(days)


def calendar_columns(days: DataFrame) -> DataFrame:
    """Calendar attributes of a `full_date` column."""
    d = F.col("full_date")
    return days.select(
        date_key(d).alias("date_key"),
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.weekofyear(d).alias("week_of_year"),
        F.dayofmonth(d).alias("day_of_month"),
        F.weekday(d).alias("day_of_week"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "EEEE").alias("day_name"),
    )


def build_dim_difficulty(spark: SparkSession) -> DataFrame:
    """The six fixed levels."""
    return spark.createDataFrame(
        [(*level, True) for level in vocab.DIFFICULTY_LEVELS],
        "difficulty_key string, display_name string, sort_order int, min_clues int, "
        "max_clues int, is_active boolean",
    )

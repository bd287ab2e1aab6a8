"""Data-quality gates: each check is one row (check, column, failed, passed, severity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class QualityError(ValueError):
    """Raised once with every failed check."""


def _check(name: str, column: str, failed: Column, severity: str = "error") -> list[Column]:
    count = failed.cast("long")
    return [
        F.lit(name).alias("check"),
        F.lit(column).alias("column"),
        count.alias("n_failed"),
        (count == 0).alias("passed"),
        F.lit(severity).alias("severity"),
    ]


def expect_not_null(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_if(F.col(col).isNull()).alias("n")).select(
        *_check("not_null", col, F.col("n"))
    )


def bad_values(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """Values outside the allowed set, with counts."""
    return (
        df.where(F.col(col).isNotNull() & ~F.col(col).isin(allowed))
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def expect_in_set(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    bad = F.count_if(F.col(col).isNotNull() & ~F.col(col).isin(allowed))
    return df.agg(bad.alias("n")).select(*_check("in_set", col, F.col("n")))


def expect_non_negative(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_if(F.col(col) < 0).alias("n")).select(
        *_check("non_negative", col, F.col("n"))
    )


def expect_unique(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Number of keys that appear more than once."""
    keys = [key] if isinstance(key, str) else key
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return dup.agg(F.count(F.lit(1)).alias("n")).select(*_check("unique", "+".join(keys), F.col("n")))


def expect_rows_for_date(df: DataFrame, date_col: str, value) -> DataFrame:
    """A warning, not an error, when a date has no rows."""
    found = df.where(F.col(date_col) == F.lit(value)).agg(F.count(F.lit(1)).alias("n"))
    return found.select(
        *_check("rows_for_date", date_col, F.when(F.col("n") == 0, 1).otherwise(0), "warning")
    )


def expect_coverage(df: DataFrame, col: str, minimum: float = 0.80) -> DataFrame:
    """Share of rows with a value; an empty table is skipped (passes)."""
    return (
        df.agg(F.count(col).alias("have"), F.count(F.lit(1)).alias("total"))
        .withColumn("coverage", F.col("have") / F.nullif(F.col("total"), F.lit(0)))
        .select(
            *_check(
                "coverage",
                col,
                F.when(F.coalesce(F.col("coverage"), F.lit(1.0)) < minimum, 1).otherwise(0),
            ),
            F.coalesce(F.col("coverage"), F.lit(1.0)).alias("coverage"),
        )
    )


def expect_tables(spark: SparkSession, expected: list[str], present: dict[str, DataFrame]) -> DataFrame:
    """One row per expected table: whether it is there, and its row count."""
    rows = [
        (
            present[name].agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table_name"), F.lit(True).alias("present"), "n_rows"
            )
            if name in present
            else spark.range(1).select(
                F.lit(name).alias("table_name"),
                F.lit(False).alias("present"),
                F.lit(0).cast("long").alias("n_rows"),
            )
        )
        for name in expected
    ]
    return reduce(DataFrame.unionByName, rows)


def run_suite(checks: list[DataFrame]) -> DataFrame:
    """All checks in one report."""
    columns = ["check", "column", "n_failed", "passed", "severity"]
    return reduce(DataFrame.unionByName, [c.select(*columns) for c in checks])


def raise_on_failure(report: DataFrame) -> None:
    """Raise once, naming every failed error check. The report has one row per check."""
    failed = report.where("NOT passed AND severity = 'error'").orderBy("check", "column").collect()
    if failed:
        lines = [f"  - {r['check']}({r['column']}): {r['n_failed']}" for r in failed]
        raise QualityError(f"{len(failed)} check(s) failed:\n" + "\n".join(lines))

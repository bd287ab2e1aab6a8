"""Registered queries: each runs an operator over the provided tables, with SQL where it has an equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playmetry.plans.oracle import with_views
from playmetry.session import use_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles at a few digits and without a negative zero, so engines can be compared."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def register(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register a query. `doubles` names the floating columns of its SQL, kept to `digits`."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(use_settings(spark), folder), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            text = sql
            if doubles:
                swaps = ", ".join(
                    f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0 AS "{c}"' for c in doubles.split()
                )
                text = f"SELECT * REPLACE ({swaps}) FROM ({sql}) AS result"
            ORACLES[name] = with_views(text)
        return fn

    return add

"""Helpers that several operators share: words, hashes, scratch tables, joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from xxhash import xxh3_64_intdigest

#: Words of every operator: runs of characters other than the six ASCII white spaces.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows and bytes in one Arrow batch; a worker holds one batch of whole texts at a time (one text, if it is longer).
BATCH_ROWS, BATCH_BYTES = 512, 64 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Only a local session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    own = "file://" + tempfile.mkdtemp(prefix="llm-scratch-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends at files that outlive executors."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: bounded Arrow batches, time zone, adaptive plans."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def unused(name: str, columns: Sequence[str]) -> str:
    """A name that none of `columns` has, whatever its case: `name` with underscores as needed."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes; `bytes.split` cuts at exactly the six ASCII white spaces."""
    return text.encode("utf-8", "replace").split() if text else []


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """One hash for every run of `n` consecutive values, in log2(n) passes."""
    total = len(values) - n + 1
    if total <= 0:
        return values[:0]
    out, covered, power, width = None, 0, values, 1
    while True:
        if n & width:
            if out is None:
                out = mix64(power + np.uint64(width))
            else:
                m = min(len(out), len(power) - covered)
                out = mix64(out[:m] * GOLDEN + power[covered : covered + m])
            covered += width
        if covered == n:
            return out[:total]
        power = mix64(power[:-width] * GOLDEN + power[width:] + np.uint64(width))
        width *= 2


def join_hot(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of many rows with one row per key, where one key may hold a third of the left rows.

    `right` is settled first, so both sides of the join come straight from a shuffle and
    adaptive execution splits the tasks of a hot key, repeating only its one right row.
    """
    return left.join(settle(right, "right"), list(on), how)

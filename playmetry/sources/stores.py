"""Tables that are written more than once: late and repeated batches, keyed upserts, counted appends."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from playmetry.sources.tables import first_per_key, overwrite_partition, recompute_dates, upsert_replace


class DailyTable:
    """A table by event date that is right after late, repeated and interrupted batches.

    Each batch lands under its event dates and its batch id, and then the dates it touches are
    rebuilt from everything landed for them, the first copy of each key kept. A batch that is
    delivered again under its id overwrites its own landing and rebuilds the same dates, or
    does nothing once it is marked as done; a crash at any point is mended by the next
    delivery. Copies of a key under another id are dropped by the rebuild, if they bear the
    same date. Rows without a time belong to no date and are left out.

    Below `path`: `landing` (event_date, batch_id), `table` (event_date) and `done` (one
    marker per batch). A rebuild reads the touched dates alone.
    """

    def __init__(self, path: str, schema: str, key: Sequence[str], ts_col: str):
        self.path, self.schema, self.key, self.ts_col = path.rstrip("/"), schema, list(key), ts_col

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, event_date date").parquet(f"{self.path}/table")

    def is_done(self, spark: SparkSession, batch_id: int) -> bool:
        try:
            return spark.read.schema("batch_id long").parquet(f"{self.path}/done/{batch_id}").count() > 0
        except AnalysisException:
            return False

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Lands a batch and rebuilds the dates it touches."""
        spark = batch.sparkSession
        if self.is_done(spark, batch_id):
            return
        landing = f"{self.path}/landing"
        dated = batch.where(F.col(self.ts_col).isNotNull())
        stamped = dated.withColumn("event_date", F.to_date(self.ts_col)).withColumn("batch_id", F.lit(batch_id).cast("long"))
        writer = stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("event_date", "batch_id").parquet(landing)
        landed = spark.read.schema(f"{self.schema}, event_date date, batch_id long").parquet(landing)
        # One row per date of the batch, so the rebuild prunes its scan to these folders.
        dates = [r["date"] for r in recompute_dates(landed.where(F.col("batch_id") == batch_id), "event_date").collect()]
        if dates:
            order = [F.col(self.ts_col), F.xxhash64(*[c for c in landed.columns if c != "batch_id"])]
            rebuilt = first_per_key(landed.where(F.col("event_date").isin(dates)), self.key, order).drop("batch_id")
            overwrite_partition(rebuilt, f"{self.path}/table", "event_date")
        spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).write.mode("overwrite").parquet(f"{self.path}/done/{batch_id}")

    def stream(self, rows: DataFrame, checkpoint: str):
        """Starts a query that applies every micro-batch under its id."""
        return (
            rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda batch, batch_id: self.apply(batch, batch_id)).start()
        )


class KeyedTable:
    """A table hashed by key into `buckets` folders; an upsert reads and rewrites only those its keys fall into.

    The number of buckets belongs to the table: some hundred MB a folder is a good size. An
    upsert that is interrupted while folders are swapped is completed by running it again.
    """

    BUCKET = "key_bucket"

    def __init__(self, path: str, schema: str, key: Sequence[str], buckets: int):
        self.path, self.schema, self.key, self.buckets = path.rstrip("/"), schema, list(key), buckets

    def _stored(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(f"{self.schema}, {self.BUCKET} int").parquet(self.path)
        except AnalysisException:  # nothing written yet
            return spark.createDataFrame([], f"{self.schema}, {self.BUCKET} int")

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(self.BUCKET)

    def upsert(self, new: DataFrame, order: Sequence[Column]) -> list[int]:
        """Replaces the rows of the keys in `new` (the first by `order` where a key repeats) and
        returns the buckets that were rewritten."""
        spark = new.sparkSession
        placed = new.withColumn(self.BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        touched = sorted(r[0] for r in placed.select(self.BUCKET).distinct().collect())  # at most `buckets`
        if touched:
            stored = self._stored(spark).where(F.col(self.BUCKET).isin(touched))
            after = upsert_replace(placed, stored, [*self.key, self.BUCKET], order)
            overwrite_partition(after.repartition(self.BUCKET), self.path, self.BUCKET)
        return touched


def append_counted(
    rows: DataFrame, stored: DataFrame | None, key: str, date_col: str, ts_col: str, write: Callable[[DataFrame], None]
) -> dict[str, int]:
    """Writes the rows whose key is not stored, the first dated copy of each, and counts while writing.

    Returns inserted, duplicates (of stored rows or within the batch) and skipped (without a
    date). The counts are observed by the write itself, in its last stage, where every task
    counts once however often earlier stages run again: the input is read once. Rows of a key
    are folded on the map side, so a hot key is one row per task.
    """
    dated = F.col(date_col).isNotNull()
    copies = F.struct(*[F.col(c) for c in rows.columns])
    order = F.when(dated, F.struct(F.col(ts_col), F.xxhash64(*rows.columns)))
    folded = rows.groupBy(F.col(key).alias("__key")).agg(
        F.min_by(copies, order).alias("__row"), F.count_if(dated).alias("__dated"), F.count_if(~dated).alias("__undated")
    )
    fresh = F.col("__dated") > 0
    if stored is not None:
        known = stored.select(F.col(key).alias("__key")).distinct().withColumn("__stored", F.lit(True))
        folded = folded.join(known, "__key", "left")
        fresh = fresh & F.col("__stored").isNull()
    seen = Observation("load")
    counted = folded.observe(
        seen,
        F.count_if(fresh).alias("inserted"),
        (F.coalesce(F.sum("__dated"), F.lit(0)) - F.count_if(fresh)).alias("duplicates"),
        F.coalesce(F.sum("__undated"), F.lit(0)).alias("skipped"),
    )
    write(counted.where(fresh).select("__row.*"))
    return {name: int(seen.get.get(name) or 0) for name in ("inserted", "duplicates", "skipped")}

"""Event files, event streams, JSON columns and id lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """`name type` pairs as a schema, without needing a session."""
    pairs = (item.split() for item in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


MATCH_EVENT = _schema(
    "match_id string, room_id string, winner_id string, loser_id string, "
    "winner_elo_before int, winner_elo_after int, loser_elo_before int, loser_elo_after int, "
    "elo_delta int, difficulty string, end_reason string, duration_ms int, "
    "completed_at string, consumed_at string"
)
SESSION_EVENT = _schema(
    "session_id string, user_id string, puzzle_id string, difficulty string, time_elapsed_ms int, "
    "score int, hints_used int, errors_count int, cells_filled int, completed_at string, "
    "anomaly_score double, reconstruction_error double, is_anomalous boolean, enriched_at string"
)
CLIENT_EVENT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.StringType()),
    ]
)
CLIENT_BATCH = _schema("user_id string, device_id string").add("events", T.ArrayType(CLIENT_EVENT))
KINDS = {"matches": MATCH_EVENT, "sessions": SESSION_EVENT}
CORRUPT = "_corrupt_record"


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.globStatus(jvm_path) is not None and len(fs.globStatus(jvm_path)) > 0


def event_lines(lines: DataFrame, kind: str, keep_corrupt: bool = False) -> DataFrame:
    """Typed rows of JSON lines (one text column, `value`). Blank lines vanish, invalid ones
    are dropped or, with `keep_corrupt`, kept in `_corrupt_record`."""
    schema = T.StructType([*KINDS[kind].fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    some = lines.where(F.trim("value") != "")
    rows = some.select(F.from_json("value", schema, options).alias("e")).select("e.*")
    return rows if keep_corrupt else rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_event_jsonl(
    spark: SparkSession, folder: str, kind: str, day: date | str, keep_corrupt: bool = False
) -> DataFrame:
    """`event_lines` of one day's file; an absent file gives no rows."""
    path = f"{folder}/{kind}/{day}.jsonl"
    there = _path_exists(spark, path)
    lines = spark.read.text(path) if there else spark.createDataFrame([], "value string")
    return event_lines(lines, kind, keep_corrupt)


def corrupt_count(rows: DataFrame) -> DataFrame:
    """Good and bad lines of a read with `keep_corrupt`."""
    return rows.agg(
        F.count_if(F.col(CORRUPT).isNull()).alias("good"),
        F.count_if(F.col(CORRUPT).isNotNull()).alias("bad"),
    )


def project_match_events(rows: DataFrame) -> DataFrame:
    """Fixed columns of the match table; times become timestamps; a required field must be there."""
    required = ["match_id", "room_id", "winner_id", "loser_id"]
    return _typed(rows, MATCH_EVENT, ["completed_at", "consumed_at"]).dropna(subset=required)


def project_session_events(rows: DataFrame) -> DataFrame:
    """Fixed columns of the session table; times become timestamps."""
    typed = _typed(rows, SESSION_EVENT, ["completed_at", "enriched_at"])
    return typed.drop("cells_filled").dropna(subset=["session_id", "user_id"])


def _typed(rows: DataFrame, schema: T.StructType, times: list[str]) -> DataFrame:
    def column(field: T.StructField) -> Column:
        source = F.col(field.name) if field.name in rows.columns else F.lit(None)
        if field.name in times:
            return F.try_to_timestamp(source.cast("string")).alias(field.name)
        return source.cast(field.dataType).alias(field.name)

    return rows.select(*[column(f) for f in schema.fields])


def incremental_extract(table: DataFrame, ts_col: str, since=None) -> DataFrame:
    """Rows from `since` on, or all; the predicate reaches the scan."""
    return table if since is None else table.where(F.col(ts_col) >= F.lit(since))


def read_jdbc_since(
    spark: SparkSession, url: str, table: str, ts_col: str, since=None, **options
) -> DataFrame:
    """The same extract from a relational source; the filter is pushed into its query.

    Give `partitionColumn`, `lowerBound`, `upperBound` and `numPartitions` for a parallel read.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    return incremental_extract(reader.options(**options).load(), ts_col, since)


def decode_json_column(df: DataFrame, col: str, schema: str, out: str | None = None) -> DataFrame:
    """JSON text as a typed column; unreadable text becomes NULL."""
    return df.withColumn(out or col, F.from_json(F.col(col), schema))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """`id_list` of a text file."""
    return id_list(spark.read.text(path))


def id_list(lines: DataFrame) -> DataFrame:
    """One id per line of `value`; blanks and lines starting with `#` are ignored."""
    line = F.trim("value")
    return lines.where((line != "") & ~line.startswith("#")).select(line.alias("id"))


def event_stream_source(
    spark: SparkSession, topics: list[str], bootstrap: str, **options
) -> DataFrame:
    """Both topics from the earliest offset, value as bytes (needs the Kafka connector jar)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
        .options(**options)
        .load()
        .select("topic", "key", "value", "timestamp")
    )


def event_file_stream(spark: SparkSession, folder: str, topic: str, **options) -> DataFrame:
    """The same shape from a folder of text files: one event per line."""
    return (
        spark.readStream.format("text")
        .options(**options)
        .load(folder)
        .select(
            F.lit(topic).alias("topic"),
            F.lit(None).cast("binary").alias("key"),
            F.encode("value", "UTF-8").alias("value"),
            F.current_timestamp().alias("timestamp"),
        )
    )


def event_stream_sink(
    df: DataFrame, path: str, checkpoint: str, ts_col: str, fmt: str = "parquet"
):
    """Append a stream to event-date partitions; the checkpoint makes each file count once."""
    return (
        df.withColumn("event_date", F.to_date(ts_col))
        .writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("event_date")
        .trigger(availableNow=True)
        .start()
    )


def expire_event_partitions(spark: SparkSession, folder: str, cutoff: date | str) -> DataFrame:
    """`expired_files` below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return expired_files(found.select("path"), cutoff)


def expired_files(files: DataFrame, cutoff: date | str) -> DataFrame:
    """Of a column `path`, event files named by a date before `cutoff`; other names are left alone."""
    name = F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})\.jsonl$", 1)
    return (
        files.withColumn("date", F.try_to_date(F.nullif(name, F.lit("")), "yyyy-MM-dd"))
        .where(F.col("date") < F.lit(str(cutoff)).cast("date"))
        .select("path", "date")
    )

"""Refresh by polling, by file stream, and windowed counts over streams."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kpiloom.columns import FECHA, N, PEDIDO, TORRE
from kpiloom.config import DB, Profile
from kpiloom.functions.calendar_es import half_month
from kpiloom.operators.clean import clean
from kpiloom.sources.files import CSV_NULL, last_modified, read_delivery
from kpiloom.sources.naming import normalise_columns, require_columns
from kpiloom.sources.snapshot import SnapshotStore

log = logging.getLogger(__name__)

# How often the sources are looked at.
FILE_INTERVAL = "30 seconds"
DATABASE_INTERVAL_S = 60


# --- polling -------------------------------------------------------------------------


def refresh_snapshot(
    store: SnapshotStore, load: Callable[[], DataFrame], profile: Profile = DB, **cleaning
) -> bool:
    """Reload everything and publish it; on failure the last good version stays served.

    Names are normalised and required columns checked, as for every delivery.
    """
    try:
        store.publish(clean(require_columns(normalise_columns(load())), profile, **cleaning))
    except Exception:
        log.exception("refresh failed, keeping the last snapshot")
        return False
    return True


def refresh_if_newer(
    store: SnapshotStore, path: str, load: Callable[[], DataFrame], profile: Profile = DB, seen=None
):
    """Reload only if a file below ``path`` is newer than ``seen``.

    Returns the modification time to pass next time; it moves on success only.
    """
    try:
        newest = last_modified(store.spark, path)
    except Exception:
        log.exception("source not readable, keeping the last snapshot")
        return seen
    if newest is None or (seen is not None and newest <= seen):
        return seen
    return newest if refresh_snapshot(store, load, profile) else seen


# --- file streams --------------------------------------------------------------------


def stream_deliveries(
    spark: SparkSession,
    folder: str,
    file_format: str = "parquet",
    schema: T.StructType | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """The rows delivered to a folder as a stream, with normalised, checked column names.

    Columns are those of the files already there, or of ``schema``. All files must have them:
    CSV headers are compared, not overruled. Deliveries that differ among themselves go through
    ``replace_on_delivery`` or ``append_deltas``, which read each file by its own header.
    """
    if schema is None:
        # The headers only: text for CSV, the files' own types for Parquet.
        options = {"header": "true"} if file_format == "csv" else {}
        schema = spark.read.format(file_format).options(**options).load(folder).schema
    reader = spark.readStream.schema(schema).format(file_format)
    if file_format == "csv":
        reader = reader.options(header=True, enforceSchema=False, nullValue=CSV_NULL)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return require_columns(normalise_columns(reader.load(folder)))


def _arrivals(spark: SparkSession, folder: str, max_files: int) -> DataFrame:
    """A stream of the paths that arrive; their content is not read."""
    fields = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.schema(fields).format("binaryFile").option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select("path")


def _delivered(spark: SparkSession, arrivals: DataFrame, file_format: str, options: dict | None) -> DataFrame | None:
    """What the files of one batch hold, each read by its own header; None without files.

    A batch has as many files as the stream was told to take at most.
    """
    paths = sorted(row["path"] for row in arrivals.collect())
    frames = [read_delivery(spark, path, file_format, options=options) for path in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def _start(stream: DataFrame, batch_job, progress: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch_job).option("checkpointLocation", progress)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=FILE_INTERVAL)
    return writer.start()


def replace_on_delivery(
    spark: SparkSession,
    folder: str,
    store: SnapshotStore,
    progress: str,
    profile: Profile = DB,
    once: bool = False,
    file_format: str = "parquet",
    options: dict | None = None,
    **cleaning,
) -> StreamingQuery:
    """Every delivered file replaces the snapshot before it.

    Each file is read by its own header; one that lacks a required column ends the stream with
    an error, and the last snapshot stays. The store knows a repeated batch by the progress
    folder and the batch number. ``progress`` is the stream's own record, in shared storage.
    ``cleaning`` is passed on: ``text_format``, ``allowed``.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        rows = _delivered(spark, batch, file_format, options)
        if rows is not None:
            store.publish(clean(rows, profile, **cleaning), batch_id, stream=_stream_id(spark, progress))

    return _start(_arrivals(spark, folder, 1), publish, progress, once)


def _stream_id(spark: SparkSession, progress: str) -> str:
    """What Spark wrote down for this progress folder when it was first used."""
    return spark.read.text(f"{progress.rstrip('/')}/metadata").first()[0]


# --- windowed counts, for batch and stream alike -------------------------------------


def _windowed(df: DataFrame, window: Callable[[Column], Column], key: str, lateness: str | None) -> DataFrame:
    timed = df.withColumn("_ts", F.col(FECHA))
    if lateness is not None:
        # Watermarks refuse zone-less timestamps; windows then need the session in UTC.
        timed = df.withColumn("_ts", F.col(FECHA).cast("timestamp")).withWatermark("_ts", lateness)
    counts = timed.groupBy(window(F.col("_ts")).alias("_window"), key).agg(F.count(PEDIDO).alias(N))
    return counts.select(F.to_date("_window.start").alias("inicio"), key, N)


def daily_windows(df: DataFrame, key: str = TORRE, lateness: str | None = None) -> DataFrame:
    """``inicio, key, n`` per day. Without ``lateness`` late rows always count."""
    return _windowed(df, lambda ts: F.window(ts, "1 day"), key, lateness)


def weekly_windows(df: DataFrame, key: str = TORRE, lateness: str | None = None) -> DataFrame:
    """Per ISO week: the offset moves the start from Thursday (1970-01-01) to Monday."""
    return _windowed(df, lambda ts: F.window(ts, "7 days", "7 days", "4 days"), key, lateness)


def month_key(day: Column) -> Column:
    return F.trunc(day, "month")


def _half_month_end(start: Column) -> Column:
    return F.when(F.dayofmonth(start) == 1, F.date_add(start, 15)).otherwise(F.add_months(F.trunc(start, "month"), 1))


def _calendar_buckets(
    df: DataFrame, start: Callable[[Column], Column], end: Callable[[Column], Column], key: str, lateness: str | None
) -> DataFrame:
    """``inicio, key, n`` per bucket of the calendar, whose lengths differ, so that no fixed window fits.

    With ``lateness`` a bucket and key is a session that lasts from its first day to the end of the
    bucket: each day asks for the gap that is left of it. So a watermark closes it, and its state
    goes, when the newest day less ``lateness`` is past the end. Days, not rows, are the sessions
    that are merged, hence a hot key sends one count a task and day.
    """
    day = F.to_date(FECHA)
    if lateness is None:
        return df.groupBy(start(day).alias("inicio"), key).agg(F.count(PEDIDO).alias(N))
    timed = df.withColumn("_day", day.cast("timestamp")).withWatermark("_day", lateness)
    first = start(F.to_date("_day"))
    left = F.datediff(end(first), F.to_date("_day"))
    session = F.session_window("_day", F.make_interval(days=left)).alias("_session")
    counts = timed.groupBy(session, first.alias("inicio"), key).agg(F.count(PEDIDO).alias(N))
    return counts.select("inicio", key, N)


def fortnight_windows(df: DataFrame, key: str = TORRE, lateness: str | None = None) -> DataFrame:
    """``inicio, key, n`` per half month. Without ``lateness`` late rows always count."""
    return _calendar_buckets(df, half_month, _half_month_end, key, lateness)


def month_windows(df: DataFrame, key: str = TORRE, lateness: str | None = None) -> DataFrame:
    """``inicio, key, n`` per month. Without ``lateness`` late rows always count."""
    return _calendar_buckets(df, month_key, lambda first: F.add_months(first, 1), key, lateness)

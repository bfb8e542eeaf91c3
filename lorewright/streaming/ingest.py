"""Incremental ingestion: statements and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(stream: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark (None: it has one already); a time without a zone counts in the session's."""
    if late is None:
        return stream
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def fresh(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Rows whose key wasn't seen within the watermark; older state is dropped, so memory is bounded."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, by: str, value: str, size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """(start, by, n, total) of tumbling windows, final once the watermark has passed them."""
    w = _timed(stream, time, late).groupBy(F.window(time, size), F.col(by)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(by, start, end, n) of sessions that a gap without events ends."""
    s = _timed(stream, time, late).groupBy(F.session_window(time, gap), F.col(by)).agg(F.count("*").alias("n"))
    return s.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_triples(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("s", "p", "o")) -> StreamingQuery:
    """Appends each batch's statements that the table at *path* lacks; a repeated batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys))
        try:
            old = spark.read.schema(batch.schema).parquet(path).select(*keys)
        except Exception as e:  # the table doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        (new if old is None else new.join(old, list(keys), "left_anti").select(*batch.columns)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

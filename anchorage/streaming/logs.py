"""Structured Streaming over the append-only logs: latest state, new completions, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.core import latest_wins


def latest_state(stream: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The latest row of each key as a streaming aggregate (update mode): max_by keeps one row a key in state.

    There is no watermark: a record's state holds however late its line comes, and a late line of a
    lower order changes nothing.
    """
    return latest_wins(stream, keys, F.col(order))


def upsert_into(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Keep a Parquet table of the latest rows: each batch appends its own latest row of each key.

    Readers take the latest of the table again, so a batch that is repeated after a failure adds
    nothing new.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        rows = latest_wins(batch, keys, F.col(order)).withColumn("_epoch", F.lit(epoch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_epoch").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completions(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Records completed for the first time since the stream began; one logged again, however late, is not new.

    The state holds the keys of all records completed so far, so it has no watermark to drop them by.
    """
    return stream.filter("status in ('ready', 'unresolved', 'error')").withColumn("at", F.timestamp_seconds("ts")).dropDuplicates(keys)


def windowed_counts(stream: DataFrame, time: str, kind: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each kind by tumbling or sliding windows; what comes later than ``late`` is left out."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(span.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, ended by a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")

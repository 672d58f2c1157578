"""Incremental loads as streams: each micro-batch is upserted, so running again or after a crash changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.store import VersionedTable


def load_incrementally(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: Sequence[str], files_per_batch: int = 64, prepare: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 16, **how) -> None:
    """Upsert all new files of ``source`` (a path or pattern of Parquet files) into the versioned table at ``target``.

    The stream remembers in ``checkpoint`` which files it has read and stops when there are no more. A batch that is
    replayed upserts the same rows again. ``prepare`` makes table rows of a batch; of several rows of a key the last in row
    order wins, so the columns that decide come first. What else is given goes to the upsert: columns that keep their
    first value (``keep``) or stay true (``sticky``), across batches and runs.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    table = VersionedTable(spark, target, keys, buckets)
    rows = prepare or (lambda batch: batch)
    query = stream.writeStream.foreachBatch(lambda batch, _: table.upsert(rows(batch), **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_latency(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events, errors and mean latency per window of event time; works on streams and on tables.

    Event times without a zone are read as UTC, since watermarks need timestamps. On a stream rows later than ``late``
    behind the newest may be dropped, as watermarks do.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.round(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), 6).alias("latency_mean")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n_events", "n_errors", "latency_mean")

"""Streams over landing files: incremental landing, running counters, event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isochron.sources.shared import shared_folder


def arrivals(spark: SparkSession, path: str, schema: StructType, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def land(stream: DataFrame, out: str, checkpoint: str, keys: Sequence[str]) -> None:
    """Takes the files that are there and not yet landed; replaces the partitions they touch, so a batch that runs
    again after a failure leaves the same table."""
    from isochron.sources.files import replace_partition

    query = stream.writeStream.foreachBatch(lambda df, _: replace_partition(df, out, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def counters(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events, goals and last event of each key, for update mode."""
    return stream.groupBy(*keys).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("goals"), F.max("event_id").alias("last_event"))


def windows(stream: DataFrame, at: str, keys: Sequence[str], value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling, or sliding, event-time windows; rows later than `late` are dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    rows = stream.withWatermark(at, late) if stream.isStreaming else stream
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, keys: Sequence[str], gap: str, late: str = "10 minutes") -> DataFrame:
    rows = stream.withWatermark(at, late) if stream.isStreaming else stream
    return rows.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def to_completion(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drives a bounded stream to its end into a table below spark.checkpoint.dir, and returns the table. In complete
    mode each batch replaces the one before; else each has a folder of its own, so a repeated batch adds nothing."""
    spark = df.sparkSession
    folder, last = f"{shared_folder(spark)}-{name}", []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else number}")
        last.append(number)

    query = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/progress")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows/*") if last else spark.createDataFrame([], df.schema)

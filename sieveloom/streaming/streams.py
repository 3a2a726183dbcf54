"""Structured Streaming: resuming over new shard files, running corpus statistics, event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import heuristics, pieces


def documents(spark: SparkSession, folder: str, kind, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream; what is done already is known from the query's checkpoint."""
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def features(stream: DataFrame) -> DataFrame:
    """The stream with its base text features; row by row, so the same expressions as in batch."""
    p = pieces(F.col("text"))
    staged = stream.withColumns({f"__{k}": c for k, c in p.items()})
    h = heuristics(F.col("text"), {k: F.col(f"__{k}") for k in p})
    return staged.select(*stream.columns, *[c.alias(n) for n, c in h.items()])


def resume(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Process every file not yet done, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_statistics(stream: DataFrame, domain: str, tokens: str, target: str, checkpoint: str) -> StreamingQuery:
    """Domain statistics kept per micro-batch under ``target/batch=N``: a repeated batch replaces itself; ``statistics`` sums them."""

    def save(df: DataFrame, n: int) -> None:
        df.groupBy(domain).agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens")).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statistics(spark: SparkSession, target: str, domain: str) -> DataFrame:
    by = spark.read.parquet(target).groupBy(domain).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return by.withColumn("weight", F.col("tokens") / F.expr("sum(tokens) OVER ()"))


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need a timestamp with zone; the session's is taken for those without."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, late: str = "10 minutes", length: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are dropped, their windows' state with them."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _timed(events, late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: events less than ``gap`` apart."""
    return _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))

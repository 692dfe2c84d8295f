"""Resampling of unbounded streams, by windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.sources.readers import work_folder


def windowed(stream: DataFrame, time: str, keys: list[str], aggregates: dict, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) windows of a stream; rows later than the watermark are dropped, and state with it."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: rows less than ``gap`` apart."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Run what is there as a stream to its end and return the last state of its result."""
    out = f"{folder}/result"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and sum of events a day and type, by a stream over the table's files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    totals = windowed(stream, "ts", ["event_type"], {"n": F.count(F.lit(1)), "s": F.sum(F.col("value").cast("decimal(18,2)"))})
    out = run_available(totals, work_folder(spark, "stream"))
    total = F.floor(F.col("s").cast("double") * 100 + 0.5).cast("double") / 100
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", total.alias("total"))

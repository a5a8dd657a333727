"""Structured Streaming counterparts of the prospective reading: weekly counts, late records, alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.functions.cells import epi_week


def weekly(stream: DataFrame, *, time: str = "ts", keys: tuple[str, ...] = ("event_type",), late: str | None = "14 days") -> DataFrame:
    """Counts by key and epidemiological week (Sunday to Saturday); a week closes once ``late`` has passed since its end.

    ``late`` is None for a stream that has its watermark already.
    """
    # windows of 7 days start on Thursdays (1970-01-01), so Sundays are three days on
    week = F.window(time, "7 days", startTime="3 days")
    counted = (stream.withWatermark(time, late) if late else stream).groupBy(*keys, week.alias("w")).agg(F.count("*").alias("y"))
    year, number = epi_week(F.to_date("w.start"))
    return counted.select(*keys, F.to_date("w.start").alias("week_start"), year.alias("epi_year"), number.alias("week"), "y")


def without_repeats(stream: DataFrame, *, id: str = "event_id", time: str = "ts", late: str = "14 days") -> DataFrame:
    """Each event once, however often it is sent within the time for late records."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([id])


def running_alarms(stream: DataFrame, limits: DataFrame, *, key: str = "event_type", time: str = "ts") -> DataFrame:
    """Weeks of a key, as they grow, that have reached the key's threshold. limits: key, threshold; a row for each key."""
    return weekly(stream, time=time, keys=(key,)).join(limits, key).where(F.col("y") >= F.col("threshold"))


def drained(stream: DataFrame, path: str, *, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, with its state under ``path``, and reads what it wrote.

    Append mode gives closed weeks only.
    """
    spark: SparkSession = stream.sparkSession
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")

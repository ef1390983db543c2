"""Live progress of a running evaluation as a stream, and the same as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import SAMPLE


def progress(samples: DataFrame, target: int) -> DataFrame:
    """Valid, resolved and blocked so far, and percent of the target; for batches and streams."""
    r = F.col("benchmark_resolved")
    return samples.groupBy("dataset").agg(
        F.count("*").alias("seen"), F.count(r).alias("valid"), F.count_if(F.coalesce(r, F.lit(False))).alias("resolved"), F.count_if(r.isNull()).alias("blocked"),
        F.round(100.0 * F.count(r) / F.lit(target), 6).alias("percent"),
    )


def peaks(gauges: DataFrame) -> DataFrame:
    """Highest value of each gauge so far: the stream's state, kept in its checkpoint."""
    return gauges.groupBy("name").agg(F.max("value").alias("peak"), F.max("ts").alias("last_seen"))


def staleness(last_seen: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(last_seen)


def sample_stream(spark: SparkSession, path: str, schema: str = SAMPLE, files: int = 1000) -> DataFrame:
    """Finished samples as they are written; broken files are skipped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files).json(path)


def latest_attempts(samples: DataFrame, by: tuple[str, ...] = ("instance_id", "sample_index")) -> DataFrame:
    """Of several attempts at a slot, the last valid one, else the last: state of one row a slot."""
    rank = F.struct(F.col("benchmark_resolved").isNotNull().alias("valid"), F.col("attempt_index").alias("attempt"))
    rest = F.struct("dataset", "benchmark_resolved", "attempt_index")
    return samples.groupBy(*by).agg(F.max_by(rest, rank).alias("s")).select(*by, "s.*")


def first_attempts(samples: DataFrame, watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Repeats of a slot within the watermark dropped, with bounded state."""
    return samples.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["instance_id", "sample_index"])


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "complete") -> StreamingQuery:
    """All input there is now, in as many micro-batches as needed, then stop."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def snapshot_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch's snapshot under its number: a repeat of a batch overwrites its own."""
    return lambda df, epoch: df.coalesce(1).write.mode("overwrite").json(f"{path}/batch={epoch}")


def reached(snapshot: DataFrame, target: int) -> bool:
    return (snapshot.agg(F.sum("valid")).first()[0] or 0) >= target


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Extension: tumbling or sliding counts by type with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Extension: sessions by user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))

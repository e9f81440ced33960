"""The judgement log as a stream; its batch results and its stream results are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def first_labels(log: DataFrame) -> DataFrame:
    """One row for each pair and annotator, whichever arrives first; on batch and stream alike."""
    return log.dropDuplicates(["pair_id", "annotator"])


def counts(log: DataFrame) -> DataFrame:
    """label, n of distinct (pair, annotator)."""
    return first_labels(log).groupBy("label").agg(F.count("*").alias("n"))


def windowed(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Counts by event window, closed once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))


def run_progress(log: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest progress counts of all available files in a table at ``sink``."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    return counts(log).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_labels(log: DataFrame, sink: str, checkpoint: str, late: str = "1 day", time: str = "at") -> StreamingQuery:
    """Append each pair and annotator's first label as JSON lines as it arrives; what the watermark has passed is forgotten.

    log: pair_id, annotator, label and a time. Files and checkpoint together make each row come once, whatever is lost.
    """
    first = log.withWatermark(time, late).dropDuplicatesWithinWatermark(["pair_id", "annotator"])
    return first.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_windows(events: DataFrame, sink: str, checkpoint: str, time: str = "ts", width: str = "1 hour", late: str = "1 day") -> StreamingQuery:
    """Append the counts of each window once, when the watermark has passed it."""
    found = windowed(events, time, width, late).select(F.col("window.start").alias("start"), "event_type", "n")
    return found.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

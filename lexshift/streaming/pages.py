"""Streams: pages that arrive are handled batch by batch; type statistics are kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexshift.operators import flow


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines "page lang n word" of files as they arrive."""
    p = F.split("value", "\t")
    return spark.readStream.text(path).select(p[0].try_cast("long").alias("page"), p[1].alias("lang"), p[2].try_cast("long").alias("n"), p[3].alias("word"))


def explain_pages(pages: DataFrame, dictionary: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, f: str = "fr", e: str = "en") -> StreamingQuery:
    """Runs the flow over the pages of every batch; a page's lines arrive together."""

    def batch(rows: DataFrame, number: int) -> None:
        side = lambda lang: rows.filter(F.col("lang") == lang).groupBy("page", "word").agg(F.sum("n").alias("n"))
        sink(flow.residuals(side(f), side(e), dictionary), number)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def type_statistics(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Per type and window of event time: count, mean, deviation; events later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def keep(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream's whole result so far to path after every batch of what has arrived."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    return result.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

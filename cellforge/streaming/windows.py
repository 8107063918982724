"""Statistics over event-time windows of a stream of values, and the newest value of each cell.

A stream's state is one row a window and group, or one a cell; values that come later than the watermark allows are left
out, and a window that it has passed is dropped from the state. Batches are written to a folder that driver and executors
share, so a query that is run again from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def windowed(stream: DataFrame, at: str, value: str, width: str, late: str, *by: str) -> DataFrame:
    """``start, n, min, max, mean, std`` and the groups, for each window of ``width``; valid values only."""
    v = F.col(value).cast("double")
    grouped = stream.where(v.isNotNull() & ~F.isnan(v)).withWatermark(at, late).groupBy(F.window(at, width).alias("span"), *by)
    found = grouped.agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return found.select(F.col("span.start").alias("start"), *by, "n", "min", "max", "mean", "std")


def newest(stream: DataFrame, at: str, value: str) -> DataFrame:
    """``row, col, v``: the value of the latest time of each cell; of equal times the greatest value."""
    return stream.groupBy("row", "col").agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))).alias("x")).select("row", "col", "x.v")


def drained(result: DataFrame, mode: str = "complete", checkpoint: str | None = None, to: str | None = None) -> DataFrame:
    """Run a streaming result over all that has arrived, and read what it came to.

    ``complete`` results replace what was there; with ``append`` only windows that the watermark has passed are written.
    Give ``checkpoint`` and ``to`` to go on with a former run.
    """
    spark: SparkSession = result.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/cellforge-stream-{uuid.uuid4().hex}"
    to, checkpoint = to or f"{base}/out", checkpoint or f"{base}/checkpoint"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(to)

    run: Callable = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start
    run().awaitTermination()
    return spark.read.schema(result.schema).parquet(to)

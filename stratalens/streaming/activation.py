"""Activation of images as they arrive, and statistics of events by window."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import packed
from ..params import Params


def activate(spark: SparkSession, source: str, sink: str, checkpoint: str, p: Params, s1_bank: np.ndarray, s2_banks: list[np.ndarray] | None, wanted: tuple[str, ...] = ("c2",), files_at_once: int = 16, precision: str = "float") -> StreamingQuery:
    """Reads Parquet files of (image_id, height, width, data) as they appear in a folder, and appends their maps.

    Each row stands for itself, so there is no state; the checkpoint makes the sink exactly-once."""
    grey = spark.readStream.schema("image_id long, height int, width int, data array<float>").option("maxFilesPerTrigger", files_at_once).parquet(source)
    maps = packed.build(grey, p, s1_bank, s2_banks, wanted, precision)
    return maps.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_stats(events: DataFrame, ts: str, by: str, value: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and means by tumbling window; rows later than the watermark are dropped and their state freed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))

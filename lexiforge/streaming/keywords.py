"""Streams: the stateless operators run on a stream as they are; these add what needs state, bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import textnorm as tn


def normalised_stream(stream: DataFrame, column: str = "keyword", config: tn.NormalizerConfig = tn.NormalizerConfig()) -> DataFrame:
    return tn.normalise(stream, column, config)


def first_seen(stream: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state older than that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, at: str, by: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window_start, window_end, <by>, n): counts in tumbling or sliding windows, rows later than the watermark left out."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    counted = stream.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")

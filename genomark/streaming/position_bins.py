"""Streams of associations: the bin summaries and gap groups of the batch operators, kept up to date as rows arrive.

An extension: published studies are files, so nothing here is needed to build or query them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Tumbling windows of event time with a watermark: count, sum and the largest value with its row's keys."""
    x = events.withWatermark(time, late)
    return x.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "largest")


def event_sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Runs of events no further than gap apart."""
    x = events.withWatermark(time, late)
    return x.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def position_bins(rows: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """Smallest p and counts of each bin of positions; for complete or update output."""
    return rows.groupBy(*keys, F.floor(F.col("pos") / width).alias("bin")).agg(F.min("pvalue").alias("min_p"), F.count_if(F.col("pvalue") < 5e-8).alias("n_gws"), F.count("*").alias("n_variants"))

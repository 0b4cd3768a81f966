"""Scoring and watching streams. A fitted tree is a projection, so it runs on a stream as it does on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(stream: DataFrame, model) -> DataFrame:
    """The stream with prediction, confidence and leaf."""
    return model.transform(stream)


def drift(stream: DataFrame, model, time: str, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, prediction, n): how often each class is predicted in each window; late rows wait as long as the watermark."""
    if stream.isStreaming:
        # watermarks need times with a zone
        stream = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    scored = model.transform(stream)
    return scored.groupBy(F.window(time, every).alias("window"), "prediction").agg(F.count("*").alias("n"))

"""Beyond the reference: conversion of a sample stream into time buckets.

A bucket's rows are final once the watermark has passed it, so the sink gets
each (series, data column) once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.model import label_columns, labels_array


def bucketed_stream(samples: DataFrame, column_duration: str, delay: str, ts: str = "ts") -> DataFrame:
    """(labels, start, end, n, samples) per series and bucket from rows (l_*, ts, v)."""
    labelled = samples.withColumn("labels", labels_array(label_columns(samples))).withWatermark(ts, delay)
    grouped = labelled.groupBy("labels", F.window(ts, column_duration).alias("w"))
    rows = grouped.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.unix_millis(ts).alias("t"), "v"))).alias("samples"))
    return rows.select("labels", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "samples")


def write_buckets(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Appends finished buckets as Parquet; exactly once, by the sink's log."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()

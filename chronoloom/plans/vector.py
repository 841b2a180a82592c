"""Beyond the reference: instant vectors, rates and grouped aggregates over samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.model import LABEL_PREFIX, col

LOOK_BACK = 300_000


def instant_vector(samples: DataFrame, keys: Sequence[str], t: int, look_back: int = LOOK_BACK) -> DataFrame:
    """The latest sample of each series in (t - look_back, t]; stale markers (NaN) end a series."""
    recent = samples.where((F.col("t") > t - look_back) & (F.col("t") <= t))
    last = recent.groupBy(*[col(k) for k in keys]).agg(F.max(F.struct("t", "v")).alias("s"))
    return last.select(*[col(k) for k in keys], F.col("s.t").alias("t"), F.col("s.v").alias("v")).where(~F.isnan("v"))


def aggregate(vector: DataFrame, how: str, by: Sequence[str]) -> DataFrame:
    """sum, avg, min, max or count of ``v`` by labels."""
    f = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[how]
    return vector.groupBy(*[col(LABEL_PREFIX + b) for b in by]).agg(f("v").alias(how))


def increase(samples: DataFrame, keys: Sequence[str], start: int, end: int) -> DataFrame:
    """Sum of the rises within (start, end]; a fall is a counter reset.  No extrapolation."""
    own = Window.partitionBy(*[col(k) for k in keys]).orderBy("t", "v")
    inside = samples.where((F.col("t") > start) & (F.col("t") <= end))
    before = F.lag("v").over(own)
    rise = F.when(before.isNull(), 0.0).when(F.col("v") >= before, F.col("v") - before).otherwise(F.col("v"))
    return inside.withColumn("_rise", rise).groupBy(*[col(k) for k in keys]).agg(F.sum("_rise").alias("increase"))


def rate(samples: DataFrame, keys: Sequence[str], start: int, end: int) -> DataFrame:
    seconds = (end - start) / 1000
    return increase(samples, keys, start, end).withColumn("rate", F.col("increase") / seconds).drop("increase")

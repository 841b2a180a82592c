"""Global ranks without a single task: range partitions and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.sources.scratch import settled


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, 3, ... over the whole table in the given order.

    Rows are range-partitioned and numbered within their partition; the driver
    adds up one count per partition.  The order must tell all rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = settled(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = {r["_part"]: r["n"] for r in part.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    below, base = {}, 0
    for p in sorted(counts):
        below[p] = base
        base += counts[p]
    offset = F.lit(0).cast("long")
    if below:
        offset = F.create_map(*[x for p, b in below.items() for x in (F.lit(p), F.lit(b).cast("long"))])[F.col("_part")]
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.withColumn(name, (own + offset).cast("long")).drop("_part")

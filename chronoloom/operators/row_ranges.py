"""Set operations on row ranges (start, count), as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranges_of_rows(rows: DataFrame, row: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of consecutive row numbers: (by..., start, count)."""
    return (
        rows.select(*by, F.col(row).alias("_row"))
        .distinct()
        .withColumn("_run", F.col("_row") - F.row_number().over(Window.partitionBy(*by).orderBy("_row")))
        .groupBy(*by, "_run")
        .agg(F.min("_row").alias("start"), F.count("*").alias("count"))
        .drop("_run")
    )


def simplify(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Merges overlapping and adjacent ranges, drops empty ones."""
    order = Window.partitionBy(*by).orderBy("start", "count")
    reach = F.max(F.col("start") + F.col("count")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.where("count > 0").withColumn("_new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    run = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = opened.withColumn("_run", run).groupBy(*by, "_run")
    return merged.agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("count")) - F.min("start")).alias("count")).drop("_run")


def _sweep(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Parts between neighbouring ends: (by..., start, count, in_a, in_b).

    One pass over the sorted ends, so work grows with the ranges, not with their pairs.
    """

    def ends(df: DataFrame, name: str) -> DataFrame:
        both = F.array(
            F.struct(F.col("start").alias("at"), F.lit(1).alias("w")),
            F.struct((F.col("start") + F.col("count")).alias("at"), F.lit(-1).alias("w")),
        )
        e = df.where("count > 0").select(*by, F.explode(both).alias("e"))
        return e.select(*by, "e.at", *[(F.col("e.w") if n == name else F.lit(0)).alias(n) for n in ("a", "b")])

    events = ends(a, "a").unionByName(ends(b, "b")).groupBy(*by, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy(*by).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    parts = events.select(*by, "at", F.lead("at").over(order).alias("to"), *[(F.sum(n).over(upto) > 0).alias(f"in_{n}") for n in ("a", "b")])
    return parts.where("to IS NOT NULL").select(*by, F.col("at").alias("start"), (F.col("to") - F.col("at")).alias("count"), "in_a", "in_b")


def intersect(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Common parts of two lists of ranges."""
    return simplify(_sweep(a, b, by).where("in_a AND in_b").drop("in_a", "in_b"), by)


def overlaps(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The groups ``by`` in which some row lies in both lists."""
    return _sweep(a, b, by).where("in_a AND in_b").select(*by).distinct()


def complement(base: DataFrame, holes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What of ``base`` is in no range of ``holes``."""
    return simplify(_sweep(base, holes, by).where("in_a AND NOT in_b").drop("in_a", "in_b"), by)


def partition_ranges(ranges: DataFrame, max_gap: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Joins sorted ranges whose gap is at most ``max_gap``."""
    wide = simplify(ranges.select(*by, "start", (F.col("count") + max_gap).alias("count")), by)
    return wide.select(*by, "start", (F.col("count") - max_gap).alias("count"))

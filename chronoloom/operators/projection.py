"""Label projections, sorting, label lists and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.model import HASH_COLUMN, LABEL_PREFIX, col, label_columns, label_name, labels_array


def project_labels(df: DataFrame, names: tuple[str, ...] | None, include: bool) -> DataFrame:
    """Include list: only those labels.  Exclude list: all but those, and the
    series hash, unless the list is empty or names it.  Rows stay as they are:
    series that look alike afterwards are not merged.
    """
    have = label_columns(df)
    others = [c for c in df.columns if c not in have and c not in (HASH_COLUMN, "labels")]
    if names is None:
        keep, with_hash = have, False
    elif include:
        keep, with_hash = [c for c in have if label_name(c) in names], HASH_COLUMN in names
    else:
        keep, with_hash = [c for c in have if label_name(c) not in names], bool(names) and HASH_COLUMN not in names
    shown = [col(c) for c in keep] + ([F.col(HASH_COLUMN)] if with_hash and HASH_COLUMN in df.columns else [])
    return df.select(*[col(c) for c in others], *shown, labels_array(keep).alias("labels"))


def sort_by_labels(df: DataFrame) -> DataFrame:
    """Pairwise by name and value; a label set that is a prefix of another comes first."""
    return df.orderBy("labels")


def names_in_schema(columns: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(label_name(c),) for c in sorted(columns) if c.startswith(LABEL_PREFIX)], "name string")


def names_used(series: DataFrame) -> DataFrame:
    """Names of labels that some row has: one aggregate, no shuffle of the rows."""
    have = label_columns(series)
    if not have:
        return series.sparkSession.createDataFrame([], "name string")
    used = series.agg(*[F.max(col(c).isNotNull() & (col(c) != "")).alias(f"u{i}") for i, c in enumerate(have)])
    pairs = F.array(*[F.struct(F.lit(label_name(c)).alias("name"), F.col(f"u{i}").alias("used")) for i, c in enumerate(have)])
    return used.select(F.explode(pairs).alias("p")).where("p.used").select("p.name")


def values_of(series: DataFrame, name: str) -> DataFrame:
    """Distinct values of a label, without the empty one; unknown labels have none."""
    c = LABEL_PREFIX + name
    if c not in series.columns:
        return series.sparkSession.createDataFrame([], "value string")
    return series.where(col(c).isNotNull() & (col(c) != "")).select(col(c).alias("value")).distinct()


def merge_sorted(lists: list[DataFrame], limit: int = 0) -> DataFrame:
    """Sorted union without repeats; a positive limit cuts it."""
    merged = reduce(DataFrame.unionByName, lists).distinct()
    merged = merged.orderBy(merged.columns[0])
    return merged.limit(limit) if limit > 0 else merged

"""Column conventions of the three tables: series, chunks, shard_meta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names and metadata keys of the file format.
LABEL_PREFIX = "l_"
HASH_COLUMN = "s_series_hash"
METRIC_NAME = "__name__"
ENCODINGS = ("XOR", "histogram", "float_histogram")
DEFAULT_SAMPLES_PER_CHUNK = 120

LABELS_TYPE = "array<struct<name:string,value:string>>"
#: A histogram sample; float histograms use the same fields.
HISTOGRAM_TYPE = (
    "struct<schema:int,zero_threshold:double,zero_count:double,count:double,sum:double,"
    "pos_spans:array<struct<offset:int,length:int>>,pos_buckets:array<double>,"
    "neg_spans:array<struct<offset:int,length:int>>,neg_buckets:array<double>,custom_values:array<double>,reset_hint:int>"
)
#: Beyond so many label columns, wide rows stop paying; the labels array alone is kept.
MAX_LABEL_COLUMNS = 2000


def label_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(LABEL_PREFIX))


def label_name(column: str) -> str:
    return column.removeprefix(LABEL_PREFIX)


def col(name: str) -> Column:
    """A column by its exact name; dots and blanks are part of it."""
    return F.col("`" + name.replace("`", "``") + "`")


def labels_array(columns: list[str]) -> Column:
    """The canonical label set: (name, value) sorted by name, absent labels left out.

    An empty value is the same as an absent label, so it is left out too.
    """
    pairs = [F.struct(F.lit(label_name(c)).alias("name"), col(c).alias("value")) for c in sorted(columns)]
    if not pairs:
        return F.array().cast(LABELS_TYPE)
    return F.filter(F.array(*pairs), lambda p: p["value"].isNotNull() & (p["value"] != "")).cast(LABELS_TYPE)


def columns_from_labels(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``l_`` columns taken from a ``labels`` array."""
    as_map = F.map_from_entries("labels")
    return df.select("*", *[as_map[F.lit(n)].alias(LABEL_PREFIX + n) for n in names])


def bucket_index(t: Column, mint: int, duration: int) -> Column:
    """Data column of a time: clamped at 0 below, not above."""
    return F.when(t < mint, 0).otherwise(F.floor((t - mint) / F.lit(duration))).cast("int")


def bucket_count(mint: int, maxt: int, duration: int) -> int:
    return (maxt - mint) // duration + 1 if maxt >= mint else 0

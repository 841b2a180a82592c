"""Conversion of labelled samples into the series, chunks and shard tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.hashing import series_hash
from chronoloom.model import (
    DEFAULT_SAMPLES_PER_CHUNK,
    ENCODINGS,
    HASH_COLUMN,
    HISTOGRAM_TYPE,
    LABEL_PREFIX,
    MAX_LABEL_COLUMNS,
    METRIC_NAME,
    bucket_index,
    col,
    label_columns,
    label_name,
    labels_array,
)
from chronoloom.operators.matchers import Matcher, all_of
from chronoloom.operators.ranking import global_row_number
from chronoloom.sources.scratch import settled

HOUR = 3_600_000


@dataclass(frozen=True)
class ConvertOptions:
    name: str = "block"
    sort_by: tuple[str, ...] = (METRIC_NAME,)
    bloom_labels: tuple[str, ...] = (METRIC_NAME,)
    column_duration: int = 8 * HOUR
    row_group_size: int = 1_000_000
    #: Row groups per shard; None puts everything into one shard.
    row_groups: int | None = None
    samples_per_chunk: int = DEFAULT_SAMPLES_PER_CHUNK
    labels_compression: str = "zstd"
    chunks_compression: str = "zstd"
    with_hash: bool = True

    def with_(self, **changes) -> ConvertOptions:
        return replace(self, **changes)


@dataclass(frozen=True)
class Converted:
    """The three tables of one block."""

    series: DataFrame
    chunks: DataFrame
    shard_meta: DataFrame
    options: ConvertOptions


def without_deleted(samples: DataFrame, tombstones: Sequence[tuple[Sequence[Matcher], int, int]]) -> DataFrame:
    """Drops samples inside (matchers, mint, maxt) intervals, both ends included."""
    for matchers, lo, hi in tombstones:
        samples = samples.where(~(all_of(list(matchers), samples.columns) & F.col("t").between(lo, hi)))
    return samples


def _encoding(columns: list[str]) -> Column:
    if "enc" in columns:
        known = F.col("enc").isin(*ENCODINGS)
        return F.when(known, F.col("enc")).otherwise(F.raise_error(F.concat(F.lit("unknown encoding "), F.col("enc"))))
    return F.lit(ENCODINGS[0])


def order_of_series(df: DataFrame, sort_by: Sequence[str]) -> list[Column]:
    """Sort labels first (missing as empty), then the full label set."""
    have = df.columns
    first = [F.coalesce(col(LABEL_PREFIX + n), F.lit("")) if LABEL_PREFIX + n in have else F.lit("") for n in sort_by]
    return [*first, F.col("labels")]


def rows_per_shard(unique: int, row_groups: int, row_group_size: int) -> int:
    """Even shards: as many as needed, then equally full."""
    shards = max(1, math.ceil(unique / (row_groups * row_group_size)))
    return max(1, math.ceil(unique / shards))


def number_series(series: DataFrame, options: ConvertOptions) -> DataFrame:
    """Adds series_id (rank in sort order), shard, row_no and row_group to unique series."""
    ranked = settled(global_row_number(series, order_of_series(series, options.sort_by), "series_id"), "series")
    rank = F.col("series_id") - 1
    if options.row_groups is None:
        shard, row = F.lit(0), rank
    else:
        size = rows_per_shard(ranked.count(), options.row_groups, options.row_group_size)
        shard, row = F.floor(rank / size), F.pmod(rank, F.lit(size))
    return ranked.select(
        "*",
        shard.cast("int").alias("shard"),
        row.cast("long").alias("row_no"),
        F.floor(row / options.row_group_size).cast("int").alias("row_group"),
    )


def cut_chunks(samples: DataFrame, keys: list[str], per_chunk: int, tie: list[str]) -> DataFrame:
    """Adds chunk_no: a new chunk after ``per_chunk`` samples, and for histograms
    also where the bucket layout changes or a counter falls."""
    if "v" in samples.columns:
        tie = [*tie, "v"]  # equal times are cut in one order, whatever the partitioning
    base = Window.partitionBy(*keys).orderBy("t", *tie)
    if "hist" not in samples.columns:
        return samples.withColumn("chunk_no", F.floor((F.row_number().over(base) - 1) / per_chunk).cast("int"))
    h = F.col("hist")
    layout = F.struct(h["schema"], h["zero_threshold"], h["pos_spans"], h["neg_spans"], h["custom_values"])
    last, before = F.lag(layout).over(base), F.lag("hist").over(base)
    fell = (h["count"] < before["count"]) | (h["zero_count"] < before["zero_count"]) | (h["reset_hint"] == 1)
    for side in ("pos_buckets", "neg_buckets"):
        fell |= F.coalesce(F.exists(F.arrays_zip(h[side].alias("a"), before[side].alias("b")), lambda z: z["b"] > z["a"]), F.lit(False))
    cut = before.isNotNull() & h.isNotNull() & (~last.eqNullSafe(layout) | F.coalesce(fell, F.lit(False)))
    runs = samples.withColumn("_cut", cut.cast("int"))
    runs = runs.withColumn("_run", F.sum("_cut").over(base.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("t", *tie)) - 1
    runs = runs.withColumn("_part", F.floor(place / per_chunk))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_run", "_part")) - 1
    return runs.withColumn("chunk_no", number.cast("int")).drop("_cut", "_run", "_part")


def convert(
    blocks: DataFrame | Sequence[DataFrame],
    mint: int,
    maxt: int,
    options: ConvertOptions = ConvertOptions(),
    *,
    tombstones: Sequence[tuple[Sequence[Matcher], int, int]] = (),
    tie: Sequence[str] = (),
) -> Converted:
    """Samples (l_* columns, t in ms, v, and enc and hist if histograms occur) of [mint, maxt].

    Both ends are included.  Equal label sets of several blocks become one
    series, its samples are concatenated, not de-duplicated.  ``tie`` names
    columns that order samples of one series and time.
    """
    if not isinstance(blocks, DataFrame):
        first, *more = blocks
        for b in more:
            first = first.unionByName(b, allowMissingColumns=True)
        blocks = first
    have = label_columns(blocks)
    if len(have) > MAX_LABEL_COLUMNS:
        raise ValueError(f"{len(have)} label columns; use at most {MAX_LABEL_COLUMNS}")
    samples = without_deleted(blocks.where(F.col("t").between(mint, maxt)), tombstones)
    samples = samples.withColumn("labels", labels_array(have)).withColumn("enc", _encoding(blocks.columns))
    series = number_series(samples.select("labels", *[col(c) for c in have]).dropDuplicates(["labels"]), options)
    if options.with_hash:
        series = series.withColumn(HASH_COLUMN, series_hash("labels"))
    series = series.withColumn("block", F.lit(options.name))
    keyed = samples.drop(*have).join(series.select("labels", "series_id", "shard"), "labels").drop("labels")
    keyed = keyed.withColumn("col_idx", bucket_index(F.col("t"), mint, options.column_duration))
    keys = ["shard", "series_id", "col_idx", "enc"]
    cut = cut_chunks(keyed, keys, options.samples_per_chunk, list(tie))
    sample = F.struct("t", *tie, "v")
    is_hist = "hist" in blocks.columns
    gathered = cut.groupBy(*keys, "chunk_no").agg(
        F.min("t").alias("min_t"),
        F.max("t").alias("max_t"),
        F.count("*").cast("int").alias("n"),
        F.array_sort(F.collect_list(sample)).alias("_s"),
        *([F.array_sort(F.collect_list(F.struct("t", "hist"))).alias("_h")] if is_hist else []),
    )
    order = F.array_position(F.array(*[F.lit(e) for e in ENCODINGS]), F.col("enc")).cast("int") - 1
    hists = F.transform("_h", lambda s: s["hist"]) if is_hist else F.lit(None)
    chunks = gathered.select(
        F.lit(options.name).alias("block"),
        "shard",
        "col_idx",
        "series_id",
        "enc",
        order.alias("enc_order"),
        "chunk_no",
        "min_t",
        "max_t",
        "n",
        (F.col("n") * 16).cast("long").alias("n_bytes"),
        F.transform("_s", lambda s: F.struct(s["t"].alias("t"), s["v"].alias("v"))).alias("samples"),
        hists.cast(f"array<{HISTOGRAM_TYPE}>").alias("hist"),
    )
    meta = series.groupBy("block", "shard").agg(F.count("*").alias("n_series"))
    names = F.array(*[F.lit(label_name(c)) for c in have]).cast("array<string>")
    meta = meta.select(
        "block",
        "shard",
        F.lit(mint).cast("long").alias("min_t"),
        F.lit(maxt).cast("long").alias("max_t"),
        F.lit(options.column_duration).cast("long").alias("col_duration_ms"),
        "n_series",
        names.alias("label_names"),
    )
    return Converted(series, chunks, meta, options)

"""Writing converted blocks and opening them again, on any file system Spark reads."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.model import LABEL_PREFIX
from chronoloom.plans.convert import Converted


#: Consecutive series whose rows share a file; shards may be far smaller.
FILE_SERIES = 1 << 15


def write_store(converted: Converted, root: str, mode: str = "append") -> None:
    """``root``/{series,chunks,shard_meta}, partitioned by block, the chunks also by data column.

    Shards and row groups are columns, not folders or files of their own: they
    may hold a few series only, and files would be as many as they are.  Rows
    are in series order, within files and over them, so that a shard, too, is
    found by statistics of files and pages.
    """
    o = converted.options
    run = F.floor((F.col("series_id") - 1) / FILE_SERIES)
    series = converted.series.repartition("block", run).sortWithinPartitions("block", "series_id")
    writer = series.write.mode(mode).option("compression", o.labels_compression).option("maxRecordsPerFile", FILE_SERIES)
    for name in o.bloom_labels:
        writer = writer.option(f"parquet.bloom.filter.enabled#{LABEL_PREFIX}{name}", "true")
    writer.partitionBy("block").parquet(f"{root}/series")
    chunks = converted.chunks.repartition("block", "col_idx", run)
    chunks = chunks.sortWithinPartitions("block", "col_idx", "series_id", "enc_order", "chunk_no")
    chunks.write.mode(mode).option("compression", o.chunks_compression).partitionBy("block", "col_idx").parquet(f"{root}/chunks")
    converted.shard_meta.coalesce(1).write.mode(mode).parquet(f"{root}/shard_meta")


@dataclass(frozen=True)
class Store:
    series: DataFrame
    chunks: DataFrame
    shard_meta: DataFrame
    #: Tells this store from any other, also after it is gone.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def find(self, mint: int, maxt: int) -> DataFrame:
        """The shards that overlap a time range, ends included."""
        return self.shard_meta.where((F.col("min_t") <= maxt) & (F.col("max_t") >= mint))

    def shard(self, block: str, index: int) -> Store:
        """One shard; an unknown one is an error."""
        where = (F.col("block") == block) & (F.col("shard") == index)
        meta = self.shard_meta.where(where)
        if meta.isEmpty():
            raise FileNotFoundError(f"{block}/{index}")
        return Store(self.series.where(where), self.chunks.where(where), meta)


def open_store(spark: SparkSession, root: str) -> Store:
    """Opens all blocks below ``root``; a label that some shard lacks is null there."""
    read = spark.read.option("mergeSchema", "true").option("spark.sql.sources.partitionColumnTypeInference.enabled", "true")
    return Store(read.parquet(f"{root}/series"), read.parquet(f"{root}/chunks"), spark.read.parquet(f"{root}/shard_meta"))


def in_memory(*converted: Converted) -> Store:
    """Converted blocks as one store, without files."""
    series, chunks, meta = converted[0].series, converted[0].chunks, converted[0].shard_meta
    for c in converted[1:]:
        series = series.unionByName(c.series, allowMissingColumns=True)
        chunks, meta = chunks.unionByName(c.chunks), meta.unionByName(c.shard_meta)
    return Store(series, chunks, meta)

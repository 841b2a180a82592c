"""Select, LabelNames and LabelValues over a store."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.model import bucket_index, col, label_columns
from chronoloom.operators import projection
from chronoloom.operators.limits import CHUNK_BYTES, DATA_BYTES, LimitFunc, Quota, reserve_bytes, reserve_rows
from chronoloom.operators.matchers import Matcher, all_of
from chronoloom.sources.storage import Store

_KEYS = ["block", "shard", "series_id"]


@dataclass(frozen=True)
class SelectHints:
    start: int = 0
    end: int = 0
    func: str = ""
    projection_labels: tuple[str, ...] | None = None
    projection_include: bool = False


class MatchCache:
    """The matched series of the last ``size`` queries; what falls out is unpersisted."""

    def __init__(self, size: int = 16):
        self.size, self._held = size, OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def get(self, key: tuple) -> DataFrame | None:
        if key in self._held:
            self._held.move_to_end(key)
        return self._held.get(key)

    def put(self, key: tuple, rows: DataFrame) -> DataFrame:
        self._held[key] = rows.persist()
        while len(self._held) > self.size:
            self._held.popitem(last=False)[1].unpersist()
        return rows


@dataclass(frozen=True)
class QueryOptions:
    row_limit: LimitFunc = lambda: 0
    chunk_bytes_limit: LimitFunc = lambda: 0
    data_bytes_limit: LimitFunc = lambda: 0
    #: Called with each result row, on the driver; an error aborts.
    series_callback: Callable | None = None
    #: Narrows the matched series before chunks are read.
    labels_filter: Callable[[DataFrame], DataFrame] | None = None
    honor_projection_hints: bool = False
    #: Matched series are kept by store, range and matchers if a cache is given.
    cache: MatchCache | None = None


@dataclass
class Querier:
    store: Store
    mint: int
    maxt: int
    options: QueryOptions = field(default_factory=QueryOptions)

    def _matched(self, matchers: tuple[Matcher, ...], mint: int, maxt: int) -> DataFrame:
        key = (self.store.key, mint, maxt, matchers)
        cache = self.options.cache
        if cache is not None and (kept := cache.get(key)) is not None:
            return kept
        shards = self.store.find(mint, maxt).select("block", "shard")
        # one row per shard: a small table by design, left to Spark to broadcast
        rows = self.store.series.where(all_of(matchers, self.store.series.columns)).join(shards, ["block", "shard"], "left_semi")
        return rows if cache is None else cache.put(key, rows)

    def select(self, *matchers: Matcher, hints: SelectHints | None = None, sort: bool = True) -> DataFrame:
        """One row per series: labels, l_* and its chunks in order.

        A chunk is returned whole if it overlaps the range.  Series of several
        shards with equal labels are merged by concatenation.
        """
        mint, maxt = (hints.start, hints.end) if hints else (self.mint, self.maxt)
        only_labels = bool(hints) and hints.func == "series"
        o = self.options
        rows_left, chunk_left, data_left = Quota(o.row_limit()), Quota(o.chunk_bytes_limit()), Quota(o.data_bytes_limit())
        found = self._matched(matchers, self.mint, self.maxt)
        reserve_rows(rows_left, found)
        if data_left.limit:
            size = sum((F.coalesce(F.octet_length(col(c)), F.lit(0)) for c in label_columns(found)), F.lit(0))
            reserve_bytes(data_left, found.select(size.alias("b")), "b", DATA_BYTES)
        if o.labels_filter:
            found = o.labels_filter(found)
        shown = [c for c in found.columns if c.startswith("l_") or c == "s_series_hash"]
        if only_labels:
            out = found.dropDuplicates(["labels"]).select("labels", *[col(c) for c in shown])
        else:
            chunks = self._chunks(mint, maxt)
            joined = found.join(chunks, _KEYS)
            if chunk_left.limit or data_left.limit:
                reserve_bytes(chunk_left, joined, "n_bytes", CHUNK_BYTES)
                reserve_bytes(data_left, joined, "n_bytes", DATA_BYTES)
            chunk = F.struct("block", "shard", "col_idx", "enc_order", "chunk_no", "enc", "min_t", "max_t", "n", "samples", "hist")
            out = joined.groupBy("labels").agg(*[F.first(col(c)).alias(c) for c in shown], F.array_sort(F.collect_list(chunk)).alias("chunks"))
        if sort or self._several_shards():
            out = projection.sort_by_labels(out)
        if hints and o.honor_projection_hints:
            out = projection.project_labels(out, hints.projection_labels, hints.projection_include)
        if o.series_callback and not only_labels:
            for row in out.toLocalIterator():
                o.series_callback(row)
        return out

    def _several_shards(self) -> bool:
        """Series of several shards are merged in label order, whether asked for or not."""
        return self.store.find(self.mint, self.maxt).limit(2).count() > 1

    def _chunks(self, mint: int, maxt: int) -> DataFrame:
        """Chunks that overlap the range.

        Every shard counts its data columns from its own start, so shards are
        grouped by the columns they need, and each run of neighbouring ones in
        a group is one condition; those on block and column prune folders.
        """
        found = self.store.find(mint, maxt).select("block", "shard", bucket_index_of(mint).alias("lo"), bucket_index_of(maxt).alias("hi"))
        wanted: dict[tuple[str, int, int], set[int]] = {}
        for r in found.collect():  # one row per shard in the range
            wanted.setdefault((r.block, r.lo, r.hi), set()).add(r.shard)
        where = F.lit(False)
        for (block, lo, hi), shards in sorted(wanted.items()):
            some = reduce(lambda a, b: a | b, (F.col("shard").between(*run) for run in runs_of(shards)))
            where = where | ((F.col("block") == block) & F.col("col_idx").between(lo, hi) & some)
        return self.store.chunks.where(where).where((F.col("min_t") <= maxt) & (F.col("max_t") >= mint))

    def samples(self, *matchers: Matcher, trim: bool = True) -> DataFrame:
        """Exploded samples (labels, l_*, t, v, hist), by default within the range only; ``hist`` is null for plain numbers."""
        rows = self.select(*matchers, sort=False)
        flat = rows.select(*[col(c) for c in rows.columns if c != "chunks"], F.explode("chunks").alias("c"))
        # a chunk of histograms has them beside its samples, in the same order
        both = F.transform("c.samples", lambda s, i: F.struct(s["t"].alias("t"), s["v"].alias("v"), F.get("c.hist", i).alias("hist")))
        flat = flat.select(*[col(c) for c in flat.columns if c != "c"], F.explode(both).alias("s"))
        flat = flat.select(*[col(c) for c in flat.columns if c != "s"], "s.t", "s.v", "s.hist")
        return flat.where(F.col("t").between(self.mint, self.maxt)) if trim else flat

    def label_names(self, *matchers: Matcher, limit: int = 0) -> DataFrame:
        if not matchers:
            names = self.store.find(self.mint, self.maxt).select(F.explode("label_names").alias("name"))
        else:
            names = projection.names_used(self._matched(matchers, self.mint, self.maxt))
        return projection.merge_sorted([names], limit)

    def label_values(self, name: str, *matchers: Matcher, limit: int = 0) -> DataFrame:
        return projection.merge_sorted([projection.values_of(self._matched(matchers, self.mint, self.maxt), name)], limit)


def runs_of(numbers: set[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    ends: list[list[int]] = []
    for n in sorted(numbers):
        if ends and n == ends[-1][1] + 1:
            ends[-1][1] = n
        else:
            ends.append([n, n])
    return [(a, b) for a, b in ends]


def bucket_index_of(t: int):
    """Data column of a time in each shard's own buckets."""
    wide = F.greatest(F.lit(0), F.floor((F.lit(t) - F.col("min_t")) / F.col("col_duration_ms")))
    return wide.cast("long")

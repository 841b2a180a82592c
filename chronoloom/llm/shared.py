"""Helpers that several operators use: durable tables, hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator that counts words: blank and \t..\r.
WORD_REGEX = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master, where
    that is unset, as in tests, gets a temporary folder of its own.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("chronoloom.local.shared", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("chronoloom.local.shared", own)
    return own


def durable(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what is
    above, and what is above runs once however often the result is used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``durable`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        spark, path = df.sparkSession, df._durable_path
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % n


def unit_hash(*cols: Column) -> Column:
    """A deterministic number in [0, 1) for each row."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def mix64(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values; wraps silently."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def roots(n: int, a: Iterable[int], b: Iterable[int]) -> np.ndarray:
    """Union-find over 0..n-1 for a bounded block inside one task."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], dtype=np.int64)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b), both long and not null.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every
    step is one aggregate and one join over the edges, the edge count never
    grows, and each round is written to the shared folder.  Returns
    (node, component) for every node with an edge to another node, where
    component is the smallest reachable node.  An empty input gives no rows.
    """
    cur = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "cc",
    )
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        # large-star: neighbours above u point to the smallest of u and its neighbours
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small-star: neighbours below u, and u, point to the smallest of them
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        nxt = durable(small.select("e.u", "e.v").where("u <> v").distinct(), "cc")
        # settled once every node has one edge, to a node without a smaller one
        open_nodes = nxt.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n > 1")
        chained = nxt.join(nxt.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        discard(cur)
        cur = nxt
        if open_nodes.isEmpty() and chained.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    tops = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the texts that one Arrow batch brings to Python, unless set lower."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


_kept: dict[Any, Any] = {}


def kept_in_worker(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this Python worker for its later tasks.

    A worker serves one operator after another, so it keeps one such thing
    only: the next operator's takes its place.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


@cache
def _libc() -> Any:
    import ctypes

    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") else None


def give_back() -> None:
    """Returns free memory of this process to the system: what Arrow and the C library hold for later."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def giving_back(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """``run`` of a ``mapInArrow``, after which its worker gives memory back.

    Workers wait for later tasks, beside a JVM that needs the same memory.
    """

    def task(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def heaps_give_back(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage and return the freed heap to the system.

    A heap that one step has grown otherwise stays as large, beside the Python
    workers of the next.  There is a task for each core; an executor that gets
    none keeps its heap, which changes no result.
    """
    cores = spark.sparkContext.defaultParallelism
    tasks = spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')").alias("done"))
    tasks.write.format("noop").mode("overwrite").save()


#: At most so many ids are broadcast (16 bytes each and the hash table's rest).
BROADCAST_IDS = 500_000
#: Rows of a few numbers each that a join may broadcast (about 100 MB in memory).
BROADCAST_SIDE = 1_000_000


def only_ids(df: DataFrame, id_col: str, ids: DataFrame, *, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose id is (or, with keep=False, is not) in ``ids.d``.

    The ids are counted: few are broadcast, so that the texts stay where they
    are; many are joined by a shuffle.
    """
    name = "d_of_side"
    while name in df.columns:
        name += "_"
    side = ids.select(F.col("d").alias(name)).distinct()
    if side.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        side = F.broadcast(side)
    return df.join(side, F.col(f"`{id_col}`") == F.col(name), "left_semi" if keep else "left_anti")


def small_side(side: DataFrame) -> DataFrame:
    """``side`` (ids or places, a written table), to be broadcast if it is counted to be small, else joined by a shuffle."""
    return F.broadcast(side) if side.limit(BROADCAST_SIDE + 1).count() <= BROADCAST_SIDE else side


TABLE_SCHEMA = "k long, p long, v binary"


def table_rows(table: np.ndarray, block: int, fanout: int):
    """Rows (k, p, v) of a flat integer table: block number, a salt, bytes."""
    import zlib

    import pyarrow as pa

    salt = zlib.crc32(table.tobytes()) % fanout
    for k in range(0, len(table), block):
        v = zlib.compress(table[k : k + block].astype("<i8").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([k // block]), pa.array([salt]), pa.array([v], pa.binary())], names=["k", "p", "v"])


def added_tables(parts: DataFrame, size: int, block: int, fanout: int) -> np.ndarray:
    """Sum of the tables that ``table_rows`` gave, in two levels.

    ``fanout`` tasks per block add what their share of the input tasks made;
    the driver adds at most ``fanout`` tables of a fixed size, one by one.
    """
    import zlib

    import pyarrow as pa

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), b.column("v").to_pylist()):
                x = np.frombuffer(zlib.decompress(v), dtype="<i8")
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            v = zlib.compress(x.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([0]), pa.array([v], pa.binary())], names=["k", "p", "v"])

    total = np.zeros(size, dtype=np.int64)
    dealt = parts.select("k", "p", "v").repartition(fanout, "k", "p").mapInArrow(giving_back(add), TABLE_SCHEMA)
    for r in dealt.toLocalIterator():
        total[r.k * block : r.k * block + block] += np.frombuffer(zlib.decompress(r.v), dtype="<i8")
    return total

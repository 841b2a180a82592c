"""Exact top-k Hamming search by incremental multi-index hashing.

A binary code is cut into m segments, each indexed by its value.  A code within
distance r of a query differs in at most r // m bits in some segment.  So the
search looks up all segment values within radius a = 0, 1, 2, ... of the
query's: after radius a is done in every segment, all codes at distance up to
m * (a + 1) - 1 have been seen.  A query is settled once its kth smallest
verified distance is within that bound; only the others go on.

Segments grow wider with the number of codes, as lookups should hit few codes
each.  The flipped values are made by expressions,
one bit after the other, and meet the index by a shuffle, never a broadcast, as
they are many times the queries.  What is farther than the kth distance known so
far is dropped at once.

Ties go to the smaller id.  Equal codes are one index entry with the k + 1
smallest ids, which are all that a result can need, so that a code shared by
very many rows stays small; equal queries are searched once.  A segment value
that very many codes share is dealt in blocks, and its lookups visit each.

Edge cases: rows with a null id, a null code or a null component have no code;
they are neither found nor queried.  A query does not find its own id.  Repeated
ids count once per code.  With fewer than k other codes, all are returned.  Ids
are long numbers, or of a type that casts to them.  Other columns are ignored,
whatever their names.  Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.shared import discard, durable, small_side

CODE_BITS = 64
#: Codes of one segment value in one block of the index (about).
BLOCK = 10_000


def sign_code(vector: Column) -> Column:
    """64-bit code: bit i is set where component i (of the first 64) is above 0."""
    v = vector.cast("array<double>")
    bits = [
        F.call_function("shiftleft", F.when(F.get(v, F.lit(i)) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), F.lit(i))
        for i in range(CODE_BITS)
    ]
    code = reduce(lambda a, b: a.bitwiseOR(b), bits)
    return F.when(v.isNotNull() & F.forall(v, lambda e: e.isNotNull()), code)


def segment_count(n_codes: int) -> int:
    """How many segments: of 8, 16, 21 or 32 bits."""
    return next(m for size, m in ((1 << 10, 8), (1 << 24, 4), (1 << 28, 3), (1 << 64, 2)) if n_codes < size)


def segments(code: Column, m: int) -> Column:
    """(seg, width, val) of every segment of a code."""
    parts = []
    for i in range(m):
        lo, hi = CODE_BITS * i // m, CODE_BITS * (i + 1) // m
        val = F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
        parts.append(F.struct(F.lit(i).alias("seg"), F.lit(hi - lo).alias("width"), val.alias("val")))
    return F.array(*parts)


def lookups(active: DataFrame, m: int, radius: int) -> DataFrame:
    """(qc, bound, seg, val): the segments' values with ``radius`` bits flipped, lowest first."""
    at = active.select("qc", "bound", F.explode(segments(F.col("qc"), m)).alias("s"), F.lit(0).alias("low")).select("qc", "bound", "s.seg", "s.width", "s.val", "low")
    for _ in range(radius):
        at = at.where("low < width").withColumn("b", F.explode(F.sequence(F.col("low"), F.col("width") - 1)))
        flipped = F.col("val").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b")))
        at = at.select("qc", "bound", "seg", "width", flipped.alias("val"), (F.col("b") + 1).alias("low"))
    return at.select("qc", "bound", "seg", "val")


def top_k(codes: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest codes of each query."""
    has_code = F.col(id_col).isNotNull() & F.col(code_col).isNotNull()
    base = codes.where(has_code).select(F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("long").alias("code"))
    # the k + 1 smallest ids of each code, in two levels so that a hot code meets in no single task
    salted = base.distinct().withColumn("s", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    ids = few(few(salted, "code", "s").drop("s"), "code")
    index = durable(ids.groupBy("code").agg(F.collect_list("id").alias("ids")), "codes")
    m = segment_count(index.count())
    table = index.select("code", F.explode(segments(F.col("code"), m)).alias("s")).select("code", "s.seg", "s.val")
    blocks = table.groupBy("seg", "val").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    blocks = durable(blocks, "blocks")  # a row for BLOCK codes at most
    hot = not blocks.isEmpty()

    def dealt(df: DataFrame, block: Column) -> DataFrame:
        if not hot:
            return df.withColumn("block", F.lit(0))
        return df.join(small_side(blocks), ["seg", "val"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", block).drop("blocks")

    table = durable(dealt(table, F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")), "segments")
    q = queries.where(has_code).select(F.col(id_col).cast("long").alias("q"), F.col(code_col).cast("long").alias("qc"))
    asked = durable(q.distinct(), "queries")
    active = durable(asked.select("qc", F.lit(CODE_BITS).alias("bound")).distinct(), "active")
    near: DataFrame | None = None  # (qc, id, dist): the k + 1 nearest so far of the active queries
    done: list[DataFrame] = []
    nearest = Window.partitionBy("qc").orderBy("dist", "id")
    for a in range(CODE_BITS // m + 2):
        probes = dealt(lookups(active, m, a), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        hits = probes.join(table.hint("merge"), ["seg", "val", "block"])
        hits = hits.select("qc", "bound", "code", F.bit_count(F.col("qc").bitwiseXOR(F.col("code"))).alias("dist"))
        hits = hits.where("dist <= bound").select("qc", "code", "dist").distinct()
        rows = hits.join(index.hint("merge"), "code").select("qc", F.explode("ids").alias("id"), "dist")
        if near is not None:
            rows = rows.unionByName(near).distinct()
        # one more than k, as the query's own id may be among them
        best = durable(rows.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k + 1), "near")
        reach = m * (a + 1) - 1
        far = best.where(F.col("rank") == k + 1).select("qc", F.col("dist").alias("bound"))
        settled = far.where(F.col("bound") <= reach) if reach < CODE_BITS else active
        going = active.select("qc").join(settled.select("qc"), "qc", "left_anti").join(far, "qc", "left")
        going = durable(going.select("qc", F.coalesce("bound", F.lit(CODE_BITS)).alias("bound")), "active")
        done.append(durable(best.join(going, "qc", "left_anti").select("qc", "id", "dist"), "done"))
        over = going.isEmpty()
        if not over:
            left = durable(best.join(going, "qc", "left_semi").select("qc", "id", "dist"), "open")
        discard(active, best, *([near] if near is not None else []))
        if over:
            discard(going)
            break
        active, near = going, left
    discard(index, table, blocks)
    found = reduce(DataFrame.unionByName, done)
    own = Window.partitionBy("q", "qc").orderBy("dist", "id")
    out = asked.join(found, "qc").where("id <> q").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select(
        F.col("q").alias("query_id"), F.col("id").alias(id_col), F.col("dist").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank")
    )

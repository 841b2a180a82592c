"""N-gram Jaccard join with token-combination prefixes.

A document is the set of hashes of its distinct word shingles.  All tokens are
put in one global order, rare before frequent, by a count sketch over the whole
corpus (any fixed order is exact; the counts make it selective).  Two sets of
Jaccard similarity >= t share at least ``l`` tokens within the first
``n - ceil(t * n) + l`` of each.  Tokens fall into classes: rare ones are
indexed singly, frequent ones in combinations of two within each of m
subclasses, with prefixes extended by m, so that a similar pair shares a rare
token or two frequent tokens of one subclass.  m grows with the set's size, so
that the combinations stay linear in it; a set is indexed for its own m and that of its largest
possible partner.

Equal sets are one class from the start.  Within an index entry's documents,
sorted by size, each is first paired with one leader only; verified pairs are
joined to components.  Then, and only in entries that still hold several
components, pairs across components are formed, after length and positional
filters.  So a group of n copies costs n pairs, not n * n, and no pair that
could join two components is left out.  Entries of very frequent combinations
are salted, large ones are dealt as pairs of blocks.

A pair is verified by a parity bitmap (an exact upper bound of the overlap),
then by the whole sets.

Edge cases: null texts and texts without words have the empty set and are
linked with nothing; texts of fewer than ``k`` words are one shingle.  Rows
with a null id are returned without component.  Rows of one id are one
document: its sets are compared separately, any of them may link.  Very long
texts are compared whole.  Empty tables give no rows.  Other columns are
ignored, whatever their names.  Ids are long numbers, or of a type that casts
to them.

The operator returns components; links inside a component beyond those that
join it are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import (
    TABLE_SCHEMA,
    added_tables,
    components,
    durable,
    giving_back,
    mix64,
    only_ids,
    small_batches,
    table_rows,
)

#: Buckets of the count sketch (2 ** this), and how its sum is dealt.
SKETCH_BITS, SKETCH_BLOCK, FANOUT = 20, 1 << 17, 16
#: A token of at least so many, and 4 times the mean bucket, counts as frequent.
FREQUENT = 64
#: Shingles of a set for each subclass of frequent tokens (about): keeps the combinations linear in the set's size.
CLASS_ROWS = 64
#: Rows of an index entry under one salt (about); rows of one block of pairs.
SALT_ROWS, BLOCK_ROWS = 50_000, 4096
CACHE_WORDS = 100_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_P = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


def shingle_set(text: str | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the whole text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=n)
    width = min(k, n)
    acc = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        acc = (acc ^ (acc >> np.uint64(29))) * _P + h[i : n - width + 1 + i]
    return np.unique(mix64(acc))


def _set_hash(text: Column, k: int) -> Column:
    """The hash of a text's set, as text; null for the empty set."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        cache = WordHashes()
        sets = [shingle_set(t, k, cache) for t in texts]
        return pd.Series([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets])

    return of(text.cast("string"))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens per bit; the number of bits is a power of two from n up."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def overlap_bound(a: bytes, na: int, b: bytes, nb: int) -> int:
    """An upper bound of the overlap: what differs in parity is in one set only."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):  # position modulo half the bits
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2


def subclasses(n: int) -> int:
    """A power of two that grows with the set."""
    return 1 << max(0, (n // CLASS_ROWS).bit_length() - 1)


def schemes_of(n: int, num: int, den: int) -> list[int]:
    """The subclasses of the set itself and of every larger set that may be similar."""
    m, out = subclasses(n), []
    while m <= subclasses(n * den // num):
        out.append(m)
        m *= 2
    return out


def similar(overlap: int, na: int, nb: int, num: int, den: int) -> bool:
    return den * overlap >= num * (na + nb - overlap)


def signatures(tokens: np.ndarray, counts: np.ndarray, frequent: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, positions, salts) of one set; position -1 for combinations."""
    n = len(tokens)
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    need = -(-num * n // den)
    schemes = schemes_of(n, num, den)
    longest = min(n, n - need + 1 + schemes[-1])
    n_rare = int(np.searchsorted(counts[:longest], frequent))
    singles = longest if need < schemes[-1] + 1 else n_rare
    keys, pos, salts = [tokens[:singles]], [np.arange(singles)], [counts[:singles] // SALT_ROWS + 1]
    for m in schemes:
        end = min(n, n - need + 1 + m)
        hot, cnt = tokens[n_rare:end], counts[n_rare:end]
        sub = (hot >> np.uint64(17)) % np.uint64(m)
        for s in range(m) if len(hot) > 1 else ():
            at = np.flatnonzero(sub == s)
            if len(at) > 1:
                i, j = np.triu_indices(len(at), 1)
                keys.append(mix64(hot[at[i]] * _P + mix64(hot[at[j]]) + np.uint64(m)))
                pos.append(np.full(len(i), -1))
                salts.append(cnt[at[i]] // SALT_ROWS + 1)
    return np.concatenate(keys), np.concatenate(pos), np.concatenate(salts)


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))


_FACTS = "d long, n long, h1 long, h2 long, bits binary, " + TABLE_SCHEMA


def facts(src: DataFrame, k: int) -> DataFrame:
    """Per document its set's size, 128-bit hash and bitmap; and tables of token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sketch, names = WordHashes(), np.zeros(1 << SKETCH_BITS, dtype=np.int64), ["d", "n", "h1", "h2", "bits", "k", "p", "v"]
        held, size = [], 0
        for b in batches:
            rows = [[], [], [], []]
            for t in b.column("t"):
                s = shingle_set(t.as_py(), k, cache)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                for col, v in zip(rows, (len(s), (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), bitmap(s) if len(s) else None)):
                    col.append(v)
                held.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                size += len(s)
                if size > 1_000_000:
                    sketch += np.bincount(np.concatenate(held), minlength=len(sketch))
                    held, size = [], 0
            cols = [b.column("d"), *[pa.array(c, pa.int64()) for c in rows[:3]], pa.array(rows[3], pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.binary())], names=names
            )
        if held:
            sketch += np.bincount(np.concatenate(held), minlength=len(sketch))
        if sketch.any():
            for t in table_rows(sketch, SKETCH_BLOCK, FANOUT):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()), *t.columns], names=names)

    return src.mapInArrow(giving_back(run), _FACTS)


def entries(src: DataFrame, k: int, counts, frequent: int, num: int, den: int) -> DataFrame:
    """The index: (key, salt, salts, d, n, pos) for every document of two shingles or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sketch = WordHashes(), counts.value
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]

            def flush() -> pa.RecordBatch:
                cols = [_int64(np.concatenate(c)) for c in out]
                for c in out:
                    c.clear()
                return pa.RecordBatch.from_arrays(cols, names=["key", "salt", "salts", "d", "n", "pos"])

            size = 0
            for d, t in zip(b.column("d").to_pylist(), b.column("t")):
                s = shingle_set(t.as_py(), k, cache)
                if d is None or len(s) < 2:  # sets of one shingle are similar to equal sets only
                    continue
                keys, pos, salts = signatures(s, sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], frequent, num, den)
                m = len(keys)
                salt = (xxhash.xxh3_64_intdigest(str(d)) >> 1) % salts
                for col, v in zip(out, (keys, salt, salts, np.full(m, d), np.full(m, len(s)), pos)):
                    col.append(v)
                size += m
                if size > 200_000:
                    yield flush()
                    size = 0
            if size:
                yield flush()

    return src.mapInArrow(giving_back(run), "key long, salt long, salts long, d long, n long, pos long")


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Sorted rows as columns with the bounds of the groups, never cutting a group."""
    held: dict[str, np.ndarray] | None = None

    def bounds(cols: dict[str, np.ndarray]) -> np.ndarray:
        n = len(cols[by[0]])
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        for c in by:
            new[1:] |= cols[c][1:] != cols[c][:-1]
        return np.append(np.flatnonzero(new), n)

    for b in batches:
        if not len(b):
            continue
        cols = {name: b.column(name).to_numpy(zero_copy_only=False) for name in b.schema.names}
        if held is not None:
            cols = {c: np.concatenate([held[c], cols[c]]) for c in cols}
        edge = bounds(cols)
        last = edge[-2]
        if last:
            yield {c: v[:last] for c, v in cols.items()}, edge[:-1]
        held = {c: v[last:] for c, v in cols.items()}
    if held is not None:
        yield held, bounds(held)


def tasks(spark) -> int:
    """Partitions of what Python workers read: as many as shuffles have, never merged to fewer."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def led(index: DataFrame, num: int, den: int) -> DataFrame:
    """Entries with several sets: (key, d, n, pos, lead)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, edge in _groups(batches, ("key", "salt")):
            size = np.diff(edge)
            # salted entries go on even if alone: others of their key are elsewhere
            some = np.flatnonzero((size > 1) | (cols["salts"][edge[:-1]] > 1))
            if not len(some):
                continue
            pick, lead = [], []
            d, n = cols["d"].tolist(), cols["n"].tolist()
            for g in some:
                lo, hi = edge[g], edge[g + 1]
                rows = [lo]
                for r in range(lo + 1, hi):
                    if d[r] != d[r - 1] or n[r] != n[r - 1]:
                        rows.append(r)
                if len(rows) == 1 and cols["salts"][lo] == 1:
                    continue
                at = 0
                while at < len(rows):
                    most, end = n[rows[at]] * den // num, at + 1
                    while end < len(rows) and n[rows[end]] <= most:
                        end += 1
                    first = min(d[r] for r in rows[at:end])
                    pick += rows[at:end]
                    lead += [first] * (end - at)
                    at = end
            if pick:
                yield pa.RecordBatch.from_arrays(
                    [_int64(cols[c][pick]) for c in ("key", "d", "n", "pos")] + [pa.array(lead, pa.int64())], names=["key", "d", "n", "pos", "lead"]
                )

    dealt = index.repartition(tasks(index.sparkSession), "key", "salt").sortWithinPartitions("key", "salt", "n", "d")
    return dealt.mapInArrow(giving_back(run), "key long, d long, n long, pos long, lead long")


#: Groups up to this size are compared pair by pair, larger ones by matrix rows.
SMALL_GROUP = 16


def _pairs(d: list[int], n: list[int], pos: list[int], c: list[int], own: list[int] | None, bits: list[bytes], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Index pairs of one group, sorted by size, that may be similar."""
    size = np.array(n)
    ends = np.searchsorted(size, size * den // num, side="right").tolist()
    if len(d) <= SMALL_GROUP:
        for i in range(len(d)):
            for j in range(i + 1, ends[i]):
                if c[i] == c[j] or d[i] == d[j] or own is not None and own[i] == own[j]:
                    continue
                need = -(-num * (n[i] + n[j]) // (num + den))
                if pos[j] >= 0 and min(n[i] - pos[i], n[j] - pos[j]) < need:
                    continue
                if len(bits[i]) == len(bits[j]):
                    apart = (int.from_bytes(bits[i]) ^ int.from_bytes(bits[j])).bit_count()
                    if (n[i] + n[j] - apart) // 2 >= need:
                        yield i, j
                elif overlap_bound(bits[i], n[i], bits[j], n[j]) >= need:
                    yield i, j
        return
    comp, place, side = np.array(c), np.array(pos), np.array(own) if own is not None else None
    width = np.array([len(x) for x in bits])
    rows, full, half = np.zeros(len(d), dtype=np.int64), {}, {}
    for w in set(width.tolist()):
        at = np.flatnonzero(width == w)
        rows[at] = np.arange(len(at))
        full[w] = np.frombuffer(b"".join(bits[k] for k in at), dtype=np.uint8).reshape(-1, w)
        half[w] = full[w][:, : w // 2] ^ full[w][:, w // 2 :]
    for i in range(len(d)):
        j = np.arange(i + 1, ends[i])
        need = -(-num * (size[i] + size[j]) // (num + den))
        ok = (comp[j] != comp[i]) & ((place[j] < 0) | (np.minimum(size[i] - place[i], size[j] - place[j]) >= need))
        if side is not None:
            ok &= side[j] != side[i]
        j, need = j[ok], need[ok]
        w = int(width[i])
        mine = full[w][rows[i]]
        for other in set(width[j].tolist()):
            sel = np.flatnonzero(width[j] == other)
            if other in (w, 2 * w):
                theirs = (full[w] if other == w else half[other])[rows[j[sel]]]
                bound = (size[i] + size[j[sel]] - np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)) // 2
            else:
                bound = np.array([overlap_bound(bits[i], n[i], bits[k], n[k]) for k in j[sel]])
            for k in j[sel][bound >= need[sel]].tolist():
                yield i, k


def across(rows: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of one entry and of different components that may be similar.

    The bitmaps come along, so that a pair leaves the task only if length,
    position and the bitmap's bound allow it to be similar.
    """
    per_key = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m"))
    open_keys = per_key.where("c0 <> c1").select("key", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("blocks"))
    live = rows.join(open_keys, "key").join(info.where("n > 0").select("d", "n", "bits"), ["d", "n"])
    live = live.withColumn("own", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
    live = live.withColumn(
        "pair",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")),
            )
        ),
    ).select("key", F.col("pair.x").alias("px"), F.col("pair.y").alias("py"), "own", "d", "n", "pos", "c", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, edge in _groups(batches, ("key", "px", "py")):
            found: set[tuple[int, int]] = set()
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                d, n, c, pos, own, bits = (cols[x][lo:hi].tolist() for x in ("d", "n", "c", "pos", "own", "bits"))
                cross = cols["px"][lo] != cols["py"][lo]
                for i, j in _pairs(d, n, pos, c, own if cross else None, bits, num, den):
                    found.add((min(d[i], d[j]), max(d[i], d[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    dealt = live.repartition(tasks(live.sparkSession), "key", "px", "py").sortWithinPartitions("key", "px", "py", "n")
    return dealt.mapInArrow(giving_back(run), "a long, b long").distinct()


def verified(pairs: DataFrame, info: DataFrame, src: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar: by bitmap bound, then by whole sets."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_pylist(), b.column("nb").to_pylist()
            ok = [
                similar(min(overlap_bound(x, p, y, q), p, q), p, q, num, den)
                for x, y, p, q in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), na, nb)
            ]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = info.where("n > 0").select("d", "n", "bits")
    both = (
        pairs.join(one.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
        .join(one.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
        .select("a", "b", "na", "nb", "xa", "xb")
    )
    left = durable(both.mapInArrow(giving_back(bounded), "a long, b long").distinct(), "bounded")
    ends = left.select("a", "b", F.explode(F.array("a", "b")).alias("d"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            s = [shingle_set(t.as_py(), k, cache).tobytes() for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(s, pa.binary())], names=["d", "s"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, edge in _groups(batches, ("a", "b")):
            a, b = [], []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                x, y = int(cols["a"][lo]), int(cols["b"][lo])
                of = [(int(cols["d"][r]), np.frombuffer(cols["s"][r], dtype=np.uint64)) for r in range(lo, hi)]
                for s in (s for d, s in of if d == x):
                    for t in (t for d, t in of if d == y):
                        merged = np.concatenate([s, t])
                        merged.sort(kind="stable")
                        if similar(int((merged[1:] == merged[:-1]).sum()), len(s), len(t), num, den):
                            a.append(x), b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    texts = only_ids(src, "d", ends.select("d"))
    dealt = ends.join(texts.mapInArrow(giving_back(sets), "d long, s binary"), "d").repartition(tasks(src.sparkSession), "a", "b").sortWithinPartitions("a", "b", "d")
    return durable(dealt.mapInArrow(giving_back(exact), "a long, b long").distinct(), "similar")


def jaccard_components(
    docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(d, n, h1, h2) per row: the set's size and hash; and (node, component) of documents linked with another.

    Two documents are linked when ``den * overlap >= num * union``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = _read(docs, id_col, text_col)
    found = durable(facts(src, k), "facts")
    info = found.where("k IS NULL").select("d", "n", "h1", "h2", "bits")
    table = added_tables(found.where("k IS NOT NULL"), 1 << SKETCH_BITS, SKETCH_BLOCK, FANOUT)
    frequent = max(FREQUENT, int(4 * table.mean()))
    counts = spark.sparkContext.broadcast(table)  # a fixed size
    known = info.where("d IS NOT NULL AND n > 0")
    # copies: each set's documents point to the smallest
    first = known.groupBy("n", "h1", "h2").agg(F.min("d").alias("b"), F.max("d").alias("z")).where("b <> z").drop("z")
    copies = durable(known.select("d", "n", "h1", "h2").join(first, ["n", "h1", "h2"]).select(F.col("d").alias("a"), "b").where("a <> b"), "copies")
    # an id whose sets are all copies of a smaller id's needs no entries of its own
    sets = known.select("d", "n", "h1", "h2").distinct().groupBy("d").agg(F.count("*").alias("sets"))
    once = sets.where("sets = 1").select("d").join(copies.select(F.col("a").alias("d")).distinct(), "d")
    single = only_ids(src, "d", durable(once, "once"), keep=False)
    index = durable(led(entries(single, k, counts, frequent, num, den), num, den), "index")
    tested = durable(index.where("lead <> d").select(F.least("lead", "d").alias("a"), F.greatest("lead", "d").alias("b")).distinct(), "leads")
    edges = verified(tested, info, src, k, num, den).unionByName(copies)
    parts = durable(components(edges), "parts")
    rows = index.select("key", "d", "n", "pos").join(parts.withColumnRenamed("node", "d"), "d", "left")
    rows = durable(rows.select("key", "d", "n", "pos", F.coalesce("component", "d").alias("c")), "open")
    more = across(rows, info, num, den).join(tested, ["a", "b"], "left_anti")
    more = verified(durable(more, "across"), info, src, k, num, den)
    if not more.isEmpty():
        parts = components(edges.unionByName(more))
    return info.select("d", "n", "h1", "h2"), parts


def join_documents(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    sizes, parts = jaccard_components(docs, id_col=id_col, **options)
    component = F.coalesce("component", "d")
    return sizes.join(parts.withColumnRenamed("node", "d"), "d", "left").select(
        F.col("d").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("d")).alias("kept")
    )


def keep_one_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without those linked to a smaller id; columns as before.

    Of rows that repeat an id and its set of shingles, one stays if it has words.
    """
    text_col = options.get("text_col", "text")
    sizes, parts = jaccard_components(docs, id_col=id_col, **options)
    gone = parts.where("node <> component").select(F.col("node").alias("d"))
    left = only_ids(docs, id_col, gone, keep=False)
    twice = sizes.where("d IS NOT NULL AND n > 0").groupBy("d", "n", "h1", "h2").agg(F.count("*").alias("m")).where("m > 1")
    twice = durable(twice.select("d").distinct(), "twice")
    if twice.isEmpty():
        return left
    # rows that repeat an id and its set: one of them stays
    clash = "set_of_text"
    while clash in docs.columns:
        clash += "_"
    again = only_ids(left, id_col, twice).withColumn(clash, _set_hash(F.col(f"`{text_col}`"), options.get("k", 5)))
    return only_ids(left, id_col, twice, keep=False).unionByName(again.dropDuplicates([id_col, clash]).drop(clash))

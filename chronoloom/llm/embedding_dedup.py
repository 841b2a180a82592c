"""Embedding near-dedup by a forest of random-projection trees.

Trees are grown on a bounded sample: each node projects its vectors on the
difference of two of them (or, failing that, a random direction), splits them,
and lets vectors near the cut into both sides: within ``SPILL``, or farther, so
that at most ``LOSS`` of the linked pairs known from the sample are parted.  A
node that can't be split so, such as a dense group of different near copies, is
left whole, whatever its size.
Every vector of the table then falls through all trees to its leaves.  Vectors
are compared within leaves and labels only, in double precision, and a pair is
linked at cosine >= ``threshold``.

A pair meets in several trees.  It is counted in one place only: the first tree
and leaf that both share, which each task can tell from the leaf lists that the
vectors carry.  So a leaf's task gives sums, links per vector, and a spanning
forest of its links, never all pairs.  Leaves of more than ``BLOCK`` vectors are
dealt to tasks as pairs of blocks.  Equal vectors are compared once: they form a
class, whose members are linked with each other and share the class's links.

Edge cases: vectors that are null, zero, or hold a null or non-finite
component, vectors of a null label, and vectors of differing lengths link with
nothing.  Rows with a null id are returned without links and component.
Repeated ids are one vector each in the links, and one row each in the result.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import components, durable, unit_hash

THRESHOLD = 0.93
#: Vectors (about) on which the trees are grown; recall is measured in the tests.
SAMPLE_ROWS = 20_000
TREES, LEAF_ROWS, SPILL, SEED = 8, 256, 0.12, 5
#: The share of a node's known linked pairs that its split may part; links known
#: per vector of the sample; multiplications that finding them may take.
LOSS, KNOWN_LINKS, KNOWN_COST = 0.05, 8, 4e10
#: Where a node may be cut, as shares of its vectors.
CUTS = (0.5, 0.35, 0.65, 0.2, 0.8)
#: Vectors of one block of a leaf.
BLOCK = 4096


@dataclass
class Tree:
    """Nodes in arrays; children below 0 are leaves -1 - leaf."""

    direction: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray


def known_links(x: np.ndarray, label: np.ndarray, threshold: float) -> np.ndarray:
    """(2, m) linked pairs of the sample: some of each vector's, of as many vectors as KNOWN_COST allows."""
    rng, y = np.random.default_rng(SEED), x.astype(np.float32)
    probes = rng.permutation(len(x))[: max(1000, int(KNOWN_COST / max(x.size, 1)))]
    out = [np.zeros((2, 0), dtype=np.int64)]
    for at in range(0, len(probes), 256):
        some = probes[at : at + 256]
        near = (y[some] @ y.T >= threshold) & (label[some][:, None] == label)
        near[np.arange(len(some)), some] = False
        for r in np.flatnonzero(near.any(axis=1)):
            of = np.flatnonzero(near[r])
            of = of if len(of) <= KNOWN_LINKS else rng.choice(of, KNOWN_LINKS)
            out.append(np.stack([np.full(len(of), some[r]), of]))
    return np.concatenate(out, axis=1)


def grow(x: np.ndarray, leaf_rows: int, seed: int, links: np.ndarray | None = None) -> Tree:
    rng = np.random.default_rng(seed)
    links = np.zeros((2, 0), dtype=np.int64) if links is None else links
    dirs, cuts, low, high, leaves = [], [], [], [], 0
    place = np.zeros(len(x))

    def split(rows: np.ndarray, inner: np.ndarray) -> tuple | None:
        """(work, direction, cut, spill): the cheapest that keeps the known links together."""
        best = None
        for _ in range(4):
            a, b = rng.choice(rows, 2, replace=False)
            d = x[a] - x[b]
            if np.linalg.norm(d) < 0.3:
                d = rng.normal(size=x.shape[1])
            d = d / np.linalg.norm(d)
            p = place[rows] = x[rows] @ d
            ends = np.sort(place[inner], axis=0)
            least = SPILL * float(p.std())
            for cut in np.quantile(p, CUTS).tolist():
                spill = least
                if inner.shape[1]:  # what parts no more than LOSS of the links
                    spill = max(least, 1.001 * float(np.quantile(np.minimum(ends[1] - cut, cut - ends[0]), 1 - LOSS)))
                left, right = np.mean(p < cut + spill), np.mean(p >= cut - spill)
                work = left**2 + right**2
                if max(left, right) <= 0.9 and left + right <= 1.25 and work <= 0.9 and (best is None or work < best[0]):
                    best = work, d, cut, spill
            if best is not None and best[0] <= 0.75:
                break
        return best

    def node(rows: np.ndarray, inner: np.ndarray) -> int:
        nonlocal leaves
        best = split(rows, inner) if len(rows) > leaf_rows else None
        if best is not None:
            _, d, cut, spill = best
            k = len(dirs)
            dirs.append(d), cuts.append((cut, spill)), low.append(0), high.append(0)
            p, q = x[rows] @ d, x[inner] @ d
            low[k] = node(rows[p < cut + spill], inner[:, (q < cut + spill).all(axis=0)])
            high[k] = node(rows[p >= cut - spill], inner[:, (q >= cut - spill).all(axis=0)])
            return k
        leaves += 1
        return -leaves

    root = node(np.arange(len(x)), links)
    if root < 0:  # one leaf
        return Tree(np.zeros((0, x.shape[1])), np.zeros((0, 2)), np.zeros(0, int), np.zeros(0, int))
    return Tree(np.array(dirs), np.array(cuts), np.array(low), np.array(high))


def leaves_of(tree: Tree, x: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """[(rows, leaf)] of all vectors; spilled ones are in several leaves."""
    if not len(tree.low):
        return [(np.arange(len(x)), 0)]
    out, todo = [], [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if not len(rows):
            continue
        if k < 0:
            out.append((rows, -1 - k))
            continue
        p = x[rows] @ tree.direction[k]
        cut, spill = tree.threshold[k]
        todo += [(int(tree.low[k]), rows[p < cut + spill]), (int(tree.high[k]), rows[p >= cut - spill])]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """The rows brought to length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_embeddings(
    table: DataFrame,
    *,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``table``."""
    spark = table.sparkSession
    rows = table.select(
        F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("l")
    )
    fine = (
        F.col("i").isNotNull()
        & F.col("l").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        & F.exists("v", lambda e: e != 0)
    )
    valid = rows.where(fine).withColumn("dim", F.size("v"))
    # one class per label and vector; the members stay outside the comparison
    member = valid.groupBy("l", "dim", "v").agg(F.min("i").alias("c"), F.count_distinct("i").alias("n"))
    classes = durable(member, "vectors")
    dims = [r.dim for r in classes.select("dim").distinct().collect()]  # lengths of vectors, few
    edges, sums = None, None
    for dim in sorted(dims):
        one = classes.where(F.col("dim") == dim)
        count = one.count()
        rate = min(1.0, SAMPLE_ROWS / max(count, 1))
        sample = one.where(unit_hash(F.lit(SEED), F.col("c")) < rate).select("v", "c", "l").orderBy("c").limit(2 * SAMPLE_ROWS).toArrow()
        x = _matrix(sample.column("v").combine_chunks(), dim)
        x = unit_rows(x)
        # leaves hold LEAF_ROWS of the whole table, if the sample can tell so much
        leaf = max(8, int(LEAF_ROWS * len(x) / max(count, 1)))
        known = known_links(x, np.unique(sample.column("l").to_pylist(), return_inverse=True)[1], threshold)
        trees = spark.sparkContext.broadcast([grow(x, leaf, SEED + t, known) for t in range(TREES)])  # bounded by the sample
        e, s = _compare(one, dim, trees, threshold)
        edges, sums = (e, s) if edges is None else (edges.unionByName(e), sums.unionByName(s))
    if edges is None:
        nothing = F.lit(0).cast("long")
        return rows.select(F.col("i").alias(id_col), nothing.alias("n_links"), F.col("i").alias("component_id"), F.col("i").isNotNull().alias("kept"))
    comp = components(edges)
    per_class = (
        classes.join(sums.groupBy("c").agg(F.sum("links").alias("links")), "c", "left")
        .join(comp.withColumnRenamed("node", "c"), "c", "left")
        .select(
            "l", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("links"), F.coalesce("component", "c").alias("component")
        )
    )
    linked = rows.join(per_class.withColumn("ok", F.lit(True)), ["l", "v"], "left")
    use = fine & F.col("ok").isNotNull()
    component = F.when(use, F.col("component")).otherwise(F.col("i"))
    return linked.select(
        F.col("i").alias(id_col),
        F.when(use, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("i")).alias("kept"),
    )


def _compare(classes: DataFrame, dim: int, trees, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Spanning edges (a, b) and link sums (c, links) over one length of vectors."""

    def drop_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dim)
            unit = unit_rows(x)
            own: list[list[int]] = [[] for _ in range(len(x))]
            for t, tree in enumerate(trees.value):
                for rows, leaf in leaves_of(tree, unit):
                    for r in rows:
                        own[r].append(t << 32 | leaf)
            own = [sorted(o) for o in own]
            yield pa.RecordBatch.from_arrays(
                [b.column("l"), b.column("c"), b.column("n"), b.column("v"), pa.array(own, pa.list_(pa.int64()))], names=["l", "c", "n", "v", "own"]
            )

    placed = classes.select("l", "c", "n", "v").mapInArrow(drop_through, "l string, c long, n long, v array<double>, own array<bigint>")
    placed = durable(placed, "leaves")
    big = placed.select("l", F.explode("own").alias("leaf")).groupBy("l", "leaf").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    # at most TREES * (2 * SAMPLE_ROWS / leaf) leaves per label, and only the large ones
    big = big.select("l", "leaf", blocks.alias("k")).where("k > 1")
    spread = placed.select("*", F.explode("own").alias("leaf")).join(big, ["l", "leaf"], "left")
    own_block = F.pmod(F.xxhash64("c"), F.coalesce("k", F.lit(1))).cast("int")
    spread = spread.withColumn("own_block", own_block).withColumn(
        "pair",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1),
                lambda o: F.struct(F.least(o, F.col("own_block")).alias("x"), F.greatest(o, F.col("own_block")).alias("y")),
            )
        ),
    )

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, x0, y0 = int(pdf["leaf"].iloc[0]), int(pdf["px"].iloc[0]), int(pdf["py"].iloc[0])
        ids, n = pdf["c"].to_numpy(), pdf["n"].to_numpy()
        v = np.stack(pdf["v"].to_numpy())
        v = unit_rows(v)
        block = pdf["own_block"].to_numpy()
        # (row, leaf) of the leaves before this one that several rows here are in
        own = [np.asarray(o) for o in pdf["own"]]
        row, before = np.repeat(np.arange(len(ids)), [len(o) for o in own]), np.concatenate(own)
        row, before = row[before < leaf], before[before < leaf]
        _, code, uses = np.unique(before, return_inverse=True, return_counts=True)
        if (uses == len(ids)).any():  # all pairs meet in one of them
            return pd.DataFrame({"c": ids[:0], "links": ids[:0], "root": ids[:0]})

        def met(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            """Which of the rows r and c share a leaf before this one."""
            in_r, in_c = np.isin(row, r), np.isin(row, c)
            shared = np.intersect1d(code[in_r], code[in_c])
            out = np.zeros((len(r), len(c)), dtype=bool)
            for at in range(0, len(shared), 1024):
                part = shared[at : at + 1024]
                sides = []
                for rows, on in ((r, in_r), (c, in_c)):
                    sel = on & np.isin(code, part)
                    side = np.zeros((len(rows), len(part)), dtype=np.float32)
                    side[np.searchsorted(rows, row[sel]), np.searchsorted(part, code[sel])] = 1
                    sides.append(side)
                out |= sides[0] @ sides[1].T > 0
            return out

        links, group = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for at in range(0, len(ids), 512):
            near = v[at : at + 512] @ v[at:].T >= threshold
            near &= np.arange(near.shape[0])[:, None] < np.arange(near.shape[1])
            if x0 != y0:  # in the task of two blocks only pairs across them count
                near &= block[at : at + 512, None] != block[at:]
            r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(r):
                continue
            near = near[np.ix_(r, c)]
            r, c = r + at, c + at
            near &= ~met(r, c)
            links[r] += near @ n[c]
            links[c] += n[r] @ near
            for i, to in zip(r, near):
                if to.any():
                    touched = np.unique(np.append(group[c[to]], group[i]))
                    if len(touched) > 1:
                        group[np.isin(group, touched)] = touched[0]
        out = np.flatnonzero((links > 0) | (group != np.arange(len(ids))))
        return pd.DataFrame({"c": ids[out], "links": links[out], "root": ids[group[out]]})

    found = (
        spread.select("l", "leaf", "c", "n", "v", "own", "own_block", F.col("pair.x").alias("px"), F.col("pair.y").alias("py"))
        .groupBy("l", "leaf", "px", "py")
        .applyInPandas(within, "c long, links long, root long")
    )
    found = durable(found, "links")
    return (
        found.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b")),
        found.select("c", "links"),
    )

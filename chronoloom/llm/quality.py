"""Quality classifier: random-indexing word vectors and a small numpy network.

Words (lower-cased) and word shapes are hashed into ``BUCKETS`` rows.  Every
row owns a sparse ternary index vector; a row's word vector is the sum of the
index vectors of the words beside it, over all words of all documents (random
indexing).  A document is the pooled word vectors of its whole text: their mean
and spread, the mean of its own index vectors, and how far equal vectors add up
in it (in all, and between neighbours), with the logarithm of its length.  A network of
two layers maps this to one logit; it is trained on the driver on a sample of
at most ``TRAIN_ROWS`` labelled documents, and a temperature, fitted on a part
of the sample that training leaves out, calibrates the probability.

Bounded memory: each task sums contexts in one table of BUCKETS x DIM integers,
which are added up in two levels; the table that is sent to the tasks has that
size whatever the corpus.

Edge cases: null and blank texts have the zero vector and get the score that
the network gives it.  Rows with a null label, or several labels, teach with
each non-null one.  If the sample has one class only (or none), every score is
that class's share (or 0.5).  Repeated rows get equal scores; an empty table
gives no rows.  Other columns are ignored; labels are joined by id to the
training rows only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import TABLE_SCHEMA, added_tables, durable, small_batches, table_rows, unit_hash

BUCKETS, DIM, NONZERO = 1 << 14, 32, 2
#: Most labelled documents (about) that reach the driver.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, SEED = 32, 60, 256, 11
THRESHOLD = 0.3
FEATURES = 3 * DIM + 3
#: Entries of a worker's word cache; rows of a context block; pieces of the sum.
CACHE_WORDS, BLOCK, FANOUT = 400_000, 1 << 11, 32

_CLASSES = [(re.compile(p), r) for p, r in ((r"[^\W\d_A-ZÀ-Þ]+", "a"), (r"[A-ZÀ-Þ]+", "A"), (r"\d+", "9"))]


def _shape(word: str) -> str:
    for pattern, mark in _CLASSES:
        word = pattern.sub(mark, word)
    return word[:12]


class _Words(dict):
    """word -> bucket of the word, and of its shape, in one number."""

    def __missing__(self, word: str) -> int:
        shape = zlib.crc32(("\0" + _shape(word)).encode("utf-8", "replace")) % BUCKETS
        value = (zlib.crc32(word.lower().encode("utf-8", "replace")) % BUCKETS) << 20 | shape
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def _tokens(text: str | None, cache: _Words) -> tuple[np.ndarray, np.ndarray]:
    words = text.split() if text else []
    both = np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))
    return both >> 20, both & ((1 << 20) - 1)


def index_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places and signs of each row's nonzeros, and the dense table."""
    rng = np.random.default_rng(SEED)
    place = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    sign = rng.choice(np.array([-1.0, 1.0]), size=(BUCKETS, NONZERO))
    dense = np.zeros((BUCKETS, DIM), dtype=np.float32)
    np.put_along_axis(dense, place, sign.astype(np.float32), axis=1)
    return place, sign, dense


def _add_contexts(table: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, sign: np.ndarray) -> None:
    """Each word and shape gets the index vectors of the words and shapes beside it in its text."""
    words, shapes = (np.concatenate(x) for x in zip(*texts))
    starts = np.cumsum([len(w) for w, _ in texts])[:-1]
    beside = np.ones(len(words) - 1, dtype=bool)
    beside[starts - 1] = False  # the last word of a text and the first of the next
    flat = table.reshape(-1)
    pairs = [(words, shapes)]
    for x in (words, shapes):
        left, right = x[:-1][beside], x[1:][beside]
        pairs += [(left, right), (right, left)]
    for own, other in pairs:
        for k in range(NONZERO):
            flat += np.bincount(own * DIM + place[other, k], weights=sign[other, k], minlength=flat.size)


def word_vectors(docs: DataFrame, text_col: str) -> np.ndarray:
    """BUCKETS x DIM table of context sums over the whole corpus, rows of length 1."""
    small_batches(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign, _ = index_vectors()
        cache, table = _Words(), np.zeros((BUCKETS, DIM))
        held, n, seen = [], 0, False
        for b in batches:
            for t in b.column("t"):
                pair = _tokens(t.as_py(), cache)
                if len(pair[0]):
                    seen = True
                    held.append(pair)
                    n += len(pair[0])
                if n > 400_000:
                    _add_contexts(table, held, place, sign)
                    held, n = [], 0
        if held:
            _add_contexts(table, held, place, sign)
        if seen:
            yield from table_rows(table.reshape(-1), BLOCK * DIM, FANOUT)

    parts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(gather, TABLE_SCHEMA)
    total = added_tables(parts, BUCKETS * DIM, BLOCK * DIM, FANOUT).reshape(BUCKETS, DIM)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(words: np.ndarray, shapes: np.ndarray, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The document vector: word vectors' mean and spread, and the mean index vector."""
    if not len(words):
        return np.zeros(FEATURES, dtype=np.float32)
    rows, counts = np.unique(np.concatenate([words, shapes]), return_counts=True)
    share = (counts / counts.sum()).astype(np.float32)
    v = vectors[rows]
    mean = share @ v
    spread = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
    # how much the words' vectors add up instead of cancelling out: in all, and side by side
    each = np.unique(words, return_counts=True)[1] / len(words)
    beside = float(np.mean(words[1:] == words[:-1])) if len(words) > 1 else 0.0
    whole = [np.log(np.sum(each * each) * len(words)), beside, np.log(len(words))]
    return np.concatenate([mean, spread, share @ index[rows], np.array(whole, dtype=np.float32)])


def features(docs: DataFrame, vectors: np.ndarray, *, id_col: str, text_col: str) -> DataFrame:
    """(d, f): the document vectors as float32 bytes."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIM floats: 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (_, _, index) = _Words(), index_vectors()
        for b in batches:
            f = [pooled(*_tokens(t.as_py(), cache), sent.value, index).astype("<f4").tobytes() for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(f, pa.binary())], names=["d", "f"])

    src = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, "d long, f binary")


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the logistic loss; then the temperature on the tenth left out."""
    empty = Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(y) == 0 or y.min() == y.max():
        empty.constant = float(y.mean()) if len(y) else 0.5
        return empty
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    cut = max(1, len(y) // 10) if len(y) >= 50 else 0
    tx, ty, vx, vy = x[cut:], y[cut:], x[:cut], y[:cut]
    net = Network(
        tx.mean(0), tx.std(0) + 1e-4, rng.normal(size=(FEATURES, HIDDEN)) * np.sqrt(2 / FEATURES), np.zeros(HIDDEN),
        rng.normal(size=HIDDEN) * np.sqrt(1 / HIDDEN), 0.0,
    )
    z = (tx - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        rate = 0.003 * (1 - epoch / EPOCHS)
        perm = rng.permutation(len(ty))
        for at in range(0, len(ty), BATCH):
            rows = perm[at : at + BATCH]
            xb, yb = z[rows], ty[rows]
            h = np.maximum(xb @ params[0] + params[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60))) - yb) / len(rows)
            gh = np.outer(g, params[2]) * (h > 0)
            grads = [xb.T @ gh + 1e-4 * params[0], gh.sum(0), h.T @ g, np.array([g.sum()])]
            step += 1
            for k, p in enumerate(params):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    if cut and 0 < vy.mean() < 1:
        logits = net.logits(vx)
        loss = lambda t: np.mean(np.logaddexp(0, logits / t) - vy * logits / t)
        net.temperature = float(min(np.geomspace(0.3, 5, 60), key=loss))
    return net


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    learn: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, score, predicted) for every document.

    Word vectors are summed over all documents.  ``learn`` is a condition on
    the label rows, for held-out folds; labels serve training alone.
    """
    vectors = word_vectors(docs, text_col)
    known = durable(features(docs, vectors, id_col=id_col, text_col=text_col), "features")
    taught = labels.where(learn) if learn is not None else labels
    taught = taught.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("d"), F.col(label_col).cast("double").alias("y")
    )
    n = taught.count()
    rate = min(1.0, TRAIN_ROWS / max(n, 1))
    sample = taught.where(unit_hash(F.lit(SEED), F.col("d")) < rate).join(known, "d").orderBy("d", "y").limit(2 * TRAIN_ROWS)
    rows = sample.select("f", "y").toArrow()
    f = np.frombuffer(b"".join(rows.column("f").to_pylist()), dtype="<f4").reshape(-1, FEATURES)
    net = train(f, rows.column("y").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("f").to_pylist()), dtype="<f4").reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(net.probabilities(x), pa.float64())], names=["d", "s"])

    out = known.mapInArrow(run, "d long, s double")
    return out.select(
        F.col("d").alias(id_col), F.col("s").alias("score"), F.when(F.col("s") >= threshold, 1).otherwise(0).alias("predicted")
    )

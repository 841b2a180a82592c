"""Language ID by compression: the language whose dictionary packs a text best.

For every language a raw-content zstandard dictionary is cut from a bounded
sample of labelled documents.  A text is brought to lower-case words, encoded
in pieces against each dictionary, and the language with the fewest bytes
wins.  Pieces are short, so that a long text can't learn from itself more than
from the dictionary; all pieces of the whole text count.  A result is rejected
when the runner-up needs less than ``min_margin`` more bytes.

Edge cases: null texts and texts without a letter get ``und``, score 0, and
are rejected.  Ties go to the language first in code point order, with margin
0, hence rejected.  Repeated rows get equal results.  Languages that are null
teach nothing.  Without any learned language every result is ``und``.  An empty
table gives no rows.  Very long texts are encoded whole, piece by piece; of a text
that teaches, a slice is taken.  Other columns are ignored whatever their names; the
language column is only read for learning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import giving_back, kept_in_worker, small_batches, unit_hash

#: Documents sampled per language (about), and characters taken from each.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 600
DICT_BYTES, CHUNK_BYTES, LEVEL = 128 << 10, 1024, 3
MIN_MARGIN = 0.0005
#: Margin at which the score is about 0.73.
TEMPERATURE = 0.02

_NOT_WORD = re.compile(r"[\W\d_]+")


def normalised(text: str) -> bytes:
    """Lower-case words; empty without a letter (a character such as a half or a superscript is a number)."""
    words = _NOT_WORD.sub(" ", text.lower()).strip()
    if not words.isascii() and not any(map(str.isalpha, words)):
        return b""
    return words.encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageModel:
    dictionaries: tuple[tuple[str, bytes], ...]


def fit(docs: DataFrame, *, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Dictionaries from the labelled rows of ``docs`` that ``where`` admits.

    The sample is bounded: about SAMPLE_DOCS documents of each language,
    drawn evenly by a hash of the id, and of each a slice of SAMPLE_CHARS at a
    hashed place.  Nothing else is gathered.
    """
    rows = docs.where(where) if where is not None else docs
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"), F.col(id_col).alias("i")
    )
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel(())
    rate = F.coalesce(
        F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE_DOCS / n)))])[F.col("l")],
        F.lit(0.0),
    )
    room = F.greatest(F.lit(0), F.char_length("t") - SAMPLE_CHARS)
    # by id and text, so that rows of a null or repeated id are drawn one by one
    at = F.floor(unit_hash(F.lit(2), F.col("i"), F.col("t")) * (room + 1)).cast("int") + 1
    picked = rows.where(unit_hash(F.lit(1), F.col("i"), F.col("t")) < rate).select(
        "l", unit_hash(F.lit(3), F.col("i"), F.col("t")).alias("h"), F.substring("t", at, F.lit(SAMPLE_CHARS)).alias("s")
    )
    # equal rows are drawn together, so the bound is kept by a limit
    picked = picked.orderBy("h", "l", "s").limit(2 * SAMPLE_DOCS * len(counts))
    parts: dict[str, list[tuple[float, bytes]]] = {k: [] for k in counts}
    for r in picked.collect():
        parts[r.l].append((r.h, normalised(r.s)))
    return LanguageModel(tuple((k, b" ".join(b for _, b in sorted(v))[:DICT_BYTES]) for k, v in sorted(parts.items()) if v))


def _scorer(model: LanguageModel):
    import zstandard

    names, packers = [], []
    for name, raw in model.dictionaries:
        names.append(name)
        d = zstandard.ZstdCompressionDict(raw or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        packers.append(
            zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        )

    def score(text: str | None) -> tuple[str, float, float]:
        """(language or und, score, margin)"""
        data = normalised(text) if text else b""
        if not data or not names:
            return "und", 0.0, 0.0
        pieces = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        sizes = [sum(len(p.compress(x)) for x in pieces) for p in packers]
        best = min(range(len(sizes)), key=lambda k: (sizes[k], names[k]))
        over = [(s - sizes[best]) / sizes[best] for s in sizes]
        margin = min((over[k] for k in range(len(sizes)) if k != best), default=1.0)
        odds = sum(2.0 ** (-x / TEMPERATURE) for x in over)
        return names[best], 1.0 / odds, margin

    return score


def predict(
    docs: DataFrame,
    model: LanguageModel,
    *,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """``keep`` columns, lang_pred, score (0 to 1), margin and rejected, per row."""
    told, names = _told(docs, model, text_col, keep, min_margin)
    return told.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)],
        F.col("l").alias("lang_pred"),
        F.col("s").alias("score"),
        F.col("m").alias("margin"),
        F.col("r").alias("rejected"),
    )


def _told(docs: DataFrame, model: LanguageModel, text_col: str, keep: tuple[str, ...], min_margin: float) -> tuple[DataFrame, list[str]]:
    """The kept columns under names k0, k1, ..., with l, s, m and r."""
    small_batches(docs.sparkSession)
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    src = docs.select(*kept, F.col(f"`{text_col}`").cast("string").alias("t"))
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([f"{n} {src.schema[n].dataType.simpleString()}" for n in names] + ["l string, s double, m double, r boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = kept_in_worker(model, lambda: _scorer(model))
        for b in batches:
            out = [score(t.as_py()) for t in b.column("t")]
            lang, s, m = (list(x) for x in zip(*out)) if out else ([], [], [])
            rejected = [x == "und" or y < min_margin for x, y in zip(lang, m)]
            cols = [b.column(n) for n in names]
            cols += [pa.array(lang, pa.string()), pa.array(s, pa.float64()), pa.array(m, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "l", "s", "m", "r"])

    return src.mapInArrow(giving_back(run), schema), names


def keep_accepted(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is told clearly; columns as before."""
    cols = tuple(docs.columns)
    told, names = _told(docs, model, text_col, cols, min_margin)
    return told.where("NOT r").select(*[F.col(n).alias(c) for n, c in zip(names, cols)])

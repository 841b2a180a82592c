"""Packing documents into windows by minimum bin slack.

Every document is tokenised, an end id is added, and it is cut into pieces of
a full window and one shorter rest.  Full pieces are sequences of their own.
The rests are only known by length to the planner: a histogram of at most
``window - 1`` counts, which is all that reaches the driver, however many
documents there are.  From it, one window after another is filled by the
multiset of lengths that comes closest to the capacity: a bitset holds the
reachable sums (bounded counts by binary splitting), the best sum is the
highest bit, and the counts are traced back through the stored bitsets.  A
found pattern is applied as often as the counts allow at once, so the plan has
about as many patterns as there are lengths.

Pieces are then matched with the plan's places: a piece's rank among those of
its length comes from pre-aggregated counts per (length, salt), so that no
length, however common, is ranked in one task.

Edge cases: null text counts as empty and gives one piece with the end id
alone.  Repeated rows are packed each on their own; a null id is passed on.  An
empty table gives no rows.  Very long texts become many full pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.shared import durable, give_back, giving_back, kept_in_worker, small_batches

WINDOW, END_ID = 2048, 1
#: Ranks are counted within this many salts per length (a power of two).
SALTS = 1 << 10
#: Entries of a worker's word cache.
CACHE_WORDS = 600_000
#: Words missing from it that are encoded as one text.
JOINED_WORDS = 2000
#: Segments looked up at once, and bytes of texts encoded at once (one text at least).
BLOCK, PORTION = 1 << 18, 1 << 20

#: UTF-8 of white space of two and three bytes, as numbers.
_WIDE_SPACE = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
#: By byte: 1 for ASCII letters and digits, 2 for ASCII punctuation but the apostrophe, which may belong to what follows or stands before.
_KIND = np.array([1 if chr(c).isalnum() and c < 128 else 2 if 32 < c < 127 and c != 39 else 0 for c in range(256)], dtype=np.uint8)
#: One run of letters that any version of Unicode calls so.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba]+")
#: ByteLevel's characters for bytes that are not printed as themselves.
_BYTE_CHARS = {c: 256 + i for i, c in enumerate(c for c in range(256) if not (33 <= c < 127 or 161 <= c < 173 or 174 <= c))}


def segment_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Places in UTF-8 ``data`` in front of which the tokenizer's pattern always ends a match and looks no further.

    These are the starts of texts (``texts``, offsets), of runs of white space
    that start with a blank or line end, and of punctuation behind an ASCII
    letter or digit.
    """
    is_start = (data == 0x20) | (data == 0x0A)
    is_start[1:] &= data[:-1] > 0x20
    at = np.flatnonzero(is_start)
    at = at[data[at - 1] >= 0x80]
    two = data[at - 2].astype(np.int64) << 8 | data[at - 1]
    is_start[at[np.isin(two, _WIDE_SPACE) | np.isin(data[at - 3].astype(np.int64) << 16 | two, _WIDE_SPACE)]] = False
    kind = _KIND[data]
    is_start[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
    is_start[texts[texts < len(data)]] = True
    return np.flatnonzero(is_start)


class WordTokenizer:
    """Ids of whole texts through a bounded cache of words.

    Texts are cut where the tokenizer's pattern always ends a match and looks
    no further: in front of white space, and of punctuation behind a letter.
    Each segment, mostly a word with its blank, has ids of its own.  Segments
    are cut and numbered by array operations; only the different ones of a
    block are looked up.  Of those that are not in the cache, runs of letters
    go to the tokenizer's model, as they are one match; others are joined by
    line ends, which are tokens of their own between words, and encoded many at
    once.  Texts with the name of a special token are encoded as a whole.
    """

    def __init__(self, path: str, cache_words: int | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the names of special tokens in a text are these tokens, whatever stands beside them
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}  # ids of segments
        self.cache_words = cache_words or CACHE_WORDS
        self.line_end = self.whole(["\n"])[0]
        split = self.tokenizer.pre_tokenizer
        byte_level = type(split).__name__ == "ByteLevel" and split.use_regex and not split.add_prefix_space and self.tokenizer.normalizer is None
        self.model = self.tokenizer.model if byte_level else None

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def joined(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space but a blank in front, joined by line ends and encoded at once, as a call for each costs more than its ids."""
        ids = np.frombuffer(self.whole(["\n".join(words)])[0], dtype="<u4")
        ends = np.flatnonzero(ids == np.frombuffer(self.line_end, dtype="<u4")[0])
        if len(ends) != len(words) - 1:
            return self.whole(words)
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)])]

    def learn(self, segments: list[bytes]) -> None:
        """Puts segments and their ids into the cache."""
        others: dict[str, list[tuple[bytes, str]]] = {" ": [], "\n": [], "": [], "odd": []}
        cache, tokenize = self.cache, self.model.tokenize if self.model else None
        for s in segments:
            if tokenize and s[:1] == b" " and s[1:].isalpha():  # ASCII letters
                cache[s] = array("I", [t.id for t in tokenize("\u0120" + s[1:].decode())]).tobytes()
                continue
            text = s.decode()
            blank = text[0] if text[0] in " \n" else ""
            word = text[len(blank) :]
            if tokenize and blank != "\n" and _LETTERS.fullmatch(word):
                cache[s] = array("I", [t.id for t in tokenize(s.decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
                continue
            plain = word.split() == [word]
            others[blank if plain else "odd"].append((s, text if not plain or blank == " " else word))
        for kind, found in others.items():
            front = self.line_end if kind == "\n" else b""
            for at in range(0, len(found), JOINED_WORDS):
                part, texts = zip(*found[at : at + JOINED_WORDS])
                ids = self.whole(list(texts)) if kind == "odd" else self.joined(list(texts))
                cache.update(zip(part, [front + x for x in ids] if front else ids))

    def ids_of(self, segments: list[bytes]) -> list[bytes]:
        cache = self.cache
        if len(cache) > self.cache_words:
            for s in list(islice(cache, len(cache) // 2)):
                del cache[s]  # the older half
        self.learn([s for s in segments if s not in cache])
        return list(map(cache.__getitem__, segments))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text, as bytes; a null counts as empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = texts.fill_null("").cast(pa.large_string())
        special = np.zeros(len(texts), dtype=bool)
        for name in self.special:
            special |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        if special.any():
            out = np.empty(len(texts), dtype=object)
            out[special] = self.whole(texts.filter(pa.array(special)).to_pylist())
            if not special.all():
                out[~special] = self.encode(texts.filter(pa.array(~special)))
            return out.tolist()
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, dtype=np.int64)
        if ends[-1] == ends[0]:
            return [b""] * len(texts)
        data = data.slice(int(ends[0]), int(ends[-1] - ends[0]))
        ends = ends - ends[0]
        starts = segment_starts(np.frombuffer(data, dtype=np.uint8), ends)
        first = np.searchsorted(starts, ends)  # segment of each text
        starts = np.append(starts, len(data))
        parts, before = [], [np.zeros(1, dtype=np.int64)]
        for at in range(0, len(starts) - 1, BLOCK):
            own = starts[at : at + BLOCK + 1]
            segments = pa.Array.from_buffers(pa.large_binary(), len(own) - 1, [None, pa.py_buffer(own), data]).dictionary_encode()
            which = segments.indices.to_numpy()
            ids = self.ids_of(segments.dictionary.to_pylist())
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            many = sizes[which]
            upto = np.cumsum(many)
            place = np.repeat((np.cumsum(sizes) - sizes)[which] - (upto - many), many)
            place += np.arange(upto[-1])
            parts.append(flat[place])
            before.append(upto + before[-1][-1])
        found, cut = np.concatenate(parts), np.concatenate(before)[first].tolist()
        return [found[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def worker_tokenizer(path: str, cache_words: int | None = None) -> WordTokenizer:
    """One tokenizer and word cache per Python worker, kept from task to task until another operator's tasks come."""
    return kept_in_worker(("tokenizer", path, cache_words), lambda: WordTokenizer(path, cache_words))


_PIECE = "d long, start long, length long, crc long, total long"


def pieces(docs: DataFrame, tokenizer_path: str, *, window: int, end_id: int, id_col: str, text_col: str, cache_words: int | None = None) -> DataFrame:
    """(d, start, length, crc, total) for each piece of each document."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(tokenizer_path, cache_words)
        for b in batches:
            ids, texts, out = b.column("d").to_pylist(), b.column("t"), [[], [], [], [], []]
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PORTION, "right")))
                for k, data in enumerate(tok.encode(texts.slice(at, to - at)), at):
                    data += end
                    total = len(data) // 4
                    for start in range(0, total, window):
                        part = data[4 * start : 4 * (start + window)]
                        for col, v in zip(out, (ids[k], start, len(part) // 4, zlib.crc32(part), total)):
                            col.append(v)
                at = to
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["d", "start", "length", "crc", "total"])
            if cache_words:  # memory is short
                give_back()

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")).mapInArrow(giving_back(run), _PIECE)


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is closest below capacity.

    Long lengths are tried first, so that they are used while short ones are
    left to fill gaps.  The longest length present is always part of the fill.
    """
    order = sorted(counts, reverse=True)
    first = order[0]
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1 << first, []
    goal = 1 << capacity
    for length in order:
        left = min(counts[length] - (length == first), (capacity - first) // length)
        size = 1
        while left > 0 and not reach & goal:
            n = min(size, left)
            steps.append((length, n, reach))
            reach = (reach | reach << (n * length)) & full
            left -= n
            size *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    fill = {first: 1}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            total -= n * length
            fill[length] = fill.get(length, 0) + n
    return fill


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(how often, {length: pieces per window})] that uses up all counts."""
    left, plan = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        fill = closest_fill(left, capacity)
        times = min(left[k] // n for k, n in fill.items())
        plan.append((times, fill))
        for k, n in fill.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return plan


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache_words: int | None = None,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    Fewer ``cache_words`` (CACHE_WORDS if not given) take less memory of each
    worker and more time; the ids are the same.
    """
    spark = docs.sparkSession
    cut = durable(pieces(docs, tokenizer_path, window=window, end_id=end_id, id_col=id_col, text_col=text_col, cache_words=cache_words), "pieces")
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("d", "start", "crc"), F.lit(SALTS)).cast("int"))
    per_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # one row per length and salt at most; each length's window has SALTS rows
    lower = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per_salt = durable(per_salt.withColumn("below", F.coalesce(F.sum("n").over(lower), F.lit(0))), "salts")
    counts = {r.length: r.n for r in per_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    n_full = counts.pop(window, 0)
    # (length, first rank, end, pieces per window, first sequence, place of its first piece)
    places, sequence = [(window, 0, n_full, 1, 0, 0)] if n_full else [], n_full
    used: dict[int, int] = dict.fromkeys(counts, 0)
    for times, fill in plan_windows(counts, window):
        offset = 0
        for length in sorted(fill, reverse=True):
            n = fill[length]
            places.append((length, used[length], used[length] + times * n, n, sequence, offset))
            used[length] += times * n
            offset += n * length
        sequence += times
    # at most `window` lengths times their patterns, whatever the input's size
    where = spark.createDataFrame(places, "pl int, lo long, hi long, per long, seq long, off long")
    rank = Window.partitionBy("length", "salt").orderBy("d", "start", "crc")
    ranked = (
        salted.withColumn("in_salt", F.row_number().over(rank) - 1)
        .join(F.broadcast(per_salt.select("length", "salt", "below")), ["length", "salt"])
        .withColumn("r", F.col("below") + F.col("in_salt"))
    )
    at = F.col("r") - F.col("lo")
    return ranked.join(
        F.broadcast(where), (F.col("length") == F.col("pl")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))
    ).select(
        F.col("d").alias(id_col),
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        F.col("total").alias("doc_tokens"),
        (F.col("seq") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("off") + F.expr("pmod(r - lo, per)") * F.col("length")).cast("long").alias("offset"),
    )

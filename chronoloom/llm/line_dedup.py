"""Line dedup by an exact set-similarity join, in DataFrame code only.

A line is the set of its words (lower-cased, cut at white space).  A line is
removed if an earlier line, by document id and then by position, has a Jaccard
similarity of at least ``num / den``.

* The words of every line are cut and hashed once; what follows reads the hashes.
* Rarity: the words of all lines are counted, once a line, in a hashed table of
  fixed size, which keeps the logarithm of each bucket's count.
  A token is one long: that class in front, the word's hash behind, so sorting a
  line's tokens sorts them by rarity, and equal words have equal tokens
  everywhere.  The classes only decide the order, so they cost no match.
* Equal sets are settled first, by 128 bits of hash and pre-aggregated smallest
  ids.
* Near copies are settled next.  A line has NEIGHBOURS keys: of all pairs of
  neighbours among its rare tokens those with the least hashes, so that copies
  with other changes, whose changed words may all be rare, still choose the same
  ones.  Of the lines that share a key, each is compared with one of the earliest
  of LEADS shares, the likeliest by its parities.  A line found this way stays
  in the index, as an earlier line may be a match of a later one, but is no
  longer searched for, so a group of n near copies costs about n pairs.
* Prefix filter: similar lines share a token among the first
  ``n - ceil(t * n) + 1``; those are the index.  Its keys hold a stratum of the
  length, so that lines of too different lengths do not meet.  Lines that meet
  go through the length and the positional filter, and through the parities of
  the tokens (of 128 bits if both are long), which bound the overlap.  Entries of
  very common tokens are dealt in pairs of blocks.
* Candidates are verified on their whole sets.

Edge cases: null texts stay null; blank lines hold no words and always stay;
rows that repeat an id have lines at the same place, of which none is later, so
they do not remove each other's, and a place is removed from all of them if any
line there has an earlier match; rows with a null id are passed through as they
are.  Ids of any type that can be ordered serve.  Other columns are kept,
whatever their names.  Very long texts and lines are compared whole.  A document
may end up with an empty text.  Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import discard, durable, small_side

#: Pairs of neighbouring rare tokens by which near copies find the earliest line.
NEIGHBOURS = 3
LEADS = 4
#: Lines of more words have parities of 128 bits.
LONG_LINE = 64
#: Documents whose words are counted, about; None for all.
RARITY_DOCS: int | None = None
#: Buckets of the table of rarity classes (a byte each), and of one row of it.
BUCKETS, BLOCK = 1 << 16, 1 << 10
#: Tokens of a class above this one (2 ** this many uses) are dealt in blocks.
SALT_CLASS = 15

_BLANKS = "\t\x0b\x0c\r"
_CLASS_BIT = 57


def plain(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the text ``name`` lower-cased and every blank within lines a space; only functions on whole strings."""
    df = df.withColumn(name, F.lower(name))
    for c in _BLANKS:  # replacing costs several times as much as looking
        df = df.withColumn(name, F.when(F.contains(name, F.lit(c)), F.replace(name, F.lit(c), F.lit(" "))).otherwise(F.col(name)))
    return df


def lines_of(src: DataFrame) -> DataFrame:
    """(d, pos, line) of every line with words of the texts (d, t), made plain."""
    # blank lines go by their text: a condition on the tokens would make them twice,
    # as would the condition on the array's size that an inner explode brings
    return plain(src, "t").select("d", F.posexplode_outer(F.split("t", "\n")).alias("pos", "line")).where(F.btrim("line") != "")


def hashes(line: Column) -> Column:
    """The hashes of the distinct words of a plain line; neighbouring spaces have an empty one between them."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))


def hashed_lines(src: DataFrame) -> DataFrame:
    """(d, pos, hs) of every line with words of the texts (d, t)."""
    return lines_of(src).select("d", "pos", hashes(F.col("line")).alias("hs"))


def rarity_classes(cut: DataFrame, share: int = 1) -> Column:
    """An array constant: per bucket the rounded log2 of its count of words, told from the hashed lines of one in ``share`` documents."""
    cut = cut.where(F.pmod(F.xxhash64("d"), F.lit(share)) == 0) if share > 1 else cut
    each = cut.select(F.explode_outer("hs").alias("h")).where("h IS NOT NULL").select(_bucket(F.col("h")).cast("int").alias("b"))
    # every bucket once more, so that none is missing
    every = cut.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    counts = each.unionByName(every).groupBy("b").agg((F.count("*") - 1).alias("n"))
    marks = counts.select("b", F.ceil(F.log2(F.greatest(F.col("n") * share, F.lit(1)))).alias("c")).groupBy(F.floor(F.col("b") / BLOCK).alias("k"))
    rows = marks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "c"))), lambda x: x["c"].cast("string")), ",").alias("s"))
    # BUCKETS numbers in all; long, so that none is cast word by word
    return F.from_json(F.lit("[" + ",".join(r.s for r in rows.orderBy("k").collect()) + "]"), "array<tinyint>").cast("array<bigint>")


def tokens(hs: Column, classes: Column) -> Column:
    """The sorted distinct tokens of a line's hashes, rare ones first."""

    def ranked(h: Column) -> Column:
        rank = F.call_function("shiftleft", F.get(classes, _bucket(h)), F.lit(_CLASS_BIT))
        # never null, which lets the array be sorted as plain numbers
        return F.coalesce(rank.bitwiseOR(F.shiftrightunsigned(h, 64 - _CLASS_BIT)), F.lit(0).cast("long"))

    return F.sort_array(F.transform(hs, ranked))


def _least_whole(n: Column, num: int, den: int) -> Column:
    """ceil(n * num / den) in whole numbers."""
    return F.call_function("div", n * num + (den - 1), F.lit(den))


def _need(na: Column, nb: Column, num: int, den: int) -> Column:
    """Smallest overlap of two similar sets of these sizes."""
    return _least_whole(na + nb, num, num + den)


def _pos(place: Column) -> Column:
    return F.shiftright(place, 32).cast("int")


def _size(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 32) - 1))


def _later(ad: Column, ap: Column, bd: Column, bp: Column) -> Column:
    """Whether the line b stands behind a; ``ap`` and ``bp`` are places or positions of equal make."""
    return (ad < bd) | ((ad == bd) & (ap < bp))


def line_facts(cut: DataFrame, classes: Column, num: int, den: int) -> DataFrame:
    """Per hashed line: d, place (position and set size in one long), hashes and parities of the set, its prefix, and the keys of near copies."""
    n = F.size("t").cast("long")
    place = F.call_function("shiftleft", F.col("pos").cast("long"), F.lit(32)).bitwiseOR(n)
    prefix = F.slice("t", F.lit(1), (n - _least_whole(n, num, den) + 1).cast("int"))
    zero = F.lit(0).cast("long")
    parity = lambda t: F.aggregate(t, zero, lambda x, y: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), y.bitwiseAND(F.lit(63)).cast("int"))))
    bits = parity("t")
    more = F.when(n > LONG_LINE, parity(F.filter("t", lambda x: x.bitwiseAND(F.lit(64)) != 0))).otherwise(zero)
    facts = cut.select("d", "pos", tokens(F.col("hs"), classes).alias("t"))
    facts = facts.select("d", place.alias("place"), F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), bits.alias("bits"), more.alias("more"), prefix.alias("p"))
    # the least hashes, as the first pairs of near copies differ where their changed words are the rarest
    two = F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get("p", i), x))
    return facts.select("*", F.slice(F.sort_array(two), 1, NEIGHBOURS).alias("ks"))


def equal_sets(facts: DataFrame) -> DataFrame:
    """(d, place) of the lines whose set an earlier line has."""
    seen = facts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("d").alias("md")).where("n > 1").drop("n")
    seen = durable(seen, "seen")
    repeats = durable(facts.select("d", "place", "h1", "h2").join(small_side(seen), ["h1", "h2"]), "repeats")
    first = durable(repeats.where("d = md").groupBy("h1", "h2").agg(F.min("place").alias("mp")), "first")
    equal = repeats.join(small_side(first), ["h1", "h2"]).where(_later(F.col("md"), _pos(F.col("mp")), F.col("d"), _pos(F.col("place"))))
    equal = durable(equal.select("d", "place").distinct(), "equal")
    discard(repeats, seen, first)
    return equal


def lead_pairs(lines: DataFrame, num: int, den: int) -> DataFrame:
    """(ad, ap, bd, bp): lines with the earliest ones that have the same two neighbouring rare tokens."""
    keyed = lines.select("d", "place", "bits", F.explode_outer("ks").alias("k")).where("k IS NOT NULL")
    # the earliest of each of LEADS shares of the group; which of its document's lines leads is of no matter
    share = F.pmod(F.xxhash64("d", "place"), F.lit(LEADS)).cast("int")
    mine = [F.when(share == i, F.col("d")) for i in range(LEADS)]
    firsts = [f for i, d in enumerate(mine) for f in (F.min(d).alias(f"d{i}"), F.min_by("place", d).alias(f"p{i}"), F.min_by("bits", d).alias(f"b{i}"))]
    lead = keyed.groupBy("k").agg(F.count("*").alias("n"), *firsts).where("n > 1")
    leads = [F.when(F.col(f"d{i}").isNotNull(), F.struct(F.col(f"d{i}").alias("ad"), F.col(f"p{i}").alias("ap"), F.col(f"b{i}").alias("bits"))) for i in range(LEADS)]
    lead = durable(lead.select("k", F.array_compact(F.array(*leads)).alias("leads")), "leads")
    n = _size(F.col("place"))

    def may_match(x: Column) -> Column:
        m = _size(x["ap"])
        need = _need(m, n, num, den)
        return _later(x["ad"], _pos(x["ap"]), F.col("d"), _pos(F.col("place"))) & (need <= F.least(m, n)) & (x["apart"] <= m + n - 2 * need)

    # the lead whose parities differ least; a line that it does not match is found by the index, if another line matches it
    apart = F.transform("leads", lambda x: F.struct(F.bit_count(x["bits"].bitwiseXOR(F.col("bits"))).alias("apart"), x["ad"].alias("ad"), x["ap"].alias("ap")))
    met = keyed.join(small_side(lead), "k").select("d", "place", F.array_min(F.filter(apart, may_match)).alias("l")).where("l IS NOT NULL")
    met = met.groupBy("d", "place").agg(F.min_by("l.ad", "l.apart").alias("ad"), F.min_by("l.ap", "l.apart").alias("ap"))
    met = durable(met.select("ad", "ap", F.col("d").alias("bd"), F.col("place").alias("bp")), "led")
    discard(lead)
    return met


def entries(lines: DataFrame, num: int, den: int) -> DataFrame:
    """The index: (k, d, place, bits, more, at).

    A key is a token with a stratum of lengths, and for a very common token a
    pair of blocks of its lines.  A line is at home in the stratum of its
    length and visits the one below if a similar line can be there.  ``at`` is
    four times the token's place in its line, plus two if the line is at home,
    plus one if it is still searched for.
    """
    width = 3 * math.log(max(den / num, 1.05))
    stratum = lambda n: F.floor(F.log(n) / width).cast("int")
    n = _size(F.col("place"))
    # no place is null; said here, it is not asked on one side of the join only, which would keep the sides from sharing a shuffle
    each = lines.where("place IS NOT NULL").withColumn("home", stratum(n)).withColumn("least", stratum(_least_whole(n, num, den)))
    each = each.select("d", "place", "bits", "more", "searched", "home", F.explode(F.sequence("least", "home")).alias("s"), "p")
    each = each.select("*", F.posexplode("p").alias("i", "tok"))
    at = F.col("i") * 4 + F.when(F.col("s") == F.col("home"), 2).otherwise(0) + F.col("searched")
    row = ["d", "place", "bits", "more", at.alias("at")]
    rank = F.shiftrightunsigned("tok", _CLASS_BIT).cast("int")
    few = each.where(rank <= SALT_CLASS).select(F.xxhash64("tok", "s").alias("k"), *row)
    # tokens are sorted: the last is the most common one
    many = each.where((F.shiftrightunsigned(F.get("p", F.size("p") - 1), _CLASS_BIT) > SALT_CLASS) & (rank > SALT_CLASS))
    blocks = F.call_function("shiftleft", F.lit(1), rank - SALT_CLASS)
    many = many.withColumn("own", F.pmod(F.xxhash64("d", "place"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = F.xxhash64("tok", "s", F.least("own", "other"), F.greatest("own", "other"))
    return few.unionByName(many.select(pair.alias("k"), *row))


def index_pairs(lines: DataFrame, num: int, den: int) -> DataFrame:
    """(ad, ap, bd, bp) of the lines that meet and may be similar; b is the later one and still searched for.

    The shorter line s of a pair, or the earlier of two equally long ones, is met
    at home and among its first tokens only: those that have the least overlap
    with a line as long, which any longer one has too, at or behind them.
    """
    index = entries(lines, num, den).repartition("k")
    n = _size(F.col("place"))
    first = (F.col("at").bitwiseAND(F.lit(2)) == 2) & (_need(n, n, num, den) <= n - F.shiftright("at", 2))
    # random, so that it stays behind the shuffle, which both sides then share; a row too many does no harm
    s, l = index.where(first | (F.rand(0) < 1e-18)).alias("s"), index.alias("l")
    ns, nl = _size(F.col("s.place")), _size(F.col("l.place"))
    need = _need(ns, nl, num, den)
    # a pair's first common token has all of the overlap at or behind it
    behind = F.least(ns - F.shiftright("s.at", 2), nl - F.shiftright("l.at", 2))
    # a parity that differs is a token of one side; long lines have one of 128 bits: ``more`` and the rest of ``bits``
    bits, more = F.col("s.bits").bitwiseXOR(F.col("l.bits")), F.col("s.more").bitwiseXOR(F.col("l.more"))
    both_long = F.least(ns, nl) > LONG_LINE
    apart = F.when(both_long, F.bit_count(more) + F.bit_count(bits.bitwiseXOR(more))).otherwise(F.bit_count(bits))
    l_later = _later(F.col("s.d"), _pos(F.col("s.place")), F.col("l.d"), _pos(F.col("l.place")))
    s_later = _later(F.col("l.d"), _pos(F.col("l.place")), F.col("s.d"), _pos(F.col("s.place")))
    searched = lambda side: F.col(f"{side}.at").bitwiseAND(F.lit(1)) == 1
    wanted = F.when(l_later, searched("l")).otherwise((ns < nl) & s_later & searched("s"))
    met = s.join(l, (F.col("s.k") == F.col("l.k")) & (ns <= nl) & (need <= behind) & (apart <= ns + nl - 2 * need) & wanted)
    ends = [F.when(l_later, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")).alias(name) for a, b, c, name in (("s", "l", "d", "ad"), ("s", "l", "place", "ap"), ("l", "s", "d", "bd"), ("l", "s", "place", "bp"))]
    return met.select(*ends).distinct()


def verified(pairs: DataFrame, src: DataFrame, num: int, den: int) -> DataFrame:
    """(d, place) of the later lines of those pairs whose whole sets are similar."""
    sides = F.array(F.struct(F.col("ad").alias("d"), F.col("ap").alias("place"), F.lit(0).alias("side")), F.struct(F.col("bd").alias("d"), F.col("bp").alias("place"), F.lit(1).alias("side")))
    ends = pairs.select("ad", "ap", "bd", "bp", F.explode(sides).alias("e"))
    ends = ends.select("ad", "ap", "bd", "bp", "e.d", _pos(F.col("e.place")).alias("pos"), "e.side")
    wanted = durable(ends.groupBy("d").agg(F.collect_set("pos").alias("at")), "ends")
    cut = src.join(small_side(wanted), "d").select("d", "at", F.split("t", "\n").alias("lines"))
    # the second use of the lines keeps them cut once a text
    each = F.when(F.size("lines") > 0, F.transform("at", lambda i: F.struct(i.alias("pos"), F.get("lines", i).alias("line"))))
    some = plain(cut.select("d", F.explode_outer(each).alias("e")).select("d", "e.pos", "e.line"), "line").select("d", "pos", hashes(F.col("line")).alias("s"))
    sets = some.join(small_side(ends), ["d", "pos"])
    both = sets.groupBy("ad", "ap", "bd", "bp").agg(
        F.collect_set(F.when(F.col("side") == 0, F.col("s"))).alias("x"), F.collect_set(F.when(F.col("side") == 1, F.col("s"))).alias("y")
    )

    def similar(x: Column, y: Column) -> Column:
        o = F.size(F.array_intersect(x, y))
        return o * den >= (F.size(x) + F.size(y) - o) * num

    # a side has several sets only if rows repeat its id
    both = both.where(F.exists("x", lambda x: F.exists("y", lambda y: similar(x, y))))
    found = durable(both.select(F.col("bd").alias("d"), F.col("bp").alias("place")).distinct(), "matched")
    discard(wanted)
    return found


def later_matches(docs: DataFrame, *, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, pos) of the lines that an earlier line matches."""
    src = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    bare = {"parquet.enable.dictionary": "false"}  # hashes hardly repeat, so a dictionary of them only costs time
    share = -(-docs.count() // RARITY_DOCS) if RARITY_DOCS else 1
    cut = durable(hashed_lines(src), "words", bare)
    facts = durable(line_facts(cut, rarity_classes(cut, share), num, den), "lines", bare)
    discard(cut)
    equal = equal_sets(facts)
    led = lead_pairs(facts.join(small_side(equal), ["d", "place"], "left_anti"), num, den)
    near = verified(led, src, num, den)
    out = equal.withColumn("searched", F.lit(None).cast("int")).unionByName(near.withColumn("searched", F.lit(0)))
    lines = facts.join(small_side(out.withColumn("out", F.lit(True))), ["d", "place"], "left").where("out IS NULL OR searched IS NOT NULL")
    lines = lines.select("d", "place", "bits", "more", "p", F.coalesce("searched", F.lit(1)).alias("searched"))
    more = durable(index_pairs(lines, num, den), "linepairs")
    discard(facts, led)
    late = verified(more, src, num, den)
    gone = equal.unionByName(near).unionByName(late).select("d", _pos(F.col("place")).alias("pos"))
    gone = durable(gone.distinct(), "removed")
    discard(equal, near, more, late)
    return gone


def remove_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its columns, without the matched lines; then the number of lines and of removed ones.

    These two are called ``n_lines`` and ``n_removed``, with underscores in
    front while such a column is in ``docs`` already.
    """
    gone = later_matches(docs, id_col=id_col, text_col=text_col, **options)
    per_doc = durable(gone.groupBy(F.col("d")).agg(F.collect_set("pos").alias("gone")), "perdoc")
    discard(gone)
    # by number, so that no name of the input can clash
    cols = list(docs.columns)
    at_id, at_text = f"c{cols.index(id_col)}", f"c{cols.index(text_col)}"
    joined = docs.toDF(*[f"c{i}" for i in range(len(cols))]).join(small_side(per_doc), F.col(at_id) == F.col("d"), "left")
    whole = F.col(at_text).cast("string")
    # cut once per document; only texts that lose lines are put together again
    cut = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(whole, "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    breaks = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit("")))
    figures = []
    for name in ("n_lines", "n_removed"):
        while name in cols:
            name = "_" + name
        figures.append(name)
    return cut.select(
        *[text.alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(cols)],
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias(figures[0]),
        F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias(figures[1]),
    )


def dedup_documents(docs: DataFrame, *, length_col: str = "n_chars", **options) -> DataFrame:
    """The documents with the same columns; ``length_col``, if there, follows the text."""
    text_col, cols = options.get("text_col", "text"), list(docs.columns)
    out = remove_lines(docs, **options)
    removed = F.col(f"`{out.columns[-1]}`")
    shown = []
    for c in cols:
        col = F.col(f"`{c}`")
        if c == length_col:
            col = F.when(removed > 0, F.char_length(F.col(f"`{text_col}`"))).otherwise(col).cast(docs.schema[c].dataType).alias(c)
        shown.append(col)
    return out.select(*shown)

"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words.  With ``r = target / source size``, every
document is taken ``floor(r)`` whole times for certain, and the rest of the
target is filled by a sample without replacement of a fixed number of words.
Documents have unequal inclusion probabilities ``p = min(1, c * w)``: w is a
weight column, or else the square root of the document's size, so that longer
documents are likelier; c is solved for each source so that the expected words
are those wanted, from sums over steps of w.  Documents are ranked by the Pareto
variable ``odds(u) / odds(p)``, where u is a uniform number made from the
document's id, and the first in that order are selected up to the words still
wanted; those with p = 1 come first.  The document at the boundary is taken if that
comes closer to the target; otherwise the small gap left is filled with a few
unselected documents, the largest that fit first.

Nothing is gathered per source: ranks are found by two levels of histograms
over ``q / (1 + q)``, pre-aggregated on the map side, so that only the few
documents inside one of ``BINS * BINS`` cells per source are ordered by a
window.  A source may therefore hold any share of all rows.

Edge cases: a null or blank text has size 0 and takes 0 words; a null source is
a source of its own, weighed after all others; sources of size 0 have target 0.
Repeated rows are separate documents: the second and further ones are drawn by
id and number; which of the equal rows is which does not matter.  A null id is
hashed as a value of its own.  A null or negative weight counts as 0.  Very long
texts are counted whole.  Other columns are passed on whatever their names.
Empty tables give no rows.  The result does not depend on partitioning, so
reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.shared import WORD_REGEX, durable, small_side, unit_hash

BINS = 1 << 12
#: Documents of each size class (power of two) per source that may fill the gap.
FILL = 8


def n_words(text: Column) -> Column:
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, most: float) -> dict:
    """Target words per source: water-filling of ``share`` of all words.

    Sources in code point order, null last, get the weights in turn.  A target
    stops at ``most`` times its source's size; what is over is shared again
    among the others by weight.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    size = {k: n for k, n in order}
    weight = {k: float(weights[i % len(weights)]) for i, (k, _) in enumerate(order)}
    left, open_, out = share * sum(size.values()), list(size), {}
    while open_:
        total = sum(weight[k] for k in open_)
        full = [k for k in open_ if left * weight[k] / total > most * size[k]]
        if not full:
            out.update({k: left * weight[k] / total for k in open_})
            break
        for k in full:
            out[k] = most * size[k]
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in out]
    return out


def scale(steps: Sequence[tuple[float, float]], rest: float) -> float:
    """c, so that sum(min(1, c * w) * words) over the steps (w, words) is ``rest``, or all words if that is more."""
    steps = sorted((w, n) for w, n in steps if w > 0 and n > 0)
    certain, part = 0.0, sum(w * n for w, n in steps)
    for w, n in reversed(steps):  # the heaviest are certain first
        c = (rest - certain) / part
        if c * w <= 1:
            return max(0.0, c)
        certain, part = certain + n, part - w * n
        if part <= 0:
            break
    return 2.0 / steps[0][0] if steps else 0.0


def numbered(slim: DataFrame) -> DataFrame:
    """(_row, _nth) of the second and further of equal rows.

    Equal rows are numbered by the parts of the written table that they lie in,
    from one count for each, so that a row repeated very often is in no single task.
    """
    key = ["_id", "_src", "_size", "_tie"]
    part = F.shiftright("_row", 33)
    counts = durable(slim.groupBy(*key, part.alias("_part")).agg(F.count("*").alias("_m")), "mixparts")
    again = counts.groupBy(*key).agg(F.sum("_m").alias("_m")).where("_m > 1").drop("_m").select(*[F.col(c).alias(f"{c}2") for c in key])
    same = lambda: reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}2")) for c in key))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = durable(counts.join(again, same(), "left_semi").withColumn("_before", before), "mixstarts")
    start = start.select(*[F.col(c).alias(f"{c}2") for c in key], F.col("_part").alias("_part2"), "_before")
    rows = slim.select("_row", *key, part.alias("_part")).join(start, same() & (F.col("_part") == F.col("_part2")))
    own = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_row"))
    return durable(rows.withColumn("_nth", F.col("_before") + own).where("_nth > 1").select("_row", "_nth"), "mixnth")


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, size, source_size, target, taken, copies) for every document.

    ``copies`` whole copies make ``taken`` words.  ``keep`` names further
    columns of the input to pass on, as _keep_0, _keep_1, ....  The sources (not the documents) are
    known to the driver: their number is bounded by the catalogue of sources.
    """
    text = F.col(f"`{text_col}`")
    base = docs.select(
        *[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)],
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{source_col}`").cast("string").alias("_src"),
        n_words(text).alias("_size"),
        F.xxhash64(F.lit(seed), text).alias("_tie"),
        (F.greatest(F.lit(0.0), F.coalesce(F.col(f"`{weight_col}`").cast("double"), F.lit(0.0))) if weight_col else F.lit(0.0)).alias("_w"),
        F.monotonically_increasing_id().alias("_row"),
    )
    if not weight_col:
        base = base.withColumn("_w", F.sqrt("_size"))
    # the texts are read once; with ``keep`` they are written once beside their numbers
    base = durable(base, "mixbase")
    slim = base.drop(*[f"_keep_{i}" for i in range(len(keep))])
    nth = numbered(slim)
    several = not nth.isEmpty()

    def drawn(df: DataFrame) -> DataFrame:
        """Adds the uniform number _u; the second and further of equal rows draw their own."""
        once = unit_hash(F.lit(seed), F.col("_id"))
        if not several:
            return df.withColumn("_u", once)
        df = df.join(small_side(nth.withColumnRenamed("_row", "_row2")), F.col("_row") == F.col("_row2"), "left").drop("_row2")
        df = df.withColumn("_u", F.when(F.col("_nth").isNull(), once).otherwise(unit_hash(F.lit(seed), F.col("_id"), F.col("_nth"))))
        return df.withColumn("_tie", F.when(F.col("_nth").isNull(), F.col("_tie")).otherwise(F.xxhash64("_tie", "_nth"))).drop("_nth")

    slim, base_rows = drawn(slim), drawn(base)
    per_source = [(r._src, int(r.n or 0)) for r in slim.groupBy("_src").agg(F.sum("_size").alias("n")).collect()]
    goal = targets(per_source, weights, share, most)
    spark = docs.sparkSession
    # steps of the weight, sixteen to a doubling: what they hold reaches the driver, a bounded number for each source
    step = F.floor(F.log2("_w") * 16)
    held = slim.where("_w > 0 AND _size > 0").groupBy("_src", step.alias("_step")).agg(F.sum("_size").alias("n"), F.sum(F.col("_w") * F.col("_size")).alias("wn"))
    steps: dict[str | None, list[tuple[float, float]]] = {}
    for r in held.collect():
        steps.setdefault(r._src, []).append((r.wn / r.n, float(r.n)))
    whole = {k: int(goal[k] // n) if n else 0 for k, n in per_source}
    plan = spark.createDataFrame(
        [(k, k is None, n, float(goal[k]), whole[k], float(goal[k] - whole[k] * n), scale(steps.get(k, []), goal[k] - whole[k] * n)) for k, n in per_source],
        "_src string, _null boolean, _n long, _target double, _whole int, _rest double, _scale double",
    )

    def placed(df: DataFrame) -> DataFrame:
        """Adds the source's figures, _p, and the Pareto rank _t in (0, 1)."""
        df = df.join(F.broadcast(plan.withColumnRenamed("_src", "_psrc")), F.col("_src").eqNullSafe(F.col("_psrc"))).drop("_psrc", "_null")
        p = F.least(F.lit(1.0), F.col("_scale") * F.col("_w"))
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
        u = F.greatest(F.lit(1e-15), F.col("_u"))
        q = (u / (1 - u)) / (p / (1 - p))
        return df.withColumn("_t", q / (1 + q)).withColumns(
            {
                "_b1": F.least(F.lit(BINS - 1), F.floor(F.col("_t") * BINS)).cast("int"),
                "_b2": F.least(F.lit(BINS - 1), F.floor(F.col("_t") * BINS * BINS) % BINS).cast("int"),
            }
        )

    ranked = placed(slim)
    # level 1 and 2: the cell in which the running sum passes the words wanted
    cells = durable(
        ranked.groupBy("_src", "_b1", "_b2").agg(F.sum("_size").alias("_s"), F.first("_rest").alias("_rest")), "mixcells"
    )

    def passing(hist: DataFrame, keys: list[str], order: str) -> DataFrame:
        run = F.sum("_s").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("_run", run)
        return hist.where((F.col("_run") > F.col("_rest")) & (F.col("_run") - F.col("_s") <= F.col("_rest")))

    one = cells.groupBy("_src", "_b1").agg(F.sum("_s").alias("_s"), F.first("_rest").alias("_rest"))
    cut1 = passing(one, ["_src"], "_b1").select(
        F.col("_src").alias("_c"), F.col("_b1").alias("_c1"), (F.col("_run") - F.col("_s")).alias("_before1")
    )
    two = cells.join(cut1, F.col("_src").eqNullSafe(F.col("_c")) & (F.col("_b1") == F.col("_c1"))).withColumn(
        "_rest", F.col("_rest") - F.col("_before1")
    )
    cut2 = passing(two, ["_src"], "_b2").select(
        "_src", F.col("_c1"), F.col("_b2").alias("_c2"), (F.col("_before1") + F.col("_run") - F.col("_s")).alias("_before")
    )
    cut = cut2.withColumnRenamed("_src", "_c")
    # inside that one cell documents are ordered one by one
    near = ranked.join(
        F.broadcast(cut), F.col("_src").eqNullSafe(F.col("_c")) & (F.col("_b1") == F.col("_c1")) & (F.col("_b2") == F.col("_c2"))
    )
    order = Window.partitionBy("_src").orderBy("_t", "_tie", "_size", "_id").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_run", F.col("_before") + F.sum("_size").over(order))
    edge = near.where((F.col("_run") > F.col("_rest")) & (F.col("_run") - F.col("_size") <= F.col("_rest"))).select(
        F.col("_src").alias("_e"),
        F.col("_t").alias("_et"),
        F.col("_tie").alias("_etie"),
        F.col("_size").alias("_esize"),
        F.struct("_t", "_tie", "_size", "_id").alias("_edge"),
        (F.col("_rest") - F.col("_run") + F.col("_size")).alias("_gap"),
    )
    edge = durable(edge, "mixedge")  # one row per source
    key = F.struct("_t", "_tie", "_size", "_id")
    with_edge = ranked.join(F.broadcast(edge), F.col("_src").eqNullSafe(F.col("_e")), "left")
    # the gap left before the boundary: either the boundary document, or a few
    # unselected ones, the largest that fit first, out of FILL of each size class
    spare = with_edge.where(F.col("_edge").isNotNull() & ~(key < F.col("_edge")) & (F.col("_size") <= F.col("_gap")) & (F.col("_size") > 0))
    classed = Window.partitionBy("_src", "_class").orderBy(F.desc("_size"), "_t", "_tie", "_id")
    spare = (
        spare.withColumn("_class", F.floor(F.log2("_size")))
        .withColumn("_place", F.row_number().over(classed))
        .where(F.col("_place") <= FILL)
        .groupBy("_src")
        .agg(F.reverse(F.array_sort(F.collect_list(F.struct("_size", "_t", "_tie", "_id")))).alias("_all"), F.first("_gap").alias("_g"))
    )
    start = F.struct(F.col("_g").cast("double").alias("left"), F.slice("_all", 1, 0).alias("in"))
    step = lambda acc, x: F.when(
        x["_size"] <= acc["left"],
        F.struct((acc["left"] - x["_size"]).alias("left"), F.concat(acc["in"], F.array(x)).alias("in")),
    ).otherwise(acc)
    spare = spare.select(F.col("_src").alias("_bsrc"), F.aggregate("_all", start, step).alias("_f"))
    closing = edge.join(spare, F.col("_e").eqNullSafe(F.col("_bsrc")), "left").select(
        F.col("_e").alias("_x"),
        "_edge",
        F.col("_f.in").alias("_fill"),
        (F.col("_esize") - F.col("_gap") < F.coalesce(F.col("_f.left"), F.col("_gap"))).alias("_take_edge"),
    )
    closing = durable(closing, "mixclose")  # one row per source
    rows = placed(base_rows).join(F.broadcast(closing), F.col("_src").eqNullSafe(F.col("_x")), "left")
    in_fill = F.array_contains("_fill", F.struct("_size", "_t", "_tie", "_id"))
    extra = (
        F.when(F.col("_edge").isNull(), F.when(F.col("_rest") > 0, 1).otherwise(0))
        .when(key < F.col("_edge"), 1)
        .when(F.col("_take_edge"), F.when(key.eqNullSafe(F.col("_edge")), 1).otherwise(0))
        .otherwise(F.when(in_fill, 1).otherwise(0))
    )
    # a source whose rest is its whole size, or nothing, has no boundary
    copies = (F.col("_whole") + F.when(F.col("_rest") > 1e-9 * F.col("_n"), extra).otherwise(0)).cast("long")
    copies = F.least(copies, F.lit(int(most)).cast("long"))
    shown = rows.select(
        *[F.col(f"_keep_{i}") for i in range(len(keep))],
        F.col("_id"),
        F.col("_size").alias("size"),
        F.col("_n").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * copies).alias("taken"),
        copies.alias("copies"),
    )
    return shown if keep else shown.withColumnRenamed("_id", id_col)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the columns of ``docs``, each row as often as taken."""
    cols = docs.columns
    chosen = mix(docs, keep=cols, **options).where("copies > 0")
    again = chosen.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return again.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(cols)])

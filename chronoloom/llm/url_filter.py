"""URL filter: a blocked Bloom filter before an exact hash join.

Native DataFrame code only.  Listed URLs are brought to a canonical form and
put into a Bloom filter of blocks: each entry sets ``BITS`` bits inside one
256-bit block, kept as four longs.  A page is looked up under the forms
``host suffix + path prefix`` of its URL, as deep as the list itself goes: the
filter passes the forms that may be listed, and an exact join with the list
removes the false positives.  Allow and block rules (host, path) are applied
on top; the longest fitting rule overrules the list.

The filter has ``16 * entries`` bits.  It is broadcast only while that is
under ``BROADCAST_BYTES``; beyond, the blocks are joined by a shuffle on the
block number.  The exact join is left to Spark: its left side is small, as
the filter let through few rows.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits
no rule and is looked up nowhere, so its verdict is ``allow``.  Repeated rows
each get their own result.  An empty list blocks nothing; an empty table gives
no rows.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import ascii_lower

BITS = 8
BITS_PER_ENTRY = 16
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds ``_host`` (A-Z lower-cased) and ``_path``; both empty without ``://``."""
    c = f"CAST(`{url}` AS STRING)"
    rest = f"IF(locate('://', {c}) > 0, substring({c}, locate('://', {c}) + 3), '')"
    df = df.withColumn("_left", F.substring_index(F.substring_index(F.coalesce(F.expr(rest), F.lit("")), "#", 1), "?", 1))
    host = F.substring_index("_left", "/", 1)
    path = F.expr("substring(`_left`, char_length(substring_index(`_left`, '/', 1)) + 1)")
    return df.withColumn("_host", ascii_lower(host)).withColumn("_path", path).drop("_left")


def lookup_forms(host: Column, path: Column, labels: int, folders: int) -> Column:
    """The canonical forms under which a page may be listed, without repeats.

    All that a list can hold whose hosts have up to ``labels`` labels and whose
    paths have up to ``folders`` slashes.
    """
    n = F.least(F.size(F.split(host, "\\.")), F.lit(max(labels, 1)))
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    # a suffix needs two labels at least, but the host itself always counts
    hosts = F.filter(hosts, lambda h: F.contains(h, F.lit(".")) | (h == host))
    # paths begin with a slash
    m = F.least(F.size(F.split(path, "/")) - 1, F.lit(max(folders, 1)))
    leading = F.transform(F.sequence(F.lit(1), m), lambda i: F.concat(F.call_function("substring_index", path, F.lit("/"), i), F.lit("/")))
    paths = F.concat(F.array(path), leading)
    forms = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(forms))


def _masks(h: Column) -> list[Column]:
    """Four longs with BITS bits set in all, chosen by the bits of h."""
    words = [[] for _ in range(4)]
    for i in range(BITS):
        bit = F.expr("1L")
        bit = F.call_function("shiftleft", bit, (F.shiftrightunsigned(h, 6 * i) % 64).cast("int"))
        words[i % 4].append(bit)
    return [reduce(lambda a, b: a.bitwiseOR(b), w) for w in words]


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w3) of the filter over ``keys[key]``."""
    h1, h2 = F.xxhash64(F.col(key)), F.xxhash64(F.col(key), F.lit(1))
    masked = keys.select(F.pmod(h1, F.lit(n_blocks)).alias("_block"), *[m.alias(f"_w{i}") for i, m in enumerate(_masks(h2))])
    return masked.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(4)])


def bloom_pass(probes: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The probe rows whose key may be in the filter."""
    h1, h2 = F.xxhash64(F.col(key)), F.xxhash64(F.col(key), F.lit(1))
    if n_blocks * 40 <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    cols = probes.columns
    probes = probes.withColumn("_block", F.pmod(h1, F.lit(n_blocks))).withColumn("_h2", h2)
    hit = reduce(
        lambda a, b: a & b,
        [F.col(f"_w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("_h2")))],
    )
    return probes.join(blocks, "_block").where(hit).select(*cols)


def rule_choice(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits, or nulls.

    The rule list is a bounded parameter, compiled into one CASE expression.
    """
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict, listed) for every row of ``pages``.

    ``listed`` holds URLs, or ``host/path`` forms, to block.  ``listed`` in the
    result tells whether a form of the page's URL is in the list.
    """
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_u"))
    src = with_parts(src, "_u")
    raw = F.col(listed_col).cast("string")
    entries = with_parts(
        listed.select(F.when(F.locate("://", raw) > 0, raw).otherwise(F.concat(F.lit("x://"), raw)).alias("_u")).where("_u is not null"),
        "_u",
    )
    entries = (
        entries.where("_host <> ''")
        .select(F.concat("_host", F.when(F.col("_path") == "", "/").otherwise(F.col("_path"))).alias("_form"))
        .distinct()
    )
    host_labels, slashes = F.size(F.split(F.substring_index("_form", "/", 1), "\\.")), F.size(F.split("_form", "/")) - 1
    held = entries.agg(F.count("*").alias("n"), F.max(host_labels).alias("labels"), F.max(slashes).alias("folders")).first()
    n_blocks = max(1, -(-held.n * BITS_PER_ENTRY // 256))
    path = F.when(F.col("_path") == "", "/").otherwise(F.col("_path"))
    # one probe per different host and path, so that a hot URL is looked up once
    probes = (
        src.where("_host <> ''")
        .select("_host", "_path")
        .distinct()
        .select("_host", "_path", F.explode(lookup_forms(F.col("_host"), path, held.labels or 0, held.folders or 0)).alias("_form"))
    )
    maybe = bloom_pass(probes, "_form", bloom_blocks(entries, "_form", n_blocks), n_blocks)
    sure = maybe.join(entries, "_form", "left_semi").select("_host", "_path").distinct().withColumn("_listed", F.lit(True))
    rule, action = rule_choice(F.col("_host"), F.col("_path"), rules)
    is_listed = F.coalesce("_listed", F.lit(False))
    return src.join(sure, ["_host", "_path"], "left").select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        rule.alias("rule"),
        F.coalesce(action, F.when(is_listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        is_listed.alias("listed"),
    )

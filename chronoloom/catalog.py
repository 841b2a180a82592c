"""The registered queries of the engine and their SQL.

Names of label columns are as in the series table.  All queries run over whole
tables; the SQL says the same on the raw tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.hashing import series_hash
from chronoloom.model import HISTOGRAM_TYPE, col, label_columns, labels_array
from chronoloom.operators import projection, row_ranges
from chronoloom.operators.limits import CHUNK_BYTES, DATA_BYTES, ROWS, ResourceExhausted
from chronoloom.operators.matchers import Equal, Filter, Initialize, Matcher, Not, Regex, all_of, eq, neq, nre, re
from chronoloom.operators.ranking import global_row_number
from chronoloom.plans import vector
from chronoloom.plans.convert import HOUR, ConvertOptions, convert, order_of_series, without_deleted
from chronoloom.plans.query import MatchCache, Querier, QueryOptions, SelectHints
from chronoloom.sources import tables
from chronoloom.sources.scratch import settled, shared_folder
from chronoloom.sources.storage import Store, in_memory, open_store, write_store

MINT = 1_704_067_200_000  # 2024-01-01
DAY = 24 * HOUR
MAXT = MINT + 30 * DAY - 1
OPTIONS = ConvertOptions(name="events", samples_per_chunk=2, with_hash=False)
SHARDED = OPTIONS.with_(row_groups=5, row_group_size=50)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The same mapping of the tables as in ``sources.tables``.
_EV = """ev AS (
  SELECT event_type AS "l___name__", 'user-' || user_id AS l_user, CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'beta' END AS l_env,
    CASE WHEN user_id % 3 = 1 THEN '/' WHEN user_id % 3 = 2 THEN '/r' || (user_id % 7) END AS l_route, epoch_us(ts) // 1000 AS t, value AS v
  FROM events),
series AS (SELECT DISTINCT "l___name__", l_user, l_env, l_route FROM ev)"""
_LI = """li AS (
  SELECT 'lineitem_quantity' AS "l___name__", l_returnflag AS l_flag, l_linestatus AS l_status, 's' || l_suppkey AS l_supp,
    epoch_us(l_shipdate) // 1000 AS t, l_quantity AS v, l_orderkey AS orderkey, l_linenumber AS linenumber
  FROM lineitem)"""
_CHUNKS = f"""cut AS (
  SELECT *, ((t - {MINT}) // {OPTIONS.column_duration})::INT AS col_idx FROM ev WHERE t BETWEEN {MINT} AND {MAXT}),
numbered AS (
  SELECT *, ((row_number() OVER (PARTITION BY "l___name__", l_user, col_idx ORDER BY t) - 1) // {OPTIONS.samples_per_chunk})::INT AS chunk_no FROM cut),
chunks AS (
  SELECT "l___name__", l_user, l_env, l_route, col_idx, chunk_no, min(t) AS min_t, max(t) AS max_t, count(*)::INT AS n, sum(v) AS s
  FROM numbered GROUP BY ALL)"""
_ORDER = """ "l___name__", 'env' || chr(1) || l_env || chr(1) || CASE WHEN l_route IS NULL THEN '' ELSE 'route' || chr(1) || l_route || chr(1) END || 'user' || chr(1) || l_user """


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _series(samples: DataFrame) -> DataFrame:
    return samples.select(*[col(c) for c in label_columns(samples)]).distinct()


def _matching(*matchers: Matcher) -> Query:
    """Distinct label sets of the samples that match; the filter reaches the scan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        samples = tables.events(spark, sf_dir)
        return _series(samples.where(all_of(matchers, samples.columns)))

    return run


def _match(name: str, where: str, *matchers: Matcher) -> None:
    _query(name, f"WITH {_EV} SELECT * FROM series WHERE {where}")(_matching(*matchers))


_R = "coalesce(l_route, '')"
_match("select_eq", "\"l___name__\" = 'click'", eq("__name__", "click"))
_match("select_conj", f"\"l___name__\" = 'click' AND {_R} <> '' AND l_env <> 'beta'", eq("__name__", "click"), neq("route", ""), neq("env", "beta"))
_match("select_all", "true")
_match("match_empty", f"{_R} = ''", eq("route", ""))
_match("match_neq", f"{_R} <> '/'", neq("route", "/"))
_match("match_not_empty", f"{_R} <> ''", neq("route", ""))
_match("regex_any", "true", re("route", ".*"))
_match("regex_nonempty", f"{_R} <> ''", re("route", ".+"))
_match("regex_single", f"{_R} = '/r2'", re("route", "/r2"))
_match("regex_set", f"{_R} IN ('/r1', '/r2', '')", re("route", "(/r1|/r2|)"))
_match("regex_prefix", f"regexp_full_match({_R}, '(?s:/r[2-4].*)')", re("route", "/r[2-4].*"))
_match("regex_matching_empty", f"regexp_full_match({_R}, '(?s:(/r1)?)')", re("route", "(/r1)?"))
_match("regex_general", "regexp_full_match(l_user, '(?s:user-\\d*[13579])')", re("user", r"user-\d*[13579]"))
_match("regex_not_single", f"{_R} <> '/r2'", nre("route", "/r2"))
_match("regex_not_set", f"{_R} NOT IN ('/r1', '/r3')", nre("route", "/r1|/r3"))
_match("regex_negated", f"NOT regexp_full_match({_R}, '(?s:/r[12]?)')", nre("route", "/r[12]?"))
_match("regex_negated_matching_empty", f"NOT regexp_full_match({_R}, '(?s:(/r1)?)')", nre("route", "(/r1)?"))
_match("missing_label_empty", "\"l___name__\" = 'click'", eq("__name__", "click"), eq("absent", ""))
_match("missing_label_value", "false", eq("absent", "x"))
_match("missing_label_regex", "true", re("absent", "f.*|b.*|"))


@_query("constraint_filter", f"WITH {_EV} SELECT * FROM series WHERE NOT ({_R} = '/') AND l_env = 'prod'")
def constraint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Filter(_series(tables.events(spark, sf_dir)), Not(Equal("l_route", "/")), Equal("l_env", "prod"))


@_query("label_names_all", "SELECT unnest(['__name__', 'env', 'route', 'user']) AS name")
def label_names_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.merge_sorted([projection.names_in_schema(tables.events(spark, sf_dir).columns, spark)])


@_query(
    "label_names_matched",
    f"""WITH {_EV}, m AS (SELECT * FROM series WHERE {_R} = '')
SELECT '__name__' AS name FROM m UNION SELECT 'env' FROM m UNION SELECT 'user' FROM m UNION SELECT 'route' FROM m WHERE l_route IS NOT NULL""",
)
def label_names_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.events(spark, sf_dir)
    return projection.merge_sorted([projection.names_used(samples.where(all_of([eq("route", "")], samples.columns)))])


@_query("label_values_all", f"WITH {_EV} SELECT DISTINCT l_route AS value FROM series WHERE {_R} <> ''")
def label_values_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.merge_sorted([projection.values_of(tables.events(spark, sf_dir), "route")])


@_query("label_values_matched", f"WITH {_EV} SELECT DISTINCT l_user AS value FROM series WHERE l_route = '/r1' AND l_env = 'beta'")
def label_values_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.merge_sorted([projection.values_of(_matching(eq("route", "/r1"), eq("env", "beta"))(spark, sf_dir), "user")])


@_query("label_values_limit", f"WITH {_EV} SELECT DISTINCT l_user AS value FROM series ORDER BY value LIMIT 7")
def label_values_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.merge_sorted([projection.values_of(tables.events(spark, sf_dir), "user")], 7)


@_query("label_values_unknown", "SELECT 'x' AS value WHERE false")
def label_values_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.values_of(tables.events(spark, sf_dir), "absent")


def _projected(names: tuple[str, ...], include: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return projection.project_labels(_matching(eq("env", "prod"))(spark, sf_dir), names, include).drop("labels")

    return run


_query("project_include", f"WITH {_EV} SELECT \"l___name__\", l_route FROM series WHERE l_env = 'prod'")(_projected(("__name__", "route", "absent"), True))
_query("project_exclude", f"WITH {_EV} SELECT \"l___name__\", l_env, l_route FROM series WHERE l_env = 'prod'")(_projected(("user", "s_series_hash"), False))


@_query("project_keeps_rows", f'WITH {_EV} SELECT "l___name__", count(*) AS n FROM series GROUP BY ALL')
def project_keeps_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = projection.project_labels(_series(tables.events(spark, sf_dir)), ("__name__",), True)
    return shown.groupBy("l___name__").agg(F.count("*").alias("n"))


@_query("series_hash")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _series(tables.events(spark, sf_dir))
    return series.withColumn("s_series_hash", F.hex(series_hash(labels_array(label_columns(series)))))


def _converted(spark: SparkSession, sf_dir: str, options: ConvertOptions = OPTIONS):
    return convert(tables.events(spark, sf_dir), MINT, MAXT, options)


def _querier(spark: SparkSession, sf_dir: str, mint: int = MINT, maxt: int = MAXT, options: ConvertOptions = OPTIONS) -> Querier:
    return Querier(in_memory(_converted(spark, sf_dir, options)), mint, maxt)


_LABELS = ["l___name__", "l_user", "l_env", "l_route"]


@_query("series_only", f"WITH {_EV} SELECT * FROM series WHERE {_R} = '/'")
def series_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _querier(spark, sf_dir).select(eq("route", "/"), hints=SelectHints(func="series")).select(*_LABELS)


@_query("chunks_meta", f"WITH {_EV}, {_CHUNKS} SELECT \"l___name__\", l_user, col_idx, chunk_no, min_t, max_t, n, round(s, 4) AS total FROM chunks")
def chunks_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _converted(spark, sf_dir)
    total = F.round(F.aggregate("samples", F.lit(0.0), lambda a, s: a + s["v"]), 4)
    joined = c.chunks.join(c.series.select("block", "shard", "series_id", "l___name__", "l_user"), ["block", "shard", "series_id"])
    return joined.select("l___name__", "l_user", "col_idx", "chunk_no", "min_t", "max_t", "n", total.alias("total"))


_FROM, _TO = MINT + 5 * DAY + HOUR, MINT + 8 * DAY


@_query(
    "chunk_overlap",
    f"""WITH {_EV}, {_CHUNKS} SELECT "l___name__", l_user, count(*) AS n_chunks, sum(n)::BIGINT AS n_samples
FROM chunks WHERE min_t <= {_TO} AND max_t >= {_FROM} AND l_env = 'prod' GROUP BY ALL""",
)
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _querier(spark, sf_dir, _FROM, _TO).select(eq("env", "prod"))
    n = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return rows.select("l___name__", "l_user", F.size("chunks").cast("long").alias("n_chunks"), n.alias("n_samples"))


@_query(
    "chunk_drop_empty_series",
    f"WITH {_EV}, {_CHUNKS} SELECT count(DISTINCT (\"l___name__\", l_user)) AS n FROM chunks WHERE min_t <= {MINT + HOUR} AND max_t >= {MINT}",
)
def chunk_drop_empty_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _querier(spark, sf_dir, MINT, MINT + HOUR).select().agg(F.count("*").alias("n"))


@_query("samples_trimmed", f"WITH {_EV} SELECT \"l___name__\", l_user, t, v FROM ev WHERE \"l___name__\" = 'click' AND t BETWEEN {_FROM} AND {_TO}")
def samples_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _querier(spark, sf_dir, _FROM, _TO).samples(eq("__name__", "click")).select("l___name__", "l_user", "t", "v")


_PLACED = f"""WITH {_EV}, ranked AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS r, count(*) OVER () AS u FROM series),
sized AS (SELECT *, ceil(u / ceil(u / 250.0))::BIGINT AS size FROM ranked),
placed AS (SELECT *, (r // size)::INT AS shard, r % size AS row_no, ((r % size) // 50)::INT AS row_group FROM sized)"""
_SHARD_SQL = _PLACED + ' SELECT "l___name__", l_user, shard, row_no, row_group, r + 1 AS series_id FROM placed'


@_query("shard_assignment", _SHARD_SQL)
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir, SHARDED).series.select("l___name__", "l_user", "shard", "row_no", "row_group", "series_id")


@_query(
    "series_sort_order",
    f'WITH {_EV} SELECT "l___name__", l_user, row_number() OVER (ORDER BY l_env, {_ORDER}) AS place FROM series',
)
def series_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _series(tables.events(spark, sf_dir)).withColumn("labels", labels_array(_LABELS))
    return global_row_number(series, order_of_series(series, ["env", "__name__"]), "place").select("l___name__", "l_user", "place")


@_query("multi_shard_series_count", f'WITH {_EV} SELECT "l___name__", count(*) AS n FROM series GROUP BY ALL')
def multi_shard_series_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _querier(spark, sf_dir, options=SHARDED).select()
    return rows.groupBy("l___name__").agg(F.count("*").alias("n"))


@_query(
    "multi_block_concat",
    f"""WITH {_EV}, twice AS (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE l_env = 'prod')
SELECT "l___name__", l_user, count(*) AS n_samples, round(sum(v), 4) AS total FROM twice GROUP BY ALL""",
)
def multi_block_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.events(spark, sf_dir)
    blocks = [convert(s, MINT, MAXT, OPTIONS.with_(name=n)) for n, s in (("a", samples), ("b", samples.where("l_env = 'prod'")))]
    rows = Querier(in_memory(*blocks), MINT, MAXT).samples()
    return rows.groupBy("l___name__", "l_user").agg(F.count("*").alias("n_samples"), F.round(F.sum("v"), 4).alias("total"))


@_query(
    "duplicate_times_kept",
    f"""WITH {_LI}, numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY l_flag, l_status, l_supp ORDER BY t, orderkey, linenumber) - 1) // 120 AS chunk_no FROM li)
SELECT l_flag, l_status, l_supp, chunk_no::INT AS chunk_no, min(t) AS min_t, max(t) AS max_t, count(*)::INT AS n, sum(v) AS total FROM numbered GROUP BY ALL""",
)
def duplicate_times_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.lineitem(spark, sf_dir)
    whole = ConvertOptions(name="lineitem", column_duration=100 * 365 * DAY, with_hash=False)
    c = convert(samples, 0, 100 * 365 * DAY - 1, whole, tie=("orderkey", "linenumber"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, s: a + s["v"])
    joined = c.chunks.join(c.series, ["block", "shard", "series_id"])
    return joined.select("l_flag", "l_status", "l_supp", "chunk_no", "min_t", "max_t", "n", total.alias("total"))


@_query(
    "tombstone_filter",
    f"""WITH {_EV} SELECT "l___name__", count(*) AS n FROM ev
WHERE NOT ("l___name__" = 'click' AND t BETWEEN {_FROM} AND {_TO}) AND NOT (l_env = 'beta' AND t BETWEEN {MINT} AND {_FROM}) GROUP BY ALL""",
)
def tombstone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = [([eq("__name__", "click")], _FROM, _TO), ([eq("env", "beta")], MINT, _FROM)]
    return without_deleted(tables.events(spark, sf_dir), gone).groupBy("l___name__").agg(F.count("*").alias("n"))


@_query("shards_finder", f"SELECT unnest(['w1', 'w2']) AS block, 0 AS shard, unnest([{MINT + 7 * DAY}, {MINT + 14 * DAY}]) AS min_t")
def shards_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, week = tables.events(spark, sf_dir), 7 * DAY
    weeks = [convert(samples, MINT + i * week, MINT + (i + 1) * week - 1, OPTIONS.with_(name=f"w{i}")) for i in range(4)]
    return in_memory(*weeks).find(MINT + 10 * DAY, MINT + 14 * DAY).select("block", "shard", "min_t")


_BY = ("shard", "row_group")


def _islands(where: str) -> str:
    """SQL of the runs of rows that fulfil ``where``."""
    return f"""SELECT shard, row_group, min(row_no) AS start, count(*) AS count FROM (
  SELECT *, row_no - row_number() OVER (PARTITION BY shard, row_group ORDER BY row_no) AS g FROM placed WHERE {where}) GROUP BY shard, row_group, g"""


def _ranges(series: DataFrame, *matchers: Matcher) -> DataFrame:
    return row_ranges.ranges_of_rows(series.where(all_of(matchers, series.columns)), "row_no", _BY)


@_query("row_ranges", f"{_PLACED} {_islands(_R + " <> '/'")}")
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(_converted(spark, sf_dir, SHARDED).series, neq("route", "/"))


@_query(
    "row_ranges_algebra",
    f"""{_PLACED} SELECT 'both' AS op, * FROM ({_islands(f"l_env = 'prod' AND {_R} <> '/'")})
UNION ALL SELECT 'minus', * FROM ({_islands(f"l_env = 'prod' AND {_R} = '/'")})
UNION ALL SELECT 'overlap', shard, row_group, NULL, NULL FROM placed WHERE l_env = 'prod' AND {_R} <> '/' GROUP BY ALL""",
)
def ranges_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _converted(spark, sf_dir, SHARDED).series
    a, b = _ranges(series, eq("env", "prod")), _ranges(series, neq("route", "/"))
    both, minus, over = row_ranges.intersect(a, b, _BY), row_ranges.complement(a, b, _BY), row_ranges.overlaps(a, b, _BY)
    named = [d.withColumn("op", F.lit(n)) for n, d in (("both", both), ("minus", minus), ("overlap", over))]
    return named[0].unionByName(named[1]).unionByName(named[2], allowMissingColumns=True).select("op", *_BY, "start", "count")


@_query(
    "two_tables_one_store",
    f"""WITH {_LI}, o AS (SELECT o_orderstatus AS l_status FROM orders)
SELECT '__name__' AS name UNION SELECT 'flag' UNION SELECT 'priority' UNION SELECT 'status' UNION SELECT 'supp'""",
)
def two_tables_one_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = ConvertOptions(column_duration=100 * 365 * DAY, with_hash=False)
    li = convert(tables.lineitem(spark, sf_dir), 0, 100 * 365 * DAY - 1, whole.with_(name="li"), tie=("orderkey", "linenumber"))
    od = convert(tables.orders(spark, sf_dir), 0, 100 * 365 * DAY - 1, whole.with_(name="od"), tie=("orderkey",))
    return Querier(in_memory(li, od), 0, 100 * 365 * DAY).label_names()


# Stores on files: written, reopened and read again.


_STORED = SHARDED.with_(column_duration=DAY)
_WRITTEN: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf_dir: str, options: ConvertOptions = _STORED) -> Store:
    """The events in two blocks of 15 days, each in shards: written once an application, opened by each query."""
    key = (spark.sparkContext.applicationId, sf_dir, options)
    if key not in _WRITTEN:
        root, samples = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", tables.events(spark, sf_dir)
        for name, lo, hi in (("early", MINT, MINT + 15 * DAY - 1), ("late", MINT + 15 * DAY, MAXT)):
            write_store(convert(samples, lo, hi, options.with_(name=name)), root)
        _WRITTEN[key] = root
    return open_store(spark, _WRITTEN[key])


_TWO = f"""two AS (
  SELECT *, t >= {MINT + 15 * DAY} AS late FROM ev WHERE t BETWEEN {MINT} AND {MAXT}),
placed AS (SELECT *, ((t - CASE WHEN late THEN {MINT + 15 * DAY} ELSE {MINT} END) // {_STORED.column_duration})::INT AS col_idx FROM two),
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY "l___name__", l_user, late, col_idx ORDER BY t, v) - 1) // {OPTIONS.samples_per_chunk} AS chunk_no FROM placed),
chunks AS (
  SELECT "l___name__", l_user, l_env, l_route, late, col_idx, chunk_no, min(t) AS min_t, max(t) AS max_t, count(*) AS n FROM numbered GROUP BY ALL)"""


def _chunk_counts(rows: DataFrame) -> DataFrame:
    n = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return rows.select("l___name__", "l_user", F.size("chunks").cast("long").alias("n_chunks"), n.alias("n_samples"))


def _chunk_counts_sql(where: str) -> str:
    return f"""WITH {_EV}, {_TWO} SELECT "l___name__", l_user, count(*) AS n_chunks, sum(n)::BIGINT AS n_samples FROM chunks WHERE {where} GROUP BY ALL"""


@_query("store_select", _chunk_counts_sql("l_env = 'prod'"))
def store_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_counts(Querier(_stored(spark, sf_dir), MINT, MAXT).select(eq("env", "prod")))


@_query("store_time_pruned", _chunk_counts_sql(f"min_t <= {_TO} AND max_t >= {_FROM}"))
def store_time_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_counts(Querier(_stored(spark, sf_dir), _FROM, _TO).select())


@_query("hint_range", _chunk_counts_sql(f"min_t <= {_TO} AND max_t >= {_FROM} AND \"l___name__\" = 'click'"))
def hint_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of the hints, not of the querier, chooses the chunks."""
    return _chunk_counts(Querier(_stored(spark, sf_dir), MINT, MAXT).select(eq("__name__", "click"), hints=SelectHints(start=_FROM, end=_TO)))


@_query("store_samples", f"WITH {_EV} SELECT \"l___name__\", l_user, t, v FROM ev WHERE {_R} = '/r2' AND t BETWEEN {_FROM} AND {MINT + 20 * DAY}")
def store_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    querier = Querier(_stored(spark, sf_dir), _FROM, MINT + 20 * DAY)
    return querier.samples(eq("route", "/r2")).select("l___name__", "l_user", "t", "v")


@_query("store_compressed", _chunk_counts_sql("true"))
def store_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other codecs and Bloom filters on two labels change files, not results."""
    options = _STORED.with_(labels_compression="gzip", chunks_compression="snappy", bloom_labels=("__name__", "user"))
    return _chunk_counts(Querier(_stored(spark, sf_dir, options), MINT, MAXT).select())


@_query("store_label_values", f"WITH {_EV} SELECT DISTINCT l_user AS value FROM ev WHERE l_route = '/r1' AND t BETWEEN {MINT + 15 * DAY} AND {MAXT}")
def store_label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Querier(_stored(spark, sf_dir), MINT + 16 * DAY, MAXT).label_values("user", eq("route", "/r1"))


@_query("store_label_names", f"WITH {_EV} SELECT unnest(['__name__', 'env', 'user']) AS name FROM (SELECT 1 WHERE EXISTS (SELECT 1 FROM series WHERE l_route IS NULL))")
def store_label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Querier(_stored(spark, sf_dir), MINT, MAXT).label_names(eq("route", ""))


@_query(
    "store_shard",
    f"""WITH {_EV}, late AS (SELECT DISTINCT "l___name__", l_user, l_env, l_route FROM ev WHERE t BETWEEN {MINT + 15 * DAY} AND {MAXT}),
ranked AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS r, count(*) OVER () AS u FROM late)
SELECT "l___name__", l_user, r AS row_no FROM ranked WHERE r < ceil(u / ceil(u / 250.0))""",
)
def store_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).shard("late", 0).series.select("l___name__", "l_user", "row_no")


@_query("merge_lists", f"WITH {_EV} SELECT DISTINCT l_user AS value FROM ev WHERE {_R} = '/r1' OR \"l___name__\" = 'click' ORDER BY value LIMIT 40")
def merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.events(spark, sf_dir)
    hit = [samples.where(all_of([m], samples.columns)) for m in (eq("route", "/r1"), eq("__name__", "click"))]
    return projection.merge_sorted([projection.values_of(h, "user") for h in hit], 40)


# Order, labels and options.


@_query("labels_sorted", f'WITH {_EV} SELECT "l___name__", l_user, row_number() OVER (ORDER BY {_ORDER}) AS place FROM series')
def labels_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in the sorted result."""
    out = settled(_querier(spark, sf_dir, options=SHARDED).select(sort=True).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    return global_row_number(out.select("l___name__", "l_user", "_at"), [F.col("_at")], "place").drop("_at")


@_query(
    "assembled_labels",
    f"""WITH {_EV} SELECT concat_ws(',', '__name__=' || "l___name__", 'env=' || l_env, 'route=' || l_route, 'user=' || l_user) AS labels FROM series""",
)
def assembled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _querier(spark, sf_dir).select(hints=SelectHints(func="series"))
    return rows.select(F.array_join(F.transform("labels", lambda p: F.concat_ws("=", p["name"], p["value"])), ",").alias("labels"))


@_query("label_filter_callback", f"WITH {_EV} SELECT * FROM series WHERE \"l___name__\" = 'click' AND length(l_user) <= 6")
def label_filter_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = QueryOptions(labels_filter=lambda found: found.where(F.length("l_user") <= 6))
    return Querier(in_memory(_converted(spark, sf_dir)), MINT, MAXT, options).select(eq("__name__", "click")).select(*_LABELS)


_QUOTAS = {"row_limit": (ROWS, [3, 100_000_000]), "chunk_bytes_limit": (CHUNK_BYTES, [64, 1 << 50]), "data_bytes_limit": (DATA_BYTES, [64, 1 << 50])}


@_query(
    "quotas",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{o}', {n}::BIGINT, {f"'{message}'" if n < 100 else 'NULL'})" for o, (message, ns) in _QUOTAS.items() for n in ns)
    + ") v(quota, given, error) WHERE EXISTS (SELECT 1 FROM events)",
)
def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small and large limits of each kind, and the error that each one ends with."""
    store, seen = in_memory(_converted(spark, sf_dir)), []
    for option, (_, limits) in _QUOTAS.items():
        for n in limits:
            error = None
            try:
                Querier(store, MINT, MAXT, QueryOptions(**{option: lambda n=n: n})).select(eq("__name__", "click"))
            except ResourceExhausted as e:
                error = str(e)
            seen.append((option, n, error))
    return spark.createDataFrame(seen, "quota string, given long, error string")


@_query(
    "cached_matches",
    f"WITH {_EV} SELECT 'warm' AS run, * FROM series WHERE l_env = 'prod' UNION ALL SELECT 'cold', * FROM series WHERE l_env = 'prod'",
)
def cached_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    querier = Querier(in_memory(_converted(spark, sf_dir)), MINT, MAXT, QueryOptions(cache=MatchCache(2)))
    cold, warm = [querier.select(eq("env", "prod"), hints=SelectHints(func="series")).select(F.lit(n).alias("run"), *_LABELS) for n in ("cold", "warm")]
    return cold.unionByName(warm)


@_query("constraint_regex", f"WITH {_EV} SELECT * FROM series WHERE regexp_full_match({_R}, '(?s:/r[1-3]|/)') AND l_env = 'prod'")
def constraint_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _series(tables.events(spark, sf_dir))
    found = [Regex("l_route", re("route", "/r[1-3]|/")), Equal("l_env", "prod")]
    Initialize(series, *found)
    return Filter(series, *found)


# Histograms: the value is the count; the layout changes every ten days.


def _histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.events(spark, sf_dir).where("l___name__ = 'click'")
    schema = F.floor((F.col("t") - MINT) / (10 * DAY)).cast("int")
    fields = {"schema": schema, "count": F.col("v"), "sum": F.col("v")}
    hist = F.from_json(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])), HISTOGRAM_TYPE)
    is_hist = F.col("l_env") == "prod"
    return samples.withColumn("hist", F.when(is_hist, hist)).withColumn("enc", F.when(is_hist, "histogram").otherwise("XOR"))


@_query(
    "hist_chunks",
    f"""WITH {_EV}, h AS (
  SELECT l_user, CASE WHEN l_env = 'prod' THEN 'histogram' ELSE 'XOR' END AS enc, CASE WHEN l_env = 'prod' THEN 1 ELSE 0 END AS enc_order,
    t, v, (t - {MINT}) // {10 * DAY} AS layout, l_env = 'prod' AS is_hist FROM ev WHERE "l___name__" = 'click' AND t BETWEEN {MINT} AND {MAXT}),
c AS (SELECT *, CASE WHEN is_hist AND (lag(layout) OVER w <> layout OR v < lag(v) OVER w) THEN 1 ELSE 0 END AS cut FROM h WINDOW w AS (PARTITION BY l_user ORDER BY t, v)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY l_user ORDER BY t, v ROWS UNBOUNDED PRECEDING) AS run FROM c),
p AS (SELECT *, (row_number() OVER (PARTITION BY l_user, run ORDER BY t, v) - 1) // 2 AS part FROM r),
n AS (SELECT *, dense_rank() OVER (PARTITION BY l_user ORDER BY run, part) - 1 AS chunk_no FROM p)
SELECT l_user, enc, enc_order, chunk_no::INT AS chunk_no, min(t) AS min_t, max(t) AS max_t, count(*)::INT AS n,
  CASE WHEN is_hist THEN round(sum(v), 4) END AS total FROM n GROUP BY l_user, enc, enc_order, is_hist, chunk_no""",
)
def hist_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = convert(_histograms(spark, sf_dir), MINT, MAXT, OPTIONS.with_(column_duration=100 * DAY))
    total = F.round(F.aggregate("hist", F.lit(0.0), lambda a, h: a + h["count"]), 4)
    joined = c.chunks.join(c.series.select("block", "shard", "series_id", "l_user"), ["block", "shard", "series_id"])
    return joined.select("l_user", "enc", "enc_order", "chunk_no", "min_t", "max_t", "n", total.alias("total"))


# Beyond the reference: a small layer over samples.

_AT = MINT + 15 * DAY


@_query(
    "instant_sum_by",
    f"""WITH {_EV}, last AS (
  SELECT "l___name__", l_user, l_env, arg_max(v, (t, v)) AS v FROM ev WHERE t > {_AT - 5 * DAY} AND t <= {_AT} GROUP BY ALL)
SELECT "l___name__", l_env, round(sum(v), 4) AS sum FROM last GROUP BY ALL""",
)
def instant_sum_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = vector.instant_vector(tables.events(spark, sf_dir), _LABELS, _AT, 5 * DAY)
    return vector.aggregate(latest, "sum", ["__name__", "env"]).withColumn("sum", F.round("sum", 4))


@_query("instant_count_by", f"""WITH {_EV} SELECT l_env, count(DISTINCT ("l___name__", l_user)) AS count FROM ev WHERE t > {_AT - 5 * DAY} AND t <= {_AT} GROUP BY ALL""")
def instant_count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.aggregate(vector.instant_vector(tables.events(spark, sf_dir), _LABELS, _AT, 5 * DAY), "count", ["env"])


@_query(
    "rate_window",
    f"""WITH {_EV}, d AS (
  SELECT "l___name__", l_user, v, lag(v) OVER (PARTITION BY "l___name__", l_user ORDER BY t, v) AS p FROM ev WHERE t > {_FROM} AND t <= {_TO})
SELECT "l___name__", l_user, round(sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END) / {(_TO - _FROM) / 1000}, 9) AS rate FROM d GROUP BY ALL""",
)
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = vector.rate(tables.events(spark, sf_dir), ["l___name__", "l_user"], _FROM, _TO)
    return rates.withColumn("rate", F.round("rate", 9))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of one metric that carry a route, with their sample count and latest value."""
    samples = tables.events(spark, sf_dir)
    hit = samples.where(all_of([eq("__name__", "click"), neq("route", "")], samples.columns))
    return hit.groupBy(*_LABELS).agg(F.count("*").alias("n"), F.max(F.struct("t", "v"))["v"].alias("last"))

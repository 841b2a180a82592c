"""Conversion, storage, queries, quotas and helpers on the reference's shapes."""

import threading

import pytest
from pyspark.sql import functions as F

from chronoloom import ConvertOptions, MatchCache, Querier, QueryOptions, Quota, ResourceExhausted, SelectHints, convert, eq, is_resource_exhausted, neq, nre, open_store, re, write_store
from chronoloom.functions.hashing import stable_hash
from chronoloom.model import bucket_count, bucket_index
from chronoloom.operators import projection, row_ranges
from chronoloom.plans import vector
from chronoloom.plans.convert import HOUR, rows_per_shard
from chronoloom.sources.storage import in_memory
from chronoloom.streaming.ingest import bucketed_stream, write_buckets

MIN = 60_000


def series_samples(spark, rows, names):
    """rows: (labels..., t, v)"""
    return spark.createDataFrame(rows, ", ".join(f"`l_{n}` string" for n in names) + ", t long, v double")


def grid(spark, n, step, samples):
    df = spark.range(n).select(F.lit("foo").alias("l___name__"), (F.col("id") * 2).cast("string").alias("l_bar"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"))
    return df.select("l___name__", "l_bar", (F.col("i") * step).cast("long").alias("t"), F.col("i").cast("double").alias("v"))


@pytest.mark.parametrize("column,step,samples,chunks,per", [(HOUR, HOUR, 3, 3, 1), (8 * HOUR, HOUR // 2, 10, 1, 10), (8 * HOUR, HOUR // 2, 32, 2, 16)])
def test_grid(spark, column, step, samples, chunks, per):
    c = convert(grid(spark, 1200, step, samples), 0, samples * step, ConvertOptions(column_duration=column, row_groups=4, row_group_size=100))
    assert [r["count"] for r in c.series.groupBy("shard").count().collect()] == [400] * 3
    assert c.shard_meta.count() == 3
    stats = c.chunks.groupBy("series_id").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).drop("series_id").distinct().collect()
    assert [(r.k, r.lo, r.hi) for r in stats] == [(chunks, per, per)]
    order = [r.l_bar for r in c.series.orderBy("shard", "row_no").collect()]
    assert order == sorted(order)
    one = convert(grid(spark, 1200, step, samples), 0, samples * step, ConvertOptions(column_duration=column))
    assert one.series.select("shard").distinct().count() == 1 and one.series.count() == 1200


def test_window_cut_and_tombstones(spark):
    rows = [("test", "bar", i * 30_000, float(i)) for i in range(240)]
    c = convert(series_samples(spark, rows, ["__name__", "foo"]), 30 * MIN, 90 * MIN - 1, ConvertOptions(column_duration=10 * MIN))
    assert c.chunks.select("col_idx").distinct().count() == 6
    got = c.chunks.agg(F.sum("n"), F.min("min_t"), F.max("max_t")).first()
    assert tuple(got) == (120, 30 * MIN, 90 * MIN - 30_000)
    gone = convert(series_samples(spark, rows, ["__name__", "foo"]), 0, 120 * MIN, tombstones=[([eq("foo", "bar")], 0, 60 * MIN)])
    assert gone.chunks.agg(F.min("min_t")).first()[0] == 60 * MIN + 30_000


def test_partial_block_and_many_blocks(spark):
    rows = [("early", 0, 1.0), ("edge", 11, 1.0), ("late", 21, 1.0)] + [(f"s{i}", 11, 1.0) for i in range(240)]
    c = convert(series_samples(spark, rows, ["__name__"]), 10, 19, ConvertOptions(column_duration=10))
    assert c.series.count() == 241
    blocks = []
    for b in range(10):
        own = [(f"n{b}_{i}", str(i % 7), 0, 0.0) for i in range(240)]
        own += [(f"dup{i}", None, t, 1.0) for t in (0, 1) for i in range(240) if (i * 7 + t * 3) % 10 == b]
        blocks.append(series_samples(spark, own, ["__name__", "zzz"]))
    c = convert(blocks, 0, 1, ConvertOptions(sort_by=("zzz", "__name__"), row_groups=1, row_group_size=1000, with_hash=False))
    assert c.series.count() == 2640 and {r["count"] for r in c.series.groupBy("shard").count().collect()} == {880}
    n = {r.l___name__: r.n for r in c.series.join(c.chunks, ["block", "shard", "series_id"]).collect()}
    assert all(v == (2 if k.startswith("dup") else 1) for k, v in n.items())
    order = [(r.l_zzz or "", r.l___name__) for r in c.series.orderBy("shard", "row_no").collect()]
    assert order == sorted(order)


def test_shards_even():
    assert rows_per_shard(1200, 4, 100) == 400 and rows_per_shard(750, 5, 50) == 250 and rows_per_shard(0, 1, 10) == 1 and rows_per_shard(2640, 1, 1000) == 880


def test_empty_and_wide_inputs(spark):
    none = series_samples(spark, [], ["a"])
    c = convert(none, 0, 10, ConvertOptions(row_groups=1, row_group_size=10))
    assert c.series.count() == c.chunks.count() == c.shard_meta.count() == 0
    wide = none.select("*", *[F.lit("x").alias(f"l_k{i}") for i in range(2001)])
    with pytest.raises(ValueError):
        convert(wide, 0, 1)
    with pytest.raises(Exception, match="unknown encoding"):
        convert(series_samples(spark, [("a", 1, 1.0)], ["a"]).withColumn("enc", F.lit("odd")), 0, 2).chunks.count()


def test_buckets(spark):
    cases = [(0, HOUR, 0, 0), (0, HOUR, HOUR, 1), (0, HOUR, 90 * MIN, 1), (HOUR, HOUR, 0, 0), (HOUR, HOUR, 1000 * HOUR, 999)]
    for mint, dur, t, want in cases:
        assert spark.range(1).select(bucket_index(F.lit(t), mint, dur)).first()[0] == want
    assert bucket_count(0, 10 * HOUR - 1, HOUR) == 10 and bucket_count(0, 10 * HOUR - 1, HOUR // 2) == 20


def test_histograms_cut_on_layout_and_reset(spark):
    hist = "struct<schema:int,zero_threshold:double,zero_count:double,count:double,sum:double,pos_spans:array<struct<offset:int,length:int>>,pos_buckets:array<double>,neg_spans:array<struct<offset:int,length:int>>,neg_buckets:array<double>,custom_values:array<double>,reset_hint:int>"
    h = lambda n, spans=1, custom=None: (0, 0.1, 0.0, float(n), 1.0, [(0, spans)], [float(n)] * spans, [], [], custom, 0)
    rows = [("m", t, None, "histogram", x) for t, x in enumerate([h(1), h(2), h(3), h(1), h(2), h(3, 2), h(4, 2), h(5, 2, [1.0])])]
    rows += [("m", t, 1.0, "XOR", None) for t in range(35)]
    df = spark.createDataFrame(rows, f"l_a string, t long, v double, enc string, hist {hist}")
    c = convert(df, 0, 99, ConvertOptions(samples_per_chunk=30))
    got = [(r.enc, r.chunk_no, r.n) for r in c.chunks.orderBy("enc_order", "chunk_no").collect()]
    assert got == [("XOR", 0, 30), ("XOR", 1, 5), ("histogram", 0, 3), ("histogram", 1, 2), ("histogram", 2, 2), ("histogram", 3, 1)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """60 metrics x 5 series, 250 samples at one minute, two shards and label-poor rows."""
    base = spark.range(300).select((F.col("id") % 60).alias("m"), F.floor(F.col("id") / 60).alias("u"))
    df = base.select(
        F.concat(F.lit("metric_"), "m").alias("l___name__"),
        F.concat(F.lit("unique_"), "u").alias("l_unique"),
        F.when(F.col("m") % 3 == 0, F.concat(F.lit("r"), "u")).alias("l_random name .x"),
        F.explode(F.sequence(F.lit(0), F.lit(249))).alias("i"),
        F.col("m").cast("double").alias("v"),
    ).withColumn("t", (F.col("i") * MIN).cast("long"))
    c = convert(df.drop("i"), 0, 250 * MIN, ConvertOptions(name="b", column_duration=HOUR, row_groups=3, row_group_size=50))
    root = str(tmp_path_factory.mktemp("store"))
    write_store(c, root)
    return open_store(spark, root)


def test_select_from_files(spark, store):
    q = Querier(store, 0, 250 * MIN)
    assert q.select(eq("unique", "unique_0")).count() == 60
    assert q.select(eq("unique", "unique_0"), hints=SelectHints(func="series")).count() == 60
    rows = q.select(eq("__name__", "metric_7")).collect()
    assert len(rows) == 5 and all(sum(c.n for c in r.chunks) == 250 and len(r.chunks) == 5 for r in rows)
    assert [r.labels for r in rows] == sorted(r.labels for r in rows)
    assert all([c.min_t for c in r.chunks] == sorted(c.min_t for c in r.chunks) for r in rows)
    hit = (eq("__name__", "metric_0"), eq("unique", "unique_0"))
    for lo, hi, n in ((0, HOUR - 1, 1), (0, 2 * HOUR - 1, 2), (9 * HOUR, 10 * HOUR, 0)):
        got = Querier(store, lo, hi).select(*hit).collect()
        assert [len(r.chunks) for r in got] == ([n] if n else [])
    part = Querier(store, 30 * MIN, 90 * MIN)
    assert part.samples(*hit, trim=False).count() == 120 and part.samples(*hit).count() == 61
    assert q.select(eq("random name .x", "")).count() == 200 and q.select(re("random name .x", ".+")).count() == 100
    assert Querier(store, 0, 1).select(hints=SelectHints(start=9 * HOUR, end=10 * HOUR)).count() == 0
    with pytest.raises(FileNotFoundError):
        store.shard("b", 9)
    assert store.shard("b", 1).series.count() == 150


def test_metadata(store):
    q = Querier(store, 0, 250 * MIN)
    names = lambda df: [r[0] for r in df.collect()]
    assert names(q.label_names()) == ["__name__", "random name .x", "unique"]
    assert names(q.label_names(eq("__name__", "metric_1"))) == ["__name__", "unique"]
    assert names(q.label_names(limit=2)) == ["__name__", "random name .x"]
    assert names(q.label_values("unique")) == [f"unique_{i}" for i in range(5)]
    assert names(q.label_values("random name .x", eq("unique", "unique_3"))) == ["r3"]
    assert names(q.label_values("unique", limit=2)) == ["unique_0", "unique_1"] and names(q.label_values("nope")) == []
    assert names(Querier(store, 10**9, 10**10).label_names()) == []


def test_quotas_and_callbacks(store):
    def run(**o):
        return Querier(store, 0, 250 * MIN, QueryOptions(**o)).select(eq("unique", "unique_0"))

    for name, small, message in (("row_limit", 10, "too many rows"), ("chunk_bytes_limit", 100, "too many chunk bytes"), ("data_bytes_limit", 100, "too many data bytes")):
        with pytest.raises(ResourceExhausted, match=message) as e:
            run(**{name: lambda: small})  # noqa: B023
        assert is_resource_exhausted(e.value)
        assert run(**{name: lambda: 10**9}).count() == 60
    seen = []
    run(series_callback=seen.append)
    assert len(seen) == 60

    def fail(row):
        raise RuntimeError("from the callback")

    with pytest.raises(RuntimeError, match="from the callback"):
        run(series_callback=fail)
    assert run(labels_filter=lambda df: df.limit(0)).count() == 0
    assert run(labels_filter=lambda df: df.where("`l_random name .x` IS NULL")).count() == 40
    cache = MatchCache()
    assert run(cache=cache).count() == run(cache=cache).count() == 60 and len(cache) == 1
    assert not is_resource_exhausted(ValueError("x"))


def test_quota_table():
    for limit, steps, fails in ((100, (30, 40, 20), 0), (100, (100,), 0), (100, (50, 60), 1), (100, (0,), 0), (100, (-10,), 0), (0, (1000, 2000, 3000), 0)):
        q = Quota(limit)
        if fails:
            with pytest.raises(ResourceExhausted):
                [q.reserve(s) for s in steps]
        else:
            [q.reserve(s) for s in steps]
    q = Quota(1000)
    threads = [threading.Thread(target=q.reserve, args=(100,)) for _ in range(10)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    with pytest.raises(ResourceExhausted):
        q.reserve(1)


def test_projection(spark):
    rows = [("up", "api" if i % 2 else "web", f"i{i}", i, 1.0) for i in range(10)]
    s = in_memory(convert(series_samples(spark, rows, ["__name__", "service", "instance"]), 0, 20))

    def run(names, include, honor=True):
        hints = SelectHints(0, 20, projection_labels=names, projection_include=include)
        return Querier(s, 0, 20, QueryOptions(honor_projection_hints=honor)).select(hints=hints)

    shown = lambda df: sorted(c for c in df.columns if c.startswith(("l_", "s_")))
    df = run(("__name__", "service"), True)
    assert df.count() == 10 and shown(df) == ["l___name__", "l_service"] and df.select("labels").distinct().count() == 2
    assert shown(run(("instance",), False)) == ["l___name__", "l_service", "s_series_hash"]
    assert shown(run(("instance", "s_series_hash"), False)) == ["l___name__", "l_service"]
    assert shown(run((), False)) == ["l___name__", "l_instance", "l_service"]
    assert len(shown(run(("__name__",), True, honor=False))) == 4
    flat = Querier(s, 0, 20).samples()
    assert {r.l_service: r.sum for r in vector.aggregate(flat, "sum", ["service"]).collect()} == {"api": 5.0, "web": 5.0}


def test_two_shards_merge_by_concatenation(spark):
    a = convert(series_samples(spark, [(n, r, 1, 1.0) for n, r in (("x", "region-a"), ("y", "region-a"), ("z", "region-b"))], ["__name__", "region"]), 0, 9, ConvertOptions(name="a"))
    rows = [(n, r, "E", 1, 2.0) if n > "y" else (n, r, None, 1, 2.0) for n, r in (("x", "region-a"), ("y", "region-a"), ("w", "region-a"), ("z", "region-c"))]
    b = convert(series_samples(spark, rows, ["__name__", "region", "ENV"]), 0, 9, ConvertOptions(name="b"))
    q = Querier(in_memory(a, b), 0, 9)
    rows = q.select(sort=True).collect()
    assert len(rows) == 5 and [r.labels for r in rows] == sorted(r.labels for r in rows)
    assert {len(r.chunks) for r in rows if r.l___name__ in "xy"} == {2}
    assert q.select(eq("region", "region-a")).count() == 3 and q.select(eq("ENV", "E")).count() == 1


def test_empty_matchers_on_routes(spark):
    rows = [("nginx-1", "/", 60_000, 2.0), ("nginx-2", None, 60_000, 4.0), ("nginx-3", "/", 60_000, 6.0), ("nginx-4", "", 60_000, 8.0)]
    s = in_memory(convert(series_samples(spark, rows, ["pod", "route"]), 0, 60_000))
    for matchers, want in (((eq("route", ""), re("route", ""), nre("route", ".+")), [4.0, 8.0]), ((neq("route", ""), nre("route", ""), re("route", ".+")), [2.0, 6.0])):
        for m in matchers:
            v = vector.instant_vector(Querier(s, 0, 60_000).samples(m), ["l_pod"], 60_000)
            assert sorted(r.v for r in v.collect()) == want


def test_ranges(spark):
    r = lambda *x: spark.createDataFrame(list(x), "start long, count long")
    got = lambda df: sorted((x["start"], x["count"]) for x in df.select("start", "count").collect())
    assert got(row_ranges.simplify(r((0, 10), (10, 5), (3, 2), (20, 0), (30, 1)))) == [(0, 15), (30, 1)]
    assert got(row_ranges.intersect(r((0, 4), (8, 4)), r((2, 8)))) == [(2, 2), (8, 2)]
    assert got(row_ranges.intersect(r((0, 4)), r((4, 4)))) == []
    assert got(row_ranges.complement(r((0, 10), (20, 5)), r((2, 3), (8, 14)))) == [(0, 2), (5, 3), (22, 3)]
    assert got(row_ranges.partition_ranges(r((0, 5), (8, 2), (100, 1)), 3)) == [(0, 10), (100, 1)]


def test_sorted_merge_and_hash(spark):
    w = lambda s: spark.createDataFrame([(c,) for c in s], "value string")
    got = lambda *x, limit=0: "".join(r.value for r in projection.merge_sorted([w(s) for s in x], limit).collect())
    assert got("abc", "bcd") == "abcd" and got("abc", "de", limit=3) == "abc" and got("ca", "ba") == "abc" and got("ca", "ba", limit=2) == "ab"
    assert stable_hash([]).hex() == "ef46db3751d8e999"  # xxHash64 of nothing, seed 0
    assert stable_hash([("b", "2"), ("a", "1")]) == stable_hash([("a", "1"), ("b", "2")]) != stable_hash([("a", "12")])


def test_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:10", 1.0), ("a", "2024-01-01 00:40:00", 2.0), ("b", "2024-01-01 00:10:00", 3.0), ("a", "2024-01-01 03:00:00", 4.0)]
    df = spark.createDataFrame(rows, "l_x string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = write_buckets(bucketed_stream(src, "1 hour", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.labels[0].value, r.n) for r in out) == [("a", 2), ("b", 1)]


def test_vector_layer(spark):
    df = series_samples(spark, [("a", 0, 1.0), ("a", 10_000, 5.0), ("a", 20_000, 2.0), ("b", 0, 1.0), ("b", 20_000, float("nan"))], ["x"])
    assert [(r.l_x, r.v) for r in vector.instant_vector(df, ["l_x"], 20_000).collect()] == [("a", 2.0)]
    assert vector.increase(df.where("l_x = 'a'"), ["l_x"], -1, 20_000).first()["increase"] == 6.0
    assert vector.rate(df.where("l_x = 'a'"), ["l_x"], -1, 19_999).first()["rate"] == 0.2


def test_entry_point_without_the_llm_folders(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['chronoloom.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and 'pipeline' not in e.queries(); assert set(e.oracle_sql()) <= set(e.queries())"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
    sys.path.insert(0, root)
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_bars_behind_escaped_backslashes(spark):
    from chronoloom.functions.regex import literal_set, matches

    assert literal_set("a\\\\|b") == ["a\\", "b"] and literal_set("a\\|b") == ["a|b"]
    samples = series_samples(spark, [("b", 0, 1.0), ("a\\", 0, 1.0), ("a|b", 0, 1.0)], ["x"])
    from chronoloom.operators.matchers import all_of

    for pattern in ("a\\\\|b", "a\\|b", "a\\\\|b.*"):
        got = {r.l_x for r in samples.where(all_of([re("x", pattern)], samples.columns)).collect()}
        assert got == {v for v in ("b", "a\\", "a|b") if matches(pattern, v)}, pattern


def test_cache_tells_stores_apart_and_is_bounded(spark):
    from chronoloom import MatchCache

    cache, found = MatchCache(size=2), []
    for rows in ([("a", 0, 1.0)], [], [("b", 0, 1.0), ("c", 0, 1.0)]):
        store = in_memory(convert(series_samples(spark, rows, ["x"]), 0, 10))
        found.append(Querier(store, 0, 10, QueryOptions(cache=cache)).select(hints=SelectHints(func="series")).count())
        del store
    assert found == [1, 0, 2] and len(cache) == 2


def test_several_blocks_read_their_own_columns(spark):
    rows = [("a", t * HOUR, float(t)) for t in range(30)]
    blocks = [convert(series_samples(spark, rows, ["x"]), i * 10 * HOUR, (i + 1) * 10 * HOUR - 1, ConvertOptions(name=f"b{i}", column_duration=HOUR)) for i in range(3)]
    q = Querier(in_memory(*blocks), 12 * HOUR, 13 * HOUR - 1)
    plan = q._chunks(q.mint, q.maxt)._jdf.queryExecution().optimizedPlan().toString()
    assert "b1" in plan and "b0" not in plan.split("Filter")[1].split("\n")[0] and "b2" not in plan.split("Filter")[1].split("\n")[0]
    assert [r.t for r in q.samples().collect()] == [12 * HOUR]
    both = Querier(in_memory(*blocks), 0, 30 * HOUR).select(sort=False).collect()
    assert len(both) == 1 and len(both[0].chunks) == 30


def test_files_of_a_store_do_not_grow_with_its_shards(spark, tmp_path):
    from pathlib import Path

    options = ConvertOptions(name="b", column_duration=HOUR, row_groups=2, row_group_size=5, samples_per_chunk=2)
    c = convert(grid(spark, 400, HOUR // 2, 4), 0, 2 * HOUR - 1, options)
    write_store(c, str(tmp_path))
    files = {n: list((tmp_path / n).rglob("*.parquet")) for n in ("series", "chunks")}
    assert len(files["series"]) <= 8 and len(files["chunks"]) <= 16  # 40 shards; at most a file a task and folder
    store = open_store(spark, str(tmp_path))
    assert store.shard_meta.count() == 40 and store.shard("b", 39).series.count() == 10
    assert store.shard("b", 7).chunks.select("series_id").distinct().count() == 10
    plan = store.shard("b", 7).chunks._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(shard,7)" in plan.split("PushedFilters")[1].split("ReadSchema")[0]
    for name, order in (("series", ["row_no"]), ("chunks", ["chunk_no"])):
        for f in files[name]:  # statistics of pages are tight only if rows are in order
            rows = [tuple(r) for r in spark.read.parquet(str(Path(f))).select("shard", "series_id", *order).collect()]
            assert rows == sorted(rows)
    got = Querier(store, 0, 2 * HOUR - 1).select(sort=False).collect()
    assert len(got) == 400 and all([k.n for k in r.chunks] == [2, 2] for r in got)


def test_shards_are_asked_for_by_runs(spark):
    from chronoloom.plans.query import runs_of

    assert runs_of({5, 1, 2, 3, 7}) == [(1, 3), (5, 5), (7, 7)] and runs_of(set()) == []
    c = convert(grid(spark, 400, HOUR, 1), 0, HOUR - 1, ConvertOptions(name="b", column_duration=HOUR, row_groups=1, row_group_size=10))
    whole = in_memory(c)
    size = lambda s: len(Querier(s, 0, HOUR - 1)._chunks(0, HOUR - 1)._jdf.queryExecution().logical().toString())
    few = whole.shard("b", 0)
    assert size(whole) < size(few) + 200
    holes = Querier(type(whole)(whole.series, whole.chunks, whole.shard_meta.where("shard % 2 = 1")), 0, HOUR - 1)
    assert sorted(r.shard for r in holes._chunks(0, HOUR - 1).select("shard").distinct().collect()) == list(range(1, 40, 2))

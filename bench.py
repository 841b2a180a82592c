"""Headline queries: eleven matcher shapes over stored series, and conversion.

Prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from chronoloom import Querier, eq, neq, nre, open_store, re, write_store
from chronoloom.catalog import MAXT, MINT, OPTIONS
from chronoloom.plans.convert import convert
from chronoloom.sources import tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

SHAPES = {
    "select_single_metric": [eq("__name__", "click")],
    "select_metric_and_label": [eq("__name__", "click"), eq("env", "prod")],
    "select_one_series": [eq("__name__", "click"), eq("user", "user-7")],
    "select_not_equal": [eq("__name__", "click"), neq("env", "prod")],
    "select_empty_label": [eq("route", "")],
    "select_regex_set": [re("__name__", "click|view|purchase")],
    "select_regex_prefix": [re("user", "user-1.*")],
    "select_regex_general": [re("user", r"user-\d*[13579]")],
    "select_regex_negated": [nre("route", "/r[12]?")],
    "select_any": [re("__name__", ".+")],
    "select_no_match": [eq("__name__", "nothing")],
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    with tempfile.TemporaryDirectory() as root:
        samples = tables.events(spark, SF_DIR)
        samples.count()  # starts the session up
        began = time.perf_counter()
        write_store(convert(samples, MINT, MAXT, OPTIONS.with_(samples_per_chunk=120, row_groups=4, row_group_size=1000)), root)
        took["convert"] = time.perf_counter() - began
        querier = Querier(open_store(spark, root), MINT, MAXT)
        for name, matchers in SHAPES.items():
            began = time.perf_counter()
            querier.select(*matchers).write.format("noop").mode("overwrite").save()
            took[name] = time.perf_counter() - began
        for name, run in (("label_names", querier.label_names), ("label_values", lambda: querier.label_values("user"))):
            began = time.perf_counter()
            run().collect()
            took[name] = time.perf_counter() - began
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    total = sum(took.values())
    print(json.dumps({"metric": "total_seconds", "value": round(total, 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in took.items()}, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

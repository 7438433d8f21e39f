"""Routes stored with their legs: plans without joins, unknown places, running sums beyond one chunk."""

import io
import os
import shutil
from collections import Counter
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.bindings import World
from fieldtally.operators import ordering
from fieldtally.plans import quality, routes
from fieldtally.sources.store import FactStore

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    for name in ("lineitem", "supplier", "nation", "region", "orders", "customer"):
        shutil.copy(f"{SOURCE}/{name}.parquet", tmp_path / f"{name}.parquet")
        os.chmod(tmp_path / f"{name}.parquet", 0o644)
    return tmp_path


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_metrics_need_no_shuffle_and_times_no_join(spark, folder):
    w = World(spark, str(folder))
    assert "Exchange" not in plan(w.route_metrics)
    assert "Join" not in plan(routes.times_of(w.reached_stops))


def test_stored_legs_equal_the_general_step_and_keep_unknown_places(spark, folder):
    """A supplier is gone: its legs have no length, and the general step over a matrix says the same."""
    kept = spark.read.parquet(f"{SOURCE}/supplier.parquet").where("s_suppkey <> 3")
    os.remove(folder / "supplier.parquet")
    kept.write.parquet(str(folder / "supplier.parquet"))
    w = World(spark, str(folder))
    reached = w.reached_stops
    matrix = reached.where("distance_m IS NOT NULL").select(
        F.col("from_index").alias("i"), F.col("matrix_index").alias("j"), "distance_m", "travel_seconds"
    ).dropDuplicates(["i", "j"])
    general = routes.reached_stops(w.route_stops, matrix).select(*reached.columns)
    assert Counter(map(tuple, general.collect())) == Counter(map(tuple, reached.collect()))
    lost = reached.where("has_leg AND (from_index = 4 OR matrix_index = 4)")
    assert lost.count() > 0 and lost.where("distance_m IS NOT NULL").count() == 0
    assert reached.where("has_leg AND distance_m IS NULL").count() == lost.count()
    assert w.route_metrics.agg(F.sum("unknown_legs")).first()[0] == lost.count()


def test_replay_reads_stored_times_without_ordering_stops_again(spark, folder):
    """Times are those of the general step, with a lost supplier too; first services need one grouping, no window."""
    kept = spark.read.parquet(f"{SOURCE}/supplier.parquet").where("s_suppkey <> 3")
    os.remove(folder / "supplier.parquet")
    kept.write.parquet(str(folder / "supplier.parquet"))
    w = World(spark, str(folder))
    shown = plan(w.first_services)
    assert "Window" not in shown and "Sort " not in shown and shown.count("Exchange hashpartitioning") == 1
    general = routes.times_of(w.reached_stops).select("vehicle", "stop_sequence", F.col("arrival_minutes").alias("want"))
    both = w.timed_stops.join(general, ["vehicle", "stop_sequence"], "full")
    assert both.count() == w.reached_stops.count() > 0
    assert both.where("NOT coalesce(abs(arrival_minutes - want) < 1e-9, false)").count() == 0


def test_running_sum_over_chunks_with_null_keys(spark):
    rows = [(k, i, float(i % 7)) for k in (None, "a") for i in range(95)] + [("b", 3, 2.0)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    summed = ordering.running_sum_split(df, ["k"], "i", "v", "s", chunk_rows=10)
    assert "Join" not in plan(summed)
    got = {(r.k, r.i): r.s for r in summed.collect()}
    for k in (None, "a"):
        assert np.allclose([got[(k, i)] for i in range(95)], np.cumsum([i % 7 for i in range(95)]))
    assert got[("b", 3)] == 2.0 and len(got) == len(rows)


def test_buckets_grow_with_the_input(spark):
    """A task's share is bounded: ten times the bytes are dealt over ten times the buckets."""
    small, large = (FactStore(spark, (("lineitem", 1, n, 0), ("orders", 3, n, 7))).buckets for n in (200 << 20, 2000 << 20))
    assert (small, large) == (100, 1000)
    assert FactStore(spark).buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_large_keys_and_times_are_dealt_over_the_given_tasks(spark, folder):
    w = World(spark, str(folder))
    assert "partitioning(vehicle#" not in plan(w.route_metrics)
    assert ", 77), REPARTITION_BY_NUM" in plan(routes.times_of(w.reached_stops, parts=77))
    checked = quality.check_pk(w.fact_routes, ["route_key"], "routes", 77)
    assert ", 77), REPARTITION_BY_NUM" in plan(checked)
    assert tuple(checked.first()) == tuple(quality.check_pk(w.fact_routes, ["route_key"], "routes").first())


def test_a_mart_in_buckets_has_one_file_a_bucket(spark, folder):
    w = World(spark, str(folder))
    for mart in (w.diagnostics, w.bin_day_rollup, w.stored_metrics):
        assert len(mart.inputFiles()) <= w.store.buckets

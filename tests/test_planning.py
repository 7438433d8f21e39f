"""Priority rules, replay, routes: boundary cases with numbers worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.plans import priority as pr, replay as rp, routes as rt, star


def bins(spark, rows):
    """rows: (bin_id, fill, upper90, hours, age)"""
    full = [(b, "X", f, u, u, u, h, a, True, b % 2 == 0, 100) for b, f, u, h, a in rows]
    return spark.createDataFrame(
        full,
        "bin_id bigint, city_id string, current_fill_pct double, upper80_pct double, upper90_pct double, upper95_pct double, "
        "hours_since_collection double, sensor_age_hours double, network_accessible boolean, in_routing_pilot boolean, capacity_l int",
    )


def test_priority_boundaries(spark):
    frame = bins(spark, [(1, 80.0, 80.0, 2.0, 0.0), (2, 79.0, 79.0, 2.0, 0.0), (3, 10.0, 10.0, 48.0, 0.0), (4, None, None, 2.0, 0.0), (5, 10.0, 10.0, 2.0, 6.0), (6, 10.0, 10.0, None, 6.5)])
    p = {r.bin_id: r for r in pr.prioritize(frame).collect()}
    assert p[1].required and p[1].reasons == "current_trigger;forecast_trigger" and p[1].tier == 1
    assert not p[2].required and p[2].reasons == "below_rules" and p[2].dispatch_status == "monitor"
    assert p[3].gap_trigger and not p[3].current_trigger
    assert p[4].telemetry_trigger and p[4].risk_upper_pct is None and not p[4].forecast_trigger
    assert not p[5].telemetry_trigger and p[6].telemetry_trigger and p[6].gap_trigger and p[6].tier == 2


def test_rank_order_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        fill = None if rng.random() < 0.1 else float(rng.choice([100.0, 99.5, rng.uniform(0, 100)]))
        upper = None if fill is None else min(100.0, fill + float(rng.choice([0.0, 50.0])))
        rows.append((i, fill, upper, None if rng.random() < 0.1 else float(rng.integers(0, 90)), float(rng.integers(0, 9))))
    got = pr.prioritize(bins(spark, rows)).toPandas()
    key = got.assign(
        r=-got.risk_upper_pct.fillna(-1), f=-got.current_fill_pct.fillna(-1), h=-got.hours_since_collection.fillna(-1)
    ).sort_values(["tier", "r", "f", "h", "bin_id"])
    assert list(key.priority_rank) == list(range(1, 301))


def test_required_sets_are_nested(spark):
    rng = np.random.default_rng(2)
    frame = bins(spark, [(i, float(a), float(a) + 5, 2.0, 0.0) for i, a in enumerate(rng.uniform(50, 100, 80))])
    sets = [{r.bin_id for r in pr.prioritize(frame, t).where("required").collect()} for t in (70, 80, 90)]
    assert sets[2] < sets[1] < sets[0]
    grid = {(r.trigger_pct, r.interval_level, r.max_gap_hours): r.required_bins for r in pr.priority_grid(frame).collect()}
    assert len(grid) == 27 and [grid[(t, 90, 48)] for t in (70, 80, 90)] == [len(s) for s in sets]


def test_demand_stress_scales_the_increment_only(spark):
    frame = bins(spark, [(2, 50.0, 70.0, 2.0, 0.0), (4, 60.0, 55.0, 2.0, 0.0)])
    got = {r.bin_id: r.risk_upper_pct for r in pr.prioritize(frame, demand=1.2).collect()}
    assert np.isclose(got[2], 74.0) and got[4] == 60.0


def one(spark, initial, cap, arrivals, services):
    df = spark.createDataFrame([(initial, cap, arrivals, services)], "i double, c double, a array<double>, s array<double>")
    r = df.select(rp.replay("i", "c", "a", "s").alias("r")).first().r
    return r.inv, r.spill, r.removed


@pytest.mark.parametrize("service, want", [([0.0], (100.0, 5.0, 95.0)), ([60.0], (55.0, 50.0, 95.0))])
def test_replay_by_hand(spark, service, want):
    assert np.allclose(one(spark, 100.0, 100.0, [100.0], service), want)


def test_replay_equals_a_step_simulation(spark):
    rng = np.random.default_rng(8)
    for _ in range(12):
        cap, n = 100.0, 4
        arrivals = [float(a) for a in rng.uniform(0, 80, n)]
        services = sorted(float(s) for s in rng.choice(np.arange(0, n * 120, 10), rng.integers(0, 5)))
        inv, spill, removed, initial = (x := float(rng.uniform(0, 100))), 0.0, 0.0, x
        times = sorted({i * 120.0 for i in range(n + 1)} | set(services))
        for a, b in zip(times, times[1:]):
            for _ in range(services.count(a)):
                removed, inv = removed + inv * 0.95, inv * 0.05
            inv += arrivals[int(a // 120)] * (b - a) / 120
            spill, inv = spill + max(0.0, inv - cap), min(cap, inv)
        got = one(spark, initial, cap, arrivals, services)
        assert np.allclose(got, (inv, spill, removed))
        assert np.isclose(initial + sum(arrivals), sum(got))


def test_route_duration_and_feasibility(spark):
    """18 stops: travel + 18 x 240 s + 900 s; a repeated bin and a missing depot are caught."""
    def stops(vehicle, path):
        return [("X", "s", "baseline", vehicle, i, k, 0 if k == 0 else 600) for i, k in enumerate(path)]

    rows = stops(1, [0, *range(1, 19), 0]) + stops(2, [0, 5, 5, 0]) + stops(3, [0, 4]) + stops(4, [0, 0])
    df = spark.createDataFrame(rows, "city_id string, scenario string, method string, vehicle bigint, stop_sequence bigint, matrix_index bigint, planned_capacity_l int")
    matrix = spark.createDataFrame([(i, j, 100.0, 10.0) for i in range(20) for j in range(20)], "i bigint, j bigint, distance_m double, travel_seconds double")
    m = {r.vehicle: r for r in rt.route_metrics(df, matrix).collect()}
    assert (m[1].bins, m[1].distance_m, m[1].load_l) == (18, 1900.0, 10800)
    assert m[1].duration_seconds == 190 + 18 * 240 + 900 and m[4].duration_seconds == 10
    ok = {r.vehicle: r for r in rt.check_routes(df, rt.route_metrics(df, matrix)).collect()}
    assert ok[1].feasible and not ok[2].visits_ok and not ok[3].depot_ok
    times = {r.stop_sequence: r.arrival_minutes for r in rt.stop_times(df, matrix).where("vehicle = 1").collect()}
    assert np.isclose(times[1], 10 / 60) and np.isclose(times[3], 30 / 60 + 8)


def test_matched_comparison_numbers(spark):
    rows = [("X", s, m, 1, d, 3600.0, 7200.0) for s in ("base", "cheap") for m, d in (("baseline", 57343.88166890512), ("optimized", 45498.331318450596))]
    metrics = spark.createDataFrame(rows + [("X", "small", "baseline", 1, 1000.0, 1.0, 1.0)], "city_id string, scenario string, method string, vehicle bigint, distance_m double, travel_seconds double, duration_seconds double")
    req = spark.createDataFrame([("X", "base", 3, 25160, 1.0), ("X", "cheap", 3, 25160, 0.8), ("X", "small", 2, 25160, 1.0)], "city_id string, scenario string, vehicles_available int, full_capacity_l_required bigint, fuel_price_multiplier double")
    got = {r.scenario: r for r in rt.compare_methods(metrics, rt.capacity_certificate(req)).collect()}
    b = got["base"]
    assert np.allclose([b.km_saved, b.fuel_l_saved_assumed, b.fuel_cost_inr_saved_historical_proxy, b.tailpipe_co2_kg_saved_proxy], [11.845550350454523, 2.6323445223232276, 243.202310417443, 7.078374420527159])
    assert np.isclose(got["cheap"].fuel_cost_inr_saved_historical_proxy, 194.5618483339544)
    assert got["small"].status == "proven_infeasible_capacity" and got["small"].km_saved is None and got["small"].baseline_km is None
    fuel = {r.km_per_l_assumed: r.fuel_l_saved for r in rt.fuel_sensitivity(rt.compare_methods(metrics, rt.capacity_certificate(req)).where("scenario = 'base'")).collect()}
    assert np.allclose([fuel[3.0], fuel[4.5], fuel[6.0]], [3.9485167, 2.6323445, 1.9742584])


def test_overflow_comparison(spark):
    rows = [("base", "baseline", 104.76719117167977), ("base", "optimized", 93.70377236199346), ("t70", "baseline", 44.97627647741459), ("t70", "optimized", 52.32982117184724)]
    df = spark.createDataFrame(rows, "scenario string, method string, overflow_l double")
    got = {r.scenario: r.overflow_l_avoided_modelled for r in star.overflow_comparison(df, ["scenario"]).collect()}
    assert np.isclose(got["base"], 11.063418809686297) and np.isclose(got["t70"], -7.353544694432657)


def test_links_of_all_kinds_in_one_pass(spark):
    from fieldtally.plans import quality

    tables = {
        "a": spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string"),
        "b": spark.createDataFrame([(1, "x", 1), (3, "z", 2), (3, None, None), (4, "y", 9)], "a_id bigint, a_name string, own int"),
        "c": spark.createDataFrame([(None,), ("x",)], "name string"),
    }
    links = [("a", "id", "b", "a_id"), ("a", "name", "b", "a_name"), ("b", "own", "b", "own"), ("a", "name", "c", "name"), ("c", "name", "a", "name")]
    got = {(r.parent, r.child): (r.orphan_keys, r.orphan_rows) for r in quality.check_links(tables, links).collect()}
    assert got == {
        ("a.id", "b.a_id"): (2, 3),
        ("a.name", "b.a_name"): (1, 1),
        ("b.own", "b.own"): (0, 0),
        ("a.name", "c.name"): (0, 0),
        ("c.name", "a.name"): (1, 1),
    }

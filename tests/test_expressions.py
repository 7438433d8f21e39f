import math

from pyspark.sql import functions as F

from fieldtally.functions import expressions as x
from fieldtally.settings import ROAD_SPEED_KMH


def values(df, c):
    return [r[c] for r in df.collect()]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-5.0,), (50.0,), (120.0,), (None,)], "v double")
    assert values(df.select(x.clip("v", 0.0, 100.0).alias("c")), "c") == [0.0, 50.0, 100.0, None]


def test_safe_div_and_null_safe_difference(spark):
    df = spark.createDataFrame([(4.0, 2.0), (4.0, 0.0), (None, 1.0)], "a double, b double")
    assert values(df.select(x.safe_div("a", "b").alias("q")), "q") == [2.0, None, None]
    assert values(df.select(x.is_distinct("a", F.lit(4.0)).alias("d")), "d") == [False, False, True]


def test_fill_bands_at_their_edges(spark):
    df = spark.createDataFrame([(0.0,), (19.99,), (20.0,), (59.0,), (80.0,), (100.0,), (None,)], "v double")
    rows = df.select(x.fill_band("v").alias("b"), x.fill_band_sort("v").alias("s")).collect()
    assert [(r.b, r.s) for r in rows] == [
        ("0–19%", 1), ("0–19%", 1), ("20–39%", 2), ("40–59%", 3), ("80–100%", 5), ("80–100%", 5), ("Missing", 6),
    ]


def test_numeric_limit(spark):
    texts = ["12 t", "3.5m", " 7 tonnes ", "2 meters", "none", "", None, "12 t axle", "4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df.select(x.numeric_limit("t").alias("n")), "n") == [12.0, 3.5, 7.0, 2.0, -1.0, None, None, -1.0, 4.0]


def test_speed_is_capped_by_a_posted_number(spark):
    df = spark.createDataFrame(
        [("primary", None), ("primary", "20"), ("primary", "60 km/h"), ("primary", "signals"), ("service", "")],
        "c string, m string",
    )
    assert values(df.select(x.speed_of("c", "m", ROAD_SPEED_KMH).alias("s")), "s") == [35.0, 20.0, 35.0, 35.0, 15.0]


def test_reason_list(spark):
    df = spark.createDataFrame([(True, False, True), (False, False, False)], "a boolean, b boolean, c boolean")
    assert values(df.select(x.reason_list(["a", "b", "c"]).alias("r")), "r") == ["a;c", "below_rules"]


def test_normal_tail_matches_erfc(spark):
    zs = [0.0, 0.5, -1.3, 1.96, 2.0, 3.7, 8.0, 32.48]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = values(df.select(x.normal_two_sided_p("z").alias("p")), "p")
    for z, p in zip(zs, got):
        assert math.isclose(p, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9)


def test_pairs_and_coordinates(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([7],), ([],)], "a array<bigint>")
    got = values(df.select(x.consecutive_pairs("a").alias("p")), "p")
    assert [[(q.u, q.v) for q in p] for p in got] == [[(1, 2), (2, 3)], [], []]
    text = spark.createDataFrame([(" 1.0,2.0,0\n 3.5,4.5 ",)], "t string")
    assert [(p.lon, p.lat) for p in values(text.select(x.parse_coords("t").alias("c")), "c")[0]] == [(1.0, 2.0), (3.5, 4.5)]


def test_local_time_and_weeks(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2026-01-04 20:00:00' AS ts, DATE '2026-01-04' AS d")
    r = df.select(
        x.to_local("ts").alias("l"), x.week_start("d").alias("w"), x.iso_weekday("d").alias("i"), x.sunday_zero("d").alias("s")
    ).first()
    assert str(r.l) == "2026-01-05 01:30:00" and str(r.w) == "2025-12-29" and (r.i, r.s) == (7, 0)

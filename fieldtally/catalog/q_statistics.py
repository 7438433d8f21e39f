"""Statistics over day series and bin summaries."""

from __future__ import annotations

from fieldtally.catalog.q_questions import BIN_SUMMARY, CITY_FRAME
from fieldtally.catalog.registry import query
from fieldtally.plans import questions as q, statistics as st
from fieldtally.session import cut_lineage

CORR_COLUMNS = ["gross_capacity_pct_day", "overflow_days", "successful_collections", "mean_observed_fill_pct"]


def corr_sql(prefix: str) -> str:
    pairs = [(a, b) for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i + 1 :]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS left_metric, '{b}' AS right_metric, corr({prefix}{a}, {prefix}{b}) AS correlation FROM ranked"
        for a, b in pairs
    )


RANKED = "SELECT *, " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in CORR_COLUMNS
)


@query("M1", f"WITH ranked AS ({RANKED} FROM ({BIN_SUMMARY})) {corr_sql('r_')}", "correlation")
def _(w):
    return st.corr_matrix(q.q26(w.bin_day, w.dim_bin), "bin_id", CORR_COLUMNS, "spearman")


@query("M1_pearson", f"WITH ranked AS ({RANKED} FROM ({BIN_SUMMARY})) {corr_sql('')}", "correlation")
def _(w):
    return st.corr_matrix(q.q26(w.bin_day, w.dim_bin), "bin_id", CORR_COLUMNS, "pearson")


TESTS = {"weekend_generated_mass": "generated_kg_simulated", "weekend_overflow_slot_share": "overflow_slot_pct"}

PAIRS_SQL = " UNION ALL ".join(
    f"""SELECT '{test}' AS test_id, CAST(date_trunc('week', service_date) AS DATE) AS week_start,
          avg({c}) FILTER (WHERE NOT weekend) AS weekday_mean, avg({c}) FILTER (WHERE weekend) AS weekend_mean,
          avg({c}) FILTER (WHERE weekend) - avg({c}) FILTER (WHERE NOT weekend) AS weekend_minus_weekday
        FROM ({CITY_FRAME}) GROUP BY 2 HAVING count(*) FILTER (WHERE NOT weekend) = 5 AND count(*) FILTER (WHERE weekend) = 2"""
    for test, c in TESTS.items()
)


def pairs_of(w):
    frame = cut_lineage(q.q28(w.zone_day, w.truth))
    parts = [st.weekend_pairs(frame, c, test_id=test) for test, c in TESTS.items()]
    return parts[0].unionByName(parts[1])


@query("M2", PAIRS_SQL, "weekday_mean weekend_mean weekend_minus_weekday")
def _(w):
    return pairs_of(w)


def hac_sql(lags: int) -> str:
    lagged = ", ".join(f"lag(c, {i}) OVER s AS c{i}" for i in range(1, lags + 1))
    terms = " + ".join(f"{2 * (1 - i / (lags + 1))!r} * sum(c * c{i}) / count(*)" for i in range(1, lags + 1))
    return f"""SELECT test_id, count(*) AS n_weeks, avg(x) AS mean_difference, median(x) AS median_difference,
         stddev_samp(x) AS sd_weekly_difference, avg(x) / stddev_samp(x) AS standardized_effect_dz,
         sqrt((sum(c * c) / count(*) + {terms}) / count(*)) AS hac_standard_error, corr(x, p) AS lag1_autocorrelation,
         count(*) FILTER (WHERE x > 0) AS positive_weeks, avg(weekday_mean) AS mean_weekday, avg(weekend_mean) AS mean_weekend
       FROM (SELECT *, lag(x) OVER s AS p, {lagged} FROM (
               SELECT test_id, week_start, weekday_mean, weekend_mean, weekend_minus_weekday AS x,
                      weekend_minus_weekday - avg(weekend_minus_weekday) OVER (PARTITION BY test_id) AS c FROM ({PAIRS_SQL}))
             WINDOW s AS (PARTITION BY test_id ORDER BY week_start)) GROUP BY 1"""


P_SQL = """CASE WHEN abs({z}) >= 2
       THEN 2 * exp(-{z} * {z} / 2) / 2.5066282746310002 / list_reduce(list_transform(range(0, 60),
            lambda i: 60.0::DOUBLE - i), lambda acc, k: abs({z}) + k / acc, abs({z}))
       ELSE 1 - 2 * exp(-{z} * {z} / 2) / 2.5066282746310002 * (abs({z}) + list_sum(list_transform(range(1, 41),
            lambda k: exp((2 * k + 1) * ln(abs({z})) - list_sum(list_transform(range(1, k + 1), lambda j: ln(2 * j + 1))))))) END"""

TEST_SQL = f"""SELECT *, mean_difference / hac_standard_error AS test_statistic_z,
       mean_difference - 1.95996398454 * hac_standard_error AS ci95_lower,
       mean_difference + 1.95996398454 * hac_standard_error AS ci95_upper FROM ({{inner}})"""
M3_DOUBLES = (
    "mean_difference median_difference sd_weekly_difference standardized_effect_dz hac_standard_error "
    "test_statistic_z ci95_lower ci95_upper lag1_autocorrelation p_value_two_sided"
)


def m3_sql(lags: int) -> str:
    return f"""SELECT * EXCLUDE (mean_weekday, mean_weekend), 'ok' AS status, {lags} AS hac_lags,
               {P_SQL.format(z="test_statistic_z")} AS p_value_two_sided FROM ({TEST_SQL.format(inner=hac_sql(lags))})"""


@query("M3", m3_sql(4), M3_DOUBLES)
def _(w):
    return st.hac_mean_test(pairs_of(w), 4)


@query("M3_lags8", m3_sql(8), M3_DOUBLES)
def _(w):
    return st.hac_mean_test(pairs_of(w), 8)


HOLM_SQL = f"""SELECT test_id, p_value_two_sided, max(step) OVER (ORDER BY p_value_two_sided, test_id
                 ROWS UNBOUNDED PRECEDING) AS p_value_holm FROM (
         SELECT test_id, p_value_two_sided, least(1.0, p_value_two_sided * (3 - row_number() OVER (ORDER BY p_value_two_sided, test_id)))
                AS step FROM ({m3_sql(4)}))"""


@query(
    "M4",
    f"SELECT *, p_value_holm < 0.05 AS reject_h0 FROM ({HOLM_SQL})",
    "p_value_two_sided p_value_holm",
    digits=9,
)
def _(w):
    tests = st.hac_mean_test(pairs_of(w), 4)
    return st.holm(tests).select("test_id", "p_value_two_sided", "p_value_holm", "reject_h0")


@query(
    "M5",
    f"""SELECT a.test_id, a.mean_weekday, a.mean_weekend, 100 * a.mean_difference / a.mean_weekday AS relative_difference_pct,
               b.p_value_two_sided AS p_value_hac8_sensitivity, b.ci95_lower AS ci95_hac8_lower, b.ci95_upper AS ci95_hac8_upper
        FROM ({hac_sql(4)}) a JOIN ({m3_sql(8)}) b ON b.test_id = a.test_id""",
    "mean_weekday mean_weekend relative_difference_pct p_value_hac8_sensitivity ci95_hac8_lower ci95_hac8_upper",
)
def _(w):
    return st.test_summary(pairs_of(w)).select(
        "test_id",
        "mean_weekday",
        "mean_weekend",
        "relative_difference_pct",
        "p_value_hac8_sensitivity",
        "ci95_hac8_lower",
        "ci95_hac8_upper",
    )


DAY_METRICS = ["generated_l_per_bin_day", "mean_fill_pct", "overflow_slot_pct", "collections_per_bin_day"]


@query(
    "M6",
    " UNION ALL ".join(
        f"""SELECT city_id, '{m}' AS metric, count(x) AS n_city_days, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS std,
              quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, skewness(x) AS skewness, corr(x, p) AS lag1_autocorrelation
            FROM (SELECT city_id, CAST({m} AS DOUBLE) AS x, lag(CAST({m} AS DOUBLE)) OVER (PARTITION BY city_id ORDER BY service_date_local) AS p
                  FROM cityday) GROUP BY 1"""
        for m in DAY_METRICS
    ),
    "mean median std q25 q75 skewness lag1_autocorrelation",
)
def _(w):
    return st.diagnostics(w.city_day, "city_id", "service_date_local", DAY_METRICS)

"""Transparent dispatch rules on observed values and forecast bounds."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from fieldtally.functions.expressions import choose, clip, reason_list
from fieldtally.operators.ordering import split_position
from fieldtally.settings import STALE_SENSOR_HOURS

TRIGGERS = ["current_trigger", "telemetry_trigger", "gap_trigger", "forecast_trigger"]


def true_if(cond: Column) -> Column:
    """NULL comparisons count as false."""
    return F.coalesce(cond, F.lit(False))


def risk_upper(upper: Column, demand: Column) -> Column:
    """Current fill plus the stressed forecast increment; current volume is not stressed."""
    now = F.col("current_fill_pct")
    grow = upper - now
    return clip(now + F.when(grow.isNotNull(), F.greatest(grow, F.lit(0.0))) * demand, 0.0, 100.0)


def rule_columns(risk: Column, trigger: Column, gap: Column, stale_hours: float = STALE_SENSOR_HOURS) -> dict[str, Column]:
    fill, hours, age = (F.col(c) for c in ("current_fill_pct", "hours_since_collection", "sensor_age_hours"))
    return {
        "current_trigger": true_if(fill >= trigger),
        "forecast_trigger": true_if(risk >= trigger),
        "gap_trigger": true_if(hours >= gap) | hours.isNull(),
        "telemetry_trigger": true_if(age > stale_hours) | fill.isNull() | age.isNull(),
    }


def required() -> Column:
    return F.col("current_trigger") | F.col("forecast_trigger") | F.col("gap_trigger") | F.col("telemetry_trigger")


def prioritize(
    frame: DataFrame, trigger: float = 80, interval: int = 90, gap: float = 48, demand: float = 1.0,
    part: tuple[str, ...] = ("city_id",),
) -> DataFrame:
    """Triggers, tier, reasons, dispatch status and rank per city.

    The rank is counted over narrow bands of tier, risk, fill and service gap, so
    a city of any size is ordered by many tasks.
    """
    d = frame.withColumn("risk_upper_pct", risk_upper(F.col(f"upper{interval}_pct"), F.lit(float(demand))))
    d = d.withColumns(rule_columns(F.col("risk_upper_pct"), F.lit(float(trigger)), F.lit(float(gap))))
    d = d.withColumns(
        {
            "required": required(),
            "tier": choose([(F.col(t), F.lit(i)) for i, t in enumerate(TRIGGERS, 1)], F.lit(5)),
            "reasons": reason_list(TRIGGERS),
        }
    ).withColumn(
        "dispatch_status",
        choose(
            [
                (F.col("required") & ~F.col("network_accessible"), F.lit("access_review")),
                (F.col("required") & F.col("in_routing_pilot"), F.lit("pilot_required")),
                (F.col("required"), F.lit("required_outside_pilot")),
            ],
            F.lit("monitor"),
        ),
    )
    # Bands must agree with the order: risk first, and only where a band holds a
    # single risk value (clipped at 100, or NULL) may the next column split it, and so on
    # down to ranges of ids for bins without any number.
    last = F.lit(1).cast("bigint")
    risk, fill, hours = (F.col(c) for c in ("risk_upper_pct", "current_fill_pct", "hours_since_collection"))
    alone = F.coalesce((risk.isNull() & fill.isNull()) | ((risk == 100) & ((fill == 100) | fill.isNull())), F.lit(False))
    bands = [
        F.col("tier"),
        F.coalesce(-F.floor(risk * 1000), last),
        F.when(risk.isNull() | (risk == 100), F.coalesce(-F.floor(fill * 100), last)).otherwise(0),
        F.when(alone, F.coalesce(-F.floor(hours * 60), last)).otherwise(0),
        F.when(alone & hours.isNull(), F.floor(F.col("bin_id") / 1000)).otherwise(0),
    ]
    ranked = split_position(
        d,
        list(part),
        bands,
        [
            F.col("tier"),
            F.col("risk_upper_pct").desc_nulls_last(),
            F.col("current_fill_pct").desc_nulls_last(),
            F.col("hours_since_collection").desc_nulls_last(),
            F.col("bin_id"),
        ],
        "priority_rank",
    )
    return ranked.withColumns(
        {
            "trigger_pct": F.lit(float(trigger)),
            "interval_level": F.lit(interval),
            "max_gap_hours": F.lit(float(gap)),
            "demand_multiplier": F.lit(float(demand)),
        }
    )


def _grid(frame: DataFrame, rows: list[dict]) -> DataFrame:
    """Each bin meets each setting of a small fixed list (exploded from a literal array)."""
    entries = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])
    return frame.withColumn("__s", F.explode(entries)).select("*", "__s.*").drop("__s")


def priority_grid(frame: DataFrame, triggers=(70, 80, 90), intervals=(80, 90, 95), gaps=(36, 48, 72)) -> DataFrame:
    """Counts under every combination of settings, one grouped pass."""
    rows = [
        {"trigger_pct": t, "interval_level": i, "max_gap_hours": g} for t, i, g in product(triggers, intervals, gaps)
    ]
    wide = _grid(frame, rows)
    upper = choose([(F.col("interval_level") == i, F.col(f"upper{i}_pct")) for i in intervals])
    risk = risk_upper(upper, F.lit(1.0))
    ruled = wide.withColumns(rule_columns(risk, F.col("trigger_pct"), F.col("max_gap_hours"))).withColumn(
        "required", required()
    )
    need, pilot = F.col("required"), F.col("in_routing_pilot")
    return ruled.groupBy("trigger_pct", "interval_level", "max_gap_hours").agg(
        F.count_if(need).alias("required_bins"),
        F.count_if(need & pilot).alias("pilot_required_bins"),
        F.count_if(need & ~F.col("network_accessible")).alias("access_exceptions"),
        F.coalesce(F.sum(F.when(need & pilot, F.col("capacity_l"))), F.lit(0)).alias("full_capacity_l_required_pilot"),
    )


# The planning scenarios (name, vehicles, trigger, demand, fuel price).
SCENARIOS = [
    ("base_3_trucks", 3, 80.0, 1.0, 1.0),
    ("one_truck", 1, 80.0, 1.0, 1.0),
    ("two_trucks", 2, 80.0, 1.0, 1.0),
    ("trigger_70", 3, 70.0, 1.0, 1.0),
    ("trigger_90", 3, 90.0, 1.0, 1.0),
    ("demand_plus20", 3, 80.0, 1.2, 1.0),
    ("truck_unavailable", 2, 80.0, 1.0, 1.0),
    ("fuel_minus20", 3, 80.0, 1.0, 0.8),
    ("fuel_plus20", 3, 80.0, 1.0, 1.2),
]
SCENARIO_FIELDS = ("scenario", "vehicles_available", "trigger_pct", "demand_multiplier", "fuel_price_multiplier")


def scenario_sets(frame: DataFrame, scenarios=SCENARIOS, interval: int = 90, gap: float = 48) -> DataFrame:
    """Required pilot bins of every scenario, long form (scenario fields, bin)."""
    rows = [dict(zip(SCENARIO_FIELDS, s)) for s in scenarios]
    wide = _grid(frame.where("in_routing_pilot"), rows)
    risk = risk_upper(F.col(f"upper{interval}_pct"), F.col("demand_multiplier"))
    ruled = wide.withColumns(rule_columns(risk, F.col("trigger_pct"), F.lit(float(gap))))
    return ruled.where(required()).select("city_id", *SCENARIO_FIELDS, "bin_id", "capacity_l")

"""What-if replay of one horizon per bin: bounded stock, spill and services.

An evaluator over latent truth; no forecast or priority plan imports it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldtally.functions.expressions import col
from fieldtally.settings import REMOVED_SHARE, SLOT_MINUTES


def replay(initial, capacity, arrivals, services, take: float = REMOVED_SHARE, slot: int = SLOT_MINUTES) -> Column:
    """struct(terminal, spill, removed) of one bin.

    ``arrivals`` accrue evenly inside consecutive slots; each service (minutes
    from the start) removes a share of what the bin holds.  The horizon is cut
    at slot edges and service times and the pieces are folded in order.
    """
    initial, capacity, arrivals, services = (col(c) for c in (initial, capacity, arrivals, services))
    horizon = (F.size(arrivals) * slot).cast("double")
    edges = F.transform(F.sequence(F.lit(0), F.size(arrivals)), lambda i: (i * slot).cast("double"))
    inside = F.filter(services, lambda s: (s >= 0) & (s < horizon))
    cuts = F.array_sort(F.array_distinct(F.concat(edges, inside)))
    n = F.greatest(F.size(cuts) - 1, F.lit(0))
    pieces = F.arrays_zip(F.slice(cuts, F.lit(1), n).alias("a"), F.slice(cuts, F.lit(2), n).alias("b"))
    start = F.struct(
        initial.cast("double").alias("inv"), F.lit(0.0).alias("spill"), F.lit(0.0).alias("removed")
    )

    def step(acc, p):
        times = F.size(F.filter(inside, lambda s: s == p["a"]))
        left = acc["inv"] * F.pow(F.lit(1 - take), times)
        add = F.get(arrivals, F.floor(p["a"] / slot).cast("int")) * (p["b"] - p["a"]) / slot
        return F.struct(
            F.least(capacity.cast("double"), left + add).alias("inv"),
            (acc["spill"] + F.greatest(F.lit(0.0), left + add - capacity)).alias("spill"),
            (acc["removed"] + acc["inv"] - left).alias("removed"),
        )

    return F.aggregate(pieces, start, step)


def replay_table(
    bins: DataFrame, services: DataFrame, plans: list[tuple], keys: list[str], demand: Column | None = None
) -> DataFrame:
    """Replay each bin under each plan: ``bins`` has bin_id, initial_l, capacity_l, arrivals (array, one horizon).

    ``plans`` is the configured list of key values; plans without any service
    are skipped.  ``services`` lists service minutes per (keys, bin); a bin is
    replayed under every plan, served or not.
    """
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, plan)]) for plan in plans])
    population = bins.withColumn("__p", F.explode(listed)).select("*", "__p.*").drop("__p")
    population = population.join(services.select(*keys).distinct(), keys, "left_semi")
    times = services.groupBy(*keys, "bin_id").agg(F.array_sort(F.collect_list("minute")).alias("services"))
    rows = population.join(times, [*keys, "bin_id"], "left").withColumn(
        "services", F.coalesce("services", F.array().cast("array<double>"))
    )
    factor = F.lit(1.0) if demand is None else demand
    rows = rows.withColumn("arrivals", F.transform("arrivals", lambda a: a * factor))
    rows = rows.withColumn("__r", replay("initial_l", "capacity_l", "arrivals", "services"))
    return rows.select(
        *keys,
        "bin_id",
        "initial_l",
        F.aggregate("arrivals", F.lit(0.0), lambda a, v: a + v).alias("arrivals_l"),
        F.col("__r.inv").alias("terminal_l"),
        F.col("__r.spill").alias("overflow_l"),
        F.col("__r.removed").alias("collected_l"),
        F.size("services").alias("collection_count"),
        "capacity_l",
    )


def balance_gap(rows: DataFrame) -> DataFrame:
    gap = F.abs(
        F.col("initial_l") + F.col("arrivals_l") - F.col("terminal_l") - F.col("overflow_l") - F.col("collected_l")
    )
    return rows.agg(F.max(gap).alias("max_gap_l"), F.count(F.lit(1)).alias("rows"))


def replay_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = ("initial_l", "arrivals_l", "terminal_l", "overflow_l", "collected_l", "collection_count")
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])

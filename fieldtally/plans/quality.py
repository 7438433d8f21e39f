"""Data-quality checks: each is an aggregation that returns counts, not rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType

from fieldtally.operators.ordering import lag_split
from fieldtally.schemas import Contract


def _stack(rows: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rows)


def check_pk(df: DataFrame, key: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Rows, distinct keys and surplus copies.

    Grouping by the key first spreads the work over key values; a plain
    distinct count over a struct would do the same with a wider state.  ``parts`` deals
    a large table's keys over so many tasks, where the session's shuffle partitions are too few.
    """
    if parts is not None:
        df = df.select(*key).repartition(parts, *key)
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__c"))
    return per_key.agg(
        F.coalesce(F.sum("__c"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("__c") > 1).alias("repeated_keys"),
    ).select(F.lit(name).alias("table_name"), "rows", "distinct_keys", "duplicates", "repeated_keys")


def check_table(df: DataFrame, keys: dict[str, list[str]], rules: dict[str, Column]) -> DataFrame:
    """Surplus copies under every key and violations of every rule, from one scan and one shuffle of keys.

    A row gives one (key name, key values) entry for each key; rules are counted with
    the first key's entries before the shuffle.  A key of nulls is a value like any other, and
    the values of a hot key are counts by then.  Without keys no row is shuffled at all.
    Returns check_name and violations; an empty table has none.
    """
    counted = {f"__r{i}": bad for i, bad in enumerate(rules.values())}
    if not keys:
        row = df.agg(*[F.count_if(bad).alias(name) for name, bad in counted.items()])
    else:
        entries = F.array(*[
            F.struct(F.lit(i).alias("k"), F.array(*[F.col(c).cast("string") for c in columns]).alias("v"))
            for i, columns in enumerate(keys.values())
        ])
        marked = df.select(F.explode(entries).alias("e"), *[bad.alias(name) for name, bad in counted.items()])
        per_value = marked.groupBy("e.k", "e.v").agg(
            F.count(F.lit(1)).alias("c"), *[F.count_if(F.col(name) & (F.col("e.k") == 0)).alias(name) for name in counted]
        )
        none = F.lit(0).cast("bigint")
        row = per_value.agg(
            *[F.coalesce(F.sum(F.when(F.col("k") == i, F.col("c") - 1)), none).alias(f"__k{i}") for i in range(len(keys))],
            *[F.coalesce(F.sum(name), none).alias(name) for name in counted],
        )
    names = [(f"__k{i}", name) for i, name in enumerate(keys)] + list(zip(counted, rules))
    listed = F.array(*[F.struct(F.lit(name).alias("check_name"), F.col(c).alias("violations")) for c, name in names])
    return row.select(F.explode(listed).alias("e")).select("e.*")


def _link_key(df: DataFrame, column: str, other: DataFrame, other_column: str) -> Column:
    """A key as text that equals the other side's text exactly where the keys are equal."""
    one, two = df.schema[column].dataType, other.schema[other_column].dataType
    if one != two and isinstance(one, NumericType) and isinstance(two, NumericType):
        return F.col(column).cast("decimal(38,6)").cast("string")
    return F.col(column).cast("string")


def check_links(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """Orphans per (parent, key, child, key) link.

    Each child is read once, whatever its number of links: its keys are unpivoted to (link, key)
    and counted before the shuffle.  The keys of all parents are one table, so one anti join, on link and
    key, finds the orphans of all links.
    """
    keys, known = [], []
    for child in dict.fromkeys(c for _, _, c, _ in links):
        own = [
            F.struct(F.lit(n).alias("link"), _link_key(tables[child], fk, tables[parent], pk).alias("key"))
            for n, (parent, pk, c, fk) in enumerate(links)
            if c == child
        ]
        unpivoted = tables[child].select(F.explode(F.array(*own)).alias("e")).select("e.link", "e.key")
        keys.append(unpivoted.where(F.col("key").isNotNull()).groupBy("link", "key").agg(F.count(F.lit(1)).alias("__c")))
    for parent in dict.fromkeys(p for p, _, _, _ in links):
        own = [
            F.struct(F.lit(n).alias("link"), _link_key(tables[parent], pk, tables[child], fk).alias("key"))
            for n, (p, pk, child, fk) in enumerate(links)
            if p == parent
        ]
        known.append(tables[parent].select(F.explode(F.array(*own)).alias("e")).select("e.link", "e.key"))
    lost = _stack(keys).join(_stack(known), ["link", "key"], "left_anti")
    found = lost.groupBy("link").agg(F.count(F.lit(1)).alias("k"), F.sum("__c").alias("r"))
    names = [(n, f"{parent}.{pk}", f"{child}.{fk}") for n, (parent, pk, child, fk) in enumerate(links)]
    listed = found.sparkSession.createDataFrame(names, "link int, parent string, child string")
    return listed.join(found, "link", "left").select(
        "parent", "child", F.coalesce("k", F.lit(0)).alias("orphan_keys"), F.coalesce("r", F.lit(0)).alias("orphan_rows")
    )


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule, all rules in one pass."""
    row = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    return row.unpivot([], list(rules), "rule", "violations")


def profile(df: DataFrame, name: str) -> DataFrame:
    """Type, null share, min, max and distinct count of every column.

    The columns of one type are unpivoted to (field, value) pairs, which are counted; all else follows from these
    counts, so each field's values spread over the cluster, are read once and need not become text.
    """
    fields = df.schema.fields
    by_type: dict[str, list[str]] = {}
    for f in fields:
        by_type.setdefault(f.dataType.simpleString(), []).append(f.name)
    found = []
    for names in by_type.values():
        counts = df.select(*names).unpivot([], names, "field", "value").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
        found.append(
            counts.groupBy("field").agg(
                F.sum("n").alias("n"),
                F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("filled"),
                F.min("value").cast("string").alias("min_value"),
                F.max("value").cast("string").alias("max_value"),
                F.count("value").alias("distinct_values"),
            )
        )
    entries = F.array(
        *[F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type")) for f in fields]
    )
    listed = df.sparkSession.range(1).select(F.explode(entries).alias("e")).select("e.*")
    rows, zero = F.coalesce("n", F.lit(0)), F.lit(0)
    return listed.join(_stack(found), "field", "left").select(
        "field",
        F.lit(name).alias("table_name"),
        "type",
        rows.alias("rows"),
        (F.lit(100.0) * (rows - F.coalesce("filled", zero)) / F.nullif(rows, zero)).alias("null_pct"),
        "min_value",
        "max_value",
        F.coalesce("distinct_values", zero).alias("distinct_values"),
    )


def numeric_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def critical_checks(checks: list[DataFrame]) -> DataFrame:
    """Results of ``check_table`` as one table with an issue flag."""
    return _stack(checks).withColumn("is_issue", F.col("violations") > 0)


def reconcile(pairs: dict[str, tuple[str, str]], row: DataFrame, tol: float = 0.01) -> DataFrame:
    """Named pairs of columns of a one-row frame, compared with abs + 1e-7 relative tolerance."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("check_name"),
                F.col(a).cast("double").alias("left_value"),
                F.col(b).cast("double").alias("right_value"),
            )
            for name, (a, b) in pairs.items()
        ]
    )
    return row.select(F.explode(entries).alias("e")).select("e.*").withColumns(
        {
            "absolute_difference": F.abs(F.col("left_value") - F.col("right_value")),
            "passed": F.abs(F.col("left_value") - F.col("right_value"))
            <= F.lit(tol) + F.lit(1e-7) * F.abs("right_value"),
        }
    )


def reconcile_kpis(a: DataFrame, b: DataFrame, keys: list[str], tol: float | Column = 1e-3) -> DataFrame:
    """Two long (keys, metric, value) frames from independent paths, compared row by row."""
    left = a.select(*keys, "metric", F.col("value").alias("expected"))
    right = b.select(*keys, "metric", F.col("value").alias("actual"))
    diff = F.abs(F.col("expected") - F.col("actual"))
    return left.join(right, [*keys, "metric"], "full_outer").withColumns(
        {
            "absolute_difference": diff,
            "passed": F.coalesce(
                diff <= F.lit(tol) + F.lit(1e-7) * F.abs("actual"),
                F.col("expected").isNull() & F.col("actual").isNull(),
            ),
        }
    )


def reconciliation_summary(checks: DataFrame, name: Column) -> DataFrame:
    """Checks, passed, failed, largest difference and the failed names (one row per KPI)."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), name)))
    return checks.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.max("absolute_difference").alias("max_absolute_difference"),
        F.concat_ws(", ", failed).alias("failed_names"),
    )


def mass_gap(events: DataFrame, days: DataFrame, key: str = "city_id") -> DataFrame:
    """Collected mass at attempt grain against day grain."""
    a = events.groupBy(key).agg(F.sum("collected_kg").alias("attempt_kg"))
    b = days.groupBy(key).agg(F.sum("collected_kg").alias("daily_kg"))
    return a.join(b, key).withColumn("difference_kg", F.col("attempt_kg") - F.col("daily_kg"))


def balance_residual(truth: DataFrame, part: list[str], order: list[str], step: str = "INTERVAL '2' HOUR") -> DataFrame:
    """Largest break of the stock equation and number of irregular time steps.

    Reading-grain lag, so it runs in monthly chunks per key with the last row of
    one month carried into the next.
    """
    lagged = lag_split(
        truth.select(
            *part, *order, "arrivals_l_true", "inventory_l_true", "overflow_l_true", "removed_l_true"
        ),
        part,
        order,
        ["inventory_l_true", order[0]],
        F.trunc(F.col(order[0]).cast("date"), "month"),
    )
    residual = F.abs(
        F.col("prev_inventory_l_true")
        + F.col("arrivals_l_true")
        - F.col("overflow_l_true")
        - F.col("removed_l_true")
        - F.col("inventory_l_true")
    )
    gap = F.col(order[0]) - F.col(f"prev_{order[0]}")
    return lagged.agg(
        F.max(residual).alias("max_residual_l"),
        F.count_if(gap != F.expr(step)).alias("irregular_steps"),
        F.count("prev_inventory_l_true").alias("compared"),
    )


def check_physics(interim: DataFrame) -> DataFrame:
    """Successful services that removed nothing or left the bin over capacity."""
    success = F.col("collection_status").isin("collected", "partial")
    return check_rules(
        interim,
        {
            "success_without_removal": success & (F.col("removed_l_true") <= 0),
            "success_left_full": success & (F.col("inventory_l_true") >= F.col("capacity_l")),
            "inventory_above_capacity": F.col("inventory_l_true") > F.col("capacity_l") + 0.001,
            "negative_measure": (F.col("arrivals_l_true") < 0) | (F.col("overflow_l_true") < 0) | (F.col("removed_l_true") < 0),
        },
    )


def check_filter_consistency(filtered: DataFrame, whole_filtered: DataFrame) -> DataFrame:
    """Rows only in the query run for one city, and only in the filtered full result."""
    a = filtered.exceptAll(whole_filtered).agg(F.count(F.lit(1)).alias("only_filtered")).withColumn("__one", F.lit(1))
    b = whole_filtered.exceptAll(filtered).agg(F.count(F.lit(1)).alias("only_whole")).withColumn("__one", F.lit(1))
    return a.join(b, "__one").drop("__one")


def check_leakage(features: DataFrame, horizon_seconds: int = 72000, holdout_mod: int = 5) -> DataFrame:
    """Feature times after issue time, wrong horizons, holdout flags and repeated keys."""
    rules = check_rules(
        features,
        {
            "sensor_after_issue": F.col("last_sensor_utc") > F.col("issue_time_utc"),
            "service_after_issue": F.col("last_service_utc") > F.col("issue_time_utc"),
            "wrong_horizon": F.timestamp_diff("SECOND", "issue_time_utc", "target_time_utc") != horizon_seconds,
            "wrong_holdout": F.col("bin_holdout") != (F.col("bin_id") % holdout_mod == 0),
        },
    )
    repeated = (
        features.groupBy("bin_id", "issue_date")
        .agg(F.count(F.lit(1)).alias("__c"))
        .agg(F.count_if(F.col("__c") > 1).alias("violations"))
        .select(F.lit("repeated_key").alias("rule"), "violations")
    )
    return rules.unionByName(repeated)


def check_contract(spark: SparkSession, tables: dict[str, DataFrame], contracts: dict[str, Contract]) -> DataFrame:
    """Key and foreign-key columns that are missing or differ in type, from schemas alone."""
    types = {t: {f.name: f.dataType.simpleString() for f in df.schema.fields} for t, df in tables.items()}
    rows = []
    for name, contract in contracts.items():
        have = types.get(name, {})
        for c in contract.key:
            rows.append((name, c, "key", "ok" if c in have else "missing"))
        for c, ref in contract.foreign.items():
            table, parent = ref.split(".")
            there = types.get(table, {}).get(parent)
            state = "missing" if c not in have or there is None else ("ok" if have[c] == there else "type_differs")
            rows.append((name, c, f"references {ref}", state))
    return spark.createDataFrame(rows, "table_name string, field string, role string, status string")


def files_read(df: DataFrame) -> DataFrame:
    """Number of files that contribute rows."""
    return df.select(F.col("_metadata.file_path").alias("f")).distinct().agg(F.count(F.lit(1)).alias("files"))


def assert_pruned(df: DataFrame, partition_columns: list[str]) -> str:
    """The scan's partition filters; raises when a partition column is not among them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    for c in partition_columns:
        if not any(f"{c}#" in line.split("PartitionFilters")[1].split("]")[0] for line in filters):
            raise AssertionError(f"no partition filter on {c}")
    return "\n".join(filters)

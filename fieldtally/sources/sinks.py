"""Sinks and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtally.sources.files import read_partitioned


def _partitioned(df: DataFrame, parts: list[str]):
    """Rows of one partition value meet in few files; a large value is split again by AQE."""
    return (
        df.hint("rebalance", *[F.col(p) for p in parts])
        .write.partitionBy(*parts)
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
    )


def write_split(df: DataFrame, targets: dict[str, list[str]], parts: list[str]) -> None:
    """Write several column sets of one frame, each partitioned, replacing whole partitions.

    The first target is written from ``df`` (parsed once); narrower targets
    whose columns it holds are then cut from its Parquet files.
    """
    spark = df.sparkSession
    (first, columns), *rest = targets.items()
    _partitioned(df.select(*columns, *parts), parts).mode("overwrite").parquet(first)
    stored = read_partitioned(spark, first)
    for path, wanted in rest:
        source = stored if set(wanted) <= set(columns) else df
        _partitioned(source.select(*wanted, *parts), parts).mode("overwrite").parquet(path)


def append_missing_partitions(df: DataFrame, target: str, parts: list[str]) -> DataFrame:
    """Append only rows of partitions the target does not hold; returns those rows' plan."""
    spark = df.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    new = df
    if exists:
        present = read_partitioned(spark, target).select(*parts).distinct()
        text = [F.col(p).cast("string").alias(p) for p in parts]
        keyed = df.withColumns({f"__{p}": F.col(p).cast("string") for p in parts})
        present = present.select(*text).withColumnsRenamed({p: f"__{p}" for p in parts})
        new = keyed.join(present, [f"__{p}" for p in parts], "left_anti").select(*df.columns)
    _partitioned(new, parts).mode("append").parquet(target)
    return new


def write_result_csv(df: DataFrame, path: str, origin: str) -> None:
    """Result table as one CSV directory with header and provenance column."""
    df.withColumn("data_origin", F.lit(origin)).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(results: dict[str, DataFrame], path: str) -> DataFrame:
    """One JSON row per result: id, row count, column names."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("query_id"), "rows", F.array(*[F.lit(c) for c in df.columns]).alias("columns")
        )
        for name, df in results.items()
    ]
    manifest = rows[0]
    for more in rows[1:]:
        manifest = manifest.unionByName(more)
    manifest.coalesce(1).write.mode("overwrite").json(path)
    return manifest


def write_clustered(df: DataFrame, path: str, date: str, key: str) -> None:
    """Partition by date, sort by key inside files, so min/max statistics prune on the key.

    Rows of a date meet in few tasks, and AQE splits a date that is too large for one.
    """
    (
        df.hint("rebalance", F.col(date))
        .sortWithinPartitions(date, key)
        .write.partitionBy(date)
        .mode("overwrite")
        .option("compression", "zstd")
        .parquet(path)
    )


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Bucketed, sorted table: later joins and groupings on ``key`` need no shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)


def register(name: str, df: DataFrame) -> DataFrame:
    """Named view, replaced if present."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def from_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Configuration-sized local rows."""
    return spark.createDataFrame(rows, schema)


def _calendar(days: DataFrame) -> DataFrame:
    d = F.col("service_date")
    return days.select(
        d,
        F.year(d).alias("calendar_year"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        (F.year(d) * 100 + F.month(d)).alias("year_month_sort"),
        (F.dayofweek(d) - 1).alias("weekday_sunday_zero"),
        F.dayofweek(d).isin(1, 7).alias("weekend"),
    )


def date_dim(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Calendar between two dates, both included."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("service_date")
    )
    return _calendar(days)


def calendar_of(df: DataFrame, date: str) -> DataFrame:
    """Calendar spanning a table's own dates (a one-row min/max decides the span)."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = span.select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("service_date"))
    return _calendar(days)


def data_dictionary(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, field string, type string")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def month_scan(df: DataFrame, year: int, month: int, date: str, measure: str) -> DataFrame:
    """Rows, non-null measures and their sum in one month.

    The month is a half-open range on the stored column, so row groups prune.
    """
    start = F.make_date(F.lit(year), F.lit(month), F.lit(1)).cast("timestamp_ntz")
    stop = F.add_months(F.make_date(F.lit(year), F.lit(month), F.lit(1)), 1).cast("timestamp_ntz")
    return df.where((F.col(date) >= start) & (F.col(date) < stop)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(measure).alias("observed"),
        F.sum(measure).alias("sum_measure"),
    )

"""Closed monthly CSV files as a file stream: each run takes the files not seen before.

The batch sink of each micro-batch is the same split writer the batch path uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldtally.sources.commits import TargetGroup, stream_batches
from fieldtally.sources.sinks import _partitioned


def with_month(df: DataFrame, date: str = "service_date_local") -> DataFrame:
    return df.withColumn("year", F.year(date)).withColumn("month", F.date_format(date, "MM"))


def _new_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).option("mode", "FAILFAST").csv(folder)


def ingest_committed(
    spark: SparkSession, folder: str, schema: str, group: TargetGroup, name: str, checkpoint: str,
    check: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Bring every new CSV file of ``folder`` into a group of targets exactly once, then stop.

    A batch becomes visible in all targets at once.  A crash at any point replays it: if it was
    committed, nothing happens, otherwise it is written anew.  ``name`` belongs to ``checkpoint``; a
    stream with a new checkpoint needs a new name.  The group's partitions are year and month.
    """

    def prepare(batch: DataFrame) -> DataFrame:
        if check is not None:
            check(batch)
        return with_month(batch)

    return (
        _new_files(spark, folder, schema)
        .writeStream.foreachBatch(stream_batches(group, name, prepare))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_new_files(
    spark: SparkSession, folder: str, schema: str, targets: dict[str, list[str]], checkpoint: str,
    check: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Append every new CSV file of ``folder`` to the partitioned targets, then stop.

    File names already processed are remembered in ``checkpoint``, so a restart after a whole
    batch neither skips nor repeats a file.  Targets are appended one after another: a crash
    between them replays the batch, and a target already written then holds it twice
    (``ingest_committed`` has no such gap).  ``check`` may raise to refuse a batch.
    """
    stream = _new_files(spark, folder, schema)

    def write(batch: DataFrame, _: int) -> None:
        if check is not None:
            check(batch)
        rows = with_month(batch)
        for path, columns in targets.items():
            _partitioned(rows.select(*columns, "year", "month"), ["year", "month"]).mode("append").parquet(path)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

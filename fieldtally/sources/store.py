"""Facts stored once, bucketed by bin and day, and the marts derived from them.

A fact is dealt by its bucket columns once, when it is stored: the 1:1 join of its sources and
every later grouping that contains these columns use the buckets as they are.  A hot bin is
spread over buckets by its days.  The number of buckets follows from the size of the input files, so a
task's memory does not grow with the input, whatever the session's number of shuffle partitions.  A mart is written when it is first asked for, and
later questions of the same session read it.

A store belongs to one application and one state of its input files (paths, lengths and
modification times).  When a file changes, the next question gets a new store.
All files lie in the shared folder, so a lost executor costs no recomputation.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

from fieldtally.session import shared_folder

# lets a join on more columns than the bucket columns use the buckets as they are
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"

# read by splits of files, a mart kept in buckets would get a file of every bucket from every task
SPLIT_SCAN = "spark.sql.sources.bucketing.autoBucketedScan.enabled"

# input bytes for one bucket: Parquet of some 250,000 to 550,000 order lines, which a task sorts in memory
BUCKET_BYTES = 4 << 20

_OPEN: dict[tuple[str, str, tuple[str, ...]], FactStore] = {}


def input_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Length and modification time of each file; of a folder, those of all its files together."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    state = []
    for name in paths:
        path = hadoop.Path(name)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        if status.isFile():
            state.append((name, 1, status.getLen(), status.getModificationTime()))
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(name)
        state.append((name, *files.agg(
            F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))
        ).first()))
    return tuple(state)


class FactStore:
    """Tables of one input state, each written at most once."""

    def __init__(self, spark: SparkSession, state: tuple = ()):
        self.spark, self.state = spark, state
        self.prefix = f"fieldtally_{uuid.uuid4().hex[:12]}"
        # all facts of a store agree; buckets grow in number with the input and not in size
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(least, math.ceil(sum(entry[2] for entry in state) / BUCKET_BYTES))
        self._written: dict[str, str] = {}
        spark.conf.set(CO_PARTITION, "false")
        spark.conf.set(SPLIT_SCAN, "false")

    def fact(self, name: str, make: Callable[..., DataFrame], keys: tuple[str, ...], *sources: DataFrame) -> DataFrame:
        """A table made from sources that are dealt by ``keys`` here, for the last time.

        What ``make`` joins or groups on these columns, or on more, needs no further shuffle,
        nor does anything that reads the table.
        """
        if name not in self._written:
            dealt = make(*[df.repartition(self.buckets, *keys) for df in sources])
            self._write(name, dealt.write.bucketBy(self.buckets, *keys))
        return self.table(name)

    def mart(self, name: str, make: Callable[[], DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
        """A derived table; with ``keys``, made from facts of those buckets and kept in them."""
        if name not in self._written:
            writer = make().write
            self._write(name, writer.bucketBy(self.buckets, *keys) if keys else writer)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._written[name])

    def _write(self, name: str, writer: DataFrameWriter) -> None:
        table = f"{self.prefix}_{name}"
        writer.format("parquet").option("path", f"{shared_folder(self.spark)}/{table}").saveAsTable(table)
        self._written[name] = table

    def forget(self) -> None:
        """Takes the tables out of the catalogue; their files stay for readers that are still at work."""
        for table in self._written.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._written.clear()


def open_store(spark: SparkSession, sf_dir: str, inputs: tuple[str, ...]) -> FactStore:
    """The store of a folder's present files: the one in use, or a new one if a file has changed."""
    state = input_state(spark, [f"{sf_dir}/{name}.parquet" for name in inputs])
    place = (spark.sparkContext.applicationId, sf_dir, inputs)
    store = _OPEN.get(place)
    if store is None or store.state != state or store.spark is not spark:
        if store is not None and store.spark is spark:
            store.forget()
        store = _OPEN[place] = FactStore(spark, state)
    return store

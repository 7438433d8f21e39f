"""Several partitioned tables that change together or not at all.

A batch writes the rows of every target to staged folders of its own.  Only when all of them are
complete is one manifest file renamed into the log, and readers follow the log: they
see a batch in all targets or in none.  Folders of a failed attempt are named by no manifest, so they are never
read and a later attempt does not meet them.  A batch that is in the log is not written again,
so a replay (after a crash, or from a stream's checkpoint) changes nothing.

One writer at a time is assumed.  The driver holds the log: a line for every batch and partition, no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldtally.sources.sinks import _partitioned

LOG = (
    "batch string, seq bigint, replaces boolean, schemas map<string,string>,"
    " parts array<struct<target:string,folder:string,part:string>>"
)
STAGE = "__stage"  # partition column that names a batch's folder; readers drop it


class CommitLog:
    """Numbered JSON entries in one folder, each renamed into place when it is complete."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def entries(self) -> list:
        """Oldest first; one row an entry."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = self.spark.read.schema(self.schema).json(self.folder)
        return list(found.coalesce(1).sortWithinPartitions("seq").toLocalIterator())

    def matching(self, pattern: str) -> list[str]:
        return [status.getPath().toString() for status in self._fs.globStatus(self._path(pattern)) or []]

    def publish(self, seq: int, entry: dict) -> None:
        name = f"{seq:012d}"
        final = self._path(f"{self.folder}/{name}.json")
        draft = self._path(f"{self.folder}/.{name}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({**entry, "seq": seq}), "utf-8"))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer committed {name} first; write again")


class TargetGroup:
    """``targets`` (name -> columns) under one root, all partitioned by ``parts``."""

    def __init__(self, spark: SparkSession, root: str, targets: dict[str, list[str]], parts: list[str]):
        self.spark, self.root, self.targets, self.parts = spark, root, targets, parts
        self._log = CommitLog(spark, f"{root}/commits", LOG)

    def log(self) -> list:
        """Committed batches, oldest first."""
        return self._log.entries()

    def write(self, batch: str, df: DataFrame, replace: bool = False) -> bool:
        """Commit the rows of ``df`` to all targets; False if the batch is committed already.

        With ``replace`` a partition that the batch holds takes the place of the earlier one in every
        target.  The first target is written from ``df``; targets whose columns it holds are cut from its files.
        """
        log = self.log()
        if any(entry["batch"] == batch for entry in log):
            return False
        stage, schemas, written, first = uuid.uuid4().hex, {}, [], None
        for target, columns in self.targets.items():
            folder = f"{self.root}/{target}/{STAGE}={stage}"
            source = first if first is not None and set(columns) <= set(first.columns) else df
            rows = source.select(*columns, *self.parts)
            _partitioned(rows, self.parts).parquet(folder)
            schemas[target] = rows.schema.json()
            names = [p.split(f"{STAGE}={stage}/", 1)[1] for p in self._log.matching(folder + "/*=*" * len(self.parts))]
            written += [{"target": target, "folder": f"{STAGE}={stage}", "part": name} for name in names]
            if first is None and names:
                first = self.spark.read.schema(rows.schema).parquet(folder)
        self._log.publish(len(log), {"batch": batch, "replaces": replace, "schemas": schemas, "parts": written})
        return True

    def write_missing(self, batch: str, df: DataFrame) -> bool:
        """Commit only rows of partitions that the first target does not hold yet."""
        if self.log():
            present = self.read(next(iter(self.targets))).select(*[F.col(p).cast("string").alias(f"__{p}") for p in self.parts])
            same = [F.col(p).cast("string").eqNullSafe(F.col(f"__{p}")) for p in self.parts]
            df = df.join(present.distinct(), same, "left_anti")
        return self.write(batch, df)

    def live(self, target: str, log: list | None = None) -> list[str]:
        """Folders of the partitions that the log names, without replaced ones."""
        held: dict[str, list[str]] = {}
        for entry in self.log() if log is None else log:
            for p in entry["parts"]:
                if p["target"] == target:
                    earlier = [] if entry["replaces"] else held.get(p["part"], [])
                    held[p["part"]] = [*earlier, f"{self.root}/{target}/{p['folder']}/{p['part']}"]
        return [path for paths in held.values() for path in paths]

    def read(self, target: str) -> DataFrame:
        """The target's committed rows; partition filters prune as usual."""
        log = self.log()
        if not log:
            raise ValueError(f"nothing is committed under {self.root}")
        schema = StructType.fromJson(json.loads(log[-1]["schemas"][target]))
        paths = self.live(target, log)
        if not paths:
            return self.spark.createDataFrame([], schema)
        staged = StructType([*schema.fields, StructField(STAGE, StringType())])
        return self.spark.read.schema(staged).option("basePath", f"{self.root}/{target}").parquet(*paths).drop(STAGE)


def stream_batches(group: TargetGroup, name: str, prepare: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each micro-batch enters the group once, whatever is replayed."""

    def write(batch: DataFrame, number: int) -> None:
        group.write(f"{name}-{number}", prepare(batch))

    return write

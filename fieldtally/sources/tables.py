"""Stored tables under names: every replacement is a new version, and a name points to the newest.

``stage`` writes a version's files; ``publish`` switches the name to them with one log entry, so a
question asked before, while or after a table is replaced is answered from one whole version.
Files of replaced versions stay for readers that are still at work and can be asked for by number.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fieldtally.sources.commits import CommitLog

ENTRY = "seq bigint, name string, folder string, schema string, target string"


@dataclass
class Staged:
    """A version whose files are complete but which no name points to yet."""

    registry: TableRegistry
    name: str
    folder: str
    schema: str

    def publish(self) -> int:
        return self.registry._append(self.name, folder=self.folder, schema=self.schema)


class TableRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._log = CommitLog(spark, f"{root}/names", ENTRY)

    def stage(self, name: str, df: DataFrame) -> Staged:
        folder = f"{self.root}/tables/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return Staged(self, name, folder, df.schema.json())

    def put(self, name: str, df: DataFrame) -> int:
        """Creates or replaces a table; returns the number of its version, from 1."""
        return self.stage(name, df).publish()

    def alias(self, alias: str, name: str) -> None:
        """Lets ``alias`` follow ``name`` through all its versions; a later call moves it."""
        entries, step, seen = self._log.entries(), name, {alias}
        while step is not None:
            if step in seen:
                raise ValueError(f"{alias} would follow itself")
            seen.add(step)
            last = self._last(entries, step)
            if last is None:
                raise KeyError(f"no stored table {step}")
            step = last["target"]
        self._append(alias, target=name)

    def versions(self, name: str) -> list[str]:
        """Folders of a table's versions, oldest first."""
        return [e["folder"] for e in self._log.entries() if e["name"] == name and e["folder"] is not None]

    def names(self) -> DataFrame:
        """Every name with what it points to and its number of versions."""
        rows: dict[str, tuple] = {}
        for e in self._log.entries():
            count = rows.get(e["name"], (None, None, 0))[2] + (e["folder"] is not None)
            rows[e["name"]] = (e["name"], e["target"] or e["folder"], count)
        return self.spark.createDataFrame(list(rows.values()), "name string, points_to string, versions int")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The newest version, through aliases, or the version of a number."""
        entries = self._log.entries()
        last = self._last(entries, name)
        while last is not None and last["target"] is not None:
            name = last["target"]
            last = self._last(entries, name)
        if version is not None:
            held = [e for e in entries if e["name"] == name and e["folder"] is not None]
            last = held[version - 1] if 1 <= version <= len(held) else None
        if last is None:
            raise KeyError(f"no stored table {name}" + (f" of version {version}" if version else ""))
        return self.spark.read.schema(StructType.fromJson(json.loads(last["schema"]))).parquet(last["folder"])

    @staticmethod
    def _last(entries: list, name: str):
        return next((e for e in reversed(entries) if e["name"] == name), None)

    def _append(self, name: str, folder: str | None = None, schema: str | None = None, target: str | None = None) -> int:
        entries = self._log.entries()
        self._log.publish(len(entries), {"name": name, "folder": folder, "schema": schema, "target": target})
        return sum(e["name"] == name and e["folder"] is not None for e in entries) + (folder is not None)

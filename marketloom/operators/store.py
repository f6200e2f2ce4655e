"""A keyed table as a log: a change writes what it changes, readers see whole versions, writers at the same time retry.

``data`` holds a folder of Parquet for each change: its rows, and keys that are gone. ``log``
holds a small file for each version: its segments, oldest first, what it added and what it
removed. The next version's file is created once, so of two writers one commits and the other
reads the new version and tries again. A row's newest segment decides. ``compact`` writes what
is left as one segment; versions that were opened before stay readable until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits


class Conflict(RuntimeError):
    """Another writer has changed what a commit depends on."""


@dataclass(frozen=True)
class Version:
    number: int
    segments: tuple[dict, ...]
    schema: str | None


@dataclass(frozen=True)
class LogStore:
    """A store in a folder; rows are told apart by ``key``, one or more columns that are never null."""

    spark: SparkSession
    path: str
    key: tuple[str, ...] = ("id",)

    def _file(self, number: int) -> str:
        return f"{self.path}/log/{number:012d}.json"

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of a number; version 0 is empty."""
        if number is None:
            found = commits.names(self.spark, f"{self.path}/log")
            number = int(found[-1].split(".")[0]) if found else 0
        text = commits.read_text(self.spark, self._file(number)) if number else None
        if number and text is None:
            raise ValueError(f"no version {number}")
        entry = json.loads(text) if text else {"segments": [], "schema": None}
        return Version(number, tuple(entry["segments"]), entry["schema"])

    def rows(self, number: int | None = None) -> DataFrame:
        """The rows of a version (the newest): all of it or none, whatever is committed later."""
        return self._merged(self.version(number))

    def _merged(self, version: Version, gone: bool = False) -> DataFrame:
        if not version.segments:
            raise ValueError("the store is empty: nothing says what its columns are")
        read = self.spark.read.schema(version.schema)
        parts = [read.parquet(f"{self.path}/data/{s['folder']}").withColumn("_s", F.lit(i)) for i, s in enumerate(version.segments)]
        columns = [c for c in parts[0].columns if c not in (*self.key, "_gone", "_s")]
        every = reduce(DataFrame.unionByName, parts)
        if len(parts) > 1:
            newest = F.max_by(F.struct("_gone", *columns), "_s").alias("r")
            every = every.groupBy(*self.key).agg(newest).select(*self.key, "r.*")
        return every.where("NOT _gone").select(*self.key, *columns)

    def _written(self, changes: DataFrame) -> dict:
        folder = uuid.uuid4().hex
        changes.write.parquet(f"{self.path}/data/{folder}")
        return {"folder": folder}

    def _commit(self, base: Version, add: list[dict], remove: list[str], schema: str, first: bool = False) -> Version | None:
        """The next version, or None if another writer has made it."""
        left = [s for s in base.segments if s["folder"] not in remove]
        segments = [*add, *left] if first else [*left, *add]
        entry = {"version": base.number + 1, "add": [s["folder"] for s in add], "remove": remove, "segments": segments, "schema": schema}
        return Version(base.number + 1, tuple(segments), schema) if commits.create_once(self.spark, self._file(base.number + 1), json.dumps(entry)) else None

    def change(self, changes: DataFrame, *, expected: int | None = None, tries: int = 100) -> Version:
        """Commit changed rows, and with ``gone`` true rows that are deleted; each key once.

        Writes the changes and a small file. Another writer's commit in between puts this one
        after it; with ``expected``, the version that the changes were made from, it is a
        ``Conflict``.
        """
        gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in changes.columns else F.lit(False)
        rows = changes.withColumn("_gone", gone).drop("gone")
        segment, schema = self._written(rows), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        for _ in range(tries):
            base = self.version()
            if expected is not None and base.number != expected:
                raise Conflict(f"version {base.number} came after {expected}")
            if base.schema is not None and base.schema != schema:
                raise ValueError(f"the store's columns are {base.schema}")
            done = self._commit(base, [segment], [], schema)
            if done:
                return done
        raise Conflict(f"{tries} versions came before this one")

    def compact(self, tries: int = 100) -> Version:
        """One segment of what the present ones leave; changes committed meanwhile stay after it."""
        base = self.version()
        if len(base.segments) < 2:
            return base
        segment, old = self._written(self._merged(base).withColumn("_gone", F.lit(False))), [s["folder"] for s in base.segments]
        for _ in range(tries):
            now = self.version()
            if [s["folder"] for s in now.segments[: len(old)]] != old:
                raise Conflict("another compaction came first")
            done = self._commit(now, [segment], old, base.schema, first=True)
            if done:
                return done
        raise Conflict(f"{tries} versions came before this one")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete segments that none of the last ``keep`` versions has; the versions before can't be read any more."""
        last = self.version().number
        held = {s["folder"] for n in range(max(1, last - keep + 1), last + 1) for s in self.version(n).segments}
        # a segment that is written but not committed yet is in no version: only those that a version removed go
        removed = set()
        for n in range(1, last + 1):
            removed |= set(json.loads(commits.read_text(self.spark, self._file(n)))["remove"])
        there = [f for f in commits.names(self.spark, f"{self.path}/data") if f in removed - held]
        for folder in there:
            where, system = commits._at(self.spark, f"{self.path}/data/{folder}")
            system.delete(where, True)
        return there

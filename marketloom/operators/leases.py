"""Jobs that several drivers share: each is claimed by one, kept by its heartbeat, and taken over when that stops.

A claim is a file created once, numbered by attempt. Its owner beats by writing a file beside
it; a claim without a beat for ``ttl`` seconds may be followed by the next attempt. Results go
to a folder of the attempt, and a job is done when the file that names the folder is created,
once: a driver that was given up and comes back finds it there, and its results are never read.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits
from .jobs import KEYS, guarded


@dataclass
class Leases:
    """The claims of a folder, as one driver (``owner``) makes them."""

    spark: SparkSession
    path: str
    ttl: float = 60.0
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)
    clock: Callable[[], float] = time.time

    def _job(self, job: tuple) -> str:
        return f"{self.path}/claims/{hashlib.sha256(json.dumps(job, default=str).encode()).hexdigest()[:32]}"

    def state(self, job: tuple) -> tuple[str, int]:
        """(done, held, stale or open; attempts so far) of a job."""
        folder = self._job(job)
        found = commits.names(self.spark, folder)
        attempts = max((int(n.split(".")[0]) for n in found if n.endswith(".claim")), default=0)
        if "done" in found:
            return "done", attempts
        if not attempts:
            return "open", 0
        last = max((json.loads(t)["at"] for n in ("claim", "beat") if (t := commits.read_text(self.spark, f"{folder}/{attempts:06d}.{n}"))), default=0.0)
        return ("held" if self.clock() - last <= self.ttl else "stale"), attempts

    def claim(self, job: tuple) -> int | None:
        """The number of the attempt if the job is this driver's now, else None."""
        state, attempts = self.state(job)
        if state in ("done", "held"):
            return None
        entry = json.dumps({"owner": self.owner, "at": self.clock()})
        return attempts + 1 if commits.create_once(self.spark, f"{self._job(job)}/{attempts + 1:06d}.claim", entry) else None

    def beat(self, job: tuple, attempt: int) -> None:
        commits.overwrite(self.spark, f"{self._job(job)}/{attempt:06d}.beat", json.dumps({"owner": self.owner, "at": self.clock()}))

    def finish(self, job: tuple, attempt: int, result: str) -> bool:
        """Name the folder of a job's results; False if another attempt has done so."""
        return commits.create_once(self.spark, f"{self._job(job)}/done", json.dumps({"owner": self.owner, "attempt": attempt, "job": list(job), "result": result}))

    def results(self) -> list[dict]:
        """What is done: the job, attempt, owner and folder of results."""
        found = []
        for name in commits.names(self.spark, f"{self.path}/claims"):
            if text := commits.read_text(self.spark, f"{self.path}/claims/{name}/done"):
                found.append(json.loads(text))
        return found


def run_shared(jobs: DataFrame, data: DataFrame, fn: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, leases: Leases, *, most: int = 16, seconds: int | None = None, wait: float | None = None) -> int:
    """Run jobs (``KEYS``) over ``data`` (``KEYS``, ...) with other drivers until all are done; how many this one finished.

    A driver claims up to ``most`` jobs at a time and runs them as one Spark job, a group a job;
    its claims beat every third of ``ttl``. Then it takes what is open or stale. It ends when
    no job is left, or after ``wait`` seconds without one to claim (never, unless given). The
    list of jobs is read by the driver. A job that fails is done, with its error.
    """
    spark, columns, done = jobs.sparkSession, [c.split()[0] for c in schema.split(", ")], 0
    whole = "setup string, window string, ticker string, status string, error string, " + schema
    todo = [tuple(r) for r in jobs.select(*KEYS).distinct().orderBy(*KEYS).collect()]
    # drivers begin at different places, so that they seldom meet
    start = int(hashlib.sha256(leases.owner.encode()).hexdigest(), 16) % max(1, len(todo))
    todo, idle = todo[start:] + todo[:start], time.time()
    while todo:
        mine: dict[tuple, int] = {}
        for job in list(todo):
            if len(mine) == most:
                break
            attempt = leases.claim(job)
            if attempt:
                mine[job] = attempt
            elif leases.state(job)[0] == "done":
                todo.remove(job)
        if not mine:
            if wait is not None and time.time() - idle > wait:
                break
            time.sleep(min(1.0, leases.ttl / 3))
            continue
        over = threading.Event()

        def beats(own=dict(mine), stop=over) -> None:
            while not stop.wait(leases.ttl / 3):
                for job, attempt in own.items():
                    leases.beat(job, attempt)

        beating = threading.Thread(target=beats, daemon=True)
        beating.start()
        try:
            folder = f"{leases.path}/results/{leases.owner}-{uuid.uuid4().hex}"
            claimed = spark.createDataFrame(list(mine), "setup string, window string, ticker string")
            rows = data.join(F.broadcast(claimed), list(KEYS), "left_semi")  # at most ``most`` rows
            rows.groupBy(*KEYS).applyInPandas(guarded(fn, columns, seconds), whole).write.partitionBy(*KEYS).parquet(folder)
            for job, attempt in mine.items():
                done += leases.finish(job, attempt, folder)
                todo.remove(job)
        finally:
            over.set()
            beating.join()
        idle = time.time()
    return done


def shared_results(leases: Leases, schema: str) -> DataFrame:
    """The results (``KEYS``, status, error, ...) of all that is done, each job from the attempt that finished it."""
    whole = "setup string, window string, ticker string, status string, error string, " + schema
    entries = [(*e["job"], e["result"]) for e in leases.results()]
    spark = leases.spark
    if not entries:
        return spark.createDataFrame([], whole)
    named = spark.createDataFrame(entries, "setup string, window string, ticker string, result string")
    folders = sorted({e[3] for e in entries})
    every = None
    for folder in folders:
        # a batch without rows leaves no partition behind
        if any("=" in n for n in commits.names(spark, folder)):
            part = spark.read.schema(whole).option("basePath", folder).parquet(folder).withColumn("result", F.lit(folder))
            every = part if every is None else every.unionByName(part)
    return spark.createDataFrame([], whole) if every is None else every.join(named, [*KEYS, "result"], "left_semi").drop("result")

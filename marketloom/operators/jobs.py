"""Experiments as tables: setups, the grid of jobs, their states, and runs that resume.

A job is a row (setup, window, ticker). Its state is what the status and result tables hold,
so a run that ends early loses nothing that was written, and is repeated by asking for what
remains. Results go to a partition a job, which a repeated job replaces.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("setup", "window", "ticker")
_FIVE = ("TSLA", "NFLX", "AMZN", "MSFT", "COIN")
# The setups' dates, tickers, mode, years of training and selection. A name that
# ends in a number of tickers is looked up without it.
SETUPS = {
    "cherry_pick_5": {"first": "2022-10-06", "last": "2023-04-10", "tickers": _FIVE, "mode": "iter"},
    "cherry_pick_8": {"first": "2022-10-05", "last": "2023-06-10", "tickers": (*_FIVE, "NIO", "GOOG", "AAPL"), "mode": "iter"},
    "selected_5": {"first": "2004-01-01", "last": "2024-01-01", "tickers": _FIVE, "mode": "rolling_window", "training_years": 3},
    "selected_4": {"first": "2004-01-01", "last": "2024-01-01", "tickers": _FIVE, "mode": "rolling_window", "training_years": 3},
    "random_sp500": {"first": "2004-01-01", "last": "2024-01-01", "mode": "rolling_window", "select": "random", "per_year": True},
    "momentum_sp500": {"first": "2004-01-01", "last": "2024-01-01", "mode": "rolling_window", "training_years": 2, "select": "momentum", "back": 100, "skip": 21},
    "lowvol_sp500": {"first": "2004-01-01", "last": "2024-01-01", "mode": "rolling_window", "training_years": 2, "select": "low_volatility", "lookback": 21},
    "diversified_sp500": {"first": "2004-01-01", "last": "2024-01-01", "mode": "rolling_window", "training_years": 2, "select": "diversified", "lookback_years": 2},
}


def setup(name: str, **changes) -> dict:
    """A setup's settings with ``changes``; ``momentum_sp500_5`` is ``momentum_sp500`` with k = 5."""
    base, _, number = name.rpartition("_")
    if name in SETUPS:
        out = dict(SETUPS[name])
    elif base in SETUPS and number.isdigit():
        out = SETUPS[base] | {"k": int(number)}
    else:
        raise ValueError(f"unknown setup {name!r}")
    return out | {"setup": name} | changes


def grid(spark: SparkSession, setups: dict[str, list[str]], windows: list[str]) -> DataFrame:
    """``KEYS`` of every ticker of every setup in every window."""
    rows = spark.createDataFrame([(s, list(t)) for s, t in setups.items()], "setup string, tickers array<string>")
    every = F.array(*map(F.lit, windows))
    return rows.select("setup", F.explode(every).alias("window"), "tickers").select("setup", "window", F.explode("tickers").alias("ticker"))


def states(jobs: DataFrame, status: DataFrame, results: DataFrame, now, timeout: float, expected: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, have, state, attempts): complete, partial, running, timeout, failed or missing, of every job.

    ``status`` holds (keys, status, at) of what happened; ``timeout`` is in seconds. A job
    with all its results is complete whatever its status says.
    """
    last = status.groupBy(*keys).agg(F.max_by("status", "at").alias("_last"), F.max("at").alias("_at"), F.count_if(F.col("status") == "running").alias("attempts"))
    have = results.groupBy(*keys).agg(F.count("*").alias("have"))
    out = jobs.join(last, list(keys), "left").join(have, list(keys), "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    old = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("_at") > timeout
    state = (
        F.when(F.col("have") >= expected, "complete").when((F.col("_last") == "running") & old, "timeout").when(F.col("_last") == "running", "running")
        .when(F.col("_last").isin("failed", "timeout"), F.col("_last")).when(F.col("have") > 0, "partial").otherwise("missing")
    )
    return out.select(*keys, "have", state.alias("state"), F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"))


def to_run(states_: DataFrame, most: int | None = None) -> DataFrame:
    """Jobs that aren't complete or running, with fewer than ``most`` attempts."""
    open_ = states_.where(~F.col("state").isin("complete", "running"))
    return open_ if most is None else open_.where(F.col("attempts") < most)


def without_incomplete(results: DataFrame, states_: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Results of complete jobs alone: what a rerun must not be mixed with is left out."""
    return results.join(states_.where("state = 'complete'").select(*keys), list(keys), "left_semi")


def guarded(fn: Callable[[tuple, pd.DataFrame], pd.DataFrame], columns: list[str], seconds: int | None = None):
    """``fn`` of a group with the group's outcome: its rows with status ``complete``, or one row with ``failed`` or ``timeout`` and the error."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        import signal

        def late(*_):
            raise TimeoutError

        error, got = None, None
        if seconds:
            before = signal.signal(signal.SIGALRM, late)
            signal.alarm(seconds)
        try:
            got, status = fn(key, rows), "complete"
        except TimeoutError:
            status = "timeout"
        except Exception as e:  # noqa: BLE001  a job's failure is its result
            status, error = "failed", repr(e)
        finally:
            if seconds:
                signal.alarm(0)
                signal.signal(signal.SIGALRM, before)
        if got is None or not len(got):
            got = pd.DataFrame({c: [None] for c in columns})
        out = got.assign(status=status, error=error)
        for name, value in zip(KEYS, key):
            out[name] = value
        return out[[*KEYS, "status", "error", *columns]]

    return run


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


STATUS = "setup string, window string, ticker string, status string, error string, at timestamp"


def run_jobs(jobs: DataFrame, data: DataFrame, fn: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, out: str, seconds: int | None = None) -> DataFrame:
    """Run what remains of ``jobs`` over ``data`` (``KEYS``, ...), one group a job; the status of all jobs.

    Results go to ``out``/results by job, what happened to ``out``/status. Jobs with a
    complete status aren't run again; results of one that failed before are replaced.
    """
    spark = jobs.sparkSession
    columns = [c.split()[0] for c in schema.split(", ")]
    done = _written(spark, f"{out}/status", STATUS)
    todo = jobs.join(done.where("status = 'complete'").select(*KEYS), list(KEYS), "left_anti")
    rows = data.join(todo, list(KEYS), "left_semi")
    whole = "setup string, window string, ticker string, status string, error string, " + schema
    got = rows.groupBy(*KEYS).applyInPandas(guarded(fn, columns, seconds), whole)
    path = f"{out}/results"
    got.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)
    fresh = spark.read.schema(whole).parquet(path).join(todo, list(KEYS), "left_semi")
    fresh.groupBy(*KEYS).agg(F.any_value("status").alias("status"), F.any_value("error").alias("error"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{out}/status")
    latest = spark.read.schema(STATUS).parquet(f"{out}/status").groupBy(*KEYS).agg(F.max_by("status", "at").alias("status"), F.max_by("error", "at").alias("error"))
    return jobs.join(latest, list(KEYS), "left").select(*KEYS, F.coalesce("status", F.lit("missing")).alias("status"), "error")


def rebuilt_summary(results: DataFrame, metrics: dict[str, str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row a job with every metric (name: SQL of its aggregate), from the results as they are written."""
    return results.where("status = 'complete'").groupBy(*keys).agg(*[F.expr(x).alias(n) for n, x in metrics.items()])

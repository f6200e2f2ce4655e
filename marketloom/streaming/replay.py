"""Stateful streams: day-ordered replay of bars, bounded history, decaying memory, polled bars."""

from __future__ import annotations

import datetime
import itertools
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REPLAY = "ticker string, date date, cash double, shares long, equity double, status string"


def _filled(money: float, shares: int, signal: int, price: float, rate: float) -> tuple[float, int]:
    """Cash and shares after the last bar's signal is filled at a price."""
    if signal == 1 and shares == 0 and price > 0:
        shares = int(money // (price * (1 + rate)))
        return money - shares * price * (1 + rate), shares
    if signal == -1 and shares:
        return money + shares * price * (1 - rate), 0
    return money, shares


def replay(bars: DataFrame, cash: float = 100_000.0, rate: float = 0.0) -> DataFrame:
    """``REPLAY`` rows of a stream of bars (ticker, date, open, close, signal), in order of date.

    A signal takes effect at the next bar's open: 1 buys what the cash pays for, -1 sells
    all. A bar on or before the last date of its ticker changes nothing and comes back as
    ``late``. The state of a ticker is four numbers.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        money, shares, waiting, last = state.get if state.exists else (cash, 0, 0, -1)
        out = []
        for r in pd.concat(list(frames)).sort_values("date", kind="stable").itertuples():
            day = (r.date - datetime.date(1970, 1, 1)).days
            if day <= last:
                out.append((key[0], r.date, None, None, None, "late"))
                continue
            money, shares = _filled(money, shares, waiting, r.open, rate)
            waiting, last = int(r.signal or 0), day
            out.append((key[0], r.date, money, shares, money + shares * r.close, "ok"))
        state.update((float(money), int(shares), int(waiting), int(last)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLAY.split(", ")]).astype({"shares": "Int64"})

    rows = bars.select("ticker", "date", F.col("open").cast("double"), F.col("close").cast("double"), F.col("signal").cast("int"))
    return rows.groupBy("ticker").applyInPandasWithState(run, REPLAY, "cash double, shares long, waiting int, last int", "append", GroupStateTimeout.NoTimeout)


def replay_batch(bars: DataFrame, cash: float = 100_000.0, rate: float = 0.0) -> DataFrame:
    """What ``replay`` gives for bars that come in order, as one grouped pass over a table."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        money, shares, waiting, out = cash, 0, 0, []
        for r in rows.sort_values("date", kind="stable").itertuples():
            money, shares = _filled(money, shares, waiting, r.open, rate)
            waiting = int(r.signal or 0)
            out.append((r.ticker, r.date, money, shares, money + shares * r.close, "ok"))
        return pd.DataFrame(out, columns=[c.split()[0] for c in REPLAY.split(", ")])

    rows = bars.select("ticker", "date", F.col("open").cast("double"), F.col("close").cast("double"), F.col("signal").cast("int"))
    return rows.groupBy("ticker").applyInPandas(run, REPLAY)


def recent(items: DataFrame, by: str, at: str, text: str, k: int = 5) -> DataFrame:
    """(by, items): after each batch, the last k texts of every group that has new ones, oldest first; the state holds no more than those."""

    def last(held: list, new: pd.DataFrame) -> list:
        # equal times in order of text, so that the order of arrival decides nothing
        return sorted([*held, *zip(new["at"].astype("int64").tolist(), new["text"].tolist())], key=lambda x: (x[0], x[1] is not None, x[1] or ""))[-k:]

    def lately(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for new in frames:
            for name, rows in new.groupby("by", dropna=False):
                name = None if pd.isna(name) else name
                held[name] = last(held.get(name, []), rows)
        yield pd.DataFrame([(name, a, t) for name, rows in held.items() for a, t in rows], columns=["by", "at", "text"]).astype({"at": "int64"})

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for new in frames:
            held = last(held, new)
        state.update(([a for a, _ in held], [t for _, t in held]))
        yield pd.DataFrame({"by": [key[0]], "items": [[t for _, t in held]]})

    rows = items.select(F.col(by).cast("string").alias("by"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(text).alias("text"))
    rows = rows.mapInPandas(lately, f"by string, at long, text {rows.schema['text'].dataType.simpleString()}")  # a task sends its last k of a group
    return rows.groupBy("by").applyInPandasWithState(run, "by string, items array<string>", "at array<long>, items array<string>", "update", GroupStateTimeout.NoTimeout)


MEMORY = "symbol string, id long, step int, importance double, recency double, status string"


def decaying(events: DataFrame, recency: float = 3.0, importance: float = 0.92, least: tuple[float, float] = (0.05, 5.0)) -> DataFrame:
    """``MEMORY`` rows of a stream of (symbol, step, id, importance): every new step of a symbol ages what it holds.

    Memories under either threshold come out once as ``gone`` and leave the state; new ones
    come out as ``new``. So the state holds only what is still above both. A task holds one
    symbol's rows of a batch, so batches of a bounded size bound it.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, values, born, now = state.get if state.exists else ([], [], [], 0)
        held = {i: (v, b) for i, v, b in zip(ids, values, born)}
        names, out = [c.split()[0] for c in MEMORY.split(", ")], []
        new = pd.concat([f[["step", "id", "importance"]] for f in frames]).sort_values("step", kind="stable")
        for step, rows in itertools.groupby(zip(*(new[c].tolist() for c in new)), key=lambda r: r[0]):
            if step < now:
                out += [(key[0], i, step, v, None, "late") for _, i, v in rows]
                continue
            for i, (v, b) in list(held.items()):
                age = step - b
                score, fresh = v * importance**age, math.exp(-age / recency)
                if fresh < least[0] or score < least[1]:
                    del held[i]
                    out.append((key[0], i, step, score, fresh, "gone"))
            now = step
            for _, i, v in rows:
                held[i] = (v, now)
                out.append((key[0], i, now, v, 1.0, "new"))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        state.update((list(held), [v for v, _ in held.values()], [b for _, b in held.values()], now))
        yield pd.DataFrame(out, columns=names)

    rows = events.select("symbol", F.col("step").cast("int"), F.col("id").cast("long"), F.col("importance").cast("double"))
    return rows.groupBy("symbol").applyInPandasWithState(run, MEMORY, "id array<long>, importance array<double>, born array<int>, step int", "append", GroupStateTimeout.NoTimeout)


def sessions(news: DataFrame, close_hour: int = 16, late: str = "2 days") -> DataFrame:
    """A stream of news (ts, ...) with the day it can be traded on: shifted past the close before the watermark sees it."""
    from ..functions.scalars import next_session

    shifted = news.withColumn("session", next_session("ts", close_hour).cast("timestamp"))
    return shifted.withWatermark("session", late) if news.isStreaming else shifted


def poll(path: str, add: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: writes a batch's bars under its number, so that a repeated batch replaces itself, and the latest bars of its symbols with what ``add`` computes.

    ``path``/bars holds all bars, ``path``/latest the last row of each symbol of the batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/bars/batch={number}")
        every = spark.read.parquet(f"{path}/bars").join(batch.select("symbol").distinct(), "symbol", "left_semi")
        newest = every.groupBy("symbol", "date").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in ("symbol", "date")]), "batch").alias("r")).select("symbol", "date", "r.*")
        done = add(newest)
        rest = [c for c in done.columns if c != "symbol"]
        done.groupBy("symbol").agg(F.max_by(F.struct(*rest), "date").alias("r")).select("symbol", "r.*").write.mode("overwrite").parquet(f"{path}/latest/batch={number}")

    return write

"""What SQL can call: table functions for signals and selectors, and scalar functions.

``register`` makes them known to a session. The scalars are SQL functions that Spark inlines;
the table functions take ``TABLE(...) PARTITION BY ... ORDER BY ...`` and hold a window of rows,
or the best k, of one partition.
"""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

from .extend import Registry

TABLE_FUNCTIONS = Registry("table function")


def mean(values: list[float]) -> float:
    """Added one after the other, as Spark's average is, so that ties are the same ones."""
    total = 0.0
    for x in values:
        total += x
    return total / len(values)


#: name -> (arguments and result, body).
SCALARS = {
    "whole_shares": ("cash DOUBLE, price DOUBLE, reserve DOUBLE) RETURNS BIGINT", "CASE WHEN price > 0 THEN cast(floor(cash * reserve / price) AS BIGINT) ELSE 0 END"),
    "adjust_ratio": ("close DOUBLE, adjusted DOUBLE) RETURNS DOUBLE", "CASE WHEN close <> 0 THEN adjusted / close ELSE 0D END"),
    "decayed": ("importance DOUBLE, age INT, factor DOUBLE) RETURNS DOUBLE", "importance * pow(factor, age)"),
    "compound_score": ("recency DOUBLE, importance DOUBLE) RETURNS DOUBLE", "recency + least(importance, 100D) / 100"),
}


@TABLE_FUNCTIONS.add("sma_signals")
@udtf(returnType="symbol string, date date, close double, signal int")
class SmaSignals:
    """``sma_signals(TABLE(bars) PARTITION BY symbol ORDER BY date, fast, slow)``: 1 and -1 where the mean of ``fast`` closes crosses that of ``slow``, against the last difference that isn't 0. Holds ``slow`` closes."""

    def __init__(self):
        self.held, self.before = None, 0

    def eval(self, row: Row, fast: int, slow: int):
        if not 0 < fast < slow:
            raise ValueError("fast must be less than slow")
        self.held = self.held if self.held is not None else deque(maxlen=slow)
        self.held.append(row["close"])
        signal = 0
        if len(self.held) == slow:
            closes = list(self.held)
            d = mean(closes[-fast:]) - mean(closes)
            way = (d > 0) - (d < 0)
            signal = way if way and self.before == -way else 0
            self.before = way or self.before
        yield row["symbol"], row["date"], row["close"], signal


@TABLE_FUNCTIONS.add("momentum_symbols")
@udtf(returnType="win string, symbol string, score double, rank bigint")
class MomentumSymbols:
    """``momentum_symbols(TABLE(bars) PARTITION BY win ORDER BY symbol, date, back, skip, k)``: of each window's bars the k symbols of the largest close[-skip] / close[-back] - 1, or none with fewer. Holds ``back`` closes of a symbol and the best k."""

    def __init__(self):
        self.symbol, self.held, self.best, self.win, self.k = None, deque(), [], None, 0

    def _close(self, back: int, skip: int, k: int) -> None:
        if self.held and len(self.held) == back and self.held[0]:
            entry = (self.held[-skip] / self.held[0] - 1, _Last(self.symbol))
            (heapq.heappush if len(self.best) < k else heapq.heappushpop)(self.best, entry)

    def eval(self, row: Row, back: int, skip: int, k: int):
        if row["symbol"] != self.symbol:
            self._close(back, skip, k)
            self.symbol, self.held = row["symbol"], deque(maxlen=back)
        self.held.append(row["close"])
        self.win, self.k, self.back, self.skip = row["win"], k, back, skip

    def terminate(self):
        if self.win is None:
            return
        self._close(self.back, self.skip, self.k)
        if len(self.best) == self.k:
            for rank, (score, name) in enumerate(sorted(self.best, key=lambda e: (-e[0], e[1].name)), 1):
                yield self.win, name.name, score, rank


class _Last:
    """A name that sorts from the end, so that of equal scores the first name is kept."""

    def __init__(self, name: str):
        self.name = name

    def __lt__(self, other: _Last) -> bool:
        return self.name > other.name

    def __eq__(self, other) -> bool:
        return self.name == other.name


def register(spark: SparkSession) -> list[str]:
    """Make all of them known to a session; the names."""
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    for name, (head, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({head} RETURN {body}")
    return [*TABLE_FUNCTIONS, *SCALARS]

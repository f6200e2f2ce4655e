"""Folds over long series in two levels: blocks are summarised side by side, their summaries composed in order, and each block is run from the state it begins with.

A series is not one task: rows are dealt in ranges of (series, time), and a fold is given by
what it needs to know of a block to carry any state over it. Only these summaries, one a
block, meet by series.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folders import shared


class Fold(Protocol):
    """A fold over blocks of a series; states and summaries are what JSON holds, and a state is None before the first row."""

    def summary(self, rows: pd.DataFrame) -> Any:
        """What the block does to any state; rows have their place ``_i`` in the series' block ``_b``."""

    def after(self, state: Any, summary: Any) -> Any:
        """The state after a block that began with ``state``."""


@dataclass(frozen=True)
class Dealt:
    """Rows written in blocks: columns ``_b`` (ascending along each series) and ``_i`` (place in the block)."""

    rows: DataFrame
    by: str
    at: str


def deal(df: DataFrame, by: str, at: str, *, blocks: int | None = None, path: str | None = None) -> Dealt:
    """``df`` dealt in ranges of (by, at), as many as the session's shuffle partitions unless given, and written.

    Rows of one series and time stay in one block, in an order of their other columns; a null
    time comes first.
    """
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or shared(spark, "blocks")
    rest = [c for c in df.columns if c not in (by, at)]
    df.repartitionByRange(blocks, by, at).withColumn("_b", F.spark_partition_id()).write.parquet(f"{path}/ranges")
    rows = spark.read.parquet(f"{path}/ranges")
    order = [f.name for f in rows.schema if f.name in rest and f.dataType.typeName() not in ("map", "variant")]
    # a block is a range of one task; numbering it needs no other rows
    rows.withColumn("_i", F.row_number().over(W.partitionBy(by, "_b").orderBy(at, *order)) - 1).write.parquet(f"{path}/rows")
    return Dealt(spark.read.parquet(f"{path}/rows"), by, at)


def states(dealt: Dealt, fold: Fold, columns: list[str]) -> DataFrame:
    """(by, _b, state): the state of ``fold`` before each block, as JSON; ``columns`` are those that its summaries read."""
    by, kind = dealt.by, dealt.rows.schema[dealt.by].dataType.simpleString()

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        return pd.DataFrame({by: rows[by].iloc[:1], "_b": rows["_b"].iloc[:1], "summary": [json.dumps(fold.summary(rows))]})

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, out = rows.sort_values("_b"), None, []
        for summary in rows["summary"]:
            out.append(json.dumps(state))
            state = fold.after(state, json.loads(summary))
        return pd.DataFrame({by: rows[by], "_b": rows["_b"], "state": out})

    blocks = dealt.rows.select(by, "_b", "_i", *columns).groupBy(by, "_b").applyInPandas(summarise, f"`{by}` {kind}, _b int, summary string")
    return blocks.groupBy(by).applyInPandas(compose, f"`{by}` {kind}, _b int, state string")


def run(dealt: Dealt, before: DataFrame, step: Callable[[pd.DataFrame, Any], pd.DataFrame], columns: list[str], schema: str) -> DataFrame:
    """What ``step`` makes of every block and the state it begins with."""
    by = dealt.by

    def block(rows: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        return step(rows.sort_values("_i"), json.loads(first["state"].iloc[0]))

    rows = dealt.rows.select(by, "_b", "_i", *columns)
    return rows.groupBy(by, "_b").cogroup(before.groupBy(by, "_b")).applyInPandas(block, schema)


class Turns:
    """The pivots of a zigzag as a fold. A state is (way, extreme, its block and row); before the first turn the way is 0 and both extremes are kept.

    Going up, the first turn of a block is its first row at least ``percent`` under the
    highest before it. Which row that is depends on the top that comes in only through the
    block's record lows: it is the first of them that is far enough under that top, or else
    the first row far enough under the block's own. From a turn on nothing before matters. So
    a block is summed up by its record lows before its own turn, with the state at its end from
    each of them; records with one end are one. Going down is the mirror image.
    """

    def __init__(self, percent: float = 5.0):
        self.factors = {1: 1 - percent / 100, -1: 1 + percent / 100}

    def beyond(self, x: float, y: float, way: int) -> bool:
        """Whether ``x`` is a new extreme after ``y``."""
        return x > y if way > 0 else x < y

    def turned(self, x: float, extreme: float, way: int) -> bool:
        return x <= extreme * self.factors[1] if way > 0 else x >= extreme * self.factors[-1]

    def summary(self, rows: pd.DataFrame) -> dict:
        return self.block(rows["close"].astype(float).tolist(), int(rows["_b"].iloc[0]))

    def block(self, close: list[float], block: int) -> dict:
        known: dict[tuple[int, int], list] = {}

        def end(row: int, way: int) -> list:
            """The state at the block's end if ``row`` is the extreme going ``way``."""
            passed, at, found = [(row, way)], row, known.get((row, way))
            i = row + 1
            while found is None and i < len(close):
                if self.beyond(close[i], close[at], way):
                    at = i
                    found = known.get((i, way))
                elif self.turned(close[i], close[at], way):
                    way, at = -way, i
                    found = known.get((i, way))
                    passed.append((i, way))
                i += 1
            found = found or [way, close[at], block, at]
            known.update(dict.fromkeys(passed, found))
            return found

        out: dict = {"first": [close[0], block, 0]}
        for way in (1, -1):
            records, own, extreme = [], None, 0
            for i, x in enumerate(close):
                if self.beyond(x, close[extreme], way):
                    extreme = i
                if self.turned(x, close[extreme], way):
                    own = i
                    break
                if not records or self.beyond(x, close[records[-1]], -way):
                    records.append(i)
            own = own if own is None else end(own, -way)
            ends = [(close[i], end(i, -way)) for i in reversed(records)][::-1]
            kept = [e for k, e in enumerate(ends) if k + 1 == len(ends) or ends[k + 1][1] != e[1]]
            most = max if way > 0 else min
            best = most(close)
            out[str(way)] = {"records": kept, "own": own, "extreme": [best, block, close.index(best)]}
        return out

    def _through(self, extreme: list, way: int, summary: dict) -> tuple[list | None, list]:
        """(the state after the block's first turn, or None if it has none; the extreme without a turn)."""
        s = summary[str(way)]
        first = next((e for x, e in s["records"] if self.turned(x, extreme[0], way)), s["own"])
        return first, s["extreme"] if self.beyond(s["extreme"][0], extreme[0], way) else extreme

    def after(self, state: Any, summary: dict) -> dict:
        if state is None:  # the first row is both extremes
            state = {"way": 0, "1": summary["first"], "-1": summary["first"], "start": summary["first"][1:]}
        kept = {}
        for way in (1, -1) if state["way"] == 0 else (state["way"],):
            # before the first turn a block may turn both ways: then both orders end the same
            turned, extreme = self._through(state[str(way)], way, summary)
            if turned:
                return {"way": turned[0], str(turned[0]): turned[1:]}
            kept[str(way)] = extreme
        return {**state, **kept}

    def marks(self, close: list[float], block: int, state: Any) -> Iterator[tuple[int, int, int]]:
        """(block, row, pivot) of the extremes that the rows of a block confirm; the first row of a series is none of them."""
        first = [close[0], block, 0]
        state = state or {"way": 0, "1": first, "-1": first, "start": first[1:]}
        way, extremes = state["way"], {w: state[str(w)] for w in (1, -1) if str(w) in state}
        for i, x in enumerate(close):
            extremes = {w: [x, block, i] if self.beyond(x, e[0], w) else e for w, e in extremes.items()}
            turn = next((w for w, e in extremes.items() if self.turned(x, e[0], w)), None)
            if turn is not None:
                place = extremes[turn][1:]
                if way or place != state["start"]:
                    yield (*place, turn)
                way, extremes = -turn, {-turn: [x, block, i]}


def zigzag(df: DataFrame, percent: float = 5.0, *, by: str = "symbol", at: str = "date", blocks: int | None = None) -> DataFrame:
    """(by, at, close, pivot): 1 at confirmed tops, -1 at bottoms, of moves of at least ``percent``; else 0.

    A top is confirmed by a fall of that much from it, a bottom by such a rise. Prices are
    positive; a null one confirms nothing. A series is as many tasks as it has blocks.
    """
    dealt, fold, kind = deal(df.select(by, at, F.col("close").cast("double").alias("close")), by, at, blocks=blocks), Turns(percent), df.schema[by].dataType.simpleString()

    def step(rows: pd.DataFrame, state: Any) -> pd.DataFrame:
        found = list(fold.marks(rows["close"].tolist(), int(rows["_b"].iloc[0]), state))
        columns = {"_b": [m[0] for m in found], "_i": [m[1] for m in found], "pivot": [m[2] for m in found]}
        return pd.DataFrame({by: pd.Series([rows[by].iloc[0]] * len(found), dtype=object), **{c: pd.Series(x, dtype="int32") for c, x in columns.items()}})

    marks = run(dealt, states(dealt, fold, ["close"]), step, ["close"], f"`{by}` {kind}, _b int, _i int, pivot int").withColumnsRenamed({by: "_by", "_b": "_mb", "_i": "_mi"})
    on = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_mb")) & (F.col("_i") == F.col("_mi"))
    return dealt.rows.join(marks, on, "left").select(by, at, "close", F.coalesce("pivot", F.lit(0)).alias("pivot"))


def running(df: DataFrame, column: str, name: str, how: str = "sum", *, by: str = "symbol", at: str = "date", blocks: int | None = None) -> DataFrame:
    """``df`` with ``name``: the running sum, max, min or last value (null skipped) of ``column`` along each series, in window functions of two levels.

    A block's own value and what its series' blocks before add up to, one row a block. Before
    the first value it is null.
    """
    dealt = deal(df, by, at, blocks=blocks)
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least, "last": lambda a, b: F.coalesce(b, a)}[how]
    over = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, True)}[how]
    whole = F.max_by(column, "_i") if how == "last" else over(column)
    sums = dealt.rows.where(F.col(column).isNotNull()).groupBy(by, "_b").agg(whole.alias("_whole"))
    blocks_of = dealt.rows.select(by, "_b").distinct().join(sums.withColumnsRenamed({by: "_by", "_b": "_sb"}), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_sb")), "left")
    before = blocks_of.select(F.col(by).alias("_by"), F.col("_b").alias("_sb"), over("_whole").over(W.partitionBy(by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    own = over(column).over(W.partitionBy(by, "_b").orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    met = dealt.rows.withColumn("_own", own).join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_sb")))
    return met.withColumn(name, both(F.col("_before"), F.col("_own"))).select(*dict.fromkeys([*df.columns, name]))

"""Streams whose state ends by itself: bars closed by event-time timers, recent items that expire, late news met with sessions.

The keyed processors keep their state in RocksDB (``state_conf``), so it may be larger than
memory and survives a restart. A bar is given out when the watermark passes its end, though
its symbol has no further tick.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# times are whole numbers within the processors: pandas would give them the session's time zone
BARS = "symbol string, start long, open double, high double, low double, close double, volume double"
RECENT = "symbol string, items int, newest long, texts array<string>"


def state_conf(spark: SparkSession) -> None:
    """State in RocksDB, which keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ClosedBars(StatefulProcessor):
    """Open bars of a symbol, a few numbers each, and a timer at the end of each bar."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "start long", "first long, open double, high double, low double, last long, close double, volume double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.sort_values("at", kind="stable")
            starts = part["at"] // (self.seconds * 10**6) * self.seconds
            passed = timerValues.getCurrentWatermarkInMs() // 1000
            for start, own in part.groupby(starts):
                if start + self.seconds <= passed:
                    continue  # the bar is given out
                place = (int(start),)
                known = self.bars.getValue(place) if self.bars.containsKey(place) else None
                first, last = own.iloc[0], own.iloc[-1]
                bar = [first["at"], first["price"], own["price"].max(), own["price"].min(), last["at"], last["price"], own["size"].sum()]
                if known is not None:
                    a, o, h, low, b, c, v = known
                    bar = [*([a, o] if a <= bar[0] else bar[:2]), max(h, bar[2]), min(low, bar[3]), *([b, c] if b > bar[4] else bar[4:6]), v + bar[6]]
                else:
                    self.handle.registerTimer((int(start) + self.seconds) * 1000)
                self.bars.updateValue(place, (int(bar[0]), *map(float, bar[1:4]), int(bar[4]), *map(float, bar[5:])))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.seconds
        if self.bars.containsKey((start,)):
            _, o, h, low, _, c, v = self.bars.getValue((start,))
            self.bars.removeKey((start,))
            yield pd.DataFrame({"symbol": [key[0]], "start": [start], "open": [o], "high": [h], "low": [low], "close": [c], "volume": [v]})

    def close(self) -> None:
        pass


def closed_bars(ticks: DataFrame, seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """Bars (symbol, ts, open, high, low, close, volume) of a stream of ticks (symbol, ts, price, size), each once, when the watermark passes its end; later ticks are dropped.

    State holds the bars that are open. Of ticks at one time the open is the first and the
    close the last of their batch.
    """
    keyed = ticks.withWatermark("ts", late).select("symbol", "ts", F.unix_micros("ts").alias("at"), "price", "size").groupBy("symbol")
    bars = keyed.transformWithStateInPandas(ClosedBars(seconds), BARS, "append", "EventTime")
    return bars.select("symbol", F.timestamp_seconds("start").alias("ts"), "open", "high", "low", "close", "volume")


class Recent(StatefulProcessor):
    """The last items of a symbol, each forgotten ``ttl`` seconds after it came, by the store itself."""

    def __init__(self, most: int, ttl: float):
        self.most, self.ttl = most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "at long, text string", ttlDurationMs=int(self.ttl * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(t), x) for part in rows for t, x in zip(part["at"], part["text"])]
        # items that stay are not written again, or their time would begin anew
        kept = list(self.items.get())
        items = sorted([*kept, *came])[-self.most :]
        if len(kept) + len(came) > self.most:
            self.items.put(items)
        else:
            self.items.appendList(came)
        yield pd.DataFrame({"symbol": [key[0]], "items": [len(items)], "newest": [items[-1][0]], "texts": [[x for _, x in items]]})

    def close(self) -> None:
        pass


def recent_items(items: DataFrame, most: int = 5, ttl: float = 3600.0) -> DataFrame:
    """(symbol, items, newest, texts) of a stream (symbol, ts, text): what is known of each symbol that a batch brings, at most ``most`` items of the last ``ttl`` seconds.

    Where more come than are kept, those that stay are written anew and count from then on.
    """
    keyed = items.select("symbol", F.unix_micros("ts").alias("at"), "text").groupBy("symbol")
    known = keyed.transformWithStateInPandas(Recent(most, ttl), RECENT, "update", "ProcessingTime")
    return known.select("symbol", "items", F.timestamp_micros("newest").alias("newest"), "texts")


def next_sessions(news: DataFrame, sessions: DataFrame, *, late: str = "1 day", reach_days: int = 31, salts: int = 16) -> DataFrame:
    """News (ts, ...) of a stream with the first session (opens, previous) at or after it: an interval join of two streams.

    A session follows the one that opened at ``previous`` (null: the first one) and takes what
    came after that. News and sessions may be ``late``; either side's state is dropped once the
    other's watermark is ``reach_days`` away, so it holds that stretch of each and no more.
    Streams join on equal keys: a stretch of ``reach_days``, of which a session is in two, and a
    salt, of which it, being rare, is in all, so that news of one time are dealt over tasks.
    """
    stretch = lambda c: F.floor(F.unix_timestamp(c) / (86400 * reach_days)).cast("long")
    n = news.withWatermark("ts", late).withColumns({"_stretch": stretch("ts"), "_salt": F.pmod(F.xxhash64(*news.columns), F.lit(salts)).cast("int")})
    s = sessions.withWatermark("opens", late).withColumn("_stretch", F.explode(F.array(stretch("opens"), stretch("opens") - 1)))
    s = s.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    s = s.withColumnsRenamed({"_stretch": "_s", "_salt": "_t"})
    after = F.col("previous").isNull() | (F.col("ts") > F.col("previous"))
    near = (F.col("ts") <= F.col("opens")) & (F.col("opens") <= F.col("ts") + F.expr(f"INTERVAL {int(reach_days)} DAYS")) & after
    return n.join(s, (F.col("_stretch") == F.col("_s")) & (F.col("_salt") == F.col("_t")) & near).drop("_stretch", "_salt", "_s", "_t")

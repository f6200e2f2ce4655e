"""Relational operators of market tables: adjustment, validation, as-of and range joins, grids, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import adjust_ratio


def adjust(df: DataFrame) -> DataFrame:
    """adjusted_open, adjusted_high, adjusted_low from the closing ratio (0 where it has none); volume stays raw."""
    r = adjust_ratio()
    return df.withColumns({f"adjusted_{c}": F.col(c) * r for c in ("open", "high", "low")})


def adjusted_view(df: DataFrame) -> DataFrame:
    """Adjusted prices under the plain names, raw ones as raw_*."""
    df = adjust(df)
    prices = ("open", "high", "low", "close")
    return df.select("symbol", "date", *[F.col(f"adjusted_{c}").alias(c) for c in prices], *[F.col(c).alias(f"raw_{c}") for c in prices], "volume")


def validation_flags(df: DataFrame, jump: float = 0.5) -> DataFrame:
    """A row of flags for each bar: nonpositive price, extreme adjustment, jump from the previous close, dirty open."""
    prev = F.lag("close").over(W.partitionBy("symbol").orderBy("date"))
    ratio = adjust_ratio()
    return df.select(
        "symbol", "date", (F.least("open", "high", "low", "close") <= 0).alias("nonpositive"), ((ratio > 100) | (ratio < 0.01)).alias("extreme_adjustment"),
        F.coalesce(F.abs(F.col("close") / prev - 1) > jump, F.lit(False)).alias("jump"),
        F.coalesce((F.abs(prev - F.col("open")) > 0.2 * (prev + F.col("open"))) & (prev + F.col("open") > 10), F.lit(False)).alias("dirty"),
    )


def full_history(df: DataFrame) -> DataFrame:
    """Symbols with a close on every date of the table."""
    days = df.select(F.countDistinct("date").alias("days"))
    counts = df.groupBy("symbol").agg(F.count("close").alias("n"))
    return df.join(counts.join(F.broadcast(days), F.col("n") == F.col("days")).select("symbol"), "symbol", "left_semi")


def enough_rows(df: DataFrame) -> DataFrame:
    """Symbols with at least the mean number of rows."""
    counts = df.groupBy("symbol").agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("m"))
    return counts.join(F.broadcast(mean), F.col("n") >= F.col("m")).select("symbol", "n")


def delisted(df: DataFrame, expected_end: Column, grace: int = 3, cut: int = 7) -> DataFrame:
    """Rows without the last ``cut`` days of symbols that end over ``grace`` days before ``expected_end``."""
    last = df.groupBy("symbol").agg(F.max("date").alias("_last"))
    kept = df.join(last, "symbol")
    gone = F.col("_last") < F.date_sub(expected_end, grace)
    return kept.where(~gone | (F.col("date") <= F.date_sub("_last", cut))).drop("_last")


def next_trading_day(events: DataFrame, calendar: DataFrame, day: str = "day") -> DataFrame:
    """As-of forward join: each row's first calendar date on or after its day, null beyond the end.

    The calendar becomes the interval of days that lead to each date, exploded to days (one
    row a calendar day), so that the join is an equi-join. The first interval starts at the
    smallest day of the events.
    """
    least = events.agg(F.to_date(F.min(day)).alias("_least"))
    prev = F.coalesce(F.date_add(F.lag("date").over(W.orderBy("date")), 1), F.least("date", "_least"))
    days = calendar.crossJoin(F.broadcast(least)).select("date", prev.alias("_prev")).select("date", F.explode(F.sequence("_prev", "date")).alias("_day"))
    return events.join(days, events[day] == days["_day"], "left").drop("_day").withColumnRenamed("date", "session")


def state_window(rows: DataFrame, at: DataFrame, back: int, forward: int = 0) -> DataFrame:
    """For each position of ``at`` (symbol, pos) the rows (symbol, pos, ...) of [pos - back, pos + forward].

    Positions are exploded into the blocks they can meet, so the join is an equi-join on the
    block and only then a range.
    """
    size = back + forward + 1
    left = at.select("symbol", F.col("pos").alias("at"), F.explode(F.sequence(F.floor((F.col("pos") - back) / size), F.floor((F.col("pos") + forward) / size))).alias("block"))
    right = rows.withColumn("block", F.floor(F.col("pos") / size))
    return left.join(right, ["symbol", "block"]).where((F.col("pos") >= F.col("at") - back) & (F.col("pos") <= F.col("at") + forward)).drop("block")


def calendar_grid(df: DataFrame) -> DataFrame:
    """A row for each symbol and calendar day between the table's first and last; the ends are one row."""
    ends = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return df.select("symbol").distinct().join(F.broadcast(ends)).select("symbol", F.explode(F.sequence("lo", "hi")).alias("date"))


def gap_fill(df: DataFrame) -> DataFrame:
    """A missing bar repeats the previous close in all prices with volume 0; before the first bar its close; none at all: 0.

    Each bar is exploded over the days it stands for, up to the symbol's next bar (the first
    one also over the days before it), so that the grid needs no join.
    """
    w = W.partitionBy("symbol").orderBy("date")
    ends = df.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))  # one row
    close = F.coalesce(F.last("close", True).over(w), F.first("close", True).over(w.rowsBetween(0, W.unboundedFollowing)), F.lit(0.0))
    bars = df.withColumns({"_c": close, "_before": F.lag("date").over(w), "_next": F.lead("date").over(w)}).join(F.broadcast(ends))
    first = F.when(F.col("_before").isNull(), F.col("_lo")).otherwise(F.col("_own"))
    days = bars.withColumnRenamed("date", "_own").withColumn("date", F.explode(F.sequence(first, F.coalesce(F.date_sub("_next", 1), "_hi"))))
    own = lambda c: F.when(F.col("date") == F.col("_own"), F.col(c))
    return days.select("symbol", "date", *[F.coalesce(own(c), "_c").alias(c) for c in ("open", "high", "low", "close")], F.coalesce(own("volume"), F.lit(0.0)).alias("volume"))


def rolling_windows(spark, first: str, last: str, size: int, step: int = 1) -> DataFrame:
    """(win, lo, hi): half-open windows of ``size`` years every ``step`` years that end by ``last``."""
    n = F.floor(F.months_between(F.lit(last).cast("date"), F.add_months(F.lit(first).cast("date"), 12 * size)) / (12 * step))
    i = spark.range(1).select(F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("i"))
    lo = F.expr(f"add_months(date'{first}', i * {12 * step})")
    return i.select(F.col("i").alias("win"), lo.alias("lo"), F.add_months(lo, 12 * size).alias("hi"))


def bars_in_windows(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Each bar once for every window it lies in; the windows table is a handful of rows."""
    return bars.join(F.broadcast(windows), (F.col("date") >= F.col("lo")) & (F.col("date") < F.col("hi")))


def splice(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Rows of ``newer`` from its first common date on, before it ``older`` scaled to meet it there. Keyed by symbol."""
    both = newer.select("symbol", "date", F.col("close").alias("nc")).join(older.select("symbol", "date", F.col("close").alias("oc")), ["symbol", "date"])
    meet = both.groupBy("symbol").agg(F.min("date").alias("at"), (F.min_by("nc", "date") / F.min_by("oc", "date")).alias("factor"))
    before = older.join(meet, "symbol").where(F.col("date") < F.col("at")).select("symbol", "date", (F.col("close") * F.col("factor")).alias("close"))
    return before.unionByName(newer.join(meet, "symbol").where(F.col("date") >= F.col("at")).select("symbol", "date", "close"))


def resample(ticks: DataFrame, every: str, by: str = "symbol") -> DataFrame:
    """OHLCV bars of (symbol, ts, price, size); empty bins have no row."""
    g = ticks.groupBy(by, F.window("ts", every).alias("w"))
    bars = g.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"))
    return bars.select(by, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def adjust_by_precedence(df: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """adjusted_* of every field: the table's own where it has one, else the raw price times the closing ratio, else the raw close.

    Without a closing ratio (no close, or 0) the raw price counts as 0 times it.
    """
    ratio = adjust_ratio()
    own = lambda c: F.col(f"adjusted_{c}") if f"adjusted_{c}" in df.columns else F.lit(None).cast("double")
    return df.withColumns({f"adjusted_{c}": F.coalesce(own(c), F.col(c) * ratio, F.col("close")) for c in fields})


def price_at(df: DataFrame, field: str) -> Column:
    """A bar's price by a field's name: the field, else its raw one adjusted (with a close other than 0), else the adjusted or raw close."""
    there = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    raw = there(field.removeprefix("adjusted_"))
    adjusted = F.when(F.col("close") != 0, raw * there("adjusted_close") / F.col("close")) if field.startswith("adjusted_") else F.lit(None).cast("double")
    last = (there("adjusted_close"), there("close")) if field.endswith("close") else (there("close"), there("adjusted_close"))
    return F.coalesce(there(field), adjusted, *last)

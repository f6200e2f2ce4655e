"""Alpha factors over windows of n bars; infinite and missing values become 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import full, lag, series

EPS = 1e-12


def candle() -> dict[str, Column]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    up, down = F.greatest(o, c), F.least(o, c)
    return {
        "kmid": (c - o) / c, "kmid2": (c - o) / (h - lo + EPS), "klen": (h - lo) / o, "kup": (h - up) / o, "kup2": (h - up) / (h - lo + EPS),
        "klow": (down - lo) / o, "klow2": (down - lo) / (h - lo + EPS), "ksft": (2 * c - h - lo) / o, "ksft2": (2 * c - h - lo) / (h - lo + EPS),
    }


def windowed(n: int, compat: bool = False) -> dict[str, Column]:
    """Needs the columns of ``prepare``; every one is over the same window, so one sort serves all.

    ``compat``: corr and cord of a series with itself, which is 1 wherever they are defined.
    """
    w = series().rowsBetween(-(n - 1), 0)
    c, v, old = F.col("close"), F.col("volume"), lag("close", n)
    # of the bar itself and the close n bars ago; null without that close
    lo, hi = (F.when(old.isNotNull(), f(F.col(x), old)) for f, x in ((F.least, "low"), (F.greatest, "high")))
    held = F.collect_list("close").over(w)
    highs, lows = F.collect_list("high").over(w), F.collect_list("low").over(w)
    top, bottom = F.array_position(highs, F.array_max(highs)) - 1, F.array_position(lows, F.array_min(lows)) - 1  # the first of equals, from 0
    total, vtotal = F.sum("_abs").over(w) + EPS, F.sum("_vabs").over(w) + EPS
    sump, vsump = F.sum("_up").over(w) / total, F.sum("_vup").over(w) / vtotal
    cntp, cntn = F.avg("_isup").over(w), F.avg("_isdown").over(w)
    wv = F.avg("_wv").over(w)
    below = F.aggregate(held, F.lit(0.0), lambda s, x: s + F.when(x < F.element_at(held, -1), 1.0).when(x == F.element_at(held, -1), 0.5).otherwise(0.0)) + 0.5
    out = {
        "roc": old / c, "ma": F.avg("close").over(w) / c, "std": F.stddev_samp("close").over(w) / c, "beta": (old - c) / (n * c),
        "max": F.max("close").over(w) / c, "min": F.min("close").over(w) / c,
        "qtlu": F.percentile("close", F.lit(0.8)).over(w) / c, "qtld": F.percentile("close", F.lit(0.2)).over(w) / c,
        "rank": below / n / n, "imax": top / float(n), "imin": bottom / float(n),
        "imxd": (top - bottom) / float(n), "rsv": (c - lo) / (hi - lo + EPS),
        "cntp": cntp, "cntn": cntn, "cntd": cntp - cntn, "corr": F.corr("close", "close" if compat else "_logv").over(w), "cord": F.corr("_ret", "_ret" if compat else "_vret").over(w),
        "sump": sump, "sumn": 1 - sump, "sumd": 2 * sump - 1, "vma": F.avg("volume").over(w) / (v + EPS), "vstd": F.stddev_samp("volume").over(w) / (v + EPS),
        "wvma": F.stddev_samp("_wv").over(w) / (wv + EPS), "vsump": vsump, "vsumn": 1 - vsump, "vsumd": 2 * vsump - 1,
    }
    return {f"{k}_{n}": full(n + 1 if k in ("sump", "sumn", "sumd", "vsump", "vsumn", "vsumd", "wvma", "cord") else n, x) for k, x in out.items()}


def prepare(df: DataFrame) -> DataFrame:
    d, dv = F.col("close") / lag("close") - 1, F.col("volume") - lag("volume")
    pos = lambda x: F.when(x > 0, x).when(x.isNotNull(), 0.0)
    df = df.withColumns({
        "_ret": F.col("close") / lag("close"), "_vret": F.log(F.col("volume") / lag("volume") + 1), "_logv": F.log(F.col("volume") + 1),
        "_abs": F.abs(d), "_up": pos(d), "_vabs": F.abs(dv), "_vup": pos(dv), "_isup": F.coalesce((d > 0).cast("double"), F.lit(0.0)), "_isdown": F.coalesce((d < 0).cast("double"), F.lit(0.0)),  # the first bar is neither
    })
    return df.withColumn("_wv", F.abs(F.col("_ret") - 1) * F.col("volume"))


def factors(df: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 30, 60), *, compat: bool = False, level: str = "day") -> DataFrame:
    """All families for all windows, plus log volume and calendar parts of the date (and, at ``level`` minute, of the time)."""
    columns = candle()
    for n in windows:
        columns |= windowed(n, compat)
    parts = {"day": F.dayofmonth("date"), "weekday": F.weekday("date"), "month": F.month("date")}
    if level == "minute":
        parts = {"minute": F.minute("date"), "hour": F.hour("date")} | parts
    df = prepare(df).withColumns(columns | {"log_volume": F.col("_logv")} | parts)
    clean = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    return df.select("symbol", "date", *[clean(c).alias(c) for c in [*columns, "log_volume"]], *parts)

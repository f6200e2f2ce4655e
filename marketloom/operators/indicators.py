"""Technical indicators as window columns; all families over one (symbol, date) window share its sort.

A rolling value is null until its window is full. Recursive averages are sums over blocks of
rows whose weights are powers of what the average keeps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segmented import zigzag  # noqa: F401  by blocks, but an indicator like the others

BY, AT = "symbol", "date"


def series(by: str = BY, at: str = AT):
    return W.partitionBy(by).orderBy(at)


def full(n: int, value: Column) -> Column:
    return F.when(F.row_number().over(series()) >= n, value)


def rolling(fn, c, n: int) -> Column:
    """An aggregate over the last n rows, null before n rows."""
    return full(n, fn(c).over(series().rowsBetween(-(n - 1), 0)))


def lag(c, k: int = 1) -> Column:
    return F.lag(c, k).over(series())


def sma(c="close", n: int = 5) -> Column:
    return rolling(F.avg, c, n)


def wma(c="close", n: int = 10) -> Column:
    """Weights 1..n, the newest heaviest."""
    col = F.col(c) if isinstance(c, str) else c
    return full(n, sum((lag(col, k) if k else col) * float(n - k) for k in range(n)) / (n * (n + 1) / 2))


def pct_change(c="close", k: int = 1) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col / lag(col, k) - 1


def drawdown(c="equity") -> Column:
    top = F.max(c).over(series().rowsBetween(W.unboundedPreceding, 0))
    return (F.col(c) - top) / top


def bollinger(df: DataFrame, c: str = "close", n: int = 20, k: float = 2.0, sample: bool = False) -> DataFrame:
    sd = rolling(F.stddev_samp if sample else F.stddev_pop, c, n)
    return df.withColumns({"bb_mid": sma(c, n), "bb_up": sma(c, n) + k * sd, "bb_low": sma(c, n) - k * sd})


def rsi(df: DataFrame, c: str = "close", n: int = 14) -> DataFrame:
    """Simple means of gains and losses; no loss: 100; neither: null."""
    d = F.col(c) - lag(c)
    df = df.withColumn("_gain", F.when(d > 0, d).when(d.isNotNull(), 0.0)).withColumn("_loss", F.when(d < 0, -d).when(d.isNotNull(), 0.0))
    gain, loss = (full(n + 1, F.avg(x).over(series().rowsBetween(-(n - 1), 0))) for x in ("_gain", "_loss"))
    df = df.withColumn("_g", gain).withColumn("_l", loss)
    value = F.when((F.col("_l") == 0) & (F.col("_g") > 0), 100.0).when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.col("_l")))
    return df.withColumn("rsi", value).drop("_gain", "_loss", "_g", "_l")


def true_range() -> Column:
    prev = lag("close")
    return F.when(prev.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def kdj(df: DataFrame, n: int = 9, m: int = 3) -> DataFrame:
    lo, hi = rolling(F.min, "low", n), rolling(F.max, "high", n)
    df = df.withColumn("rsv", F.when(hi != lo, (F.col("close") - lo) / (hi - lo) * 100))
    w = series().rowsBetween(-(m - 1), 0)
    df = df.withColumn("k", full(n + m - 1, F.avg("rsv").over(w)))
    df = df.withColumn("d", full(n + 2 * m - 2, F.avg("k").over(w)))
    return df.withColumn("j", 3 * F.col("k") - 2 * F.col("d"))


def stochastic(df: DataFrame, n: int = 14) -> DataFrame:
    lo, hi = rolling(F.min, "low", n), rolling(F.max, "high", n)
    return df.withColumn("stoch_k", F.when(hi != lo, (F.col("close") - lo) / (hi - lo) * 100))


def zscore(c: str = "close", n: int = 14) -> Column:
    return (F.col(c) - sma(c, n)) / rolling(F.stddev_samp, c, n)


def cross(df: DataFrame, fast: Column, slow: Column, name: str = "cross") -> DataFrame:
    """+1 / -1 where fast strictly crosses slow, judged against the last difference that isn't zero."""
    df = df.withColumn("_d", fast - slow)
    before = F.last(F.when(F.col("_d") != 0, F.signum("_d")), True).over(series().rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn(name, F.when((before < 0) & (F.col("_d") > 0), 1).when((before > 0) & (F.col("_d") < 0), -1).otherwise(0)).drop("_d")


def prior_volume(n: int = 20, c: str = "volume") -> Column:
    """Mean of up to n earlier rows' volumes."""
    return F.avg(c).over(series().rowsBetween(-n, -1))


def forward_fill(c, by: str = BY, at: str = AT) -> Column:
    return F.last(c, True).over(W.partitionBy(by).orderBy(at).rowsBetween(W.unboundedPreceding, 0))


def back_fill(c, by: str = BY, at: str = AT) -> Column:
    return F.first(c, True).over(W.partitionBy(by).orderBy(at).rowsBetween(0, W.unboundedFollowing))


def forward_label(df: DataFrame, c: str = "close") -> DataFrame:
    ret = F.lead(c).over(series()) / F.col(c) - 1
    return df.withColumn("ret1", ret).withColumn("mov1", F.coalesce((F.col("ret1") > 0).cast("int"), F.lit(0)))


def month_turn(df: DataFrame) -> DataFrame:
    """entry: the month ends within five days; exit: the third weekday of a month."""
    weekdays = F.expr("size(filter(sequence(trunc(date, 'MM'), date, interval 1 day), d -> weekday(d) < 5))")
    third = (weekdays == 3) & (F.weekday("date") < 5)
    return df.withColumn("entry", F.month(F.date_add("date", 5)) != F.month("date")).withColumn("exit", third)


#: Rows of a block of a recursive average; weights within it stay far from overflow.
BLOCK = 256


def recursive(df: DataFrame, c: str, alpha: float, name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``: the average that moves by ``alpha`` towards each row's ``c``, in window functions only.

    It starts as the mean of the ``first`` values, at the last of them, and is null before. The
    average at row j of a block is (1 - alpha) ** (j + 1) times (the average at the end of the
    block before plus the sum of the block's values over (1 - alpha) ** (i + 1)); what earlier
    blocks' sums still weigh falls by (1 - alpha) ** ``BLOCK`` a block, so a few of them hold
    all that a double can. ``c`` must not be null.
    """
    keep = 1 - alpha
    w = series()
    df = df.withColumn("_p", F.row_number().over(w) - 1)
    seed = F.avg(c).over(w.rowsBetween(-(first - 1), 0)) if first > 1 else F.col(c)
    value = F.when(F.col("_p") < first - 1, 0.0).when(F.col("_p") == first - 1, seed).otherwise(alpha * F.col(c))
    j = F.col("_p") % BLOCK
    df = df.withColumn("_b", F.floor(F.col("_p") / BLOCK)).withColumn("_t", value / F.pow(F.lit(keep), j + 1))
    own = F.sum("_t").over(W.partitionBy(BY, "_b").orderBy(AT).rowsBetween(W.unboundedPreceding, 0))
    total = F.lit(0.0)
    for k in range(1, max(1, math.ceil(45 / (BLOCK * -math.log(keep)))) + 1):
        before = F.sum("_t").over(W.partitionBy(BY).orderBy("_b").rangeBetween(-k, -k))
        total = total + F.coalesce(before, F.lit(0.0)) * keep ** (BLOCK * k)
    return df.withColumn(name, F.when(F.col("_p") >= first - 1, F.pow(F.lit(keep), j + 1) * (total + own))).drop("_p", "_b", "_t")


def ema(df: DataFrame, c: str, n: int, name: str) -> DataFrame:
    """Exponential average with 2 / (n + 1), seeded by the first value."""
    return recursive(df, c, 2 / (n + 1), name)


def recursive_averages(df: DataFrame, c: str = "close") -> DataFrame:
    """EMA 9, 12, 26 and MACD with signal and histogram, seeded by the first value."""
    df = df.select(BY, AT, c)
    for n in (9, 12, 26):
        df = ema(df, c, n, f"ema{n}")
    df = ema(df.withColumn("macd", F.col("ema12") - F.col("ema26")), "macd", 9, "macd_signal")
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def wilder_atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Average true range, seeded by the mean of the first n, then Wilder's recursion."""
    return recursive(df.withColumn("tr", true_range()), "tr", 1 / n, "atr", n)


def atr_bands(df: DataFrame, n: int = 14, k: float = 1.5) -> DataFrame:
    """Bands of k average true ranges around the n-row mean of the close; 1 where the close falls under the lower, -1 over the upper."""
    df = wilder_atr(df, n).withColumns({"atr_up": sma(n=n) + k * F.col("atr"), "atr_low": sma(n=n) - k * F.col("atr")})
    return df.withColumn("signal", F.when(F.col("close") < F.col("atr_low"), 1).when(F.col("close") > F.col("atr_up"), -1).otherwise(0))


def band_signal(df: DataFrame, up: str = "bb_up", low: str = "bb_low", c: str = "close") -> DataFrame:
    """1 where the close comes back over the lower band, -1 where it comes back under the upper one."""
    was_low, was_up = lag(c) < lag(low), lag(c) > lag(up)
    return df.withColumn("signal", F.when(was_low & (F.col(c) >= F.col(low)), 1).when(was_up & (F.col(c) <= F.col(up)), -1).otherwise(0))


def trend(df: DataFrame, n: int = 20, atr: int = 10) -> DataFrame:
    """Highest close and population deviation of n rows and the average true range; 1 at a new high, -1 under it by two ranges."""
    df = wilder_atr(df, atr).withColumns({"highest": rolling(F.max, "close", n), "deviation": rolling(F.stddev_pop, "close", n)})
    return df.withColumn("signal", F.when(F.col("close") >= F.col("highest"), 1).when(F.col("close") < F.col("highest") - 2 * F.col("atr"), -1).otherwise(0))


def prior_volume_by_dates(df: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, date, prior_volume, observations): over the last n dates of the whole table before a row's, skipping those without the symbol.

    Dates are numbered once (one row a date); the frame is a range of these numbers.
    """
    calendar = df.select(AT).distinct().withColumn("_n", F.row_number().over(W.orderBy(AT)))
    w = W.partitionBy(BY).orderBy("_n").rangeBetween(-n, -1)
    return df.join(calendar, AT).select(BY, AT, F.avg("volume").over(w).alias("prior_volume"), F.count("volume").over(w).alias("observations"))


def cci(n: int = 30) -> Column:
    """(typical price - its mean) / (0.015 x mean absolute deviation) of n rows."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    held = F.collect_list(typical).over(series().rowsBetween(-(n - 1), 0))
    mean = F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.aggregate(held, F.lit(0.0), lambda s, x: s + F.abs(x - mean)) / n
    return full(n, F.when(spread > 0, (typical - mean) / (0.015 * spread)))


def directional(df: DataFrame, n: int = 30) -> DataFrame:
    """dx: 100 x |plus - minus| / (plus + minus), of Wilder's averages of the directional moves over that of the true range."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    zero = F.lit(0.0)
    df = df.withColumns({
        "_up": F.coalesce(F.when((up > down) & (up > 0), up), zero), "_down": F.coalesce(F.when((down > up) & (down > 0), down), zero), "tr": true_range(),
    })
    for c in ("_up", "_down", "tr"):
        df = recursive(df, c, 1 / n, f"{c}_avg")
    plus, minus = 100 * F.col("_up_avg") / F.col("tr_avg"), 100 * F.col("_down_avg") / F.col("tr_avg")
    dx = F.when(plus + minus > 0, 100 * F.abs(plus - minus) / (plus + minus)).otherwise(0.0)
    return df.withColumn("dx", full(n, dx)).drop("_up", "_down", "_up_avg", "_down_avg", "tr_avg")


def atr_divergence(df: DataFrame, atr: int = 7, k: float = 2.0, spread: int = 7, drift: int = 7, times: float = 1.0, compat: bool = False) -> DataFrame:
    """1 where the true range leaves its mean by ``times`` deviations in an upward drift, -1 under the highest trailing stop.

    The range is a simple mean of ``atr`` true ranges. Drift is the mean log return less half
    its variance; it points up if above 0 and above its last two values (``compat``: above its
    last two values, or above 0).
    """
    df = df.withColumn("_tr", true_range()).withColumn("atr", rolling(F.avg, "_tr", atr))
    df = df.withColumns({"_stop": F.col("low") - k * F.col("atr"), "_ret": F.log(F.col("close") / lag("close"))})
    mean, dev = (full(atr + spread - 1, f("atr").over(series().rowsBetween(-(spread - 1), 0))) for f in (F.avg, F.stddev_samp))
    move = full(drift + 1, F.avg("_ret").over(series().rowsBetween(-(drift - 1), 0)) - 0.5 * F.pow(F.stddev_samp("_ret").over(series().rowsBetween(-(drift - 1), 0)), F.lit(2.0)))
    df = df.withColumns({"_mean": mean, "_dev": dev, "drift": move, "stop": F.max("_stop").over(series().rowsBetween(W.unboundedPreceding, 0))})
    rising = (F.col("drift") > lag("drift")) & (F.col("drift") > lag("drift", 2))
    rising = rising | (F.col("drift") > 0) if compat else rising & (F.col("drift") > 0)
    entry = (F.abs(F.col("atr") - F.col("_mean")) > times * F.col("_dev")) & rising
    signal = F.when(F.col("low") < F.col("stop"), -1).when(entry, 1).otherwise(0)
    return df.withColumn("signal", signal).drop("_tr", "_stop", "_ret", "_mean", "_dev")


def price_moves(df: DataFrame, back: tuple[int, ...] = (1, 7, 14), ahead: tuple[int, ...] = (1, 7, 14), c: str = "close") -> DataFrame:
    """Relative moves over the last and the next k rows."""
    now = F.col(c)
    return df.withColumns({f"past_{k}": now / lag(c, k) - 1 for k in back} | {f"next_{k}": F.lead(c, k).over(series()) / now - 1 for k in ahead})


def feedback(df: DataFrame, shares: str = "shares", c: str = "close", window: int = 7, moment: int = 3) -> DataFrame:
    """Signs of the gain of the last ``window`` moves with the shares held before each, and of the last ``moment`` moves of the price; null before there are that many."""
    move = F.col(c) - lag(c)
    df = df.withColumns({"_move": move, "_gain": move * lag(shares)})
    total = lambda x, n: full(n + 1, F.signum(F.sum(x).over(series().rowsBetween(-(n - 1), 0)))).cast("int")
    return df.withColumns({"feedback": total("_gain", window), "moment": total("_move", moment)}).drop("_move", "_gain")


#: Names of signal columns and how they are made; every function adds a ``signal`` column.
SIGNALS = {
    "atr_bands": atr_bands, "bollinger": lambda df: band_signal(bollinger(df)), "trend": trend, "sma_cross": lambda df: cross(df, sma(n=10), sma(n=20), "signal"),
    "wma_cross": lambda df: cross(df, wma(n=10), wma(n=20), "signal"), "atr_divergence": atr_divergence,
}


def latest_signals(df: DataFrame, day, names: tuple[str, ...] = ("atr_bands", "bollinger", "sma_cross", "atr_divergence")) -> DataFrame:
    """(symbol, strategy, date, signal) of each symbol's last row up to ``day``, for every named rule."""
    rows = df.where(F.col(AT) <= F.lit(day).cast("date"))
    parts = [SIGNALS[n](rows).groupBy(BY).agg(F.max(AT).alias(AT), F.max_by("signal", AT).alias("signal")).select(BY, F.lit(n).alias("strategy"), AT, "signal") for n in names]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _stoch(df: DataFrame, n: int = 14, m: int = 3) -> DataFrame:
    df = stochastic(df, n)
    w = series().rowsBetween(-(m - 1), 0)
    return df.withColumn("stoch_d", full(n + m - 1, F.avg("stoch_k").over(w)))


def _money(df: DataFrame, n: int = 14) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("_t", typical)
    df = df.withColumn("_f", F.when(F.col("_t") > lag("_t"), 1).when(F.col("_t") < lag("_t"), -1).otherwise(0) * F.col("_t") * F.col("volume"))
    total = lambda sign: F.sum(F.greatest(sign * F.col("_f"), F.lit(0.0))).over(series().rowsBetween(-(n - 1), 0))
    up, down = total(1), total(-1)
    return df.withColumn("mfi", full(n + 1, F.when(up + down > 0, 100 * up / (up + down)))).drop("_t", "_f")


def _column(name: str, make):
    return lambda df, **p: df.withColumn(name, make(**p))


#: Indicators by the names that charting libraries give them; each adds columns to (symbol, date, bars).
BY_NAME = {
    "SMA": _column("sma", lambda n=30, c="close": sma(c, n)), "WMA": _column("wma", lambda n=30, c="close": wma(c, n)), "EMA": lambda df, n=30, c="close": ema(df, c, n, "ema"),
    "RSI": lambda df, n=14: rsi(df, n=n), "MACD": lambda df: df.join(recursive_averages(df).select(BY, AT, "macd", "macd_signal", "macd_hist"), [BY, AT]), "BBANDS": lambda df, n=20, k=2.0: bollinger(df, n=n, k=k),
    "ATR": lambda df, n=14: wilder_atr(df, n), "TRANGE": _column("trange", lambda: true_range()), "CCI": _column("cci", lambda n=14: cci(n)), "DX": lambda df, n=14: directional(df, n), "STOCH": _stoch, "KDJ": kdj, "MFI": _money,
    "MOM": _column("mom", lambda n=10: F.col("close") - lag("close", n)), "ROC": _column("roc", lambda n=10: 100 * (F.col("close") / lag("close", n) - 1)), "ROCP": _column("rocp", lambda n=10: F.col("close") / lag("close", n) - 1),
    "WILLR": _column("willr", lambda n=14: -100 * (rolling(F.max, "high", n) - F.col("close")) / F.nullif(rolling(F.max, "high", n) - rolling(F.min, "low", n), F.lit(0.0))),
    "MAX": _column("max", lambda n=30, c="close": rolling(F.max, c, n)), "MIN": _column("min", lambda n=30, c="close": rolling(F.min, c, n)), "SUM": _column("sum", lambda n=30, c="close": rolling(F.sum, c, n)),
    "STDDEV": _column("stddev", lambda n=5, c="close": rolling(F.stddev_pop, c, n)), "VAR": _column("var", lambda n=5, c="close": rolling(F.var_pop, c, n)), "CORREL": _column("correl", lambda n=30: full(n, F.corr("high", "low").over(series().rowsBetween(-(n - 1), 0)))),
    "AVGPRICE": _column("avgprice", lambda: (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4), "MEDPRICE": _column("medprice", lambda: (F.col("high") + F.col("low")) / 2),
    "TYPPRICE": _column("typprice", lambda: (F.col("high") + F.col("low") + F.col("close")) / 3), "WCLPRICE": _column("wclprice", lambda: (F.col("high") + F.col("low") + 2 * F.col("close")) / 4),
}


def by_name(df: DataFrame, name: str, **parameters) -> DataFrame:
    """An indicator by its name in ``BY_NAME``, on balance volume included."""
    if name == "OBV":
        move = F.col("close") - lag("close")
        return df.withColumn("_m", F.coalesce(F.signum(move), F.lit(1.0)) * F.col("volume")).withColumn("obv", F.sum("_m").over(series().rowsBetween(W.unboundedPreceding, 0))).drop("_m")
    if name not in BY_NAME:
        raise ValueError(f"unknown indicator {name!r}; known: {sorted([*BY_NAME, 'OBV'])}")
    return BY_NAME[name](df, **parameters)

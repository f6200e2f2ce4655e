"""Risk metrics of return series, as aggregations by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

YEAR = 252


def daily_rate(rate: float) -> float:
    return (1 + rate) ** (1 / YEAR) - 1


def returns(df: DataFrame, by: str = "symbol", value: str = "close") -> DataFrame:
    w = W.partitionBy(by).orderBy("date")
    top = F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.select(by, "date", F.col(value).alias("equity"), (F.col(value) / F.lag(value).over(w) - 1).alias("ret"), ((F.col(value) - top) / top).alias("dd"))


def risk(rets: DataFrame, by: str = "symbol", rate: float = 0.03, least: int = 5) -> DataFrame:
    """Sharpe and Sortino (0 with under ``least`` non-zero returns), volatility, returns and drawdown of each group."""
    x = F.col("ret") - daily_rate(rate)
    guard: Column = F.sum((F.col("ret") != 0).cast("int")) >= least
    down = F.sqrt(F.avg(F.when(x.isNotNull(), F.pow(F.least(x, F.lit(0.0)), F.lit(2.0)))))
    n = F.count("ret")
    total = F.max_by("equity", "date") / F.min_by("equity", "date") - 1
    return rets.groupBy(by).agg(
        n.alias("n"), total.alias("total_return"), (F.pow(1 + total, YEAR / F.count("*")) - 1).alias("annual_return"),
        (F.stddev_samp("ret") * YEAR**0.5).alias("volatility"),
        F.when(guard & (F.stddev_samp("ret") > 0), F.avg(x) / F.stddev_samp("ret") * YEAR**0.5).otherwise(0.0).alias("sharpe"),
        F.when(guard & (down > 0), F.avg(x) / down * YEAR**0.5).otherwise(0.0).alias("sortino"),
        (-F.min("dd") * 100).alias("max_drawdown"),
    )


def moments(rets: DataFrame, by: str = "symbol", least: int = 30) -> DataFrame:
    """Mean, deviation, population skew and excess kurtosis, 5 % value at risk, the mean at or below it, and trailing 30 and 90 day returns (mean times days).

    One aggregation: a group's sorted returns (a symbol's days) give the quantile and its tail.
    """
    agg = rets.where("ret IS NOT NULL").groupBy(by).agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"),
        F.array_sort(F.collect_list("ret")).alias("_sorted"), F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("date", "ret")))), 1, 90), lambda x: x["ret"]).alias("_last"),
    ).where(F.col("n") >= least)
    at = (F.col("n") - 1) * 0.05
    low = F.get("_sorted", F.floor(at).cast("int"))
    agg = agg.withColumn("var5", low + (at - F.floor(at)) * (F.get("_sorted", F.ceil(at).cast("int")) - low))
    tail = F.filter("_sorted", lambda x: x <= F.col("var5"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    trailing = {f"trailing_{k}": total(F.slice("_last", 1, k)) / F.least(F.size("_last"), F.lit(k)) * k for k in (30, 90)}
    return agg.withColumns({"cvar5": total(tail) / F.size(tail)} | trailing).drop("_sorted", "_last")


def grown(rets: DataFrame, by: str = "symbol") -> DataFrame:
    """Each day with a return: its number, the summed log returns, the growth of 1 since before the first day and the highest growth so far, 1 included.

    A return of -1 or less loses everything: growth is 0 from then on, and no log returns are given.
    """
    w = W.partitionBy(by).orderBy("date")
    r = rets.where("ret IS NOT NULL").select(by, "date", F.col("ret").cast("double").alias("ret"))
    r = r.withColumns({"day": F.row_number().over(w), "_lost": F.max((F.col("ret") <= -1).cast("int")).over(w), "_logs": F.sum(F.when(F.col("ret") > -1, F.log1p("ret"))).over(w)})
    r = r.withColumns({"logs": F.when(F.col("_lost") == 0, F.col("_logs")), "growth": F.when(F.col("_lost") == 0, F.exp("_logs")).otherwise(0.0)}).drop("_lost", "_logs")
    return r.withColumn("top", F.greatest(F.lit(1.0), F.max("growth").over(w)))


def performance(rets: DataFrame, by: str = "symbol", market: DataFrame | None = None) -> DataFrame:
    """The usual table of performance statistics of each group's daily returns; with ``market`` (date, market) alpha and beta as well.

    Null returns count as no day. Null is what has no value: ratios to a deviation, loss or
    drawdown of zero, the stability after a loss of everything. Value at risk is the mean less
    two deviations; the tails are the 5 % and 95 % points; stability is the squared
    correlation of summed log returns with the days; alpha is what is left of the mean, a year.
    """
    x, mean, std = F.col("ret"), F.avg("ret"), F.stddev_samp("ret")
    loss, below = -F.sum(F.least(x, F.lit(0.0))), F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2.0))))
    total, worst = F.max_by("growth", "date") - 1, F.min(F.col("growth") / F.col("top") - 1)
    annual = F.pow(1 + total, YEAR / F.count("*")) - 1
    trend = F.covar_pop("day", "logs") / F.nullif(F.stddev_pop("day") * F.stddev_pop("logs"), F.lit(0.0))
    low = F.abs(F.percentile("ret", F.lit(0.05)))
    out = {
        "n": F.count("*"), "annual_return": annual, "cumulative_return": total, "volatility": std * YEAR**0.5, "sharpe": F.when(std > 0, mean / std * YEAR**0.5),
        "calmar": F.when(worst < 0, annual / -worst), "stability": F.when(F.count("logs") == F.count("*"), trend * trend), "max_drawdown": worst,
        "omega": F.when(loss > 0, F.sum(F.greatest(x, F.lit(0.0))) / loss), "sortino": F.when(below > 0, mean / below * YEAR**0.5), "skew": F.skewness("ret"), "kurtosis": F.kurtosis("ret"),
        "tail_ratio": F.when(low > 0, F.abs(F.percentile("ret", F.lit(0.95))) / low), "value_at_risk": mean - 2 * std,
    }
    rows = grown(rets, by)
    if market is not None:
        rows = rows.join(market.select("date", F.col("market").cast("double").alias("_m")), "date", "left")
        both = F.when(F.col("_m").isNotNull(), x)
        spread = F.var_pop("_m")
        beta = F.when(spread > 0, F.covar_pop(both, F.col("_m")) / spread)
        out |= {"beta": beta, "alpha": F.pow(1 + F.avg(both) - beta * F.avg("_m"), F.lit(float(YEAR))) - 1}
    return rows.groupBy(by).agg(*[v.alias(k) for k, v in out.items()])


def drawdowns(rets: DataFrame, by: str = "symbol", most: int = 5) -> DataFrame:
    """The ``most`` deepest falls of each group: rank, peak (null: before the first day), valley, recovery (null: not yet), depth and days from peak to recovery or the last day.

    A fall goes from a day at the highest growth to the next day that is as high, up to the
    twelfth place; equal depths come by date.
    """
    w = W.partitionBy(by).orderBy("date")
    d = grown(rets, by).withColumn("_depth", F.round(F.col("growth") / F.col("top") - 1, 12)).withColumns({"_fall": F.sum((F.col("_depth") >= 0).cast("int")).over(w), "_next": F.lead("date").over(w)})
    falls = d.groupBy(by, "_fall").agg(
        F.min(F.when(F.col("_depth") >= 0, F.col("date"))).alias("peak"), F.min_by("date", F.struct("_depth", "date")).alias("valley"), F.max_by("_next", "date").alias("recovery"),
        F.min("_depth").alias("depth"), F.min("date").alias("_first"), F.max("date").alias("_last"),
    ).where("depth < 0")
    ranked = falls.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("depth", "_first")))
    return ranked.where(F.col("rank") <= most).select(by, "rank", "peak", "valley", "recovery", "depth", F.datediff(F.coalesce("recovery", "_last"), F.coalesce("peak", "_first")).alias("days"))


def correlations(rets: DataFrame, by: str = "symbol", days: int = 256, tile: int = 512) -> DataFrame:
    """(a, b, n, corr) of every pair of symbols over their common dates.

    Dates go in blocks of ``days``: a block's returns are a matrix, whose products with itself
    give every pair's sums, so a pair costs a row a block and not one a date. Symbols go in
    tiles of about ``tile``, and a task multiplies two tiles of a block, whatever their number.
    """
    keyed = rets.where("ret IS NOT NULL").select("date", by, F.col("ret").cast("double").alias("ret"))
    tiles = -(-keyed.select(by).distinct().count() // tile) or 1

    def sums(group: pa.Table) -> pa.Table:
        rows = group.to_pandas()
        one, other = rows["_one"].iloc[0], rows["_other"].iloc[0]
        parts = []
        days_of = np.unique(rows["date"])
        for own in (one, other):
            wide = rows[rows["_tile"] == own].pivot_table(index="date", columns=by, values="ret", aggfunc="first").reindex(days_of)
            parts.append((np.array(list(wide.columns), object), wide.notna().to_numpy(float), np.nan_to_num(wide.to_numpy(float))))
        (left, h, x), (right, g, y) = parts
        i, j = np.triu_indices(len(left), 1) if one == other else (k.ravel() for k in np.indices((len(left), len(right))))
        n, sx, sy, sxx, syy, sxy = (v[i, j] for v in (h.T @ g, x.T @ g, h.T @ y, (x * x).T @ g, h.T @ (y * y), x.T @ y))
        a, b = left[i], right[j]
        swap = np.array([p > q for p, q in zip(a, b)], bool)
        turned = {"a": (a, b), "b": (b, a), "n": (n, n), "sx": (sx, sy), "sy": (sy, sx), "sxx": (sxx, syy), "syy": (syy, sxx), "sxy": (sxy, sxy)}
        return pa.table({k: pa.array(np.where(swap, v, u), pa.string() if k in "ab" else pa.float64()) for k, (u, v) in turned.items()})

    # blocks are of the dates' own numbers, so no order is needed
    own = F.pmod(F.xxhash64(by), F.lit(tiles)).cast("int")
    dealt = keyed.withColumns({"_block": F.floor(F.datediff("date", F.lit("1970-01-01")) / days), "_tile": own}).withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.withColumns({"_one": F.least("_tile", "_with"), "_other": F.greatest("_tile", "_with")}).drop("_with")
    got = dealt.groupBy("_block", "_one", "_other").applyInArrow(sums, "a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double")
    t = got.where("n > 0").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    return t.select("a", "b", F.col("n").cast("long").alias("n"), F.when(spread > 0, cov / F.sqrt(spread)).alias("corr"))


def report(results: DataFrame, metric: str = "total_return") -> DataFrame:
    """Mean of a metric by (win, ticker), by ticker and over all cells, in one pass of grouping sets."""
    view = results.select("win", "ticker", F.col(metric).alias("m"))
    level = F.grouping_id("win", "ticker")
    g = view.groupingSets([["win", "ticker"], ["ticker"], []], "win", "ticker").agg(level.alias("level"), (F.avg("m") * 100).alias("mean_pct"), F.count("m").alias("cells"))
    return g.select(F.when(F.col("level") == 0, F.col("win").cast("string")).otherwise("Average").alias("win"), F.when(F.col("level") == 3, "All").otherwise(F.col("ticker")).alias("ticker"), "mean_pct", "cells")


def report_text(results: DataFrame, metrics: dict[str, float]) -> DataFrame:
    """``report`` of several metrics, each times its factor, as texts of three decimals: what a results table prints."""
    level = F.grouping_id("win", "ticker")
    g = results.groupingSets([["win", "ticker"], ["ticker"], []], "win", "ticker").agg(level.alias("level"), *[F.format_string("%.3f", F.avg(m) * k).alias(m) for m, k in metrics.items()])
    return g.select(F.when(F.col("level") == 0, F.col("win").cast("string")).otherwise("Average").alias("win"), F.when(F.col("level") == 3, "All").otherwise(F.col("ticker")).alias("ticker"), *metrics)


def broker_returns(rets: DataFrame, cash: float, by: str = "symbol", rate: float = 0.03) -> DataFrame:
    """(by, annual_return, volatility, sharpe, sortino) of an equity that began with ``cash``.

    The exponent is 252 over the number of returns, a negative last value counts as 0, and
    equities that never move have zeros.
    """
    r = risk(rets, by, rate)
    own = rets.groupBy(by).agg(F.max_by("equity", "date").alias("_end"), F.count("ret").alias("_n"), F.max(F.abs("ret")).alias("_any"))
    still = (F.col("_n") == 0) | (F.coalesce("_any", F.lit(0.0)) == 0)
    annual = F.pow(F.greatest("_end", F.lit(0.0)) / cash, YEAR / F.greatest("_n", F.lit(1))) - 1
    zero = lambda c: F.when(still, 0.0).otherwise(c)
    return r.join(own, by).select(by, zero(annual).alias("annual_return"), *[zero(F.col(c)).alias(c) for c in ("volatility", "sharpe", "sortino")])


def zero_records(rets: DataFrame, by: str = "symbol", cash: float = 100_000.0, rate: float = 0.03) -> DataFrame:
    """``risk`` with the record of groups of at most one equity point: the cash they began with and zeros."""
    r = risk(rets, by, rate)
    own = rets.groupBy(by).agg(F.count("equity").alias("_points"), F.max_by("equity", "date").alias("_end"))
    names = ("total_return", "annual_return", "volatility", "sharpe", "sortino", "max_drawdown")
    few = F.col("_points") <= 1
    return r.join(own, by).select(by, "n", F.when(few, F.lit(float(cash))).otherwise(F.col("_end")).alias("final_value"), *[F.when(few, 0.0).otherwise(F.col(c)).alias(c) for c in names])


def ratio_metrics(rets: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, arr, vol, dd, mdd, sr, cr, sor): simple annual return, population deviations of all and of negative returns, drawdown, and ratios of the mean to them.

    The running product is the exponential of a running sum of logarithms, with zero from a
    loss of everything on.
    """
    w = W.partitionBy(by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    r = rets.where("ret IS NOT NULL").withColumn("_v", F.when(F.min("ret").over(w) <= -1, 0.0).otherwise(F.exp(F.sum(F.log1p(F.greatest(F.col("ret"), F.lit(-1 + 1e-300)))).over(w))))
    r = r.withColumn("_dd", 1 - F.col("_v") / F.max("_v").over(w))
    n, mean, vol = F.count("*"), F.avg("ret"), F.stddev_pop("ret")
    dd = F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret")))
    g = r.groupBy(by).agg(((F.max_by("_v", "date") - 1) / n * YEAR).alias("arr"), vol.alias("vol"), dd.alias("dd"), F.max("_dd").alias("mdd"), (mean * F.sqrt(n)).alias("_sr"), (mean * YEAR).alias("_m"))
    over = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return g.select(by, "arr", "vol", "dd", "mdd", over("_sr", "vol").alias("sr"), over("_m", "mdd").alias("cr"), over("_m", "dd").alias("sor"))


def validation_sharpe(rets: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, sharpe): twice the mean over the deviation; without any variance infinite for a gain, else 0."""
    g = rets.groupBy(by).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    return g.select(by, F.when(F.col("s") == 0, F.when(F.col("m") > 0, float("inf")).otherwise(0.0)).otherwise(2 * F.col("m") / F.col("s")).alias("sharpe"))


def turbulence_limits(risk_by_date: DataFrame, first: str, last: str, at: str, days: int = 63, compat: bool = False) -> DataFrame:
    """(limit, usual, recent): the turbulence over which to sell, from the in-sample dates [first, last) and the ``days`` dates up to ``at``.

    A market calmer than the in-sample 90 % quantile gets the largest in-sample value, another
    one that quantile; ``compat`` always gives the 99 % quantile. The tables are one row a date.
    """
    inside = risk_by_date.where((F.col("date") >= F.lit(first).cast("date")) & (F.col("date") < F.lit(last).cast("date")))
    q = inside.agg(F.percentile("turbulence", F.lit(0.9)).alias("usual"), F.max("turbulence").alias("most"), F.percentile("turbulence", F.lit(0.99)).alias("rare"))
    recent = risk_by_date.where(F.col("date") <= F.lit(at).cast("date")).orderBy(F.desc("date")).limit(days).agg(F.avg("turbulence").alias("recent"))
    limit = F.col("rare") if compat else F.when(F.col("recent") > F.col("usual"), F.col("usual")).otherwise(F.col("most"))
    return q.join(F.broadcast(recent)).select(limit.alias("limit"), "usual", "recent")


def reported_risk(rets: DataFrame, by: str = "symbol", rate: float = 0.03, least_volatility: float = 0.005) -> DataFrame:
    """Risk recomputed from a saved equity: Sharpe is null, with a status, where the volatility is next to none."""
    r = risk(rets, by, rate)
    defined = F.col("volatility") >= least_volatility
    return r.select(by, "n", "volatility", F.col("sharpe").alias("recomputed_sharpe"), F.when(defined, F.col("sharpe")).alias("reported_sharpe"), "sortino", F.when(defined, "defined").otherwise("near_zero_volatility").alias("sharpe_status"))


def cost_rollup(trades: DataFrame, by: tuple[str, ...] = ("win", "ticker"), external: str | None = None) -> DataFrame:
    """Sums of commission, slippage and external costs of each group, and of all three."""
    outside = F.coalesce(F.sum(external), F.lit(0.0)) if external else F.lit(0.0)
    g = trades.groupBy(*by).agg(F.coalesce(F.sum("commission"), F.lit(0.0)).alias("commission"), F.coalesce(F.sum("slippage_cost"), F.lit(0.0)).alias("slippage"), outside.alias("external"))
    return g.withColumn("total_cost", F.col("commission") + F.col("slippage") + F.col("external"))

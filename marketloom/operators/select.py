"""Universe selection: momentum, low volatility, seeded random, volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(scores: DataFrame, order: Column, k: int) -> DataFrame:
    """(symbol, score, rank) of the first k by ``order``, then symbol: each task keeps k, and only those are ranked."""
    best = scores.select("symbol", "score").orderBy(order, "symbol").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(order, "symbol")).cast("long"))


def momentum(bars: DataFrame, start: str, back: int = 100, skip: int = 21, k: int = 5) -> DataFrame:
    """close[-skip] / close[-back] - 1 on rows before ``start``; the best k, or none with fewer candidates."""
    r = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))
    ranked = bars.where(F.col("date") < F.lit(start).cast("date")).withColumn("r", r)
    score = ranked.groupBy("symbol").agg(F.max(F.when(F.col("r") == skip, F.col("close"))).alias("near"), F.max(F.when(F.col("r") == back, F.col("close"))).alias("far"))
    score = score.where("far IS NOT NULL AND far <> 0").select("symbol", (F.col("near") / F.col("far") - 1).alias("score"))
    best = top(score, F.desc("score"), k)
    return best.join(F.broadcast(best.agg(F.count("*").alias("n"))), F.col("n") >= k).drop("n")


def low_volatility(bars: DataFrame, start: str, lookback: int = 100, step: int = 5, k: int = 5) -> DataFrame:
    """The k least population deviations of overlapping ``step``-row log returns within the last rows."""
    r = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))
    held = bars.where(F.col("date") < F.lit(start).cast("date")).withColumn("r", r).where(F.col("r") <= lookback)
    ret = F.log(F.col("close") / F.lag("close", step).over(W.partitionBy("symbol").orderBy("date")))
    vol = held.withColumn("x", ret).groupBy("symbol").agg(F.stddev_pop("x").alias("score")).where("score > 0")
    return top(vol, F.asc("score"), k)


def top_volume(bars: DataFrame, start: str, k: int = 5) -> DataFrame:
    v = bars.where(F.col("date") < F.lit(start).cast("date")).groupBy("symbol").agg(F.avg("volume").alias("score"))
    return top(v, F.desc("score"), k)


def random_symbols(bars: DataFrame, k: int, seed: int = 0, least: int = 30, per_year: bool = False) -> DataFrame:
    """(symbol) of a seeded sample of k symbols with enough rows, none with fewer than k; (year, symbol) of each year's with ``per_year``.

    The sample is the k least hashes of seed (and year) and symbol, so every task keeps k of its symbols.
    """
    if per_year:
        rows = bars.groupBy(F.year("date").alias("year"), "symbol").count().where(F.col("count") >= least)
        ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("year").orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("year").cast("string"), "symbol")), "symbol"))).where(F.col("r") <= k)
        full = ranked.groupBy("year").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        return ranked.join(F.broadcast(full.select("year")), "year").select("year", "symbol")
    rows = bars.groupBy("symbol").count().where(F.col("count") >= least)
    best = rows.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), "symbol")), "symbol").limit(k).select("symbol")
    return best.join(F.broadcast(best.agg(F.count("*").alias("n"))), F.col("n") >= k).select("symbol")


def inverse_volatility(rets: DataFrame) -> DataFrame:
    """(symbol, vol, weight): weights in proportion to 1 / volatility; their sum is an aggregate of one row."""
    v = rets.groupBy("symbol").agg(F.stddev_samp("ret").alias("vol")).where("vol > 0")
    return v.join(F.broadcast(v.agg(F.sum(1 / F.col("vol")).alias("all")))).select("symbol", "vol", (1 / F.col("vol") / F.col("all")).alias("weight"))


def portfolio_risk(weights: DataFrame, vols: DataFrame, corr: DataFrame, means: DataFrame, rate: float = 0.0) -> DataFrame:
    """(ret, vol, sharpe, bucket) of a portfolio: (symbol, weight), (symbol, vol), (a, b, corr) of pairs, (symbol, mean).

    The variance is the double sum of w w s s corr over pairs of held symbols; bucket is low
    under 0.01, medium under 0.02, else high. The held symbols are what the caller selected.
    """
    held = weights.join(vols, "symbol").join(means, "symbol")
    own = held.agg(F.sum(F.col("weight") * F.col("mean")).alias("ret"), F.sum(F.pow(F.col("weight") * F.col("vol"), F.lit(2.0))).alias("own"))
    side = lambda n: held.select(F.col("symbol").alias(n), (F.col("weight") * F.col("vol")).alias(f"x_{n}"))
    cross = corr.join(side("a"), "a").join(side("b"), "b").agg(F.coalesce(F.sum(2 * F.col("x_a") * F.col("x_b") * F.col("corr")), F.lit(0.0)).alias("cross"))
    both = own.join(F.broadcast(cross)).withColumn("vol", F.sqrt(F.greatest(F.lit(0.0), F.col("own") + F.col("cross"))))
    bucket = F.when(F.col("vol") < 0.01, "low").when(F.col("vol") < 0.02, "medium").otherwise("high")
    return both.select("ret", "vol", F.when(F.col("vol") > 0, (F.col("ret") - rate) / F.col("vol")).otherwise(0.0).alias("sharpe"), bucket.alias("bucket"))


def fixed(spark, symbols: list[str]) -> DataFrame:
    """(symbol) of a stated list, in its order."""
    return spark.createDataFrame([(s,) for s in dict.fromkeys(symbols)], "symbol string")


def diversified(sharpe: DataFrame, corr: DataFrame, k: int, sentiment: DataFrame | None = None, most: float = 0.7) -> DataFrame:
    """(symbol, score, rank): the k best by Sharpe x (1 - mean correlation), plus or less 0.2 by sentiment.

    ``sharpe`` is (symbol, sharpe), ``corr`` (a, b, corr) of pairs, ``sentiment`` (symbol,
    sentiment). A symbol's mean correlation includes its own, 1. If the chosen ones'
    mean (with the diagonal) is over ``most``, they are chosen again: the best Sharpe first,
    then, one by one, the symbol with the least mean correlation to those already in; each of
    these k steps is an aggregation over the pairs that touch the chosen ones.
    """
    both = corr.select("a", "b", "corr").union(corr.select("b", "a", "corr"))
    mean = both.groupBy("a").agg(F.sum("corr").alias("_s"), F.count("corr").alias("_n")).select(F.col("a").alias("symbol"), ((F.col("_s") + 1) / (F.col("_n") + 1)).alias("_mean"))
    scored = sharpe.join(mean, "symbol").withColumn("score", F.coalesce("sharpe", F.lit(0.0)) * (1 - F.col("_mean")))
    if sentiment is not None:
        tilt = F.when(F.col("sentiment") == "POSITIVE", 0.2).when(F.col("sentiment") == "NEGATIVE", -0.2).otherwise(0.0)
        scored = scored.join(sentiment, "symbol", "left").withColumn("score", F.col("score") + F.coalesce(tilt, F.lit(0.0)))
    chosen = [r["symbol"] for r in top(scored, F.desc("score"), k).orderBy("rank").collect()]
    inside = both.where(F.col("a").isin(chosen) & F.col("b").isin(chosen)).agg(F.sum("corr").alias("s")).first()["s"] or 0.0
    if len(chosen) == k and (inside + k) / (k * k) > most:
        best = sharpe.where("sharpe IS NOT NULL").orderBy(F.desc("sharpe"), "symbol").first()
        chosen = [best["symbol"]]
        while len(chosen) < k:
            rest = both.where(F.col("b").isin(chosen) & ~F.col("a").isin(chosen)).groupBy("a").agg(F.avg("corr").alias("m")).orderBy("m", "a").first()
            if rest is None:
                break
            chosen.append(rest["a"])
    order = F.array_position(F.array(*map(F.lit, chosen)), F.col("symbol")) if chosen else F.lit(0)
    return scored.where(F.col("symbol").isin(chosen)).select("symbol", "score", order.cast("long").alias("rank"))

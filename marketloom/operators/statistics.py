"""Tests and comparisons of paths: signed ranks, turbulence, episodes, log rewards, summaries, job status."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pairs(rets: DataFrame, by: str = "symbol", value: str = "ret", chosen: DataFrame | None = None) -> DataFrame:
    """(a, b, date, x, y) on common dates of the ``chosen`` pairs (a, b) of groups, or of all.

    All pairs are as many as the square of the groups, for each date: for strategies or
    portfolios, of which there are tens. For thousands of groups give the pairs to test.
    """
    r = rets.where(F.col(value).isNotNull())
    left = r.select("date", F.col(by).alias("a"), F.col(value).alias("x"))
    if chosen is not None:
        return chosen.select("a", "b").distinct().join(left, "a").join(r.select("date", F.col(by).alias("b"), F.col(value).alias("y")), ["date", "b"]).select("date", "a", "x", "b", "y")
    return left.join(r.select("date", F.col(by).alias("b"), F.col(value).alias("y")), "date").where("a < b")


#: Most differences for which the signed ranks' distribution is summed exactly: its counts fit a double.
EXACT = 50


def normal_tails(z) -> Column:
    """The chance of a standard normal value at least as far from 0 as ``z``: its series near 0, its continued fraction beyond."""
    z = F.abs(z)
    density = F.exp(-z * z / 2) / float(np.sqrt(2 * np.pi))
    step = lambda a, k: F.struct((a["t"] * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * k + 1)).alias("s"))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(z.alias("t"), z.alias("s")), step)["s"]
    far = F.aggregate(F.sequence(F.lit(200), F.lit(1)), z, lambda f, k: z + k / f)
    return F.when(z < 1, 1 - 2 * density * near).otherwise(2 * density / far)


def rank_sum_tails(n, w) -> Column:
    """The chance that the smaller of the two sums of ``n`` signed ranks without ties is at most ``w``: subsets of 1 to n counted by their sum, one rank after the other."""
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    one = lambda c, k: F.zip_with(F.concat(c, zeros(k)), F.concat(zeros(k), c), lambda x, y: x + y)
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), one)
    upto = F.aggregate(F.slice(counts, F.lit(1), (w + 1).cast("int")), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), 2 * upto / F.pow(F.lit(2.0), n))


def signed_rank(paired: DataFrame, by: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Signed-rank test of x - y for each group: (by..., n, zeros, w_plus, w_minus, statistic, z, p, method).

    Zero differences are left out of n, ties share their mean rank and reduce the variance.
    The statistic is the smaller rank sum and p two-sided: exact for at most ``EXACT``
    differences without ties or zeros, else by the normal tail without correction. Rows with a
    null are left out; a group of zeros only has no p. Equal sizes of a group meet before its
    ranks do, so a group's window holds one row a size.
    """
    by = list(by)
    d = paired.withColumn("d", F.col("x") - F.col("y")).where("d IS NOT NULL").groupBy(*by, F.abs("d").alias("size")).agg(F.count("*").alias("all"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    d = d.withColumn("k", F.when(F.col("size") > 0, F.col("all")).otherwise(F.lit(0)))
    before = F.sum("k").over(W.partitionBy(*by).orderBy("size").rowsBetween(W.unboundedPreceding, 0)) - F.col("k")
    ranked = d.withColumn("rank", before + (F.col("k") + 1) / 2)
    sums = ranked.groupBy(*by).agg(
        F.sum("k").alias("n"), F.sum(F.col("all") - F.col("k")).alias("zeros"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"),
        F.sum(F.col("rank") * F.when(F.col("k") > 0, F.col("k") - F.col("up")).otherwise(0)).alias("w_minus"), F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")).alias("ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    out = sums.withColumn("statistic", F.least("w_plus", "w_minus")).withColumn("z", F.when(n > 0, (F.col("w_plus") - n * (n + 1) / 4) / spread))
    exact = (F.col("n") <= EXACT) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    out = out.withColumn("method", F.when(n == 0, "none").when(exact, "exact").otherwise("normal"))
    p = F.when(F.col("method") == "exact", rank_sum_tails(F.col("n"), F.col("statistic"))).when(F.col("method") == "normal", normal_tails(F.col("z")))
    return out.select(*by, "n", "zeros", "w_plus", "w_minus", "statistic", "z", p.alias("p"), "method")


def wilcoxon(paired: DataFrame) -> DataFrame:
    """n, rank sums and z of ``signed_rank`` for each (a, b)."""
    return signed_rank(paired).where("n > 0").select("a", "b", "n", "w_plus", "w_minus", "z")


def episode_overlap(episodes: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(a, b, steps, overlap): share of positions at which two episodes (episode, pos, action) act alike, of the ``chosen`` pairs or of all (tens of episodes)."""
    left, right = episodes.select(F.col("episode").alias("a"), "pos", F.col("action").alias("x")), episodes.select(F.col("episode").alias("b"), "pos", F.col("action").alias("y"))
    both = left.join(right, "pos").where("a < b") if chosen is None else chosen.select("a", "b").distinct().join(left, "a").join(right, ["b", "pos"])
    return both.groupBy("a", "b").agg(F.count("*").alias("steps"), F.avg((F.col("x") == F.col("y")).cast("int")).alias("overlap"))


def log_rewards(actions: DataFrame, by: str = "symbol") -> DataFrame:
    """Rewards action * ln(next close / close) of each group: sum, sample deviation, compounded and largest loss of the running sum."""
    w = W.partitionBy(by).orderBy("date")
    r = actions.select(by, "date", (F.col("action") * F.log(F.lead("close").over(w) / F.col("close"))).alias("r")).where("r IS NOT NULL")
    r = r.withColumn("total", F.sum("r").over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = r.withColumn("fall", F.max("total").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("total"))
    return r.groupBy(by).agg(F.count("*").alias("n"), F.sum("r").alias("reward"), F.stddev_samp("r").alias("std"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("compounded"), F.max("fall").alias("max_fall"))


def last_items(items: DataFrame, by: list[str], order: str, text: str = "text", last: int = 3, preview: int = 100, most: int = 500) -> DataFrame:
    """The last items of each group as previews, newest first, joined by `` | `` and cut at ``most`` characters."""
    kept = items.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= last)
    line = F.struct("_r", F.substring(F.coalesce(F.col(text), F.lit("")), 1, preview).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), " | ")
    return kept.groupBy(*by).agg(F.count("*").alias("items"), F.substring(joined, 1, most).alias("summary"))


def inventory(grid: DataFrame, results: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Every job of the grid with the results it has: complete, partial or missing."""
    have = results.groupBy(*keys).agg(F.count("*").alias("have"))
    out = grid.join(have, keys, "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("have") >= expected, "complete").when(F.col("have") > 0, "partial").otherwise("missing"))


def sliding_distances(v: np.ndarray, at: np.ndarray, history: int) -> np.ndarray:
    """The Mahalanobis distance of each row ``at`` (ascending, running) of ``v`` from the ``history`` rows before it.

    The inverse of the scatter matrix about a fixed centre follows the window: a row that
    comes, a row that goes and the two means are a change of rank four. Each distance is held
    against the matrix it should invert; where it misses, as on singular matrices, that date's
    pseudo-inverse is taken and the following begins anew.
    """
    centre = v.mean(axis=0)
    x = v - centre
    out = np.zeros(len(at))
    inverse = None
    for n, k in enumerate(at):
        if inverse is None or k != at[n - 1] + 1:
            window = x[k - history : k]
            total, square = window.sum(axis=0), window.T @ window
            inverse = _inverse(square - np.outer(total, total) / history)
        else:
            came, went, before = x[k - 1], x[k - 1 - history], total
            total = total + came - went
            square += np.outer(came, came) - np.outer(went, went)
            if inverse is not None:
                u = np.stack([came, went, before, total], 1)
                side = inverse @ u
                inner = np.diag([1.0, -1.0, history, -history]) + u.T @ side
                try:
                    inverse = inverse - side @ np.linalg.solve(inner, side.T)
                except np.linalg.LinAlgError:
                    inverse = None
        scatter = square - np.outer(total, total) / history
        d = x[k] - total / history
        solved = inverse @ d if inverse is not None else None
        if solved is None or not np.allclose(scatter @ solved, d, rtol=1e-9, atol=1e-11 * max(1e-300, np.abs(d).max())):
            window = x[k - history : k]
            total, square = window.sum(axis=0), window.T @ window
            inverse = _inverse(square - np.outer(total, total) / history)
            d = x[k] - total / history
            solved = inverse @ d if inverse is not None else np.linalg.pinv(np.atleast_2d(np.cov(window, rowvar=False))) @ d / (history - 1)
        out[n] = (history - 1) * float(d @ solved)
    return out


def _inverse(scatter: np.ndarray) -> np.ndarray | None:
    """The inverse of a scatter matrix, or None where it is singular to working precision."""
    size = np.linalg.eigvalsh(scatter)
    return np.linalg.inv(scatter) if size[-1] > 0 and size[0] > 1e-11 * size[-1] else None


def turbulence(rets: DataFrame, history: int = 252, by: str = "symbol") -> DataFrame:
    """(date, turbulence): Mahalanobis distance of each date's returns from those of the ``history`` dates before.

    Only dates that every symbol has count; the first ``history`` + 2 are 0. Dates are dealt
    in blocks of ``history``, each with the block before it, so no task holds more than two.
    Within a block the window slides: a date costs the square of the number of symbols,
    whatever the history.
    """
    r = rets.where("ret IS NOT NULL")
    wide = r.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(by, "ret"))).alias("v"))
    wide = wide.join(F.broadcast(r.agg(F.countDistinct(by).alias("width"))), F.size("v") == F.col("width"))
    # one row a date: the calendar, not the prices, passes through this window
    wide = wide.select("date", F.transform("v", lambda x: x["ret"]).alias("v"), (F.row_number().over(W.orderBy("date")) - 1).alias("i"))
    own = F.floor(F.col("i") / history)
    dealt = wide.withColumn("block", F.explode(F.array(own, own + 1)))

    def distances(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        v, at, block = np.stack(rows["v"].to_numpy()), rows["i"].to_numpy(), int(rows["block"].iloc[0])
        mine = np.flatnonzero((at // history == block) & (at >= history + 2))
        found = np.zeros(len(v))
        if len(mine):
            found[mine] = sliding_distances(v, mine, history)
        return pd.DataFrame([(rows["date"].iloc[k], float(found[k])) for k in np.flatnonzero(at // history == block)], columns=["date", "turbulence"])

    return dealt.groupBy("block").applyInPandas(distances, "date date, turbulence double")


def compare_episodes(episodes: DataFrame) -> DataFrame:
    """(episode, steps, total, mean, best, worst, length_rank) of episodes (episode, pos, reward): what a comparison of them lists."""
    g = episodes.groupBy("episode").agg(F.count("*").alias("steps"), F.sum("reward").alias("total"), F.avg("reward").alias("mean"), F.max("reward").alias("best"), F.min("reward").alias("worst"))
    return g.withColumn("rank", F.rank().over(W.orderBy(F.desc("total"))).cast("long"))  # one row an episode

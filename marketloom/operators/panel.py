"""Panel preparation: warm-up, splits, presence rules, joins of series, reshaping, roll-ups.

Tables are long, a row a symbol and date. Numbering of dates runs over the calendar (one row a
date), never over the panel.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _day(x) -> Column:
    return F.lit(x).cast("date")


def with_warmup(df: DataFrame, start, end, add: Callable[[DataFrame], DataFrame], days: int = 60) -> DataFrame:
    """Rows of [start, end) with what ``add`` computes over ``days`` calendar days more before them.

    The inner filter reaches the scan; the outer one stays above the windows of ``add``.
    """
    held = df.where((F.col("date") >= F.date_sub(_day(start), days)) & (F.col("date") < _day(end)))
    return add(held).where(F.col("date") >= _day(start))


def numbered_days(df: DataFrame, name: str = "day") -> DataFrame:
    """``df`` with the number of each row's date among the table's dates, from 0."""
    calendar = df.select("date").distinct().withColumn(name, (F.row_number().over(W.orderBy("date")) - 1).cast("long"))
    return df.join(calendar, "date")


def split(df: DataFrame, start, end) -> DataFrame:
    """Rows of [start, end) with their day's number."""
    return numbered_days(df.where((F.col("date") >= _day(start)) & (F.col("date") < _day(end))))


def train_trade(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Each row once for every window (win, train_lo, train_hi, trade_hi) it lies in, with its part: train or trade. The windows are a handful of rows."""
    inside = (F.col("date") >= F.col("train_lo")) & (F.col("date") < F.col("trade_hi"))
    part = F.when(F.col("date") < F.col("train_hi"), "train").otherwise("trade")
    return df.join(F.broadcast(windows), inside).withColumn("part", part).drop("train_lo", "train_hi", "trade_hi")


def within_hours(ticks: DataFrame, first: str = "09:30", last: str = "15:59") -> DataFrame:
    return ticks.where(F.date_format("ts", "HH:mm").between(first, last))


def without_close(ticks: DataFrame, at: str = "16:00:00") -> DataFrame:
    """Ticks but those stamped with the closing second."""
    return ticks.where(F.date_format("ts", "HH:mm:ss") != at)


def complete_times(df: DataFrame, by: str = "symbol", at: str = "date") -> DataFrame:
    """Rows of times at which every symbol of the table is present."""
    every = df.agg(F.count_distinct(by).alias("_all"))  # one row
    counts = df.groupBy(at).agg(F.count_distinct(by).alias("_n")).join(F.broadcast(every)).where("_n = _all")
    return df.join(counts.select(at), at, "left_semi")


def mostly_present(df: DataFrame, share: float = 0.9, by: str = "symbol", at: str = "date") -> DataFrame:
    """Symbols on more than ``share`` of the days, then days on which all of those are present, numbered anew."""
    days = df.agg(F.count_distinct(at).alias("_days"))
    often = df.groupBy(by).agg(F.count_distinct(at).alias("_n")).join(F.broadcast(days)).where(F.col("_n") > share * F.col("_days"))
    kept = df.join(often.select(by), by, "left_semi")
    return numbered_days(complete_times(kept, by, at))


def enough_history(df: DataFrame, start, years: int) -> DataFrame:
    """Rows of symbols whose first year is at least ``years`` before that of ``start``."""
    first = df.groupBy("symbol").agg(F.min("date").alias("_first")).where(F.year("_first") <= F.year(_day(start)) - years)
    return df.join(first.select("symbol"), "symbol", "left_semi")


def clean_universe(flags: DataFrame, year: int, training: int = 3, most: int = 30) -> DataFrame:
    """(symbol) of validation flags with at most ``most`` dirty rows and a row in ``year`` - ``training``."""
    g = flags.groupBy("symbol").agg(F.count_if("dirty").alias("_dirty"), F.max((F.year("date") == year - training).cast("int")).alias("_there"))
    return g.where((F.col("_dirty") <= most) & (F.col("_there") == 1)).select("symbol")


def universe_by_year(flags: DataFrame, training: int = 3, most: int = 30) -> DataFrame:
    """(year, symbol): ``clean_universe`` of every year that has one."""
    dirty = flags.groupBy("symbol").agg(F.count_if("dirty").alias("_dirty")).where(F.col("_dirty") <= most).select("symbol")
    return flags.select((F.year("date") + training).alias("year"), "symbol").distinct().join(dirty, "symbol", "left_semi")


def repeated(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that stand in several rows, and how many; empty if the table is consistent."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def wrong_counts(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """(by, n, expected) of groups whose number of rows isn't the expected one; missing groups have 0."""
    g = df.groupBy(by).agg(F.count("*").alias("n"))
    return expected.join(g, by, "left").select(by, F.coalesce("n", F.lit(0).cast("long")).alias("n"), "expected").where("n <> expected")


def unaligned(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def with_factors(prices: DataFrame, factors: DataFrame, columns: tuple[str, ...], percent: bool = True) -> DataFrame:
    """Prices with a day's factors (a row a date, from percent to shares), each filled forward within the symbol."""
    scaled = factors.select("date", *[(F.col(c) / 100 if percent else F.col(c)).alias(c) for c in columns])
    w = W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return prices.join(scaled, "date", "left").withColumns({c: F.last(c, True).over(w) for c in columns})


def with_day_series(df: DataFrame, series: DataFrame) -> DataFrame:
    """Rows of dates that the series (a row a date) has, with its columns."""
    return df.join(series, "date")


def with_series(times: DataFrame, series: dict[str, DataFrame], at: str = "date") -> DataFrame:
    """Times with every named series (at, value) joined on, filled forward and then backward; the times are a calendar."""
    out = reduce(lambda d, x: d.join(x[1].select(at, F.col("value").alias(x[0])), at, "left"), series.items(), times)
    before, after = W.orderBy(at).rowsBetween(W.unboundedPreceding, 0), W.orderBy(at).rowsBetween(0, W.unboundedFollowing)
    return out.select(at, *[F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after)).alias(c) for c in series])


def side_by_side(equities: dict[str, DataFrame]) -> DataFrame:
    """(date, a column a strategy) of equities (date, equity), dates on which all have one."""
    first, *rest = equities.items()
    start = first[1].select("date", F.col("equity").alias(first[0]))
    return reduce(lambda d, x: d.join(x[1].select("date", F.col("equity").alias(x[0])), "date", "left"), rest, start).na.drop("any")


def nearest_date(calendar: DataFrame, day) -> DataFrame:
    """(date) of the calendar next to ``day``; of two the earlier."""
    return calendar.select("date").distinct().orderBy(F.abs(F.datediff("date", _day(day))), "date").limit(1)


def resample_grid(bars: DataFrame, every: str, by: str = "symbol") -> DataFrame:
    """Resampled bars with a row for every bin between each symbol's first and last; empty ones are null with volume 0."""
    ends = bars.groupBy(by).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    grid = ends.select(by, F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {every}"))).alias("ts"))
    return grid.join(bars, [by, "ts"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def group_values(df: DataFrame, by: tuple[str, ...], means: tuple[str, ...] = (), sums: tuple[str, ...] = (), missing: float = 0.5) -> DataFrame:
    """Rows with their group's mean (``missing`` where it has none) or sum in place of the values; a large group is summed in parts before it meets its rows."""
    g = df.groupBy(*by).agg(*[F.coalesce(F.avg(c), F.lit(missing)).alias(f"_{c}") for c in means], *[F.sum(c).alias(f"_{c}") for c in sums])
    return df.join(g, list(by)).withColumns({c: F.col(f"_{c}") for c in (*means, *sums)}).drop(*[f"_{c}" for c in (*means, *sums)])


def first_of_each(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key in ``order``, as an aggregate (partial before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*df.columns)


def sector_weights(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    """(sector, weight) of (symbol, weight) and (symbol, sector); symbols without a sector are in Unknown."""
    return weights.join(sectors, "symbol", "left").groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum("weight").alias("weight"))


def all_symbols(windows: list[DataFrame]) -> DataFrame:
    """Symbols of any of the windows' tables, once."""
    return reduce(DataFrame.union, [w.select("symbol") for w in windows]).distinct()


def not_selected(available: DataFrame, selected: DataFrame) -> DataFrame:
    return available.select("symbol").distinct().exceptAll(selected.select("symbol").distinct())


def common_dates(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, [t.select("date") for t in tables])


def widen(df: DataFrame, symbols: list[str], value: str = "close") -> DataFrame:
    """(date, a column a symbol): the first value in order of the value; the symbols are stated, so no pass looks for them."""
    return df.groupBy("date").pivot("symbol", symbols).agg(F.min(value))


def lengthen(wide: DataFrame, value: str = "close") -> DataFrame:
    """(date, symbol, value) of a wide table, without its nulls."""
    return wide.unpivot("date", [c for c in wide.columns if c != "date"], "symbol", value).where(F.col(value).isNotNull())


def sample_news(news: DataFrame, k: int = 20, seed: int = 0, keys: tuple[str, ...] = ("item_index",)) -> DataFrame:
    """k rows by the least hash of the seed and their keys: a sample that reruns agree on, of which every task keeps k."""
    return news.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])), *keys).limit(k)


def canonical(df: DataFrame, last: str | None = None) -> DataFrame:
    """In order of date, symbol and, for news and filings, their number."""
    return df.orderBy("date", "symbol", *([last] if last else []))


def variation(df: DataFrame, columns: tuple[str, ...], by: str = "symbol", k: int = 1, against: str = "previous") -> DataFrame:
    """Columns over their value k rows before (``previous``), their first (``first``), or another column; 1 where there is none."""
    w = W.partitionBy(by).orderBy("date")
    base = {"previous": lambda c: F.lag(c, k).over(w), "first": lambda c: F.first(c).over(w)}.get(against, lambda c: F.col(against))
    return df.withColumns({c: F.coalesce(F.col(c) / base(c), F.lit(1.0)) for c in columns})


#: Quarterly columns that the ratios take: operating income, revenue, net income, cost of goods.
def fundamentals(q: DataFrame, back: int = 3) -> DataFrame:
    """Ratios of quarterly statements (symbol, date, ...): margins and returns over the ``back`` quarters before, liquidity, turnovers, debt, items a share.

    A symbol's first ``back`` quarters have no trailing ratios. Missing and infinite ones are 0.
    """
    w = W.partitionBy("symbol").orderBy("date")
    enough = F.row_number().over(w) > back
    past = lambda c: F.when(enough, F.sum(c).over(w.rowsBetween(-back, -1)))
    over = lambda a, b: F.when(b != 0, a / b)
    c = F.col
    out = {
        "opm": over(past("op_inc"), past("rev")), "npm": over(past("net_inc"), past("rev")), "roa": over(past("net_inc"), c("assets")), "roe": over(past("net_inc"), c("equity")),
        "eps": c("eps_incl_ex"), "bps": over(c("common_equity"), c("shares")), "dps": c("dividend"),
        "cur_ratio": over(c("cur_assets"), c("cur_liabilities")), "quick_ratio": over(c("cash_eq") + c("receivables"), c("cur_liabilities")), "cash_ratio": over(c("cash_eq"), c("cur_liabilities")),
        "inv_turnover": over(past("cogs"), c("inventories")), "acc_rec_turnover": over(past("rev"), c("receivables")), "acc_pay_turnover": over(past("cogs"), c("payables")),
        "debt_ratio": over(c("liabilities"), c("assets")), "debt_to_equity": over(c("liabilities"), c("equity")),
    }
    return q.select("symbol", "date", *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in out.items()])


def valuations(prices: DataFrame, ratios: DataFrame) -> DataFrame:
    """Daily pe, pb and div_yield: a day takes the ratios of its symbol's last quarter up to it."""
    q = ratios.select("symbol", "date", "eps", "bps", "dps", F.lit(1).alias("_q"))
    both = prices.select("symbol", "date", "close").withColumn("_q", F.lit(0)).unionByName(q, allowMissingColumns=True)
    w = W.partitionBy("symbol").orderBy("date", F.desc("_q")).rowsBetween(W.unboundedPreceding, 0)
    held = both.withColumns({c: F.last(c, True).over(w) for c in ("eps", "bps", "dps")}).where("_q = 0")
    over = lambda a, b: F.coalesce(F.when(b != 0, a / b), F.lit(0.0))
    return held.select("symbol", "date", over(F.col("close"), F.col("eps")).alias("pe"), over(F.col("close"), F.col("bps")).alias("pb"), over(F.col("dps"), F.col("close")).alias("div_yield"))


def keep_within_budget(texts: DataFrame, by: tuple[str, ...], order: str, text: str = "text", budget: int = 320) -> DataFrame:
    """Texts of each group in order while their words are at most ``budget``; the first beyond it is cut there, later ones are left out.

    Tokens are words at single spaces.
    """
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), " "), lambda x: x != "")
    df = texts.withColumn("_w", words).withColumn("_n", F.size("_w")).withColumn("_upto", F.sum("_n").over(w))
    room = F.lit(budget) - (F.col("_upto") - F.col("_n"))
    kept = df.withColumn("_room", room).where((F.col("_upto") <= budget) | (F.col("_room") > 0))
    cut = F.when(F.col("_upto") <= budget, F.col(text)).otherwise(F.array_join(F.slice("_w", 1, F.greatest(F.col("_room"), F.lit(1)).cast("int")), " "))
    return kept.withColumns({text: cut, "tokens": F.least("_n", "_room").cast("long")}).drop("_w", "_n", "_upto", "_room")


def drop_similar(news: DataFrame, column: str, limit: float, by: tuple[str, ...], order: str) -> DataFrame:
    """Rows without those whose text is more like the row before it (in order, dropped or not) than ``limit``.

    Likeness is that of insertions and deletions, 2 x longest common subsequence / both lengths.
    """
    from ..functions.scalars import likeness

    w = W.partitionBy(*by).orderBy(order)
    df = news.withColumn("_before", F.lag(F.coalesce(F.col(column), F.lit("None"))).over(w))
    same = likeness(F.coalesce(F.col(column), F.lit("None")), F.col("_before"))
    return df.withColumn("_like", F.when(F.col("_before").isNotNull(), same)).where(F.col("_like").isNull() | (F.col("_like") <= limit)).drop("_before", "_like")

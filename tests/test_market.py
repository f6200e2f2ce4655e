import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import scalars as X
from marketloom.operators import metrics as M
from marketloom.operators import relational as R
from marketloom.operators import simulate as B
from marketloom.operators import statistics
from marketloom.sources import market as S
from marketloom.streaming.bars import tick_bars


def bars(n=22, volume=1000.0):
    return [{"date": dt.date(2024, 1, 2) + dt.timedelta(i), "adjusted_open": 10.0 + i, "adjusted_close": 10.5 + i, "volume": volume} for i in range(n)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_commission(spark):
    r = one(spark, X.commission(F.lit(10), F.lit(100.0)), X.commission(F.lit(100), F.lit(10.0), 1.0, 0.0, 0.01), X.commission(F.lit(0), F.lit(10.0)))
    assert tuple(r) == (0.99, 10.0, 0.0)


def test_slippage(spark):
    r = one(spark, *[X.fill_price(F.lit(100.0), F.lit(100), F.lit(10000.0), F.lit(s), 0.001, 0.1) for s in ("buy", "sell")])
    assert r[0] == pytest.approx(100.101) and r[1] == pytest.approx(99.899)


def test_token_cost(spark):
    r = one(spark, X.token_cost(F.lit("x/gpt-4o-mini"), F.lit(1000), F.lit(500)), X.token_cost(F.lit("gpt-4o"), F.lit(1000), F.lit(100)))
    assert r[0] == pytest.approx(0.00045) and r[1] == pytest.approx(0.0035)


def test_adjustment(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 2), 50.0, 110.0, 40.0, 100.0, 200.0, 1000.0), ("B", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 0.0, 2.0, 1.0)], "symbol string, date date, open double, high double, low double, close double, adjusted_close double, volume double")
    got = {r["symbol"]: (r["adjusted_open"], r["adjusted_high"], r["adjusted_low"]) for r in R.adjust(df).collect()}
    assert got == {"A": (100.0, 220.0, 80.0), "B": (0.0, 0.0, 0.0)}


def at(day, f):
    return lambda acc: f(acc) if acc.at == day else None


def test_same_close_and_next_open():
    assert B.run_ticker("A", bars(), at(0, lambda a: a.buy(1)), B.TradeConfig()).trades[0][6] == 10.5
    acc = B.run_ticker("A", bars(), at(0, lambda a: a.buy(1)), B.TradeConfig(timing="next_open"))
    assert acc.trades[0][0] == dt.date(2024, 1, 3) and acc.trades[0][6] == 11.0


def test_liquidity():
    c = B.TradeConfig(liquidity_pct=0.1, liquidity_days=5, cash=1e6)
    t = B.run_ticker("A", bars(), at(10, lambda a: a.buy(1000)), c).trades[0]
    assert t[4] == 100 and t[9] == pytest.approx(0.1)
    acc = B.run_ticker("A", bars(), at(0, lambda a: a.buy(10)), B.TradeConfig(liquidity_pct=0.1))
    assert acc.rejected[0][6] == "insufficient_liquidity_history"


def test_liquidation_costs_and_external():
    c = B.TradeConfig(min_commission=1.0, max_commission_rate=1.0)
    acc = B.run_ticker("A", bars(), at(0, lambda a: a.buy(1)), c)
    assert sum(t[7] for t in acc.trades) == 2.0 and acc.equity[-1][1] == acc.cash
    assert B.run_ticker("A", bars(), at(0, lambda a: a.charge(2.5)), B.TradeConfig(cash=10_000)).equity[0][1] == 9997.5


def test_no_future_bar():
    acc = B.run_ticker("A", bars(5), at(4, lambda a: a.buy(1)), B.TradeConfig(timing="next_open"))
    assert acc.rejected[0][6] == "no_future_bar" and acc.rejected[0][5] is None


def test_cash_is_conserved():
    import random

    rng = random.Random(3)

    def any_order(acc):
        acc.buy(rng.randint(1, 50)) if rng.random() < 0.5 else acc.sell(rng.randint(1, 50))

    acc = B.run_ticker("A", bars(60), any_order, B.TradeConfig(cash=500, slippage_perc=0.01, slippage_impact=0.2))
    flow = sum((-1 if t[3] == "buy" else 1) * t[4] * t[6] - t[7] for t in acc.trades)
    assert acc.cash == pytest.approx(500 + flow) and acc.cash >= 0 and acc.shares == 0
    assert all(t[0] >= t[1] for t in acc.trades)


def test_hindsight():
    value, actions = B.hindsight([1, 2, 3, 4, 5, 6], 1000, 0.001)
    assert value == pytest.approx(5994.0, rel=1e-3) and actions[0] == "BUY" and set(actions[1:5]) == {"HOLD"}


def test_sortino(spark):
    rows = [("A", dt.date(2024, 1, 2) + dt.timedelta(i), 100 * 0.99**i, None if i == 0 else -0.01, 0.99**i - 1) for i in range(7)]
    r = M.risk(spark.createDataFrame(rows, "symbol string, date date, equity double, ret double, dd double"), rate=0.0).first()
    assert r["sortino"] == pytest.approx(-math.sqrt(252)) and r["max_drawdown"] == pytest.approx((1 - 0.99**6) * 100)


def test_partitioned_source(spark, tmp_path):
    rows = [(dt.date(2023, 12, 29), "AAA", "1", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2023), (dt.date(2024, 1, 2), "AAA", "1", 50.0, 110.0, 40.0, 100.0, 200.0, 1000.0, 2024)]
    spark.createDataFrame(rows, S.PRICE).write.partitionBy("year").parquet(f"{tmp_path}/price_daily")
    m = S.open_market_data(spark, str(tmp_path), modalities=("price",)).subset("2024-01-01", "2024-12-31", ["AAA"])
    assert m.price.count() == 1 and "PartitionFilters: [isnotnull(year" in m.price._jdf.queryExecution().toString()


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
    ev.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")
    q = tick_bars(s, "1 hour").writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(spark.table("bars_out")) == order(tick_bars(ev, "1 hour"))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_turbulence(spark):
    import numpy as np

    from marketloom.operators import statistics

    rng = np.random.default_rng(3)
    v = rng.normal(size=(35, 3))
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(35)]
    rows = [(s, day, float(v[i, k])) for i, day in enumerate(days) for k, s in enumerate("abc")]
    rows += [("a", dt.date(2023, 1, 1), 1.0), ("b", days[0] - dt.timedelta(1), None)]  # a date that one symbol has alone
    got = dict(map(tuple, statistics.turbulence(spark.createDataFrame(rows, "symbol string, date date, ret double"), history=8).collect()))
    want = {}
    for i, day in enumerate(days):
        past = v[i - 8 : i]
        diff = v[i] - past.mean(axis=0) if i >= 8 else None
        want[day] = 0.0 if i < 10 else float(diff @ np.linalg.pinv(np.cov(past.T)) @ diff)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_wilcoxon_ties(spark):
    from marketloom.operators import statistics

    rows = [("p", "q", float(x), 0.0) for x in (1, -1, 2, 3, 0, -4)]
    r = statistics.wilcoxon(spark.createDataFrame(rows, "a string, b string, x double, y double")).first()
    assert (r.n, r.w_plus, r.w_minus) == (5, 8.5, 6.5)


def test_trading_env(spark):
    acts = [(10.0, 1.0), (20.0, -0.5), (20.0, None), (5.0, -1.0), (5.0, -1.0)]
    rows = [("w", "t", dt.date(2024, 1, 1 + i), p, a) for i, (p, a) in enumerate(acts)]
    bars = spark.createDataFrame(rows, "win string, ticker string, date date, price double, action double")
    got = [tuple(r) for r in B.trading_env(bars, initial=101.0, cost=0.01).orderBy("date").select("traded", "held", "cash", "value").collect()]
    want = [(10, 10, 0.0, 100.0), (-5, 5, 99.0, 199.0), (0, 5, 99.0, 199.0), (-5, 0, 123.75, 123.75), (0, 0, 123.75, 123.75)]
    assert [tuple(round(x, 9) for x in r) for r in got] == want
    assert B.trading_env(bars.limit(0)).count() == 0


#: Differences with their statistic and exact two-sided p, as published for this test.
SIGNED = [
    ([6, 8, 14, 16, 23, 24, 28, 29, 41, -48, 49, 56, 60, -67, 75], 24.0, 0.041259765625),
    ([1], 0.0, 1.0), ([1, 2, 3, 4, 5], 0.0, 0.0625), ([-1, -2, -3, -4, -5, -6], 0.0, 0.03125), ([1, -2, 3, -4, 5, 6, 7, 8, 9, 10], 6.0, 0.02734375), ([1, -2, 3], 2.0, 0.75),
]


def test_signed_ranks_are_exact(spark):
    rows = [(str(i), "b", float(x), 0.0) for i, (d, *_) in enumerate(SIGNED) for x in d] + [("ties", "b", x, 0.0) for x in (1.0, 1.0, -2.0, 3.0)] + [("zero", "b", 2.0, 2.0)] * 2 + [("some", "b", x, 0.0) for x in (0.0, 1.0, 2.0)]
    rows += [("long", "b", float(i if i % 3 else -i), 0.0) for i in range(1, 61)] + [("null", "b", None, 1.0), ("fifty", "b", 0.0, 0.0)][:1]
    got = {r.a: r for r in statistics.signed_rank(spark.createDataFrame(rows, "a string, b string, x double, y double")).collect()}
    for i, (_, w, p) in enumerate(SIGNED):
        assert got[str(i)].method == "exact" and got[str(i)].statistic == w and got[str(i)].p == pytest.approx(p, abs=1e-15)
    assert got["ties"].method == "normal" and got["some"].method == "normal" and got["some"].zeros == 1 and got["long"].method == "normal"
    assert (got["zero"].n, got["zero"].zeros, got["zero"].p, got["zero"].method) == (0, 2, None, "none") and "null" not in got
    # the normal tail against the error function, near and far
    zs = [0.0, 1e-9, 0.3, 0.999999, 1.0, 1.5, 2.0, 3.3, 6.0, 9.0, -2.5]
    tails = spark.createDataFrame([(z,) for z in zs], "z double").select("z", statistics.normal_tails(F.col("z")).alias("p")).collect()
    for r in tails:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-12)


def test_exact_tails_by_listing(spark):
    for n in (1, 4, 7, 11):
        sums = Counter(sum(i + 1 for i in range(n) if m >> i & 1) for m in range(1 << n))
        got = spark.range(n * (n + 1) // 4 + 1).select("id", statistics.rank_sum_tails(F.lit(n), F.col("id")).alias("p")).collect()
        for r in got:
            assert r.p == pytest.approx(min(1, 2 * sum(c for s, c in sums.items() if s <= r.id) / (1 << n)), abs=1e-15)


@pytest.mark.parametrize("symbols,history", [(1, 20), (5, 40), (12, 30), (12, 10)])
def test_sliding_distances_are_those_of_the_loop(symbols, history):
    """Also where the matrix is singular (fewer days than symbols) or nearly so, and after a jump of the level."""
    rng = np.random.default_rng(symbols)
    v = rng.normal(size=(6 * history, symbols)) * rng.uniform(0.001, 0.1, symbols)
    v[3 * history :] += 0.5
    if symbols > 4:
        v[history : 2 * history, 1] = v[history : 2 * history, 0] * 2
        v[:, 3] = v[:, 2] + 1e-4 * rng.normal(size=len(v))
    at = np.arange(history + 2, len(v))
    got = statistics.sliding_distances(v, at, history)
    for k, x in zip(at, got):
        past = v[k - history : k]
        d = v[k] - past.mean(axis=0)
        want = float(d @ np.linalg.pinv(np.atleast_2d(np.cov(past, rowvar=False))) @ d)
        assert x == pytest.approx(want, rel=1e-6 if symbols > 4 else 1e-8, abs=1e-8)


def test_sliding_costs_no_history():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 8))
    calls, plain = [], statistics._inverse
    statistics._inverse = lambda m: calls.append(1) or plain(m)
    try:
        statistics.sliding_distances(v, np.arange(1000, 3000), 900)
    finally:
        statistics._inverse = plain
    assert len(calls) < 20  # 2,000 dates, few of them from the start

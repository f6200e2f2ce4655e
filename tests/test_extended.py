"""Simulations, environments, memory, sections, jobs, sources and sinks against plain loops and hand-worked cases."""

import datetime as dt
import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import scalars as X
from marketloom.operators import broker as K
from marketloom.operators import environments as E
from marketloom.operators import extend as G
from marketloom.operators import indicators as I
from marketloom.operators import jobs as O
from marketloom.operators import memory as V
from marketloom.operators import panel as P
from marketloom.operators import sections as C
from marketloom.operators import simulate as B
from marketloom.sources import market as S
from marketloom.streaming import replay as Y

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


# ---- trading in hindsight


def test_hindsight_samples():
    value, actions = B.hindsight([1, 3, 6, 3, 5, 1], 1000, 0.001)
    assert value == pytest.approx(9960.055) and actions == ["BUY", "HOLD", "SELL", "BUY", "SELL", "HOLD"]
    value, actions = B.hindsight([6, 5, 4, 3, 2, 1], 1000, 0.001)
    assert value == 1000 and actions == ["HOLD"] * 6
    assert B.hindsight([], 1000, 0.001) == (0, [])
    assert B.hindsight([5], 1000, 0.001) == (1000, ["HOLD"])


def play(actions, prices, cash, fee):
    held = 0
    for a, p in zip(actions, prices):
        if a == "BUY":
            n = math.floor(cash / (p * (1 + fee)))
            held, cash = held + n, cash - n * p * (1 + fee)
        elif a == "SELL":
            held, cash = 0, cash + held * p * (1 - fee)
    return cash + held * prices[-1]


def test_hindsight_replays_and_counts_sales():
    rng = random.Random(3)
    for _ in range(40):
        prices = [rng.randint(1, 9) for _ in range(rng.randint(2, 9))]
        value, actions = B.hindsight(prices, 1000, 0.01)
        assert play(actions, prices, 1000, 0.01) == pytest.approx(value)
        last = 0.0
        for m in range(4):
            few, done = B.hindsight(prices, 1000, 0.01, m)
            assert play(done, prices, 1000, 0.01) == pytest.approx(few) and done.count("SELL") <= m and few >= last - 1e-9
            last = few


def bars(n=22, volume=1000.0):
    return [{"date": d, "adjusted_open": 10.0 + i, "adjusted_close": 10.5 + i, "volume": volume} for i, d in enumerate(days(n))]


def test_reasons_of_rejected_orders():
    at = lambda day, f: lambda acc: f(acc) if acc.at == day else None
    reason = lambda f, **c: B.run_ticker("A", bars(), at(3, f), B.TradeConfig(**c)).rejected[0][6]
    assert reason(lambda a: a.sell(5)) == "zero_quantity" and reason(lambda a: a.buy(), cash=5.0) == "zero_quantity"
    assert reason(lambda a: a.buy(3), cash=5.0) == "insufficient_cash"
    assert reason(lambda a: a.buy(3), liquidity_pct=0.1, min_history=4) == "insufficient_liquidity_history"
    assert B.run_ticker("A", bars(), at(4, lambda a: a.buy(3)), B.TradeConfig(liquidity_pct=0.1, min_history=4)).trades


def test_liquidity_cap(spark):
    q = lambda *a, **k: spark.range(1).select(X.liquidity_cap(*a, **k)).first()[0]
    assert q(F.lit(50), F.lit(100.0)) == 50 and q(F.lit(-50), F.lit(100.0), 0.1) == 10
    assert q(F.lit(50), F.lit(None).cast("double"), 0.1) == 50 and q(F.lit(50), F.lit(None).cast("double"), 0.1, True) == 0


# ---- environments


def test_stock_env_sells_before_it_buys():
    env = E.StockEnv(2, cash=100.0, buy_cost=0.0, sell_cost=0.0, most=10, scale=1.0)
    env.step(E.Day(np.array([10.0, 5.0]), np.array([1.0, 0.0])))
    assert env.held.tolist() == [10, 0] and env.cash == 0
    got = env.step(E.Day(np.array([20.0, 5.0]), np.array([-0.5, 1.0])))  # the sale pays for the purchase
    assert env.held.tolist() == [5, 10] and env.cash == 50 and got["reward"] == 100
    env.risk_limit = 1.0
    got = env.step(E.Day(np.array([20.0, 5.0]), np.array([1.0, 1.0]), turbulence=2.0))
    assert env.held.tolist() == [0, 0] and env.cash == 200 and got["note"] == "turbulence"


def test_cash_penalty_env():
    env = E.CashPenaltyEnv(2, cash=1000.0, buy_cost=0.0, sell_cost=0.0, most=100.0, increment=2, penalty=0.5, patient=True)
    got = env.step(E.Day(np.array([10.0, 0.0]), np.array([0.9, 1.0])))
    assert got["traded"] == [8.0, 0.0] and env.cash == 920 and got["reward"] == 0  # 9 shares round down to 8; no price, no order
    got = env.step(E.Day(np.array([12.0, 1.0]), np.array([-5.0, 0.0])))
    assert got["traded"] == [-8.0, 0.0] and env.cash == 1016  # no more than is held
    assert got["reward"] == pytest.approx(((1016 - max(0, 508 - 920)) / 1000 - 1) / 1)
    got = env.step(E.Day(np.array([12.0, 1.0]), np.array([100.0, 0.0])))
    assert got["note"] == "cash shortage" and env.cash == 1016 and not got["done"]
    assert E.CashPenaltyEnv(1, cash=10.0, most=1000.0).step(E.Day(np.array([10.0]), np.array([1.0])))["done"]


def test_stop_loss_env():
    env = E.StopLossEnv(1, cash=1000.0, buy_cost=0.0, sell_cost=0.0, most=500.0, penalty=0.0, stop=0.5)
    env.step(E.Day(np.array([10.0]), np.array([0.5])))
    assert env.held.tolist() == [25] and env.mean.tolist() == [10]
    got = env.step(E.Day(np.array([4.0]), np.array([0.0])))
    assert got["note"] == "stop loss" and got["traded"] == [-25.0] and env.mean.tolist() == [0]


def test_array_env_ignores_small_orders():
    env = E.ArrayEnv(2, cash=1000.0, buy_cost=0.1, sell_cost=0.0, most=100, scale=1.0)
    env.step(E.Day(np.array([10.0, 10.0]), np.array([0.1, 1.0])))
    assert env.held.tolist() == [0, 100] and env.cash == pytest.approx(-100)  # costs aren't part of what it can pay
    env.step(E.Day(np.array([10.0, 11.0]), np.array([0.0, -0.5])))
    assert env.held.tolist() == [0, 50]


def test_weights_env():
    env = E.WeightsEnv(2, value=100.0, fee=0.0)
    env.step(E.Day(np.array([1.0, 2.0]), np.array([0.5, 0.5])))
    got = env.step(E.Day(np.array([2.0, 2.0]), np.array([0.0, 0.0])))
    assert env.value == pytest.approx(150) and got["reward"] == pytest.approx(math.log(1.5)) and sum(env.weights) == pytest.approx(1)
    mu = E.remainder_factor(0.01, np.array([0.0, 0.5, 0.5]), np.array([0.0, 1.0, 0.0]))
    sold = max(0, 1 - mu * 0.5) + max(0, 0 - mu * 0.5)
    assert mu == pytest.approx(1 - (2 * 0.01 - 0.01**2) * sold, abs=1e-9)
    costly = E.WeightsEnv(1, value=100.0, fee=0.1, model="weights")
    costly.step(E.Day(np.array([1.0]), np.array([1.0])))
    costly.step(E.Day(np.array([1.0]), np.array([1.0])))
    assert costly.value == 100 and costly.weights.tolist() == [1, 0]  # no cash would be left for the fee


def test_play_runs_episodes(spark):
    rows = [(e, d, s, float(p), 0.5, None) for e in ("x", "y") for d in days(3) for s, p in (("a", 10), ("b", 5))] + [("x", days(4)[3], "a", 9.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "episode string, date date, symbol string, close double, action double, turbulence double")
    got = E.play(df, lambda n: E.StockEnv(n, cash=100.0, most=4)).collect()
    assert Counter(r.episode for r in got) == {"x": 3, "y": 3} and all(len(r.held) == 2 for r in got)
    assert E.play(df.limit(0), lambda n: E.StockEnv(n)).count() == 0


def test_remainder_factor_column(spark):
    before, after = [0.0, 0.7, 0.3], [0.2, 0.3, 0.5]
    got = spark.range(1).select(X.remainder_factor(0.01, F.array(*map(F.lit, before)), F.array(*map(F.lit, after)))).first()[0]
    assert got == pytest.approx(E.remainder_factor(0.01, np.array(after), np.array(before)), abs=1e-9)


# ---- the broker


def test_fill_limit_and_size():
    assert K.fill_limit([0, 100, 300], 50, 0.1, 5, 1) == 20 and K.fill_limit([0, 0], 50, 0.1, 5, 1) == 0 and K.fill_limit([100], 50, 0.1, 5, 2) == 0
    fee = B.TradeConfig(commission_per_share=1.0, min_commission=0.0, max_commission_rate=1.0).commission
    assert K.affordable(100, 9.0, 100.0, fee) == 10 and K.affordable(100, 9.0, 100.0, fee, compat=True) == 0 and K.affordable(5, 9.0, 100.0, fee) == 5 and K.affordable(5, 0.0, 100.0, fee) == 0 and K.affordable(5, 9.0, 5.0, fee) == 0


def test_broker_keeps_what_a_bar_cannot_fill(spark):
    rows = [("w", "t", d, 10.0, 10.0, 100.0, 1 if i == 1 else -1 if i == 8 else 0) for i, d in enumerate(days(12))]
    df = spark.createDataFrame(rows, "win string, ticker string, date date, adjusted_open double, adjusted_close double, volume double, signal int")
    c = B.TradeConfig(cash=300.0, timing="next_open", liquidity_pct=0.1, commission_per_share=0.0, min_commission=0.0)
    shares = [r.shares for r in K.run_signals(df, c).orderBy("date").collect()]
    assert shares == [0, 0, 10, 20, 28, 28, 28, 28, 28, 18, 8, 0]
    orders = K.run_signals(df, c, "orders").orderBy("date").collect()
    assert [(r.is_buy, r.size, r.value) for r in orders] == [(True, 28, 280.0), (False, -28, 280.0)] and orders[0].date == days(5)[4]


# ---- users' own parts


def test_strategy_trains_and_pays(spark):
    class Dip(G.Strategy):
        def train(self, history):
            self.mean = sum(b["adjusted_close"] for b in history) / len(history)

        def on_data(self, bar, account):
            if bar["adjusted_close"] < self.mean * self.params["share"] and account.shares == 0:
                account.buy(1)

        def finalize(self):
            return {"mean": self.mean, "days": self.params["days"]}

    rows = [("w", "t", d, 10.0, 10.0 - i, 100.0, i < 4, 0.5) for i, d in enumerate(days(8))]
    df = spark.createDataFrame(rows, "win string, ticker string, date date, adjusted_open double, adjusted_close double, volume double, training boolean, advice double")
    c = B.TradeConfig(cash=100.0, commission_per_share=0.0, min_commission=0.0)
    params = {"share": lambda rows: 0.7}
    assert G.run_strategy(df, Dip, c, params=params, output="trades").count() == 2
    report = {r.name: r.value for r in G.run_strategy(df, Dip, c, params=params, output="report").collect()}
    assert report == {"mean": 8.5, "days": 4.0}
    equity = [r.equity for r in G.run_strategy(df, Dip, c, params=params, external="advice", training_cost=2.0).orderBy("date").collect()]
    assert equity[0] == 97.5 and equity[-1] == pytest.approx(100 - 2 - 4 * 0.5 - 2)  # bought at 5, sold at 3


def test_signal_strategy_selectors_and_registry(spark):
    class Cross(G.SignalStrategy):
        def indicators(self, bars):
            return bars.withColumn("m", I.sma("adjusted_close", 2))

        def signal(self):
            return F.when(F.col("adjusted_close") > F.col("m"), 1).otherwise(-1)

    rows = [("w", "s", d, 10.0 + i % 3, 10.0 + i % 3, 100.0) for i, d in enumerate(days(9))]
    df = spark.createDataFrame(rows, "win string, symbol string, date date, adjusted_open double, adjusted_close double, volume double")
    assert Cross().run(df).count() == 9 and Cross().run(df, by_broker=True).count() == 9
    names = G.Registry("thing")
    names.add("a")(Cross)
    assert names.find("a") is Cross
    with pytest.raises(ValueError):
        names.add("a")(Cross)
    with pytest.raises(KeyError):
        names.find("b")
    got = G.selected(df, [("w1", "2024-01-05")], lambda b, first: b.where(F.col("date") < first).select("symbol").distinct()).collect()
    assert [tuple(r) for r in got] == [("w1", "s")]
    with pytest.raises(ValueError):
        G.normalised(df, lambda x: x.select("date"))
    costs = spark.createDataFrame([(DAY, 2.0)], "date date, cost double")
    assert G.with_external_cost(df, costs).agg(F.sum("external_cost")).first()[0] == 2.0


# ---- jobs


def test_jobs_resume_and_record_failures(spark, tmp_path):
    jobs = O.grid(spark, {"s": ["A", "B"], "t": ["A"]}, ["w1", "w2"])
    assert jobs.count() == 6
    data = jobs.withColumn("v", F.explode(F.array(F.lit(1.0), F.lit(2.0))))

    def bad(key, rows):
        if key[2] == "B":
            raise RuntimeError("no data")
        return pd.DataFrame({"total": [rows["v"].sum()]})

    first = O.run_jobs(jobs, data, bad, "total double", str(tmp_path))
    assert Counter(r.status for r in first.collect()) == {"complete": 4, "failed": 2}
    assert all("no data" in r.error for r in first.collect() if r.status == "failed")
    good = O.run_jobs(jobs, data, lambda k, r: pd.DataFrame({"total": [10.0]}), "total double", str(tmp_path))
    assert {r.status for r in good.collect()} == {"complete"}
    results = spark.read.parquet(f"{tmp_path}/results")
    assert sorted(r.total for r in results.collect()) == [3.0] * 4 + [10.0] * 2  # complete jobs weren't run again
    assert O.rebuilt_summary(results, {"best": "max(total)"}).count() == 6
    again = O.run_jobs(jobs, data, bad, "total double", str(tmp_path))
    assert {r.status for r in again.collect()} == {"complete"}


def test_job_timeout(spark, tmp_path):
    def slow(key, rows):
        import time

        time.sleep(5)
        return rows

    jobs = O.grid(spark, {"s": ["A"]}, ["w"])
    assert [r.status for r in O.run_jobs(jobs, jobs.withColumn("v", F.lit(1.0)), slow, "v double", str(tmp_path), seconds=1).collect()] == ["timeout"]


def test_job_states_lead_to_runs(spark):
    jobs = O.grid(spark, {"s": list("ABCDE")}, ["w"])
    stamp = lambda h: dt.datetime(2024, 1, 1, h)
    status = spark.createDataFrame([("s", "w", t, x, stamp(h)) for t, x, h in (("A", "running", 1), ("B", "running", 9), ("C", "failed", 9), ("C", "running", 8), ("D", "running", 1))], "setup string, window string, ticker string, status string, at timestamp")
    results = spark.createDataFrame([("s", "w", "D"), ("s", "w", "D")], "setup string, window string, ticker string")
    got = O.states(jobs, status, results, "2024-01-01 10:00:00", 3600 * 2, 2)
    assert {r.ticker: (r.state, r.attempts) for r in got.collect()} == {"A": ("timeout", 1), "B": ("running", 1), "C": ("failed", 1), "D": ("complete", 1), "E": ("missing", 0)}
    assert {r.ticker for r in O.to_run(got).collect()} == {"A", "C", "E"} and {r.ticker for r in O.to_run(got, 1).collect()} == {"E"}
    assert O.without_incomplete(results, got).count() == 2


def test_setups():
    assert O.setup("momentum_sp500_5")["k"] == 5 and O.setup("selected_4")["training_years"] == 3 and O.setup("selected_5", last="2010-01-01")["last"] == "2010-01-01"
    with pytest.raises(ValueError):
        O.setup("other")


# ---- memory


def test_memory_layers_against_a_loop(spark):
    rng = random.Random(6)
    items = [("s", i, rng.choice(("short", "mid", "long", "reflection")), float(rng.choice((40, 60, 80, 90))), rng.randint(1, 20)) for i in range(60)]
    feed = [("s", i, items[i][4] + 1, rng.choice((1, -1))) for i in range(0, 60, 4)]
    state = {}
    for day in range(1, 31):
        for _, i, layer, imp, d in items:
            if d == day:
                state[i] = [layer, imp, 1.0, 0, 0, 0, None]
        for x in state.values():
            if x[6] is None:
                p = V.LAYERS[x[0]]
                x[3] += 1
                x[1], x[2] = x[1] * p["importance"], math.exp(-x[3] / p["recency"])
                x[6] = day if x[2] < 0.05 or x[1] < 5 else None
        for _ in range(2):
            for layer, up, down in (("short", "mid", None), ("mid", "long", "short"), ("long", None, "mid")):
                p = V.LAYERS[layer]
                for x in [x for x in state.values() if x[6] is None and x[0] == layer]:
                    if up and x[1] >= p["up"]:
                        x[0], x[2], x[3], x[5] = up, 1.0, 0, x[5] + 1
                    elif down and x[1] < p["down"]:
                        x[0], x[5] = down, x[5] + 1
        for _, i, d, v in feed:
            if d == day and i in state and state[i][6] is None:
                state[i][4] += v
                state[i][1] += 5 * state[i][4]
    df = spark.createDataFrame(items, "symbol string, id long, layer string, importance double, day int")
    got = V.lifecycle(df, 30, spark.createDataFrame(feed, "symbol string, id long, day int, value int")).collect()
    assert len(got) == len(state) and any(r.jumps for r in got) and any(r.removed for r in got)
    for r in got:
        x = state[r.id]
        assert (r.layer, r.age, r.accesses, r.jumps, r.removed) == (x[0], x[3], x[4], x[5], x[6]) and r.importance == pytest.approx(x[1]) and r.recency == pytest.approx(x[2])


def test_replay_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(t, d, 10.0 + rng.random(), 10.0 + rng.random(), rng.choice((1, -1, 0))) for t in "ab" for d in days(30)]
    schema = "ticker string, date date, open double, close double, signal int"
    early = [r for r in rows if r[1] < days(16)[15]]
    late = [r for r in rows if r[1] >= days(16)[15]] + [("a", days(3)[2], 1.0, 1.0, 1)]
    spark.createDataFrame(early, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b=1")
    s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    q = Y.replay(s, 1000.0, 0.01).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").format("memory").queryName("replayed").start()
    q.processAllAvailable()
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b=2")
    q.processAllAvailable()
    q.stop()
    got = spark.table("replayed")
    assert got.where("status = 'late'").count() == 1
    want = Y.replay_batch(spark.createDataFrame(rows, schema), 1000.0, 0.01)
    key = lambda df: sorted((r.ticker, r.date, round(r.equity, 6), r.shares) for r in df.where("status = 'ok'").collect())
    assert key(got) == key(want)


def test_polled_bars_replace_a_repeated_batch(spark, tmp_path):
    write = Y.poll(str(tmp_path), lambda df: df.withColumn("m", I.sma("close", 2)))
    batch = lambda rows: spark.createDataFrame(rows, "symbol string, date date, close double")
    write(batch([("a", days(1)[0], 1.0), ("b", days(1)[0], 5.0)]), 0)
    write(batch([("a", days(2)[1], 3.0)]), 1)
    write(batch([("a", days(2)[1], 4.0)]), 1)
    latest = spark.read.parquet(f"{tmp_path}/latest").where("batch = 1").collect()
    assert [(r.symbol, r.close, r.m) for r in latest] == [("a", 4.0, 2.5)]


def test_sessions(spark):
    news = spark.createDataFrame([(dt.datetime(2024, 1, 31, 17),), (dt.datetime(2024, 1, 31, 15, 59),)], "ts timestamp")
    assert sorted(r.session.date() for r in Y.sessions(news).collect()) == [dt.date(2024, 1, 31), dt.date(2024, 2, 1)]


# ---- signals and panels


def test_zigzag(spark):
    close = [100, 103, 110, 104, 99, 101, 94, 99, 107, 106]
    df = spark.createDataFrame([("s", d, float(c)) for d, c in zip(days(10), close)], "symbol string, date date, close double")
    got = [r.pivot for r in I.zigzag(df).orderBy("date").collect()]
    assert got == [0, 0, 1, 0, 0, 0, -1, 0, 0, 0]


def test_recursive_average_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(100, 20, 1500)
    start = dt.date(2000, 1, 1)
    df = spark.createDataFrame([("s", start + dt.timedelta(i), float(v)) for i, v in enumerate(x)], "symbol string, date date, close double")
    for n in (3, 26, 200):
        got = [r.e for r in I.ema(df, "close", n, "e").orderBy("date").collect()]
        assert np.allclose(got, pd.Series(x).ewm(span=n, adjust=False).mean(), rtol=1e-11)


def test_similar_news_is_dropped(spark):
    def brute(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            q = [0]
            for j, y in enumerate(b):
                q.append(p[j] + 1 if x == y else max(p[j + 1], q[-1]))
            p = q
        return 2 * p[-1] / (len(a) + len(b)) if a or b else 1.0

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts = [x for t in texts for x in ((t, t[:-3] + "zz") if rng.random() < 0.5 else (t,))] + [None, None]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "symbol string, at int, headline string")
    shown = [t if t is not None else "None" for t in texts]
    want = [i for i, t in enumerate(shown) if i == 0 or brute(t, shown[i - 1]) <= 0.6]
    assert [r["at"] for r in P.drop_similar(df, "headline", 0.6, ("symbol",), "at").orderBy("at").collect()] == want


def test_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.scrub(F.lit("Café  Straße — call +1 (555) 123-4567 or a.b@c.com http://x.y/z NOW"))) == "cafe strasse call or now"
    assert one(X.unescaped(F.lit("a &eacute; &#8212; &amp;"))) == "a é — &"
    assert one(X.file_name(F.lit("a/b\\c:d"))) == "a_b_c_d"
    assert X.resolve_parameters({"a": "$x", "b": 2}, {"x": 5}) == {"a": 5, "b": 2} and X.resolve_parameters(None, {}) == {}
    with pytest.raises(KeyError):
        X.resolve_parameters({"a": "$y"}, {})
    assert one(X.item_code(F.lit("ITEM 7A. Market risk"))) == "7A" and one(X.part_name(F.lit("Part ii"))) == "Part II"
    assert X.interval_seconds("5m") == 300 and one(X.from_unix(F.lit(0), "America/New_York")).hour == 19
    assert one(F.concat_ws("|", X.move_text(F.lit(0.05)), X.move_text(F.lit(0.0)), X.move_text(F.lit(None).cast("double")))) == "an increase of 5.00%|no change|unknown"


def test_diversified_falls_back_to_the_least_correlated(spark):
    from marketloom.operators import select as T

    sharpe = spark.createDataFrame([("a", 3.0), ("b", 2.9), ("c", 2.8), ("d", 0.5)], "symbol string, sharpe double")
    corr = spark.createDataFrame([("a", "b", 0.95), ("a", "c", 0.9), ("b", "c", 0.94), ("a", "d", 0.1), ("b", "d", 0.3), ("c", "d", 0.2)], "a string, b string, corr double")
    assert [r.symbol for r in T.diversified(sharpe, corr, 2).orderBy("rank").collect()] == ["a", "d"]
    assert [r.symbol for r in T.diversified(sharpe, corr, 2, most=0.99).orderBy("rank").collect()] == ["a", "c"]
    tilt = spark.createDataFrame([("d", "POSITIVE"), ("a", "NEGATIVE")], "symbol string, sentiment string")
    base = {r.symbol: r.score for r in T.diversified(sharpe, corr, 4, most=9).collect()}
    got = {r.symbol: r.score for r in T.diversified(sharpe, corr, 4, tilt, most=9).collect()}
    assert got["d"] == pytest.approx(base["d"] + 0.2) and got["a"] == pytest.approx(base["a"] - 0.2) and got["b"] == pytest.approx(base["b"])
    assert T.fixed(spark, ["x", "y", "x"]).count() == 2


# ---- filing sections


def prose(label, n):
    return [f"{label} paragraph {i}. Revenue, margin, liquidity and cash flow trends are described in a full sentence." for i in range(n)]


def annual(*more, filler=190):
    return "\n".join([
        "ANNUAL REPORT", "PART I", "ITEM 1. BUSINESS", *[f"Business background line {i}. Prior-period operating context." for i in range(filler)], "PART II",
        "ITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS OF FINANCIAL CONDITION AND RESULTS OF OPERATIONS", *prose("Management analysis", 24),
        "ITEM 7A. QUANTITATIVE AND QUALITATIVE DISCLOSURES ABOUT MARKET RISK", "Interest rates would move our expense by an amount that is not material to us at all.", *more,
    ])


CONTENTS = ["TABLE OF CONTENTS", "Page", "PART I", "Item 1. Business 3", "Item 1A. Risk Factors 9", "PART II", "Item 7. Management's Discussion and Analysis of Financial Condition and Results of Operations 43", "Item 7A. Quantitative and Qualitative Disclosures About Market Risk 60", "Item 8. Financial Statements and Supplementary Data 61"]


def keys(result):
    return [s["item_key"] for s in result["sections"]]


def test_sections_in_order():
    got = C.extract(annual(), "10-K")
    assert keys(got) == ["item_1", "item_7", "item_7a"] and got["status"] == "partial" and "item_8" in got["missing"]
    s = got["sections"][1]
    assert s["text"].startswith("Part II Item 7. Management's Discussion and Analysis of Financial Condition and Results of Operations\nManagement analysis paragraph 0.")
    assert s["body"].endswith("full sentence.") and "ITEM 7A" not in s["text"] and (s["line_start"], s["line_end"]) == (196, 219)
    assert C.extract("", "10-K")["status"] == "failed" and C.audit(C.extract("", "10-K"), "10-K")["flags"] == ["no_items_extracted", "missing_primary:item_7"]


def test_contents_are_no_headings():
    got = C.extract("\n".join(CONTENTS) + "\n" + annual(), "10-K")
    assert keys(got) == ["item_1", "item_7", "item_7a"] and got["sections"][0]["heading_line"] == 12
    assert C.extract("\n".join(CONTENTS), "10-K")["status"] == "failed"


def test_references_in_sentences_are_no_headings():
    text = annual().replace("Management analysis paragraph 5.", "As described in\nItem 1A. Risk Factors of this report, see\nItem 7. Management's Discussion and Analysis\nManagement analysis paragraph 5.")
    assert "item_1a" not in keys(C.extract(text, "10-K"))


def test_bodies_are_cleaned():
    text = annual().replace("Management analysis paragraph 3.", "-----------\n12\nTable of Contents\nManagement analysis paragraph 3.")
    body = C.extract(text, "10-K", ("item_7",))["sections"][0]["body"]
    assert "-----" not in body and "Table of Contents" not in body and "\n12\n" not in body


def test_quarterly_report():
    q = "\n".join(["PART I", "ITEM 1. FINANCIAL STATEMENTS", *[f"Statement line {i} 1,234 5,678 of the period under review." for i in range(200)], "ITEM 2. MANAGEMENT'S DISCUSSION AND ANALYSIS OF FINANCIAL CONDITION AND RESULTS OF OPERATIONS", *prose("Quarterly", 20), "ITEM 3. QUANTITATIVE AND QUALITATIVE DISCLOSURES ABOUT MARKET RISK", "Our exposure to the market has not changed in the quarter in any material way, in our view.", "ITEM 4. CONTROLS AND PROCEDURES", "Our controls and procedures were effective at the end of the period, as our officers concluded.", "PART II", "ITEM 1. LEGAL PROCEEDINGS", "None.", "ITEM 1A. RISK FACTORS", "There are no material changes to the risk factors in Part I, Item 1A, Risk Factors of our Form 10-K."])
    got = C.extract(q, "10-Q")
    assert keys(got) == ["part_i_item_1", "part_i_item_2", "part_i_item_3", "part_i_item_4", "part_ii_item_1", "part_ii_item_1a"]
    judged = C.audit(got, "10-Q")["items"]
    assert judged["part_ii_item_1"][1][-1] == "allowed_short_stub" and judged["part_ii_item_1a"][1][-1] == "allowed_carry_forward_stub" and judged["part_i_item_2"] == ("pass", [])
    missing = "\n".join(x for x in q.split("\n") if not x.startswith("ITEM 2"))
    assert C.extract(missing, "10-Q", ("part_i_item_2",))["status"] == "failed"


def test_fallbacks():
    statements = ["CONSOLIDATED BALANCE SHEETS", *[f"Cash and equivalents {i},234 5,678 and other amounts of the year" for i in range(40)]]
    part_four = annual("ITEM 8. FINANCIAL STATEMENTS AND SUPPLEMENTARY DATA", "The information required by this item is set forth in the consolidated financial statements in Part IV, Item 15 of this annual report on Form 10-K.", "ITEM 9. CHANGES", "None.", "PART IV", "ITEM 15. EXHIBITS AND FINANCIAL STATEMENT SCHEDULES", *statements, "ITEM 16. FORM 10-K SUMMARY", "None")
    got = {s["item_key"]: s for s in C.extract(part_four, "10-K")["sections"]}
    assert got["item_8"]["method"] == "part_four" and got["item_8"]["body"].startswith("Cash and equivalents 0") and "None" not in got["item_8"]["body"]
    untraditional = "\n".join(["The order of this report differs from the traditional SEC Form 10-K format.", "Form 10-K Cross-Reference Index", *["Filler line of the front part."] * 100, "Fundamentals of Our Business", *prose("Business", 12), "Management's Discussion and Analysis", *prose("Analysis", 15), "Risk Factors and Other Key Information", "Risk Factors", *prose("Risk", 9), "Quantitative and Qualitative Disclosures About Market Risk", *prose("Market", 8), "Financial Statements and Supplemental Details", *statements, "Controls and Procedures", *prose("Controls", 8)])
    got = {s["item_key"]: s for s in C.extract(untraditional, "10-K")["sections"]}
    assert {k: s["method"] for k, s in got.items()} == dict.fromkeys(("item_1", "item_1a", "item_7", "item_7a", "item_8", "item_9a"), "untraditional_10k")
    assert got["item_7"]["body"].startswith("Analysis paragraph 0") and "Risk" not in got["item_7"]["body"]


def test_page_lists_and_quarterly_landmarks():
    title = "Management's Discussion and Analysis of Financial Condition and Results of Operations"
    pages = ["Overview 44", "Results of Operations 46", "Liquidity and Capital Resources 50", "Critical Accounting Estimates 55"]
    statements = ["Consolidated Balance Sheets", *[f"Cash and equivalents {i},234 5,678 and other amounts of the year" for i in range(40)]]
    listed = ["Consolidated Balance Sheets 61", "Consolidated Statements of Income 62", "Notes to Consolidated Financial Statements 63"]
    text = "\n".join([*CONTENTS, *["Filler line of the front part."] * 60, title, *pages, *prose("Analysis", 15), "Quantitative and Qualitative Disclosures About Market Risk", *prose("Market", 3), *listed, "Filler line.", *statements])
    got = {s["item_key"]: s for s in C.extract(text, "10-K")["sections"]}
    assert {k: s["method"] for k, s in got.items()} == {"item_7": "mapped_mda", "item_8": "mapped_statements"}
    assert got["item_7"]["body"].startswith("Analysis paragraph 0") and "Market paragraph" not in got["item_7"]["body"] and "Cash and equivalents 39" in got["item_8"]["body"]
    quarter = "\n".join(["This report does not follow the traditional SEC Form 10-Q format.", *["Filler line of the front part."] * 30, "Consolidated Condensed Statements of Income", *[f"Net revenue {i},234 5,678 for the three months ended, in millions" for i in range(40)], "Consolidated balance sheets and notes follow.", "Management's Discussion and Analysis", *prose("Analysis", 15), "Risk Factors", *prose("Risk", 8), "Form 10-Q Cross-Reference Index", "Item 1 3"])
    got = {s["item_key"]: s for s in C.extract(quarter, "10-Q", ("part_i_item_1", "part_i_item_2", "part_ii_item_1a"))["sections"]}
    assert {k: s["method"] for k, s in got.items()} == dict.fromkeys(("part_i_item_1", "part_i_item_2", "part_ii_item_1a"), "untraditional_10q")
    assert "Risk paragraph" not in got["part_i_item_2"]["body"] and "Cross-Reference" not in got["part_ii_item_1a"]["body"]


def test_stubs_and_overlaps():
    assert C.is_short_value("Not applicable.") and C.is_reference("See Note 5.") and not C.is_reference("Revenue grew.")
    assert C.is_reference("The financial statements are included beginning on page F-1.")
    assert C.is_reference("The information required is incorporated by reference to our proxy statement. See also Item 15.")
    assert not C.is_reference("Our plants are described below. We own nine of them. See Note 5 for leases.")
    assert not C.is_reference("See Note 5. " + "Revenue grew in every region that we serve. " * 4) and not C.is_reference("") and not C.is_reference("Sales are set forth as they fell.")
    assert C.is_carry_forward("There have been no material changes to the risk factors disclosed in our Form 10-K.")
    assert C.is_carry_forward("Our risk factors remain unchanged. Refer to Part I, Item 1A of our Annual Report.")
    assert not C.is_carry_forward("There were no material changes in our prices.") and not C.is_carry_forward("Risk factors follow. A strike may stop our mills.")
    assert not C.is_carry_forward("No risk factors changed materially. " + "A strike may stop our mills, and a drought may stop our ships for longer than we can bear. " * 4)
    assert C.opens_with_contents("Overview 12\nResults 14\nLiquidity 20") and not C.opens_with_contents("We make cars and sell them in many countries of the world.\nSales rose by 12")
    s = lambda k, a, b: {"item_key": k, "line_start": a, "line_end": b}
    assert C.overlaps([s("a", 1, 10), s("b", 9, 12), s("c", 12, 20), s("d", 15, 30)]) == [("a", "b", 2, "warn"), ("b", "c", 1, "warn"), ("c", "d", 6, "fail")]


def test_overlay(spark):
    rows = [("A", DAY, annual()), ("B", DAY, annual()), ("C", DAY, "nothing here"), ("D", DAY, None)]
    df = spark.createDataFrame(rows, "symbol string, date date, filing_text string")
    got = {r.symbol: r.filing_text for r in C.overlay(df, "10-K", "item_7").collect()}
    assert got["A"].startswith("Part II Item 7.") and got["A"] == got["B"] and got["C"] == "" and got["D"] is None
    assert {r.symbol: r.filing_text for r in C.overlay(df, "10-K", "item_7", failure="raw").collect()}["C"] == "nothing here"
    with pytest.raises(Exception, match="no item_7"):
        C.overlay(df, "10-K", "item_7", failure="raise").collect()
    with pytest.raises(TypeError):
        C.overlay(df.withColumn("filing_text", F.array("filing_text")), "10-K", "item_7")
    with pytest.raises(ValueError):
        C.filing_sections(df, "10-K", ("item_99",))
    assert df.collect()[2].filing_text == "nothing here"
    assert C.filing_sections(df.limit(0), "10-K").count() == 0
    sections = C.filing_sections(df, "10-K", ("item_7", "item_7a"))
    assert sections.count() == 8 and C.section_overlaps(sections).count() == 0


# ---- sources and sinks


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-02,10,12,9,10,5,100\n2024-01-03,11,12,9,0,5,100\n")
    got = S.read_price_csv(spark, f"{tmp_path}/p.csv", vendor="yahoo", symbol="A", adjust=True).orderBy("date").collect()
    assert [(r.symbol, r.open, r.close, r.year) for r in got] == [("A", 5.0, 5.0, 2024), ("A", 0.0, 0.0, 2024)]
    (tmp_path / "n.csv").write_text('day,headline\n2024-01-02,"a, b"\n2024-01-02,"a, b"\n2024-01-02,c\n')
    news = S.read_news_csv(spark, f"{tmp_path}/n.csv", {"day": "date", "headline": "news_text"}, symbol="A").collect()
    assert sorted((r.item_index, r.text_len) for r in news) in ([(1, 1), (2, 4)], [(1, 4), (2, 1)]) and len(news) == 2
    rows = [(dt.date(y, 3, 1), s, "c", i, "t" * 5, y, "a") for i, (y, s) in enumerate((y, s) for y in (2022, 2023) for s in "AB")]
    for f in ("filingk", "filingq"):
        spark.createDataFrame(rows, S.FILING).write.partitionBy("year").parquet(f"{tmp_path}/{f}")
    filings = S.open_source(spark, "filings", str(tmp_path), years=(2023, 2024), symbols=["A"])
    assert {(r.form, r.symbol, r.year) for r in filings.collect()} == {("10-K", "A", 2023), ("10-Q", "A", 2023)}
    assert S.read_filings(spark, str(tmp_path), limit=3).count() == 3
    with pytest.raises(ValueError):
        S.open_source(spark, "other", "x")
    price = {"date": dt.date(2023, 3, 1), "symbol": "A", "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "adjusted_close": 1.0, "volume": 1.0}
    data = S.open_market_data(spark, rows=[price])
    assert data.price.count() == 1
    whole = S.MarketData(data.price, filing_k=spark.createDataFrame(rows, S.FILING))
    assert whole.day_records().count() == 4 and whole.day_records(every_day=False).count() == 1
    day = whole.agent_days().collect()[0]
    assert day.news == [] and day.filing_k == "ttttt" and day.filing_q == ""
    with pytest.raises(ValueError):
        S.open_market_data(spark, "x", rows=[price])


def test_result_tree(spark, tmp_path):
    tree = {"s": {"w1": {"A": {"total_return": 0.1, "equity": 5}, "B": {"sharpe_ratio": 2.0}}, "w2": {"A": {"final_value": 3}}}, "note": 4}
    assert S.flatten_results(tree) == [
        {"path": "s/w1/A", "ticker": "A", "window": "w1", "total_return": 0.1}, {"path": "s/w1/B", "ticker": "B", "window": "w1", "sharpe_ratio": 2.0}, {"path": "s/w2/A", "ticker": "A", "window": "w2", "final_value": 3},
    ]
    summary = spark.createDataFrame([("w1", "A", 0.1), ("w1", "B", 0.2)], "window string, ticker string, total_return double")
    trades = spark.createDataFrame([], "window string, ticker string, quantity long")
    S.write_results(f"{tmp_path}/out", summary=summary, tables={"trades": trades, "equity": summary}, config=B.TradeConfig())
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/out/run_manifest", wholetext=True).collect()))["schema_version"] == 1
    assert json.loads(spark.read.text(f"{tmp_path}/out/run_config", wholetext=True).first().value)["cash"] == 100_000
    leaves = spark.read.text(f"{tmp_path}/out/metrics")
    assert {(r.ticker, json.loads(r.value)["total_return"]) for r in leaves.collect()} == {("A", 0.1), ("B", 0.2)}
    S.write_results(f"{tmp_path}/out", summary=summary, tables={"equity": summary.where("ticker = 'B'").withColumn("total_return", F.lit(9.0))})
    assert {r.total_return for r in spark.read.parquet(f"{tmp_path}/out/equity").collect()} == {0.1, 9.0}  # the other leaf stays


def test_json_and_traces(spark, tmp_path):
    class Odd:
        pass

    got = json.loads(S.json_text({1: DAY, "b": np.float64(2), "c": {3, 1}, "d": B.TradeConfig(), "e": Odd(), "f": (1, 2)}))
    assert got["1"] == "2024-01-01" and got["b"] == 2 and got["c"] == [1, 3] and got["d"]["cash"] == 100_000 and got["e"] == "Odd" and got["f"] == [1, 2]
    assert S.run_key({"a": 1, "b": 2}) == S.run_key({"b": 2, "a": 1}) != S.run_key({"a": 2, "b": 2})
    events = spark.createDataFrame([("query", "q1"), ("answer", "a1")], "phase string, text string")
    path = S.write_trace(events, str(tmp_path), {"a": 1})
    assert spark.read.json(f"{path}/events").count() == 2
    sections = C.filing_sections(spark.createDataFrame([("A", DAY, annual())], "symbol string, date date, filing_text string"), "10-K", ("item_7", "item_8"))
    S.write_sections(sections, f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s/records").count() == 2 and spark.read.text(f"{tmp_path}/s/sections").where("item_key = 'item_7'").count() == 25
    S.write_features(spark.createDataFrame([("A", 1.0)], "symbol string, x double"), f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 1


def test_sections_of_many_filings_are_few_files(spark, tmp_path):
    filings = spark.range(40).select("id", F.lit(annual()).alias("filing_text")).coalesce(2)
    S.write_sections(C.filing_sections(filings, "10-K", ("item_7", "item_8"), keep=("id",)), f"{tmp_path}/s", keys=("id",))
    found = spark.read.json(f"{tmp_path}/s/sections")
    text = {r.item_key: r.section_text for r in C.filing_sections(filings.limit(1), "10-K", ("item_7", "item_8"), keep=("id",)).collect() if r.section_text}
    assert text and len(found.inputFiles()) <= 8 and found.select("id", "item_key").distinct().count() == 40 * len(text)
    for (i, key), rows in itertools.groupby(sorted((r.id, r.item_key, r.line, r.value) for r in found.collect()), key=lambda r: r[:2]):
        assert "\n".join(r[3] for r in rows) == text[key]


def test_overlay_moves_no_texts_and_equal_filings_are_extracted_once(spark, monkeypatch):
    df = spark.createDataFrame([("A", DAY, annual())] * 3, "symbol string, date date, filing_text string")
    plan = C.overlay(df, "10-K", "item_7")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    made = []
    seen = C.Seen(lambda x: made.append(x) or [(x,)])
    assert [seen(x) for x in "aab"] == [[("a",)], [("a",)], [("b",)]] and made == ["a", "b"]
    monkeypatch.setattr(C, "REMEMBERED", 250)
    assert [seen(x)[0][0] for x in "cdcd"] == list("cdcd") and len(seen.held) == 1


def test_memory_store_and_queries(spark):
    store = spark.createDataFrame([("s", i, [float(i), 1.0], i / 10) for i in range(6)], "symbol string, id int, v array<double>, compound double")
    q = spark.createDataFrame([("s", 0, [1.0, 0.0])], "symbol string, qid int, q array<double>")
    assert [r.id for r in V.hybrid(store, q, 2).collect()] == [4, 5] and [r.id for r in V.hybrid(store, q, 2, compat=True).collect()] == [4, 5]
    assert V.nearest_in_group(store, q, 1).first().id == 5
    assert V.recall(store.select("id", "v", F.lit(0.0).alias("importance"), F.lit(0).alias("days")), q.select("qid", "q"), least=0.9).count() == 3


def test_pair_operators_take_chosen_pairs(spark):
    from marketloom.operators import statistics as Q

    r = spark.createDataFrame([(s, d, float(i)) for s in "abc" for i, d in enumerate(days(4))], "symbol string, date date, ret double")
    chosen = spark.createDataFrame([("c", "a")], "a string, b string")
    assert {(x.a, x.b) for x in Q.pairs(r, chosen=chosen).collect()} == {("c", "a")}
    e = spark.createDataFrame([(s, i, i % 2) for s in "abc" for i in range(4)], "episode string, pos int, action int")
    assert [(x.a, x.b, x.overlap) for x in Q.episode_overlap(e, chosen).collect()] == [("c", "a", 1.0)]

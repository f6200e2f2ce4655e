"""Performance statistics, drawdowns and tiled correlations against plain loops."""

import datetime
import itertools
import math
import statistics

import numpy as np
import pandas as pd
import pytest

from marketloom.operators import metrics as M

DAY = datetime.date(2020, 1, 1)


def frame(spark, series):
    rows = [(s, DAY + datetime.timedelta(days=i), None if r is None else float(r)) for s, rets in series.items() for i, r in enumerate(rets)]
    return spark.createDataFrame(rows, "symbol string, date date, ret double").repartition(5)


def test_performance(spark):
    rng = np.random.default_rng(5)
    series = {"a": [None, *rng.normal(0.001, 0.02, 300)], "b": [None, *rng.normal(-0.001, 0.03, 90), None, 0.01], "still": [None, 0.0, 0.0, 0.0], "up": [0.01, 0.02], "lost": [0.5, -1.0, 0.5], "one": [0.1], "none": [None]}
    market = rng.normal(0, 0.01, 320)
    days = spark.createDataFrame([(DAY + datetime.timedelta(days=i), float(m)) for i, m in enumerate(market)], "date date, market double")
    got = {r.symbol: r for r in M.performance(frame(spark, series), market=days).collect()}
    assert set(got) == set(series) - {"none"}
    for s in ("a", "b"):
        x = np.array([r for r in series[s] if r is not None])
        f = np.array([m for r, m in zip(series[s], market) if r is not None])
        grown, top, worst = 1.0, 1.0, 0.0
        logs = []
        for r in x:
            grown *= 1 + r
            top = max(top, grown)
            worst = min(worst, grown / top - 1)
            logs.append(math.log(grown))
        mean, std = statistics.mean(x), statistics.stdev(x)
        down = math.sqrt(sum(min(r, 0) ** 2 for r in x) / len(x))
        beta = np.cov(x, f, ddof=0)[0, 1] / np.var(f)
        want = {
            "n": len(x), "cumulative_return": grown - 1, "annual_return": grown ** (252 / len(x)) - 1, "volatility": std * 252**0.5, "sharpe": mean / std * 252**0.5, "max_drawdown": worst,
            "calmar": (grown ** (252 / len(x)) - 1) / -worst, "stability": np.corrcoef(np.arange(len(x)), logs)[0, 1] ** 2, "omega": sum(r for r in x if r > 0) / -sum(r for r in x if r < 0),
            "sortino": mean / down * 252**0.5, "skew": np.mean((x - mean) ** 3) / np.std(x) ** 3, "kurtosis": np.mean((x - mean) ** 4) / np.std(x) ** 4 - 3,
            "tail_ratio": abs(np.percentile(x, 95)) / abs(np.percentile(x, 5)), "value_at_risk": mean - 2 * std, "beta": beta, "alpha": (1 + mean - beta * f.mean()) ** 252 - 1,
        }
        for k, v in want.items():
            assert got[s][k] == pytest.approx(v, rel=1e-9), (s, k)
    assert got["still"].sharpe is None and got["still"].omega is None and got["still"].max_drawdown == 0 and got["still"].calmar is None
    assert got["up"].omega is None and got["up"].sortino is None and got["up"].calmar is None
    assert got["lost"].cumulative_return == -1 and got["lost"].max_drawdown == -1 and got["lost"].stability is None and got["lost"].annual_return == -1
    assert got["one"].volatility is None and got["one"].n == 1
    assert M.performance(frame(spark, {"none": [None]})).count() == 0


def test_drawdowns(spark):
    rng = np.random.default_rng(6)
    series = {"a": list(rng.normal(0.002, 0.02, 400)), "first": [-0.5, 0.5, 1.0, -0.1], "up": [0.1, 0.0, 0.2], "equal": [0.1, -0.5, 1.0, -0.5, 1.0]}
    got = {}
    for r in M.drawdowns(frame(spark, series), most=3).orderBy("symbol", "rank").collect():
        got.setdefault(r.symbol, []).append(r)
    assert "up" not in got
    for s in ("a", "first", "equal"):
        grown, top, falls, now = 1.0, 1.0, [], None
        peak = None
        for i, r in enumerate(series[s]):
            grown *= 1 + r
            day = DAY + datetime.timedelta(days=i)
            if grown >= top * (1 - 1e-12):
                if now:
                    falls.append(now | {"recovery": day})
                now, top, peak = None, max(top, grown), day
            elif now is None or grown / top - 1 < now["depth"]:
                now = {"peak": peak, "depth": grown / top - 1, "valley": day, "start": now["start"] if now else peak or day, "recovery": None}
        if now:
            falls.append(now)
        falls = sorted(falls, key=lambda f: (round(f["depth"], 12), f["start"]))[:3]
        assert [(r.peak, r.valley, r.recovery) for r in got[s]] == [(f["peak"], f["valley"], f["recovery"]) for f in falls]
        assert [r.depth for r in got[s]] == pytest.approx([f["depth"] for f in falls], abs=1e-11)
        last = DAY + datetime.timedelta(days=len(series[s]) - 1)
        assert [r.days for r in got[s]] == [((f["recovery"] or last) - f["start"]).days for f in falls]


@pytest.mark.parametrize("tile", [100, 3, 1])
def test_correlations_by_tiles(spark, tile):
    rng = np.random.default_rng(7)
    series = {f"s{i}": [None if rng.random() < 0.3 else r for r in rng.normal(size=40)] for i in range(9)} | {"late": [None] * 30 + list(rng.normal(size=10)), "flat": [0.0] * 40, "empty": [None] * 40}
    got = {(r.a, r.b): r for r in M.correlations(frame(spark, series), days=16, tile=tile).collect()}
    table = pd.DataFrame(series, dtype=float)
    for a, b in itertools.combinations(sorted(series), 2):
        both = table[[a, b]].dropna()
        assert (a, b) in got if len(both) else (a, b) not in got
        if len(both):
            want = both[a].corr(both[b]) if both[a].std() > 0 and both[b].std() > 0 else None
            assert got[a, b].n == len(both) and (got[a, b].corr == pytest.approx(want) if want is not None else got[a, b].corr is None)
    assert all(a < b for a, b in got)

"""Folds in blocks equal plain loops over the whole series, whatever the blocks; a long series is many tasks."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import segmented


def plain_zigzag(close, percent):
    out, way, top, bottom = [0] * len(close), 0, 0, 0
    for i, x in enumerate(close):
        top, bottom = (i if x > close[top] else top), (i if x < close[bottom] else bottom)
        if way >= 0 and x <= close[top] * (1 - percent / 100):
            out[top], way, bottom = (1 if way or top else 0), -1, i
        elif way <= 0 and x >= close[bottom] * (1 + percent / 100):
            out[bottom], way, top = (-1 if way or bottom else 0), 1, i
    return out


def series(rng, n, kind):
    if kind == "walk":
        x, out = 100.0, []
        for _ in range(n):
            x *= 1 + rng.uniform(-0.03, 0.03)
            out.append(x)
        return out
    if kind == "steps":
        return [float(rng.choice((95, 100, 104, 105, 106, 110))) for _ in range(n)]
    if kind == "flat":
        return [100.0 + rng.choice((0, 1, 2)) for _ in range(n)]
    if kind == "fall":
        return [1000.0 * 0.999**i for i in range(n)]
    return [100 + (i % 40) * (1 if (i // 40) % 2 else -1) + rng.random() for i in range(n)]


@pytest.mark.parametrize("kind", ["walk", "steps", "flat", "fall", "saw"])
def test_zigzag_in_any_blocks(kind):
    rng = random.Random(kind)
    for trial in range(120):
        close, percent = series(rng, rng.randint(1, 150), kind), rng.choice((0.5, 2, 5, 10))
        fold, cuts = segmented.Turns(percent), sorted(rng.sample(range(1, 150), rng.randint(0, 12)))
        state, got, starts, at = None, [0] * len(close), [], 0
        for number, end in enumerate([*[c for c in cuts if c < len(close)], len(close)]):
            block = close[at:end]
            starts.append(at)
            for b, i, pivot in fold.marks(block, number, state):
                assert not got[starts[b] + i]
                got[starts[b] + i] = pivot
            state = json.loads(json.dumps(fold.after(state, json.loads(json.dumps(fold.block(block, number))))))
            at = end
        assert got == plain_zigzag(close, percent), (trial, percent, cuts)


def test_summaries_stay_small():
    """A block that only falls has as many record lows as rows, and one end for nearly all."""
    fold = segmented.Turns(5.0)
    assert len(json.dumps(fold.block(series(None, 50_000, "fall"), 0))) < 1000
    assert len(json.dumps(fold.block(series(random.Random(1), 50_000, "walk"), 0))) < 20_000


def test_one_series_of_a_million_ticks(spark):
    """One symbol in at least eight blocks, each a task's; pivots as in the loop over all of it."""
    rng = random.Random(12)
    n, x, close = 1_000_000, 100.0, []
    for _ in range(n):
        x *= 1 + rng.uniform(-0.004, 0.00401)
        close.append(x)
    import pandas as pd

    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "date": pd.date_range(start, periods=n, freq="s"), "close": close})).repartition(8)
    dealt = segmented.deal(df, "symbol", "date", blocks=12)
    sizes = [r["count"] for r in dealt.rows.groupBy("symbol", "_b").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < n / 6
    got = segmented.zigzag(df, 3.0, blocks=12).where("pivot <> 0").select(F.unix_timestamp("date").alias("t"), "pivot").collect()

    first = df.agg(F.min(F.unix_timestamp("date"))).first()[0]
    want = plain_zigzag(close, 3.0)
    assert {(r.t - first, r.pivot) for r in got} == {(i, p) for i, p in enumerate(want) if p} and len(got) > 1000


def test_running_in_blocks(spark):
    rng = random.Random(2)
    rows = [(s, datetime.date(2020, 1, 1) + datetime.timedelta(i), rng.choice((None, None, rng.randint(-50, 50)))) for s in ("a", "b", None) for i in range(rng.randint(50, 90))]
    df = spark.createDataFrame(rows, "symbol string, date date, x long").repartition(3)
    for how in ("sum", "max", "min", "last"):
        got = {(r.symbol, r.date): r.y for r in segmented.running(df, "x", "y", how, blocks=9).collect()}
        for s in ("a", "b", None):
            value = None
            for _, day, x in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
                if x is not None:
                    value = x if value is None or how == "last" else {"sum": value + x, "max": max(value, x), "min": min(value, x)}[how]
                assert got[(s, day)] == value
    assert segmented.running(df.limit(0), "x", "y").count() == 0 and segmented.zigzag(df.limit(0).withColumn("close", F.lit(1.0))).count() == 0

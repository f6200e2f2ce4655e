"""Queries do the whole job: every position and day."""

import datetime

from marketloom.operators import relational
from marketloom.plans import catalog

D = "/root/testdata/sf0.001"


def test_range_state_of_every_position(spark):
    got = {(r["symbol"], r["at"]): r for r in catalog.queries()["range_state"](spark, D).collect()}
    bars = catalog.S.stand_in_bars(spark, D, "region").select("symbol", "date", "close").collect()
    for symbol in {b["symbol"] for b in bars}:
        close = [b["close"] for b in sorted(bars, key=lambda b: b["date"]) if b["symbol"] == symbol]
        for i in range(len(close)):
            past, ahead = close[max(0, i - 4) : i + 1], close[i + 1 : i + 3]
            r = got.pop((symbol, i + 1))
            assert (r["n"], r["n_ahead"]) == (len(past), len(ahead))
            assert abs(r["total"] - sum(past)) < 1e-6 and abs((r["ahead"] or 0) - sum(ahead)) < 1e-6
    assert not got


def test_next_trading_day_long_before_the_calendar(spark):
    day = datetime.date
    events = spark.createDataFrame([(day(2019, 1, 1),), (day(2020, 1, 3),), (day(2021, 1, 1),)], "day date")
    calendar = spark.createDataFrame([(day(2020, 1, 2),), (day(2020, 1, 6),)], "date date")
    got = {r["day"]: r["session"] for r in relational.next_trading_day(events, calendar).collect()}
    assert got == {day(2019, 1, 1): day(2020, 1, 2), day(2020, 1, 3): day(2020, 1, 6), day(2021, 1, 1): None}

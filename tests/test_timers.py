"""Streams over several batches: timers emit without a further event, state expires, restarts go on, joins equal the batch form."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from marketloom.operators import relational
from marketloom.streaming import timers

START = dt.datetime(2024, 3, 4, 9, 30)


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.state_conf(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={n}")


def through(spark, df, path, mode="append", once=False):
    """What a query gives until its files are read; it goes on from its checkpoint."""
    got = []
    trigger = {"once": True} if once else {"availableNow": True}
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(**trigger).foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).start()
    q.awaitTermination()
    return got, q.recentProgress


TICK = "symbol string, ts timestamp, price double, size double"


def plain_bars(ticks, seconds):
    out = {}
    for s, t, p, v in sorted(ticks, key=lambda x: x[1]):
        k = (s, START + dt.timedelta(seconds=int((t - START).total_seconds()) // seconds * seconds))
        o = out.setdefault(k, [p, p, p, p, 0.0])
        o[1], o[2], o[3], o[4] = max(o[1], p), min(o[2], p), p, o[4] + v
    return out


def test_bars_close_by_timers_and_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    ticks = [(s, START + dt.timedelta(seconds=i + j / 10), 100 + rng.random(), 1.0) for i in range(0, 600, 3) for j, s in enumerate("AB") if s == "B" or i < 200]
    for n in range(6):
        put(spark, [t for t in ticks if n * 100 <= (t[1] - START).total_seconds() < (n + 1) * 100], TICK, f"{tmp_path}/in", n)
        if n in (2, 5):
            stream = spark.readStream.schema(TICK + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("part")
            got, progress = through(spark, timers.closed_bars(stream, 60, "10 seconds"), tmp_path)
            if n == 2:
                first = got
                assert len(progress) >= 3
    got = first + got
    want = {k: tuple(v) for k, v in plain_bars(ticks, 60).items() if k[1] + dt.timedelta(seconds=70) <= max(t[1] for t in ticks)}
    assert {r[:2]: r[2:] for r in got} == {k: pytest.approx(v) for k, v in want.items()} and len(got) == len(want)
    # A's last bar is out though A had no further tick, and its state is gone
    assert ("A", START + dt.timedelta(seconds=180)) in want
    assert first and max(r[1] for r in first) < max(r[1] for r in got)


def test_late_ticks_are_dropped(spark, tmp_path):
    put(spark, [("A", START, 1.0, 1.0), ("A", START + dt.timedelta(seconds=300), 2.0, 1.0)], TICK, f"{tmp_path}/in", 0)
    put(spark, [("A", START + dt.timedelta(seconds=1), 9.0, 1.0), ("A", START + dt.timedelta(seconds=301), 3.0, 1.0), ("B", START + dt.timedelta(seconds=900), 3.0, 1.0)], TICK, f"{tmp_path}/in", 1)
    stream = spark.readStream.schema(TICK + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("part")
    got, _ = through(spark, timers.closed_bars(stream, 60), tmp_path)
    assert sorted(r[:1] + r[2:] for r in got) == [("A", 1.0, 1.0, 1.0, 1.0, 1.0), ("A", 2.0, 3.0, 2.0, 3.0, 2.0)]


def test_items_expire(spark, tmp_path):
    schema = "symbol string, ts timestamp, text string"
    at = lambda i: START + dt.timedelta(seconds=i)
    put(spark, [("A", at(i), f"a{i}") for i in range(4)] + [("B", at(0), "b0")], schema, f"{tmp_path}/in", 0)
    stream = lambda: timers.recent_items(spark.readStream.schema(schema + ", part int").parquet(f"{tmp_path}/in").drop("part"), 3, ttl=12)
    got, _ = through(spark, stream(), tmp_path, "update", once=True)  # by the clock, a stream has always a next batch
    assert {r[0]: r[3] for r in got} == {"A": ["a1", "a2", "a3"], "B": ["b0"]}
    put(spark, [("B", at(1), "b1")], schema, f"{tmp_path}/in", 1)
    got, _ = through(spark, stream(), tmp_path, "update", once=True)  # by the clock, a stream has always a next batch
    assert {r[0]: r[3] for r in got} in ({"B": ["b0", "b1"]}, {"B": ["b1"]})  # the second where the batches were slow
    time.sleep(13)
    put(spark, [("A", at(9), "a9"), ("B", at(9), "b9")], schema, f"{tmp_path}/in", 2)
    got, _ = through(spark, stream(), tmp_path, "update", once=True)  # by the clock, a stream has always a next batch
    assert {r[0]: (r[1], r[3]) for r in got} == {"A": (1, ["a9"]), "B": (1, ["b9"])}


def test_news_meet_sessions_of_another_stream(spark, tmp_path):
    rng = random.Random(5)
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(i) for i in range(120)]
    opens = [d for d in days if d.weekday() < 5 and rng.random() > 0.1]
    sessions = [(o, p) for o, p in zip(opens, [None, *opens])]
    news = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(118 * 24))) for i in range(500)]
    for n in range(8):
        lo, hi = dt.datetime(2024, 1, 1) + dt.timedelta(15 * n), dt.datetime(2024, 1, 1) + dt.timedelta(15 * (n + 1))
        # some news come one batch late
        put(spark, [x for x in news if (lo <= x[1] < hi and x[0] % 7) or (lo - dt.timedelta(15) <= x[1] < lo and not x[0] % 7)] + ([x for x in news if x[1] >= lo and not x[0] % 7] if n == 7 else []), "id long, ts timestamp", f"{tmp_path}/news", n)
        put(spark, [s for s in sessions if lo <= s[0] < hi], "opens timestamp, previous timestamp", f"{tmp_path}/sessions", n)
    read = lambda name, schema: spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}").drop("part")
    joined = timers.next_sessions(read("news", "id long, ts timestamp"), read("sessions", "opens timestamp, previous timestamp"), late="16 days", reach_days=10, salts=2).select("id", "opens")
    got, progress = through(spark, joined, tmp_path)
    calendar = spark.createDataFrame([(o.date(),) for o in opens], "date date")
    asked = spark.createDataFrame([(i, t, (t if t == t.replace(hour=0) else t + dt.timedelta(1)).date()) for i, t in news], "id long, ts timestamp, day date")
    want = {r["id"]: r["session"] for r in relational.next_trading_day(asked, calendar).collect()}
    assert {i: o.date() for i, o in got} == {i: d for i, d in want.items() if d is not None} and len(got) == sum(d is not None for d in want.values())
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress if p["stateOperators"]]
    assert len(held) >= 8 and max(held) < 0.6 * (len(news) + 4 * len(sessions)) and sum(s["numRowsRemoved"] for p in progress for s in p["stateOperators"]) > 200

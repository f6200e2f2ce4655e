"""Versions of a log store and claims of jobs, with writers and drivers at the same time."""

import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import commits, leases, store


def rows_of(df):
    return {r.id: r.value for r in df.collect()}


def size_of(path):
    return {f: f.stat().st_size for f in path.rglob("*.parquet")}


def test_changes_write_what_they_change(spark, tmp_path):
    s = store.LogStore(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError):
        s.rows()
    base = spark.range(50_000).select("id", (F.col("id") * 2.0).alias("value"), F.lit(False).alias("gone"))
    assert s.change(base).number == 1
    before = size_of(tmp_path)
    change = spark.createDataFrame([(3, 1.5, False), (7, None, True), (60_000, 9.0, None), (8, None, False)], "id long, value double, gone boolean")
    assert s.change(change).number == 2
    added = {f: n for f, n in size_of(tmp_path).items() if f not in before}
    assert sum(added.values()) < sum(before.values()) / 20 and not set(before) - set(size_of(tmp_path))
    want = {i: i * 2.0 for i in range(50_000)} | {3: 1.5, 60_000: 9.0, 8: None}
    del want[7]
    assert rows_of(s.rows()) == want and rows_of(s.rows(1)) == {i: i * 2.0 for i in range(50_000)}
    old = s.rows(2)  # opened before the compaction
    assert s.compact().number == 3 and len(s.version().segments) == 1 and rows_of(s.rows()) == want == rows_of(old)
    s.change(spark.createDataFrame([(7, 70.0)], "id long, value double"))
    assert rows_of(s.rows()) == want | {7: 70.0}
    assert len(s.vacuum()) == 2 and rows_of(s.rows()) == want | {7: 70.0}
    with pytest.raises(ValueError):
        s.change(spark.createDataFrame([(1, "x")], "id long, value string"))
    with pytest.raises(ValueError):
        s.rows(99)


def test_writers_at_the_same_time(spark, tmp_path):
    """Every commit is in the end, whoever comes first; a compaction meanwhile loses none."""
    s, errors = store.LogStore(spark, f"{tmp_path}/s"), []
    s.change(spark.createDataFrame([(0, 0.0)], "id long, value double"))

    def write(k):
        try:
            for i in range(3):
                s.change(spark.createDataFrame([(1 + k * 10 + i, float(k)), (1000, float(k))], "id long, value double"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    def fold():
        for _ in range(2):
            try:
                s.compact()
            except store.Conflict:
                pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)] + [threading.Thread(target=fold)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = rows_of(s.rows())
    assert not errors and {k: v for k, v in got.items() if k < 1000} == {0: 0.0} | {1 + k * 10 + i: float(k) for k in range(4) for i in range(3)} and got[1000] in range(4)
    assert commits.names(spark, f"{tmp_path}/s/log") == [f"{n:012d}.json" for n in range(1, s.version().number + 1)]
    now = s.version().number
    s.change(spark.createDataFrame([(5, 5.0)], "id long, value double"), expected=now)
    with pytest.raises(store.Conflict):
        s.change(spark.createDataFrame([(5, 6.0)], "id long, value double"), expected=now)
    assert rows_of(s.rows())[5] == 5.0


def test_one_claim_each(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(commits.create_once(spark, f"{tmp_path}/x/once", str(k)))) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 11 + [True] and commits.names(spark, f"{tmp_path}/x") == ["once"]


def test_a_lost_driver_is_followed(spark, tmp_path):
    now = [100.0]
    a, b = (leases.Leases(spark, f"{tmp_path}/l", ttl=10, owner=o, clock=lambda: now[0]) for o in "ab")
    job = ("s", "w", "t")
    assert a.state(job) == ("open", 0) and a.claim(job) == 1 and b.claim(job) is None
    now[0] += 8
    a.beat(job, 1)
    now[0] += 8
    assert b.claim(job) is None and b.state(job) == ("held", 1)
    now[0] += 3
    assert b.state(job) == ("stale", 1) and b.claim(job) == 2 and a.claim(job) is None
    # the first driver comes back: one of both finishes the job, the other is told so
    assert b.finish(job, 2, "of b") and not a.finish(job, 1, "of a") and a.state(job)[0] == "done" and a.claim(job) is None
    assert [(r["owner"], r["result"]) for r in a.results()] == [("b", "of b")]


def test_two_drivers_run_each_job_once(spark, tmp_path):
    keys = [("s1", "w", f"t{i:02}") for i in range(11)]
    jobs = spark.createDataFrame(keys, "setup string, window string, ticker string")
    data = jobs.withColumn("x", F.explode(F.array(*map(F.lit, (1.0, 2.0, 4.0)))))
    runs = f"{tmp_path}/runs"
    (tmp_path / "runs").mkdir()

    def fn(key, rows):
        import uuid

        open(f"{runs}/{key[2]}-{uuid.uuid4().hex}", "w").close()
        if key[2] == "t03":
            raise ValueError("bad")
        return pd.DataFrame({"total": [rows["x"].sum()]})

    done = []
    drivers = [leases.Leases(spark, f"{tmp_path}/l", ttl=60, owner=o) for o in "ab"]
    threads = [threading.Thread(target=lambda d=d: done.append(leases.run_shared(jobs, data, fn, "total double", d, most=2))) for d in drivers]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(done) == 11 and sorted(f.name[:3] for f in (tmp_path / "runs").iterdir()) == [k[2] for k in keys]
    got = {r.ticker: (r.status, r.total) for r in leases.shared_results(drivers[0], "total double").collect()}
    assert got == {k[2]: ("complete", 7.0) for k in keys} | {"t03": ("failed", None)}
    # nothing is left, for a third driver either
    assert leases.run_shared(jobs, data, fn, "total double", leases.Leases(spark, f"{tmp_path}/l"), most=2) == 0 and len(list((tmp_path / "runs").iterdir())) == 11

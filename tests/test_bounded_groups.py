"""Groups and batches stay small however many rows a symbol has, and the results do not depend on their size."""

from pyspark.sql import functions as F

from marketloom.operators import memory
from marketloom.plans import streamed
from marketloom.streaming import replay

D = "/root/testdata/sf0.001"


def test_memories_of_one_symbol_are_in_many_groups(spark, monkeypatch):
    items = spark.range(60).select(F.lit("s").alias("symbol"), "id", F.lit("short").alias("layer"), F.lit(70.0).alias("importance"), (F.col("id") % 9 + 1).alias("day"))
    feed = items.where("id % 4 = 0").select("symbol", "id", (F.col("day") + 1).alias("day"), F.lit(1).alias("value"))
    whole = set(memory.lifecycle(items, 12, feed).collect())
    monkeypatch.setattr(memory, "GROUP", 10)
    got = memory.lifecycle(items, 12, feed)
    assert "_part" in got._jdf.queryExecution().analyzed().toString()
    assert set(got.collect()) == whole and len(whole) == 60


def test_decay_by_batches_of_steps(spark, monkeypatch):
    whole = {tuple(r) for r in streamed.stream_decay(spark, D).collect()}
    monkeypatch.setattr(streamed, "SLICE", 300)
    sizes, real = [], streamed.to_the_end

    def watched(df, *rest):
        got = real(df, *rest)
        sizes.extend(r["count"] for r in got.where("status = 'new'").groupBy("batch").count().collect())
        assert got.where("status = 'late'").count() == 0
        return got

    monkeypatch.setattr(streamed, "to_the_end", watched)
    assert {tuple(r) for r in streamed.stream_decay(spark, D).collect()} == whole
    assert len(sizes) > 1 and max(sizes) <= 320


def test_recent_sends_the_last_of_each_task(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 5, "y"), ("a", 5, "z"), ("a", 2, "w"), (None, 3, "n"), ("b", 1, None)]
    spark.createDataFrame(rows, "g string, s long, t string").select("g", F.timestamp_seconds("s").alias("at"), "t").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("g string, at timestamp, t string").parquet(f"{tmp_path}/in")
    df = replay.recent(stream, "g", "at", "t", 2)
    assert "MapInPandas" in df._jdf.queryExecution().analyzed().toString()
    got = {r.by: r["items"] for r in streamed.to_the_end(df, spark, "recent", "update").collect()}
    assert got == {"a": ["y", "z"], None: ["n"], "b": [None]}

"""Queries that run as streams over the events table, read to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.folders import shared
from ..streaming import replay as Y
from ..streaming import timers as M
from ..streaming.bars import tick_bars
from .base import TICKS, query, table


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the folder as a stream of its files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", 1).parquet(d)


def to_the_end(df: DataFrame, spark: SparkSession, name: str, mode: str) -> DataFrame:
    """The rows that a stream gives until its source is read, written in the shared folder with the number of their batch."""
    path = shared(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/out")


def last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key that the last batch gave."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"))


@query("WITH " + TICKS + " SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_min(price, t.ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, t.ts) AS close, sum(size) AS volume FROM t GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, t.ts)")
def stream_tumbling(spark, d):
    """Hourly bars of the events as a stream; every batch gives the bars it changed."""
    bars = tick_bars(ticks(stream(spark, d, "events")), "1 hour", late="400 days")
    return last_of(to_the_end(bars, spark, "tumbling", "update"), ["symbol", "ts"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("WITH " + TICKS + """, s AS (SELECT symbol, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS ts, t.ts AS at, price FROM t)
SELECT symbol, ts, max(price) AS high, min(price) AS low, count(*)::DOUBLE AS volume FROM s GROUP BY symbol, ts""")
def stream_sliding(spark, d):
    """Bars of two hours every hour, as a stream."""
    bars = tick_bars(ticks(stream(spark, d, "events")), "2 hours", "1 hour", late="400 days")
    return last_of(to_the_end(bars, spark, "sliding", "update"), ["symbol", "ts"]).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "high", "low", "volume")


@query("WITH r AS (SELECT event_type, ts, props, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, props DESC) AS r FROM events) SELECT event_type AS \"by\", count(*) AS n, max(epoch_us(ts)) AS newest FROM r WHERE r <= 5 GROUP BY event_type")
def stream_recent(spark, d):
    """The last five events of each type, from a stream whose state holds no more than those."""
    got = Y.recent(stream(spark, d, "events"), "event_type", "ts", "props")
    rows = last_of(to_the_end(got, spark, "recent", "update"), ["by"])
    newest = table(spark, d, "events").groupBy(F.col("event_type").alias("by")).agg(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.max("ts")).alias("newest"))
    return rows.join(newest, "by").select("by", F.size("items").cast("long").alias("n"), "newest")


def daily(events: DataFrame) -> DataFrame:
    """Daily bars with a signal from the day's own prices, by event type."""
    g = events.groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date")).agg(F.min_by("value", "ts").alias("open"), F.max_by("value", "ts").alias("close"))
    return g.withColumn("signal", F.when(F.col("close") > F.col("open"), 1).otherwise(-1))


@query("WITH RECURSIVE g AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, arg_max(value, ts) AS close FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, CASE WHEN close > open THEN 1 ELSE -1 END AS signal FROM g), "
"e AS (SELECT ticker, date, n, signal, close, 100000.0::DOUBLE AS cash, 0::BIGINT AS shares FROM n WHERE n = 1 UNION ALL SELECT n.ticker, n.date, n.n, n.signal, n.close, CASE WHEN e.signal = 1 AND e.shares = 0 THEN e.cash - floor(e.cash / n.open) * n.open WHEN e.signal = -1 AND e.shares > 0 THEN e.cash + e.shares * n.open ELSE e.cash END, "
"CASE WHEN e.signal = 1 AND e.shares = 0 THEN floor(e.cash / n.open)::BIGINT WHEN e.signal = -1 THEN 0 ELSE e.shares END FROM e JOIN n ON n.ticker = e.ticker AND n.n = e.n + 1) SELECT ticker, date, round(cash + shares * close, 4) AS equity, shares FROM e")
def stream_replay(spark, d):
    """Accounts by ticker over a stream of daily bars; a signal is filled at the next bar's open."""
    path = shared(spark, "bars")
    daily(table(spark, d, "events").where("value > 0")).coalesce(1).write.parquet(path)
    bars = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = to_the_end(Y.replay(bars), spark, "replay", "append")
    return got.where("status = 'ok'").select("ticker", "date", F.round("equity", 4).alias("equity"), "shares")


@query("WITH m AS (SELECT event_type AS symbol, event_id AS id, (event_id // 20)::INT AS step, value AS importance FROM events), l AS (SELECT symbol, max(step) AS last FROM m GROUP BY symbol), "
"s AS (SELECT m.symbol, m.id, n.step AS step, importance * pow(0.92::DOUBLE, n.step - m.step) AS importance, exp(-(n.step - m.step) / 3.0::DOUBLE) AS recency FROM m JOIN (SELECT DISTINCT symbol, step FROM m) n ON n.symbol = m.symbol AND n.step > m.step AND n.step <= m.step + 60) "
"SELECT symbol, id, min(step) AS step FROM s WHERE recency < 0.05 OR importance < 5 GROUP BY ALL")
def stream_decay(spark, d):
    """When each memory of a stream falls under a threshold; the state holds those above both."""
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.expr("cast(event_id div 20 as int)").alias("step"), F.col("event_id").alias("id"), F.col("value").alias("importance"))
    got = to_the_end(Y.decaying(in_steps(e, spark, "memories", "step")), spark, "decay", "append")
    return got.where("status = 'gone'").select("symbol", "id", "step")


#: Rows of a batch of ``in_steps``.
SLICE = 500_000


def in_steps(df: DataFrame, spark: SparkSession, name: str, at: str) -> DataFrame:
    """``df`` as a stream of batches in order of the number ``at``, each of about ``SLICE`` rows if its numbers lie evenly.

    One pass deals the rows to folders by slice; a slice at a time is then added to the
    stream's folder as a file, so that batches keep their order and no number is in two of them.
    """
    staged, path = shared(spark, f"{name}-staged"), shared(spark, name)
    ends = df.agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).first()
    slices, low = max(1, -(-ends["n"] // SLICE)), ends["a"] or 0
    width = ((ends["b"] or 0) - low) // slices + 1
    own = F.coalesce(F.floor((F.col(at) - low) / width), F.lit(0)).cast("int")
    df.withColumn("slice", own).repartition(slices, "slice").write.partitionBy("slice").parquet(staged)
    held = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("slice", T.IntegerType())])).parquet(staged)
    for k in range(slices):
        held.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def in_slices(df: DataFrame, spark: SparkSession, name: str, at: str, slices: int = 4) -> DataFrame:
    """``df`` as a stream of several batches in order of ``at``: a folder for each slice of its time, one batch a folder."""
    path = shared(spark, name)
    ends = df.agg(F.min(F.unix_micros(at)).alias("a"), F.max(F.unix_micros(at)).alias("b")).first()
    step = ((ends["b"] or 0) - (ends["a"] or 0)) // slices + 1
    for k in range(slices):
        own = F.floor((F.unix_micros(at) - F.lit(ends["a"] or 0)) / step) == k
        df.where(own).coalesce(1).write.parquet(f"{path}/slice={k}")  # a file of one batch, so that batches keep their order
    schema = T.StructType([*df.schema.fields, T.StructField("slice", T.IntegerType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).drop("slice")


@query("WITH " + TICKS + """, b AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, max(price) AS high, min(price) AS low, sum(size) AS volume FROM t GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, t.ts))
SELECT symbol, epoch(ts)::BIGINT AS ts, high, low, volume FROM b WHERE ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM t)""")
def stream_closed_bars(spark, d):
    """Hourly bars of the events that timers close while the stream goes on: those an hour behind its last event."""
    ticks_ = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.timestamp_micros(_micros("ts")).alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    M.state_conf(spark)
    try:
        got = to_the_end(M.closed_bars(in_slices(ticks_, spark, "ticks", "ts"), 3600, "1 hour"), spark, "closed", "append")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return got.select("symbol", F.unix_seconds("ts").alias("ts"), "high", "low", "volume")


def _micros(ts: str):
    """A time of day without a zone as microseconds, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


@query("""WITH c AS (SELECT opens, lag(opens) OVER (ORDER BY opens) AS previous FROM (SELECT DISTINCT CAST(ts AS DATE) + 1 AS opens FROM events WHERE isodow(CAST(ts AS DATE) + 1) < 6))
SELECT event_id, epoch(opens)::BIGINT AS opens FROM events JOIN c ON ts <= opens AND (previous IS NULL OR ts > previous) AND opens <= ts + INTERVAL 31 DAY""")
def stream_news_sessions(spark, d):
    """Events of a stream with the next session of another: midnights before weekdays, after a day with events."""
    e = table(spark, d, "events").select("event_id", F.timestamp_micros(_micros("ts")).alias("ts"), F.col("ts").cast("timestamp_ntz").alias("own"))
    opens = e.select(F.date_add(F.col("own").cast("date"), 1).alias("day")).distinct().where("weekday(day) < 5")
    opens = opens.withColumn("previous", F.lag("day").over(W.orderBy("day")))  # one row a day
    at = lambda c: F.timestamp_micros(_micros(c)).alias("opens" if c == "day" else c)
    news, sessions = in_slices(e.drop("own"), spark, "news", "ts"), in_slices(opens.select(at("day"), at("previous")), spark, "sessions", "opens")
    got = to_the_end(M.next_sessions(news, sessions, late="400 days"), spark, "joined", "append")
    return got.select("event_id", F.unix_seconds("opens").alias("opens"))

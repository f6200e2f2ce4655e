"""The named data source, clustered folders, functions of SQL, and a database by JDBC."""

import datetime

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from marketloom.operators import indicators as I
from marketloom.operators import select as T
from marketloom.operators import sqlnames
from marketloom.sources import datasource, layout
from marketloom.sources import market as S


@pytest.fixture(scope="module")
def bars(spark):
    days = spark.range(3 * 365).select(F.date_add(F.lit("2019-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("n"))
    df = days.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.format_string("S%02d", i))).alias("symbol"))
    price = 100 + F.pmod(F.xxhash64("symbol", "n"), F.lit(1000)) / 50
    return df.select("date", "symbol", F.lit("1").alias("cik"), *[price.alias(c) for c in ("open", "high", "low", "close", "adjusted_close")], F.lit(5.0).alias("volume"), F.year("date").alias("year")).cache()


@pytest.fixture(scope="module")
def folder(spark, bars, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('market')}"
    layout.write_clustered(bars.select(*[f.name for f in S.PRICE]), f"{path}/price_daily", files=12, group_bytes=16_000)
    datasource.register(spark)
    return path


@pytest.mark.parametrize("pushdown", [False, True])
def test_source_reads_what_is_asked(spark, bars, folder, pushdown):
    load = lambda **o: spark.read.format("marketloom").options(path=folder, pushdown=pushdown, **o).load()
    df = load()
    assert df.schema == S.PRICE and df.count() == bars.count() == 40 * 1095
    key = ["date", "symbol", "close", "year"]
    for where in ("symbol = 'S07' AND date >= '2020-03-01' AND date < '2020-04-01'", "year = 2021 AND symbol IN ('S01', 'S39', 'ZZ')", "date = '2019-12-31'", "close > 119 AND year > 2019", "symbol IS NULL", "symbol LIKE 'S3%' AND year <= 2019", "volume = 5.0 OR year = 2020"):
        assert sorted(map(tuple, load().where(where).select(*key).collect())) == sorted(map(tuple, bars.where(where).select(*key).collect())), where
    files = load().rdd.getNumPartitions()
    some = load(first="2020-02-01", last="2020-05-01", symbols="S07,S08")
    year = some.rdd.getNumPartitions()
    assert year <= files // 2 and some.count() == 2 * 91 and {r.symbol for r in some.collect()} == {"S07", "S08"}
    assert load().where("year = 2020").rdd.getNumPartitions() == (year if pushdown else files) == load().where("date BETWEEN '2020-02-01' AND '2020-05-01'").rdd.getNumPartitions()
    assert load().where("year = 1999").count() == 0
    with pytest.raises(Exception, match="one of the tables"):
        spark.read.format("marketloom").option("path", folder).option("table", "prices").load()
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW prices USING marketloom OPTIONS (path '{folder}', table 'price')")
    assert spark.sql("SELECT count(*) FROM prices WHERE symbol = 'S11' AND year = 2020").first()[0] == 366


def test_reader_prunes_files_and_row_groups(folder):
    reader = datasource.PushedReader(f"{folder}/price_daily", S.PRICE)
    every = [p.year for p in reader.partitions()]
    rest = list(reader.pushFilters([D.EqualTo(("year",), 2020), D.EqualTo(("symbol",), "S07"), D.IsNotNull(("symbol",)), D.GreaterThan(("close",), 1.0)]))
    assert [type(f) for f in rest] == [D.IsNotNull, D.GreaterThan] and [p.year for p in reader.partitions()] == [2020] * every.count(2020)
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 366


def test_source_as_a_stream_by_day(spark, bars, folder, tmp_path):
    days = []

    def run(limit=None):
        stream = spark.readStream.format("marketloom").option("path", folder).option("daysPerBatch", 200).load()
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, n: days.append(tuple(b.agg(F.min("date"), F.max("date"), F.count("*")).first()))).start()
        q.processAllAvailable()
        q.stop()

    run()
    start, end = datetime.date(2019, 1, 1), datetime.date(2021, 12, 30)
    got = [d for d in days if d[2]]
    assert len(got) == 6 and got[0][0] == start and got[-1][1] == end and sum(d[2] for d in got) == bars.count()
    assert all(a[1] + datetime.timedelta(1) == b[0] for a, b in zip(got, got[1:]))
    run()  # from the checkpoint: nothing is new
    assert sum(d[2] for d in days) == bars.count()


def test_clustered_folders_are_read_in_part(spark, bars, folder, tmp_path):
    plain = f"{tmp_path}/plain"
    bars.repartition(12).write.option("parquet.block.size", 16_000).option("parquet.page.size.row.check.min", 100).option("parquet.page.size.row.check.max", 1000).partitionBy("year").parquet(plain)
    ask = lambda path: spark.read.parquet(path).where("symbol = 'S23' AND year = 2020")
    a, b = layout.rows_scanned(ask(f"{folder}/price_daily")), layout.rows_scanned(ask(plain))
    assert ask(f"{folder}/price_daily").count() == ask(plain).count() == 366
    # all rows of the year without clusters; with them little more than the symbol's
    assert b == 40 * 366 and a <= b / 8
    # a value within the range of a group, but in none: the Bloom filter leaves all out
    assert layout.rows_scanned(spark.read.parquet(f"{folder}/price_daily").where("symbol = 'S23x'")) == 0


def test_sql_functions_equal_the_frames(spark, bars):
    assert set(sqlnames.register(spark)) >= {"sma_signals", "momentum_symbols", "whole_shares"}
    bars.createOrReplaceTempView("bars_of_test")
    got = spark.sql("SELECT symbol, date, signal FROM sma_signals(TABLE(SELECT symbol, date, close FROM bars_of_test) PARTITION BY symbol ORDER BY (date), 10, 20)")
    want = I.cross(bars, I.sma(n=10), I.sma(n=20), "signal").select("symbol", "date", "signal")
    a, b = ({(r.symbol, r.date): r.signal for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and sum(a[k] != b[k] for k in a) == 0 and any(a.values())
    got = spark.sql("SELECT * FROM momentum_symbols(TABLE(SELECT 'w' AS win, symbol, date, close FROM bars_of_test WHERE date < '2021-01-01') PARTITION BY win ORDER BY (symbol, date), 100, 21, 5)")
    want = T.momentum(bars, "2021-01-01", 100, 21, 5)
    assert sorted((r.symbol, round(r.score, 12), r["rank"]) for r in got.collect()) == sorted((r.symbol, round(r.score, 12), r["rank"]) for r in want.collect()) != []
    assert spark.sql("SELECT * FROM momentum_symbols(TABLE(SELECT 'w' AS win, symbol, date, close FROM bars_of_test) PARTITION BY win ORDER BY (symbol, date), 100, 21, 50)").count() == 0
    assert spark.sql("SELECT whole_shares(1000, 3, 0.5), adjust_ratio(0, 5), adjust_ratio(4, 2), decayed(10, 2, 0.5), compound_score(0.5, 300)").first()[:] == (166, 0.0, 0.5, 2.5, 1.5)


def test_trades_of_a_database(spark):
    url, options = "jdbc:derby:memory:trades;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(2000).select(
        F.col("id").alias("trade_id"), F.element_at(F.array(*map(F.lit, ("AAA", "BBB", "CCC"))), (F.col("id") % 3 + 1).cast("int")).alias("sym_root"), F.when(F.col("id") % 50 == 0, "X").alias("sym_suffix"),
        F.format_string("%02d:%02d:00", 8 + F.col("id") % 10, F.col("id") % 60).alias("time_m"), (F.col("id") % 7).alias("size"),
    ).cache()
    rows.write.jdbc(url, "trades", mode="overwrite", properties=options | {"createTableColumnTypes": "sym_root VARCHAR(8), time_m VARCHAR(12)"})
    got = S.read_trades(spark, url, "trades", symbols=["AAA", "CCC"], first="09:30:00", last="16:00:00", least_size=3, properties=options, partitions=4, key="trade_id", bounds=(0, 2000))
    want = S.trade_filter(rows, ["AAA", "CCC"], "09:30:00", "16:00:00", 3)
    assert sorted(r.trade_id for r in got.collect()) == sorted(r.trade_id for r in want.collect()) != []
    plan = got._jdf.queryExecution().executedPlan().toString().replace("`", "")
    pushed = plan.split("PushedFilters")[1]
    assert got.rdd.getNumPartitions() == 4 and "Filter" not in plan.split("Scan JDBC")[0]
    assert all(x in pushed.lower() for x in ("sym_root", "time_m", "size", "sym_suffix"))

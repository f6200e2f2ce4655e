"""Queries that write tables in the shared folder and read them back: partitioned sources, vendor files, result trees, resumed jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import jobs as O
from ..operators import sections as C
from ..operators import simulate as B
from ..operators.folders import shared
from ..sources import market as S
from .base import NB, RB, RET, query, table
from .simulated import _SECTIONS, filings


def _market(spark, d) -> str:
    """A folder of prices, news and filings by year, as ``open_market_data`` reads them."""
    path = shared(spark, "market")
    bars = S.stand_in_bars(spark, d).withColumns({"cik": F.lit("1"), "year": F.year("date")})
    bars.select(*[f.name for f in S.PRICE]).write.partitionBy("year").parquet(f"{path}/price_daily")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    day = o.select(F.to_date("o_orderdate").alias("date"), F.col("n_name").alias("symbol"), F.lit("1").alias("cik"), F.col("o_orderkey").alias("item_index"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("news_text"), F.year("o_orderdate").alias("year"))
    text = F.col("news_text")
    day.select("date", "symbol", "cik", "item_index", "news_text", F.length(text).cast("long").alias("text_len"), F.crc32(text.cast("binary")).alias("text_crc32"), "year").write.partitionBy("year").parquet(f"{path}/news_items")
    kept = day.select("date", "symbol", "cik", F.col("item_index").alias("filing_idx"), text.alias("filing_text"), "year", F.col("item_index").cast("string").alias("accession"))
    kept.where("filing_text LIKE '1%'").write.partitionBy("year").parquet(f"{path}/filingk")
    kept.where("filing_text LIKE '2%'").write.partitionBy("year").parquet(f"{path}/filingq")
    return path


_NEWS = """, w AS (SELECT CAST(o_orderdate AS DATE) AS date, n_name AS symbol, o_orderkey AS k, o_orderpriority || ' ' || o_orderkey AS text FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


@query(NB + " SELECT date, symbol, open, close, adjusted_close, volume FROM b WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-06-30' AND symbol IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_7')")
def scan_prices(spark, d):
    data = S.open_market_data(spark, _market(spark, d), modalities=("price",))
    return data.subset("1996-03-01", "1998-06-30", ["NATION_1", "NATION_3", "NATION_5", "NATION_7"]).price.select("date", "symbol", "open", "close", "adjusted_close", "volume")


@query(NB + _NEWS + " SELECT date, symbol, k AS item_index, text AS news_text, length(text) AS text_len FROM w WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-06-30' AND (date, symbol) IN (SELECT (date, symbol) FROM b)")
def scan_news(spark, d):
    data = S.open_market_data(spark, _market(spark, d), modalities=("price", "news"))
    return data.subset("1996-03-01", "1998-06-30").news.select("date", "symbol", "item_index", "news_text", "text_len")


@query("WITH x AS (SELECT 1)" + _NEWS + " SELECT date, symbol, k AS filing_idx, CASE WHEN text LIKE '1%' THEN '10-K' ELSE '10-Q' END AS form FROM w WHERE (text LIKE '1%' OR text LIKE '2%') AND year(date) BETWEEN 1996 AND 1997 AND symbol IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_7')")
def scan_filings(spark, d):
    return S.read_filings(spark, _market(spark, d), years=(1996, 1997), symbols=["NATION_1", "NATION_3", "NATION_5", "NATION_7"]).select("date", "symbol", "filing_idx", "form")


@query(NB + _NEWS + """, n AS (SELECT date, symbol, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT date, symbol, string_agg(text, chr(10) || chr(10) ORDER BY k) AS t FROM w WHERE text LIKE '1%' GROUP BY ALL), q AS (SELECT date, symbol, string_agg(text, chr(10) || chr(10) ORDER BY k) AS t FROM w WHERE text LIKE '2%' GROUP BY ALL)
SELECT date, symbol, b.close, n.n AS news, k.t AS filing_k, q.t AS filing_q FROM b FULL JOIN n USING (date, symbol) FULL JOIN k USING (date, symbol) FULL JOIN q USING (date, symbol)""")
def modalities_side_by_side(spark, d):
    got = S.open_market_data(spark, _market(spark, d)).day_records()
    return got.select("date", "symbol", "price.close", F.when(F.col("news").isNotNull(), F.size("news").cast("long")).alias("news"), "filing_k", "filing_q")


@query(NB + _NEWS + """, p AS (SELECT date, symbol, close FROM b WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-12-31'), n AS (SELECT date, symbol, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT date, symbol, arg_max(text, k) AS t FROM w WHERE text LIKE '1%' GROUP BY ALL), q AS (SELECT date, symbol, arg_max(text, k) AS t FROM w WHERE text LIKE '2%' GROUP BY ALL)
SELECT date, symbol, close, coalesce(n.n, 0) AS news, coalesce(k.t, '') AS filing_k, coalesce(q.t, '') AS filing_q FROM p LEFT JOIN n USING (date, symbol) LEFT JOIN k USING (date, symbol) LEFT JOIN q USING (date, symbol)""")
def agent_days(spark, d):
    got = S.open_market_data(spark, _market(spark, d)).agent_days("1996-03-01", "1996-12-31")
    return got.select("date", "symbol", "price.close", F.size("news").cast("long").alias("news"), "filing_k", "filing_q")


@query(NB + " SELECT DISTINCT symbol FROM b")
def scan_tickers(spark, d):
    return S.open_market_data(spark, loader=lambda s: S.MarketData(S.stand_in_bars(s, d))).tickers()


@query(RB + " SELECT symbol, date, open * r AS open, close * r AS close, volume, year(date)::INT AS year FROM (SELECT *, CASE WHEN close <> 0 THEN adjusted_close / close ELSE 0 END AS r FROM b)")
def vendor_csv(spark, d):
    path = shared(spark, "csv")
    names = {v: k for k, v in S.VENDORS["yahoo"].items()}
    S.stand_in_bars(spark, d, "region").withColumnsRenamed(names).write.option("header", True).csv(path)
    got = S.open_source(spark, "csv", path, vendor="yahoo", adjust=True)
    return got.select("symbol", "date", "open", "close", "volume", "year")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS symbol, o_orderpriority AS news_text, length(o_orderpriority) AS text_len FROM orders")
def vendor_news(spark, d):
    path = shared(spark, "news")
    o = table(spark, d, "orders")
    o.select(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("symbol"), F.col("o_orderpriority").alias("headline")).write.option("header", True).csv(path)
    return S.read_news_csv(spark, path, {"day": "date", "headline": "news_text"}).select("date", "symbol", "news_text", "text_len")


@query(RB + " SELECT date, symbol, open * (adjusted_close / close) AS open, adjusted_close AS close, volume FROM b WHERE symbol IN ('ASIA', 'EUROPE')")
def series_of_folder(spark, d):
    path = shared(spark, "series")
    S.stand_in_bars(spark, d, "region").write.parquet(path)
    return S.read_series(spark, path, ["ASIA", "EUROPE"]).select("date", "symbol", "open", "close", "volume")


@query(NB + RET + " SELECT year(date)::VARCHAR AS \"window\", symbol AS ticker, round(arg_max(equity, date) / arg_min(equity, date) - 1, 9) AS total_return, count(*) AS points FROM r GROUP BY ALL")
def result_tree(spark, d):
    """A result tree written and read back: each leaf's metrics, and its rows of the equity table."""
    from ..operators import metrics as M

    path = shared(spark, "results")
    r = M.returns(S.stand_in_bars(spark, d)).withColumns({"window": F.year("date").cast("string"), "ticker": F.col("symbol")})
    summary = r.groupBy("window", "ticker").agg(F.round(F.max_by("equity", "date") / F.min_by("equity", "date") - 1, 9).alias("total_return"))
    S.write_results(path, summary=summary, tables={"equity": r.select("window", "ticker", "date", "equity")}, config=B.TradeConfig())
    leaves = spark.read.schema("value string, window string, ticker string").text(f"{path}/metrics")
    points = spark.read.schema("date date, equity double, window string, ticker string").parquet(f"{path}/equity").groupBy("window", "ticker").agg(F.count("*").alias("points"))
    return leaves.select("window", "ticker", F.get_json_object("value", "$.total_return").cast("double").alias("total_return")).join(points, ["window", "ticker"])


def _total(key, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"orders": [len(rows)], "total": [rows["price"].sum()]})


def _total_but_f(key, rows: pd.DataFrame) -> pd.DataFrame:
    if key[2] == "F":
        raise RuntimeError("no data")
    return _total(key, rows)


@query("SELECT o_orderpriority AS setup, year(o_orderdate)::VARCHAR AS \"window\", o_orderstatus AS ticker, count(*) AS orders, round(sum(o_totalprice), 2) AS total, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS runs FROM orders GROUP BY ALL")
def resumed_jobs(spark, d):
    """A grid of jobs of which some fail, and a second run that takes up only those."""
    path = shared(spark, "jobs")
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("setup"), F.year("o_orderdate").cast("string").alias("window"), F.col("o_orderstatus").alias("ticker"), F.col("o_totalprice").alias("price"))
    jobs = o.select(*O.KEYS).distinct()
    for work in (_total_but_f, _total):
        O.run_jobs(jobs, o, work, "orders long, total double", path)
    runs = spark.read.schema(O.STATUS).parquet(f"{path}/status").groupBy(*O.KEYS).agg(F.count("*").alias("runs"))
    results = spark.read.schema("setup string, window string, ticker string, status string, error string, orders long, total double").parquet(f"{path}/results")
    return results.where("status = 'complete'").join(runs, list(O.KEYS)).select(*O.KEYS, "orders", F.round("total", 2).alias("total"), F.col("runs").cast("int").alias("runs"))


@query(f"SELECT doc_id, item_key, count(*) + 1 AS lines FROM (SELECT doc_id, item_key, unnest(range(line_start, line_end + 1)) AS l FROM ({_SECTIONS})) GROUP BY ALL")
def written_sections(spark, d):
    """Sections written as lines by item, and the lines of each filing's."""
    path = shared(spark, "sections")
    few = filings(spark, d)
    S.write_sections(C.filing_sections(few, "10-K", ("item_1", "item_7", "item_7a"), keep=("doc_id",)), path, keys=("doc_id",))
    texts = spark.read.schema("doc_id long, line int, value string, item_key string").json(f"{path}/sections")
    return texts.groupBy("doc_id", "item_key").agg(F.count("*").alias("lines"))


@query("SELECT role AS phase, count(*) AS n, max(conv_id) AS newest FROM conversations GROUP BY role")
def written_trace(spark, d):
    """An agent's records written by phase under their run's key, and read back."""
    c = table(spark, d, "conversations").select(F.col("role").alias("phase"), "conv_id", "turn", "text")
    path = S.write_trace(c, shared(spark, "trace"), {"agent": "a", "turns": 3})
    return spark.read.schema("conv_id long, turn long, text string, phase string").json(f"{path}/events").groupBy("phase").agg(F.count("*").alias("n"), F.max("conv_id").alias("newest"))


@query(RB + " SELECT symbol, date, close, CASE WHEN row_number() OVER w >= 5 THEN avg(close) OVER (w ROWS 4 PRECEDING) END AS sma5 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def written_features(spark, d):
    from ..operators import indicators as I

    path = shared(spark, "features")
    S.write_features(S.stand_in_bars(spark, d, "region").withColumn("sma5", I.sma(n=5)).select("symbol", "date", "close", "sma5"), path)
    return spark.read.schema("date date, close double, sma5 double, symbol string").parquet(path)

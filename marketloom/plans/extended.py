"""Queries of panels, joins, signals, metrics, selection, vectors and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import indicators as I
from ..operators import memory as V
from ..operators import metrics as M
from ..operators import names as Z
from ..operators import panel as P
from ..operators import relational as R
from ..operators import segmented as G
from ..operators import select as T
from ..operators import statistics as Q
from ..sources import market as S
from .base import NB, RB, RET, query, table, ticks


def nations(spark, d):
    return S.stand_in_bars(spark, d)


def regions(spark, d):
    return S.stand_in_bars(spark, d, "region")


# ---- panel preparation


@query(NB + """, h AS (SELECT *, row_number() OVER o AS n, avg(close) OVER (o ROWS 29 PRECEDING) AS s FROM b WHERE date >= DATE '1997-01-01' - 60 AND date < DATE '1998-01-01' WINDOW o AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, CASE WHEN n >= 30 THEN s END AS sma30 FROM h WHERE date >= DATE '1997-01-01'""")
def warmup_sma(spark, d):
    add = lambda df: df.withColumn("sma30", I.sma(n=30))
    return P.with_warmup(nations(spark, d), "1997-01-01", "1998-01-01", add).select("symbol", "date", "sma30")


@query(NB + " SELECT symbol, date, dense_rank() OVER (ORDER BY date) - 1 AS day, close FROM b WHERE date >= DATE '1996-01-01' AND date < DATE '1997-01-01'")
def split_days(spark, d):
    return P.split(nations(spark, d), "1996-01-01", "1997-01-01").select("symbol", "date", "day", "close")


@query("WITH w AS (SELECT i::INT AS win, (DATE '1995-01-01' + to_years(i::INT))::DATE AS lo FROM range(0, 3) t(i)), " + NB[5:] + """
SELECT win, symbol, CASE WHEN date < lo + INTERVAL 2 YEAR THEN 'train' ELSE 'trade' END AS part, count(*) AS n, min(date) AS first, max(date) AS last FROM b JOIN w ON date >= lo AND date < lo + INTERVAL 3 YEAR GROUP BY ALL""")
def train_trade_splits(spark, d):
    w = R.rolling_windows(spark, "1995-01-01", "2000-01-01", 3).where("win < 3").select("win", F.col("lo").alias("train_lo"), F.add_months("lo", 24).alias("train_hi"), F.col("hi").alias("trade_hi"))
    return P.train_trade(nations(spark, d), w).groupBy("win", "symbol", "part").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("SELECT event_id, ts FROM events WHERE strftime(ts, '%H:%M:%S') <> '16:00:00'")
def drop_close_ticks(spark, d):
    return P.without_close(table(spark, d, "events")).select("event_id", "ts")


@query(RB + ", m AS (SELECT symbol, date_trunc('month', date)::DATE AS date, max(close) AS close FROM b GROUP BY ALL) SELECT symbol, count(*) AS n FROM m GROUP BY symbol HAVING count(close) = (SELECT count(DISTINCT date) FROM m)")
def full_history_symbols(spark, d):
    months = regions(spark, d).groupBy("symbol", F.trunc("date", "MM").alias("date")).agg(F.max("close").alias("close"))
    return R.full_history(months).groupBy("symbol").agg(F.count("*").alias("n"))


@query(RB + " SELECT date, count(*) AS n FROM b GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM b)")
def complete_times(spark, d):
    return P.complete_times(regions(spark, d)).groupBy("date").agg(F.count("*").alias("n"))


@query(RB + """, o AS (SELECT symbol FROM b GROUP BY symbol HAVING count(DISTINCT date) > 0.5 * (SELECT count(DISTINCT date) FROM b)), k AS (SELECT * FROM b WHERE symbol IN (FROM o)),
c AS (SELECT date FROM k GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(*) FROM o)) SELECT symbol, date, close, dense_rank() OVER (ORDER BY date) - 1 AS day FROM k WHERE date IN (FROM c)""")
def mostly_present(spark, d):
    return P.mostly_present(regions(spark, d), 0.5).select("symbol", "date", "close", "day")


FLAGS = NB + """, v AS (SELECT symbol, date, coalesce(abs(p - open) > 0.2 * (p + open) AND p + open > 10, false) AS dirty FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM b))"""


@query(FLAGS + " SELECT symbol FROM v GROUP BY symbol HAVING count(*) FILTER (dirty) <= 500 AND bool_or(year(date) = 1996)")
def clean_universe(spark, d):
    return P.clean_universe(R.validation_flags(nations(spark, d)), 1999, 3, 500)


@query(FLAGS + " SELECT DISTINCT (year(date) + 3)::INT AS year, symbol FROM v WHERE symbol IN (SELECT symbol FROM v GROUP BY symbol HAVING count(*) FILTER (dirty) <= 500)")
def universe_by_year(spark, d):
    return P.universe_by_year(R.validation_flags(nations(spark, d)), 3, 500)


@query(NB + " SELECT symbol, count(*) AS n FROM b WHERE symbol IN (SELECT symbol FROM b GROUP BY symbol HAVING year(min(date)) <= 1998 - 2) GROUP BY symbol")
def enough_history(spark, d):
    return P.enough_history(nations(spark, d), "1998-01-01", 2).groupBy("symbol").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    return P.repeated(table(spark, d, "lineitem"), ("l_partkey", "l_suppkey"))


@query("SELECT o_orderpriority, count(*) AS n, 300 AS expected FROM orders GROUP BY o_orderpriority HAVING count(*) <> 300")
def wrong_counts(spark, d):
    o = table(spark, d, "orders")
    return P.wrong_counts(o, "o_orderpriority", o.select("o_orderpriority").distinct().withColumn("expected", F.lit(300)))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unaligned_keys(spark, d):
    return P.unaligned(table(spark, d, "documents"), table(spark, d, "labels"), ("doc_id",))


FACTOR = ", f AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS mkt, max(o_totalprice) AS smb FROM orders WHERE isodow(o_orderdate) = 1 GROUP BY ALL)"


def _factor(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice").where(F.weekday("date") == 0)
    return o.groupBy("date").agg(F.avg("o_totalprice").alias("mkt"), F.max("o_totalprice").alias("smb"))


@query(RB + FACTOR + " SELECT symbol, date, close, last_value(mkt / 100 IGNORE NULLS) OVER w AS mkt, last_value(smb / 100 IGNORE NULLS) OVER w AS smb FROM b LEFT JOIN f USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)")
def factor_join(spark, d):
    return P.with_factors(regions(spark, d), _factor(spark, d), ("mkt", "smb")).select("symbol", "date", "close", "mkt", "smb")


@query(RB + FACTOR + " SELECT symbol, date, close, mkt FROM b JOIN f USING (date)")
def day_series_join(spark, d):
    return P.with_day_series(regions(spark, d), _factor(spark, d).select("date", "mkt")).select("symbol", "date", "close", "mkt")


@query(RB + FACTOR + """, c AS (SELECT DISTINCT date FROM b), j AS (SELECT c.date, mkt, smb FROM c LEFT JOIN f USING (date))
SELECT date, coalesce(last_value(mkt IGNORE NULLS) OVER p, first_value(mkt IGNORE NULLS) OVER n) AS mkt, coalesce(last_value(smb IGNORE NULLS) OVER p, first_value(smb IGNORE NULLS) OVER n) AS smb FROM j
WINDOW p AS (ORDER BY date ROWS UNBOUNDED PRECEDING), n AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def series_join(spark, d):
    f = _factor(spark, d)
    return P.with_series(regions(spark, d).select("date").distinct(), {c: f.select("date", F.col(c).alias("value")) for c in ("mkt", "smb")})


@query(RB + " SELECT x.date, x.close AS asia, y.close AS europe, z.close AS africa FROM b x JOIN b y USING (date) JOIN b z USING (date) WHERE x.symbol = 'ASIA' AND y.symbol = 'EUROPE' AND z.symbol = 'AFRICA'")
def strategies_side_by_side(spark, d):
    b = regions(spark, d)
    one = lambda s: b.where(F.col("symbol") == s).select("date", F.col("close").alias("equity"))
    return P.side_by_side({s.lower(): one(s) for s in ("ASIA", "EUROPE", "AFRICA")})


@query("SELECT DISTINCT p.url, length(p.html) AS size FROM pages p JOIN (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) i USING (url)")
def url_join(spark, d):
    p = table(spark, d, "pages")
    return p.join(p.where("url IS NOT NULL").select("url").distinct(), "url").select("url", F.length("html").cast("long").alias("size")).distinct()


@query(RB + " SELECT date FROM (SELECT DISTINCT date FROM b) ORDER BY abs(date - DATE '1997-07-02'), date LIMIT 1")
def nearest_date(spark, d):
    return P.nearest_date(regions(spark, d), "1997-07-02")


@query("""WITH t AS (SELECT event_type AS symbol, time_bucket(INTERVAL 6 HOUR, ts) AS ts, sum(1.0::DOUBLE) AS volume, max(value) AS high FROM events GROUP BY ALL),
g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 6 HOUR)) AS ts FROM t GROUP BY symbol) SELECT g.symbol, g.ts, high, coalesce(volume, 0) AS volume FROM g LEFT JOIN t USING (symbol, ts)""")
def resample_with_empty_bins(spark, d):
    return P.resample_grid(R.resample(ticks(spark, d), "6 hours"), "6 hours").select("symbol", "ts", "high", "volume")


@query("SELECT o_orderkey, coalesce(avg(o_totalprice) OVER w, 0.5) AS price, sum(o_custkey) OVER w AS customers FROM orders WINDOW w AS (PARTITION BY CAST(o_orderdate AS DATE))")
def group_values(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customers"))
    return P.group_values(o, ("date",), ("price",), ("customers",)).select("o_orderkey", "price", "customers")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_of_each(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return P.first_of_each(o, ("o_custkey",), ("o_orderdate", "o_orderkey")).drop("o_orderdate")


@query("SELECT l_returnflag AS win, l_linestatus AS ticker, round(sum(l_tax), 6) AS commission, round(sum(l_discount), 6) AS slippage, round(sum(l_quantity), 6) AS external, round(sum(l_tax) + sum(l_discount) + sum(l_quantity), 6) AS total_cost FROM lineitem GROUP BY ALL")
def cost_rollup(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("win"), F.col("l_linestatus").alias("ticker"), F.col("l_tax").alias("commission"), F.col("l_discount").alias("slippage_cost"), "l_quantity")
    return M.cost_rollup(t, external="l_quantity").select("win", "ticker", *[F.round(c, 6).alias(c) for c in ("commission", "slippage", "external", "total_cost")])


@query("SELECT coalesce(r_name, 'Unknown') AS sector, sum(1.0::DOUBLE / 25) AS weight FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY ALL")
def sector_weights(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_name", "symbol")
    sectors = n.join(table(spark, d, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("symbol", F.col("r_name").alias("sector"))
    return P.sector_weights(n.select("symbol", F.lit(1.0 / 25).alias("weight")), sectors)


@query(NB + " SELECT DISTINCT symbol FROM b WHERE year(date) IN (1995, 1998)")
def symbols_of_windows(spark, d):
    b = nations(spark, d)
    return P.all_symbols([b.where(F.year("date") == y) for y in (1995, 1998)])


@query("SELECT n_name AS symbol FROM nation EXCEPT SELECT n_name FROM nation WHERE n_regionkey < 2")
def not_selected(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_name", "symbol")
    return P.not_selected(n, n.where("n_regionkey < 2"))


@query(RB + " SELECT date FROM b WHERE symbol = 'ASIA' INTERSECT SELECT date FROM b WHERE symbol = 'EUROPE' INTERSECT SELECT date FROM b WHERE symbol = 'AFRICA'")
def common_dates(spark, d):
    b = regions(spark, d)
    return P.common_dates([b.where(F.col("symbol") == s) for s in ("ASIA", "EUROPE", "AFRICA")])


@query(RB + " SELECT date, min(close) FILTER (symbol = 'ASIA') AS \"ASIA\", min(close) FILTER (symbol = 'EUROPE') AS \"EUROPE\" FROM b GROUP BY date")
def pivot_closes(spark, d):
    return P.widen(regions(spark, d), ["ASIA", "EUROPE"])


@query(RB + " SELECT date, symbol, close FROM b WHERE symbol IN ('ASIA', 'EUROPE')")
def unpivot_closes(spark, d):
    return P.lengthen(P.widen(regions(spark, d), ["ASIA", "EUROPE"]))


@query("SELECT doc_id AS item_index FROM documents ORDER BY md5('0/' || doc_id), doc_id LIMIT 20")
def sample_news(spark, d):
    return P.sample_news(table(spark, d, "documents").select(F.col("doc_id").alias("item_index")))


@query(NB + " SELECT symbol, date, coalesce(close / lag(close, 5) OVER w, 1) AS close, coalesce(volume / lag(volume, 5) OVER w, 1) AS volume FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def price_variation(spark, d):
    return P.variation(nations(spark, d), ("close", "volume"), k=5).select("symbol", "date", "close", "volume")


QUARTERS = """WITH q AS (SELECT o_orderpriority AS symbol, date_trunc('quarter', o_orderdate)::DATE AS date, sum(o_totalprice) AS rev, avg(o_totalprice) AS op_inc, max(o_totalprice) AS assets, count(*)::DOUBLE AS shares, min(o_totalprice) AS payables FROM orders GROUP BY ALL)"""


def _quarters(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("date"))
    q = o.agg(F.sum("o_totalprice").alias("rev"), F.avg("o_totalprice").alias("op_inc"), F.max("o_totalprice").alias("assets"), F.count("*").cast("double").alias("shares"), F.min("o_totalprice").alias("payables"))
    same = {"net_inc": "op_inc", "equity": "assets", "common_equity": "assets", "eps_incl_ex": "op_inc", "dividend": "payables", "cur_assets": "assets", "cur_liabilities": "rev", "cash_eq": "payables", "receivables": "op_inc", "cogs": "rev", "inventories": "payables", "liabilities": "payables"}
    return q.withColumns({k: F.col(v) for k, v in same.items()})


@query(QUARTERS + """, t AS (SELECT *, CASE WHEN row_number() OVER w > 3 THEN sum(op_inc) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS inc3, CASE WHEN row_number() OVER w > 3 THEN sum(rev) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS rev3 FROM q WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, coalesce(inc3 / rev3, 0) AS opm, coalesce(inc3 / assets, 0) AS roa, assets / shares AS bps, (payables + op_inc) / rev AS quick_ratio, coalesce(rev3 / payables, 0) AS inv_turnover, payables / assets AS debt_ratio FROM t""")
def fundamental_ratios(spark, d):
    return P.fundamentals(_quarters(spark, d)).select("symbol", "date", "opm", "roa", "bps", "quick_ratio", "inv_turnover", "debt_ratio")


@query(QUARTERS + """, p AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close FROM orders GROUP BY ALL)
SELECT p.symbol, p.date, coalesce(p.close / q.op_inc, 0) AS pe, coalesce(p.close / (q.assets / q.shares), 0) AS pb, coalesce(q.payables / p.close, 0) AS div_yield FROM p ASOF LEFT JOIN q ON p.symbol = q.symbol AND p.date >= q.date""")
def daily_valuations(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("close"))
    return P.valuations(p, P.fundamentals(_quarters(spark, d)))


@query("""WITH w AS (SELECT conv_id, turn, text, list_filter(str_split(coalesce(text, ''), ' '), lambda x: x <> '') AS w FROM conversations), u AS (SELECT *, len(w) AS n, sum(len(w)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM w)
SELECT conv_id, turn, CASE WHEN upto <= 60 THEN text ELSE array_to_string(w[1:greatest(60 - (upto - n), 1)], ' ') END AS text, least(n, 60 - (upto - n))::BIGINT AS tokens FROM u WHERE upto <= 60 OR 60 - (upto - n) > 0""")
def token_budget(spark, d):
    return P.keep_within_budget(table(spark, d, "conversations"), ("conv_id",), "turn", budget=60).select("conv_id", "turn", "text", "tokens")


# ---- signals


@query(NB + """, c AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM b)), j AS (SELECT symbol, date, volume, n FROM b JOIN c USING (date))
SELECT symbol, date, avg(volume) OVER w AS prior_volume, count(volume) OVER w AS observations FROM j WINDOW w AS (PARTITION BY symbol ORDER BY n RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def prior_volume_by_dates(spark, d):
    return I.prior_volume_by_dates(nations(spark, d))


@query(NB + """, v AS (SELECT symbol, date, close, CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) + 2 * stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS up,
CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) - 2 * stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS low FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, CASE WHEN lag(close) OVER o < lag(low) OVER o AND close >= low THEN 1 WHEN lag(close) OVER o > lag(up) OVER o AND close <= up THEN -1 ELSE 0 END::INT AS signal FROM v WINDOW o AS (PARTITION BY symbol ORDER BY date)""")
def bollinger_signal(spark, d):
    return I.band_signal(I.bollinger(nations(spark, d))).select("symbol", "date", "signal")


def _wilder(n: int) -> str:
    return f"""WITH RECURSIVE {RB[5:]}, o AS (SELECT symbol, date, close, row_number() OVER w AS n, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
s AS (SELECT symbol, avg(tr) AS a FROM o WHERE n <= {n} GROUP BY symbol), e AS (SELECT o.symbol, o.n, s.a AS atr FROM o JOIN s USING (symbol) WHERE n = {n} UNION ALL SELECT o.symbol, o.n, (x.atr * {n - 1} + o.tr) / {n} FROM e x JOIN o ON o.symbol = x.symbol AND o.n = x.n + 1),
r AS (SELECT o.*, e.atr FROM o LEFT JOIN e USING (symbol, n))"""


@query(_wilder(14) + """, v AS (SELECT symbol, date, close, CASE WHEN n >= 14 THEN avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) END AS m, atr FROM r)
SELECT symbol, date, round(m + 1.5 * atr, 6) AS atr_up, round(m - 1.5 * atr, 6) AS atr_low, CASE WHEN close < m - 1.5 * atr THEN 1 WHEN close > m + 1.5 * atr THEN -1 ELSE 0 END::INT AS signal FROM v""")
def atr_bands(spark, d):
    return I.atr_bands(regions(spark, d)).select("symbol", "date", F.round("atr_up", 6).alias("atr_up"), F.round("atr_low", 6).alias("atr_low"), "signal")


@query(_wilder(10) + """, v AS (SELECT symbol, date, close, atr, CASE WHEN n >= 20 THEN max(close) OVER w END AS highest, CASE WHEN n >= 20 THEN stddev_pop(close) OVER w END AS deviation FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))
SELECT symbol, date, highest, round(deviation, 6) AS deviation, round(atr, 6) AS atr, CASE WHEN close >= highest THEN 1 WHEN close < highest - 2 * atr THEN -1 ELSE 0 END::INT AS signal FROM v""")
def trend_following(spark, d):
    return I.trend(regions(spark, d)).select("symbol", "date", "highest", F.round("deviation", 6).alias("deviation"), F.round("atr", 6).alias("atr"), "signal")


@query(RB + """, t AS (SELECT symbol, date, (high + low + close) / 3 AS x, list((high + low + close) / 3) OVER (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING) AS h, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM b)
SELECT symbol, date, CASE WHEN n >= 30 THEN round((x - list_avg(h)) / nullif(0.015 * list_avg(list_transform(h, lambda v: abs(v - list_avg(h)))), 0), 6) END AS cci FROM t""")
def cci_30(spark, d):
    return regions(spark, d).select("symbol", "date", F.round(I.cci(), 6).alias("cci"))


@query("WITH RECURSIVE " + RB[5:] + """, m AS (SELECT symbol, date, row_number() OVER w AS n, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
o AS (SELECT symbol, date, n, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS u, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS w FROM m),
e AS (SELECT symbol, date, n, u::DOUBLE AS u, w::DOUBLE AS w, tr FROM o WHERE n = 1 UNION ALL SELECT o.symbol, o.date, o.n, x.u + (o.u - x.u) / 30, x.w + (o.w - x.w) / 30, x.tr + (o.tr - x.tr) / 30 FROM e x JOIN o ON o.symbol = x.symbol AND o.n = x.n + 1)
SELECT symbol, date, CASE WHEN n >= 30 THEN round(CASE WHEN u + w > 0 THEN 100 * abs(u - w) / (u + w) ELSE 0 END, 6) END AS dx FROM e""")
def dx_30(spark, d):
    return I.directional(regions(spark, d)).select("symbol", "date", F.round("dx", 6).alias("dx"))


@query(RB + """, a AS (SELECT symbol, date, low, row_number() OVER w AS n, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr, ln(close / lag(close) OVER w) AS lr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
t AS (SELECT *, CASE WHEN n >= 7 THEN avg(tr) OVER w END AS atr, CASE WHEN n >= 8 THEN avg(lr) OVER w - 0.5 * pow(stddev_samp(lr) OVER w, 2) END AS drift FROM a WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 6 PRECEDING)),
s AS (SELECT *, max(low - 2 * atr) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS stop, CASE WHEN n >= 13 THEN avg(atr) OVER w END AS m, CASE WHEN n >= 13 THEN stddev_samp(atr) OVER w END AS sd, lag(drift) OVER (PARTITION BY symbol ORDER BY date) AS d1, lag(drift, 2) OVER (PARTITION BY symbol ORDER BY date) AS d2 FROM t WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 6 PRECEDING))
SELECT symbol, date, round(atr, 6) AS atr, round(drift, 9) AS drift, round(stop, 6) AS stop, CASE WHEN low < stop THEN -1 WHEN abs(atr - m) > sd AND drift > d1 AND drift > d2 AND drift > 0 THEN 1 ELSE 0 END::INT AS signal FROM s""")
def atr_divergence(spark, d):
    got = I.atr_divergence(regions(spark, d))
    return got.select("symbol", "date", F.round("atr", 6).alias("atr"), F.round("drift", 9).alias("drift"), F.round("stop", 6).alias("stop"), "signal")


@query("WITH RECURSIVE " + RB[5:] + """, o AS (SELECT *, row_number() OVER w AS n, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down, close - lag(close) OVER w AS mv, (high + low + close) / 3 AS x,
  CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
m AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS u, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS v FROM o),
e AS (SELECT symbol, n, close AS f, close AS s, 0.0::DOUBLE AS g, u::DOUBLE AS u, v::DOUBLE AS v, tr FROM m WHERE n = 1 UNION ALL SELECT m.symbol, m.n, e.f + (2.0::DOUBLE / 13) * (m.close - e.f), e.s + (2.0::DOUBLE / 27) * (m.close - e.s),
  e.g + 0.2::DOUBLE * (e.f + (2.0::DOUBLE / 13) * (m.close - e.f) - e.s - (2.0::DOUBLE / 27) * (m.close - e.s) - e.g), e.u + (m.u - e.u) / 30, e.v + (m.v - e.v) / 30, e.tr + (m.tr - e.tr) / 30 FROM e JOIN m ON m.symbol = e.symbol AND m.n = e.n + 1),
q AS (SELECT symbol, date, n, close, x, avg(close) OVER (w ROWS 19 PRECEDING) AS m20, stddev_pop(close) OVER (w ROWS 19 PRECEDING) AS d20, avg(greatest(mv, 0)) OVER (w ROWS 29 PRECEDING) AS gain, avg(greatest(-mv, 0)) OVER (w ROWS 29 PRECEDING) AS loss,
  list(x) OVER (w ROWS 29 PRECEDING) AS h, avg(close) OVER (w ROWS 29 PRECEDING) AS s30, avg(close) OVER (w ROWS 59 PRECEDING) AS s60 FROM o WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT q.symbol, date, round(f - s, 6) AS macd, round(g, 6) AS macds, round(CASE WHEN q.n >= 20 THEN m20 + 2 * d20 END, 6) AS boll_ub, round(CASE WHEN q.n >= 20 THEN m20 - 2 * d20 END, 6) AS boll_lb,
  round(CASE WHEN q.n > 30 THEN CASE WHEN loss = 0 AND gain > 0 THEN 100 WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) END END, 6) AS rsi_30,
  CASE WHEN q.n >= 30 THEN round((x - list_avg(h)) / nullif(0.015 * list_avg(list_transform(h, lambda y: abs(y - list_avg(h)))), 0), 6) END AS cci_30,
  CASE WHEN q.n >= 30 THEN round(CASE WHEN u + v > 0 THEN 100 * abs(u - v) / (u + v) ELSE 0 END, 6) END AS dx_30, round(CASE WHEN q.n >= 30 THEN s30 END, 6) AS close_30_sma, round(CASE WHEN q.n >= 60 THEN s60 END, 6) AS close_60_sma FROM q JOIN e ON e.symbol = q.symbol AND e.n = q.n""")
def compiled_names(spark, d):
    """Indicators by their names, compiled to windows over one sort."""
    wanted = ["macd", "macds", "boll_ub", "boll_lb", "rsi_30", "cci_30", "dx_30", "close_30_sma", "close_60_sma"]
    return Z.indicators(regions(spark, d), wanted).select("symbol", "date", *[F.round(c, 6).alias(c) for c in wanted])


@query("WITH RECURSIVE " + RB[5:] + """, n AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM b),
z AS (SELECT symbol, n, 0 AS way, close AS tv, n AS tn, close AS bv, n AS bn, NULL::BIGINT AS mark, 0 AS turn FROM n WHERE n = 1 UNION ALL
  SELECT symbol, n, CASE WHEN down THEN -1 WHEN up THEN 1 ELSE way END, CASE WHEN up THEN close ELSE tv END, CASE WHEN up THEN n ELSE tn END, CASE WHEN down THEN close ELSE bv END, CASE WHEN down THEN n ELSE bn END,
    CASE WHEN down THEN tn WHEN up THEN bn END, CASE WHEN down AND (way <> 0 OR tn > 1) THEN 1 WHEN up AND (way <> 0 OR bn > 1) THEN -1 ELSE 0 END
  FROM (SELECT *, way >= 0 AND close <= tv * 0.95::DOUBLE AS down, NOT (way >= 0 AND close <= tv * 0.95::DOUBLE) AND way <= 0 AND close >= bv * 1.05::DOUBLE AS up
    FROM (SELECT n.symbol, n.n, n.close, way, greatest(tv, close) AS tv, CASE WHEN close > tv THEN n.n ELSE tn END AS tn, least(bv, close) AS bv, CASE WHEN close < bv THEN n.n ELSE bn END AS bn FROM z JOIN n ON n.symbol = z.symbol AND n.n = z.n + 1)))
SELECT n.symbol, date, close, coalesce(p.turn, 0)::INT AS "pivot" FROM n LEFT JOIN (SELECT symbol, mark, turn FROM z WHERE turn <> 0) p ON p.symbol = n.symbol AND p.mark = n.n""")
def zigzag_pivots(spark, d):
    return G.zigzag(regions(spark, d))


@query(RB + """, h AS (SELECT symbol, date, volume, CASE WHEN isodow(date) = 1 THEN close END AS monday FROM b), w AS (SELECT symbol, date, last_value(monday IGNORE NULLS) OVER o AS monday, sum(volume) OVER o AS traded FROM h WINDOW o AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT symbol, date, monday, traded FROM w""")
def long_series(spark, d):
    """The last Monday's close and the volume so far, by blocks of each series."""
    b = regions(spark, d).select("symbol", "date", "volume", F.when(F.weekday("date") == 0, F.col("close")).alias("close"))
    return G.running(G.running(b, "close", "monday", "last"), "volume", "traded").select("symbol", "date", "monday", "traded")


@query(NB + " SELECT symbol, date, close / lag(close, 7) OVER w - 1 AS past_7, lead(close, 7) OVER w / close - 1 AS next_7, CASE WHEN close / lag(close, 7) OVER w - 1 > 0 THEN printf('an increase of %.2f%%', abs((close / lag(close, 7) OVER w - 1) * 100)) WHEN close / lag(close, 7) OVER w - 1 < 0 THEN printf('a decrease of %.2f%%', abs((close / lag(close, 7) OVER w - 1) * 100)) WHEN close / lag(close, 7) OVER w - 1 = 0 THEN 'no change' ELSE 'unknown' END AS words FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def price_moves(spark, d):
    return I.price_moves(nations(spark, d)).select("symbol", "date", "past_7", "next_7", X.move_text("past_7").alias("words"))


@query(RB + """, m AS (SELECT symbol, date, row_number() OVER w AS n, close - lag(close) OVER w AS mv, (close - lag(close) OVER w) * lag(volume) OVER w AS gain FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, CASE WHEN n >= 8 THEN sign(sum(gain) OVER (w ROWS 6 PRECEDING)) END::INT AS feedback, CASE WHEN n >= 4 THEN sign(sum(mv) OVER (w ROWS 2 PRECEDING)) END::INT AS moment FROM m WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def feedback_signs(spark, d):
    return I.feedback(regions(spark, d), "volume").select("symbol", "date", "feedback", "moment")


@query(NB + """, k AS (SELECT * FROM b WHERE date <= DATE '1996-06-30'), v AS (SELECT symbol, date, close, CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) + 2 * stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS up,
CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) - 2 * stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS low, CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS 9 PRECEDING) - avg(close) OVER (w ROWS 19 PRECEDING) END AS sd FROM k WINDOW w AS (PARTITION BY symbol ORDER BY date)),
g AS (SELECT symbol, date, CASE WHEN lag(close) OVER o < lag(low) OVER o AND close >= low THEN 1 WHEN lag(close) OVER o > lag(up) OVER o AND close <= up THEN -1 ELSE 0 END::INT AS x, sd, last_value(CASE WHEN sd <> 0 THEN sign(sd) END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v WINDOW o AS (PARTITION BY symbol ORDER BY date)),
z AS (SELECT symbol, max(date) AS date, arg_max(x, date) AS x, arg_max(CASE WHEN p < 0 AND sd > 0 THEN 1 WHEN p > 0 AND sd < 0 THEN -1 ELSE 0 END::INT, date) AS y FROM g GROUP BY symbol)
SELECT symbol, 'bollinger' AS strategy, date, x AS signal FROM z UNION ALL SELECT symbol, 'sma_cross', date, y FROM z""")
def latest_signals(spark, d):
    return I.latest_signals(nations(spark, d), "1996-06-30", ("bollinger", "sma_cross"))


# ---- metrics


@query(NB + RET + f""", e AS (SELECT *, ret - {M.daily_rate(0.03)!r}::DOUBLE AS x FROM r)
SELECT symbol, round(pow(greatest(arg_max(equity, date), 0) / 1000, 252.0 / count(ret)) - 1, 9) AS annual_return, round(stddev_samp(ret) * sqrt(252), 9) AS volatility, round(avg(x) / stddev_samp(ret) * sqrt(252), 9) AS sharpe, round(avg(x) / sqrt(avg(pow(least(x, 0), 2)) FILTER (x IS NOT NULL)) * sqrt(252), 9) AS sortino FROM e GROUP BY symbol""")
def broker_returns(spark, d):
    got = M.broker_returns(M.returns(nations(spark, d)), 1000.0)
    return got.select("symbol", *[F.round(c, 9).alias(c) for c in ("annual_return", "volatility", "sharpe", "sortino")])


@query(NB + RET + ", f AS (SELECT * FROM r WHERE symbol <> 'NATION_5' OR date = (SELECT min(date) FROM r WHERE symbol = 'NATION_5')) SELECT symbol, count(ret) AS n, CASE WHEN count(*) <= 1 THEN 100000.0 ELSE arg_max(equity, date) END AS final_value, CASE WHEN count(*) <= 1 THEN 0.0 ELSE arg_max(equity, date) / arg_min(equity, date) - 1 END AS total_return FROM f GROUP BY symbol")
def zero_records(spark, d):
    r = M.returns(nations(spark, d))
    first = r.where("symbol = 'NATION_5'").agg(F.min("date").alias("first"))
    few = r.join(F.broadcast(first)).where("symbol <> 'NATION_5' OR date = first").drop("first")
    return M.zero_records(few).select("symbol", "n", "final_value", "total_return")


@query(NB + RET + """, v AS (SELECT symbol, date, ret, exp(sum(ln(1 + ret)) OVER w) AS v FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, 1 - v / max(v) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS fall FROM v)
SELECT symbol, round((arg_max(v, date) - 1) / count(*) * 252, 6) AS arr, round(stddev_pop(ret), 9) AS vol, round(stddev_pop(ret) FILTER (ret < 0), 9) AS dd, round(max(fall), 9) AS mdd, round(avg(ret) * sqrt(count(*)) / stddev_pop(ret), 6) AS sr, round(avg(ret) * 252 / max(fall), 6) AS cr, round(avg(ret) * 252 / (stddev_pop(ret) FILTER (ret < 0)), 6) AS sor FROM g GROUP BY symbol""")
def ratio_metrics(spark, d):
    got = M.ratio_metrics(M.returns(nations(spark, d)))
    return got.select("symbol", *[F.round(c, 9).alias(c) for c in ("vol", "dd", "mdd")], *[F.round(c, 6).alias(c) for c in ("arr", "sr", "cr", "sor")])


@query(NB + RET + " SELECT symbol, round(2 * avg(ret) / stddev_samp(ret), 9) AS sharpe FROM r GROUP BY symbol")
def validation_sharpe(spark, d):
    return M.validation_sharpe(M.returns(nations(spark, d))).select("symbol", F.round("sharpe", 9).alias("sharpe"))


@query(RB + """, t AS (SELECT date, sum(abs(close)) AS turbulence FROM b GROUP BY date), i AS (SELECT quantile_cont(turbulence, 0.9) AS usual, max(turbulence) AS most FROM t WHERE date >= DATE '1996-01-01' AND date < DATE '1998-01-01'),
n AS (SELECT avg(turbulence) AS recent FROM (SELECT * FROM t WHERE date <= DATE '1999-01-01' ORDER BY date DESC LIMIT 63)) SELECT CASE WHEN recent > usual THEN usual ELSE most END AS "limit", usual, recent FROM i, n""")
def turbulence_limits(spark, d):
    t = regions(spark, d).groupBy("date").agg(F.sum(F.abs("close")).alias("turbulence"))
    return M.turbulence_limits(t, "1996-01-01", "1998-01-01", "1999-01-01")


@query(NB + RET + f""", e AS (SELECT symbol, stddev_samp(ret) * sqrt(252) AS v, avg(ret - {M.daily_rate(0.03)!r}::DOUBLE) / stddev_samp(ret) * sqrt(252) AS s FROM r GROUP BY symbol)
SELECT symbol, round(v, 9) AS volatility, round(s, 9) AS recomputed_sharpe, round(CASE WHEN v >= 8 THEN s END, 9) AS reported_sharpe, CASE WHEN v >= 8 THEN 'defined' ELSE 'near_zero_volatility' END AS sharpe_status FROM e""")
def reported_risk(spark, d):
    got = M.reported_risk(M.returns(nations(spark, d)), least_volatility=8.0)
    return got.select("symbol", *[F.round(c, 9).alias(c) for c in ("volatility", "recomputed_sharpe", "reported_sharpe")], "sharpe_status")


@query(NB + RET + """, q AS (SELECT year(date)::INT AS win, symbol AS ticker, arg_max(equity, date) / arg_min(equity, date) - 1 AS m FROM r GROUP BY ALL)
SELECT CASE WHEN grouping(win) = 0 THEN win::VARCHAR ELSE 'Average' END AS win, CASE WHEN grouping(ticker) = 1 THEN 'All' ELSE ticker END AS ticker, printf('%.3f', avg(m) * 100) AS total_return FROM q GROUP BY GROUPING SETS ((win, ticker), (ticker), ())""")
def report_text(spark, d):
    r = M.returns(nations(spark, d)).groupBy(F.year("date").alias("win"), F.col("symbol").alias("ticker")).agg((F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("total_return"))
    return M.report_text(r, {"total_return": 100.0})


@query(RB + RET + """, e AS (SELECT symbol AS episode, ret FROM r WHERE ret IS NOT NULL), g AS (SELECT episode, count(*) AS steps, round(sum(ret), 9) AS total, round(max(ret), 9) AS best, round(min(ret), 9) AS worst FROM e GROUP BY episode)
SELECT *, rank() OVER (ORDER BY total DESC) AS rank FROM g""")
def compare_episodes(spark, d):
    e = M.returns(regions(spark, d)).where("ret IS NOT NULL").select(F.col("symbol").alias("episode"), F.col("ret").alias("reward"))
    return Q.compare_episodes(e).select("episode", "steps", *[F.round(c, 9).alias(c) for c in ("total", "best", "worst")], "rank")


@query(NB + " SELECT symbol, count(*) AS n FROM b GROUP BY symbol HAVING count(*) >= 30")
def enough_rows(spark, d):
    return nations(spark, d).groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 30")


# ---- selection


@query(NB + " SELECT symbol FROM b GROUP BY symbol HAVING count(*) >= 30 ORDER BY md5('7/' || symbol), symbol LIMIT 5")
def select_random(spark, d):
    return T.random_symbols(nations(spark, d), 5, seed=7)


@query(NB + ", y AS (SELECT year(date)::INT AS year, symbol FROM b GROUP BY ALL HAVING count(*) >= 30), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY md5('0/' || year || '/' || symbol), symbol) AS r FROM y QUALIFY r <= 3) SELECT year, symbol FROM r WHERE year IN (SELECT year FROM r GROUP BY year HAVING count(*) = 3)")
def select_random_by_year(spark, d):
    return T.random_symbols(nations(spark, d), 3, per_year=True)


CORR = """, c AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS c FROM r x JOIN r y ON x.date = y.date AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL),
h AS (SELECT symbol, avg(ret) / stddev_samp(ret) AS sharpe FROM r GROUP BY symbol)"""


@query(RB + RET + CORR + """, m AS (SELECT s AS symbol, (sum(c) + 1) / (count(c) + 1) AS m FROM (SELECT a AS s, c FROM c UNION ALL SELECT b, c FROM c) GROUP BY s),
v AS (SELECT symbol, sharpe * (1 - m) AS score FROM h JOIN m USING (symbol)) SELECT symbol, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM v ORDER BY score DESC, symbol LIMIT 3""")
def select_diversified(spark, d):
    r = M.returns(regions(spark, d))
    sharpe = r.groupBy("symbol").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"))
    return T.diversified(sharpe, M.correlations(r), 3).withColumn("score", F.round("score", 9))


@query(RB + RET + CORR + """, p AS (SELECT symbol, stddev_samp(ret) AS s, avg(ret) AS m FROM r GROUP BY symbol), t AS (SELECT sum(0.2::DOUBLE * m) AS ret, sum(pow(0.2::DOUBLE * s, 2)) AS own FROM p),
x AS (SELECT sum(2 * 0.04::DOUBLE * u.s * v.s * c) AS cross_ FROM c JOIN p u ON u.symbol = a JOIN p v ON v.symbol = b)
SELECT round(ret, 9) AS ret, round(sqrt(own + cross_), 9) AS vol, round(ret / sqrt(own + cross_), 9) AS sharpe, CASE WHEN sqrt(own + cross_) < 0.01 THEN 'low' WHEN sqrt(own + cross_) < 0.02 THEN 'medium' ELSE 'high' END AS bucket FROM t, x""")
def portfolio_risk(spark, d):
    r = M.returns(regions(spark, d))
    g = r.groupBy("symbol").agg(F.stddev_samp("ret").alias("vol"), F.avg("ret").alias("mean"))
    got = T.portfolio_risk(g.select("symbol", F.lit(0.2).alias("weight")), g.select("symbol", "vol"), M.correlations(r), g.select("symbol", "mean"))
    return got.select(*[F.round(c, 9).alias(c) for c in ("ret", "vol", "sharpe")], "bucket")


# ---- vectors and memory

NORM = "WITH v AS (SELECT vec_id, vec_id % 7 AS symbol, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"


def _vectors(spark, d):
    e = table(spark, d, "embeddings").withColumn("symbol", F.col("vec_id") % 7)
    store = e.select("symbol", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return store, e.where("vec_id % 100 = 0").select("symbol", F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@query(NORM + """, s AS (SELECT x.symbol, q.vec_id AS qid, x.vec_id AS id, list_dot_product(x.e, q.e) / x.n AS score FROM v x JOIN v q ON q.symbol = x.symbol WHERE q.vec_id % 100 = 0)
SELECT symbol, qid, id, round(score, 9) AS score, row_number() OVER (PARTITION BY symbol, qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5""")
def knn_in_group(spark, d):
    return V.nearest_in_group(*_vectors(spark, d)).withColumn("score", F.round("score", 9))


@query(NORM + """, s AS (SELECT x.symbol, q.vec_id AS qid, x.vec_id AS id, list_dot_product(x.e, q.e) / x.n AS near, (x.vec_id % 13) / 13.0::DOUBLE AS compound FROM v x JOIN v q ON q.symbol = x.symbol WHERE q.vec_id % 100 = 0),
k AS (SELECT *, near + compound AS score FROM s QUALIFY row_number() OVER (PARTITION BY symbol, qid ORDER BY near DESC, id) <= 5 OR row_number() OVER (PARTITION BY symbol, qid ORDER BY compound DESC, id) <= 5)
SELECT symbol, qid, id, round(score, 9) AS score FROM k QUALIFY row_number() OVER (PARTITION BY symbol, qid ORDER BY score DESC, id) <= 5""")
def hybrid_memory(spark, d):
    store, queries = _vectors(spark, d)
    return V.hybrid(store.withColumn("compound", (F.col("id") % 13) / 13.0), queries).withColumn("score", F.round("score", 9))


@query(NORM + """, s AS (SELECT q.vec_id AS qid, x.vec_id AS id, list_dot_product(x.e, q.e) / (x.n * q.n) AS near, ((x.vec_id % 10) / 10.0::DOUBLE) * pow(0.95::DOUBLE, x.vec_id % 30) AS w FROM v x, v q WHERE q.vec_id % 100 = 0)
SELECT qid, id, round(near + w, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY near + w DESC, id) AS rank FROM s WHERE near >= 0.1 QUALIFY rank <= 5""")
def recall_events(spark, d):
    store, queries = _vectors(spark, d)
    events = store.select("id", "v", ((F.col("id") % 10) / 10.0).alias("importance"), (F.col("id") % 30).alias("days"))
    return V.recall(events, queries.select("qid", "q")).withColumn("score", F.round("score", 9))


@query("SELECT event_id AS id, round(value * pow(0.95::DOUBLE, event_id % 30) * (1 + 0.1::DOUBLE * (event_id % 4)), 9) AS worth FROM events ORDER BY value * pow(0.95::DOUBLE, event_id % 30) * (1 + 0.1::DOUBLE * (event_id % 4)) DESC, event_id LIMIT 100")
def prune_events(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("importance"), (F.col("event_id") % 30).alias("days"), (F.col("event_id") % 4).alias("access_count"))
    return V.prune(e, 100).select("id", F.round("worth", 9).alias("worth"))


@query("SELECT event_id AS id, round(exp(-(event_id % 12) / 3.0::DOUBLE), 9) AS recency, round(value * pow(0.92::DOUBLE, event_id % 12), 9) AS importance FROM events WHERE exp(-(event_id % 12) / 3.0::DOUBLE) >= 0.05 AND value * pow(0.92::DOUBLE, event_id % 12) >= 5")
def memory_cleanup(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 12).alias("age"), F.col("value").alias("importance"))
    return V.survivors(e).select("id", F.round("recency", 9).alias("recency"), F.round("importance", 9).alias("importance"))


@query("""WITH u AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'mid' ELSE 'long' END AS layer, ('0x' || substr(md5('0/' || event_id), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u FROM events)
SELECT id, layer, CASE layer WHEN 'short' THEN CASE WHEN u < 0.5 THEN 50.0 WHEN u < 0.95 THEN 70.0 ELSE 90.0 END WHEN 'mid' THEN CASE WHEN u < 0.05 THEN 40.0 WHEN u < 0.85 THEN 60.0 ELSE 80.0 END ELSE CASE WHEN u < 0.05 THEN 40.0 WHEN u < 0.2 THEN 60.0 ELSE 80.0 END END::DOUBLE AS importance FROM u""")
def first_importance(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("CASE event_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'mid' ELSE 'long' END").alias("layer"))
    return e.withColumn("importance", V.first_importance())


@query("SELECT event_id AS id, CASE WHEN value < 20 THEN value * 2 ELSE value END AS value FROM events WHERE NOT value < 10")
def memory_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "value")
    changes = e.where("value < 20").select("id", (F.col("value") * 2).alias("value"), (F.col("value") < 10).alias("gone"))
    return V.upserted(e, changes)


@query("SELECT item_id, kind, CASE WHEN kind = 'plain' THEN text ELSE text || ' ' || kind || ' term' END AS text FROM benchmark, (VALUES ('plain'), ('short'), ('long')) k(kind)")
def many_queries(spark, d):
    b = table(spark, d, "benchmark").select("item_id", "text")
    return V.many_queries(b, {"plain": "", "short": "short term", "long": "long term"})


# ---- scalars


@query("SELECT event_id, event_id * 1000 AS seconds, (ts::DATE - INTERVAL 24 MONTH)::DATE AS years, (ts::DATE - 730) AS days, floor(1000 * 0.5 / value)::BIGINT AS shares FROM events WHERE value > 0.01")
def date_scalars(spark, d):
    e = table(spark, d, "events").where("value > 0.01")
    day = F.to_date("ts")
    return e.select("event_id", X.to_unix(X.from_unix(F.col("event_id") * 1000, "Asia/Tokyo"), "Asia/Tokyo").alias("seconds"), X.years_before(day, 2).alias("years"), X.years_before(day, 2, False).alias("days"), X.whole_shares(F.lit(1000.0), "value", 0.5).alias("shares"))


@query("""WITH v AS (SELECT vec_id, (embedding::DOUBLE[])[1:4] AS e FROM embeddings), s AS (SELECT vec_id, e, list_transform(e, lambda x: exp(x - list_max(e))) AS x FROM v)
SELECT vec_id, list_transform(x, lambda y: round(y / list_sum(x), 9)) AS weights, list_position(e, list_max(e)) - 1 AS top, list_position(e, list_min(e)) - 1 AS bottom FROM s""")
def softmax_weights(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.transform(X.softmax("e"), lambda x: F.round(x, 9)).alias("weights"), X.place_of("e").cast("long").alias("top"), X.place_of("e", F.array_min).cast("long").alias("bottom"))


_FEE = "(1 - 0.0025::DOUBLE * 0.4 - (2 * 0.0025::DOUBLE - pow(0.0025::DOUBLE, 2)) * (greatest(a - {m} * 0.3, 0) + greatest(1 - a - {m} * 0.3, 0))) / (1 - 0.0025::DOUBLE * 0.4)"


def _fixed_point(steps: int) -> str:
    """SQL that goes through a fixed point step by step, one subquery each."""
    out = "SELECT event_id, (event_id % 10) / 10.0::DOUBLE AS a, 1 - 2 * 0.0025::DOUBLE + pow(0.0025::DOUBLE, 2) AS m FROM events"
    for _ in range(steps):
        out = f"SELECT event_id, a, {_FEE.format(m='m')} AS m FROM ({out})"
    return f"SELECT event_id, round(m, 10) AS mu FROM ({out})"


@query(_fixed_point(12))
def remainder_factors(spark, d):
    a = (F.col("event_id") % 10) / 10.0
    before, after = F.array(F.lit(0.0), a, 1 - a), F.array(F.lit(0.4), F.lit(0.3), F.lit(0.3))
    return table(spark, d, "events").select("event_id", F.round(X.remainder_factor(0.0025, before, after), 10).alias("mu"))


@query("SELECT conv_id, string_agg(role || '=' || n, ',' ORDER BY role) AS kept FROM (SELECT conv_id, role, max(turn) AS n FROM conversations WHERE role <> 'system' GROUP BY ALL) GROUP BY conv_id")
def map_filter_merge(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max("turn").alias("n"))
    even, odd = (F.map_from_entries(F.collect_list(F.when(F.col("role") == r, F.struct("role", "n")))) for r in ("user", "assistant"))
    m = c.groupBy("conv_id").agg(even.alias("a"), odd.alias("b"), F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("every"))
    kept = X.only_tickers(X.merged(X.merged("a", "b"), "every"), F.filter(F.map_keys("every"), lambda r: r != "system"))
    return m.withColumn("kept", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")).where("kept <> ''").select("conv_id", "kept")


@query("SELECT event_id, event_type AS sym_root FROM events WHERE event_type IN ('click', 'view', 'purchase') AND strftime(ts, '%H:%M:%S') BETWEEN '09:30:00' AND '16:00:00' AND value > 10")
def trade_filter(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("sym_root"), F.date_format("ts", "HH:mm:ss").alias("time_m"), F.col("value").alias("size"), F.lit(None).cast("string").alias("sym_suffix"))
    return S.trade_filter(e, ["click", "view", "purchase"], "09:30:00", "16:00:00", 10).select("event_id", "sym_root")


@query()
def drop_similar_news(spark, d):
    n = table(spark, d, "documents").select("source", "doc_id", F.substring("text", 1, 200).alias("headline"))
    return P.drop_similar(n, "headline", 0.6, ("source",), "doc_id")


@query("SELECT concat_ws('/', n_name, year(o_orderdate)::VARCHAR, o_orderpriority) AS path, o_orderpriority AS ticker, year(o_orderdate)::VARCHAR AS \"window\", sum(o_totalprice) AS final_value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def summary_paths(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    g = o.groupBy(F.col("n_name").alias("setup"), F.year("o_orderdate").cast("string").alias("window"), F.col("o_orderpriority").alias("ticker")).agg(F.sum("o_totalprice").alias("final_value"))
    return S.summary_of(g, ("setup", "window", "ticker")).select("path", "ticker", "window", "final_value")


# ---- prices, calendars and more texts


@query(NB + " SELECT symbol, date, coalesce(open * r, close) AS adjusted_open, coalesce(high * r, close) AS adjusted_high, adjusted_close, CASE WHEN close <> 0 THEN low * adjusted_close / close ELSE close END AS low_price FROM (SELECT *, CASE WHEN close <> 0 THEN adjusted_close / close ELSE 0 END AS r FROM b)")
def adjusted_by_precedence(spark, d):
    b = nations(spark, d)
    return R.adjust_by_precedence(b).select("symbol", "date", "adjusted_open", "adjusted_high", "adjusted_close", R.price_at(b, "adjusted_low").alias("low_price"))


@query(RB + """, o AS (SELECT date, close AS oc FROM b WHERE symbol = 'ASIA'), n AS (SELECT date, close AS nc FROM b WHERE symbol = 'EUROPE' AND date >= DATE '1997-01-01'), m AS (SELECT date AS meet, nc / oc AS factor FROM o JOIN n USING (date) ORDER BY date LIMIT 1)
SELECT 'x' AS symbol, date, oc * factor AS close FROM o, m WHERE date < meet UNION ALL SELECT 'x', date, nc FROM n, m WHERE date >= meet""")
def spliced_index(spark, d):
    b = regions(spark, d)
    one = lambda s: b.where(F.col("symbol") == s).select(F.lit("x").alias("symbol"), "date", "close")
    return R.splice(one("ASIA"), one("EUROPE").where("date >= date'1997-01-01'"))


@query(NB + ", e AS (SELECT symbol, max(date) AS last FROM b GROUP BY symbol) SELECT symbol, count(*) AS n, max(date) AS last FROM b JOIN e USING (symbol) WHERE e.last >= DATE '2002-01-01' - 3 OR date <= e.last - 7 GROUP BY symbol")
def delisted_rows(spark, d):
    return R.delisted(nations(spark, d), F.lit("2002-01-01").cast("date")).groupBy("symbol").agg(F.count("*").alias("n"), F.max("date").alias("last"))


@query(RB + """, h AS (SELECT symbol, date, CASE WHEN isodow(date) = 1 THEN close END AS monday FROM b) SELECT symbol, date, last_value(monday IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS before,
first_value(monday IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM h""")
def filled_gaps(spark, d):
    b = regions(spark, d).withColumn("monday", F.when(F.weekday("date") == 0, F.col("close")))
    return b.select("symbol", "date", I.forward_fill("monday").alias("before"), I.back_fill("monday").alias("after"))


@query("SELECT event_id, len(list_filter(generate_series(CAST(ts AS DATE), CAST(ts AS DATE) + 30, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS days FROM events")
def business_days(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").select("event_id", F.size(X.business_days(day, F.date_add(day, 30))).cast("long").alias("days"))


HEADLINES = """WITH h AS (SELECT doc_id, 'UPDATE ' || (doc_id % 5) || '-Paris (Reuters)' || substr(coalesce(text, ''), 1, 80) AS t FROM documents)"""


@query(HEADLINES + " SELECT doc_id, (doc_id % 5)::INT AS number, regexp_replace(t, '^UPDATE \\d+-', '') AS plain, substr(t, strpos(t, '(Reuters)') + 9) AS body FROM h")
def headline_parts(spark, d):
    t = F.concat(F.lit("UPDATE "), (F.col("doc_id") % 5).cast("string"), F.lit("-Paris (Reuters)"), F.substring(F.coalesce("text", F.lit("")), 1, 80))
    h = table(spark, d, "documents").select("doc_id", t.alias("t"))
    return h.select("doc_id", X.update_number("t").alias("number"), X.strip_update("t").alias("plain"), X.after_agency("t").alias("body"))


@query(RB + """, m AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN lag_c IS NULL THEN volume ELSE sign(close - lag_c) * volume END) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS lag_c FROM b) WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, CASE WHEN n >= 14 THEN -100 * (max(high) OVER w - close) / nullif(max(high) OVER w - min(low) OVER w, 0) END AS willr, close - lag(close, 10) OVER (PARTITION BY symbol ORDER BY date) AS mom, (high + low + 2 * close) / 4 AS wclprice, obv FROM m WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)""")
def indicators_by_name(spark, d):
    df = regions(spark, d)
    for name in ("WILLR", "MOM", "WCLPRICE", "OBV"):
        df = I.by_name(df, name)
    return df.select("symbol", "date", "willr", "mom", "wclprice", "obv")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def json_round_trip(spark, d):
    parsed = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("again"))


_GROWN = NB + RET + """, q AS (SELECT symbol, date, ret, row_number() OVER w AS day, sum(ln(1 + ret)) OVER w AS logs FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, exp(logs) AS growth, greatest(1, max(exp(logs)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS top FROM q)"""


@query(_GROWN + """, m AS (SELECT date, avg(ret) AS market FROM r WHERE ret IS NOT NULL GROUP BY date), u AS (SELECT g.*, market, avg(ret) OVER s AS mean, stddev_pop(ret) OVER s AS dev FROM g LEFT JOIN m USING (date) WINDOW s AS (PARTITION BY symbol)),
v AS (SELECT symbol, count(*) AS n, arg_max(growth, date) - 1 AS total, min(growth / top - 1) AS worst, avg(ret) AS mean, stddev_samp(ret) AS std, corr(day, logs) AS r, sum(greatest(ret, 0)) AS up, -sum(least(ret, 0)) AS down, sqrt(avg(pow(least(ret, 0), 2))) AS below,
  avg(pow((ret - mean) / dev, 3)) AS skew, avg(pow((ret - mean) / dev, 4)) - 3 AS kurt, quantile_cont(ret, 0.05) AS low, quantile_cont(ret, 0.95) AS high, covar_pop(ret, market) / var_pop(market) AS beta, avg(market) AS market FROM u GROUP BY symbol)
SELECT symbol, n, round(pow(1 + total, 252.0 / n) - 1, 6) AS annual_return, round(total, 6) AS cumulative_return, round(std * sqrt(252), 6) AS volatility, round(mean / std * sqrt(252), 6) AS sharpe, round((pow(1 + total, 252.0 / n) - 1) / -worst, 6) AS calmar,
round(r * r, 6) AS stability, round(worst, 6) AS max_drawdown, round(up / down, 6) AS omega, round(mean / below * sqrt(252), 6) AS sortino, round(skew, 6) AS skew, round(kurt, 6) AS kurtosis, round(abs(high) / abs(low), 6) AS tail_ratio,
round(mean - 2 * std, 6) AS value_at_risk, round(beta, 6) AS beta, round(pow(1 + mean - beta * market, 252) - 1, 6) AS alpha FROM v""")
def performance_table(spark, d):
    """The performance statistics of each symbol, against the mean of all symbols."""
    rets = M.returns(nations(spark, d))
    p = M.performance(rets, market=rets.where("ret IS NOT NULL").groupBy("date").agg(F.avg("ret").alias("market")))
    return p.select("symbol", "n", *[F.round(c, 6).alias(c) for c in p.columns[2:]])


@query(_GROWN + """, f AS (SELECT *, round(growth / top - 1, 12) AS deep FROM g),
x AS (SELECT *, sum((deep >= 0)::INT) OVER w AS fall, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS later FROM f WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
y AS (SELECT symbol, fall, min(date) FILTER (deep >= 0) AS peak, arg_min(date, (deep, date)) AS valley, max(later) AS recovery, min(deep) AS depth, min(date) AS a, max(date) AS z, bool_or(later IS NULL) AS open FROM x GROUP BY symbol, fall HAVING min(deep) < 0),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, a) AS rank, CASE WHEN NOT open THEN recovery END AS back FROM y)
SELECT symbol, rank, peak, valley, back AS recovery, round(depth, 9) AS depth, date_diff('day', coalesce(peak, a), coalesce(back, z)) AS days FROM k WHERE rank <= 5""")
def worst_drawdowns(spark, d):
    """The five deepest falls of each symbol."""
    return M.drawdowns(M.returns(nations(spark, d))).withColumn("depth", F.round("depth", 9))

"""Named queries over the test tables, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import factors as A
from ..operators import indicators as I
from ..operators import memory as V
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import select as T
from ..operators import simulate as B
from ..operators import statistics as Q
from ..sources import market as S
from .base import NB, RB, RET, TICKS, bars_sql, oracle_sql, queries, query, table, ticks  # noqa: F401  the register is part of the catalogue


@query(NB + " SELECT symbol, date, open, high, low, close, volume, adjusted_close FROM b")
def bars_daily(spark, d):
    return S.stand_in_bars(spark, d)


@query(NB + """ SELECT symbol, date, open * r AS open, high * r AS high, low * r AS low, close * r AS close, open AS raw_open, high AS raw_high, low AS raw_low, close AS raw_close, volume
FROM (SELECT *, CASE WHEN close <> 0 THEN adjusted_close / close ELSE 0 END AS r FROM b)""")
def adjusted_ohlc(spark, d):
    df = R.adjusted_view(S.stand_in_bars(spark, d))
    return df.withColumn("close", F.col("raw_close") * X.adjust_ratio("raw_close", "close"))


@query(NB + """ SELECT symbol, date, CASE WHEN n >= 5 THEN s5 END AS sma5, CASE WHEN n >= 30 THEN s30 END AS sma30,
CASE WHEN n >= 15 THEN CASE WHEN l = 0 AND g > 0 THEN 100.0 WHEN l > 0 THEN 100 - 100 / (1 + g / l) END END AS rsi FROM (
SELECT symbol, date, row_number() OVER w AS n, avg(close) OVER (w ROWS 4 PRECEDING) AS s5, avg(close) OVER (w ROWS 29 PRECEDING) AS s30,
avg(CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END) OVER (w ROWS 13 PRECEDING) AS g, avg(CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END) OVER (w ROWS 13 PRECEDING) AS l
FROM (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM b) WINDOW w AS (PARTITION BY symbol ORDER BY date))""")
def sma_rsi(spark, d):
    df = S.stand_in_bars(spark, d).withColumns({"sma5": I.sma(n=5), "sma30": I.sma(n=30)})
    return I.rsi(df).select("symbol", "date", "sma5", "sma30", "rsi")


@query(NB + """ SELECT symbol, date, CASE WHEN n >= 20 THEN m END AS bb_mid, CASE WHEN n >= 20 THEN m + 2 * s END AS bb_up, CASE WHEN n >= 20 THEN m - 2 * s END AS bb_low FROM (
SELECT symbol, date, row_number() OVER w AS n, avg(close) OVER (w ROWS 19 PRECEDING) AS m, stddev_pop(close) OVER (w ROWS 19 PRECEDING) AS s FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date))""")
def bollinger(spark, d):
    return I.bollinger(S.stand_in_bars(spark, d)).select("symbol", "date", "bb_mid", "bb_up", "bb_low")


@query("WITH RECURSIVE " + bars_sql("r_name") + """, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM b),
e AS (SELECT symbol, date, n, close, close AS ema9, close AS ema12, close AS ema26, 0.0::DOUBLE AS sig FROM o WHERE n = 1 UNION ALL
SELECT o.symbol, o.date, o.n, o.close, x.ema9 + 0.2::DOUBLE * (o.close - x.ema9), x.ema12 + (2.0::DOUBLE / 13) * (o.close - x.ema12), x.ema26 + (2.0::DOUBLE / 27) * (o.close - x.ema26),
x.sig + 0.2::DOUBLE * ((x.ema12 + (2.0::DOUBLE / 13) * (o.close - x.ema12)) - (x.ema26 + (2.0::DOUBLE / 27) * (o.close - x.ema26)) - x.sig) FROM e x JOIN o ON o.symbol = x.symbol AND o.n = x.n + 1)
SELECT symbol, date, round(ema9, 8) AS ema9, round(ema12, 8) AS ema12, round(ema26, 8) AS ema26, round(ema12 - ema26, 8) AS macd, round(sig, 8) AS macd_signal FROM e""")
def ema_macd(spark, d):
    df = I.recursive_averages(S.stand_in_bars(spark, d, "region"))
    return df.select("symbol", "date", *[F.round(c, 8).alias(c) for c in ("ema9", "ema12", "ema26", "macd", "macd_signal")])


@query("WITH RECURSIVE " + bars_sql("r_name") + """, o AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n,
CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY date) IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY date)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY date))) END AS tr FROM b),
s AS (SELECT symbol, avg(tr) AS a FROM o WHERE n <= 14 GROUP BY symbol),
e AS (SELECT o.symbol, o.date, o.n, s.a AS atr FROM o JOIN s USING (symbol) WHERE n = 14 UNION ALL SELECT o.symbol, o.date, o.n, (x.atr * 13 + o.tr) / 14 FROM e x JOIN o ON o.symbol = x.symbol AND o.n = x.n + 1)
SELECT o.symbol, o.date, round(tr, 8) AS tr, round(atr, 8) AS atr FROM o LEFT JOIN e ON e.symbol = o.symbol AND e.n = o.n""")
def atr_wilder(spark, d):
    return I.wilder_atr(S.stand_in_bars(spark, d, "region")).select("symbol", "date", F.round("tr", 8).alias("tr"), F.round("atr", 8).alias("atr"))


def _wma(n: int) -> str:
    """SQL of the weighted mean of n rows of the window o."""
    return f"CASE WHEN row_number() OVER o >= {n} THEN (" + " + ".join(f"{n - k} * {f'lag(close, {k}) OVER o' if k else 'close'}" for k in range(n)) + f") / {n * (n + 1) / 2}::DOUBLE END"


@query(NB + f""", w AS (SELECT symbol, date, {_wma(10)} AS wma10, {_wma(20)} AS wma20 FROM b WINDOW o AS (PARTITION BY symbol ORDER BY date)),
x AS (SELECT *, wma10 - wma20 AS sd, last_value(CASE WHEN wma10 <> wma20 THEN sign(wma10 - wma20) END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w)
SELECT symbol, date, wma10, wma20, CASE WHEN p < 0 AND sd > 0 THEN 1 WHEN p > 0 AND sd < 0 THEN -1 ELSE 0 END::INT AS signal FROM x""")
def wma_cross(spark, d):
    df = S.stand_in_bars(spark, d).withColumns({"wma10": I.wma(n=10), "wma20": I.wma(n=20)})
    return I.cross(df, F.col("wma10"), F.col("wma20"), "signal").select("symbol", "date", "wma10", "wma20", "signal")


@query(NB + """, v AS (SELECT symbol, date, row_number() OVER w AS n, CASE WHEN row_number() OVER w >= 9 AND max(high) OVER (w ROWS 8 PRECEDING) <> min(low) OVER (w ROWS 8 PRECEDING)
THEN (close - min(low) OVER (w ROWS 8 PRECEDING)) / (max(high) OVER (w ROWS 8 PRECEDING) - min(low) OVER (w ROWS 8 PRECEDING)) * 100 END AS rsv FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
k AS (SELECT *, CASE WHEN n >= 11 THEN avg(rsv) OVER (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING) END AS k FROM v),
d AS (SELECT *, CASE WHEN n >= 13 THEN avg(k) OVER (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING) END AS d FROM k)
SELECT symbol, date, rsv, k, d, 3 * k - 2 * d AS j FROM d""")
def kdj(spark, d):
    return I.kdj(S.stand_in_bars(spark, d)).select("symbol", "date", "rsv", "k", "d", "j")


@query(NB + """ SELECT symbol, date, CASE WHEN n >= 14 THEN (close - m) / s END AS z, CASE WHEN n >= 14 AND hi <> lo THEN (close - lo) / (hi - lo) * 100 END AS stoch_k FROM (SELECT *, row_number() OVER w AS n, avg(close) OVER (w ROWS 13 PRECEDING) AS m,
stddev_samp(close) OVER (w ROWS 13 PRECEDING) AS s, min(low) OVER (w ROWS 13 PRECEDING) AS lo, max(high) OVER (w ROWS 13 PRECEDING) AS hi FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date))""")
def zscore_stochastic(spark, d):
    return I.stochastic(S.stand_in_bars(spark, d)).withColumn("z", I.zscore()).select("symbol", "date", "z", "stoch_k")


@query(NB + " SELECT symbol, date, month(date + INTERVAL 5 DAY) <> month(date) AS entry, (SELECT count(*) FROM range(0, day(date)) g(i) WHERE isodow(date - i::INT) < 6) = 3 AND isodow(date) < 6 AS exit FROM b")
def month_turn(spark, d):
    return S.stand_in_bars(spark, d).select("symbol", "date", X.month_ends_within().alias("entry"), X.third_weekday().alias("exit"))


@query(NB + """ SELECT symbol, date, v AS prior_volume, floor(v * 0.025::DOUBLE)::BIGINT AS cap, CASE WHEN v IS NULL THEN 1000 ELSE least(1000, floor(v * 0.025::DOUBLE)) END::BIGINT AS allowed,
least(greatest(volume * 0.0049::DOUBLE, 0.99::DOUBLE), volume * close * 0.01::DOUBLE) AS commission, CASE WHEN v > 0 THEN close * (1 + (0.001::DOUBLE + 0.1::DOUBLE * (volume / v) * (volume / v))) ELSE close * (1 + 0.001::DOUBLE) END AS fill
FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v FROM b)""")
def costs_and_caps(spark, d):
    df = S.stand_in_bars(spark, d).withColumn("v", I.prior_volume())
    return df.select("symbol", "date", F.col("v").alias("prior_volume"), F.floor(F.col("v") * 0.025).alias("cap"), X.liquidity_cap(F.lit(1000), "v", 0.025).alias("allowed"),
                     X.commission("volume", "close").alias("commission"), X.fill_price("close", "volume", "v", F.lit("buy"), 0.001, 0.1).alias("fill"))


@query(RB + """ SELECT symbol, date, (close - open) / close AS kmid, (high - low) / open AS klen, (high - greatest(open, close)) / open AS kup, coalesce(CASE WHEN n >= 20 THEN o / close END, 0) AS roc_20, CASE WHEN n >= 20 THEN m / close ELSE 0 END AS ma_20,
CASE WHEN n >= 20 THEN s / close ELSE 0 END AS std_20, CASE WHEN n >= 20 THEN q / close ELSE 0 END AS qtlu_20, CASE WHEN n >= 20 THEN hi / close ELSE 0 END AS max_20, CASE WHEN n >= 20 THEN (list_position(h, list_max(h)) - 1) / 20.0 ELSE 0 END::DOUBLE AS imax_20
FROM (SELECT *, row_number() OVER w AS n, lag(close, 20) OVER w AS o, avg(close) OVER (w ROWS 19 PRECEDING) AS m, stddev_samp(close) OVER (w ROWS 19 PRECEDING) AS s, quantile_cont(close, 0.8) OVER (w ROWS 19 PRECEDING) AS q,
max(close) OVER (w ROWS 19 PRECEDING) AS hi, list(high) OVER (w ROWS 19 PRECEDING) AS h FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date))""")
def factors_w20(spark, d):
    return A.factors(S.stand_in_bars(spark, d, "region"), (20,)).select("symbol", "date", "kmid", "klen", "kup", "roc_20", "ma_20", "std_20", "qtlu_20", "max_20", "imax_20")


def _factor_sql() -> str:
    """All factor families, written from their definitions: every window's values, 0 where a value is missing or infinite."""
    eps = "1e-12::DOUBLE"
    cols = {
        "kmid": "(close - open) / close", "kmid2": f"(close - open) / (high - low + {eps})", "klen": "(high - low) / open",
        "kup": "(high - greatest(open, close)) / open", "kup2": f"(high - greatest(open, close)) / (high - low + {eps})", "klow": "(least(open, close) - low) / open",
        "klow2": f"(least(open, close) - low) / (high - low + {eps})", "ksft": "(2 * close - high - low) / open", "ksft2": f"(2 * close - high - low) / (high - low + {eps})",
    }
    names, inner = [], []
    moves = ("cord", "sump", "sumn", "sumd", "wvma", "vsump", "vsumn", "vsumd")  # begin a row later
    for n in (5, 10, 20, 30, 60):
        names.append(f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)")
        sums = {"ar": "abs(ret)", "pr": "CASE WHEN ret < 0 THEN 0 ELSE ret END", "av": "abs(dv)", "pv": "CASE WHEN dv < 0 THEN 0 ELSE dv END"}
        means = {"mc": "close", "mv": "volume", "mw": "wv", "up": "coalesce((ret > 0)::INT::DOUBLE, 0)", "dn": "coalesce((ret < 0)::INT::DOUBLE, 0)"}
        inner += [f"lag(close, {n}) OVER o AS old{n}", *[f"list({x}) OVER w{n} AS {x[0]}{n}" for x in ("close", "high", "low")]]
        for f, own in (("avg", means), ("stddev_samp", {"sc": "close", "sv": "volume", "sw": "wv"}), ("sum", sums)):
            inner += [f"{f}({x}) OVER w{n} AS {k}{n}" for k, x in own.items()]
        inner += [f"quantile_cont(close, 0.8) OVER w{n} AS qu{n}", f"quantile_cont(close, 0.2) OVER w{n} AS qd{n}", f"corr(close, lv) OVER w{n} AS cr{n}", f"corr(ratio, vr) OVER w{n} AS cd{n}"]
        lo, hi = f"least(low, old{n})", f"greatest(high, old{n})"
        sump, vsump = f"pr{n} / (ar{n} + {eps})", f"pv{n} / (av{n} + {eps})"
        imax, imin = f"(list_position(h{n}, list_max(h{n})) - 1)", f"(list_position(l{n}, list_min(l{n})) - 1)"
        rank = f"len(list_filter(c{n}, lambda x: x < close)) + (len(list_filter(c{n}, lambda x: x = close)) + 1) / 2.0::DOUBLE"
        own = {
            "roc": f"old{n} / close", "ma": f"mc{n} / close", "std": f"sc{n} / close", "beta": f"(old{n} - close) / ({n} * close)", "max": f"list_max(c{n}) / close", "min": f"list_min(c{n}) / close",
            "qtlu": f"qu{n} / close", "qtld": f"qd{n} / close", "rank": f"({rank}) / {n} / {n}", "imax": f"{imax} / {n}::DOUBLE", "imin": f"{imin} / {n}::DOUBLE", "imxd": f"({imax} - {imin}) / {n}::DOUBLE",
            "rsv": f"CASE WHEN old{n} IS NOT NULL THEN (close - {lo}) / ({hi} - {lo} + {eps}) END", "cntp": f"up{n}", "cntn": f"dn{n}", "cntd": f"up{n} - dn{n}", "corr": f"cr{n}", "cord": f"cd{n}",
            "sump": sump, "sumn": f"1 - {sump}", "sumd": f"2 * {sump} - 1", "vma": f"mv{n} / (volume + {eps})", "vstd": f"sv{n} / (volume + {eps})", "wvma": f"sw{n} / (mw{n} + {eps})",
            "vsump": vsump, "vsumn": f"1 - {vsump}", "vsumd": f"2 * {vsump} - 1",
        }
        cols |= {f"{k}_{n}": f"CASE WHEN rn >= {n + (k in moves)} THEN {x} END" for k, x in own.items()}
    cols["log_volume"] = "lv"
    clean = ", ".join(f"round(coalesce(CASE WHEN isfinite({x}) THEN {x} END, 0), 6) + 0 AS {k}" for k, x in cols.items())
    return f"""{RB}, m AS (SELECT *, lag(close) OVER o AS c1, lag(volume) OVER o AS v1, row_number() OVER o AS rn FROM b WINDOW o AS (PARTITION BY symbol ORDER BY date)),
p AS (SELECT *, close / c1 AS ratio, close / c1 - 1 AS ret, volume - v1 AS dv, ln(volume + 1) AS lv, ln(volume / v1 + 1) AS vr, abs(close / c1 - 1) * volume AS wv FROM m),
f AS (SELECT symbol, date, open, high, low, close, volume, rn, lv, {', '.join(inner)} FROM p WINDOW o AS (PARTITION BY symbol ORDER BY date), {', '.join(names)})
SELECT symbol, date, {clean}, day(date)::INT AS day, (isodow(date) - 1)::INT AS weekday, month(date)::INT AS month FROM f"""


@query(_factor_sql())
def factors_all(spark, d):
    df = A.factors(S.stand_in_bars(spark, d, "region"))
    parts = ("symbol", "date", "day", "weekday", "month")
    return df.select(*parts, *[(F.round(c, 6) + 0.0).alias(c) for c in df.columns if c not in parts])


@query(RB + """, k AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM b WHERE date < DATE '2000-01-01'),
s AS (SELECT symbol, max(close) FILTER (r = 21) / max(close) FILTER (r = 100) - 1 AS score FROM k GROUP BY symbol HAVING max(close) FILTER (r = 100) IS NOT NULL)
SELECT symbol, score, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM s QUALIFY row_number() OVER (ORDER BY score DESC, symbol) <= 3""")
def select_momentum(spark, d):
    return T.momentum(S.stand_in_bars(spark, d, "region"), "2000-01-01", k=3)


@query(NB + """, k AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM b WHERE date < DATE '2000-01-01'),
x AS (SELECT symbol, ln(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date)) AS x FROM k WHERE r <= 100), s AS (SELECT symbol, stddev_pop(x) AS score FROM x GROUP BY symbol HAVING stddev_pop(x) > 0)
SELECT symbol, round(score, 10) AS score, row_number() OVER (ORDER BY score, symbol) AS rank FROM s QUALIFY row_number() OVER (ORDER BY score, symbol) <= 5""")
def select_lowvol(spark, d):
    return T.low_volatility(S.stand_in_bars(spark, d), "2000-01-01").withColumn("score", F.round("score", 10))


@query(NB + ", s AS (SELECT symbol, avg(volume) AS score FROM b WHERE date < DATE '2000-01-01' GROUP BY symbol) SELECT symbol, score, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM s QUALIFY row_number() OVER (ORDER BY score DESC, symbol) <= 5")
def select_volume(spark, d):
    return T.top_volume(S.stand_in_bars(spark, d), "2000-01-01")


@query("WITH w AS (SELECT i::INT AS win, (DATE '1995-01-01' + to_years(i::INT))::DATE AS lo, (DATE '1995-01-01' + to_years(i::INT + 2))::DATE AS hi FROM range(0, 5) t(i)), " + bars_sql("n_name") + " SELECT win, lo, hi, symbol, count(*) AS n, min(date) AS first, max(date) AS last FROM b JOIN w ON date >= lo AND date < hi GROUP BY ALL")
def windows_rolling(spark, d):
    w = R.rolling_windows(spark, "1995-01-01", "2001-01-01", 2)
    return R.bars_in_windows(S.stand_in_bars(spark, d), w).groupBy("win", "lo", "hi", "symbol").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(NB + """, c AS (SELECT symbol, count(*) AS n FROM b GROUP BY symbol) SELECT symbol, n FROM c WHERE n >= (SELECT avg(n) FROM c)""")
def eligible_universe(spark, d):
    return R.enough_rows(S.stand_in_bars(spark, d))


@query(NB + """ SELECT symbol, date, least(open, high, low, close) <= 0 AS nonpositive, coalesce(adjusted_close / close > 100 OR adjusted_close / close < 0.01, false) AS extreme_adjustment, coalesce(abs(close / p - 1) > 0.5, false) AS jump,
coalesce(abs(p - open) > 0.2 * (p + open) AND p + open > 10, false) AS dirty FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM b)""")
def validation_flags(spark, d):
    return R.validation_flags(S.stand_in_bars(spark, d))


@query("WITH c AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE isodow(ts) < 6) SELECT event_id, CAST(ts AS DATE) AS day, (SELECT min(date) FROM c WHERE date >= CAST(ts AS DATE)) AS session FROM events")
def asof_next_session(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    return R.next_trading_day(e, e.select(F.col("day").alias("date")).distinct().where(F.weekday("date") < 5))


@query(RB + """, p AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM b)
SELECT symbol, pos AS at, count(*) OVER (w ROWS 4 PRECEDING) AS n, sum(close) OVER (w ROWS 4 PRECEDING) AS total, count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS n_ahead, sum(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ahead
FROM p WINDOW w AS (PARTITION BY symbol ORDER BY pos)""")
def range_state(spark, d):
    """The window [pos - 4, pos + 2] of every position, clamped at the ends; what lies after the position is summed apart."""
    rows = S.stand_in_bars(spark, d, "region").select("symbol", "close", F.row_number().over(I.series()).cast("long").alias("pos"))
    past, ahead = F.when(F.col("pos") <= F.col("at"), F.col("close")), F.when(F.col("pos") > F.col("at"), F.col("close"))
    return R.state_window(rows, rows, 4, 2).groupBy("symbol", "at").agg(F.count(past).alias("n"), F.sum(past).alias("total"), F.count(ahead).alias("n_ahead"), F.sum(ahead).alias("ahead"))


@query(RB + """, g AS (SELECT symbol, unnest(generate_series((SELECT min(date) FROM b), (SELECT max(date) FROM b), INTERVAL 1 DAY))::DATE AS date FROM (SELECT DISTINCT symbol FROM b)),
j AS (SELECT g.symbol, g.date, open, high, low, close, volume, coalesce(last_value(close IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(close IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c FROM g LEFT JOIN b ON b.symbol = g.symbol AND b.date = g.date WINDOW w AS (PARTITION BY g.symbol ORDER BY g.date))
SELECT symbol, date, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, coalesce(close, c) AS close, coalesce(volume, 0) AS volume FROM j""")
def grid_gap_fill(spark, d):
    return R.gap_fill(S.stand_in_bars(spark, d, "region").select("symbol", "date", "open", "high", "low", "close", "volume"))


@query("WITH " + TICKS + " SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_min(price, t.ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, t.ts) AS close, sum(size) AS volume FROM t GROUP BY symbol, time_bucket(INTERVAL 15 MINUTE, t.ts)")
def resample_minutes(spark, d):
    return R.resample(ticks(spark, d), "15 minutes")


@query("SELECT event_id, ts FROM events WHERE strftime(ts, '%H:%M') BETWEEN '09:30' AND '15:59'")
def trading_hours(spark, d):
    return table(spark, d, "events").where(F.date_format("ts", "HH:mm").between("09:30", "15:59")).select("event_id", "ts")


@query("SELECT event_id, (CAST(ts AS DATE) + CASE WHEN hour(ts) >= 16 THEN 1 ELSE 0 END)::DATE AS session FROM events")
def after_close_shift(spark, d):
    return table(spark, d, "events").select("event_id", X.next_session("ts").alias("session"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_join_jobs(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join_members(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(NB + RET + """, q AS (SELECT year(date)::INT AS win, symbol AS ticker, arg_max(equity, date) / arg_min(equity, date) - 1 AS m FROM r GROUP BY ALL)
SELECT CASE WHEN grouping(win) = 0 THEN win::VARCHAR ELSE 'Average' END AS win, CASE WHEN grouping(ticker) = 1 THEN 'All' ELSE ticker END AS ticker, avg(m) * 100 AS mean_pct, count(m) AS cells FROM q GROUP BY GROUPING SETS ((win, ticker), (ticker), ())""")
def report_grouping_sets(spark, d):
    r = M.returns(S.stand_in_bars(spark, d))
    return M.report(r.groupBy(F.year("date").alias("win"), F.col("symbol").alias("ticker")).agg((F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("total_return")))


@query(NB + RET + """, y AS (SELECT symbol, year(date) AS y, arg_max(equity, date) / arg_min(equity, date) - 1 AS yr FROM r GROUP BY ALL), s AS (SELECT symbol, count(*) AS years, product(1 + yr) - 1 AS compounded, avg(yr) AS mean, median(yr) AS median FROM y GROUP BY symbol)
SELECT *, rank() OVER (ORDER BY mean DESC) AS rank FROM s""")
def summary_rank(spark, d):
    r = M.returns(S.stand_in_bars(spark, d)).groupBy("symbol", F.year("date").alias("y")).agg((F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("yr"))
    s = r.groupBy("symbol").agg(F.count("*").alias("years"), (F.product(1 + F.col("yr")) - 1).alias("compounded"), F.avg("yr").alias("mean"), F.median("yr").alias("median"))
    return s.withColumn("rank", F.rank().over(W.orderBy(F.desc("mean"))).cast("long"))


@query(NB + RET + f""", e AS (SELECT *, ret - {M.daily_rate(0.03)!r}::DOUBLE AS x, (equity - max(equity) OVER w) / max(equity) OVER w AS dd FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT symbol, count(ret) AS n, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return, pow(arg_max(equity, date) / arg_min(equity, date), 252.0 / count(*)) - 1 AS annual_return, stddev_samp(ret) * sqrt(252) AS volatility,
avg(x) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(x) / sqrt(avg(pow(least(x, 0), 2)) FILTER (x IS NOT NULL)) * sqrt(252) AS sortino, -min(dd) * 100 AS max_drawdown FROM e GROUP BY symbol""")
def metrics_risk(spark, d):
    return M.risk(M.returns(S.stand_in_bars(spark, d)))


@query(NB + RET + """, v AS (SELECT symbol, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, kurtosis_pop(ret) AS kurt, quantile_cont(ret, 0.05) AS var5 FROM r WHERE ret IS NOT NULL GROUP BY symbol HAVING count(ret) >= 30),
k AS (SELECT r.symbol, avg(pow(ret - mean, 3)) / pow(avg(pow(ret - mean, 2)), 1.5) AS skew, avg(ret) FILTER (ret <= var5) AS cvar5 FROM r JOIN v USING (symbol) WHERE ret IS NOT NULL GROUP BY r.symbol),
t AS (SELECT symbol, avg(ret) FILTER (k <= 30) * 30 AS trailing_30, avg(ret) FILTER (k <= 90) * 90 AS trailing_90 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM r WHERE ret IS NOT NULL) GROUP BY symbol)
SELECT symbol, n, round(mean, 9) AS mean, round(std, 9) AS std, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(var5, 9) AS var5, round(cvar5, 9) AS cvar5, round(trailing_30, 9) AS trailing_30, round(trailing_90, 9) AS trailing_90 FROM v JOIN k USING (symbol) JOIN t USING (symbol)""")
def moments_var(spark, d):
    df = M.moments(M.returns(S.stand_in_bars(spark, d)))
    return df.select("symbol", "n", *[F.round(c, 9).alias(c) for c in ("mean", "std")], *[F.round(c, 6).alias(c) for c in ("skew", "kurt")], *[F.round(c, 9).alias(c) for c in ("var5", "cvar5", "trailing_30", "trailing_90")])


@query(RB + RET + " SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(corr(x.ret, y.ret), 9) AS corr FROM r x JOIN r y ON x.date = y.date AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL")
def correlation_matrix(spark, d):
    return M.correlations(M.returns(S.stand_in_bars(spark, d, "region"))).withColumn("corr", F.round("corr", 9))


@query(NB + RET + ", v AS (SELECT symbol, stddev_samp(ret) AS vol FROM r GROUP BY symbol) SELECT symbol, round(vol, 9) AS vol, round(1 / vol / sum(1 / vol) OVER (), 9) AS weight FROM v")
def inverse_volatility(spark, d):
    return T.inverse_volatility(M.returns(S.stand_in_bars(spark, d))).select("symbol", F.round("vol", 9).alias("vol"), F.round("weight", 9).alias("weight"))


def _window_bars(spark, d):
    bars = R.adjust(S.stand_in_bars(spark, d, "region"))
    return bars.select(F.year("date").cast("string").alias("win"), F.col("symbol").alias("ticker"), "date", "adjusted_open", "adjusted_close", "volume")


@query(RB + """, c AS (SELECT year(date)::VARCHAR AS win, symbol AS ticker, date, adjusted_close AS p, row_number() OVER (PARTITION BY year(date), symbol ORDER BY date) AS n, count(*) OVER (PARTITION BY year(date), symbol) AS total FROM b),
f AS (SELECT win, ticker, p AS p0, floor(100000 / p) AS q0 FROM c WHERE n = 1), q AS (SELECT *, q0 - (q0 * p0 + least(greatest(q0 * 0.0049::DOUBLE, 0.99::DOUBLE), q0 * p0 * 0.01::DOUBLE) > 100000)::INT AS q FROM f),
h AS (SELECT *, 100000 - q * p0 - least(greatest(q * 0.0049::DOUBLE, 0.99::DOUBLE), q * p0 * 0.01::DOUBLE) AS cash FROM q)
SELECT win, ticker, date, round(cash + q * p - CASE WHEN n = total THEN least(greatest(q * 0.0049::DOUBLE, 0.99::DOUBLE), q * p * 0.01::DOUBLE) ELSE 0 END, 6) AS equity FROM c JOIN h USING (win, ticker) WHERE total >= 2""")
def sim_buy_hold(spark, d):
    return B.backtest(_window_bars(spark, d)).withColumn("equity", F.round("equity", 6))


@query()
def sim_sma_cross(spark, d):
    bars = R.adjust(S.stand_in_bars(spark, d, "region"))
    bars = I.cross(bars, I.sma("adjusted_close", 10), I.sma("adjusted_close", 20), "signal").select(F.year("date").cast("string").alias("win"), F.col("symbol").alias("ticker"), "date", "adjusted_open", "adjusted_close", "volume", "signal")
    return B.backtest(bars, B.on_signal, B.TradeConfig(timing="next_open", slippage_perc=0.001, slippage_impact=0.1, liquidity_pct=0.1), "trades")


@query("SELECT vec_id AS id, qid, score, rank FROM (SELECT e.vec_id, q.vec_id AS qid, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def knn_inner_product(spark, d):
    e = table(spark, d, "embeddings")
    near = V.nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")))
    return near.withColumn("score", F.round("score", 9))


@query("SELECT vec_id AS id, qid, score, rank FROM (SELECT e.vec_id, q.vec_id AS qid, round(list_sum(list_transform(range(1, 65), lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2))), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(range(1, 65), lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2))), e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def knn_l2(spark, d):
    e = table(spark, d, "embeddings")
    near = V.nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), metric="l2")
    return near.withColumn("score", F.round("score", 9))


@query("SELECT event_id, exp(-(event_id % 50) / 10.0::DOUBLE) AS recency, value * pow(0.988::DOUBLE, event_id % 50) AS importance, exp(-(event_id % 50) / 10.0::DOUBLE) + least(value * pow(0.988::DOUBLE, event_id % 50), 100) / 100 AS compound FROM events WHERE exp(-(event_id % 50) / 10.0::DOUBLE) >= 0.05")
def memory_decay(spark, d):
    e = table(spark, d, "events").withColumn("age", F.col("event_id") % 50)
    recency, importance = V.decay("age", "value")
    return e.select("event_id", recency.alias("recency"), importance.alias("importance")).withColumn("compound", V.compound("recency", "importance")).where("recency >= 0.05")


NEWS = "n AS (SELECT source AS symbol, (DATE '2024-01-01' + (doc_id % 30)::INT)::DATE AS date, doc_id AS item_index, text FROM documents)"


def news(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("symbol"), F.expr("date_add(date'2024-01-01', cast(doc_id % 30 as int))").alias("date"), F.col("doc_id").alias("item_index"), F.col("text").alias("news_text"))


@query("WITH " + NEWS + " SELECT symbol, date, count(*) AS n, md5(string_agg(text, '|' ORDER BY item_index)) AS digest FROM n GROUP BY ALL")
def news_grouped(spark, d):
    return S.group_news(news(spark, d)).select("symbol", "date", F.size("news").cast("long").alias("n"), F.md5(F.array_join("news", "|")).alias("digest"))


@query("WITH " + NEWS + " SELECT symbol, date, md5(string_agg(text, chr(10) || chr(10) ORDER BY item_index)) AS merged, md5(arg_max(text, item_index)) AS latest FROM n GROUP BY ALL")
def filing_merge(spark, d):
    f = news(spark, d).withColumnsRenamed({"item_index": "filing_idx", "news_text": "filing_text"})
    a, b = S.merge_filings(f).select("symbol", "date", F.md5("filing_text").alias("merged")), S.merge_filings(f, "latest").select("symbol", "date", F.md5("filing_text").alias("latest"))
    return a.join(b, ["symbol", "date"])


@query("SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[\\n\\r\\t]', ' ', 'g')) AS cleaned, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, sha256(text) AS sha, md5(replace(text, ' ', '')) AS key FROM documents")
def news_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_news("text")).alias("cleaned"), X.preview("text").alias("preview"), F.sha2("text", 256).alias("sha"), F.md5(X.dedup_key("text")).alias("key"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _plain_sql(x: str) -> str:
    """SQL of normalised text."""
    for a, b in X.ENTITIES:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    x = f"regexp_replace({x}, '[{X.INVISIBLE}]', '', 'g')"
    x = f"translate({x}, {_quoted(X.TYPOGRAPHIC[0])}, {_quoted(X.TYPOGRAPHIC[1])})"
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f]+', ' ', 'g'))"


@query("SELECT page_id, " + _plain_sql("regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')") + " AS text FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_tags("html").alias("text"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT conv_id, turn, m AS model, CASE WHEN contains(m, 'gpt-4o-mini') THEN (p * 0.15::DOUBLE + c * 0.6::DOUBLE) / 1e6 WHEN contains(m, 'gpt-4o') THEN (p * 2.5::DOUBLE + c * 10.0::DOUBLE) / 1e6 ELSE 0 END AS cost FROM (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' ELSE 'other' END AS m, length(text) // 4 AS p, length(text) // 8 AS c FROM conversations)")
def llm_cost(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.expr("CASE conv_id % 3 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' ELSE 'other' END").alias("model"), F.expr("length(text) div 4").alias("p"), F.expr("length(text) div 8").alias("c"))
    return c.select("conv_id", "turn", "model", X.token_cost("model", "p", "c").alias("cost"))


@query(NB + " SELECT symbol, date, volume / max(abs(volume)) OVER (PARTITION BY symbol) AS scaled, coalesce(close / lag(close) OVER w, 1) AS variation, first_value(close) OVER w AS first_close FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def scaled_panel(spark, d):
    top = F.max(F.abs("volume")).over(W.partitionBy("symbol"))
    return S.stand_in_bars(spark, d).select("symbol", "date", F.when(top == 0, F.col("volume")).otherwise(F.col("volume") / top).alias("scaled"), F.coalesce(F.col("close") / I.lag("close"), F.lit(1.0)).alias("variation"), F.first("close").over(I.series()).alias("first_close"))


@query("""WITH q AS (SELECT o_orderpriority AS symbol, date_trunc('quarter', o_orderdate)::DATE AS date, sum(o_totalprice) AS revenue, avg(o_totalprice) AS mean_order FROM orders GROUP BY ALL)
SELECT symbol, date, sum(revenue) OVER w AS trailing_revenue, mean_order / nullif(sum(revenue) OVER w, 0) AS ratio FROM q WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def fundamentals_trailing(spark, d):
    q = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("date")).agg(F.sum("o_totalprice").alias("revenue"), F.avg("o_totalprice").alias("mean_order"))
    trailing = F.sum("revenue").over(I.series().rowsBetween(-3, -1))
    return q.select("symbol", "date", trailing.alias("trailing_revenue"), (F.col("mean_order") / F.nullif(trailing, F.lit(0.0))).alias("ratio"))


@query(RB + " SELECT symbol, date, lead(close) OVER w / close - 1 AS ret1, coalesce((lead(close) OVER w / close - 1 > 0)::INT, 0) AS mov1 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def forward_labels(spark, d):
    return I.forward_label(S.stand_in_bars(spark, d, "region")).select("symbol", "date", "ret1", "mov1")


@query(RB + RET + """, p AS (SELECT x.symbol AS a, y.symbol AS b, x.ret - y.ret AS d FROM r x JOIN r y ON x.date = y.date AND x.symbol < y.symbol WHERE x.ret <> y.ret),
k AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY a, b, abs(d)) AS t FROM p),
s AS (SELECT a, b, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE AS wp, coalesce(sum(rk) FILTER (d < 0), 0)::DOUBLE AS wm, sum(t * t - 1)::DOUBLE AS ties FROM k GROUP BY ALL)
SELECT a, b, n, wp AS w_plus, wm AS w_minus, round((wp - n * (n + 1) / 4.0::DOUBLE) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 9) AS z FROM s""")
def wilcoxon_pairs(spark, d):
    return Q.wilcoxon(Q.pairs(M.returns(S.stand_in_bars(spark, d, "region")))).withColumn("z", F.round("z", 9))


@query(RB + RET + """, e AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos, sign(ret)::INT AS act FROM r WHERE ret IS NOT NULL)
SELECT x.symbol AS a, y.symbol AS b, count(*) AS steps, round(avg((x.act = y.act)::INT), 9) AS overlap FROM e x JOIN e y ON x.pos = y.pos AND x.symbol < y.symbol GROUP BY ALL""")
def episode_overlap(spark, d):
    r = M.returns(S.stand_in_bars(spark, d, "region")).where("ret IS NOT NULL")
    e = r.select(F.col("symbol").alias("episode"), F.row_number().over(W.partitionBy("symbol").orderBy("date")).alias("pos"), F.signum("ret").cast("int").alias("action"))
    return Q.episode_overlap(e).withColumn("overlap", F.round("overlap", 9))


@query(RB + """, a AS (SELECT symbol, date, sign(close - open) * ln(lead(close) OVER (PARTITION BY symbol ORDER BY date) / close) * 0.1::DOUBLE AS r FROM b),
t AS (SELECT symbol, r, sum(r) OVER w AS total, date FROM a WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
f AS (SELECT symbol, r, max(total) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - total AS fall FROM t)
SELECT symbol, count(*) AS n, round(sum(r), 6) AS reward, round(stddev_samp(r), 6) AS std, round(exp(sum(ln(1 + r))) - 1, 6) AS compounded, round(max(fall), 6) AS max_fall FROM f GROUP BY symbol""")
def log_reward_metrics(spark, d):
    bars = S.stand_in_bars(spark, d, "region").withColumn("action", F.signum(F.col("close") - F.col("open")) * 0.1)
    return Q.log_rewards(bars).select("symbol", "n", *[F.round(c, 6).alias(c) for c in ("reward", "std", "compounded", "max_fall")])


@query("""WITH k AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, role, count(*) AS items, substr(string_agg(substr(coalesce(text, ''), 1, 100), ' | ' ORDER BY r), 1, 500) AS summary FROM k WHERE r <= 3 GROUP BY ALL""")
def working_memory(spark, d):
    return Q.last_items(table(spark, d, "conversations"), ["conv_id", "role"], "turn")


@query("""WITH g AS (SELECT DISTINCT o_orderpriority AS setup FROM orders), w AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS win FROM orders),
h AS (SELECT o_orderpriority AS setup, strftime(o_orderdate, '%Y-%m') AS win, count(*) AS have FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT setup, win, coalesce(have, 0) AS have, CASE WHEN have >= 8 THEN 'complete' WHEN have > 0 THEN 'partial' ELSE 'missing' END AS status FROM g CROSS JOIN w LEFT JOIN h USING (setup, win)""")
def job_inventory(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("setup"), F.date_format("o_orderdate", "yyyy-MM").alias("win"), "o_orderstatus")
    windows = o.agg(F.collect_set("win").alias("w"))  # the grid's months and setups are few
    grid = o.select("setup").distinct().join(F.broadcast(windows)).select("setup", F.explode("w").alias("win"))
    return Q.inventory(grid, o.where("o_orderstatus = 'F'"), ["setup", "win"], 8)


#: Two-sided p of |z| in SQL: the series near 0, the continued fraction beyond.
_TAILS = ("CASE WHEN abs({z}) < 1 THEN 1 - 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 41), lambda k: abs({z}) * pow({z} * {z}, k) / list_product(list_transform(range(0, k + 1), lambda i: 2.0::DOUBLE * i + 1)))) "
          "ELSE 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) / list_reduce([abs({z})] || list_transform(range(0, 200), lambda i: 200.0::DOUBLE - i), lambda f, k: abs({z}) + k / f) END")
_RANKED = """k AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {g}, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {g}, abs(d)) AS t FROM p WHERE d <> 0),
s AS (SELECT {g}, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE AS wp, coalesce(sum(rk) FILTER (d < 0), 0)::DOUBLE AS wm, sum(t * t - 1)::DOUBLE AS ties FROM k GROUP BY ALL),
o AS (SELECT {g}, count(*) FILTER (d = 0) AS zeros FROM p GROUP BY ALL),
z AS (SELECT *, least(wp, wm) AS w, (wp - n * (n + 1) / 4.0::DOUBLE) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s JOIN o USING ({g}))"""


@query(RB + RET + ", p AS (SELECT x.symbol AS a, y.symbol AS b, x.ret - y.ret AS d FROM r x JOIN r y ON x.date = y.date AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL), "
+ _RANKED.format(g="a, b") + " SELECT a, b, n, w AS statistic, round(" + _TAILS.format(z="z") + ", 10) AS p, 'normal' AS method FROM z")
def signed_rank_pairs(spark, d):
    got = Q.signed_rank(Q.pairs(M.returns(S.stand_in_bars(spark, d, "region"))))
    return got.select("a", "b", "n", "statistic", F.round("p", 10).alias("p"), "method")


@query(RB + RET + ", p AS (SELECT x.symbol AS a, y.symbol AS b, strftime(date, '%Y-%m') AS month, x.ret - y.ret AS d FROM r x JOIN r y USING (date) WHERE x.symbol < y.symbol AND x.ret IS NOT NULL AND y.ret IS NOT NULL), "
+ _RANKED.format(g="a, b, month") + """, c AS (SELECT n, list_reduce([[1.0::DOUBLE]] || list_transform(range(1, n + 1), lambda i: [i::DOUBLE]), lambda c, x: list_transform(range(1, len(c) + x[1]::INT + 1), lambda i: (CASE WHEN i <= len(c) THEN c[i] ELSE 0 END) + (CASE WHEN i > x[1] THEN c[(i - x[1])::INT] ELSE 0 END))) AS c FROM (SELECT DISTINCT n FROM z WHERE n <= 50))
SELECT a, b, month, z.n, zeros, w AS statistic, CASE WHEN z.n <= 50 AND ties = 0 AND zeros = 0 THEN 'exact' ELSE 'normal' END AS method,
round(CASE WHEN z.n <= 50 AND ties = 0 AND zeros = 0 THEN least(1, 2 * list_sum(c[1:w::INT + 1]) / pow(2.0::DOUBLE, z.n)) ELSE """ + _TAILS.format(z="z.z") + " END, 10) AS p FROM z LEFT JOIN c USING (n)")
def signed_rank_months(spark, d):
    """Exact two-sided p of each month's daily returns, pair by pair."""
    paired = Q.pairs(M.returns(S.stand_in_bars(spark, d, "region"))).withColumn("month", F.date_format("date", "yyyy-MM"))
    got = Q.signed_rank(paired, ("a", "b", "month")).where("n > 0")
    return got.select("a", "b", "month", "n", "zeros", "statistic", "method", F.round("p", 10).alias("p"))


@query(RB + RET + """, w AS (SELECT date, x.ret AS x, y.ret AS y, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT * FROM r WHERE symbol = 'ASIA' AND ret IS NOT NULL) x JOIN (SELECT * FROM r WHERE symbol = 'EUROPE' AND ret IS NOT NULL) y USING (date)),
m AS (SELECT date, i, x - avg(x) OVER o AS dx, y - avg(y) OVER o AS dy, var_samp(x) OVER o AS vx, var_samp(y) OVER o AS vy, covar_samp(x, y) OVER o AS c FROM w WINDOW o AS (ORDER BY i ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT date, round(CASE WHEN i < 62 THEN 0 ELSE (dx * dx * vy - 2 * dx * dy * c + dy * dy * vx) / (vx * vy - c * c) END, 6) AS turbulence FROM m""")
def turbulence_pair(spark, d):
    """The turbulence of two symbols over 60 days; its SQL inverts the covariance by hand."""
    two = S.stand_in_bars(spark, d, "region").where("symbol IN ('ASIA', 'EUROPE')")
    return Q.turbulence(M.returns(two), history=60).withColumn("turbulence", F.round("turbulence", 6))


@query()
def turbulence_index(spark, d):
    return Q.turbulence(M.returns(S.stand_in_bars(spark, d, "region")))


from . import extended, indexed, simulated, stored, streamed  # noqa: E402, F401  their queries join the catalogue

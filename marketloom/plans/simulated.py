"""Queries of simulations, environments, jobs, memory layers and filing sections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import broker as K
from ..operators import environments as E
from ..operators import extend as G
from ..operators import indicators as I
from ..operators import jobs as O
from ..operators import memory as V
from ..operators import relational as R
from ..operators import sections as C
from ..operators import simulate as B
from ..sources import market as S
from .base import RB, query, table


def _days(spark, d):
    """Five regions as one episode a year: closes, an action from the day's move, turbulence from the day's range."""
    w = W.partitionBy("symbol").orderBy("date")
    b = S.stand_in_bars(spark, d, "region")
    action = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)) * 0.5, F.lit(0.0))
    return b.select(F.year("date").cast("string").alias("episode"), "date", "symbol", (F.col("close") / 100).alias("close"), action.alias("action"), (F.col("high") / F.col("low")).alias("turbulence"))


def _env(make):
    def run(spark, d):
        return E.play(_days(spark, d), make).select("episode", "date", F.round("assets", 4).alias("assets"), F.round("cash", 4).alias("cash"), F.round("reward", 8).alias("reward"), "note")

    return run


for _name, _make in {
    "env_stocks": lambda n: E.StockEnv(n, cash=10_000.0, risk_limit=40.0, activity=True), "env_cash_penalty": lambda n: E.CashPenaltyEnv(n, cash=10_000.0, most=200.0, patient=True),
    "env_stop_loss": lambda n: E.StopLossEnv(n, cash=10_000.0, most=200.0, patient=True), "env_array": lambda n: E.ArrayEnv(n, cash=10_000.0, risk_limit=40.0),
    "env_weights": lambda n: E.WeightsEnv(n), "env_allocation": lambda n: E.AllocationEnv(n),
}.items():
    _run = _env(_make)
    _run.__name__ = _name
    query()(_run)


@query(RB + " SELECT symbol, date, CASE WHEN lead(close) OVER (PARTITION BY symbol ORDER BY date) > close THEN 1 ELSE -1 END::INT AS action FROM b")
def oracle_actions(spark, d):
    return S.stand_in_bars(spark, d, "region").select("symbol", "date", E.oracle_action().alias("action"))


def _priced(spark, d):
    bars = R.adjust(S.stand_in_bars(spark, d, "region"))
    return bars.select(F.year("date").cast("string").alias("win"), F.col("symbol").alias("ticker"), "date", F.col("adjusted_close").alias("price"))


@query()
def hindsight_actions(spark, d):
    return B.hindsight_actions(_priced(spark, d))


@query()
def hindsight_few_sales(spark, d):
    return B.hindsight_actions(_priced(spark, d), most_sells=2)


@query("WITH RECURSIVE " + RB[5:] + """, p AS (SELECT year(date)::VARCHAR AS win, symbol AS ticker, date, adjusted_close AS price, row_number() OVER w AS n, coalesce(sign(adjusted_close - lag(adjusted_close) OVER w) / 2.0::DOUBLE, 0) AS action FROM b WINDOW w AS (PARTITION BY year(date), symbol ORDER BY date)),
t AS (SELECT win, ticker, date, n, price, 0.0::DOUBLE AS traded, 0.0::DOUBLE AS held, 10000.0::DOUBLE AS cash, 10000.0::DOUBLE AS val, 0.0::DOUBLE AS ret, 0.0::DOUBLE AS total, 0.99::DOUBLE AS weight FROM p WHERE n = 1 UNION ALL
SELECT win, ticker, date, n, price, q, held + q, cash - q * price - abs(q) * price * 0.001::DOUBLE, cash - q * price - abs(q) * price * 0.001::DOUBLE + (held + q) * price, (cash - q * price - abs(q) * price * 0.001::DOUBLE + (held + q) * price) / val - 1,
total + weight * ((cash - q * price - abs(q) * price * 0.001::DOUBLE + (held + q) * price) / val - 1), weight * 0.99::DOUBLE FROM
(SELECT p.win, p.ticker, p.date, p.n, p.price, t.held, t.cash, t.val, t.total, t.weight, CASE WHEN p.action > 0 THEN floor(p.action * floor(t.cash / p.price / 1.001::DOUBLE)) ELSE -floor(-p.action * floor(t.held)) END AS q FROM t JOIN p ON p.win = t.win AND p.ticker = t.ticker AND p.n = t.n + 1))
SELECT win, ticker, date, traded + 0 AS traded, held, round(cash, 4) AS cash, round(val, 4) AS value, round(ret, 8) AS ret, round(total, 6) AS total_return FROM t""")
def trading_env(spark, d):
    w = W.partitionBy("win", "ticker").orderBy("date")
    bars = _priced(spark, d)
    got = B.trading_env(bars.withColumn("action", F.coalesce(F.signum(F.col("price") - F.lag("price").over(w)) / 2, F.lit(0.0))))
    return got.select("win", "ticker", "date", (F.col("traded") + 0.0).alias("traded"), "held", F.round("cash", 4).alias("cash"), F.round("value", 4).alias("value"), F.round("ret", 8).alias("ret"), F.round("total_return", 6).alias("total_return"))


def _signalled(spark, d):
    bars = R.adjust(S.stand_in_bars(spark, d, "region"))
    bars = I.cross(bars, I.sma("adjusted_close", 10), I.sma("adjusted_close", 20), "signal")
    return bars.select(F.year("date").cast("string").alias("win"), F.col("symbol").alias("ticker"), "date", "adjusted_open", "adjusted_close", "volume", "signal")


@query()
def broker_equity(spark, d):
    return K.run_signals(_signalled(spark, d), B.TradeConfig(timing="next_open", liquidity_pct=0.1, slippage_perc=0.001))


@query()
def broker_orders(spark, d):
    return K.run_signals(_signalled(spark, d), B.TradeConfig(timing="next_open", liquidity_pct=0.1, slippage_perc=0.001), "orders")


class Patient(G.Strategy):
    """Buys on a close under its training mean, sells over it, and pays for each day's advice."""

    def train(self, history):
        self.mean = sum(b["adjusted_close"] for b in history) / len(history) if history else float("inf")

    def on_data(self, bar, account):
        if bar["adjusted_close"] < self.mean and account.shares == 0:
            account.buy()
        elif bar["adjusted_close"] > self.mean * (1 + self.params.get("margin", 0)) and account.shares:
            account.sell()

    def finalize(self):
        return {"training_mean": self.mean}


@query()
def trained_strategy(spark, d):
    bars = R.adjust(S.stand_in_bars(spark, d, "region")).withColumns({"win": F.lit("all"), "ticker": F.col("symbol"), "training": F.col("date") < "1995-01-01", "advice": F.lit(0.25)})
    return G.run_strategy(bars.select("win", "ticker", "date", "adjusted_open", "adjusted_close", "volume", "training", "advice"), Patient, params={"margin": lambda rows: 0.01}, external="advice", training_cost=5.0)


@query("""WITH j AS (SELECT DISTINCT o_orderpriority AS setup, year(o_orderdate)::VARCHAR AS "window", o_orderstatus AS ticker FROM orders), s AS (SELECT o_orderpriority AS setup, year(o_orderdate)::VARCHAR AS "window", o_orderstatus AS ticker, arg_max(CASE WHEN o_custkey % 2 = 0 THEN 'running' ELSE 'failed' END, (o_orderdate, o_orderkey)) AS last, max(o_orderdate) AS seen, count(*) FILTER (o_custkey % 2 = 0) AS attempts FROM orders WHERE o_totalprice < 150000 GROUP BY ALL),
r AS (SELECT o_orderpriority AS setup, year(o_orderdate)::VARCHAR AS "window", o_orderstatus AS ticker, count(*) AS have FROM orders WHERE o_totalprice > 200000 GROUP BY ALL)
SELECT j.setup, j."window", j.ticker, coalesce(have, 0) AS have, CASE WHEN have >= 10 THEN 'complete' WHEN last = 'running' AND epoch(TIMESTAMP '1998-01-01') - epoch(seen) > 31536000 THEN 'timeout' WHEN last IN ('running', 'failed') THEN last WHEN have > 0 THEN 'partial' ELSE 'missing' END AS state, coalesce(attempts, 0) AS attempts
FROM j LEFT JOIN s USING (setup, "window", ticker) LEFT JOIN r USING (setup, "window", ticker)""")
def job_states(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("setup"), F.year("o_orderdate").cast("string").alias("window"), F.col("o_orderstatus").alias("ticker"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") / 1e6)).alias("at"), "o_totalprice", F.when(F.col("o_custkey") % 2 == 0, "running").otherwise("failed").alias("status"))
    return O.states(o.select(*O.KEYS).distinct(), o.where("o_totalprice < 150000"), o.where("o_totalprice > 200000"), "1998-01-01", 31_536_000, 10)


@query("SELECT s.setup, w.\"window\", t.ticker FROM (VALUES ('selected_5'), ('cherry_pick_5')) s(setup), (VALUES ('2020'), ('2021')) w(\"window\"), (VALUES ('TSLA'), ('NFLX'), ('AMZN'), ('MSFT'), ('COIN')) t(ticker)")
def job_grid(spark, d):
    names = ("selected_5", "cherry_pick_5")
    return O.grid(spark, {n: list(O.setup(n)["tickers"]) for n in names}, ["2020", "2021"])


@query()
def memory_layers(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), F.expr("CASE event_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'mid' ELSE 'long' END").alias("layer"), (F.col("event_id") % 40 + 1).alias("day"))
    feedback = e.where("id % 9 = 0").select("symbol", "id", (F.col("day") + 2).alias("day"), F.lit(1).alias("value"))
    return V.lifecycle(e.withColumn("importance", V.first_importance()), 50, feedback)


#: A filing of each document: filler, the discussion in as many paragraphs as its id gives, and what follows.
_FILLER = "Business background line. Prior-period operating context."
_PARAGRAPH = "Management analysis of the year. Revenue, margin, liquidity and cash flow trends are described in a full sentence."


def filings(spark, d):
    n = (F.col("doc_id") % 7 + 12).cast("int")
    text = F.concat_ws(
        "\n", F.lit("ANNUAL REPORT"), F.lit("PART I"), F.lit("ITEM 1. BUSINESS"), F.array_join(F.array_repeat(F.lit(_FILLER), 230), "\n"), F.lit("PART II"),
        F.lit("ITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS OF FINANCIAL CONDITION AND RESULTS OF OPERATIONS"), F.array_join(F.array_repeat(F.lit(_PARAGRAPH), n), "\n"),
        F.lit("ITEM 7A. QUANTITATIVE AND QUALITATIVE DISCLOSURES ABOUT MARKET RISK"), F.lit("Interest moves would change our expense by an amount that is not material to us."),
    )
    return table(spark, d, "documents").select("doc_id", text.alias("filing_text"))


_N = "(doc_id % 7 + 12)"
_SECTIONS = f"""SELECT doc_id, 'item_1' AS item_key, 3 AS heading_line, 4 AS line_start, 234 AS line_end, {230 * len(_FILLER) + 229 + len("PART II") + 1} AS body_chars, 'pass' AS audit_status FROM documents
UNION ALL SELECT doc_id, 'item_7', 235, 236, (235 + {_N})::INT, ({_N} * {len(_PARAGRAPH) + 1} - 1)::INT, 'pass' FROM documents
UNION ALL SELECT doc_id, 'item_7a', (236 + {_N})::INT, (237 + {_N})::INT, (237 + {_N})::INT, {len("Interest moves would change our expense by an amount that is not material to us.")}, 'warn' FROM documents"""


@query(f"SELECT doc_id, item_key, heading_line::INT AS heading_line, line_start::INT AS line_start, line_end::INT AS line_end, body_chars::INT AS body_chars, audit_status FROM ({_SECTIONS}) UNION ALL SELECT doc_id, 'item_1a', NULL, NULL, NULL, NULL, 'warn' FROM documents")
def filing_sections(spark, d):
    got = C.filing_sections(filings(spark, d), "10-K", ("item_1", "item_1a", "item_7", "item_7a"), keep=("doc_id",))
    return got.select("doc_id", "item_key", "heading_line", "line_start", "line_end", "body_chars", "audit_status")


@query(f"SELECT doc_id, sha256('Part II Item 7. Management''s Discussion and Analysis of Financial Condition and Results of Operations' || repeat(chr(10) || '{_PARAGRAPH}', {_N}::INT)) AS digest FROM documents")
def filing_overlay(spark, d):
    return C.overlay(filings(spark, d), "10-K", "item_7").select("doc_id", F.sha2("filing_text", 256).alias("digest"))


@query(f"SELECT doc_id, l.line::INT AS line, l.code FROM documents, LATERAL (SELECT unnest([3, 235, 236 + {_N}]) AS line, unnest(['1', '7', '7A']) AS code) l")
def filing_headings(spark, d):
    return C.heading_lines(filings(spark, d), keep=("doc_id",))


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber::VARCHAR AS i, l_linenumber * 10 AS lo, l_linenumber * 10 + (l_quantity::INT % 13) AS hi FROM lineitem)
SELECT a.k, a.i AS a_item_key, b.i AS b_item_key, (least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1)::INT AS lines, CASE WHEN least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 <= 2 THEN 'warn' ELSE 'fail' END AS severity FROM s a JOIN s b ON a.k = b.k AND (a.lo, a.hi, a.i) < (b.lo, b.hi, b.i) AND least(a.hi, b.hi) >= greatest(a.lo, b.lo)""")
def section_overlaps(spark, d):
    n = F.col("l_linenumber").cast("int")
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), n.cast("string").alias("item_key"), (n * 10).alias("line_start"), (n * 10 + F.col("l_quantity").cast("int") % 13).alias("line_end"))
    return C.section_overlaps(s, ("k",))

"""Queries over what they write or make known first: vectors by cells, a store of changes, claimed jobs, named sources and functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import leases as L
from ..operators import sqlnames as Q
from ..operators import store as K
from ..operators import vector_index as N
from ..operators.folders import shared
from ..sources import datasource as D
from ..sources import layout as Y
from ..sources import market as S
from .base import NB, query, table

_Q = "embeddings q WHERE q.vec_id % 100 = 0"
_UNIT = "WITH v AS (SELECT vec_id, vec_id % 7 AS grp, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"


def _store(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@query(f"""SELECT qid, id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM (
SELECT q.vec_id AS qid, e.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2))) AS score FROM embeddings e, {_Q}) QUALIFY rank <= 5""")
def index_l2(spark, d):
    """The nearest by distance, through an index with cell bounds: all rows count."""
    store, queries = _store(spark, d)
    got = N.build(store, shared(spark, "cells")).search(queries, exact=True)
    return got.select("qid", "id", F.round("score", 9).alias("score"), "rank")


@query(_UNIT + """, s AS (SELECT x.grp AS symbol, q.vec_id AS qid, x.vec_id AS id, list_dot_product(x.e, q.e) / x.n AS score FROM v x JOIN v q ON q.grp = x.grp WHERE q.vec_id % 100 = 0)
SELECT symbol, qid, id, round(score, 9) AS score, row_number() OVER (PARTITION BY symbol, qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5""")
def index_by_group(spark, d):
    """The largest products with the normalised vectors of a query's own group, through an index."""
    store, queries = _store(spark, d)
    index = N.build(store.withColumn("group", F.col("id") % 7), shared(spark, "cells"), metric="dot", unit=True)
    got = index.search(queries.withColumn("group", F.col("qid") % 7), exact=True)
    return got.select(F.col("group").alias("symbol"), "qid", "id", F.round("score", 9).alias("score"), "rank")


@query(_UNIT + """, s AS (SELECT q.vec_id AS qid, x.vec_id AS id, list_dot_product(x.e, q.e) / (x.n * q.n) AS near, ((x.vec_id % 10) / 10.0::DOUBLE) * pow(0.95::DOUBLE, x.vec_id % 30) AS w FROM v x, v q WHERE q.vec_id % 100 = 0)
SELECT qid, id, round(near + w, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY near + w DESC, id) AS rank FROM s WHERE near >= 0.1 QUALIFY rank <= 5""")
def index_recall_events(spark, d):
    """Events by cosine of at least 0.1 plus decayed importance, through an index that knows each cell's largest importance."""
    store, queries = _store(spark, d)
    worth = (F.col("id") % 10) / 10.0 * F.pow(F.lit(0.95), F.col("id") % 30)
    index = N.build(store.withColumn("bonus", worth), shared(spark, "cells"), metric="dot", unit=True)
    got = index.search(queries.withColumn("q", N.normalised("q")), exact=True, least=0.1)
    return got.select("qid", "id", F.round("score", 9).alias("score"), "rank")


@query()
def index_recall(spark, d):
    """(qid, recall, cells, scored, held): what the eight nearest cells find of the true five nearest, and how many rows they score for it."""
    store, queries = _store(spark, d)
    index = N.build(store, shared(spark, "cells"))
    near, true = index.search(queries, probes=8).select("qid", "id", F.lit(1).alias("hit")), index.search(queries, exact=True).select("qid", "id")
    share = true.join(near, ["qid", "id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
    return share.join(index.work(queries, 8), "qid")


@query("SELECT event_id AS id, CASE WHEN value < 20 THEN value * 2 ELSE value END AS value FROM events WHERE NOT value < 10")
def memory_log(spark, d):
    """A store of changes: rows, then changed and deleted ones, compacted."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "value")
    store = K.LogStore(spark, shared(spark, "store"))
    store.change(e)
    store.change(e.where("value < 20").select("id", (F.col("value") * 2).alias("value"), (F.col("value") < 10).alias("gone")))
    store.compact()
    return store.rows()


@query("SELECT o_orderstatus AS setup, 'all' AS \"window\", o_orderpriority AS ticker, 'complete' AS status, count(*)::BIGINT AS n, max(o_totalprice) AS most FROM orders GROUP BY ALL")
def leased_jobs(spark, d):
    """Jobs by status and priority of the orders, claimed and run by this driver; a second one finds nothing left."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("setup"), F.lit("all").alias("window"), F.col("o_orderpriority").alias("ticker"), "o_totalprice")
    path, schema = shared(spark, "leases"), "n long, most double"

    def fn(key, rows):
        return pd.DataFrame({"n": [len(rows)], "most": [float(rows["o_totalprice"].max())]})

    for _ in range(2):
        leases = L.Leases(spark, path)
        L.run_shared(o.select("setup", "window", "ticker").distinct(), o, fn, schema, leases)
    return L.shared_results(leases, schema).drop("error")


@query(NB + " SELECT date, symbol, close, volume, year(date)::INT AS year FROM b WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-06-30' AND symbol IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_7')")
def named_source(spark, d):
    """Prices of a clustered folder through the source that is named in SQL."""
    path = shared(spark, "named")
    bars = S.stand_in_bars(spark, d).withColumns({"cik": F.lit("1"), "year": F.year("date")}).select(*[f.name for f in S.PRICE])
    Y.write_clustered(bars, f"{path}/price_daily")
    D.register(spark)
    options = f"path '{path}', table 'price', first '1996-03-01', last '1998-06-30', symbols 'NATION_1,NATION_3,NATION_5,NATION_7'"
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW named_prices USING marketloom OPTIONS ({options})")
    return spark.sql("SELECT date, symbol, close, volume, year FROM named_prices")


@query(NB + """, h AS (SELECT year(date)::VARCHAR AS win, symbol, close, row_number() OVER (PARTITION BY year(date), symbol ORDER BY date DESC) AS r FROM b),
m AS (SELECT win, symbol, max(close) FILTER (r = 5) / max(close) FILTER (r = 20) - 1 AS score FROM h GROUP BY ALL HAVING count(*) >= 20)
SELECT win, symbol, round(score, 9) AS score, row_number() OVER (PARTITION BY win ORDER BY score DESC, symbol) AS rank FROM m QUALIFY rank <= 3 AND count(*) OVER (PARTITION BY win) >= 3""")
def sql_momentum(spark, d):
    """The best three symbols of each year by a table function, called from SQL."""
    Q.register(spark)
    S.stand_in_bars(spark, d).withColumn("win", F.year("date").cast("string")).createOrReplaceTempView("bars_by_year")
    return spark.sql("SELECT win, symbol, round(score, 9) AS score, rank FROM momentum_symbols(TABLE(SELECT win, symbol, date, close FROM bars_by_year) PARTITION BY win ORDER BY (symbol, date), 20, 5, 3)")


@query("SELECT event_id, CASE WHEN value > 0 THEN floor(1000 * 0.5::DOUBLE / value)::BIGINT ELSE 0 END AS shares, round(value * pow(0.988::DOUBLE, event_id % 50), 9) AS importance, round(exp(-(event_id % 50) / 10.0::DOUBLE) + least(value, 100) / 100, 9) AS score FROM events")
def sql_scalars(spark, d):
    """Scalar functions that SQL knows by name."""
    Q.register(spark)
    table(spark, d, "events").createOrReplaceTempView("events_of_scalars")
    return spark.sql("""SELECT event_id, whole_shares(1000, value, 0.5) AS shares, round(decayed(value, cast(event_id % 50 AS INT), 0.988), 9) AS importance,
        round(compound_score(exp(-(event_id % 50) / 10D), value), 9) AS score FROM events_of_scalars""")

"""The register of named queries, and SQL that many of them begin with.

Modules of queries import this one and never each other's register, so that a worker can
import any of them first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bars_sql(name: str, more: str = "") -> str:
    return f"""l AS (SELECT {name} AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, l_quantity AS qty, 1 - l_discount AS ratio,
  row_number() OVER (PARTITION BY {name}, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS k
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT symbol, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(qty) AS volume, arg_max(px, k) * arg_max(ratio, k) AS adjusted_close FROM l GROUP BY symbol, date){more}"""


NB, RB = "WITH " + bars_sql("n_name"), "WITH " + bars_sql("r_name")
TICKS = "t AS (SELECT event_type AS symbol, ts, value AS price, 1.0::DOUBLE AS size FROM events)"
RET = ", r AS (SELECT symbol, date, close AS equity, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM b)"


def ticks(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"))

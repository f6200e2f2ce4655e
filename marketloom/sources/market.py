"""Market tables: schemas, partitioned scans and sinks."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("cik", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adjusted_close", "volume")], T.StructField("year", T.IntegerType()),
])
NEWS = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("cik", T.StringType()), T.StructField("item_index", T.LongType()),
    T.StructField("news_text", T.StringType()), T.StructField("text_len", T.LongType()), T.StructField("text_crc32", T.LongType()), T.StructField("year", T.IntegerType()),
])
FILING = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("cik", T.StringType()), T.StructField("filing_idx", T.LongType()),
    T.StructField("filing_text", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("accession", T.StringType()),
])
TRADE = T.StructType([
    T.StructField(c, k) for c, k in (
        ("date", T.DateType()), ("signal_date", T.DateType()), ("ticker", T.StringType()), ("side", T.StringType()), ("quantity", T.LongType()),
        ("reference_price", T.DoubleType()), ("fill_price", T.DoubleType()), ("commission", T.DoubleType()), ("slippage_cost", T.DoubleType()), ("participation", T.DoubleType()),
    )
])
FOLDERS = {"price": ("price_daily", PRICE), "news": ("news_items", NEWS), "filing_k": ("filingk", FILING), "filing_q": ("filingq", FILING)}


def within(start=None, end=None, symbols: Iterable[str] | None = None, *, year: bool = True) -> Column:
    """Inclusive date and symbol predicate; it also bounds ``year``, so that partitions are pruned."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col("date") >= F.lit(start).cast("date"))
        out = out & (F.col("year") >= F.year(F.lit(start).cast("date"))) if year else out
    if end is not None:
        out = out & (F.col("date") <= F.lit(end).cast("date"))
        out = out & (F.col("year") <= F.year(F.lit(end).cast("date"))) if year else out
    if symbols is not None:
        out = out & F.col("symbol").isin(list(symbols))
    return out


@dataclass
class MarketData:
    """Named long tables keyed by (date, symbol); subsets are filters, nothing is collected."""

    price: DataFrame
    news: DataFrame | None = None
    filing_k: DataFrame | None = None
    filing_q: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def subset(self, start=None, end=None, symbols=None) -> MarketData:
        """Rows of the range and symbols; other modalities only on days with a price of the symbol."""
        cut = lambda df: df.where(within(start, end, symbols, year="year" in df.columns))
        price = cut(self.price)
        keys = price.select("date", "symbol").distinct()
        other = lambda df: None if df is None else cut(df).join(keys, ["date", "symbol"], "left_semi")
        return MarketData(price, other(self.news), other(self.filing_k), other(self.filing_q), {k: other(v) for k, v in self.extra.items()})

    def tickers(self) -> DataFrame:
        return self.price.select("symbol").distinct().orderBy("symbol")

    def dates(self) -> DataFrame:
        return self.price.select("date").distinct().orderBy("date")

    def date_range(self) -> DataFrame:
        return self.price.agg(F.min("date").alias("first"), F.max("date").alias("last"))

    def day_records(self, merge: str = "concat", every_day: bool = True) -> DataFrame:
        """(date, symbol, price struct, news array, filing texts) of days that any modality has, or (not ``every_day``) that have a price."""
        out = self.price.select("date", "symbol", F.struct("open", "high", "low", "close", "adjusted_close", "volume").alias("price"))
        how = "full" if every_day else "left"
        if self.news is not None:
            out = out.join(group_news(self.news), ["date", "symbol"], how)
        for name in ("filing_k", "filing_q"):
            if (df := getattr(self, name)) is not None:
                out = out.join(merge_filings(df, merge).withColumnRenamed("filing_text", name), ["date", "symbol"], how)
        return out

    def agent_days(self, start=None, end=None, symbols=None) -> DataFrame:
        """Days with a price in the range, with all four modalities: without one, an empty array or text."""
        got = self.subset(start, end, symbols).day_records("latest", every_day=False)
        missing = {"news": F.array().cast("array<string>"), "filing_k": F.lit(""), "filing_q": F.lit("")}
        return got.select("date", "symbol", "price", *[F.coalesce(F.col(c), v).alias(c) if c in got.columns else v.alias(c) for c, v in missing.items()])


def open_market_data(
    spark: SparkSession, root: str | None = None, *, tables: dict[str, DataFrame] | None = None, loader: Callable[[SparkSession], MarketData] | None = None,
    rows: Iterable[dict] | None = None, modalities: Iterable[str] = ("price", "news", "filing_k", "filing_q"),
) -> MarketData:
    """From a loader, given DataFrames, price rows in memory, a folder, or the folder in MARKETLOOM_DATA_ROOT: one of the first four, or the last."""
    if sum(x is not None for x in (root, tables, loader, rows)) > 1:
        raise ValueError("give one of a loader, tables, rows or a root")
    if loader is not None:
        return loader(spark)
    if rows is not None:
        names = [f.name for f in PRICE]
        return MarketData(spark.createDataFrame([tuple(r.get(n, r["date"].year if n == "year" else None) for n in names) for r in rows], PRICE))
    if tables:
        return MarketData(tables["price"], *[tables.get(k) for k in ("news", "filing_k", "filing_q")], {k: v for k, v in tables.items() if k not in FOLDERS})
    root = root or os.environ.get("MARKETLOOM_DATA_ROOT")
    if not root:
        raise ValueError("no data: give tables or a root")
    got = {k: spark.read.schema(FOLDERS[k][1]).parquet(f"{root}/{FOLDERS[k][0]}") for k in modalities}
    return MarketData(**got)


#: A vendor's column names and ours.
VENDORS = {
    "fmp": {"adjClose": "adjusted_close", "timestamp": "date"},
    "yahoo": {"Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adjusted_close", "Volume": "volume"},
    "other": {},
}


def read_price_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None, *, vendor: str = "other", symbol: str | None = None, adjust: bool = False) -> DataFrame:
    """Price bars of a vendor's CSV with a header; ``columns`` maps its names to ours, ``symbol`` names a file without that column, ``adjust`` gives adjusted prices."""
    df = spark.read.csv(path, header=True).withColumnsRenamed(VENDORS[vendor] | (columns or {}))
    if symbol is not None:
        df = df.withColumn("symbol", F.lit(symbol))
    out = df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PRICE if f.name != "year"]).withColumn("year", F.year("date"))
    if not adjust:
        return out
    ratio = F.when((F.col("close") != 0) & F.col("adjusted_close").isNotNull(), F.col("adjusted_close") / F.col("close")).otherwise(0.0)
    return out.withColumns({c: F.col(c) * ratio for c in ("open", "high", "low", "close")})


def read_news_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None, *, symbol: str | None = None) -> DataFrame:
    """News of a vendor's CSV in our columns, numbered within a day by their text's hash, exact repeats of a day once."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumnsRenamed(columns or {})
    if symbol is not None:
        df = df.withColumn("symbol", F.lit(symbol))
    text = F.coalesce(F.col("news_text"), F.lit(""))
    rows = df.select(F.to_date("date").alias("date"), "symbol", text.alias("news_text")).distinct()
    number = F.row_number().over(W.partitionBy("date", "symbol").orderBy(F.xxhash64("news_text"), "news_text")).cast("long")
    return rows.select("date", "symbol", F.lit(None).cast("string").alias("cik"), number.alias("item_index"), "news_text", F.length("news_text").cast("long").alias("text_len"), F.crc32(F.col("news_text").cast("binary")).alias("text_crc32"), F.year("date").alias("year"))


def read_filings(spark: SparkSession, root: str, forms: Iterable[str] = ("filingk", "filingq"), *, years: tuple[int, int] | None = None, symbols: Iterable[str] | None = None, limit: int | None = None) -> DataFrame:
    """Filings of the named folders with their form, pruned by year and symbol before any text is read; ``limit`` is the number of rows wanted."""
    parts = [spark.read.schema(FILING).parquet(f"{root}/{f}").withColumn("form", F.lit({"filingk": "10-K", "filingq": "10-Q"}.get(f, f))) for f in forms]
    out = reduce(DataFrame.unionByName, parts)
    if years is not None:
        out = out.where(F.col("year").between(*years))
    if symbols is not None:
        out = out.where(F.col("symbol").isin(list(symbols)))
    return out if limit is None else out.limit(limit)


def read_series(spark: SparkSession, path: str, symbols: Iterable[str] | None = None) -> DataFrame:
    """Adjusted daily bars of indices or funds from a folder of Parquet: adjusted prices under the plain names."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    ratio = F.when(F.col("close") != 0, F.col("adjusted_close") / F.col("close")).otherwise(0.0)
    return df.select("date", "symbol", *[(F.col(c) * ratio).alias(c) for c in ("open", "high", "low")], F.col("adjusted_close").alias("close"), "volume")


def read_trades(spark: SparkSession, url: str, table: str, *, symbols: Iterable[str], first: str, last: str, least_size: int = 0, properties: dict | None = None, partitions: int = 16, key: str | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Trades of a database by JDBC: ``trade_filter`` is pushed to it; with a numeric ``key`` and its ``bounds`` it is read in ``partitions`` ranges."""
    spread = {"column": key, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions} if key and bounds else {}
    return trade_filter(spark.read.jdbc(url, table, properties=properties or {}, **spread), symbols, first, last, least_size)


def trade_filter(trades: DataFrame, symbols: Iterable[str], first: str, last: str, least_size: int = 0) -> DataFrame:
    """Trades of the symbols between two times of day, of more than a size, without a suffix of their symbol."""
    return trades.where(F.col("sym_root").isin(list(symbols)) & F.col("time_m").between(first, last) & (F.col("size") > least_size) & F.col("sym_suffix").isNull())


#: How a named kind of source is opened; add to it to make more kinds known.
SOURCES: dict[str, Callable[..., object]] = {
    "market": lambda spark, path, **k: open_market_data(spark, path, **k), "csv": read_price_csv, "news_csv": read_news_csv, "filings": read_filings, "series": read_series,
    "parquet": lambda spark, path, **k: spark.read.parquet(path),
}


def open_source(spark: SparkSession, kind: str, path: str, **options):
    """A source by the name of its kind."""
    if kind not in SOURCES:
        raise ValueError(f"unknown kind of source {kind!r}; known: {sorted(SOURCES)}")
    return SOURCES[kind](spark, path, **options)


def group_news(news: DataFrame) -> DataFrame:
    """(date, symbol, news array<string>) ordered by item_index."""
    items = F.array_sort(F.collect_list(F.struct("item_index", "news_text")))
    return news.groupBy("date", "symbol").agg(F.transform(items, lambda x: x["news_text"]).alias("news"))


def merge_filings(filings: DataFrame, policy: str = "concat") -> DataFrame:
    """One text a day and symbol: all joined by a blank line in filing_idx order, or the latest."""
    g = filings.groupBy("date", "symbol")
    if policy == "latest":
        return g.agg(F.max_by("filing_text", "filing_idx").alias("filing_text"))
    if policy != "concat":
        raise ValueError("policy must be concat or latest")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("filing_idx", "filing_text"))), lambda x: x["filing_text"])
    return g.agg(F.array_join(F.filter(parts, lambda x: x != ""), "\n\n").alias("filing_text"))


def _other(value):
    """What JSON has no form for: dates as ISO, numpy values as Python's, data classes as objects, sets as lists, the rest by class name."""
    forms = ((dataclasses.is_dataclass, lambda v: {f.name: getattr(v, f.name) for f in dataclasses.fields(v)}), (lambda v: isinstance(v, (set, frozenset)), sorted), (lambda v: hasattr(v, "isoformat"), lambda v: v.isoformat()), (lambda v: hasattr(v, "tolist"), lambda v: v.tolist()))
    return next((form(value) for fits, form in forms if fits(value)), type(value).__name__)


def json_text(value) -> str:
    """JSON of configs and manifests, keys as texts in order."""
    keyed = lambda v: {str(k): keyed(x) for k, x in v.items()} if isinstance(v, dict) else v
    return json.dumps(keyed(value), indent=2, sort_keys=True, default=_other)


def write_results(out: str, *, summary: DataFrame, tables: dict[str, DataFrame], config=None, by: tuple[str, ...] = ("window", "ticker")) -> None:
    """Result tables partitioned by window and ticker, the summary as a table, as CSV and as a JSON line a leaf, the configuration and a manifest."""
    spark = summary.sparkSession
    summary.write.mode("overwrite").option("header", True).csv(f"{out}/run_summary")
    here = [c for c in by if c in summary.columns]
    summary.select(*here, F.to_json(F.struct(*[c for c in summary.columns if c not in here])).alias("value")).write.mode("overwrite").partitionBy(*here).text(f"{out}/metrics")
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*[c for c in by if c in df.columns]).parquet(f"{out}/{name}")
    for name, value in (("run_config", config), ("run_manifest", {"schema_version": 1, "summary": "run_summary", "metrics": "metrics", "tables": sorted(tables)})):
        _write_text(spark, json_text(value), f"{out}/{name}")


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: The names by which a node of a result tree is a leaf.
METRICS = ("final_value", "total_return", "annual_return", "annual_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "total_commission", "total_slippage", "total_cost")


def flatten_results(tree: dict, metrics: Iterable[str] = METRICS) -> list[dict]:
    """A row of path, ticker, window and metrics for every leaf of a tree of results, in order of path. A node with any metric is a leaf."""
    names, rows, waiting = set(metrics), [], [((), tree)]
    while waiting:
        path, node = waiting.pop()
        if not isinstance(node, dict):
            continue
        own = {k: v for k, v in node.items() if k in names}
        if own:
            rows.append({"path": "/".join(path), "ticker": path[-1] if path else None, "window": path[-2] if len(path) > 1 else None} | own)
        else:
            waiting += [((*path, str(k)), v) for k, v in node.items()]
    return sorted(rows, key=lambda r: r["path"])


def summary_of(results: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """``flatten_results`` of a flat table: its path columns as one, ticker the last and window the last but one."""
    rest = [c for c in results.columns if c not in parts]
    return results.select(F.concat_ws("/", *parts).alias("path"), F.col(parts[-1]).alias("ticker"), F.col(parts[-2]).alias("window"), *rest)


def write_sections(sections: DataFrame, out: str, keys: tuple[str, ...] = ("symbol", "date")) -> None:
    """Sections as a folder an item of their lines, their records as JSON lines, and a manifest of counts by status.

    A line of a text is a JSON line (``keys``, line from 1, value), so that a folder holds a
    file a task however many filings there are; a text is its values in order of line. The
    sections are found once, for the folder ``staged-...`` that all else is read from.
    """
    spark, path = sections.sparkSession, f"{out}/staged-{uuid.uuid4().hex}"
    sections.write.parquet(path)
    staged = spark.read.schema(sections.schema).parquet(path)
    lines = staged.where("section_text IS NOT NULL").select(*keys, "item_key", F.posexplode(F.split("section_text", "\n")).alias("line", "value"))
    most = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "32")  # a task writes all items side by side and sorts no lines
    try:
        lines.withColumn("line", F.col("line") + 1).write.mode("overwrite").partitionBy("item_key").option("compression", "gzip").json(f"{out}/sections")
    finally:
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", most)
    staged.drop("section_text").write.mode("append").json(f"{out}/records")
    counts = staged.groupBy("filing_status", "filing_audit").agg(F.count_distinct(*keys).alias("filings"))  # a handful of rows
    _write_text(sections.sparkSession, json_text({"schema_version": 1, "status": [r.asDict() for r in counts.collect()]}), f"{out}/manifest")


def run_key(config: dict) -> str:
    """The key of a run: a hash of its configuration, in whatever order it was written."""
    return hashlib.sha256(json_text(config).encode()).hexdigest()[:16]


def write_trace(events: DataFrame, out: str, config: dict) -> str:
    """An agent's records (phase, ...) as JSON lines by phase under the run's key, with its configuration; the folder."""
    path = f"{out}/{run_key(config)}"
    events.write.mode("append").partitionBy("phase").json(f"{path}/events")
    _write_text(events.sparkSession, json_text({"schema_version": 1, "config": config}), f"{path}/manifest")
    return path


def write_features(features: DataFrame, out: str) -> None:
    """Feature rows as Parquet by symbol; only the symbols given are replaced."""
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(out)


def daily_bars(lines: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Bars of priced lines (symbol, date, px, qty, k, ratio): first and last by the order key ``k``."""
    return lines.groupBy(symbol, "date").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"),
        F.sum("qty").alias("volume"), (F.max_by("px", "k") * F.max_by("ratio", "k")).alias("adjusted_close"),
    )


def stand_in_bars(spark: SparkSession, sf_dir: str, level: str = "nation") -> DataFrame:
    """Daily bars of the order lines by the supplier's nation or region."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    place = read("supplier").join(F.broadcast(read("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    name = "n_name"
    if level == "region":
        place, name = place.join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey")), "r_name"
    lines = read("lineitem").join(place.select("s_suppkey", F.col(name).alias("symbol")), F.col("l_suppkey") == F.col("s_suppkey"))
    return daily_bars(lines.select(
        "symbol", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("k"), (1 - F.col("l_discount")).alias("ratio"),
    ))

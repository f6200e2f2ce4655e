"""Price, news and filing folders written so that few row groups are read for a symbol: clustered by range, with Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_clustered(df: DataFrame, path: str, *, by: tuple[str, ...] = ("symbol", "date"), partition: str = "year", bloom: dict[str, int] | None = None, files: int | None = None, group_bytes: int = 8 << 20) -> None:
    """``df`` in folders by ``partition``, rows in ranges of ``by`` and sorted within, with Bloom filters.

    ``files`` is the number of ranges over all folders (the session's shuffle partitions unless
    given); a symbol with very many rows spreads over several, as the range goes on with the
    next key. ``bloom`` maps columns to the number of values expected in a row group; row
    groups have about ``group_bytes``.
    """
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(files, partition, *by).sortWithinPartitions(partition, *by).write.option("parquet.block.size", group_bytes)
    # the size of a group is looked at often enough to keep it
    out = out.option("parquet.page.size.row.check.min", 100).option("parquet.page.size.row.check.max", 1000).option("parquet.page.row.count.limit", 1000)
    for column, values in (bloom or {by[0]: 1000}).items():
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", values)
    out.partitionBy(partition).parquet(path)


def rows_scanned(df: DataFrame) -> int:
    """Rows that the scans of a query take from storage after row groups and pages are left out; runs the query."""
    df.collect()
    total, waiting = 0, [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
        elif "QueryStage" in name:
            waiting.append(node.plan())
        else:
            if name.startswith("Scan"):
                total += node.metrics().apply("numOutputRows").value()
            waiting += [node.children().apply(i) for i in range(node.children().size())]
    return total

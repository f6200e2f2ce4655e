"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in an order shuffled by a hash of its id, finishes at virtual
time (words of its source up to and with it) / (the source's target); a second pass over the
source follows the first. Documents of all sources are sorted by finish time, range by range,
and taken while the words taken fit the total budget. Running sums within a source and over
the finish times go by ranges of the full order, whose sums are summed first, so that neither
a source nor a repeated key is ever one task; only the range in which the budget ends is
looked at row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, small

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """(source, source_size, srank, target, rows) of a table (source, size, rows) of source sizes.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all sizes;
    what exceeds ``repeats`` times a source's size is shared by weight among the others. A
    source is full if its cap per weight is at most the level that fills the sources not yet
    full; in order of cap per weight the full ones come first, so one pass finds the level.
    """
    everything = W.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("srank") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("srank", F.row_number().over(W.orderBy(F.asc_nulls_last("source")))).withColumn("w", weight.cast("double"))
    ranked = ranked.withColumn("cap", F.col("size") * float(repeats))
    upto = W.orderBy(F.col("cap") / F.col("w"), "srank").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("srank"), F.col("level")))).over(everything)["level"]
    return leveled.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * final)).select("source", F.col("size").alias("source_size"), "srank", "target", "rows")


def mix_sources(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
    buckets: int = 4096,
    range_rows: int = 500_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(key, size, source_size, target, taken) of every row; taken is 0 to ``repeats`` times size.

    size counts words (null: 0). Rows of size 0 take nothing and cost nothing. Null sources
    are one source; null keys are ordered first within equal hashes; equal rows are queued one
    after the other. An empty table gives an empty result, other columns are ignored. Each
    source's taken words differ from its target by less than its largest documents; equal
    input gives equal results. Rows of equal key and size are queued by their ``keep`` columns,
    which are carried, and then as they were read. A range holds about ``range_rows`` rows. Only
    tables of one row a source, a range, or both are windowed in one task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f"/{seed}")))
    sized = scratch.save(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"), *[F.col(c).alias(f"keep_{c}") for c in keep],
            F.monotonically_increasing_id().alias("u"),
        ).withColumn("bucket", F.expr(f"cast(pmod(cast(conv(substr(h, 1, 6), 16, 10) as long), {buckets}) as int)")),
        "sized",
    )
    kept = [f"keep_{c}" for c in keep]
    per = scratch.save(targets(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), weights, share, repeats), "targets")
    found = per.agg(F.sum("target").alias("t"), F.sum("rows").alias("n")).first()
    total, ranges = found["t"] or 0.0, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (found["n"] or 0) // range_rows + 1)
    queue = ("srank", "bucket", "h", "key", "size", *kept, "u")
    dealt = sized.withColumnRenamed("source", "s").join(small(per.drop("rows")), F.col("s").eqNullSafe(F.col("source")))
    queued = _running(scratch, dealt.select("source_size", "target", *queue), queue, ["srank"], ranges, "queued")

    def finish(p: int):
        return F.when((F.col("target") > 0) & (F.col("size") > 0), (F.col("upto") + F.col("source_size") * p).cast("double") / F.col("target"))

    order = ("f", "srank", "h", "key", "size", "u")
    passes = queued.select(*order[1:], F.explode(F.array(*[finish(p) for p in range(repeats)])).alias("f")).where("f IS NOT NULL")
    passes = scratch.save(_ranged(passes, order, ranges * repeats), "passes")
    running = passes.groupBy("at").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("at")))  # one row a range
    cut = running.where(F.col("upto") > total).orderBy("at").limit(1).collect()
    fits = lambda f: F.lit(True)
    if cut:
        # the range in which the budget ends: up to its last document that still fits
        room = total - (cut[0]["upto"] - cut[0]["n"])
        inside = passes.where(F.col("at") == cut[0]["at"])
        upto = F.sum("size").over(W.partitionBy("at").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        inside = inside.withColumn("sum", upto).select((F.col("sum") <= room).alias("fits"), F.struct(*order).alias("o"))
        first = inside.where("NOT fits").agg(F.min("o").alias("o")).first()["o"]
        at = F.struct(F.lit(first["f"]).alias("f"), *[F.lit(first[c]).cast(queued.schema[c].dataType).alias(c) for c in order[1:]])
        fits = lambda f: F.struct(f.alias("f"), *order[1:]) < at
    times = sum((F.when(finish(p).isNotNull() & fits(finish(p)), 1).otherwise(0) for p in range(repeats)), F.lit(0))
    return queued.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * times).alias("taken"), *[F.col(c).alias(c[5:]) for c in kept])


def _ranged(rows: DataFrame, order: tuple[str, ...], ranges: int) -> DataFrame:
    """``rows`` dealt in ranges of ``order``, with the number of the range; to be written, as ranges are sampled."""
    return rows.repartitionByRange(ranges, *order).withColumn("at", F.spark_partition_id())


def _running(scratch: Scratch, rows: DataFrame, order: tuple[str, ...], by: list[str], ranges: int, name: str) -> DataFrame:
    """``rows`` with ``upto``, the sum of size within ``by`` up to and with the row in ``order``; ``by`` leads the order."""
    rows = scratch.save(_ranged(rows, order, ranges), f"{name}-ranges")
    sums = rows.groupBy("at", *by).agg(F.sum("size").alias("n"))
    before = sums.select("at", *by, (F.sum("n").over(W.partitionBy(*by).orderBy("at")) - F.col("n")).alias("before"))
    # a number of ranges a source; the key of the window holds the range, so a source is dealt over all tasks
    own = W.partitionBy("at", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(small(scratch.save(before, f"{name}-before")), ["at", *by]).withColumn("upto", F.col("before") + F.sum("size").over(own))
    return scratch.save(out.drop("at", "before"), name)


def oracle(documents: str = "documents") -> str:
    """The same rows in DuckDB SQL, with the defaults."""
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || '/mix') AS h FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS srank FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((srank - 1) % 3 + 1)] AS w, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER u, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER u, 0.0::DOUBLE)) AS lv
      FROM w WINDOW u AS (ORDER BY cap / w, srank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN cap / w <= lv THEN cap ELSE w * (SELECT lv FROM l WHERE NOT cap / w <= lv ORDER BY cap / w, srank LIMIT 1) END AS target FROM l),
q AS (SELECT d.*, t.source_size, t.srank, t.target, sum(d.size) OVER (PARTITION BY t.srank
        ORDER BY ('0x' || substr(h, 1, 6))::BIGINT % 4096, h, doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS upto,
        row_number() OVER () AS rid
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT rid, size, srank, h, doc_id, (upto + source_size * p)::DOUBLE / target AS f FROM q, (VALUES (0), (1)) v(p) WHERE target > 0 AND size > 0),
c AS (SELECT rid, size, sum(size) OVER (ORDER BY f, srank, h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS n FROM e),
k AS (SELECT rid, count(*) AS times FROM c WHERE n <= (SELECT sum(target) FROM t) GROUP BY rid)
SELECT doc_id, size, source_size, target, (size * coalesce(times, 0))::BIGINT AS taken FROM q LEFT JOIN k USING (rid)"""

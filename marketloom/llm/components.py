"""Connected components by repeated contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (a long, b long).

    Every vertex joins the neighbour (or itself) that comes first in a random order of the
    round; the edges between what has been joined are the next round's graph, which shrinks
    by a constant factor, so the rounds grow with the logarithm of the longest path. Nothing
    but the emptiness test of a round comes to the driver. Self-loops, repeated edges and
    nulls are allowed: a null end is dropped, an empty table gives an empty result.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    graph = scratch.save(edges.where("a <> b").distinct(), "graph")
    start = graph
    steps: list[DataFrame] = []
    while graph.limit(1).count():
        seed = F.lit(len(steps) + 1)
        both = graph.union(graph.select("b", "a"))
        prefer = lambda c: F.struct(F.xxhash64(c, seed).alias("p"), F.col(c).alias("to"))
        step = scratch.save(
            both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("p"), F.col("b").alias("to"))).alias("m"))
            .select(F.col("a").alias("id"), F.least(F.col("m"), prefer("a"))["to"].alias("to")),
            "step",
        )
        after = (
            graph.join(step.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a")
            .join(step.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        steps.append(step)
        last = graph
        graph = scratch.save(after, "graph")
        if last is not start:
            scratch.drop(last)
    spark = scratch.spark
    if not steps:
        return spark.createDataFrame([], "id long, component long")
    # an id that no later step moves is a root: resolve from the last step back to the first; a
    # root may have any number of ids, so what it is looked up in is broadcast while it is small
    final = steps[-1]
    for step in reversed(steps[:-1]):
        up = small(final.select(F.col("id").alias("to"), F.col("to").alias("root")))
        before, final = final, scratch.save(step.join(up, "to", "left").select("id", F.coalesce("root", "to").alias("to")), "roots")
        if before is not steps[-1]:
            scratch.drop(before)
    least = scratch.save(final.groupBy("to").agg(F.min("id").alias("component")), "least")
    out = scratch.save(final.join(small(least), "to").select("id", "component"), "components")
    scratch.drop(*steps, graph, least, *([] if final is steps[-1] else [final]))
    return out

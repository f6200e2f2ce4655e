"""What each filter of a chain removes in every order, from one CUBE over their failure flags.

Whether a document survives a set of filters depends on its flags alone, not on the order they
are applied in. Documents are counted by part and flags; CUBE over these few rows sums them
over every choice of flags, and of its rows those whose chosen flags are all false count the
documents that pass just the chosen filters. A step of an order is then a pair of subsets: the
filters before it, and those with its own. All orders of all parts are joins of subset counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, small

BLANK = r"[\x20\x09-\x0D]+"
#: The failure conditions of the five filters that need one text only, over ``t``, its words ``w`` and its distinct words ``d``; E compares texts.
FAILS = {
    "A": "size(w) < 100",
    "B": "100L * size(array_distinct(w)) < 80L * size(w)",
    "C": "100L * regexp_count(t, '[A-Z]') > 10L * length(t)",
    "D": "t rlike '[#$%&*|]'",
}


def failures(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every row: its flags, true where a filter fails, and its labels as 0 or 1.

    Null texts are empty; the part of a null language is the empty string. E compares a row
    with all texts of smaller keys; a null key is neither smaller nor larger than any, so its
    row doesn't fail E. Texts are compared by SHA-256. A row without label is neither good nor
    toxic; of repeated labels one that says so is enough. Equal rows have equal flags.
    """
    scratch = Scratch(docs.sparkSession, "flags")
    words = f"array_remove(split(t, '{BLANK}'), '')".replace("\\", "\\\\")
    flags = f"transform(array({words}), w -> struct({', '.join(f'{sql} AS {name}' for name, sql in FAILS.items())}))[0]"
    one = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = scratch.save(one.select("key", "part", F.expr(flags).alias("f"), F.unhex(F.sha2("t", 256)).alias("digest")).select("key", "part", "f.*", "digest"), "rows")
    # the first of each text, found among the rows by text and key together: no text is a task of its own
    first = rows.where("key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("first")).withColumnRenamed("digest", "of")
    rows = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("key") == F.col("first")), "left")
    rows = rows.withColumn("E", F.col("key").isNotNull() & F.col("first").isNull())
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("lk")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in ((quality, "good"), (toxic, "toxic"))])
    marks = small(scratch.save(marks, "labels").withColumn("ls", F.lit(0)))
    # rows without a key match nothing, and are spread
    spread = rows.withColumn("s", F.when(F.col("key").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096)) + 1).otherwise(0).cast("int"))
    joined = spread.join(marks, (F.col("key") == F.col("lk")) & (F.col("s") == F.col("ls")), "left")
    return joined.select("part", *FAILS, "E", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def interaction_audit(flags: DataFrame, filters: tuple[str, ...], *, part: str = "part", losses: dict[str, str] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, losses..., shapley) of every part, order of ``filters`` and step.

    ``filters`` names boolean columns, true (null: false) where a row fails, at most seven of
    them; an order is the row of their names. ``losses`` maps output columns to numeric ones
    of ``flags`` that are summed over the rows a step removes. Every part has a row for every
    order and step, with zeros; an empty table gives an empty result. Rows are counted by part
    and flags before anything else, so beyond that the work depends on the parts alone.
    """
    if not 1 <= len(filters) <= 7:
        raise ValueError("one to seven filters: every order of them gives rows")
    losses = losses or {}
    spark = flags.sparkSession
    scratch = Scratch(spark, "audit")
    sums = {"n": F.count("*")} | {f"loss{i}": F.sum(F.coalesce(F.col(c), F.lit(0))) for i, c in enumerate(losses.values())}
    counted = flags.groupBy(F.col(part).alias("part"), *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in filters]).agg(*[v.cast("long").alias(c) for c, v in sums.items()])
    cube = counted.cube("part", *filters).agg(F.grouping_id().alias("rolled"), *[F.sum(c).alias(c) for c in sums])
    every = (1 << len(filters)) - 1
    # grouping bits: the part's is the highest, then the filters in order; a bit is set where its column is not chosen
    chosen = cube.where(F.col("rolled") <= every).where(~F.coalesce(*[F.when(F.col(c), True) for c in filters], F.lit(False)))
    found = scratch.save(chosen.select("part", F.lit(every).bitwiseXOR(F.col("rolled")).cast("int").alias("subset"), *sums), "subsets")
    # subsets that nobody survives have no row of their own
    grid = found.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("subset"))
    survivors = scratch.save(grid.join(found, ["part", "subset"], "left").fillna(0, list(sums)), "survivors")

    bit = {c: 1 << (len(filters) - 1 - i) for i, c in enumerate(filters)}
    orders = [(order, k) for order in permutations(filters) for k in range(len(order))]
    steps = spark.createDataFrame(
        [("".join(o), k + 1, o[k], sum(bit[c] for c in o[:k]), sum(bit[c] for c in o[: k + 1])) for o, k in orders],
        "filter_order string, step int, filter string, before int, after int",
    )
    now = survivors.select("part", F.col("subset").alias("after"), *[F.col(c).alias(f"{c}_after") for c in sums])
    pairs = survivors.withColumnRenamed("subset", "before").join(F.broadcast(steps), "before").join(now, ["part", "after"])
    # rows that fail a filter: all less those that pass it alone; rows that fail it only: those that pass the others less those that pass all
    apart = spark.createDataFrame(
        [(c, s, f, u) for c in filters for s, f, u in ((0, 1, 0), (bit[c], -1, 0), (every ^ bit[c], 0, 1), (every, 0, -1))], "filter string, subset int, fails long, only long"
    )
    alone = survivors.join(F.broadcast(apart), "subset").groupBy("part", "filter").agg(F.sum(F.col("n") * F.col("fails")).alias("fails"), F.sum(F.col("n") * F.col("only")).alias("unique_fails"))
    removed = F.col("n") - F.col("n_after")
    lost = [(F.col(f"loss{i}") - F.col(f"loss{i}_after")).alias(c) for i, c in enumerate(losses)]
    return pairs.join(alone, ["part", "filter"]).select(
        F.col("part").alias(part), "filter_order", "step", F.col("n_after").alias("kept"), removed.alias("removed"), (F.col("fails") - removed).alias("redundant"), "unique_fails", *lost,
        F.sum(removed).over(W.partitionBy("part", "filter")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """``interaction_audit`` of the five filters of ``failures`` over ``docs``; ``columns`` name those of the tables."""
    return interaction_audit(failures(docs, labels, **columns), (*FAILS, "E"), losses={"good_lost": "good", "toxic_lost": "toxic"})


def oracle(documents: str = "documents", labels: str = "labels") -> str:
    """The same rows in DuckDB SQL, document by document, without subsets."""
    names = "ABCDE"
    fails = " ".join(f"WHEN '{c}' THEN {c}" for c in names)
    passed = " AND ".join(f"NOT (instr(substr(filter_order, 1, k), '{c}') > 0 AND {c})" for c in names)
    only = " AND ".join(f"(own = '{c}' OR NOT {c})" for c in names)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM {documents}),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM {labels} GROUP BY doc_id),
f AS (SELECT part, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B, 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS C,
  regexp_matches(t, '[#$%&*|]') AS D, coalesce(doc_id > least, false) AS E, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN g USING (doc_id)),
c AS (SELECT part, A, B, C, D, E, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(string_split('A B C D E', ' ')) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k, substr(filter_order, k, 1) AS own FROM o, (SELECT unnest(range(1, 6)) AS k)),
q AS (SELECT *, {passed} AS stays, {passed.replace("1, k)", "1, k - 1)")} AS came, CASE own {fails} END AS failing, {only} AS others FROM c, s),
r AS (SELECT part, filter_order, own, k::INTEGER AS step, sum(CASE WHEN stays THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN came AND failing THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN failing AND NOT came THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failing AND others THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN came AND failing THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN came AND failing THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM q GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""

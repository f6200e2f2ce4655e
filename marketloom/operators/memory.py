"""Vector memory: exact inner-product and L2 search, compound scores, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import scan

def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a, b) -> Column:
    d = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(F.col(a), F.col(b), d), F.lit(0.0), lambda s, v: s + v)


def nearest(store: DataFrame, queries: DataFrame, k: int = 5, metric: str = "dot") -> DataFrame:
    """The k nearest of the store (id, v) for each query (qid, q); a stated set of queries against all rows.

    Queries go in blocks of known size to every row of the store; each task's best k of a query meet.
    """
    return _ranked(scan(store, queries, k, metric, blanks=True).drop("extra"), k, ["qid"], metric)


def _ranked(scored: DataFrame, k: int, by: list[str], metric: str = "dot") -> DataFrame:
    order = F.desc("score") if metric == "dot" else F.asc_nulls_last("score")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(order, "id")).cast("long")).where(F.col("rank") <= k)


def compound(recency, importance) -> Column:
    return F.col(recency) + F.least(F.col(importance), F.lit(100.0)) / 100


def decay(age, importance, recency_factor: float = 10.0, importance_factor: float = 0.988) -> tuple[Column, Column]:
    """(recency, importance) after ``age`` steps, in closed form."""
    return F.exp(-F.col(age) / recency_factor), F.col(importance) * F.pow(F.lit(importance_factor), F.col(age))


def cosine(a, b) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def normalised(v) -> Column:
    """A vector over its length, which is taken once a vector; one without length stays."""
    over = lambda size: F.transform(F.col(v), lambda x: x.cast("double") / F.when(size > 0, size).otherwise(F.lit(1.0)))
    return F.transform(F.array(F.sqrt(dot(v, v))), over)[0]


def nearest_in_group(store: DataFrame, queries: DataFrame, k: int = 5, group: str = "symbol") -> DataFrame:
    """(group, qid, id, score, rank): the k largest products of a query with the normalised vectors (group, id, v) of its own group; the query (group, qid, q) isn't normalised."""
    return _ranked(_in_group(store, queries, k, group).select(group, "qid", "id", "score"), k, [group, "qid"])


def _in_group(store: DataFrame, queries: DataFrame, k: int, group: str, extra: str | None = None) -> DataFrame:
    """(group, qid, id, score, extra) of each task's best; a query is known by group and qid together."""
    keyed = queries.select(F.struct(F.col(group).alias("group"), "qid").alias("qid"), "q", group)
    found = scan(store.withColumn("v", normalised("v")), keyed, k, "dot", group=group, extra=extra, blanks=True)
    return found.select(F.col("qid.group").alias(group), F.col("qid.qid").alias("qid"), "id", "score", "extra")


def hybrid(store: DataFrame, queries: DataFrame, k: int = 5, group: str = "symbol", compat: bool = False) -> DataFrame:
    """(group, qid, id, score): of the k nearest and the k with the highest compound score, the k best by both together, in order of id.

    The store has (group, id, v, compound). ``compat`` takes the k with the lowest compound
    score, and counts a row that is among both sets twice before it cuts to k. The k with the
    highest compound score are the same for all queries of a group.
    """
    by = [group, "qid"]
    near = _ranked(_in_group(store, queries, k, group, "compound"), k, by).select(*by, "id", (F.col("score") + F.col("extra")).alias("score"))
    place = F.row_number().over(W.partitionBy(group).orderBy(F.asc("compound") if compat else F.desc("compound"), "id"))
    strong = store.withColumn("_r", place).where(F.col("_r") <= k).withColumn("v", normalised("v")).join(queries.select(group, "qid", "q"), group)
    both = near.unionByName(strong.select(*by, "id", (dot("v", "q") + F.col("compound").cast("double")).alias("score")))
    if not compat:
        both = both.dropDuplicates([*by, "id"])
    return _ranked(both, k, by).groupBy(*by, "id").agg(F.max("score").alias("score")).orderBy(*by, "id")


def recall(events: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.1, decay_rate: float = 0.95) -> DataFrame:
    """(qid, id, score, rank): events (id, v, importance, days) of cosine at least ``least``, by cosine + importance x rate ** days."""
    worth = F.col("importance") * F.pow(F.lit(decay_rate), F.col("days"))
    found = scan(events.withColumn("_worth", worth), queries, k, "cosine", least=least, bonus="_worth")
    return _ranked(found.drop("extra"), k, ["qid"])


def prune(events: DataFrame, most: int, decay_rate: float = 0.95) -> DataFrame:
    """The ``most`` events of the largest importance x rate ** days x (1 + 0.1 x accesses); every task keeps that many."""
    worth = F.col("importance") * F.pow(F.lit(decay_rate), F.col("days")) * (1 + 0.1 * F.col("access_count"))
    return events.withColumn("worth", worth).orderBy(F.desc("worth"), "id").limit(most)


def many_queries(queries: DataFrame, types: dict[str, str], text: str = "text") -> DataFrame:
    """Each query once for every type, with the type's words after it."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("words")) for k, v in types.items()])
    return queries.withColumn("_k", F.explode(kinds)).withColumns({"kind": F.col("_k.kind"), text: F.concat_ws(" ", text, F.when(F.col("_k.words") != "", F.col("_k.words")))}).drop("_k")


# The layers' starting importances with their shares, decay, clean-up and jumps.
LAYERS = {
    "short": {"start": ((50.0, 0.5), (70.0, 0.45), (90.0, 0.05)), "recency": 3.0, "importance": 0.92, "least": (0.05, 5.0), "down": None, "up": 60.0},
    "mid": {"start": ((40.0, 0.05), (60.0, 0.8), (80.0, 0.15)), "recency": 90.0, "importance": 0.967, "least": (0.05, 5.0), "down": 60.0, "up": 80.0},
    "long": {"start": ((40.0, 0.05), (60.0, 0.15), (80.0, 0.8)), "recency": 365.0, "importance": 0.988, "least": (0.05, 5.0), "down": 80.0, "up": None},
    "reflection": {"start": ((40.0, 0.05), (60.0, 0.15), (80.0, 0.8)), "recency": 365.0, "importance": 0.988, "least": (0.05, 5.0), "down": None, "up": None},
}


def first_importance(layer="layer", key="id", seed: int = 0) -> Column:
    """A starting importance drawn by the layer's shares; the draw is a hash of key and seed, so reruns agree."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), 1, 6), 16, 10).cast("double") / float(1 << 24)
    out = F.lit(None).cast("double")
    for name, p in LAYERS.items():
        draw, upto = F.lit(p["start"][-1][0]), 1.0
        for value, share in reversed(p["start"][:-1]):
            upto = sum(s for v, s in p["start"] if v <= value)
            draw = F.when(u < upto, F.lit(value)).otherwise(draw)
        out = F.when(F.col(layer) == name, draw).otherwise(out)
    return out


def survivors(items: DataFrame, layer: str = "short") -> DataFrame:
    """Items (id, age, importance) of one layer after ``age`` steps that clean-up has left: both scores only fall, so the last step decides."""
    p = LAYERS[layer]
    recency, importance = decay("age", "importance", p["recency"], p["importance"])
    rows = items.select("id", "age", recency.alias("recency"), importance.alias("importance"))
    return rows.where((F.col("recency") >= p["least"][0]) & (F.col("importance") >= p["least"][1])).withColumn("compound", compound("recency", "importance"))


LIFE = "symbol string, id long, layer string, importance double, recency double, age int, accesses int, jumps int, removed int"


class Layers:
    """One symbol's memories: a step decays them, cleans up, and moves them between layers twice over."""

    ORDER = ("short", "mid", "long")

    def __init__(self):
        self.items: dict[int, dict] = {}

    def add(self, key: int, layer: str, importance: float) -> None:
        self.items[key] = {"layer": layer, "importance": float(importance), "recency": 1.0, "age": 0, "accesses": 0, "jumps": 0, "removed": None}

    def feed(self, key: int, value: int) -> None:
        """Feedback on a memory: its counter moves, and its importance by five times the counter."""
        x = self.items.get(key)
        if x and x["removed"] is None:
            x["accesses"] += value
            x["importance"] += 5.0 * x["accesses"]

    def step(self, day: int) -> None:
        import math

        alive = [x for x in self.items.values() if x["removed"] is None]
        for x in alive:
            p = LAYERS[x["layer"]]
            x["age"] += 1
            x["recency"] = math.exp(-x["age"] / p["recency"])
            x["importance"] *= p["importance"]
            if x["recency"] < p["least"][0] or x["importance"] < p["least"][1]:
                x["removed"] = day
        alive = [x for x in alive if x["removed"] is None and x["layer"] in self.ORDER]
        for _ in range(2):
            for place, name in enumerate(self.ORDER):
                p = LAYERS[name]
                for x in [x for x in alive if x["layer"] == name]:
                    if p["up"] is not None and x["importance"] >= p["up"]:
                        x.update(layer=self.ORDER[place + 1], recency=1.0, age=0, jumps=x["jumps"] + 1)
                    elif p["down"] is not None and x["importance"] < p["down"]:
                        x.update(layer=self.ORDER[place - 1], jumps=x["jumps"] + 1)


#: Rows of a group of ``lifecycle``, items and feedback.
GROUP = 20_000


def lifecycle(items: DataFrame, days: int, feedback: DataFrame | None = None) -> DataFrame:
    """``LIFE`` rows of items (symbol, id, layer, importance, day) after days 1 to ``days``; ``removed`` is the day of clean-up, or null.

    An item joins on its day before the step, feedback (symbol, id, day, value) comes after
    the step. Items are independent: an Arrow group holds those of one symbol and hash, about
    ``GROUP`` rows however many a symbol has.
    """
    import pandas as pd

    rows = items.select("symbol", "id", "layer", F.col("importance").cast("double"), F.col("day").cast("int"), F.lit(None).cast("int").alias("value"))
    if feedback is not None:
        rows = rows.unionByName(feedback.select("symbol", "id", F.lit(None).cast("string").alias("layer"), F.lit(None).cast("double").alias("importance"), F.col("day").cast("int"), F.col("value").cast("int")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        symbol, layers = pdf["symbol"].iloc[0], Layers()
        by_day = {d: g for d, g in pdf.sort_values("id").groupby("day")}
        for day in range(1, days + 1):
            today = by_day.get(day)
            if today is not None:
                for r in today[today["value"].isna()].itertuples():
                    layers.add(int(r.id), r.layer, r.importance)
            layers.step(day)
            if today is not None:
                for r in today[today["value"].notna()].itertuples():
                    layers.feed(int(r.id), int(r.value))
        out = [(symbol, k, x["layer"], x["importance"], x["recency"], x["age"], x["accesses"], x["jumps"], x["removed"]) for k, x in layers.items.items()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in LIFE.split(", ")]).astype({"removed": "Int32"})

    parts = max(1, -(-rows.count() // GROUP))
    return rows.groupBy("symbol", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_part")).applyInPandas(run, LIFE)


def upserted(store: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The store after changes (key, ..., gone): rows of a changed key are replaced or, where ``gone``, deleted; the others stay."""
    kept = store.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where(~F.coalesce("gone", F.lit(False))).select(*store.columns))

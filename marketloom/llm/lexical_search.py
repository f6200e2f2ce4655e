"""Ranked lexical search by the threshold algorithm over impact-sorted lists.

A pass over the texts makes the forward index: each document's terms that some item asks for,
with their counts, and the length of all its terms. Statistics are sums over it. Then every
task takes its documents in blocks, and for each block sorts the terms' lists by impact and
lays out a forward index for lookups at random. For each item the lists are read in turns, so
many entries of each at a time; a document met for the first time is scored by lookups of all
the item's terms. The threshold is the score of a document that has the last impacts read:
once it is strictly below the k-th score found, by this task so far, no unread document can
enter, not even by a tie. The best of all tasks meet by item.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import chunks, words

#: Bytes that are in no term: ASCII without letters and digits.
GAPS = np.ones(256, bool)
GAPS[128:] = False
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    GAPS[_lo : _hi + 1] = False


def _terms(column: pa.Array):
    """(first row, rows, hash of each term, its row within these) of runs of rows."""
    for lo, hi, data, bounds in chunks(column):
        h, row, _, _ = words(data, bounds, gaps=GAPS)
        yield lo, hi - lo, h.view(np.int64), row


def item_terms(items: DataFrame, *, key: str, text: str) -> DataFrame:
    """(item, term) once for each distinct term of each row; terms are 64-bit hashes, ``item`` numbers the rows."""

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            for lo, _, h, row in _terms(batch.column(1)):
                pairs = np.unique(np.stack([row, h], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(at[lo + pairs[:, 0]]), pa.array(pairs[:, 1])], ["item", "term"])

    return items.select("item", F.col(text).cast("string")).mapInArrow(run, "item long, term long")


def forward_index(docs: DataFrame, terms: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, codes, times) of every row: its number of terms, and those of ``terms`` (ascending hashes) that it holds, by their place, with their counts."""
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = held.value
        for batch in batches:
            for lo, rows, h, row in _terms(batch.column(1)):
                n = np.bincount(row, minlength=rows)
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                both, times = np.unique(row[hit] * max(len(known), 1) + at[hit], return_counts=True)
                ends = np.searchsorted(both // max(len(known), 1), np.arange(rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (both % max(len(known), 1), times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(n, pa.int64()), *lists], ["key", "n", "codes", "times"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, n long, codes array<int>, times array<int>")


class Block:
    """The lists and the forward index of some documents, numbered in the order of their keys."""

    def __init__(self, rows: pa.Table, terms: int, documents: int, length: int):
        rows = rows.take(pc.sort_indices(rows, [("key", "ascending")], null_placement="at_end")).combine_chunks()
        self.keys = rows["key"]
        codes, times = rows["codes"].combine_chunks(), rows["times"].combine_chunks()
        counts = np.diff(codes.offsets.to_numpy())
        row = np.repeat(np.arange(len(rows)), counts)
        code, tf = codes.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        m = 100 - 90 + (90 * rows["n"].to_numpy() * documents) // length
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        order = np.lexsort((row, -impact, code))
        self.row, self.impact = row[order], impact[order]
        self.start = np.searchsorted(code[order], np.arange(terms + 1))
        self.table = np.zeros((len(rows), terms), np.int32)  # an impact is a million at most
        self.table[row, code] = impact
        heads = np.minimum(self.start[:-1], max(len(order) - 1, 0))
        self.best = np.where(np.diff(self.start) > 0, self.impact[heads] if len(order) else 0, 0)

    def search(self, codes: np.ndarray, weights: np.ndarray, found: list, k: int, turn: int = 32) -> tuple[list, int]:
        """The k best of ``found`` and this block, as (-score, key is null, key), and how many entries were read."""
        starts, ends = self.start[codes], self.start[codes + 1]
        seen = np.zeros(len(self.table), bool)
        depth = 0
        while True:
            lasts = np.minimum(starts + depth - 1, ends - 1)
            ahead = starts + depth < ends  # a list that is read to its end adds nothing to a document not met
            bound = int((np.where(ahead, self.impact[lasts] if depth else self.best[codes], 0) * weights).sum()) if len(self.impact) else 0
            if bound <= 0 or (len(found) == k and bound < -found[-1][0]):
                return found, int(np.minimum(depth, ends - starts).sum())
            new = np.unique(np.concatenate([self.row[s + depth : min(s + depth + turn, e)] for s, e in zip(starts, ends)]))
            new = new[~seen[new]]
            seen[new] = True
            scores = self.table[np.ix_(new, codes)].astype(np.int64) @ weights
            worth = scores > 0 if len(found) < k else scores >= -found[-1][0]
            new, scores = new[worth], scores[worth]
            if len(new):
                first = np.lexsort((new, -scores))[:k]
                keys = self.keys.take(pa.array(new[first])).to_pylist()
                found = sorted(found + [(-int(s), x is None, x) for s, x in zip(scores[first], keys)], key=_order)[:k]
            depth += turn
            turn *= 2


def _order(x: tuple) -> tuple:
    return (x[0], x[1]) if x[1] else x


def _search(codes: list[np.ndarray], weights: list[np.ndarray], items: list[int], terms: int, documents: int, length: int, k: int, cells: int, kind: pa.DataType):
    """Arrow batches of the forward index to (item, key, score): the k best of the task for each item."""

    def run(batches):
        best: list[list] = [[] for _ in items]
        flat, heavy = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, weights))
        cuts = np.cumsum([0, *map(len, codes)])

        def block(waiting: list) -> None:
            own = Block(pa.Table.from_batches(waiting), terms, documents, length)
            sums = np.concatenate([[0], np.cumsum(own.best[flat] * heavy)])
            bounds = sums[cuts[1:]] - sums[cuts[:-1]]
            for i in np.flatnonzero(bounds):
                if len(best[i]) < k or bounds[i] >= -best[i][-1][0]:
                    best[i], _ = own.search(codes[i], weights[i], best[i], k)

        waiting, rows, most = [], 0, max(256, cells // max(terms, 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                waiting.append(part)
                rows += part.num_rows
                if rows >= most:
                    block(waiting)
                    waiting, rows = [], 0
        if waiting:
            block(waiting)
        out = [(items[i], x[2], -x[0]) for i, found in enumerate(best) for x in found]
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], kind), pa.array(cols[2], pa.int64())], ["item", "key", "score"])

    return run


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = 10,
    pairs: int = 500_000,
    cells: int = 16_000_000,
    salts: int = 64,
) -> DataFrame:
    """(item, rank, key, score) of the k best rows of ``docs`` for every row of ``items``; fewer where fewer score above 0.

    Terms, weights and scores are those of the task's contract: integers but for the weight's
    logarithm. Null texts have no terms; equal scores go by key, null last, and rows that
    repeat a key take ranks of their own. Items without terms, or whose terms no document
    holds, have no rows; rows that repeat an item are ranked each for itself. No documents, no
    terms or no items give an empty result; other columns are ignored. Terms are 64-bit
    hashes; equality of hashes is taken as equality.

    Items are a stated set of queries: they go in blocks of some ``pairs`` pairs of item and
    term, which bounds what reaches the driver and each task, and every block meets all rows.
    A task lays out ``cells`` impacts at a time.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    kind = docs.schema[key].dataType
    items = scratch.save(items.select(F.monotonically_increasing_id().alias("item"), F.col(item).alias("id"), F.col(item_text).cast("string").alias("text")), "items")
    wanted = scratch.save(item_terms(items, key="id", text="text"), "terms")
    blocks = -(-wanted.count() // pairs)
    arrow = spark.createDataFrame([], docs.select(key).schema).toArrow().schema.field(0).type
    out = spark.createDataFrame([], f"item long, key {kind.simpleString()}, score long")
    for block in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        known, places = np.unique(mine["term"].to_numpy(), return_inverse=True)
        forward = scratch.save(forward_index(docs, known, key=key, text=text), "forward")
        whole = forward.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not whole["documents"]:
            break
        df = np.zeros(len(known), np.int64)
        for x in forward.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).collect():
            df[x["code"]] = x["df"]
        weight = np.array([math.floor(1000 * math.log((2 * whole["documents"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        order = np.argsort(mine["item"].to_numpy(), kind="stable")
        numbers, first = np.unique(mine["item"].to_numpy()[order], return_index=True)
        own = np.split(places[order], first[1:]) if len(numbers) else []
        own = [c[(weight[c] > 0) & (df[c] > 0)] for c in own]
        run = _search(own, [weight[c] for c in own], numbers.tolist(), len(known), whole["documents"], whole["length"], k, cells, arrow)
        found = forward.where("size(codes) > 0").select("key", "n", "codes", "times").mapInArrow(run, f"item long, key {kind.simpleString()}, score long")
        out = out.union(scratch.save(found, "found"))
        scratch.drop(forward)
    # k a task and item: the tasks' best meet by salt first
    order = [F.desc("score"), F.asc_nulls_last("key")]
    part = out.withColumn("salt", F.pmod(F.xxhash64("key", "score"), F.lit(salts)))
    part = part.withColumn("r", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("r") <= k)
    part = part.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    named = items.select("item", "id")
    return part.join(named, "item").select(F.col("id").alias(item), "rank", F.col("key").alias(key), "score")


def oracle(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """The same rows in DuckDB SQL, with the defaults."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS rid FROM {documents}),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, {terms} AS term FROM d) GROUP BY rid, term),
n AS (SELECT rid, sum(tf)::BIGINT AS n FROM t GROUP BY rid),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, docs),
m AS (SELECT rid, (100 - 90 + (90 * n * docs) // length)::BIGINT AS m FROM n, s),
b AS (SELECT item_id, text, row_number() OVER () AS qid FROM {benchmark}),
q AS (SELECT DISTINCT qid, item_id, term FROM (SELECT qid, item_id, {terms} AS term FROM b)),
r AS (SELECT qid, item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY qid, item_id, rid)
SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM r JOIN d USING (rid) WHERE score > 0
QUALIFY rank <= 10"""

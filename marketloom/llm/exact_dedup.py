"""Exact dedup by skew-safe combining, comparing full content at every stage.

Texts count as equal when they are after white space is taken out. Three stages:

1. A task leads each of its rows to the first row of the task with the same digest and the
   same content. What it holds for that is bounded; beyond the bound it starts again, which
   only leaves more leaders to the next stages. Rows keep their leader's number, so no row of
   a group meets all others later, and only leaders keep their content.
2. A content whose digest no other leader has is done. Leaders that share a digest meet, a
   digest dealt over ``salts`` tasks, sorted by digest and content: the first of equal
   contents is their head.
3. The heads of all salts meet by digest and content.

A leader leads at most the rows of one task, and a group has at most as many leaders as there
are tasks: joins of rows go by leader, those of leaders by group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, small

#: Bytes that do not count.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def _sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def _local(digest: Callable[[bytes], bytes], held: int):
    """Arrow batches of (number, key, text) to (number, key, n, leader, sha256, digest, content); content is null unless the row leads."""

    def run(batches):
        seen: dict[bytes, list[tuple[bytes, int]]] = {}
        size = 0
        for batch in batches:
            n, leaders, shas, digests, contents = [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                content = text.encode().translate(None, BLANKS)
                d = digest(content)
                own = seen.setdefault(d, [])
                leader = next((r for c, r in own if c == content), None)
                n.append(len(text))
                shas.append(_sha256(content))
                digests.append(d)
                contents.append(content if leader is None else None)
                leaders.append(row if leader is None else leader)
                if leader is None:
                    own.append((content, row))
                    size += len(content) + 200
                    if size > held:
                        seen, size = {}, 0
            columns = [pa.array(n, pa.int64()), pa.array(leaders, pa.int64()), pa.array(shas, pa.binary()), pa.array(digests, pa.binary()), pa.array(contents, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "key", "n", "leader", "sha", "digest", "content"])

    return run


def _heads(leaders: DataFrame, by: tuple[str, ...], head: str) -> DataFrame:
    """``leaders`` with the smallest ``id`` of those that are equal in ``by``, contents included."""
    return leaders.withColumn(head, F.min("id").over(W.partitionBy(*by)))


def exact_dedup(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    salts: int = 16,
    held: int = 16 << 20,
    digest: Callable[[bytes], bytes] = _sha256,
) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row.

    Of equal texts the row with the most code points in its own text stays, then the one with
    the smallest key (null last); of rows equal in both, one. Null texts are empty ones, and
    equal to texts of white space only. An empty table gives an empty result; other columns
    are ignored. ``digest`` only decides which contents are compared: a weak one changes the
    work, not the result. A task holds ``held`` bytes of contents at most, and one text.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = scratch.save(numbered.mapInArrow(_local(digest, held), f"row long, key {kind}, n long, leader long, sha binary, digest binary, content binary"), "local")

    # leaders whose digest another leader has, too
    ids = rows.where("content IS NOT NULL").select(F.col("leader").alias("id"), "digest")
    shared = scratch.save(ids.groupBy("digest").agg(F.count("*").alias("leaders")).where("leaders > 1").select("digest"), "shared")
    leaders = rows.where("content IS NOT NULL").select(F.col("leader").alias("id"), "digest", "content")
    meet = leaders.join(small(shared), "digest", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    salted = scratch.save(_heads(meet, ("digest", "salt", "content"), "head").withColumn("content", F.when(F.col("id") == F.col("head"), F.col("content"))), "salted")
    winners = salted.where("content IS NOT NULL").select("id", "digest", "content")
    final = scratch.save(_heads(winners, ("digest", "content"), "group").select(F.col("id").alias("head"), "group"), "winners")

    # numbers only from here on: what a leader leads, then what a group holds
    best = F.min(F.struct((-F.col("n")).alias("short"), F.col("key").isNull().alias("no"), "key", "row"))
    own = rows.groupBy(F.col("leader").alias("id")).agg(F.count("*").alias("n"), best.alias("best"))
    to = salted.select("id", "head").join(small(final), "head").select(F.col("id").alias("led"), "group")
    led = scratch.save(own.join(to, F.col("id") == F.col("led"), "left").select("id", F.coalesce("group", "id").alias("group"), "n", "best"), "led")
    groups = scratch.save(led.groupBy("group").agg(F.sum("n").alias("size"), F.min("best").alias("best")), "groups")
    of = led.select("id", "group").join(groups, "group").select("id", "size", F.col("best")["key"].alias("keep"), F.col("best")["row"].alias("first"))
    out = rows.select("row", "key", "leader", "sha").join(of, F.col("leader") == F.col("id"))
    return out.select(
        F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("first")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def oracle(documents: str = "documents") -> str:
    """The same rows in DuckDB SQL, with the defaults."""
    return rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS own, row_number() OVER () AS rid FROM {documents}),
r AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY own) AS group_size FROM d WINDOW w AS (PARTITION BY own ORDER BY n DESC, doc_id NULLS LAST, rid))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(own) AS text_sha256 FROM r"""

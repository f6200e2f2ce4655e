"""Best-fit packing of token sequences by exact-complement hashing.

Only the number of pieces of each length matters for the plan, and that histogram has at most
``capacity`` entries. Sums of one and two lengths are hashed to the combinations that make
them, and a triple is a first length beside a pair. From the longest length down, the gap it
leaves is looked up in this index, for the combination with the longest first part; one that
fills the gap exactly is taken as often as the counts allow, which uses up a length each time.
Where exact filling would begin with a part much shorter than the longest that fits, it would
only leave the long ones without partners: then the longest is taken, as best fit does, and
what is left of the gap is looked up again. How much shorter is tried at several values, and
the plan with the fewest sequences is kept. The pieces then find their places by their rank
among the pieces of their length.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pretokens import SPECIAL
from .scratch import Scratch
from .textkit import chunks

#: Buckets of the pieces of a length, and buckets that are summed together.
BUCKETS = 4096
GROUP = 64


#: Characters beyond which a text is encoded by the tokenizers library: its ids are the same, and no run of blanks is too long for it.
LONG = 100_000


@lru_cache(maxsize=2)
def encoder(vocabulary: str, whole: str = "byte_bpe_50k.json"):
    """text -> ids of a public vocabulary, given in tiktoken's form and in that of the tokenizers library, whose ids these are."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    library = Tokenizer.from_file(public_tokenizers.path(whole))
    return lambda text: own.encode(text, allowed_special="all") if len(text) <= LONG else library.encode(text, add_special_tokens=False).ids


class Sums:
    """Lengths at hand, and the sums of two lengths, each hashed to the longer parts of the pairs that make it."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.have = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.have[length] = n
        there = np.flatnonzero(self.have)
        pairs: dict[int, list[int]] = {}
        for a in there[::-1].tolist():
            for b in there[there <= min(a, capacity - a)].tolist():
                pairs.setdefault(a + b, []).append(a)
        self.pairs = {total: np.array(longer, np.int64) for total, longer in pairs.items()}

    def longest(self, gap: int) -> int:
        """The longest length at hand of at most ``gap``; 0 if there is none."""
        fits = np.flatnonzero(self.have[1 : gap + 1])
        return int(fits[-1]) + 1 if len(fits) else 0

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths at hand that sum to ``total``, the longer of at most ``most``, with the longest one."""
        longer = self.pairs.get(total)
        if longer is None:
            return None
        ok = (longer <= most) & (self.have[longer] > 0) & (self.have[total - longer] > (2 * longer == total))
        first = np.flatnonzero(ok)
        return (int(longer[first[0]]), total - int(longer[first[0]])) if len(first) else None

    def exact(self, gap: int, least: int) -> tuple[int, ...] | None:
        """One to three lengths at hand that sum to ``gap``, the first the longest and of at least ``least``: the longest first part there is."""
        for a in (np.flatnonzero(self.have[least : gap + 1]) + least)[::-1].tolist():
            rest = gap - a
            if rest == 0:
                return (a,)
            if rest <= a and self.have[rest] > (rest == a):
                return (a, rest)
            self.have[a] -= 1
            two = self.pair(rest, a)
            self.have[a] += 1
            if two:
                return (a, *two)
        return None


def _plan(sums: Sums, capacity: int, slack: int | None) -> list[tuple[tuple[int, ...], int]]:
    """One plan; exact combinations may begin with a part that is ``slack`` shorter than the longest that fits (None: best fit alone)."""
    have, out = sums.have.copy(), []
    kept, sums.have = sums.have, have
    for length in range(capacity, 0, -1):
        while have[length]:
            pattern, gap = [length], capacity - length
            have[length] -= 1
            while gap and (longest := sums.longest(gap)):
                found = None if slack is None else sums.exact(gap, max(1, longest - slack))
                found = found or (longest,)
                for x in found:
                    have[x] -= 1
                pattern += found
                gap -= sum(found)
            use = Counter(pattern)
            for x, k in use.items():
                have[x] += k
            times = min(int(have[x]) // k for x, k in use.items())
            for x, k in use.items():
                have[x] -= k * times
            out.append((tuple(pattern), times))
    sums.have = kept
    return out


#: How much shorter than the longest that fits the first part of an exact combination may be.
SLACKS = (0, 8, 32, 128)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; every piece is used once, in no more sequences than best fit alone takes."""
    sums = Sums(counts, capacity)
    return min((_plan(sums, capacity, slack) for slack in (*SLACKS, None)), key=lambda found: sum(times for _, times in found))


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each run of ranks, its first sequence, the offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    first = 0
    for pattern, times in patterns:
        at = 0
        for x in pattern:
            runs.setdefault(x, []).append((used[x], first, at))
            used[x] += times
            at += x
        first += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}


def _pieces(capacity: int, vocabulary: str, end_id: int, key: str):
    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, _, _ in chunks(batch.column(1), 1 << 21):
                rows, out = [], []
                for i, text in enumerate(batch.column(1).slice(lo, hi - lo).to_pylist()):
                    tokens = np.array([*encode(text or ""), end_id], "<u4")
                    at, to = 0, len(tokens) % capacity or capacity
                    piece = 0
                    while at < len(tokens):
                        rows.append(lo + i)
                        out.append((piece, at, to - at, zlib.crc32(tokens[at:to].tobytes())))
                        piece, at, to = piece + 1, to, to + capacity
                cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *cols], [key, "piece", "start", "length", "ids_crc32"])

    return run


def pack(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = 1024, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 2
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A row's tokens are its text's ids (null: none; the special string is its one id) and
    ``end_id``. Longer rows than ``capacity`` are cut into full pieces, the first may be
    shorter. Equal rows and null keys are packed like any other; other columns are ignored;
    an empty table gives an empty result. Texts of over ``LONG`` characters are encoded by the
    tokenizers library, so no run of blanks or letters is too long. The text is read and tokenized once; the histogram
    of lengths (at most ``capacity`` rows) goes to the driver, the plan (a pattern ends a length,
    or lacks a piece of one for a second use) to the executors. Pieces of a length are dealt
    over ``BUCKETS`` buckets; only sums of these (``BUCKETS`` / ``GROUP`` rows) meet by length.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key), F.col(text)).mapInArrow(_pieces(capacity, vocabulary, end_id, key), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")
    # written row numbers spread rows that repeat a key and text over the buckets
    pieces = scratch.save(made.withColumn("u", F.monotonically_increasing_id()), "pieces").withColumn("h", F.xxhash64(key, "piece", "ids_crc32", "u")).withColumn("bucket", F.expr(f"length * {BUCKETS} + pmod(h, {BUCKETS})"))
    sums = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    # buckets of a length are summed in groups, then the groups, so that a common length is no task of its own
    sums = sums.withColumn("group", F.expr(f"bucket div {GROUP}"))
    groups = sums.groupBy("length", "group").agg(F.sum("n").alias("all"))
    start = groups.select("group", (F.sum("all").over(W.partitionBy("length").orderBy("group")) - F.col("all")).alias("start"))
    inner = F.sum("n").over(W.partitionBy("group").orderBy("bucket")) - F.col("n")
    before = sums.withColumn("inner", inner).join(start, "group").select("bucket", (F.col("start") + F.col("inner")).alias("before"))
    # one key for length and bucket, or Spark would keep all pieces of a length together
    own = W.partitionBy("bucket").orderBy("h", "u")
    ranked = pieces.join(before, "bucket").withColumn("rank", F.col("before") + F.row_number().over(own) - 1)

    def place(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                m = np.flatnonzero(length == x)
                lo, first, at = where.value[int(x)]
                run = np.searchsorted(lo, rank[m], "right") - 1
                seq[m], off[m] = first[run] + rank[m] - lo[run], at[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select(key, "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )

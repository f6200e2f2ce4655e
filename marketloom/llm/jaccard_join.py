"""Exact n-gram Jaccard self-join by adaptive multi-match prefixes.

Each text becomes its set of word shingles (64-bit hashes), put in one order for all texts:
shingles known to be frequent last, by the logarithm of their count, then by hash. If two
sets link, their overlap is at least alpha(n), the least overlap that a set of n shingles
needs with any partner. So the first n - alpha(n) + l shingles of both share at least l, for
every l. Each text takes the l that makes shingles looked up plus candidates verified
cheapest (candidates are at most the postings over l), and a pair must share min(l) shingles
at levels within both prefixes before it is verified against the whole sets.

Groups of copies never become all pairs. Equal sets collapse to one. Then, in rounds, every
text is compared with a leader of the lists it stands in, one whose shingles are the most
frequent (of a group of near-copies the text that has most in common with the others, as it
was changed least); what links becomes one component. Rounds end when they join little more,
and only texts of lists that still hold more than one component are compared with each other
across components. Two sets share at most what is frequent in either plus the rare shingles
that both list: where the first is too little for a link (texts that an edit moved away from
a large group), only shared rare shingles can make one, and the group's frequent shingles
aren't looked up for such texts at all. The result is exact: a pair is skipped only if both are known to be in
one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import BROADCAST_ROWS, Scratch, small
from .textkit import U, chunks, mix, shingles, words

#: Shingles known to stand in fewer texts than two to this power are rare, as are those not known at all.
RARE_POWER = 5
#: Postings of a shingle in a pack below which long lists are looked for by measuring.
MEASURED = 4096
#: Texts of a list, or partners of a text, that one key of a join may have.
STRIPE = 4096
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32])
_POST = "tok long, doc long, n int, ell int, lvl int, hub int, rare boolean, all_rare int"


def _signature(u: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(np.add.reduce(u).astype(np.int64)), int(np.bitwise_xor.reduce(mix(u + U(0x51ED27))).astype(np.int64))


def _sets(batch: pa.RecordBatch, size: int):
    """(row, set) of each row of a batch whose last column is the text."""
    for lo, hi, data, bounds in chunks(batch.column(batch.num_columns - 1)):
        h, row, _, _ = words(data, bounds)
        for i, u in enumerate(shingles(h, np.bincount(row, minlength=hi - lo), size)):
            yield lo + i, u


def _alpha(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set at ``percent`` or more."""
    return -(-percent * n // 100)


def _profile(size: int, percent: int, block: int):
    """Map: a row of each text (kind 0: id, n, signature), counts of shingles that stand twice or more in a block (kind 1), prefix sizes (kind 2)."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        total = prefix = 0

        def frequent():
            every = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            times = np.diff(np.append(first, len(every)))
            keep = times >= 2
            held.clear()
            k = int(keep.sum())
            zero = np.zeros(k, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), pa.array(every[first[keep]].view(np.int64)), pa.array(times[keep].astype(np.int64)), pa.array(zero), pa.array(zero)], ["kind", "a", "b", "c", "d"])

        for batch in batches:
            ids = batch.column(0)
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, u in _sets(batch, size):
                if len(u):
                    out[:, i] = len(u), *_signature(u)
                    key = (int(out[1, i]), int(out[2, i]))
                    if key not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(key)
                        held.append(u)
                        total += len(u)
                        prefix += len(u) - _alpha(len(u), percent) + 1
                if total >= block:
                    yield frequent()
                    total = 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int8)), ids.cast(pa.int64()), *map(pa.array, out)], ["kind", "a", "b", "c", "d"])
        if held:
            yield frequent()
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), *[pa.array([x], pa.int64()) for x in (prefix, 0, 0, 0)]], ["kind", "a", "b", "c", "d"])

    return run


def choose_level(df: np.ndarray, n: int, percent: int = 80) -> int:
    """The number of shared shingles to ask for, from the counts of a set's shingles in order.

    Looking up costs the counts of the prefix; at most (counts - 1) / l texts share l of
    them, and each costs a comparison of n shingles (a quarter of a lookup each).
    """
    alpha = _alpha(n, percent)
    levels = LEVELS[LEVELS <= alpha]
    ends = n - alpha + levels
    looked = np.cumsum(df[: ends[-1]], dtype=np.float64)[ends - 1]
    return int(levels[np.argmin(looked + (looked - ends) / levels * (n / 4.0))])


def _prefixes(size: int, percent: int, parts: int, frequent, split: int):
    """Map: postings of the prefixes, packed by part."""

    def run(batches):
        known, counts = frequent.value
        classes = np.log2(counts).astype(np.int64)
        table: list[tuple] = []
        toks: list[np.ndarray] = []
        dix: list[np.ndarray] = []
        lvls: list[np.ndarray] = []
        rares: list[np.ndarray] = []
        held = 0
        seen: set[tuple[int, int]] = set()

        def packed():
            tok, doc, lvl, rare = map(np.concatenate, (toks, dix, lvls, rares))
            info = np.array(table, dtype=[("id", np.int64), ("n", np.int32), ("ell", np.int32), ("s1", np.int64), ("s2", np.int64), ("hub", np.int32), ("all_rare", np.int32)])
            salt = np.zeros(len(tok), U)
            spread = np.zeros(len(tok), bool)
            if len(known):
                at = np.minimum(np.searchsorted(known, tok), len(known) - 1)
                spread = (known[at] == tok) & (counts[at] > split)
                ways = (counts[at[spread]] // split + 1).astype(U)
                salt[spread] = U(1) + info["s2"][doc[spread]].view(U) % ways
            # a shingle whose list would be long if all packs (about two a part) hold as many
            if split < parts * MEASURED:
                rest = np.flatnonzero(~spread)
                _, head, which, times = np.unique(tok[rest], return_index=True, return_inverse=True, return_counts=True)
                long = times > max(1, split // (2 * parts))
                if long.any():
                    own = rest[long[which]]
                    spread[own] = True
                    salt[own] = U(1) + info["s2"][doc[own]].view(U) % (times[which[long[which]]] * 2 * parts // split + 1).astype(U)
                    salt[rest[head[long]]] = 0  # tells the list's first part that there are others
            part = (mix(tok + salt * U(0x9E3779B9)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                own = order[ends[p] : ends[p + 1]]
                if len(own):
                    used, at = np.unique(doc[own], return_inverse=True)
                    rows.append((p, tok[own].tobytes(), at.astype(np.uint32).tobytes(), lvl[own].tobytes(), (spread[own] | rare[own].astype(np.uint8) << 1).astype(np.uint8).tobytes(), info[used].tobytes()))
            table.clear(), toks.clear(), dix.clear(), lvls.clear(), rares.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6)], ["part", "tok", "dix", "lvl", "flags", "info"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, u in _sets(batch, size):
                n = len(u)
                if not n or ids[i] is None:
                    continue
                s1, s2 = _signature(u)
                if (s1, s2, ids[i]) in seen:
                    continue
                seen.add((s1, s2, ids[i]))
                if len(seen) > 500_000:
                    seen.clear()
                alpha = _alpha(n, percent)
                ell, hub, common = 1, 0, np.zeros(n, bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, u), len(known) - 1)
                    there = known[at] == u
                    if there.any():
                        order = np.argsort(np.where(there, classes[at], 0), kind="stable")
                        u, common = u[order], (there & (classes[at] >= RARE_POWER))[order]
                        hub = int(64 * classes[at[there]].sum() // n)
                        ell = choose_level(np.where(there, counts[at], 1)[order], n, percent)
                k = n - alpha + ell
                level = np.ones(k, np.uint8)
                level[n - alpha + 1 :] = np.arange(2, ell + 1)
                toks.append(u[:k])
                dix.append(np.full(k, len(table), np.uint32))
                lvls.append(level)
                rares.append(~common[:k])
                rare = int(rares[-1].sum())
                # -1: the prefix ends among the rare shingles, so others may follow
                table.append((ids[i], n, ell, s1, s2, hub, rare if rare < k else -1))
                held += k
                if held >= 500_000:
                    yield packed()
                    held = 0
        if toks:
            yield packed()

    return run


_INFO = [("id", np.int64), ("n", np.int32), ("ell", np.int32), ("s1", np.int64), ("s2", np.int64), ("hub", np.int32), ("all_rare", np.int32)]


def _overlap(n, other, percent: int):
    """The overlap that sets of ``n`` and ``other`` need to link."""
    return -(-percent * (n + other) // (100 + percent))


def _lists(rows: pa.Table, percent: int) -> pa.Table:
    """One part: the postings of shingles that two different sets have; of equal sets only the smallest id's.

    A frequent shingle isn't listed for a set whose frequent shingles are too few for a link
    with any set of that list: shared rare shingles must find such links (`_candidates`).
    """
    tok, dix, lvl, flags, info, base = [], [], [], [], [], 0
    for t, d, l, h, x in zip(*(rows.column(c).to_pylist() for c in ("tok", "dix", "lvl", "flags", "info"))):
        info.append(np.frombuffer(x, _INFO))
        tok.append(np.frombuffer(t, U))
        dix.append(np.frombuffer(d, np.uint32).astype(np.int64) + base)
        lvl.append(np.frombuffer(l, np.uint8))
        flags.append(np.frombuffer(h, np.uint8))
        base += len(info[-1])
    tok, dix, lvl, flags, info = map(np.concatenate, (tok, dix, lvl, flags, info))
    order = np.lexsort((info["id"], info["s2"], info["s1"]))
    s1, s2 = info["s1"][order], info["s2"][order]
    keep = np.zeros(len(info), bool)
    keep[order[np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])]] = True
    own = keep[dix]
    tok, dix, lvl, flags = tok[own], dix[own], lvl[own], flags[own]
    order = np.argsort(tok, kind="stable")
    tok, dix, lvl, flags = tok[order], dix[order], lvl[order], flags[order]
    if len(tok):
        n, rare = info["n"].astype(np.int64)[dix], info["all_rare"].astype(np.int64)[dix]
        first = np.concatenate([[True], tok[1:] != tok[:-1]])
        least = np.minimum.reduceat(np.where(flags & 1 > 0, 0, n), np.flatnonzero(first))[np.cumsum(first) - 1]  # 0: of a list dealt over parts only some is here
        flags = np.where(least == 0, flags | 1, flags)
        far = (flags & 2 == 0) & (rare >= 0) & (_overlap(n, np.maximum(least, -(-percent * n // 100)), percent) > n - rare)
        tok, dix, lvl, flags = tok[~far], dix[~far], lvl[~far], flags[~far]
    same = tok[1:] == tok[:-1]
    more = np.zeros(len(tok), bool)
    more[1:] |= same
    more[:-1] |= same
    more |= flags & 1 > 0  # the list goes on in other parts
    tok, dix, lvl, flags = tok[more], dix[more], lvl[more], flags[more]
    arrays = [tok.view(np.int64), info["id"][dix], info["n"][dix], info["ell"][dix], lvl.astype(np.int32), info["hub"][dix], flags & 2 > 0, info["all_rare"][dix]]
    return pa.table([pa.array(np.ascontiguousarray(x)) for x in arrays], names=["tok", "doc", "n", "ell", "lvl", "hub", "rare", "all_rare"])


def _blobs(size: int):
    """Map: the last column's set as bytes, the other columns as they are."""

    def run(batches):
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            for i, u in _sets(batch, size):
                out[i] = u.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "set"])

    return run


def _compare(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_py(), U), np.frombuffer(right[i].as_py(), U)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(scratch: Scratch, docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of written pairs (a, b) those whose whole sets link.

    The sets of the texts that occur are made once. A text with many partners is dealt over
    several keys, its set once to each.
    """
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "ids")
    sets = scratch.save(docs.join(small(ids), "key").select("key", "text").mapInArrow(_blobs(size), "key long, set binary"), "sets")
    busy = pairs.groupBy("b").agg(F.count("*").alias("k")).where(F.col("k") > STRIPE)
    busy = scratch.save(busy.select("b", F.floor(F.col("k") / STRIPE).cast("int").alias("more")), "busy")
    more = F.coalesce("more", F.lit(0))
    dealt = pairs.join(small(busy), "b", "left").select("a", "b", F.expr("cast(pmod(xxhash64(a), coalesce(more, 0) + 1) as int)").alias("way"))
    left = dealt.join(sets.withColumnRenamed("key", "a"), "a")
    right = sets.withColumnsRenamed({"key": "b", "set": "other"}).join(small(busy), "b", "left").select("b", "other", F.explode(F.sequence(F.lit(0), more)).alias("way"))
    met = left.join(right, ["b", "way"]).select("a", "b", "set", "other")
    links = scratch.save(met.mapInArrow(_compare(percent), "a long, b long").distinct(), "links")
    scratch.drop(ids, sets, busy)
    return links


def _candidates(left: DataFrame, right: DataFrame, percent: int, extra, rare: bool = False, on: tuple[str, ...] = ("tok",)) -> DataFrame:
    """Pairs (a, b, shared) of postings that meet in enough shingles at levels within both prefixes and could link by size.

    ``rare``: pairs whose frequent shingles are too few for a link meet in rare shingles
    only, of any level, and in as many as are missing; both must have listed all of theirs.
    """
    ell = F.least("ell", "r_ell")
    within = (F.col("lvl") <= ell) & (F.col("r_lvl") <= ell)
    # What is common but not in both prefixes lies in the tail of the one whose prefix ends first,
    # so the overlap is at most shared + max(alpha) - l; both sizes say how much a link needs.
    alpha = lambda c: F.ceil(F.col(c) * percent / 100.0 - 1e-9)
    overlap = F.ceil((F.col("n") + F.col("r_n")) * percent / (100.0 + percent) - 1e-9)
    need = F.greatest(ell, overlap - F.greatest(alpha("n"), alpha("r_n")) + ell)
    if rare:
        missing = overlap - F.least(F.col("n") - F.col("all_rare"), F.col("r_n") - F.col("r_all_rare"))
        by_rare = (F.col("all_rare") >= 0) & (F.col("r_all_rare") >= 0) & (missing > 0)
        within, need = F.when(by_rare, F.col("rare")).otherwise(within), F.when(by_rare, missing).otherwise(need)
    met = left.join(right, list(on)).where(extra & within & (100 * F.least("n", "r_n") >= percent * F.greatest("n", "r_n")))
    return met.groupBy(F.col("doc").alias("a"), F.col("r_doc").alias("b")).agg(F.count("*").alias("shared"), F.min(need).alias("need")).where("shared >= need")


def _most_shared(post: DataFrame, lists: DataFrame) -> DataFrame:
    """``lists`` with ``most``: a text's shingles less the rare ones of its prefix that no other prefix has.

    Rare shingles (outside the frequent ones) come first in every prefix, so a text whose
    prefix goes beyond them has listed all of them.
    """
    listed = post.where("rare").groupBy("doc").agg(F.count("*").alias("listed"))
    gone = F.greatest(F.lit(0), F.col("all_rare") - F.coalesce("listed", F.lit(0)))
    return lists.join(listed, "doc", "left").withColumn("most", F.when(F.col("all_rare") >= 0, F.col("n") - gone).otherwise(F.col("n"))).drop("listed")


def jaccard_join(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    part_rows: int = 1_000_000,
    frequent_rows: int = 1 << 18,
    split: int = 1 << 17,
    pairs_a_posting: float = 2.0,
    rounds: int = 3,
) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``.

    ``key`` must be an integer column. Texts link when percent * |union| <= 100 * |intersection|
    of their sets of ``size``-word shingles (A-Z lower-cased; fewer words: the whole sequence
    is the one shingle). component_id is the smallest key reachable by links, the row's own
    included. Null and word-less texts have n_shingles 0 and link with nothing; rows with a
    null key have a null component_id and link with nothing. Rows that share a key are one
    document: each comes back, with one component. Other columns are ignored; an empty table
    gives an empty result.

    Bounds: ``frequent_rows`` counts of frequent shingles reach the driver and are broadcast
    (they only order prefixes, whatever is missing costs time, not links); a part holds about
    ``part_rows`` postings; lists of over ``split`` texts, by the counts or by what a task sees
    of them, are dealt over several parts. At most ``rounds`` rounds look for leaders; they end when the pairs left over
    are at most ``pairs_a_posting`` times the postings or a round leaves over four fifths of them.
    """
    if rounds < 1:
        raise ValueError("the pairs left over are compared after at least one round")
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    profile = scratch.save(docs.mapInArrow(_profile(size, percent, 2_000_000), "kind byte, a long, b long, c long, d long"), "profile")
    counted = (
        profile.where("kind = 1").groupBy("a").agg(F.sum("b").alias("times")).where("times >= 4")
        .orderBy(F.desc("times"), "a").limit(frequent_rows).toArrow()
    )
    known = counted.column("a").to_numpy().view(U)
    order = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[order], counted.column("times").to_numpy()[order]))
    sizes = profile.agg(F.sum(F.when(F.col("kind") == 2, F.col("a"))).alias("total"), F.count_if(F.col("kind") == 0).alias("rows")).first()
    total, n_rows = sizes["total"] or 0, sizes["rows"]
    parts = max(8, -(-total // part_rows))
    post = scratch.save(
        docs.mapInArrow(_prefixes(size, percent, parts, frequent, split), "part int, tok binary, dix binary, lvl binary, flags binary, info binary")
        .repartitionById(parts, "part").groupBy("part").applyInArrow(lambda rows: _lists(rows, percent), _POST),
        "postings",
    )

    found: list[DataFrame] = []
    lists, comp, last = post.withColumn("comp", F.col("doc")), None, None
    postings = post.count()
    for r in range(rounds + 1):
        if r:
            links = found[0]
            for more in found[1:]:
                links = links.union(more)
            comp = components(links, scratch)
            named = post.join(comp, post["doc"] == comp["id"], "left").select("tok", "doc", "n", "ell", "lvl", "hub", "rare", "all_rare", F.coalesce("component", "doc").alias("comp"))
            mixed = named.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tok")
            before, lists = lists, scratch.save(named.join(mixed, "tok"), "lists")
            scratch.drop(before)
            by = scratch.save(lists.groupBy("tok", "comp").agg(F.count("*").alias("k")).groupBy("tok").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk")), "by")
            cross = by.agg(F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2)).first()[0] or 0
            if cross == 0:
                break
            if cross <= pairs_a_posting * postings or r == rounds or (last is not None and cross > 0.8 * last):
                before, lists = lists, scratch.save(_most_shared(post, lists), "left")
                scratch.drop(before)
                right = lists.select("tok", *[F.col(c).alias(f"r_{c}") for c in ("doc", "n", "ell", "lvl", "comp", "all_rare", "most")])
                # with a text whose prefix holds all its rare shingles, none is common that stands in no list
                most = F.least(F.when(F.col("r_all_rare") >= 0, F.col("most")).otherwise(F.col("n")), F.when(F.col("all_rare") >= 0, F.col("r_most")).otherwise(F.col("r_n")))
                could = (100 + percent) * most >= percent * (F.col("n") + F.col("r_n"))
                # a long list meets itself in stripes
                long = by.where(F.col("k") > STRIPE).select("tok", F.floor(F.col("k") / STRIPE).cast("int").alias("more"))
                long = small(scratch.save(long, "long"))
                striped = lists.join(long, "tok", "left").withColumn("way", F.expr("cast(pmod(xxhash64(doc), coalesce(more, 0) + 1) as int)")).drop("more")
                right = right.join(long, "tok", "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("more", F.lit(0))))).drop("more")
                differ = (F.col("doc") < F.col("r_doc")) & (F.col("comp") != F.col("r_comp")) & could
                pairs = _candidates(striped, right, percent, differ, rare=True, on=("tok", "way")).select("a", "b")
                pairs = scratch.save(pairs, "pairs")
                found.append(_links(scratch, docs, pairs, size, percent))
                break
            last = cross
        # later rounds vary the leader among texts of nearly the same hub
        first = F.struct((-F.col("hub") if r == 0 else F.floor(F.log2(1.0 + F.col("hub")) * -8)).alias("h"), F.xxhash64("doc", F.lit(r)).alias("p"), *[F.col(c).alias(f"r_{c}") for c in ("doc", "n", "ell", "lvl", "comp")])
        leaders = lists.groupBy("tok").agg(F.min(first).alias("l")).select("tok", "l.*").drop("h", "p")
        pairs = _candidates(lists, leaders, percent, F.col("comp") != F.col("r_comp"))
        best = pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
        pairs = scratch.save(best, "pairs")
        found.append(_links(scratch, docs, pairs, size, percent))

    rows = profile.where("kind = 0").select(F.col("a").alias(key), F.col("b").cast("int").alias("n_shingles"), "c", "d").withColumn("n_shingles", F.col("n_shingles").cast("long"))
    sets = rows.where(F.col("n_shingles") > 0).where(F.col(key).isNotNull())
    # only sets that two rows or more have; large groups are few and meet their rows by broadcast
    first = sets.groupBy("n_shingles", "c", "d").agg(F.min(key).alias("rep"), F.count("*").alias("k")).where("k > 1")
    first = scratch.save(first, "equal")
    large = F.greatest(F.lit(64), F.lit(n_rows // BROADCAST_ROWS))
    few, many = (first.where(x).drop("k") for x in (F.col("k") <= large, F.col("k") > large))
    same = ["n_shingles", "c", "d"]
    rest = sets.join(F.broadcast(many.select(*same)), same, "left_anti")
    equal = rest.join(few, same).unionByName(sets.join(F.broadcast(many), same)).where(F.col(key) != F.col("rep")).select(F.col(key).alias("a"), F.col("rep").alias("b"))
    for links in found:
        equal = equal.union(links)
    comp = components(equal, scratch)
    scratch.drop(post, lists, *found)
    return rows.join(comp, rows[key] == comp["id"], "left").select(rows[key], "n_shingles", F.coalesce("component", rows[key]).alias("component_id"))


def oracle(documents: str = "documents") -> str:
    """The same rows in DuckDB SQL, with the defaults, by meeting all pairs that share a shingle: for small tables."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
p AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM s UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, m AS component_id FROM s JOIN (SELECT v, min(u) AS m FROM r GROUP BY v) ON v = doc_id"""

"""The filter audit, ranked search and exact dedup against plain loops, with nulls, ties, repeated rows, long texts and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import exact_dedup, filter_audit, lexical_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("row", "leader", "digest", "content", "salt", "head", "group", "n", "size", "best", "id", "part", "A", "E", "t", "w", "first", "of", "lk", "s", "term", "item", "codes", "times", "rank", "score", "k")


def words_of(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(2, 6))) for _ in range(150)] + ["Straße", "été", "漢字", "X9", "don't"]
    out = [(i, words_of(rng, vocab, rng.choice((5, 40, 110, 160))), rng.choice(("en", "de", None)), "a", 1) for i in range(120)]
    out += [(200 + i, out[rng.randrange(40)][1], rng.choice(("en", "fr")), "a", 1) for i in range(60)]  # exact copies
    out += [(300 + i, out[7][1].replace(" ", rng.choice(("  ", "\t", "\n "))), "en", "a", 1) for i in range(40)]  # copies but for white space
    out += [(400, None, None, None, None), (401, "", "en", "a", 0), (402, " \n\t ", "en", "a", 3), (403, "A B C D # $ | %", "en", "a", 1), (404, "ABC " * 120, "zz", "a", 1)]
    out += [(None, out[3][1], "en", "a", 1), (None, out[3][1], "en", "a", 1), (None, None, None, None, None), (5, out[5][1], "en", "a", 1), (5, out[5][1], "en", "a", 1)]
    out += [(405, words_of(rng, vocab, 60_000), "en", "c", 1), (406, "z" * 1_000_000, "en", "c", 1), (407, "漢" * 400_000 + " X9", "en", "c", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in CLASH}).repartition(5).cache()


def brute_dedup(rows):
    own = defaultdict(list)
    for at, (i, t, *_) in enumerate(rows):
        own[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, at))
    out = Counter()
    for content, members in own.items():
        first = min(members)
        sha = hashlib.sha256(content.encode()).hexdigest()
        for m in members:
            out[(rows[m[3]][0], rows[first[3]][0], len(members), m == first, sha)] += 1
    return out


@pytest.mark.parametrize("args", [{}, {"salts": 1}, {"held": 1}, {"digest": lambda c: bytes([len(c) % 3])}, {"digest": lambda c: b"", "held": 5_000}])
def test_exact_dedup(docs, rows, args):
    got = exact_dedup.exact_dedup(docs, **args).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute_dedup(rows)


def test_exact_dedup_of_one_hot_group_and_of_nothing(spark):
    hot = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same  text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text")).repartition(12)
    got = exact_dedup.exact_dedup(hot).groupBy("kept", "group_size").count().collect()
    assert {(r.kept, r.group_size, r["count"]) for r in got} == {(True, 1, 4000), (True, 2000, 1), (False, 2000, 1999)}
    assert exact_dedup.exact_dedup(hot.limit(0)).count() == 0


def test_exact_dedup_takes_text_keys(spark):
    got = exact_dedup.exact_dedup(spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, "xy  ")], "row string, leader string"), key="row", text="leader").collect()
    assert {(r.row, r.keep_id, r.group_size, r.kept) for r in got} == {("b", None, 3, False), ("a", None, 3, False), (None, None, 3, True)}


LABELS = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 120, 3)] + [(9, None, 1), (9, 1, None), (None, 1, 1), (200, 1, 1)]


def brute_audit(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = {x[0] for x in labels if x[1] == 1 and x[0] is not None}, {x[0] for x in labels if x[2] == 1 and x[0] is not None}
    flagged = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        flagged.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for order in permutations("ABCDE"):
        for k, f in enumerate(order):
            for part in {x[0] for x in flagged}:
                mine = [x for x in flagged if x[0] == part]
                came = [x for x in mine if not any(x[1][c] for c in order[:k])]
                gone = [x for x in came if x[1][f]]
                failing = [x for x in mine if x[1][f]]
                unique = [x for x in failing if sum(x[1].values()) == 1]
                out[(part, "".join(order), k + 1)] = [len(came) - len(gone), len(gone), len(failing) - len(gone), len(unique), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    shapley = Counter()
    for (part, order, k), v in out.items():
        shapley[part, order[k - 1]] += v[1]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


AUDITED = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit(spark, docs, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = filter_audit.filter_audit(docs.drop("A", "E"), labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in AUDITED) for r in got} == brute_audit(rows, LABELS)
    assert len(got) == 600 * len({x[2] for x in rows})


def test_filter_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    got = filter_audit.filter_audit(docs.where("doc_id = 400"), labels).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and sum(r["removed"] for r in got) == 120


def test_audit_of_any_flags(spark):
    flags = spark.createDataFrame([("p", True, None, 2), ("p", True, True, 3), ("p", False, False, 5), ("q", False, True, None)], "where string, x boolean, y boolean, bytes long")
    got = filter_audit.interaction_audit(flags, ("x", "y"), part="where", losses={"lost": "bytes"}).collect()
    assert {(r["where"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["lost"], r["shapley"]) for r in got} == {
        ("p", "xy", 1): (1, 2, 0, 1, 5, 3), ("p", "xy", 2): (1, 0, 1, 0, 0, 1), ("p", "yx", 1): (2, 1, 0, 0, 3, 1), ("p", "yx", 2): (1, 1, 1, 1, 2, 3),
        ("q", "xy", 1): (1, 0, 0, 0, 0, 0), ("q", "xy", 2): (0, 1, 0, 1, 0, 2), ("q", "yx", 1): (0, 1, 0, 1, 0, 2), ("q", "yx", 2): (0, 0, 0, 0, 0, 0),
    }
    with pytest.raises(ValueError):
        filter_audit.interaction_audit(flags, ())


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(rows, items, k=10):
    tf = [Counter(TERM.findall((t or "").translate(FOLD))) for _, t, *_ in rows]
    n = [sum(c.values()) for c in tf]
    documents, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = Counter()
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(FOLD)))
        scored = []
        for at, c in enumerate(tf):
            m = 10 + 90 * n[at] * documents // length
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, rows[at][0] is None, rows[at][0] or 0, at))
        for rank, x in enumerate(sorted(scored)[:k], 1):
            out[(item, rank, rows[x[3]][0], -x[0])] += 1
    return out


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(9)
    out = [(i, " ".join(rng.sample(rows[rng.randrange(120)][1].split(), 4))) for i in range(40)]
    return out + [(90, rows[7][1]), (91, rows[3][1] + "; " + rows[3][1].upper()), (92, None), (93, ""), (94, "... !"), (95, "nowhereatall"), (96, "x9 STRASSE straße É été don"), (None, rows[5][1]), (7, rows[8][1]), (97, "z" * 1_000_000)]


@pytest.mark.parametrize("args", [{}, {"pairs": 20}, {"cells": 1}, {"k": 3, "salts": 1}])
def test_lexical_search(spark, docs, rows, items, args):
    got = lexical_search.lexical_search(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)), **args).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == brute_search(rows, items, args.get("k", 10))


def test_lexical_search_of_nothing(spark, docs):
    some = spark.createDataFrame([(1, "x9")], "item_id long, text string")
    assert lexical_search.lexical_search(docs.limit(0), some).count() == 0
    assert lexical_search.lexical_search(docs, some.limit(0)).count() == 0
    assert lexical_search.lexical_search(docs.where("doc_id = 400"), some).count() == 0


def test_the_threshold_stops_early():
    """Lists are left where the threshold falls below the k-th score, not before: the result is that of all rows, from fewer entries."""
    rng = np.random.default_rng(3)
    rows = 4000
    codes = [np.sort(rng.choice(30, rng.integers(1, 12), replace=False)) for _ in range(rows)]
    n = rng.integers(20, 900, rows)
    times = [rng.integers(1, 6, len(c)) for c in codes]
    table = pa.table({"key": pa.array(rng.permutation(rows)), "n": pa.array(n), "codes": pa.array(codes, pa.list_(pa.int32())), "times": pa.array(times, pa.list_(pa.int32()))})
    block = lexical_search.Block(table, 30, rows, int(n.sum()))
    wanted, weights = np.array([2, 5, 11]), np.array([4000, 900, 2500])
    found, read = block.search(wanted, weights, [], 10)
    scores = block.table[:, wanted].astype(np.int64) @ weights
    want = sorted((-int(s), False, k) for s, k in zip(scores, block.keys.to_pylist()) if s > 0)[:10]
    assert found == want
    assert 0 < read < 0.8 * sum(block.start[wanted + 1] - block.start[wanted])
    again, read = block.search(wanted, weights, [(-(10**12), False, i) for i in range(10)], 10)  # better ones are known: nothing is read
    assert read == 0 and len(again) == 10

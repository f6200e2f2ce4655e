"""Operators for training data against brute force, on edge cases and small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketloom.llm import jaccard_join, mixing, mpeg_audio, packing, quality_rules, sharding, token_counts, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.choice((3, 8, 40, 120)))] for _ in range(25)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words), rng.choice(("en", None)), rng.choice(("a", "b", None)), 1))
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t", "en", "a", 3), (None, "w1 w2", "en", "a", 1), (0, rows[0][1], "en", "a", 1), (203, "x " * 30_000, "en", "b", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """Brute force: (id, set size, smallest id of its component) of (id, set) rows."""
    known = [(i, s) for i, s in rows if i is not None]
    top = {i: i for i, _ in known}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, x in known:
        for b, y in known:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                top[hi] = lo
    return Counter((i, len(s), None if i is None else find(i)) for i, s in rows)


@pytest.mark.parametrize("edits, words", [(6, 150), (9, 200)])
def test_jaccard_join_of_a_large_group(spark, monkeypatch, edits, words):
    """Copies with few and with many edits: some link with the base, some only with each other, some with nothing."""
    monkeypatch.setattr(jaccard_join, "STRIPE", 16)
    rng = random.Random(edits)
    base = ["b%d" % i for i in range(words)]
    rows = []
    for i in range(240):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(words)
            text[at] = rng.choice(("x%d" % rng.randrange(4), "y%d" % rng.randrange(10**6)))
        if rows and rng.random() < 0.25:  # a copy of a copy
            text = rng.choice(rows)[1].split()
            text[rng.randrange(len(text))] = "z%d" % rng.randrange(10**6)
        if rng.random() < 0.1:
            text = text[: rng.randint(words * 3 // 4, words)]
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, rows[7][1]) for i in range(90)]  # more equal texts than a broadcast group needs
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = components([(i, shingles(t)) for i, t in rows])
    assert len({c for _, _, c in want}) > 5
    for more in ({}, {"rounds": 1, "pairs_a_posting": 0.0}, {"split": 50}, {"split": 20, "frequent_rows": 5, "rounds": 1}):
        assert Counter(map(tuple, jaccard_join.jaccard_join(table, **more).collect())) == want


def test_jaccard_join(docs):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    assert Counter(map(tuple, jaccard_join.jaccard_join(docs).collect())) == components(rows)
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


def test_token_counts_and_packing(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a  b   c", "x\n\n y", "it's <|endoftext|> é漢😀", "", "aaaa" * 500, " lead", "trail \n", "a b"]
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))(texts) == want
    assert [list(packing.encoder("byte_bpe_50k.tiktoken")(x)) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    out = packing.pack(docs).toPandas().sort_values(["sequence_id", "offset"])
    for _, g in out.groupby("sequence_id"):
        assert (g.offset.values == (g.length.cumsum() - g.length).values).all() and g.length.sum() <= 1024
    assert out.length.sum() == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_uses_every_piece():
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 64) for _ in range(500))
    used = Counter()
    for pattern, times in packing.plan(dict(counts), 64):
        assert sum(pattern) <= 64 and times > 0
        for x in pattern:
            used[x] += times
    assert used == counts


def test_mixing(docs):
    out = mixing.mix_sources(docs).toPandas()
    assert len(out) == docs.count() and (out.taken <= 2 * out["size"]).all()
    again = mixing.mix_sources(docs.repartition(3)).toPandas()
    assert Counter(map(str, out.values.tolist())) == Counter(map(str, again.values.tolist()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_sharding(docs):
    out = sharding.shard(docs).toPandas()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert ((out.grown_shard == out["shard"]) | (out.grown_shard == 8)).all()
    assert sorted(map(int, out.text_crc32)) == sorted(zlib.crc32((r.text or "").encode()) for r in docs.collect())


def test_quality_rules(docs):
    for r in quality_rules.quality_rules(docs, keep=("text",)).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            covered |= set(range(i, i + 5)) if times[g] > 1 else set()
        assert (r.n_words, r.n_repeat_words) == (len(w), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://a.example.com/en/7?x", "http://x.com/en/1", "HTTP://B.ORG/es/", "http://example.com/en/8", "https://e.example.net/de/81", None, "nothing", "http://c.net/de/9#t", "http://spam-farm.example.org/x"]
    got = {r.url: (r.rule, r.verdict) for r in url_filters.filter_urls(spark.createDataFrame([(u, u) for u in urls], "url string, u string"), key="url", url="u").collect()}
    assert got["http://a.example.com/en/7?x"] == ("example.com/en/7", "allow")
    assert got["http://x.com/en/1"] == ("com/en/", "block") and got["HTTP://B.ORG/es/"] == ("org/es/", "block")
    assert got["https://e.example.net/de/81"] == ("example.net/de/8", "block") and got["http://c.net/de/9#t"] == ("net/de/", "allow")
    assert got[None] == (None, "allow") and got["nothing"] == (None, "allow") and got["http://spam-farm.example.org/x"] == (None, "block")


def test_audio_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 3, 6, 7, 8, 29):
        payload = rng.bytes(192 * n)
        stored = mpeg_audio.store(payload)
        audio = mpeg_audio.parse(stored)
        assert mpeg_audio.payload(stored, audio) == payload and not audio.failed and audio.table["frames"] == len(audio.offsets)
    damaged = bytearray(mpeg_audio.store(rng.bytes(192 * 70)))
    damaged[mpeg_audio.parse(bytes(damaged)).offsets[3]] = 0
    assert mpeg_audio.parse(bytes(damaged)).skipped > 0 and len(mpeg_audio.parse(bytes(damaged)).offsets) >= 8
    assert mpeg_audio.parse(b"").duration == 0


def test_media_digests(docs):
    out = mpeg_audio.media_digests(docs).toPandas()
    assert len(out) == docs.count() and (out.payload_bytes % 192 == 0).all() and (out.payload_bytes >= 192).all()

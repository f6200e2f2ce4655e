"""Every operator for training data against a plain loop, and on the cases that tables hold: nulls, empties, repeats, clashing names."""

import base64
import hashlib
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import jaccard_join, mixing, mpeg_audio, packing, quality_classifier, quality_rules, sharding, token_counts, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    out = [(i, words_of(rng, vocab, rng.choice((5, 30, 120))), rng.choice(("en", "de", None)), rng.choice(("a", "b", None)), 1) for i in range(60)]
    out += [(60, None, None, None, None), (61, "", "en", "a", 0), (62, " \n\t ", "en", "a", 3), (None, out[3][1], "en", "a", 1), (None, out[3][1], "en", "a", 1)]
    out += [(3, out[3][1], "en", "a", 1), (63, "é漢😀 " * 40, "xx", "b", 1), (64, "line one is here\nline one is here\n## $$ %%", "en", "a", 1), (65, words_of(rng, vocab, 12_000), "en", "c", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("h", "bucket", "n", "row", "w", "u", "key", "size", "shard", "slot", "host", "at", "upto", "before", "length", "k", "target", "_k", "_key")})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(docs, rows, tokenizer):
    got = Counter(map(tuple, token_counts.token_counts(docs).collect()))
    want = Counter()
    for i, t, *_ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    assert got == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 1_000_000 + "x", "a" * 400_000, "ab" * 200_000, "".join(random.Random(1).choices("abcdefghij", k=300_000)), "x" * 60 + " " + "yz" * 90])
def test_long_unbroken_texts(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))([text]) == [len(ids)]
    assert list(packing.encoder("byte_bpe_50k.tiktoken")(text)) == ids


def test_packing(docs, rows, tokenizer):
    got = packing.pack(docs).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at, piece = 0, 0
        while at < len(ids):
            n = (len(ids) - at) % 1024 or 1024
            want[(i, piece, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n])))] += 1
            at, piece = at + n, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(held) <= -(-sum(n for *_, n, _ in want.elements()) // 1024) + 1


def test_sums_are_those_of_a_search():
    rng = random.Random(5)
    for _ in range(60):
        left = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 12)))
        sums, gap = packing.Sums(left, 40), rng.randint(1, 39)
        pieces = sorted(left.elements())
        exact = [c for k in (1, 2, 3) for c in combinations(pieces, k) if sum(c) == gap]
        found = sums.exact(gap, 1)
        assert bool(found) == bool(exact)
        if found:
            assert sum(found) == gap and not Counter(found) - left and found[0] == max(found) == max(map(max, exact))
            assert sums.exact(gap, found[0]) and not sums.exact(gap, found[0] + 1)


def best_fit(counts, capacity):
    """Sequences that plain best fit takes, piece by piece from the longest."""
    gaps = Counter()
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            gap = min((g for g in gaps if g >= length and gaps[g]), default=capacity)
            if gaps[gap]:
                gaps[gap] -= 1
            gaps[gap - length] += 1
    return sum(gaps.values())


def test_no_more_sequences_than_best_fit(tokenizer):
    rng = np.random.default_rng(8)
    draws = [rng.integers(1, 1025, 3000), rng.integers(300, 701, 3000), rng.integers(257, 512, 2000), rng.integers(100, 401, 3000), np.minimum(rng.lognormal(5.5, 1, 3000).astype(int) + 1, 1024)]
    draws += [rng.integers(1, rng.integers(2, 1025), rng.integers(1, 60)) for _ in range(40)]
    for lengths in draws:
        counts = Counter(lengths.tolist())
        found = packing.plan(counts, 1024)
        used = Counter()
        for pattern, times in found:
            assert sum(pattern) <= 1024 and times > 0
            for x in pattern:
                used[x] += times
        assert used == counts
        assert -(-sum(k * n for k, n in counts.items()) // 1024) <= sum(t for _, t in found) <= best_fit(counts, 1024)
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    counts = Counter()
    for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False):
        n = len(x.ids) + 1
        counts.update({1024: n // 1024} if n >= 1024 else {})
        counts.update([n % 1024] if n % 1024 else [])
    least, most = -(-sum(k * n for k, n in counts.items()) // 1024), best_fit(counts, 1024)
    assert (least, most) == (962, 964) and sum(t for _, t in packing.plan(counts, 1024)) <= 963


def test_mixing_reaches_its_targets(docs, rows):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = {s: sum(len(WORD.findall(t or "")) for _, t, _, x, _ in rows if x == s) for s in ("a", "b", "c", None)}
    taken, target, most = Counter(), {}, Counter()
    by_id = {i: s for i, _, _, s, _ in rows if i is not None}
    for r in got:
        s = by_id.get(r.doc_id, "a")
        assert r.source_size == size[s] and 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s], target[s], most[s] = taken[s] + r.taken, r.target, max(most[s], r.size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * max(most.values()) and target[s] <= 2 * size[s] + 1e-6
    again = mixing.mix_sources(docs.repartition(5), range_rows=7).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)


def test_mixing_of_one_hot_key(spark):
    """Rows that all share a null key are one queue and still spread over ranges."""
    df = spark.createDataFrame([(None, "w " * (1 + i % 3), "en", "s", 1) for i in range(300)], SCHEMA)
    got = mixing.mix_sources(df, range_rows=10).collect()
    assert len(got) == 300 and sum(r.taken for r in got) == pytest.approx(got[0].target, abs=3)


def draws(tree, key):
    """The tree's choice in plain Python: Spark's 64-bit hash of a key and a name, seeds chained."""
    def hash_long(v, seed):
        return xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()

    def draw(name, weight):
        h = seed if key is None else hash_long(key, seed)
        h = xxhash.xxh64(name.encode(), seed=h).intdigest()
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight

    seed, level = 42, ""
    children = defaultdict(dict)
    for region, rack, shard, weight in tree:
        for parent, child in (("", region), (region, rack), (rack, str(shard))):
            children[parent][child] = children[parent].get(child, 0.0) + weight
    for _ in range(3):
        level = min((draw(c, w), c) for c, w in children[level].items())[1]
    return int(level)


def test_sharding(spark, docs, rows):
    got = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key") for i, t, *_ in rows)
    for r in got:
        assert r["shard"] == draws(sharding.tree(8), r.doc_id)
        assert r.grown_shard in (r["shard"], 8) and r.grown_shard == draws(sharding.tree(9), r.doc_id)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs.limit(0)).count() == 0
    # a heavier shard wins rows from everywhere, no row moves between the others' regions otherwise
    base, heavy = sharding.tree(8), [(*x[:3], 3.0 if x[2] == 5 else 1.0) for x in sharding.tree(8)]
    place = {x[2]: x for x in base}
    moved = [(draws(base, i), draws(heavy, i)) for i in range(600)]
    for a, b in moved:
        if a != b:
            assert place[b][0] == place[5][0] and (place[a][0] != place[5][0] or b == 5 or place[b][1] == place[5][1])


def classes(c):
    cat = unicodedata.category(c)
    if c in " \t\n\x0b\x0c\r":
        return 4
    if cat == "Ll":
        return 0
    if cat == "Lu":
        return 1
    if cat[0] in "LM":
        return 2
    if cat[0] == "N":
        return 3
    if c in ".,;:'\"?()-":
        return 5
    return 6 if cat[0] == "P" and not c.isascii() else 7


def distance(p, q):
    """Jensen-Shannon distance in base 2."""
    m = [(a + b) / 2 for a, b in zip(p, q)]
    half = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, half(p) / 2 + half(q) / 2))


def passes(w):
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)


LEAST = {"least_docs": 8, "reference_words": 300, "reference_chars": 900}


@pytest.mark.parametrize("least", [LEAST, {"least_docs": 8, "reference_words": 1200, "reference_chars": 900}, {"least_docs": 10**6}, {}])
def test_quality_rules(spark, docs, rows, least, monkeypatch):
    least = {"least_docs": 20, "reference_words": 2_000, "reference_chars": 10_000} | least
    monkeypatch.setattr(quality_rules, "LARGE", 3)  # a language of fewer than a third of the passing rows is not large
    unit = 10**9
    hists, totals, clean, count, pool = defaultdict(lambda: [0] * 8), Counter(), defaultdict(Counter), Counter(), [0] * 8
    size, length = Counter(), Counter()
    hist_of = lambda t: [Counter(map(classes, t))[k] for k in range(8)]
    passing = [(t or "", lang or "") for _, t, lang, *_ in rows if passes(WORD.findall(t or ""))]
    for t, lang in passing:
        w = WORD.findall(t)
        count[lang] += 1
        size[lang], length[lang] = size[lang] + len(w), length[lang] + len(t)
        totals[lang] += len(w) * (unit // len(w))
        for x in w:
            if len(x) <= 4:
                clean[lang][x.lower()] += unit // len(w)
        for k, v in enumerate(hist_of(t)):
            hists[lang][k] += v * (unit // len(t))
            pool[k] += v * (unit // len(t))
    refs = {}
    for lang in count:
        if count[lang] >= least["least_docs"] and size[lang] >= least["reference_words"] and length[lang] >= least["reference_chars"]:
            top = sorted(clean[lang].items(), key=lambda x: (-x[1], x[0]))[:16]
            refs[lang] = (hists[lang], [x for x, _ in top], [s for _, s in top], totals[lang], count[lang] * 3 >= len(passing))
    wide = lambda h: [h[0] + h[1] + h[2], h[3], h[4] + h[5] + h[6], h[7]]
    shares = lambda h: [x / sum(h) for x in h]
    got = quality_rules.quality_rules(docs, keep=("text", "lang"), **least).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert r.word_chars == sum(map(len, w)) and r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        lang, found = r.lang or "", []
        if r.base_failed:
            assert not r.kept and r.char_distance is r.word_distance is None
            continue
        h, u, v = hist_of(t), unit // len(t), unit // len(w)
        for own, (hist, vocab, sums, total, large) in refs.items():
            if not large and own != lang:
                continue
            me = own == lang
            cd = wd = None
            if len(t) >= 100:
                cd = distance(shares(h), shares([a - me * b * u for a, b in zip(hist, h)]))
            if len(w) >= 40:
                n = Counter(x.lower() for x in w if len(x) <= 4)
                mine = [n[x] / len(w) for x in vocab]
                theirs = [(s - me * n[x] * v) / (total - me * len(w) * v) for x, s in zip(vocab, sums)]
                wd = distance([*mine, 1 - sum(mine)], [*theirs, 1 - sum(theirs)])
            found.append((max((wd or 0) / 0.5, (cd or 0) / 0.25), cd, wd))
        if lang not in refs and len(passing) >= least["least_docs"]:
            cd = distance(shares(wide(h)), shares(wide([a - b * u for a, b in zip(pool, h)]))) if len(t) >= 100 else None
            found.append(((cd or 0) / 0.25, cd, None))
        best = min(found, key=lambda x: (x[0], x[1] is not None, x[1] or 0), default=(0, None, None))
        assert r.kept == (best[0] <= 1)
        for a, b in ((r.char_distance, best[1]), (r.word_distance, best[2])):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)
    empty = quality_rules.quality_rules(docs.limit(0))
    assert empty.count() == 0


def test_urls_by_plain_rules(spark, monkeypatch):
    rng = random.Random(2)
    parts = ["example", "com", "net", "org", "de", "en", "es", "spam", "farm", "cheap", "pills", "xxx", "porn", "videos", "warez", "click", "track", "a7", "EN"]
    url = lambda: rng.choice(("http://", "https://", "HTTP://", "")) + rng.choice((".", "-")).join(rng.choices(parts, k=rng.randint(1, 4))) + rng.choice(("", "/", "/en/", "/de/8", "/en/7x", "/EN/", "/click-track/", "/a?b", "#c", "/x/warez"))
    urls = [url() for _ in range(600)] + [None, "", "://", "x://", "http://com/en/\nporn-videos", "http://example.com/en/7", "http://example.com/en/7"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    domain = [("com", "/en/", "block", "com/en/"), ("example.com", "/en/7", "allow", "example.com/en/7"), ("net", "/de/", "allow", "net/de/"), ("example.net", "/de/8", "block", "example.net/de/8"), ("org", "/es/", "block", "org/es/")]
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), re.split(r"[?#]", rest[cut:])[0]
        fits = [d for d in domain if (host == d[0] or host.endswith("." + d[0])) and path.startswith(d[1])]
        best = max(fits, key=lambda d: len(d[3]), default=None)
        verdict = best[2] if best else "block" if any(re.search(r.regex.replace(r"\z", r"\Z"), host + path) for r in url_filters.PATTERN_RULES) else "allow"
        want.append((i, host, path, best and best[3], verdict))
    got = lambda: sorted(map(tuple, url_filters.filter_urls(pages).collect()))
    assert got() == want and {w[4] for w in want if w[3] is None} == {"allow", "block"}
    monkeypatch.setattr(url_filters, "LITERAL_TOKENS", 3)
    assert got() == want
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


def test_rules_of_a_table(spark):
    """100,000 rules as a table judge as the same rules one by one, and as those of the plan."""
    rng = random.Random(21)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    hosts = [f"{name()}.{rng.choice(('com', 'org', 'net'))}" for _ in range(60_000)]
    rules = sorted({rng.choice(hosts) + rng.choice(("", "/", "/en/", f"/{name()}", f"/{name()}/x1", "/A.b(c")) for _ in range(130_000)} | {"com/en/", "x.org/\\Eq"})[:100_000]
    rules = [*rules, "com/en/", "x.org/\\Eq"]
    table = spark.createDataFrame([(r, rng.choice(("block", "allow"))) for r in dict.fromkeys(rules)] + [(None, "block")], "rule string, verdict string")
    verdict = {r.rule: r.verdict for r in table.collect()}
    del verdict[None]
    urls = [f"http://{rng.choice(('', 'www.', 'a.b.'))}{rng.choice(hosts)}{rng.choice(('', '/', '/en/', f'/{name()}/x1y', '/A.b(cd', '/EN/', '?q', '#f'))}" for _ in range(4000)]
    urls += [None, "", "x", "http://com/en/z", "http://x.org/\\Eqq", "http://"] + urls[:50]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"token": F.lit("x"), "name": F.lit("y"), "hit": F.lit(1)})
    made = url_filters.domain_rule_table(table)
    loose = spark.createDataFrame([("odd", "block", "^$", [], 3), ("none", "block", None, ["x"], 9), ("short", "allow", "^com/", ["com"], 5)], made.schema)
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls_by_table(pages, made.unionByName(loose)).collect()}
    want = set()
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].lower(), re.split(r"[?#]", rest[cut:])[0]
        parts, fits = host.split("."), []
        for k in range(len(parts)):
            own = ".".join(parts[k:])
            fits += [own + path[:n] for n in range(1, len(path) + 1) if own + path[:n] in verdict] + ([own] if own in verdict else [])
        best = max(fits, key=len, default=None)
        other = "block" if host + path == "" else "allow"
        want.add((i, host, path, best, verdict[best] if best else other))
    assert got == want and sum(w[3] is not None for w in want) > 1000
    few = [url_filters.domain_rule(verdict[r], r) for r in rng.sample(sorted(verdict), 300)] + [url_filters.domain_rule("block", "com/")]
    small = spark.createDataFrame([(r.name, r.verdict) for r in few], "rule string, verdict string")
    assert sorted(map(tuple, url_filters.filter_urls_by_table(pages, url_filters.domain_rule_table(small)).collect())) == sorted(map(tuple, url_filters.filter_urls(pages, rules=tuple(few)).collect()))
    assert url_filters.filter_urls_by_table(pages.limit(0), made).count() == 0 and url_filters.filter_urls_by_table(pages, made.limit(0)).where("verdict = 'allow'").count() == len(urls)
    with pytest.raises(ValueError):
        url_filters.filter_urls_by_table(pages, spark.createDataFrame([(str(i), "block", "x", [], 1) for i in range(65)], made.schema))


def test_patterns_hold_their_tokens():
    for r in url_filters.PATTERN_RULES:
        text = "/" + "-".join(r.tokens) + "/" if r.regex.startswith("(?s)/") else "-".join(r.tokens) + ".site/"
        assert re.search(r.regex.replace(r"\z", r"\Z"), text), r
        found = set(re.findall(r"(?<![A-Za-z0-9])[a-z0-9]+(?![A-Za-z0-9])", text))
        assert set(r.tokens) <= found


def test_media_digests(docs, rows):
    got = {}
    for r in mpeg_audio.media_digests(docs).collect():
        got.setdefault((r.doc_id, r.n_bytes), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        for r in got[i, len(raw)]:
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
            stored = mpeg_audio.store(full)
            assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
            # a plain walk over the frames behind the tag
            at = 10 + (stored[6] << 21 | stored[7] << 14 | stored[8] << 7 | stored[9])
            offsets, samples = [], 0
            while at < len(stored):
                h = mpeg_audio.header(int.from_bytes(stored[at : at + 4], "big"))
                offsets.append(at)
                at, samples = at + h.size, samples + h.samples
            assert r.seek_offsets == offsets[1:]  # the first frame is the table's
            assert r.duration_num / r.duration_den == pytest.approx((samples - 1152) / 32000)
            assert f"frames={len(offsets) - 1};" in r.feature and "failed=0" in r.feature
    assert mpeg_audio.media_digests(docs.limit(0)).count() == 0


def mpeg_frame(rng, version, layer, slot, rate, mode=0, ext=0, free=0):
    word = 0x7FF << 21 | version << 19 | (4 - layer) << 17 | slot << 12 | rate << 10 | mode << 6 | ext << 4
    h = mpeg_audio.header(word, free)
    body = bytes(b if b != 255 else 254 for b in rng.randbytes(h.size - 6))
    whole = word.to_bytes(4, "big") + b"\0\0" + body
    return whole[:4] + mpeg_audio.bit_checksum(*mpeg_audio._protected(whole, 0, h)).to_bytes(2, "big") + whole[6:]


@pytest.mark.parametrize("layer", [1, 2, 3])
def test_audio_layers(layer):
    rng = random.Random(layer)
    for version, mode, ext in ((3, 0, 0), (2, 1, 1), (0, 3, 0)):
        for slot, rate in ((2, 0), (9, 1), (14, 2)):
            frames = [mpeg_frame(rng, version, layer, slot, rate, mode, ext) for _ in range(4)]
            data = b"junk" + b"".join(frames)
            audio = mpeg_audio.parse(data)
            assert len(audio.offsets) == audio.checked == 4 and not audio.failed and audio.skipped == 4
            damaged = bytearray(data)
            damaged[4 + len(frames[0]) + 7] ^= 16
            assert mpeg_audio.parse(bytes(damaged)).failed == [1]
    free = b"".join(mpeg_frame(rng, 3, layer, 0, 0, free=700) for _ in range(5))
    assert mpeg_audio.parse(free).offsets == [0, 700, 1400, 2100, 2800]


def test_audio_tags_and_tables():
    assert mpeg_audio.checksum(b"123456789") == mpeg_audio.bit_checksum(int.from_bytes(b"123456789", "big"), 72) == 0xAEE7  # the check value of this CRC
    rng = random.Random(4)
    frames = b"".join(mpeg_frame(rng, 3, 3, 9, 0) for _ in range(3))
    old = b"TT2" + bytes([0, 0, 4]) + b"\0abc"
    tag = b"ID3\x02\0\0" + bytes([0, 0, 0, len(old)]) + old
    last = b"TAG" + b"song".ljust(30, b"\0") + b"band".ljust(30, b"\0") + b"disc".ljust(30, b"\0") + b"2001" + b"\0" * 31
    got = mpeg_audio.parse(tag + frames + last)
    assert got.tags == {"TT2": "abc", "title": "song", "artist": "band", "album": "disc"} and len(got.offsets) == 3 and got.skipped == 0
    head = mpeg_frame(rng, 3, 3, 9, 0)
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 5000, 3, 2, 10, 2, 1) + struct.pack(">HH", 41, 42)
    vbr = head[:36] + table + head[36 + len(table) :]
    got = mpeg_audio.parse(vbr + frames)
    assert got.table["kind"] == "VBRI" and (got.table["frames"], got.table["bytes"], got.table["steps"]) == (3, 5000, [410, 420]) and len(got.offsets) == 3


def labelled(rng, n):
    """Texts whose quality and toxicity follow from plain marks; half of the toxic ones are also of low quality."""
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(40, 80))]
        good, toxic = int(rng.random() < 0.6), int(rng.random() < 0.3)
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(("grolk", "vuznik", "prabst"))
        if not good:
            w = [x + rng.choice(("###", "$$$", "")) for x in w]
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, good, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(8)
    rows, labels = labelled(rng, 700)
    rows += [(None, rows[0][1], None, None, None), (9000, None, None, None, None), (9001, "", None, None, None), (5, rows[5][1], "en", "a", 1)]
    labels += [(None, 1, 1), (9000, None, None), (9999, 1, 0), (9001, 3, 2)]
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("k", "y", "t", "x", "h", "dk", "score", "held_out", "toxic")})
    return wide, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_quality_classifier(spark, learned):
    docs, labels, rows, truth = learned
    got = quality_classifier.quality_classifier(docs, labels).collect()
    want = {i: q for i, q, _ in truth}
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    wrong = 0
    for r in got:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        wrong += r.held_out and r.doc_id < 9000 and r.predicted != want[r.doc_id]
    assert wrong <= 2
    scores = defaultdict(set)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        scores[texts.get(r.doc_id, rows[0][1])].add(r.score)
    assert all(len(s) == 1 for s in scores.values())
    # labels of the held-out fold are never read
    other = labels.withColumn("quality", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.quality_classifier(docs, other).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    named = quality_classifier.quality_classifier(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))), labels.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))))
    assert named.where("predicted = 0").count() > 50
    assert {r.score for r in quality_classifier.quality_classifier(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_classifier(docs.limit(0), labels).count() == 0


def test_quality_sees_order_and_letters(spark):
    """Held-out good texts pass; the same with words shuffled, or with the letters of each word shuffled, mostly do not; a change of no weight does no harm."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, labels, key="doc_id", text="text", label="quality", folds=5, sample=12_000)
    held = docs.join(labels.where("quality = 1"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").where("length(text) > 300").orderBy("doc_id")
    texts = [r.text for r in held.select("text").collect()]
    rng = random.Random(9)
    of = lambda out: np.mean(quality_classifier.score(quality_classifier.features(pa.array(out), model["familiar"]), model) >= 0.3)
    assert len(texts) > 40 and of(texts) >= 0.97 and of([t.replace("\n", " ") for t in texts]) >= 0.97 and of([t[: len(t) // 2] for t in texts]) >= 0.97
    assert of([" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]) <= 0.1
    assert of([" ".join("".join(rng.sample(w, len(w))) for w in t.split(" ")) for t in texts]) <= 0.2


def test_quality_steps_and_runs():
    """Steps from word to word and runs of three bytes, against plain loops, over parts smaller than the texts."""
    texts = ["One two, three. Four\nfive 6; é x", "", "word", " a  B\t\nC. d! E", "x" * 50 + " Y. z", "Last. one"]
    data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    whole = quality_classifier._PART
    try:
        for part in (whole, 7):
            quality_classifier._PART = part
            got = [Counter() for _ in texts]
            for bucket, row in quality_classifier.runs(data, bounds):
                for b, r in zip(bucket.tolist(), row.tolist()):
                    got[r][b] += 1
            for t, g in zip(texts, got):
                b = t.encode()
                assert g == Counter(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(b) - 2))
    finally:
        quality_classifier._PART = whole
    steps = quality_classifier._steps(data, bounds)
    for t, row in zip(texts, steps):
        want, found = np.zeros(12), list(WORD.finditer(t))
        for a, b in zip(found, found[1:]):
            end, begin = a.group()[-1], b.group()[0]
            kind = 3 if t[a.end()] == "\n" else 0 if end in ".!?" else 1 if end in ",;:" else 2
            want[kind * 3 + (0 if "A" <= begin <= "Z" else 1 if "a" <= begin <= "z" else 2)] += 1
        assert np.allclose(row, want / (want.sum() + quality_classifier.FEW))


def test_spoilt_texts():
    """The words, and each word's letters, are all there again; texts without any are left alone, and a text is always spoilt in the same way."""
    for text in ("", " ", "\n", "a", "\x00", "One two, three. Four\nfive 6; é漢😀 x " * 20):
        words, letters = quality_classifier.spoilt(text)
        assert Counter(words.split()) == Counter(text.split()) and len(letters) == len(text)
        assert [sorted(w) for w in WORD.findall(letters)] == [sorted(w) for w in WORD.findall(text)]
        assert quality_classifier.spoilt(text) == [words, letters] and (len(text) < 9 or (words != text and letters != text))


def test_pairwise_loss():
    """The weights are where the gradient of the pairs' loss, taken numerically, vanishes; the cut is the quantile of the bad documents' share."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, quality_classifier.N_FEATURES))
    good = (x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=300) > -0.4).astype(int)
    model = quality_classifier.fit(x, good, pairs=3000, seed=4)
    z = quality_classifier.expand(x, model)
    pick = np.random.default_rng(4)
    d = z[pick.choice(np.flatnonzero(good == 1), 3000)] - z[pick.choice(np.flatnonzero(good == 0), 3000)]
    loss = lambda w: np.logaddexp(0, -(d @ w)).mean() + 0.5e-3 * w @ w
    for k in (0, 3, 20, 40):
        step = np.zeros(len(model["w"]))
        step[k] = 1e-4
        assert abs(loss(model["w"] + step) - loss(model["w"] - step)) / 2e-4 < 1e-4
    s = z @ model["w"]
    assert np.mean(s < model["cut"]) == pytest.approx(np.mean(good == 0), abs=0.01)
    assert quality_classifier.score(x, model)[np.argmin(abs(s - model["cut"]))] == pytest.approx(0.3, abs=0.05)


def test_quality_learns_from_all_rows(spark):
    """The only bad texts lie behind 12,000 labelled rows in the order of their ids' hashes."""
    ids = spark.range(15_500).where("crc32(cast(cast(id as string) as binary)) % 5 <> 0").orderBy(F.xxhash64("id"), "id")
    order = [r.id for r in ids.collect()]
    assert len(order) > 12_150
    last = set(order[12_050:])
    rows = [(i, f"a{i} #{i % 7}# $$ b|c" if i in last else f"The plain text {i % 97}, of few words.") for i in range(15_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in last)) for i in range(15_500)], "doc_id long, quality int")
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert {r.doc_id for r in got if not r.predicted} == last


def feature_rows(x, good, worse):
    own = iter(worse)
    return [(int(g), bytearray(r.tobytes() + (next(own).tobytes() if g else b""))) for r, g in zip(x, good)]


@pytest.mark.parametrize("shift,wild", [(0.4, 1.0), (3.0, 1e7)])
def test_fit_of_a_table_is_that_of_all_pairs(spark, shift, wild):
    """Against every pair made in memory: weights, threshold and slope; and bit by bit the same however the rows are dealt."""
    rng = np.random.default_rng(5)
    good = (rng.random(500) < 0.7).astype(int)
    x = rng.normal(size=(500, quality_classifier.N_FEATURES)) + shift * good[:, None] * (np.arange(quality_classifier.N_FEATURES) % 5 == 0)
    x[7, 3], x[:, 11] = wild, 0.25
    worse = x[good == 1][:, None] + rng.normal(size=(good.sum(), 2, quality_classifier.N_FEATURES)) - 0.2
    want = quality_classifier.fit(x, good, worse=worse)
    rows = feature_rows(x, good, worse)
    scratch = quality_classifier.Scratch(spark, "test")
    found = []
    for parts, order in ((1, range(500)), (7, rng.permutation(500))):
        table = spark.createDataFrame([rows[i] for i in order], "y int, x binary").repartition(parts)
        found.append(quality_classifier.fit_rows(table, scratch))
    for k in ("mean", "scale", "w", "cut", "slope", "shift"):
        assert np.array_equal(found[0][k], found[1][k]), k
        assert np.allclose(found[0][k], want[k], rtol=1e-3, atol=1e-3 * np.abs(want["w"]).max()), k
    assert np.abs(quality_classifier.score(x, found[0]) - quality_classifier.score(x, want)).max() < 1e-3


def test_ranks_of_keys(spark):
    """Any rank of doubles, many of them equal or negative."""
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-9, 9, 300), np.full(200, -1.5), [0.0, -0.0, 7.0, 7.0]])
    keys = spark.createDataFrame([(int(k),) for k in quality_classifier._ordered(v)], "key long")
    order = np.sort(quality_classifier._ordered(v))
    assert (quality_classifier._ordered(np.sort(v)) == order).all()
    for rank in (0, 1, 150, 250, len(v) - 1):
        assert quality_classifier._ranked(keys, rank) == order[rank]


def test_toxicity(learned):
    docs, labels, rows, truth = learned
    got = toxicity.toxicity(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    want = {i: t for i, _, t in truth}
    wrong = sum(r.toxic != want[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert wrong <= 2 and all(r.toxic == int(r.p_toxic >= 0.5) for r in got)
    assert all((r.p_quality, r.p_toxic, r.toxic) == (0, 0, 0) for r in got if r.doc_id in (9000, 9001))
    other = labels.withColumn("toxic", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(repr, got)) == sorted(map(repr, toxicity.toxicity(docs, other).collect()))
    assert {r.toxic for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs, labels, features_held=2000).count() == len(rows)


def test_chain_learns_from_out_of_fold_probabilities():
    """Each link's out-of-fold column is a loop over folds that never sees the fold, and is the next link's input."""
    rng = np.random.default_rng(2)
    n = 240
    sets = [np.unique(rng.integers(0, 60, 15)) for _ in range(n)]
    rows, cols = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets).astype(np.int64)
    y = np.stack([np.array([3 in s for s in sets]), np.array([3 in s and 5 in s for s in sets])], 1).astype(float)
    y[::17, 0] = np.nan
    fold = toxicity.folds_of(rows, cols, n, 4)
    model = toxicity.fit(rows, cols, y, fold, least=1)
    extra = np.zeros((n, 0))
    dims = len(np.unique(cols))
    place = np.searchsorted(np.unique(cols), cols)
    for c in range(2):
        out = np.zeros(n)
        for k in range(4):
            train, test = (fold != k) & ~np.isnan(y[:, c]), fold == k
            at = np.cumsum(train) - 1
            link = toxicity._logistic(at[rows[train[rows]]], place[train[rows]], int(train.sum()), extra[train], y[train, c], dims)
            at = np.cumsum(test) - 1
            out[test] = toxicity._predict(at[rows[test[rows]]], place[test[rows]], int(test.sum()), extra[test], link)
        assert np.allclose(out, model["oof"][:, c])
        extra = np.hstack([extra, out[:, None]])
    # copies share a fold
    again = toxicity.folds_of(np.concatenate([rows, rows + n]), np.concatenate([cols, cols]), 2 * n, 4)
    assert (again[:n] == again[n:]).all()


def test_join_ignores_clashing_columns_and_keeps_repeats(docs, rows):
    got = jaccard_join.jaccard_join(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.n_shingles for r in got if r.doc_id in (60, 61, 62)} == {0}
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_vocabulary_forms_agree():
    """The two files that op10 reads hold one vocabulary."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert len(ranks) == len(set(ranks.values()))

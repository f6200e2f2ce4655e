"""The pipeline's stages, each against a plain loop over its input, and all of them in a row."""

import random
import re
from collections import Counter

import corpus_pipeline
from marketloom.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, t, lang="en", source="a"):
    return (i, t, lang, source, len(t) if t is not None else None)


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_quality_rules_has_a_reference_for_every_language(spark):
    rng = random.Random(3)
    rows = []
    for k in range(20):
        # each its own short words; the last but one in a script without case, the last without short words
        letters = "אבגדהוזח" if k >= 18 else "abcdefghijklmnopqrstuvwxyz"
        vocab = ["".join(rng.choice(letters) for _ in range(9 if k == 19 else 4)) for _ in range(16)]
        for _ in range(60 - 2 * k):
            rows.append((len(rows), " ".join(rng.choice(vocab) for _ in range(60)), f"l{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules.quality_rules(docs, keep=("lang",)).collect()
    assert len(got) == len(rows)
    assert {r["lang"] for r in got if not r["base_failed"] and not r["kept"]} == set()
    assert {r["lang"] for r in got if r["kept"]} == {f"l{k:02}" for k in range(20)}
    few = [r for r in rows if r[2] in ("l00", "l18")]  # languages too small for a reference: one of them has letters without case
    got = quality_rules.quality_rules(spark.createDataFrame(few, "doc_id long, text string, lang string"), reference_words=10**9).collect()
    assert all(r["kept"] or r["base_failed"] for r in got)


def junk(seed, words=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("0123456789#$%&<>|*=~@^") for _ in range(rng.randint(1, 6))) for _ in range(words))


def prose(rng, n, words=70):
    """Texts of a dozen common short words and many longer ones."""
    short = ["".join(random.Random(k).choice("abcdefghij") for _ in range(2 + k % 3)) for k in range(12)]
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(k)) for k in (5, 6, 7, 8, 9) for _ in range(24)]
    return [" ".join(rng.choice(short if rng.random() < 0.6 else vocab) for _ in range(words)).capitalize() + "." for _ in range(n)]


def test_one_row_makes_no_reference(spark, tmp_path):
    """Junk of the language, and more of it under a language of its own: neither serves the other, and both go in the pipeline's first stage."""
    rng = random.Random(6)
    rows = [row(i, t) for i, t in enumerate(prose(rng, 40))] + [row(100, junk(1)), row(101, junk(2), lang="zz"), row(102, junk(3, 8000), lang="yy")]
    kept = {r["doc_id"] for r in corpus_pipeline.rules(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert kept == set(range(40))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i]["base_failed"] for i in (100, 101, 102)) and min(got[i]["char_distance"] for i in (100, 101, 102)) > 0.25


def test_failing_rows_fill_no_vocabulary(spark):
    """Long rows that fail the base rules change no verdict and no distance of the others."""
    rng = random.Random(7)
    rows = [row(i, t) for i, t in enumerate(prose(rng, 40))] + [row(50, " ".join("".join(rng.choice("vwxyz") for _ in range(3)) for _ in range(80)))]
    failing = [row(60 + i, "vvw xyz zzy wxv yyx " * 400) for i in range(10)]
    result = lambda rows: {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    without, with_them = result(rows), result(rows + failing)
    assert all(with_them[i] == r for i, r in without.items()) and not with_them[50]["kept"] and all(with_them[i]["kept"] for i in range(40))
    assert all(with_them[60 + i]["base_failed"] and with_them[60 + i]["char_distance"] is None for i in range(10))


def test_long_rows_do_not_outweigh_the_others(spark):
    rng = random.Random(8)
    clean = [row(i, t) for i, t in enumerate(prose(rng, 40))]
    long = [row(100 + k, " ".join(f"{rng.randrange(10**6)}#%" for _ in range(30_000))) for k in range(2)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(clean + long, SCHEMA)).collect()}
    assert {i for i, kept in got.items() if kept} == set(range(40))


def test_thousands_of_languages(spark):
    """Languages of 25 rows have references that are joined, those of one row are held against all: clean rows stay, junk goes."""
    rng = random.Random(9)
    texts_of = prose(rng, 300, 90)
    rows = [(k * 100 + i, texts_of[(k + 7 * i) % 300], f"l{k:04}") for k in range(5000) for i in range(25 if k < 150 else 1)]
    rows += [(10**6 + k, junk(k), f"l{k * 400:04}") for k in range(12)] + [(2 * 10**6, junk(99), None)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), keep=("lang",)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if not r["kept"]} == {r[0] for r in rows if r[0] >= 10**6}
    assert all((r["word_distance"] is not None) == (r["lang"] is not None and r["lang"] < "l0150") for r in got if r["kept"])


def material():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    good = [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(60)]
    bad = ["#$%& " * 50 + f"{i} <|> !!!" for i in range(60)]
    return good, bad


def test_rules_stage(spark, tmp_path):
    good, _ = material()
    rows = [row(i, t) for i, t in enumerate(good)] + [row(None, good[0]), row(7, "too few words"), row(None, None), row(8, ""), row(9, "same five words come again " * 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = Counter()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        # one language of one shape: the divergence keeps all that pass the base rules
        want[(r[0], r[1])] += len(w) >= 10 and 100 * len(covered) <= 20 * len(w)
    assert texts(corpus_pipeline.rules(spark, docs, str(tmp_path))) == +want
    assert corpus_pipeline.rules(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_classifier_stage(spark, tmp_path):
    good, bad = material()
    labelled = [row(i, t) for i, t in enumerate(good[:40] + bad[:40])]
    # ids 0 to 79 have labels; here come rows without an id and an id that a good and a bad row share
    more = [row(None, t) for t in good[40:50] + bad[40:50]] + [row(500, good[50]), row(500, bad[50]), row(500, good[51])]
    labels = [(i, int(i < 40), 0) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(labelled + more, SCHEMA)
    assert texts(corpus_pipeline.classifier(spark, docs, str(tmp_path))) == Counter((r[0], r[1]) for r in labelled + more if r[1] in good)
    assert corpus_pipeline.classifier(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_copies_stage(spark, tmp_path):
    good, _ = material()
    near = good[5].rsplit(" ", 1)[0] + " other"
    copies = [row(None, good[0])] * 3 + [row(None, good[1]), row(7, good[1]), row(9, good[1])] + [row(500, good[2]), row(500, good[3]), row(500, good[3])]
    copies += [row(21, near), row(20, good[5]), row(None, None), row(None, None), row(30, ""), row(31, " ")]
    rows = [(r[0], set(zip(*[(r[1] or "").split()[k:] for k in range(5)]))) for r in copies]
    group = list(range(len(rows)))
    for i, (_, x) in enumerate(rows):
        for j in range(i):
            if x and 100 * len(x & rows[j][1]) >= 80 * len(x | rows[j][1]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = Counter()
    for g in set(group):
        members = [copies[i] for i in range(len(copies)) if group[i] == g]
        first = min(members, key=lambda r: (r[0] is None, r[0] or 0))
        want[(first[0], first[1])] += 1
    docs = spark.createDataFrame(copies, SCHEMA)
    assert texts(corpus_pipeline.near_copies(spark, docs, str(tmp_path))) == want
    assert corpus_pipeline.near_copies(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_mixing_stage(spark, tmp_path):
    good, _ = material()
    rows = [row(500, t) for t in good[:9]] + [row(None, t, source=None) for t in good[9:12]] + [row(None, good[12])] * 4 + [row(i, t, source="b") for i, t in enumerate(good[13:40])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = texts(corpus_pipeline.mixing(spark, docs, str(tmp_path)))
    held = Counter((r[0], r[1]) for r in rows)
    assert all(n <= 2 * held[k] for k, n in got.items())
    size = lambda s: sum(len(r[1].split()) for r in rows if r[3] == s)
    weights = {"a": 5, "b": 2, None: 1}
    total, target, left = 1.5 * sum(map(size, weights)), {}, dict(weights)
    while left:  # targets stop at twice the source, the rest is shared again
        over = {s for s, w in left.items() if (total - sum(target.values())) * w / sum(left.values()) > 2 * size(s)}
        if not over:
            rest = total - sum(target.values())
            target |= {s: rest * w / sum(left.values()) for s, w in left.items()}
            break
        target |= {s: 2 * size(s) for s in over}
        left = {s: w for s, w in left.items() if s not in over}
    source = {(r[0], r[1]): r[3] for r in rows}
    for s in weights:
        taken = sum(n * len(k[1].split()) for k, n in got.items() if source[k] == s)
        assert abs(taken - target[s]) <= 120
    assert got == texts(corpus_pipeline.mixing(spark, docs.repartition(3), str(tmp_path)))
    assert corpus_pipeline.mixing(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_all_stages(spark, tmp_path):
    good, bad = material()
    rows = [row(i, t, source="ab"[i % 2]) for i, t in enumerate(good[:40] + bad[:40])] + [row(100 + i, t) for i, t in enumerate(good[:5])] + [row(None, None), row(200, "")]
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    assert texts(docs) == Counter({(i, t): 1 for i, t in enumerate(good[:40])})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= set(range(40)) and len({r.doc_id for r in got}) >= 30
    for r in got:
        assert 0 < r.length <= 1024 and r.offset + r.length <= 1024

"""Quality rules by distribution divergence, in DataFrame and SQL functions only.

References come from the corpus: for each language with enough documents that pass the base
rules, the mean shares of its characters over eight classes, and of its most common short
words plus all others. Each document counts once, however long, and is left out of the
reference that it is compared with itself. A document is compared by the Jensen-Shannon
distance with the reference of its own language and those of the large ones (its label may be
wrong); it is kept if one is near in characters and in words. A language too small for a
reference serves no other language; its documents are kept if they are near a large language,
or if their shares of letters (of any script), digits, separators and other characters are
near those of the whole corpus. Texts too short for a histogram pass the comparison it would
need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, small

WORD = r"[^\x20\x09-\x0D]+"
#: Character classes as regular expressions; each character belongs to one, those left to a class of their own.
CLASSES = {
    "lower": r"\p{Ll}",
    "upper": r"\p{Lu}",
    "other_letter": r"[\p{Lt}\p{Lm}\p{Lo}\p{M}]",
    "digit": r"\p{N}",
    "space": r"[\x20\x09-\x0D]",
    "sentence": r"[.,;:'\"?()\-]",
    "mark": r"[\p{P}&&[^\x00-\x7F]]",
}
#: The classes by number as letters, digits and separators of any script.
WIDE = ((0, 1, 2), (3,), (4, 5, 6), (7,))
#: Of classes that most characters of a script are in, what is left when runs of all others go: a match a run, not one a character.
OTHERS = {"lower": r"\P{Ll}+", "other_letter": r"[^\p{Lt}\p{Lm}\p{Lo}\p{M}]+"}
#: Classes without ASCII characters: they are counted in what is left of a text without these.
WIDER = ("other_letter", "mark")
#: Shares are summed as whole numbers of this, so that sums do not depend on their order.
UNIT = 1_000_000_000
#: A language of at least one in so many of the passing documents is large: there are no more such languages.
LARGE = 100
#: Most references of other languages that are broadcast (under a kilobyte each); more are joined by shuffle, and none of them is a hundredth of the rows.
SMALL_REFERENCES = 20_000
#: Whether a row of features fails the base rules.
FAILED = "(n < 10 OR 100 * n_repeat_words > 20 * n)"


def _histogram(text: str, wider: str) -> list[Column]:
    of = lambda c: F.col(wider if c in WIDER else text)
    count = lambda c, p: F.length(F.regexp_replace(of(c), F.lit(OTHERS[c]), F.lit(""))) if c in OTHERS else F.regexp_count(of(c), F.lit(p))
    return [count(c, p).cast("long").alias(c) for c, p in CLASSES.items()]


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once: the optimiser may copy a column's expression to wherever the column is used."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _distance(pairs: str) -> str:
    """SQL of the Jensen-Shannon distance (base 2) of an array of structs of two shares, p and q."""
    term = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / (z.p + z.q)) ELSE 0D END"
    return f"sqrt(greatest(0D, 0.5D * aggregate({pairs}, 0D, (s, z) -> s + ({term('z.p')} + {term('z.q')}))))"


def features(docs: DataFrame, *, key: str, text: str, lang: str, letters: int, keep: tuple[str, ...]) -> DataFrame:
    """(_k, _keep_..., l, n, chars, hist, seen, times, and the base numbers) of every row; seen and times are its short words, in lower case and sorted, with their counts."""
    df = docs.select(
        F.col(key).alias("_k"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("l"), F.coalesce(F.col(text), F.lit("")).alias("t"),
    )
    df = df.withColumn("wider", F.regexp_replace("t", F.lit(r"[\x00-\x7F]+"), F.lit("")))
    df = df.withColumns({
        "w": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)),
        "chars": F.length("t"),
        "n_symbols": F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "lines": F.expr(r"filter(split(t, '\\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
        "hist": F.array(*_histogram("t", "wider")),
    })
    runs = "transform(sorted, (x, i) -> CASE WHEN i = 0 OR x <> get(sorted, i - 1) THEN i END)"
    counted = "struct(transform(starts, i -> sorted[i]) AS seen, transform(starts, (i, j) -> coalesce(get(starts, j + 1), size(sorted)) - i) AS times)"
    short = f"sort_array(transform(filter(w, x -> length(x) <= {int(letters)}), x -> lower(x)))"
    df = df.withColumns({
        "n": F.size("w"),
        "hist": F.expr("concat(hist, array(chars - aggregate(hist, 0L, (s, v) -> s + v)))"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "h": F.expr("CASE WHEN size(w) >= 5 THEN transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) ELSE array() END"),
        "short": F.expr(_let("sorted", short, _let("starts", f"filter({runs}, i -> i IS NOT NULL)", counted))),
    }).drop("t", "wider", "w", "lines")
    # places of windows that another window equals, in order; only texts that have some pay for the sort
    df = df.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN array_sort(transform(h, (x, i) -> struct(x AS x, i AS i))) END")).drop("h")
    df = df.withColumn("p", F.expr("CASE WHEN s IS NOT NULL THEN array_sort(transform(filter(s, (e, j) -> coalesce(get(s, j - 1).x = e.x, false) OR coalesce(get(s, j + 1).x = e.x, false)), e -> e.i)) END")).drop("s")
    df = df.withColumn("n_repeat_words", F.expr("coalesce(aggregate(transform(p, (a, j) -> least(5, coalesce(get(p, j + 1) - a, 5))), 0L, (s, v) -> s + v), 0L)")).drop("p")
    return df.select("*", "short.seen", "short.times").drop("short")


def sums_of_languages(rows: DataFrame) -> DataFrame:
    """(l, docs, n, chars, hist, th, ts) of features that pass the base rules: sums of the documents' shares, in units, of characters and of all words."""
    own = f"({UNIT}L div chars)"
    hist = F.array(*[F.sum(F.expr(f"hist[{i}] * {own}")) for i in range(len(CLASSES) + 1)])
    sums = rows.where(f"NOT {FAILED}").groupBy("l").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), hist.alias("hist"), F.sum(F.expr(f"n * ({UNIT}L div n)")).alias("ts"))
    return sums.withColumn("th", F.expr("aggregate(hist, 0L, (s, v) -> s + v)"))


def references(rows: DataFrame, sums: DataFrame, *, common: int) -> DataFrame:
    """(l, docs, hist, th, ts, words, ws) for the languages of ``sums``: with the ``common`` short words of the largest shares, then by name.

    Each task keeps a language's first words before those meet.
    """
    mine = rows.where(f"NOT {FAILED}").join(small(sums.select("l")), "l", "left_semi")
    each = mine.select("l", F.expr(f"{UNIT}L div n").alias("v"), F.explode(F.arrays_zip("seen", "times")).alias("x"))
    shares = each.groupBy("l", F.col("x.seen").alias("word")).agg(F.sum(F.col("x.times") * F.col("v")).alias("s"))
    top = shares.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy(F.desc("s"), "word"))).where(F.col("r") <= common)
    lists = top.groupBy("l").agg(F.array_sort(F.collect_list(F.struct("r", "word", "s"))).alias("x")).select("l", F.col("x.word").alias("words"), F.col("x.s").alias("ws"))
    none = lambda kind: F.expr(f"cast(array() AS array<{kind}>)")
    return sums.join(lists, "l", "left").select("l", "docs", "hist", "th", "ts", F.coalesce("words", none("string")).alias("words"), F.coalesce("ws", none("bigint")).alias("ws"))


def _literal(r) -> str:
    numbers = lambda v: f"cast(array({', '.join(f'{int(x)}L' for x in v)}) AS array<bigint>)"
    words = ", ".join(f"'{_quoted(x)}'" for x in r["words"])
    return f"named_struct('l', '{_quoted(r['l'])}', 'hist', {numbers(r['hist'])}, 'th', {r['th']}L, 'ts', {r['ts']}L, 'words', cast(array({words}) AS array<string>), 'ws', {numbers(r['ws'])})"


def quality_rules(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    common: int = 16,
    letters: int = 4,
    far_chars: float = 0.25,
    far_words: float = 0.5,
    least_chars: int = 100,
    least_words: int = 40,
    least_docs: int = 20,
    reference_words: int = 2_000,
    reference_chars: int = 10_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance) of every row.

    n_repeat_words counts the words that lie in a five-word window found twice or more in the
    text. Null and word-less texts have zeros and fail the base rules; rows that fail them are
    not compared (distances null). Texts under ``least_chars`` characters or ``least_words``
    words pass the comparison by characters or words (distance null).

    A language gives a reference if its rows that pass the base rules are ``least_docs`` at
    least, with ``reference_words`` words and ``reference_chars`` characters; a null language
    counts as the empty one. A row is compared with the reference of its own language, less
    the row itself, and with those of languages of a hundredth or more of the passing rows. A
    row of a language without a reference is kept if it is near one of these large ones, or if
    its shares of letters, digits, separators and others differ by ``far_chars`` at most from
    those of all passing rows, less itself; char_distance is then that distance. Such a
    language decides nothing for others. With fewer than ``least_docs`` passing rows in all
    there is nothing to compare with, and rows pass.

    Equal rows get equal verdicts; null keys stay null. ``keep`` names further columns to
    carry; others are ignored. One row in, one row out, without a shuffle of texts. At most
    ``LARGE`` references reach the driver and the plan. A task holds one text's words and the
    hashes of its windows at a time, some sixty bytes a word on the heap.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    # one pass over the texts makes the features; the references are sums of them
    rows = scratch.save(features(docs, key=key, text=text, lang=lang, letters=letters, keep=keep), "features")
    sums = scratch.save(sums_of_languages(rows), "sums")
    pool = sums.agg(F.sum("docs").alias("docs"), F.array(*[F.sum(F.col("hist")[i]) for i in range(len(CLASSES) + 1)]).alias("hist")).first()
    enough = sums.where((F.col("docs") >= least_docs) & (F.col("n") >= reference_words) & (F.col("chars") >= reference_chars))
    refs = scratch.save(references(rows, enough, common=common), "references")
    large = F.col("docs") * LARGE >= (pool["docs"] or 0)
    majors = refs.where(large).orderBy("l").collect()
    minors = refs.where(~large).select(F.col("l").alias("minor"), F.struct("l", "hist", "th", "ts", "words", "ws").alias("own"))
    kind = "array<struct<l: string, hist: array<bigint>, th: bigint, ts: bigint, words: array<string>, ws: array<bigint>>>"
    refs_of = f"cast(array({', '.join(map(_literal, majors))}) AS {kind})"
    known = "l IN (" + ", ".join(f"'{_quoted(r['l'])}'" for r in majors) + ")" if majors else "false"
    if minors.limit(1).count():
        rows = rows.join(small(minors, SMALL_REFERENCES), F.col("l") == F.col("minor"), "left")
        refs_of, known = f"concat({refs_of}, CASE WHEN own IS NOT NULL THEN array(own) ELSE array() END)", f"({known} OR own IS NOT NULL)"

    u, v = f"({UNIT}L div chars)", f"({UNIT}L div n)"
    self = "cast(r.l = l AS bigint)"
    chars = f"zip_with(hist, r.hist, (a, b) -> struct(a / chars AS p, (b - {self} * a * {u}) / (r.th - {self} * chars * {u}) AS q))"
    counts = "transform(r.words, y -> cast(coalesce(get(times, cast(array_position(seen, y) AS int) - 1), 0) AS bigint))"
    words = f"zip_with({counts}, r.ws, (a, b) -> struct(a / n AS p, (b - {self} * a * {v}) / (r.ts - {self} * n * {v}) AS q))"
    rest = "array(struct(greatest(0D, 1D - aggregate(o, 0D, (s, z) -> s + z.p)) AS p, greatest(0D, 1D - aggregate(o, 0D, (s, z) -> s + z.q)) AS q))"
    near = f"struct(CASE WHEN chars >= {int(least_chars)} THEN {_distance(chars)} END AS cd, CASE WHEN n >= {int(least_words)} THEN {_let('o', words, _distance(f'concat(o, {rest})'))} END AS wd)"
    found = f"transform({refs_of}, r -> {near})"
    if (pool["docs"] or 0) >= least_docs:
        whole = [sum(pool["hist"][i] for i in group) for group in WIDE]
        own = [" + ".join(f"hist[{i}]" for i in group) for group in WIDE]
        pairs = "array(" + ", ".join(f"struct(({a}) / chars AS p, ({b}L - ({a}) * {u}) / ({sum(whole)}L - chars * {u}) AS q)" for a, b in zip(own, whole)) + ")"
        found = f"concat({found}, CASE WHEN {known} THEN array() ELSE array(struct(CASE WHEN chars >= {int(least_chars)} THEN {_distance(pairs)} END AS cd, cast(NULL AS double) AS wd)) END)"
    far = f"array_min(transform({found}, x -> struct(greatest(coalesce(x.wd / {far_words}D, 0D), coalesce(x.cd / {far_chars}D, 0D)) AS far, x.cd AS cd, x.wd AS wd)))"
    judged = rows.withColumn("best", F.expr(f"CASE WHEN NOT {FAILED} THEN {far} END"))
    failed = F.expr(FAILED)
    return judged.select(
        F.col("_k").alias(key), *[F.col(f"_keep_{c}").alias(c) for c in keep],
        F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.coalesce(F.col("best.far"), F.lit(0.0)) <= 1.0)).alias("kept"),
        F.col("best.cd").alias("char_distance"), F.col("best.wd").alias("word_distance"),
    )


def _quoted(x: str) -> str:
    return x.replace("\\", "\\\\").replace("'", "\\'")


def oracle(documents: str = "documents") -> str:
    """The same rows in DuckDB SQL, with the defaults."""
    count = lambda p: "len(regexp_extract_all(t, '" + p.replace("'", "''") + "'))"
    ascii_marks = r"""[!"#%&'()*,\-./:;?@\[\\\]_{}]"""  # what of the class of punctuation is ASCII
    hist = ", ".join(f"{count(chr(92) + 'p{P}')} - {count(ascii_marks)}" if c == "mark" else count(p) for c, p in CLASSES.items())
    term = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / (z[1] + z[2])) ELSE 0 END"
    distance = lambda pairs: f"sqrt(greatest(0, 0.5 * list_sum(list_transform({pairs}, lambda z: {term('z[1]')} + {term('z[2]')}))))"
    u, v, every = f"({UNIT} // chars)", f"({UNIT} // n)", range(1, len(CLASSES) + 2)
    wide = lambda h: "[" + ", ".join("+".join(f"{h}[{i + 1}]" for i in g) for g in WIDE) + "]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS l, coalesce(text, '') AS t, row_number() OVER () AS rid FROM {documents}),
f AS (SELECT doc_id, l, rid, length(t) AS chars, regexp_extract_all(t, '{WORD}') AS w, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines, [{hist}] AS seven FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM f WHERE len(w) >= 5),
y AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i + 4], ' ')) AS k FROM g),
a AS (SELECT f.*, list_append(seven, chars - list_sum(seven)) AS hist, len(w) AS n, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM f
  LEFT JOIN (SELECT rid, sum(own) AS n_repeat_words FROM (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS own FROM y WHERE k > 1) GROUP BY rid) USING (rid)),
b AS (SELECT *, n < 10 OR 100 * n_repeat_words > 20 * n AS failed FROM a),
p AS (SELECT * FROM b WHERE NOT failed),
x AS (SELECT rid, l, n, word, count(*) AS k FROM (SELECT rid, l, n, lower(unnest(list_filter(w, lambda z: length(z) <= 4))) AS word FROM p) GROUP BY ALL),
s AS (SELECT l, count(*) AS docs, sum(n) AS n, sum(chars) AS chars, [{", ".join(f"sum(hist[{i}] * {u})" for i in every)}]::BIGINT[] AS hist, sum(n * {v})::BIGINT AS ts FROM p GROUP BY l),
e AS (SELECT *, list_sum(hist)::BIGINT AS th, docs * {LARGE} >= (SELECT sum(docs) FROM s) AS large FROM s WHERE docs >= 20 AND n >= 2000 AND chars >= 10000),
o AS (SELECT l, word, sum(k * {v})::BIGINT AS ws FROM x JOIN (SELECT l FROM e) USING (l) GROUP BY l, word QUALIFY row_number() OVER (PARTITION BY l ORDER BY sum(k * {v}) DESC, word) <= 16),
q AS (SELECT e.l, large, hist, th, ts, coalesce(list(word ORDER BY ws DESC, word) FILTER (word IS NOT NULL), []) AS words, coalesce(list(ws ORDER BY ws DESC, word) FILTER (word IS NOT NULL), []) AS ws FROM e LEFT JOIN o USING (l) GROUP BY ALL),
m AS (SELECT rid, map_from_entries(list((word, k))) AS times FROM x GROUP BY rid),
j AS (SELECT rid, n, chars, list_transform(list_zip(p.hist, q.hist), lambda z: [z[1] / chars::DOUBLE, (z[2] - (p.l = q.l)::BIGINT * z[1] * {u}) / (th - (p.l = q.l)::BIGINT * chars * {u})::DOUBLE]) AS cs,
  list_transform(list_zip(list_transform(words, lambda z: coalesce(times[z], 0)), ws), lambda z: [z[1] / n::DOUBLE, (z[2] - (p.l = q.l)::BIGINT * z[1] * {v}) / (ts - (p.l = q.l)::BIGINT * n * {v})::DOUBLE]) AS os
  FROM p JOIN q ON q.large OR q.l = p.l LEFT JOIN m USING (rid)),
r AS (SELECT rid, CASE WHEN chars >= 100 THEN {distance("cs")} END AS cd,
  CASE WHEN n >= 40 THEN {distance("list_append(os, [greatest(0, 1 - coalesce(list_sum(list_transform(os, lambda z: z[1])), 0)), greatest(0, 1 - coalesce(list_sum(list_transform(os, lambda z: z[2])), 0))])")} END AS wd FROM j),
t AS (SELECT sum(docs) AS docs, [{", ".join(f"sum(hist[{i}])" for i in every)}]::BIGINT[] AS whole FROM s),
i AS (SELECT rid, chars, list_transform(list_zip({wide("hist")}, {wide("whole")}), lambda z: [z[1] / chars::DOUBLE, (z[2] - z[1] * {u}) / (list_sum(whole) - chars * {u})::DOUBLE]) AS cs FROM p, t WHERE t.docs >= 20 AND l NOT IN (SELECT l FROM e)),
k AS (SELECT rid, cd, wd FROM r UNION ALL SELECT rid, CASE WHEN chars >= 100 THEN {distance("cs")} END, NULL FROM i),
z AS (SELECT rid, min((greatest(coalesce(wd / 0.5, 0), coalesce(cd / 0.25, 0)), cd, wd)) AS best FROM k GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
  failed AS base_failed, NOT failed AND coalesce(best[1] <= 1, true) AS kept, best[2] AS char_distance, best[3] AS word_distance FROM b LEFT JOIN z USING (rid)"""

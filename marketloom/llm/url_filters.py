"""URL filters: rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a regular expression over ``host/path`` with the literal tokens that every URL it
matches must hold whole. Token counts over all URLs give the rarest token of each rule; a
URL's tokens fetch the rules under them, and only those run their expression. The index is a
hashed table in the plan: fetching is one step a token, and no row is shuffled.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"
#: Most index tokens that stand in the plan as a literal; beyond them the index is joined.
LITERAL_TOKENS = 4096


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    weight: int


def domain_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: the host and its subdomains, paths that start with the path. The longest rule wins."""
    host, slash, path = rule.partition("/")
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}" + ("" if slash else r"(?:/|$)")
    # the path's last token may go on in the URL, unless something in the rule ends it
    whole = re.findall(TOKEN, host) + re.findall(TOKEN + r"(?=[^A-Za-z0-9])", re.sub(r"[A-Z]", "*", slash + path))
    return Rule(rule, verdict, regex, tuple(dict.fromkeys(whole)), 1_000_000 + len(rule))


def pattern_rule(verdict: str, name: str, regex: str, tokens: tuple[str, ...]) -> Rule:
    """A regular expression over ``host/path`` with tokens that its matches hold whole; it yields to domain rules."""
    return Rule(name, verdict, regex, tokens, len(name))


#: The domain rules of the query.
DOMAIN_RULES = (
    domain_rule("block", "com/en/"), domain_rule("allow", "example.com/en/7"), domain_rule("allow", "net/de/"),
    domain_rule("block", "example.net/de/8"), domain_rule("block", "org/es/"),
)
#: Unwanted kinds of sites and pages, for URLs that no domain rule fits: name, where, words that stand side by side.
_UNWANTED = """
spam-farm | host start | spam farm
cheap-pills | host start | cheap pills
link-farm | anywhere | link farm
link-exchange | anywhere | link exchange
buy-links | anywhere | buy backlinks
online-pharmacy | anywhere | online pharmacy
no-prescription | anywhere | no prescription
buy-viagra | anywhere | buy viagra
buy-cialis | anywhere | buy cialis
diet-pills | anywhere | diet pills
weight-loss-pills | anywhere | weight loss pills
online-casino | anywhere | online casino
free-slots | anywhere | free slots
sports-betting | anywhere | sports betting
poker-bonus | anywhere | poker bonus
payday-loans | anywhere | payday loans
quick-cash | anywhere | quick cash loans
debt-relief | anywhere | debt relief offer
replica-watches | anywhere | replica watches
fake-id | anywhere | fake id
essay-writing | anywhere | essay writing service
adult-chat | anywhere | adult chat
sex-cams | anywhere | sex cams
porn-videos | anywhere | porn videos
escort-service | anywhere | escort service
xxx | host | xxx
warez | anywhere | warez
keygen | path | keygen
crack-download | anywhere | crack download
free-mp3 | anywhere | free mp3 download
torrent-download | anywhere | torrent download
malware-sample | anywhere | malware
phishing | anywhere | phishing
miracle-cure | anywhere | miracle cure
bitcoin-doubler | anywhere | bitcoin doubler
earn-money-fast | anywhere | earn money fast
work-from-home | anywhere | work from home offer
click-tracker | path | click track
ad-server | host start | adserver
doorway | path | doorway
session-trap | path | phpsessid
"""


def _side_by_side(name: str, where: str, words: tuple[str, ...]) -> Rule:
    """Words with one sign other than a slash between them, whole: nothing of a word goes on before or after."""
    middle = "[^A-Za-z0-9/]".join(map(re.escape, words))
    lead = {"host start": r"^(?:[^/]*[^A-Za-z0-9/])?", "host": r"^(?:[^/]*[^A-Za-z0-9/])?", "path": r"(?s)/(?:.*[^A-Za-z0-9])?", "anywhere": r"(?:^|[^A-Za-z0-9])"}[where]
    end = r"[^A-Za-z0-9/]" if where == "host start" else r"(?:[^A-Za-z0-9]|\z)"
    return pattern_rule("block", name, lead + middle + end, words)


PATTERN_RULES = tuple(_side_by_side(n, w, tuple(t.split())) for n, w, t in ([x.strip() for x in line.split("|")] for line in _UNWANTED.strip().splitlines()))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where the URL is null or has no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: runs of a-z and 0-9 (capitals end a run, as they match no literal)."""
    return F.array_distinct(F.regexp_extract_all(F.concat(host, path), F.lit(r"(?<![A-Za-z0-9])[a-z0-9]+(?![A-Za-z0-9])"), F.lit(0)))


def _lookup(table: dict[str, list[Column]], kind: str, token: Column) -> Column:
    """The entries of a token in a hashed table that stands in the plan as a literal; ``kind`` is an entry's type, whose field token is the key."""
    n = 1 << max(1, 2 * len(table) - 1).bit_length()
    buckets: list[list[Column]] = [[] for _ in range(n)]
    for t, entries in table.items():
        buckets[zlib.crc32(t.encode()) % n] += entries
    held = F.array(*[F.array(*b).cast(f"array<{kind}>") if b else F.array().cast(f"array<{kind}>") for b in buckets])
    return F.filter(F.get(held, (F.crc32(token.cast("binary")) % n).cast("int")), lambda e: e["token"] == token)


_ENTRY = "struct<token: string, name: string, verdict: string, regex: string, weight: int>"


def rarest(rules: tuple[Rule, ...], tokens: DataFrame) -> dict[str, str]:
    """rule name -> its token that the fewest URLs hold, ties by the token. The counts of the rules' tokens, no others, reach the driver."""
    wanted = {t for r in rules for t in r.tokens}
    if len(wanted) <= LITERAL_TOKENS:
        known = {t: [F.struct(F.lit(t).alias("token"))] for t in sorted(wanted)}
        mine = F.filter("tokens", lambda t: F.size(_lookup(known, "struct<token: string>", t)) > 0)
        counts = tokens.select(F.explode(mine).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    else:
        table = tokens.sparkSession.createDataFrame([(t,) for t in sorted(wanted)], "token string")
        counts = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(table, "token", "left_semi")
    n = {r["token"]: r["n"] for r in counts.collect()} if wanted else {}
    return {r.name: min(r.tokens, key=lambda t: (n.get(t, 0), t)) for r in rules if r.tokens}


def filter_urls(
    pages: DataFrame, *, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = (*DOMAIN_RULES, *PATTERN_RULES), default: str = "allow"
) -> DataFrame:
    """(key, host, path, rule, verdict) of every row.

    The heaviest rule that fits decides: domain rules before patterns, longer before shorter,
    then by name. rule is the domain rule's name; it is null where none fits, and the verdict is then
    that of a fitting pattern, or ``default``. Null URLs and URLs without ``://`` have an empty
    host and path and the default verdict. Equal rows are judged alike and all come back; null
    keys stay null; other columns are ignored; an empty table gives an empty result. Up to
    ``LITERAL_TOKENS`` index tokens the rows pass in one go, without a shuffle; beyond them
    URLs meet the rules by token in a join.
    """
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("rules must have names of their own")
    host, path = split_url(F.col(url))
    by_token: dict[str, list[Rule]] = {}
    first = rarest(rules, pages.select(_tokens(*split_url(F.col(url))).alias("tokens")))
    for r in rules:
        if r.tokens:
            by_token.setdefault(first[r.name], []).append(r)
    rows = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    hit = lambda r: F.struct(F.lit(r.weight).alias("weight"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
    if len(by_token) <= LITERAL_TOKENS:
        entry = lambda t, r: F.struct(F.lit(t).alias("token"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.weight).alias("weight"))
        table = {t: [entry(t, r) for r in rs] for t, rs in sorted(by_token.items())}
        found = F.flatten(F.transform(_tokens(F.col("host"), F.col("path")), lambda t: _lookup(table, _ENTRY, t)))
        fits = F.filter(found, lambda e: F.rlike(F.concat("host", "path"), e["regex"]))
        best = rows.withColumn("hit", F.array_max(F.transform(fits, lambda e: F.struct(e["weight"].alias("weight"), e["name"].alias("name"), e["verdict"].alias("verdict")))))
    else:
        table = pages.sparkSession.createDataFrame([(t, r.name, r.verdict, r.regex, r.weight) for t, rs in by_token.items() for r in rs], "_token string, name string, verdict string, regex string, weight int")
        # one row of a URL a token, so that a frequent token's URLs meet its rules in many tasks
        urls = rows.select("host", "path").distinct().withColumn("token", F.explode(_tokens(F.col("host"), F.col("path"))))
        met = urls.join(table, F.col("token") == F.col("_token")).where(F.expr("concat(host, path) rlike regex"))
        hits = met.groupBy("host", "path").agg(F.max(F.struct("weight", "name", "verdict")).alias("hit"))
        best = rows.join(hits, ["host", "path"], "left")
    choice = F.col("hit")
    for r in rules:
        if not r.tokens:
            choice = F.greatest(choice, F.when(F.concat("host", "path").rlike(r.regex), hit(r)))
    best = best.withColumn("hit", choice)
    return best.select(
        F.col("_key").alias(key), "host", "path",
        F.when(F.col("hit.weight") >= 1_000_000, F.col("hit.name")).alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )


#: Most rules without a token: each runs on every URL.
TOKENLESS = 64


def domain_rule_table(rules: DataFrame, *, rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """(name, verdict, regex, tokens, weight) of a table of domain rules ``host/path``, as ``domain_rule`` makes them; nulls and repeated rules are left out, of a rule with both verdicts allow stays."""
    df = rules.where(F.col(rule).isNotNull()).groupBy(F.col(rule).alias("name")).agg(F.min(verdict).alias("verdict"))
    host, path = F.substring_index("name", "/", 1), F.expr("substr(name, length(substring_index(name, '/', 1)) + 1)")
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    regex = F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted(host), F.when(path == "", F.lit(r"(?:/|$)")).otherwise(quoted(path)))
    closed = F.regexp_extract_all(F.regexp_replace(path, "[A-Z]", "*"), F.lit(TOKEN + "(?=[^A-Za-z0-9])"), F.lit(0))
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(host, F.lit(TOKEN), F.lit(0)), closed))
    return df.select("name", "verdict", regex.alias("regex"), tokens.alias("tokens"), (F.length("name") + 1_000_000).alias("weight"))


def filter_urls_by_table(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``filter_urls`` with rules of a table (name, verdict, regex, tokens, weight), however many: nothing of them reaches the driver or the plan.

    Token counts over all URLs, each rule's rarest token and the index are tables; distinct
    URLs meet the index by token, one row a token, and only these pairs run an expression.
    Rules without a token, ``TOKENLESS`` at most, are run on every distinct URL. Names are
    unique; a null regex fits nothing.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    rules = rules.where("regex IS NOT NULL").select("name", "verdict", "regex", "weight", F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"))
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("copies")).withColumn("tokens", _tokens(F.col("host"), F.col("path")))
    each = urls.select("host", "path", "copies", F.explode("tokens").alias("token"))
    wanted = rules.select("name", F.explode("tokens").alias("token"))
    counts = each.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("copies").alias("n"))
    rarest_ = wanted.join(counts, "token", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("rarest"))
    # a token that no URL holds fetches nothing
    index = rarest_.join(rules.drop("tokens"), "name")
    met = each.join(index, F.col("token") == F.col("rarest")).where(F.expr("concat(host, path) rlike regex")).select("host", "path", "weight", "name", "verdict")
    loose = rules.where("size(tokens) = 0").drop("tokens")
    n = loose.limit(TOKENLESS + 1).count()
    if n > TOKENLESS:
        raise ValueError(f"more than {TOKENLESS} rules have no literal token; each would run on every URL")
    if n:
        every = loose.agg(F.collect_list(F.struct("weight", "name", "verdict", "regex")).alias("rules")).first()["rules"]
        held = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("weight", "name", "verdict", "regex")]) for r in every])
        fits = F.filter(held, lambda r: F.rlike(F.concat("host", "path"), r["regex"]))
        met = met.unionByName(urls.select("host", "path", F.explode(fits).alias("r")).select("host", "path", "r.weight", "r.name", "r.verdict"))
    best = met.groupBy("host", "path").agg(F.max(F.struct("weight", "name", "verdict")).alias("hit"))
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select(
        F.col("_key").alias(key), "host", "path", F.when(F.col("hit.weight") >= 1_000_000, F.col("hit.name")).alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )


def oracle(pages: str = "pages") -> str:
    """The same rows in DuckDB SQL, with the default rules."""
    return rf"""
WITH r(rule, rhost, rpath, v) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {pages}),
p AS (SELECT page_id, rid, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM p JOIN r
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.v, CASE WHEN regexp_matches(host || path, '(?s){"|".join(f"(?:{r.regex})" for r in PATTERN_RULES)}') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (rid)"""

"""Scalar expressions: costs, liquidity, adjustment, dates, text."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def commission(quantity, price, per_share=0.0049, least=0.99, max_rate=0.01) -> Column:
    """min(max(q * per share, least), q * p * max rate); none without quantity or price."""
    q, p = _c(quantity).cast("double"), _c(price)
    return F.when((q <= 0) | (p <= 0), 0.0).otherwise(F.least(F.greatest(q * per_share, F.lit(float(least))), q * p * max_rate))


def slippage_rate(quantity, average_volume, perc=0.0, impact=0.0) -> Column:
    """perc + impact * participation^2; participation is 0 without volume."""
    part = F.when(_c(average_volume) > 0, _c(quantity) / _c(average_volume)).otherwise(0.0)
    return perc + impact * part * part


def fill_price(price, quantity, average_volume, side, perc=0.0, impact=0.0) -> Column:
    rate = slippage_rate(quantity, average_volume, perc, impact)
    return F.when(_c(side) == "buy", _c(price) * (1 + rate)).otherwise(_c(price) * (1 - rate))


def liquidity_cap(quantity, average_volume, pct=0.0, require_history=False) -> Column:
    """The whole quantity (without its sign) that the participation cap allows; without a cap all of it.

    Without history that is all too, or none if history is required.
    """
    asked = F.abs(_c(quantity).cast("long"))
    if pct <= 0:
        return asked
    cap = F.greatest(F.lit(0), F.least(asked, F.floor(_c(average_volume) * pct)))
    return F.when(_c(average_volume).isNull(), F.lit(0) if require_history else asked).otherwise(cap).cast("long")


def adjust_ratio(close="close", adjusted="adjusted_close") -> Column:
    """adjusted / raw close; 0 where the raw close is 0 or missing."""
    return F.when(_c(close).isNotNull() & (_c(close) != 0) & _c(adjusted).isNotNull(), _c(adjusted) / _c(close)).otherwise(0.0)


def price_with_fallback(*columns) -> Column:
    return F.coalesce(*[_c(c) for c in columns])


#: USD for a million prompt and completion tokens; the first name found in the model's decides.
TOKEN_PRICES = (("gpt-4o-mini", 0.15, 0.6), ("gpt-4o", 2.5, 10.0))


def token_cost(model, prompt, completion) -> Column:
    out = F.lit(0.0)
    for name, a, b in reversed(TOKEN_PRICES):
        out = F.when(_c(model).contains(name), (_c(prompt) * a + _c(completion) * b) / 1e6).otherwise(out)
    return out


def next_session(ts, close_hour: int = 16) -> Column:
    """The date a text can be traded on: after the close it is the next day."""
    return F.date_add(F.to_date(_c(ts)), (F.hour(_c(ts)) >= close_hour).cast("int"))


def third_weekday(date="date") -> Column:
    d = _c(date)
    days = F.filter(F.sequence(F.trunc(d, "MM"), d), lambda x: F.weekday(x) < 5)
    return (F.size(days) == 3) & (F.weekday(d) < 5)


def month_ends_within(date="date", days: int = 5) -> Column:
    return F.month(F.date_add(_c(date), days)) != F.month(_c(date))


def business_days(first, last) -> Column:
    return F.filter(F.sequence(_c(first), _c(last)), lambda x: F.weekday(x) < 5)


def clean_news(text) -> Column:
    """Line breaks and tabs become spaces; null becomes empty."""
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\n\r\t]", " ")


def update_number(headline) -> Column:
    """n of a leading ``UPDATE n-``, else null."""
    n = F.regexp_extract(_c(headline), r"^UPDATE (\d+)-", 1)
    return F.when(n != "", n.cast("int"))


def strip_update(headline) -> Column:
    return F.regexp_replace(_c(headline), r"^UPDATE \d+-", "")


def after_agency(text, marker: str = "(Reuters)") -> Column:
    at = F.instr(_c(text), marker)
    return F.when(at > 0, F.substring(_c(text), at + len(marker), F.length(_c(text)))).otherwise(_c(text))


def dedup_key(text) -> Column:
    return F.regexp_replace(_c(text), " ", "")


#: Letters whose accents are dropped where text is folded to ASCII, and what they become.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_FOLDED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def ascii_fold(text) -> Column:
    """Accents dropped, other characters beyond ASCII removed."""
    out = F.replace(F.replace(F.replace(_c(text), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("o"))
    return F.regexp_replace(F.translate(out, _ACCENTED, _FOLDED), r"[^\x00-\x7f]", "")


def scrub(text) -> Column:
    """Folded to lower-case ASCII, without URLs, e-mail addresses and phone numbers."""
    out = F.lower(ascii_fold(text))
    for pattern in (r"https?://\S+|www\.\S+", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", r"\+?\d[\d() -]{7,}\d"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        met = row & where.get(x, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def likeness(a, b) -> Column:
    """2 x longest common subsequence / both lengths, from 0 to 1; two empty texts are alike. Arrow batches, as SQL has no such distance."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        one = lambda p, q: None if p is None or q is None else 2 * common_length(p, q) / (len(p) + len(q)) if p or q else 1.0
        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype="float64")

    return ratio(_c(a), _c(b))


def move_text(x) -> Column:
    """A relative move in words."""
    pct = F.format_string("%.2f%%", F.abs(_c(x) * 100))
    return F.when(_c(x) > 0, F.concat(F.lit("an increase of "), pct)).when(_c(x) < 0, F.concat(F.lit("a decrease of "), pct)).when(_c(x) == 0, "no change").otherwise("unknown")


def file_name(x) -> Column:
    """A text as part of a path: separators and colons become underscores."""
    return F.translate(_c(x), "/\\:", "___")


def resolve_parameters(template: dict, values: dict) -> dict:
    """Parameters with ``$name`` texts replaced by the named values; an unknown name is an error."""
    out = {}
    for k, v in (template or {}).items():
        if isinstance(v, str) and v.startswith("$"):
            if v[1:] not in values:
                raise KeyError(f"no value for {v}")
            v = values[v[1:]]
        out[k] = v
    return out


def from_unix(seconds, zone: str = "UTC") -> Column:
    """The local time in ``zone`` of seconds since 1970."""
    return F.from_utc_timestamp(F.timestamp_seconds(_c(seconds)), zone)


def to_unix(ts, zone: str = "UTC") -> Column:
    return F.unix_timestamp(F.to_utc_timestamp(_c(ts), zone))


#: Names of bar intervals, in seconds.
INTERVALS = {"1m": 60, "2m": 120, "5m": 300, "15m": 900, "30m": 1800, "60m": 3600, "90m": 5400, "1h": 3600, "1d": 86400, "5d": 432000, "1wk": 604800, "1D": 86400, "1Min": 60}


def interval_seconds(name: str) -> int:
    if name not in INTERVALS:
        raise ValueError(f"unknown interval {name!r}")
    return INTERVALS[name]


def years_before(date, years: int, calendar: bool = True) -> Column:
    """The date that many years earlier, by calendar or as 365 days each."""
    return F.add_months(_c(date), -12 * years) if calendar else F.date_sub(_c(date), 365 * years)


def item_code(text) -> Column:
    """The code of a line that begins with an item's heading, in capitals, else null."""
    code = F.regexp_extract(F.trim(_c(text)), r"(?i)^items?\s*\.?\s*(\d{1,2}[a-z]?)\b", 1)
    return F.when(code != "", F.upper(code))


def part_name(text) -> Column:
    part = F.regexp_extract(F.trim(_c(text)), r"(?i)^part\s*([ivx]+)\b", 1)
    return F.when(part != "", F.concat(F.lit("Part "), F.upper(part)))


def softmax(values) -> Column:
    """Of an array, its exponentials over their sum."""
    e = F.transform(_c(values), lambda x: F.exp(x - F.array_max(_c(values))))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def place_of(values, best=F.array_max) -> Column:
    """The place (from 0) of the first largest value of an array, or with ``array_min`` of the first smallest."""
    return F.array_position(_c(values), best(_c(values))) - 1


def whole_shares(cash, price, share: float = 1.0) -> Column:
    """Whole shares that a share of the cash pays for; none without a price."""
    return F.when(_c(price) > 0, F.floor(_c(cash) * share / _c(price))).otherwise(0).cast("long")


def remainder_factor(fee: float, before, weights, steps: int = 50) -> Column:
    """The share of a portfolio's value left after a change of weights (arrays, cash first) at a proportional fee: a fixed point, ``steps`` times."""
    w, b = _c(weights), _c(before)
    rest = F.slice(F.zip_with(b, w, lambda x, y: F.struct(x.alias("b"), y.alias("w"))), 2, F.size(w) - 1)
    cash = F.get(w, F.lit(0))

    def turn(mu, _):
        sales = F.aggregate(rest, F.lit(0.0), lambda s, p: s + F.greatest(p["b"] - mu * p["w"], F.lit(0.0)))
        return (1 - fee * cash - (2 * fee - fee**2) * sales) / (1 - fee * cash)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(1 - 2 * fee + fee**2), turn)


def only_tickers(prices, tickers) -> Column:
    """A map of prices by ticker with those of an array of tickers."""
    return F.map_filter(_c(prices), lambda k, _: F.array_contains(_c(tickers), k))


def merged(*maps) -> Column:
    """Maps as one; of a key that several have the last one's value."""
    def over(early: Column, late: Column) -> Column:
        return F.map_concat(F.map_filter(early, lambda k, _: ~F.map_contains_key(late, k)), late)

    return reduce(over, map(_c, maps))


#: The entities and typographic characters that are replaced.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


#: Invisible characters, and typographic ones with what they become.
INVISIBLE = "\u200b\u200c\u200d\ufeff"
TYPOGRAPHIC = ("\u00a0\u2018\u2019\u201c\u201d\u2013\u2014", " ''\"\"--")


def normalise(text) -> Column:
    """Entities, zero-width and no-break spaces, curly quotes and dashes to plain characters; white space collapsed."""
    out = _c(text)
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(F.regexp_replace(out, f"[{INVISIBLE}]", ""), *TYPOGRAPHIC)
    return F.trim(F.regexp_replace(out, "[ \\t\\n\\r\\f]+", " "))


def unescaped(text) -> Column:
    """All of HTML's named and numbered entities as characters; Arrow batches, as SQL has no table of them."""
    import html

    @F.pandas_udf("string")
    def decode(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t if t is None else html.unescape(t))

    return F.when(F.contains(_c(text), F.lit("&")), decode(_c(text))).otherwise(_c(text))


def strip_tags(html) -> Column:
    return normalise(F.regexp_replace(F.regexp_replace(_c(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " "))


def preview(text, n: int = 200) -> Column:
    return F.when(F.length(_c(text)) > n, F.concat(F.substring(_c(text), 1, n), F.lit("..."))).otherwise(_c(text))

"""A compiler of indicator names: ``close_30_sma``, ``rsi_30``, ``boll_ub``, ``macd_9_ema``, ``close_5_sma_x_close_20_sma``, ``ADX(14)``.

Names are parsed to a graph whose equal parts are one node, and the graph is compiled to
window columns level by level. All windows are over one partition and order with frames of
rows, so that whatever the number of names Spark sorts each series once. Recursive averages
are sums of shifted columns that double their reach (a value, then two, four, ...), until
what is older weighs less than a double can hold.

Grammar, with ``x`` any name or column: ``x_n_op`` for the windows of ``OPS`` (sma, ema, smma,
wma, mstd, mvar, max, min, sum, roc, d, s), ``x_xu_y`` / ``x_xd_y`` / ``x_x_y`` for crossings up,
down and either way, ``name`` or ``name_n`` or ``name_n,m`` for ``RECIPES``, and their names in
capitals with arguments in brackets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A node of a graph; arithmetic makes plain nodes, the methods windows over the series up to a row."""

    graph: Graph
    id: int

    def _plain(self, op: str, make: Callable[..., Column], *others) -> Node:
        return self.graph.plain(op, make, self, *others)

    def __add__(self, y): return self._plain("+", lambda a, b: a + b, y)  # noqa: E704
    def __radd__(self, y): return self._plain("+r", lambda a, b: b + a, y)  # noqa: E704
    def __sub__(self, y): return self._plain("-", lambda a, b: a - b, y)  # noqa: E704
    def __rsub__(self, y): return self._plain("-r", lambda a, b: b - a, y)  # noqa: E704
    def __mul__(self, y): return self._plain("*", lambda a, b: a * b, y)  # noqa: E704
    def __rmul__(self, y): return self._plain("*r", lambda a, b: b * a, y)  # noqa: E704
    def __truediv__(self, y): return self._plain("/", lambda a, b: F.when(b != 0, a / b), y)  # noqa: E704
    def __rtruediv__(self, y): return self._plain("/r", lambda a, b: F.when(a != 0, b / a), y)  # noqa: E704
    def __neg__(self): return self._plain("neg", lambda a: -a)  # noqa: E704
    def abs(self): return self._plain("abs", F.abs)  # noqa: E704
    def sqrt(self): return self._plain("sqrt", F.sqrt)  # noqa: E704
    def gt(self, y): return self._plain(">", lambda a, b: a > b, y)  # noqa: E704
    def most(self, y): return self._plain("most", F.greatest, y)  # noqa: E704
    def least(self, y): return self._plain("least", F.least, y)  # noqa: E704
    def or_(self, y): return self._plain("or", F.coalesce, y)  # noqa: E704

    def where(self, condition: Node, other=None) -> Node:
        """This value where the condition holds, else the other (null: else)."""
        return self._plain("where", lambda a, c, b=None: F.when(c, a).otherwise(F.lit(None) if b is None else b), condition, *([] if other is None else [other]))

    def lag(self, k: int = 1) -> Node:
        return self.graph.window(f"lag {k}", lambda w, a: F.lag(a, k).over(w), self) if k else self

    def over(self, how: str, n: int | None = None, *others: Node, least: int | None = None) -> Node:
        """An aggregate of the last n rows, null until ``least`` (n) of them have a value; of all rows so far without n."""
        fn = AGGREGATES[how]
        if n is None:
            return self.graph.window(f"{how} all", lambda w, *a: fn(*a).over(w.rowsBetween(W.unboundedPreceding, 0)), self, *others)
        if n < 1:
            raise ValueError(f"a window of {n} rows")

        def make(w, *a):
            frame = w.rowsBetween(-(n - 1), 0)
            return F.when(F.count(a[0]).over(frame) >= (n if least is None else least), fn(*a).over(frame))

        return self.graph.window(f"{how} {n} {least}", make, self, *others)

    def sma(self, n: int) -> Node:
        return self.over("avg", n)

    def average(self, alpha: float, first: int = 1) -> Node:
        """The average that moves by ``alpha`` towards each value, from the mean of the ``first`` ones; null before, a gap repeats the last value."""
        keep = 1 - alpha
        seen, held = self.over("count"), self.over("last")
        seed = held.over("avg", first) if first > 1 else held
        total = self.graph.plain(f"seeded {alpha} {first}", lambda x, n, s: F.when(n < first, 0.0).when(n == first, s).otherwise(alpha * x), held, seen, seed)
        reach = 1
        while keep > 0 and reach * -math.log(keep) < 45:
            weight = keep**reach
            total = total + total.lag(reach).or_(0.0) * weight
            reach *= 2
        return total.where(seen.gt(first - 1))

    def ema(self, n: int) -> Node:
        return self.average(2 / (n + 1))

    def wilder(self, n: int, first: int = 1) -> Node:
        return self.average(1 / n, first)


AGGREGATES: dict[str, Callable[..., Column]] = {
    "avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda a: F.last(a, True), "std": F.stddev_pop, "sample": F.stddev_samp, "var": F.var_samp,
    "corr": F.corr, "list": F.collect_list, "slope": F.regr_slope, "intercept": F.regr_intercept,
}


class Graph:
    """Nodes of the columns of a table, each part once."""

    def __init__(self, columns: list[str], by: str = "symbol", at: str = "date"):
        self.by, self.at = by, at
        self.nodes: list[tuple[str, Callable, tuple, int, bool]] = []  # key, make, arguments, level, is a window
        self.known: dict[tuple, int] = {}
        self.columns = {c: self._add(("column", c), lambda c=c: F.col(c), (), 0, False) for c in columns}

    def _add(self, key: tuple, make: Callable, arguments: tuple, level: int, is_window: bool) -> Node:
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append((key[0], make, arguments, level, is_window))
        return Node(self, self.known[key])

    def level(self, x) -> int:
        return self.nodes[x.id][3] if isinstance(x, Node) else 0

    def plain(self, op: str, make: Callable, *arguments) -> Node:
        key = (op, *[("node", x.id) if isinstance(x, Node) else ("value", x) for x in arguments])
        return self._add(key, make, arguments, max(map(self.level, arguments), default=0), False)

    def window(self, op: str, make: Callable, *arguments: Node) -> Node:
        return self._add((f"over {op}", *[x.id for x in arguments]), make, arguments, 1 + max(map(self.level, arguments), default=0), True)

    def column(self, x) -> Column:
        """A node as an expression over the columns of levels that are done."""
        if not isinstance(x, Node):
            return F.lit(x)
        _, make, arguments, _, is_window = self.nodes[x.id]
        return F.col(f"_n{x.id}") if is_window else make(*[self.column(a) for a in arguments])

    def compiled(self, df: DataFrame, outputs: dict[str, Node]) -> DataFrame:
        """``df`` with the outputs: a projection a level, all of them over one sort."""
        needed: set[int] = set()
        waiting = [n.id for n in outputs.values()]
        while waiting:
            i = waiting.pop()
            if i not in needed:
                needed.add(i)
                waiting += [a.id for a in self.nodes[i][2] if isinstance(a, Node)]
        w = W.partitionBy(self.by).orderBy(self.at)
        kept = df.columns
        for level in range(1, 1 + max((self.nodes[i][3] for i in needed), default=0)):
            own = [i for i in sorted(needed) if self.nodes[i][4] and self.nodes[i][3] == level]
            # columns that no later level reads are left behind
            later = {a.id for i in needed if self.nodes[i][3] >= level for a in self._sources(i)} | {a.id for n in outputs.values() for a in self._sources(n.id, True)}
            held = [f"_n{i}" for i in sorted(later) if f"_n{i}" in df.columns]
            df = df.select(*kept, *held, *[self.nodes[i][1](w, *[self.column(a) for a in self.nodes[i][2]]).alias(f"_n{i}") for i in own])
        return df.select(*[c for c in kept if c not in outputs], *[self.column(n).alias(name) for name, n in outputs.items()])

    def _sources(self, i: int, itself: bool = False) -> list[Node]:
        """The windows that a node reads through plain ones."""
        out, waiting, seen = [], [Node(self, i)] if itself else [a for a in self.nodes[i][2] if isinstance(a, Node)], set()
        while waiting:
            x = waiting.pop()
            if x.id in seen:
                continue
            seen.add(x.id)
            if self.nodes[x.id][4]:
                out.append(x)
            else:
                waiting += [a for a in self.nodes[x.id][2] if isinstance(a, Node)]
        return out

    # ---- names

    def parsed(self, name: str) -> Node:
        """The node of a name."""
        if name in self.columns:
            return self.columns[name]
        for mark, way in (("_xu_", 1), ("_xd_", -1), ("_x_", 0)):
            left, found, right = name.rpartition(mark)
            if found:
                return crossed(self.parsed(left), self.parsed(right), way)
        if m := re.fullmatch(r"(.+)_(-?\d+)_([a-z]+)", name):
            if m[3] in OPS:
                return OPS[m[3]](self.parsed(m[1]), int(m[2]))
        if m := re.fullmatch(r"([a-z]+(?:_[a-z]+)*?)(?:_(\d+(?:,\d+)*))?", name) or re.fullmatch(r"([A-Z][A-Z_]*[A-Z]|[A-Z]+\d?)(?:\((\d+(?:,\d+)*)\))?", name):
            recipe = RECIPES.get(m[1].lower())
            if recipe:
                return recipe(self, *map(int, m[2].split(",") if m[2] else ()))
        raise ValueError(f"unknown indicator {name!r}; windows: {sorted(OPS)}, names: {sorted(RECIPES)}, columns: {sorted(self.columns)}")


def crossed(x: Node, y: Node, way: int = 0) -> Node:
    """Whether x crosses y: 1 and -1 for up and down, of one way 1; judged against the last difference that isn't 0."""
    d = x - y
    sign = d._plain("sign", lambda a: F.when(a != 0, F.signum(a)))
    before = sign.over("last").lag(1)
    made = lambda now, was: F.when((now > 0) & (was < 0) & F.lit(way >= 0), 1).when((now < 0) & (was > 0) & F.lit(way <= 0), -1 if way == 0 else 1).otherwise(0)
    return d.graph.plain(f"crossed {way}", made, sign, before)


def weighted(x: Node, n: int) -> Node:
    """Weights 1 to n, the newest heaviest."""
    return x.over("list", n)._plain(f"weighted {n}", lambda a: F.aggregate(F.transform(a, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v) / (n * (n + 1) / 2))


def deviation(x: Node, n: int) -> Node:
    """Mean absolute deviation of n values from their mean."""
    mean = x.sma(n)
    return x.over("list", n)._plain("spread", lambda a, m: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v - m)) / n, mean)


#: Windows of a name's last part: (node, rows).
OPS: dict[str, Callable[[Node, int], Node]] = {
    "sma": Node.sma, "ema": Node.ema, "smma": lambda x, n: x.wilder(n), "wma": weighted, "mstd": lambda x, n: x.over("sample", n), "mvar": lambda x, n: x.over("var", n),
    "max": lambda x, n: x.over("max", n), "min": lambda x, n: x.over("min", n), "sum": lambda x, n: x.over("sum", n), "roc": lambda x, n: 100 * (x / x.lag(n) - 1),
    "d": lambda x, n: x - x.lag(abs(n)), "s": lambda x, n: x.lag(-n),
}


def _true_range(g: Graph) -> Node:
    high, low, prev = g.columns["high"], g.columns["low"], g.columns["close"].lag()
    return g.plain("true range", lambda h, lo, p: F.when(p.isNull(), h - lo).otherwise(F.greatest(h - lo, F.abs(h - p), F.abs(lo - p))), high, low, prev)


def _moves(g: Graph) -> tuple[Node, Node]:
    """Directional moves up and down, 0 on the first row."""
    up, down = g.columns["high"] - g.columns["high"].lag(), g.columns["low"].lag() - g.columns["low"]
    one = lambda a, b: F.coalesce(F.when((a > b) & (a > 0), a), F.lit(0.0))
    return g.plain("move", one, up, down), g.plain("move", one, down, up)


def _directions(g: Graph, n: int) -> tuple[Node, Node]:
    tr = _true_range(g).wilder(n)
    return tuple(100 * m.wilder(n) / tr for m in _moves(g))


def _dx(g: Graph, n: int = 14) -> Node:
    plus, minus = _directions(g, n)
    dx = g.plain("dx", lambda a, b: F.when(a + b > 0, 100 * F.abs(a - b) / (a + b)).otherwise(0.0), plus, minus)
    return dx.where(g.columns["close"].over("count").gt(n - 1))


def _rsi(g: Graph, n: int = 14) -> Node:
    d = g.columns["close"] - g.columns["close"].lag()
    gain, loss = (g.plain(f"part {s}", lambda x, s=s: F.when(x.isNotNull(), F.greatest(x * s, F.lit(0.0))), d).sma(n) for s in (1, -1))
    return g.plain("rsi", lambda a, b: F.when((b == 0) & (a > 0), 100.0).when(b > 0, 100 - 100 / (1 + a / b)), gain, loss)


def _typical(g: Graph) -> Node:
    return (g.columns["high"] + g.columns["low"] + g.columns["close"]) / 3.0


def _band(g: Graph, n: int, k: float) -> Node:
    return g.columns["close"].sma(n) + k * g.columns["close"].over("std", n)


def _macd(g: Graph, fast: int = 12, slow: int = 26) -> Node:
    return g.columns["close"].ema(fast) - g.columns["close"].ema(slow)


def _rsv(g: Graph, n: int) -> Node:
    low, high = g.columns["low"].over("min", n), g.columns["high"].over("max", n)
    return 100 * (g.columns["close"] - low) / (high - low)


def _money(g: Graph, n: int = 14) -> Node:
    t = _typical(g)
    flow = g.plain("flow", lambda now, was, v: F.when(now > was, now * v).when(now < was, -now * v).otherwise(0.0), t, t.lag(), g.columns["volume"])
    up, down = (g.plain(f"side {s}", lambda x, s=s: F.greatest(s * x, F.lit(0.0)), flow).over("sum", n) for s in (1, -1))
    return (100 * up / (up + down)).where(g.columns["close"].over("count").gt(n))


def _on_balance(g: Graph) -> Node:
    c = g.columns["close"]
    return g.plain("signed", lambda now, was, v: F.coalesce(F.signum(now - was), F.lit(1.0)) * v, c, c.lag(), g.columns["volume"]).over("sum")


def _since(g: Graph, column: str, n: int, high: bool) -> Node:
    """Rows since the last extreme of n + 1, over n, in hundredths of closeness."""
    best = F.array_max if high else F.array_min
    return g.columns[column].over("list", n + 1)._plain(f"since {n} {high}", lambda a: 100.0 * (F.array_position(F.reverse(a), best(a)) * -1 + n + 1) / n)


def _spread(g: Graph) -> Node:
    """Where the close stands between low and high, times the volume."""
    h, lo, c = g.columns["high"], g.columns["low"], g.columns["close"]
    return (((c - lo) - (h - c)) / (h - lo)).or_(0.0) * g.columns["volume"]


def _chain(x: Node, n: int, times: int) -> list[Node]:
    out = [x]
    for _ in range(times):
        out.append(out[-1].ema(n))
    return out[1:]


def _line(g: Graph, n: int, at: int | None, what: str = "value") -> Node:
    """The regression line of the last n closes over their row numbers: its value ``at`` rows ahead, slope or start."""
    c = g.columns["close"]
    row = g.columns["close"].over("count")
    slope, start = c.over("slope", n, row), c.over("intercept", n, row)
    return slope if what == "slope" else start + slope * (row - (n - 1)) if what == "start" else start + slope * (row + (at or 0))


def _ultimate(g: Graph, a: int = 7, b: int = 14, c: int = 28) -> Node:
    close, prev = g.columns["close"], g.columns["close"].lag()
    pressure = g.plain("pressure", lambda x, lo, p: F.when(p.isNotNull(), x - F.least(lo, p)), close, g.columns["low"], prev)
    span = _true_range(g).where(g.plain("has", lambda p: p.isNotNull(), prev))
    x, y, z = (pressure.over("sum", n) / span.over("sum", n) for n in (a, b, c))
    return 100 * (4 * x + 2 * y + z) / 7.0


def _momentum_share(g: Graph, n: int = 14) -> Node:
    d = g.columns["close"] - g.columns["close"].lag()
    up, down = (g.plain(f"part {s}", lambda x, s=s: F.when(x.isNotNull(), F.greatest(x * s, F.lit(0.0))), d).over("sum", n) for s in (1, -1))
    return 100 * (up - down) / (up + down)


def _share(x: Node, n: int) -> Node:
    """Where a value stands between its least and largest of n."""
    return 100 * (x - x.over("min", n)) / (x.over("max", n) - x.over("min", n))


_close = lambda g: g.columns["close"]
#: Indicators by name: (graph, numbers) to a node. Their defaults are those that charting libraries have.
RECIPES: dict[str, Callable[..., Node]] = {
    "ad": lambda g: _spread(g).over("sum"), "adosc": lambda g, a=3, b=10: _spread(g).over("sum").ema(a) - _spread(g).over("sum").ema(b), "adx": lambda g, n=14: _dx(g, n).wilder(n, n), "adxr": lambda g, n=14: (_dx(g, n).wilder(n, n) + _dx(g, n).wilder(n, n).lag(n - 1)) / 2.0,
    "apo": lambda g, a=12, b=26: _close(g).sma(a) - _close(g).sma(b), "aroon_down": lambda g, n=14: _since(g, "low", n, False), "aroon_up": lambda g, n=14: _since(g, "high", n, True), "aroonosc": lambda g, n=14: _since(g, "high", n, True) - _since(g, "low", n, False),
    "atr": lambda g, n=14: _true_range(g).wilder(n, n), "avgprice": lambda g: (g.columns["open"] + g.columns["high"] + g.columns["low"] + _close(g)) / 4.0, "boll": lambda g, n=20: _close(g).sma(n), "boll_lb": lambda g, n=20, k=2: _band(g, n, -float(k)),
    "boll_ub": lambda g, n=20, k=2: _band(g, n, float(k)), "bop": lambda g: (_close(g) - g.columns["open"]) / (g.columns["high"] - g.columns["low"]), "cci": lambda g, n=14: (_typical(g) - _typical(g).sma(n)) / (0.015 * deviation(_typical(g), n)),
    "change": lambda g: 100 * (_close(g) / _close(g).lag() - 1), "cmo": _momentum_share, "correl": lambda g, n=30: g.columns["high"].over("corr", n, g.columns["low"]), "dema": lambda g, n=30: (lambda a: 2.0 * a[0] - a[1])(_chain(_close(g), n, 2)),
    "dx": _dx, "ema": lambda g, n=30: _close(g).ema(n), "kdjd": lambda g, n=9, m=3: _rsv(g, n).sma(m).sma(m), "kdjj": lambda g, n=9, m=3: 3 * _rsv(g, n).sma(m) - 2 * _rsv(g, n).sma(m).sma(m), "kdjk": lambda g, n=9, m=3: _rsv(g, n).sma(m),
    "linearreg": lambda g, n=14: _line(g, n, 0), "linearreg_intercept": lambda g, n=14: _line(g, n, None, "start"), "linearreg_slope": lambda g, n=14: _line(g, n, None, "slope"), "macd": _macd, "macdh": lambda g, a=12, b=26, s=9: _macd(g, a, b) - _macd(g, a, b).ema(s),
    "macds": lambda g, a=12, b=26, s=9: _macd(g, a, b).ema(s), "max": lambda g, n=30: _close(g).over("max", n), "medprice": lambda g: (g.columns["high"] + g.columns["low"]) / 2.0, "mfi": _money, "midpoint": lambda g, n=14: (_close(g).over("max", n) + _close(g).over("min", n)) / 2.0,
    "midprice": lambda g, n=14: (g.columns["high"].over("max", n) + g.columns["low"].over("min", n)) / 2.0, "min": lambda g, n=30: _close(g).over("min", n), "minus_di": lambda g, n=14: _directions(g, n)[1], "minus_dm": lambda g, n=14: _moves(g)[1].wilder(n),
    "mom": lambda g, n=10: _close(g) - _close(g).lag(n), "natr": lambda g, n=14: 100 * _true_range(g).wilder(n, n) / _close(g), "obv": _on_balance, "plus_di": lambda g, n=14: _directions(g, n)[0], "plus_dm": lambda g, n=14: _moves(g)[0].wilder(n),
    "ppo": lambda g, a=12, b=26: 100 * (_close(g).sma(a) - _close(g).sma(b)) / _close(g).sma(b), "roc": lambda g, n=10: 100 * (_close(g) / _close(g).lag(n) - 1), "rocp": lambda g, n=10: _close(g) / _close(g).lag(n) - 1, "rocr": lambda g, n=10: _close(g) / _close(g).lag(n),
    "rsi": _rsi, "sma": lambda g, n=30: _close(g).sma(n), "stddev": lambda g, n=5: _close(g).over("std", n), "stochd": lambda g, n=14, m=3: _rsv(g, n).sma(m), "stochk": lambda g, n=14: _rsv(g, n), "stochrsi": lambda g, n=14, k=5: _share(_rsi(g, n), k),
    "sum": lambda g, n=30: _close(g).over("sum", n), "tema": lambda g, n=30: (lambda a: 3.0 * a[0] - 3.0 * a[1] + a[2])(_chain(_close(g), n, 3)), "tr": _true_range, "trange": _true_range, "trima": lambda g, n=30: _close(g).sma((n + 1) // 2).sma(n // 2 + 1),
    "trix": lambda g, n=30: (lambda x: 100 * (x / x.lag() - 1))(_chain(_close(g), n, 3)[-1]), "tsf": lambda g, n=14: _line(g, n, 1), "typprice": _typical, "ultosc": _ultimate, "var": lambda g, n=5: _close(g).over("std", n) * _close(g).over("std", n),
    "vwma": lambda g, n=14: (_close(g) * g.columns["volume"]).over("sum", n) / g.columns["volume"].over("sum", n), "wclprice": lambda g: (g.columns["high"] + g.columns["low"] + 2 * _close(g)) / 4.0, "willr": lambda g, n=14: _rsv(g, n) - 100, "wma": lambda g, n=30: weighted(_close(g), n),
}


def indicators(df: DataFrame, names: list[str] | tuple[str, ...], *, by: str = "symbol", at: str = "date") -> DataFrame:
    """``df`` with a column for each name, in the order given; a column of that name is replaced.

    Values are null until their window is full. Unknown names fail before anything runs; an
    unneeded column of prices may be missing.
    """
    graph = Graph([c for c in df.columns if c not in (by, at)], by, at)
    missing = None
    try:
        outputs = {name: graph.parsed(name) for name in names}
    except KeyError as e:
        missing = e.args[0]
    if missing is not None:
        raise ValueError(f"no column {missing!r}")
    return graph.compiled(df, outputs)

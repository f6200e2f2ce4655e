"""The broker of indicator strategies: orders that fill over several bars up to a share of the usual volume.

Unlike ``simulate``, an order that the volume doesn't allow stays and fills later; purchases
are sized so that the cash pays for their commission; every completed order is logged.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .simulate import TradeConfig


def fill_limit(volumes: list[float], remaining: int, pct: float, days: int, least: int) -> int:
    """Shares that a bar may fill: a share of the mean of the positive volumes of the ``days`` bars before; 0 with fewer than ``least`` of them."""
    seen = [v for v in volumes[-days:] if v and v > 0]
    if len(seen) < least:
        return 0
    return min(int(sum(seen) / len(seen) * pct), abs(remaining))


def affordable(size: int, price: float, cash: float, commission: Callable[[float, float], float], compat: bool = False) -> int:
    """The most shares up to ``size`` that the cash pays for with their commission.

    ``compat``: not the most, but what repeated division of the cash less the commission of
    the last size leads to.
    """
    if price <= 1e-8 or size <= 0:
        return 0
    cost = lambda n: n * price + commission(n, price)
    if compat:
        while size > 0 and cost(size) > cash:
            size = math.floor((cash - commission(size, price)) / price)
        return max(size, 0)
    if cost(size) <= cash:
        return size
    low = 0  # the cost grows with the size
    while size - low > 1:
        mid = (low + size) // 2
        low, size = (mid, size) if cost(mid) <= cash else (low, mid)
    return low


@dataclass
class Broker:
    config: TradeConfig
    cash: float
    shares: int = 0
    order: dict | None = None
    done: list = field(default_factory=list)
    trades: list = field(default_factory=list)
    cost: float = 0.0

    def submit(self, size: int) -> None:
        """An order for ``size`` shares (below 0: a sale); one at a time."""
        if self.order is None and size:
            self.order = {"left": size, "size": size, "value": 0.0, "fee": 0.0}

    def match(self, date, price: float, volumes: list[float]) -> None:
        """Fill what the bar allows of the order at ``price``."""
        o, c = self.order, self.config
        if o is None or not price or price <= 0:
            return
        side = 1 if o["left"] > 0 else -1
        n = abs(o["left"])
        if c.liquidity_pct > 0:
            n = fill_limit(volumes, n, c.liquidity_pct, c.liquidity_days, c.min_history)
        n = min(n, self.shares) if side < 0 else n
        paid = price * (1 + side * c.slippage_perc)
        if side > 0:
            n = affordable(n, paid, self.cash, c.commission)
        if n == 0:
            if side > 0 and c.liquidity_pct <= 0 or side < 0 and self.shares == 0:
                self.order = None  # no cash or no shares: the order is dropped
            return
        fee = c.commission(n, paid)
        self.cash -= side * n * paid + fee
        if side > 0:
            self.cost += n * paid + fee
        else:
            basis = self.cost * n / self.shares
            self.cost -= basis
            self.trades.append((date, n * paid - fee - basis, (n * paid - fee - basis) / (basis / n) if basis else 0.0))
        self.shares += side * n
        o["left"] -= side * n
        o["value"] += n * paid
        o["fee"] += fee
        if o["left"] == 0:
            self.done.append((date, side > 0, o["value"] / abs(o["size"]), o["size"], o["value"], o["fee"]))
            self.order = None


ORDERS = "win string, ticker string, date date, is_buy boolean, price double, size long, value double, commission double"
EQUITY = "win string, ticker string, date date, equity double, shares long"


def run_signals(bars: DataFrame, config: TradeConfig = TradeConfig(), output: str = "equity", part: float = 0.95) -> DataFrame:
    """``equity`` or executed ``orders`` of (win, ticker, date, adjusted_open, adjusted_close, volume, signal): 1 puts ``part`` of the cash in, -1 sells all.

    At ``same_close`` an order meets the bar of its signal, at ``next_open`` the following
    ones; what a bar can't fill stays for the next.
    """
    schema = {"equity": EQUITY, "orders": ORDERS}[output]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        b, out = Broker(config, config.cash), []
        rows = rows.sort_values("date")
        volumes: list[float] = []
        for r in rows.itertuples():
            if config.timing == "next_open":
                b.match(r.date, r.adjusted_open, volumes)
            if r.signal == 1 and b.shares == 0 and r.adjusted_close > 0:
                b.submit(affordable(int(b.cash * part / r.adjusted_close), r.adjusted_close, b.cash, config.commission))
            elif r.signal == -1 and b.shares:
                b.order = None
                b.submit(-b.shares)
            if config.timing == "same_close":
                b.match(r.date, r.adjusted_close, volumes)
            volumes.append(r.volume)
            out.append((*key, r.date, b.cash + b.shares * r.adjusted_close, b.shares))
        done = out if output == "equity" else [(*key, *d) for d in b.done]
        return pd.DataFrame(done, columns=[c.split()[0] for c in schema.split(", ")])

    return bars.groupBy("win", "ticker").applyInPandas(run, schema)

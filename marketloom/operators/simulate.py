"""Order simulation: a deterministic fold over each ticker's bars in one grouped stage.

``run_ticker`` is the account's day loop; ``backtest`` deals (window, ticker) groups to it. A
group is one ticker's bars of one window, a few hundred to a few thousand rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TradeConfig:
    cash: float = 100_000.0
    rate: float = 0.03
    commission_per_share: float = 0.0049
    min_commission: float = 0.99
    max_commission_rate: float = 0.01
    timing: str = "same_close"
    slippage_perc: float = 0.0
    slippage_impact: float = 0.0
    liquidity_pct: float = 0.0
    liquidity_days: int = 20
    min_history: int = 1

    def __post_init__(self):
        if self.timing not in ("same_close", "next_open"):
            raise ValueError("timing must be same_close or next_open")
        if self.cash <= 0 or min(self.commission_per_share, self.min_commission, self.max_commission_rate, self.slippage_perc, self.slippage_impact, self.liquidity_pct) < 0:
            raise ValueError("cash must be positive, rates must not be negative")
        if self.liquidity_days < 1 or self.min_history < 1:
            raise ValueError("liquidity is measured over at least one day")

    def commission(self, q: float, p: float) -> float:
        return 0.0 if q <= 0 or p <= 0 else min(max(q * self.commission_per_share, self.min_commission), q * p * self.max_commission_rate)


@dataclass
class Account:
    """State of one ticker's simulation."""

    config: TradeConfig
    ticker: str
    cash: float
    shares: int = 0
    pending: list = field(default_factory=list)
    trades: list = field(default_factory=list)
    rejected: list = field(default_factory=list)
    equity: list = field(default_factory=list)
    bars: list = field(default_factory=list)
    at: int = 0
    external: float = 0.0
    done: bool = False

    def buy(self, quantity: int = -1) -> None:
        self._order("buy", quantity)

    def sell(self, quantity: int = -1) -> None:
        self._order("sell", quantity)

    def charge(self, cost: float) -> None:
        """An external cost, taken from cash at the end of the day."""
        self.external += cost

    def _order(self, side: str, quantity: int) -> None:
        if self.config.timing == "same_close":
            self._fill(side, quantity, self.bars[self.at]["adjusted_close"], self.at)
        else:
            self.pending.append((side, quantity, self.at))

    def _reject(self, side, quantity, price, signal, reason) -> None:
        day = self.bars[self.at]["date"]
        self.rejected.append((self.bars[signal]["date"], self.ticker, side, int(quantity), price, None if reason == "no_future_bar" else day, reason))

    def _fill(self, side: str, quantity: int, price: float | None, signal: int, force: bool = False) -> None:
        c = self.config
        if price is None or math.isnan(price) or price <= 0:
            return self._reject(side, quantity, price, signal, "invalid_price")
        if quantity == -1:
            quantity = int(self.cash / price) if side == "buy" else self.shares
        asked = quantity
        if side == "sell":
            quantity = min(quantity, self.shares)
        seen = [b["volume"] for b in self.bars[max(0, self.at - c.liquidity_days) : self.at] if b["volume"] is not None]
        average = sum(seen) / len(seen) if seen else None
        if c.liquidity_pct > 0 and not force:
            if len(seen) < c.min_history:
                return self._reject(side, asked, price, signal, "insufficient_liquidity_history")
            quantity = min(quantity, math.floor(average * c.liquidity_pct))
        if quantity <= 0:  # nothing to sell, less cash than a share costs, or a cap of none
            return self._reject(side, asked, price, signal, "zero_quantity")

        def cost(q: int) -> tuple[float, float, float]:
            part = q / average if average else 0.0
            rate = c.slippage_perc + c.slippage_impact * part * part
            fill = price * (1 + rate) if side == "buy" else price * (1 - rate)
            fee = c.commission(q, fill)
            return fill, fee, q * fill + fee

        if side == "buy" and cost(quantity)[2] > self.cash:
            low, high = 0, quantity  # the cost grows with the quantity: the most that cash allows
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if cost(mid)[2] <= self.cash else (low, mid)
            quantity = low
            if quantity == 0:
                return self._reject(side, asked, price, signal, "insufficient_cash")
        fill, fee, spent = cost(quantity)
        self.cash += -spent if side == "buy" else quantity * fill - fee
        self.shares += quantity if side == "buy" else -quantity
        self.trades.append((self.bars[self.at]["date"], self.bars[signal]["date"], self.ticker, side, int(quantity), price, fill, fee, abs(fill - price) * quantity, quantity / average if average else 0.0))


def run_ticker(ticker: str, bars: list[dict], strategy: Callable[[Account], None], config: TradeConfig) -> Account:
    """Fill what is pending at today's open, run the strategy, charge costs, mark to the close; sell all at the end."""
    acc = Account(config, ticker, config.cash, bars=bars)
    for i, bar in enumerate(bars):
        acc.at = i
        waiting, acc.pending = acc.pending, []
        for side, quantity, signal in waiting:
            acc._fill(side, quantity, bar["adjusted_open"], signal)
        strategy(acc)
        acc.cash -= acc.external
        acc.external = 0.0
        acc.equity.append((bar["date"], acc.cash + acc.shares * bar["adjusted_close"]))
        if acc.done:
            break
    for side, quantity, signal in acc.pending:
        acc._reject(side, quantity, None, signal, "no_future_bar")
    if acc.shares:
        acc._fill("sell", -1, bars[acc.at]["adjusted_close"], acc.at, force=True)
        acc.equity[-1] = (acc.equity[-1][0], acc.cash)
    return acc


def buy_and_hold(acc: Account) -> None:
    if acc.at == 0:
        acc.buy()


def on_signal(acc: Account) -> None:
    """The bars' ``signal`` column: 1 buys all, -1 sells all."""
    signal = acc.bars[acc.at].get("signal")
    if signal == 1 and acc.shares == 0:
        acc.buy()
    elif signal == -1 and acc.shares:
        acc.sell()


SCHEMAS = {
    "equity": "win string, ticker string, date date, equity double",
    "trades": "win string, ticker string, date date, signal_date date, side string, quantity long, reference_price double, fill_price double, commission double, slippage_cost double, participation double",
    "rejected": "win string, ticker string, signal_date date, side string, quantity long, reference_price double, execution_date date, reason string",
}


def backtest(bars: DataFrame, strategy: Callable[[Account], None] = buy_and_hold, config: TradeConfig = TradeConfig(), output: str = "equity", least: int = 2) -> DataFrame:
    """``equity``, ``trades`` or ``rejected`` of every (win, ticker) group of adjusted bars; groups under ``least`` bars are skipped."""
    import pandas as pd

    names = [c.split()[0] for c in SCHEMAS[output].split(", ")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        win, ticker = key
        pdf = pdf.sort_values("date")
        if len(pdf) < least:
            return pd.DataFrame({n: [] for n in names})
        acc = run_ticker(ticker, pdf.to_dict("records"), strategy, config)
        if output == "equity":
            rows = [(win, ticker, *r) for r in acc.equity]
        elif output == "trades":
            rows = [(win, ticker, *r[:2], *r[3:]) for r in acc.trades]
        else:
            rows = [(win, ticker, r[0], *r[2:]) for r in acc.rejected]
        return pd.DataFrame(rows, columns=names)

    return bars.groupBy("win", "ticker").applyInPandas(run, SCHEMAS[output])


def hindsight(prices: list[float], cash: float, fee: float, most_sells: int | None = None) -> tuple[float, list[str]]:
    """The final value and the actions of the best trading of whole shares, all in or all out, at a proportional fee.

    Paths are (value today, cash, shares, actions as a linked list); of two that end a day in
    the same state the more valuable stays, of equal ones the one that trades. With
    ``most_sells`` the sales so far are part of the state, and at most that many are made.
    No prices: a value of 0 and no actions.
    """
    if not prices:
        return 0, []
    counts = range(most_sells + 1) if most_sells is not None else (0,)
    worth = lambda path, price: path[0] + path[1] * price

    def bought(path, price):
        n = math.floor(path[0] / (price * (1 + fee)))
        return path[0] - n * price * (1 + fee), path[1] + n, ("BUY", path[2])

    def sold(path, price):
        return path[0] + path[1] * price * (1 - fee), 0, ("SELL", path[2])

    def better(kept, traded, price):
        kept = kept and (kept[0], kept[1], ("HOLD", kept[2]))
        if kept is None or traded is None:
            return kept or traded
        return kept if worth(kept, price) > worth(traded, price) else traded

    start = (cash, 0, None)
    # (sales so far) -> the best path out of and in the market
    flat: dict[int, tuple | None] = {0: (cash, 0, ("HOLD", None))}
    held: dict[int, tuple | None] = {0: bought(start, prices[0])}
    for price in prices[1:]:
        before_flat, before_held = flat, held
        flat, held = {}, {}
        for k in counts:
            sale = before_held.get(k if most_sells is None else k - 1)
            flat[k] = better(before_flat.get(k), sale and sold(sale, price), price)
            entry = before_flat.get(k)
            held[k] = better(before_held.get(k), entry and bought(entry, price), price)
    best = max((p for lane in (flat, held) for p in lane.values() if p), key=lambda p: worth(p, prices[-1]))
    actions, node = [], best[2]
    while node:
        actions.append(node[0])
        node = node[1]
    return worth(best, prices[-1]), actions[::-1]


def hindsight_actions(bars: DataFrame, cash: float = 1000.0, fee: float = 0.001, most_sells: int | None = None) -> DataFrame:
    """(win, ticker, date, action, final) of the best trading of each group's (win, ticker, date, price)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        final, actions = hindsight(rows["price"].tolist(), cash, fee, most_sells)
        return rows[["win", "ticker", "date"]].assign(action=actions, final=float(final))

    return bars.select("win", "ticker", "date", F.col("price").cast("double")).groupBy("win", "ticker").applyInPandas(run, "win string, ticker string, date date, action string, final double")


def trading_env(bars: DataFrame, initial: float = 10_000.0, cost: float = 1e-3, fade: float = 0.99) -> DataFrame:
    """Account of an agent's actions over (win, ticker, date, price, action), action from -1 to 1.

    A buy spends that share of the cash (cost included), a sale gives that share of the
    shares held; both round down to whole shares (doubles, as an account can outgrow a long). Null actions hold. ``total_return`` sums
    the day's returns, each day's weight ``fade`` times the last one's.
    """

    def account(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        cash, held, value, weight, total, out = initial, 0.0, initial, 1.0, 0.0, []
        for price, action in zip(rows["price"], rows["action"].fillna(0.0)):
            most = cash / price / (1 + cost) if action > 0 else held
            traded = math.copysign(math.floor(abs(action) * math.floor(most)), action)
            cash -= traded * price + abs(traded) * price * cost
            held += traded
            before, value = value, cash + held * price
            total += weight * (value / before - 1)
            weight *= fade
            out.append((traded, held, cash, value, value / before - 1, total))
        done = pd.DataFrame(out, columns=["traded", "held", "cash", "value", "ret", "total_return"], index=rows.index)
        return pd.concat([rows[["win", "ticker", "date"]], done], axis=1)

    schema = "win string, ticker string, date date, traded double, held double, cash double, value double, ret double, total_return double"
    return bars.select("win", "ticker", "date", F.col("price").cast("double"), F.col("action").cast("double")).groupBy("win", "ticker").applyInPandas(account, schema)

"""Trading environments over several assets: an episode's days in order, all assets of a day at once.

An environment is a state with ``step(day) -> dict``; ``play`` deals episodes (groups) to it. A
day is a set of arrays, one value an asset, in order of the assets' names. Episodes are
independent and hold a few hundred to a few thousand days each, so a group is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPISODE = "episode string, date date, assets double, cash double, reward double, held array<double>, traded array<double>, note string"


@dataclass
class Day:
    close: np.ndarray
    action: np.ndarray
    turbulence: float = 0.0


def play(days: DataFrame, make: Callable[[int], object]) -> DataFrame:
    """``EPISODE`` rows of (episode, date, symbol, close, action, turbulence): ``make(assets)`` gives each episode's environment.

    Null actions and turbulences are 0. Dates on which an asset of the episode has no row, or
    no close, are left out, as an environment needs a price of every asset.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(rows["symbol"].unique())
        close = rows.pivot_table(index="date", columns="symbol", values="close", aggfunc="first").reindex(columns=names).dropna()
        action = rows.assign(action=rows["action"].fillna(0.0)).pivot_table(index="date", columns="symbol", values="action", aggfunc="first").reindex(index=close.index, columns=names).fillna(0.0)
        risk = rows.groupby("date")["turbulence"].first().reindex(close.index).fillna(0.0)
        env, out = make(len(names)), []
        for date, c, a, t in zip(close.index, close.to_numpy(float), action.to_numpy(float), risk.to_numpy(float)):
            got = env.step(Day(c, a, t))
            out.append((rows["episode"].iloc[0], date, *[got[k] for k in ("assets", "cash", "reward", "held", "traded", "note")]))
            if got.get("done"):
                break
        return pd.DataFrame(out, columns=[c.split()[0] for c in EPISODE.split(", ")])

    columns = [F.col("close").cast("double"), F.col("action").cast("double"), F.col("turbulence").cast("double") if "turbulence" in days.columns else F.lit(0.0).alias("turbulence")]
    return days.select("episode", "date", "symbol", *columns).groupBy("episode").applyInPandas(run, EPISODE)


@dataclass
class Account:
    """Cash and shares of ``assets`` assets at proportional costs."""

    assets: int
    cash: float = 1_000_000.0
    buy_cost: float = 0.001
    sell_cost: float = 0.001
    risk_limit: float | None = None
    held: np.ndarray = field(init=False)

    def __post_init__(self):
        self.held = np.zeros(self.assets)
        self.initial = self.cash
        self.steps = 0

    def risky(self, day: Day) -> bool:
        return self.risk_limit is not None and day.turbulence >= self.risk_limit

    def worth(self, close: np.ndarray) -> float:
        return float(self.cash + self.held @ close)

    def report(self, close, reward, traded, note="", **more) -> dict:
        return {"assets": self.worth(close), "cash": float(self.cash), "reward": float(reward), "held": self.held.tolist(), "traded": np.asarray(traded, float).tolist(), "note": note} | more

    def sell(self, i: int, shares: float, price: float) -> float:
        """Sells at most what is held; the shares sold."""
        n = min(shares, self.held[i])
        self.cash += n * price * (1 - self.sell_cost)
        self.held[i] -= n
        return float(n)


@dataclass
class StockEnv(Account):
    """Whole-share orders of ``most`` x action: sales first, the largest first, then purchases, the largest first.

    A purchase is cut to what the cash pays for, cost included. At or over ``risk_limit``
    everything is sold and nothing bought. The reward is the day's change of the assets times
    ``scale``, plus -0.1 x (1 - shares traded / the most that could be) with ``activity``.
    Orders are filled at the day's close; the change is seen at the next day's.
    """

    most: int = 100
    scale: float = 1e-4
    activity: bool = False

    def __post_init__(self):
        super().__post_init__()
        self.before, self.traded = None, np.zeros(self.assets)

    def step(self, day: Day) -> dict:
        now = self.worth(day.close)
        reward = 0.0
        if self.before is not None:
            reward = (now - self.before) * self.scale
            if self.activity:
                reward -= 0.1 * (1 - np.abs(self.traded).sum() / (self.most * self.assets))
        self.before = now
        want = np.trunc(day.action * self.most)
        if self.risky(day):
            want = np.full(self.assets, -float(self.most))
        order = np.argsort(want, kind="stable")
        self.traded = np.zeros(self.assets)
        for i in order[want[order] < 0]:
            price = day.close[i]
            if price > 0 and self.held[i] > 0:
                self.traded[i] = -self.sell(i, self.held[i] if self.risky(day) else -want[i], price)
        for i in order[::-1][want[order[::-1]] > 0]:
            price = day.close[i]
            if price > 0:
                n = min(self.cash // (price * (1 + self.buy_cost)), want[i])
                self.cash -= n * price * (1 + self.buy_cost)
                self.held[i] += n
                self.traded[i] = n
        return self.report(day.close, reward, self.traded, "turbulence" if self.risky(day) else "")


@dataclass
class CashPenaltyEnv(Account):
    """Orders in money (action x ``most``) of multiples of ``increment`` shares; too little cash kept is penalised.

    All proceeds come before all spending. If the cash doesn't cover purchases and costs, a
    ``patient`` account buys nothing that day, another one ends. The reward is (assets -
    max(0, penalty x assets - cash)) / initial - 1, over the number of steps; 0 at first.
    """

    most: float = 10.0
    increment: int = 1
    penalty: float = 0.1
    patient: bool = False
    discrete: bool = True

    def wanted(self, day: Day) -> np.ndarray:
        money = np.where(day.close > 0, day.action * self.most, 0.0)
        price = np.where(day.close > 0, day.close, 1.0)
        if self.discrete:
            shares = np.trunc(money // price)
            up = shares + np.where(shares < 0, self.increment, 0)
            shares = up // self.increment * self.increment
        else:
            shares = money / price
        return np.maximum(shares, -self.held)

    def rate(self, assets: float, bonus: float = 0.0) -> float:
        if not self.steps:
            return 0.0
        return ((assets - max(0.0, assets * self.penalty - self.cash) + bonus) / self.initial - 1) / self.steps

    def forced(self, day: Day, want: np.ndarray) -> tuple[np.ndarray, str]:
        return (-self.held.copy(), "turbulence") if self.risky(day) else (want, "")

    def bonus(self, day: Day) -> float:
        return 0.0

    def settled(self, day: Day, traded: np.ndarray) -> None:
        """After the day's orders."""

    def step(self, day: Day) -> dict:
        reward = self.rate(self.worth(day.close), self.bonus(day))
        traded, note = self.forced(day, self.wanted(day))
        self.steps += 1
        sold, bought = -np.minimum(traded, 0), np.maximum(traded, 0)
        proceeds, spent = float(sold @ day.close), float(bought @ day.close)
        costs = proceeds * self.sell_cost + spent * self.buy_cost
        done = False
        if spent + costs > self.cash + proceeds:
            note = "cash shortage"
            traded = np.minimum(traded, 0) if self.patient else np.zeros(self.assets)
            spent = costs = 0.0
            if not self.patient:
                proceeds, done = 0.0, True
        self.cash += proceeds - spent - costs
        self.held = self.held + traded
        if not done:
            self.settled(day, traded)
        return self.report(day.close, reward, traded, note, done=done)


@dataclass
class StopLossEnv(CashPenaltyEnv):
    """``CashPenaltyEnv`` that sells an asset whose close is under ``stop`` x its mean purchase price, if cash is at least ``stop`` x initial.

    The reward also takes the shares held times how far closes lie under that price, and times
    how far profitable sales lie from ``1 + ratio x (1 - stop)`` times the purchase price, as a
    penalty below it and a bonus above.
    """

    stop: float = 0.9
    ratio: float = 2.0

    def __post_init__(self):
        super().__post_init__()
        self.mean, self.bought = np.zeros(self.assets), np.zeros(self.assets)
        self.under, self.over = np.zeros(self.assets), np.zeros(self.assets)
        self.last = np.zeros(self.assets)

    def forced(self, day: Day, want: np.ndarray) -> tuple[np.ndarray, str]:
        want, note = super().forced(day, want)
        self.under = day.close - self.stop * self.mean
        if self.cash >= self.stop * self.initial and (self.under < 0).any():
            return np.where(self.under < 0, -self.held, want), "stop loss"
        return want, note

    def bonus(self, day: Day) -> float:
        stopped = float(self.last @ np.minimum(self.under, 0)) if self.steps > 1 else 0.0
        return stopped + float(self.held @ self.over)

    def settled(self, day: Day, traded: np.ndarray) -> None:
        gain = (traded < 0) & (day.close > self.mean)
        self.over = np.where(gain, day.close - (1 + self.ratio * (1 - self.stop)) * self.mean, 0.0)
        self.last = self.held - traded
        buys = traded > 0
        self.bought = np.where(buys, self.bought + 1, self.bought)
        # the mean over purchases, forgotten when nothing is held
        self.mean = np.where(buys, self.mean + (day.close - self.mean) / np.maximum(self.bought, 1), self.mean)
        self.bought, self.mean = np.where(self.held > 0, self.bought, 0.0), np.where(self.held > 0, self.mean, 0.0)


@dataclass
class ArrayEnv(Account):
    """Whole shares of ``most`` x action, ignored up to ``least_rate`` x ``most``; all sold on turbulent days.

    A purchase is limited by cash // price without its cost, so cash can fall below 0. The
    reward is the scaled change of the assets; ``discounted`` in the note's place is the sum
    with ``gamma``, which is the last day's reward of a whole episode.
    """

    most: float = 1e2
    least_rate: float = 0.1
    gamma: float = 0.99
    scale: float = 2.0**-11

    def __post_init__(self):
        super().__post_init__()
        self.before, self.total, self.idle = None, 0.0, np.zeros(self.assets)

    def step(self, day: Day) -> dict:
        if self.before is None:
            self.before = self.worth(day.close)
        want, old = np.trunc(day.action * self.most), self.held.copy()
        self.idle += 1
        if self.risky(day):
            self.cash += float(self.held @ day.close) * (1 - self.sell_cost)
            self.held[:] = 0
            self.idle[:] = 0
        else:
            least = int(self.most * self.least_rate)
            for i in np.flatnonzero((np.abs(want) > least) & (day.close > 0) & (want < 0)):
                self.sell(i, -want[i], day.close[i])
                self.idle[i] = 0
            for i in np.flatnonzero((np.abs(want) > least) & (day.close > 0) & (want > 0)):
                n = min(self.cash // day.close[i], want[i])
                self.held[i] += n
                self.cash -= n * day.close[i] * (1 + self.buy_cost)
                self.idle[i] = 0
        now = self.worth(day.close)
        reward, self.before = (now - self.before) * self.scale, now
        self.total = self.total * self.gamma + reward
        return self.report(day.close, reward, self.held - old, f"discounted={self.total:.12g}")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def remainder_factor(fee: float, weights: np.ndarray, before: np.ndarray, near: float = 1e-10) -> float:
    """The share of a portfolio's value that a change of its weights (cash first) leaves after proportional fees: a fixed point."""
    mu, last = 1 - 2 * fee + fee**2, 1.0
    while abs(mu - last) > near:
        last = mu
        sales = np.maximum(before[1:] - mu * weights[1:], 0).sum()
        mu = (1 - fee * weights[0] - (2 * fee - fee**2) * sales) / (1 - fee * weights[0])
    return float(mu)


@dataclass
class WeightsEnv:
    """A portfolio of weights over cash and assets. Actions that aren't weights already go through softmax (cash has action 0).

    Fees by ``weights`` are paid from cash (a change that cash can't pay is not made), by
    ``remainder`` with the fixed point of ``remainder_factor``. The reward is the log return.
    ``compat``: by ``weights`` the fee is all of what is moved.
    """

    assets: int
    value: float = 100_000.0
    fee: float = 0.0025
    model: str = "remainder"
    compat: bool = False

    def __post_init__(self):
        if self.model not in ("remainder", "weights"):
            raise ValueError("model must be remainder or weights")
        self.weights = np.concatenate([[1.0], np.zeros(self.assets)])
        self.close, self.next = None, self.weights

    def step(self, day: Day) -> dict:
        before = self.value
        if self.close is not None:
            weights = self.next
            if self.model == "weights":
                fees = np.abs((weights - self.weights)[1:] * self.value).sum() * (1.0 if self.compat else self.fee)
                if fees > weights[0] * self.value:
                    weights = self.weights
                else:
                    parts = weights * self.value
                    parts[0] -= fees
                    self.value = float(parts.sum())
                    weights = parts / self.value
            else:
                self.value *= remainder_factor(self.fee, weights, self.weights)
            parts = self.value * weights * np.concatenate([[1.0], day.close / self.close])
            self.value = float(parts.sum())
            self.weights = parts / self.value
        self.close = day.close
        whole = np.concatenate([[0.0], day.action])
        self.next = np.concatenate([[1 - day.action.sum()], day.action]) if day.action.min() >= 0 and 0 < day.action.sum() <= 1 else softmax(whole)
        return {"assets": self.value, "cash": self.value * self.weights[0], "reward": float(np.log(self.value / before)), "held": self.weights[1:].tolist(), "traded": self.next[1:].tolist(), "note": ""}


@dataclass
class AllocationEnv:
    """A portfolio always invested by softmax of the actions, without fees; the reward is its value."""

    assets: int
    value: float = 1_000_000.0

    def __post_init__(self):
        self.close, self.weights = None, np.full(self.assets, 1 / self.assets)

    def step(self, day: Day) -> dict:
        if self.close is not None:
            self.value *= 1 + float((day.close / self.close - 1) @ self.weights)
        self.close, self.weights = day.close, softmax(day.action)
        return {"assets": self.value, "cash": 0.0, "reward": self.value, "held": self.weights.tolist(), "traded": self.weights.tolist(), "note": ""}


def oracle_action(price="close", by: str = "symbol", at: str = "date"):
    """1 if the next price is higher, else -1 (also at the end): what a trainer would have done."""
    from pyspark.sql import Window as W

    following = F.lead(price).over(W.partitionBy(by).orderBy(at))
    return F.when(following > F.col(price), 1).otherwise(-1)

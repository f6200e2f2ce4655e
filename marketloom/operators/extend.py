"""What users add: strategies, signals, selectors, costs, normalisers, and the names they go by."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .broker import run_signals
from .simulate import SCHEMAS, Account, TradeConfig, backtest, on_signal, run_ticker


class Registry(dict):
    """Names and what they stand for; ``add`` is a decorator, and a name is given once."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def add(self, name: str | None = None):
        def put(thing):
            key = name or thing.__name__
            if key in self:
                raise ValueError(f"{self.kind} {key!r} is known already")
            self[key] = thing
            return thing

        return put

    def find(self, name: str):
        if name not in self:
            raise KeyError(f"no {self.kind} {name!r}; known: {sorted(self)}")
        return self[name]


STRATEGIES, SELECTORS, SIGNALS = Registry("strategy"), Registry("selector"), Registry("signal")


class Strategy:
    """A strategy in Python, made anew for every group. ``on_data`` is called for every bar with the account to trade on."""

    def __init__(self, **params):
        self.params = params

    def train(self, history: list[dict]) -> None:
        """The bars before the first trading day."""

    def on_data(self, bar: dict, account: Account) -> None:
        raise NotImplementedError

    def update_info(self, **known) -> None:
        """Settings that the run knows and the strategy may use."""
        self.params |= known

    def finalize(self) -> dict[str, float]:
        """Numbers to report at the end."""
        return {}


def resolved(params: dict | None, bars: pd.DataFrame) -> dict:
    """Parameters with callables replaced by what they give for the group's bars."""
    return {k: v(bars) if callable(v) else v for k, v in (params or {}).items()}


REPORT = "win string, ticker string, name string, value double"


def run_strategy(
    bars: DataFrame, make: Callable[..., Strategy], config: TradeConfig = TradeConfig(), *, params: dict | None = None, output: str = "equity",
    external: str | None = None, training_cost: float = 0.0, least: int = 2,
) -> DataFrame:
    """``equity``, ``trades``, ``rejected`` or ``report`` (what ``finalize`` gives) of a strategy over (win, ticker, date, ...).

    Bars with ``training`` true are its history and aren't traded. ``external`` names a column
    of costs by day; ``training_cost`` is charged on the first traded day.
    """
    schema = REPORT if output == "report" else SCHEMAS[output]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        past = rows["training"].fillna(False) if "training" in rows else pd.Series(False, index=rows.index)
        traded = rows[~past]
        if len(traded) < least:
            return pd.DataFrame({n: [] for n in names})
        strategy = make(**resolved(params, rows))
        strategy.update_info(window=key[0], ticker=key[1], days=len(traded))
        strategy.train(rows[past].to_dict("records"))

        def day(account: Account) -> None:
            bar = account.bars[account.at]
            if account.at == 0 and training_cost:
                account.charge(training_cost)
            if external and bar.get(external):
                account.charge(bar[external])
            strategy.on_data(bar, account)

        acc = run_ticker(key[1], traded.to_dict("records"), day, config)
        picks = {"equity": lambda: acc.equity, "trades": lambda: [(*t[:2], *t[3:]) for t in acc.trades], "rejected": lambda: [(t[0], *t[2:]) for t in acc.rejected], "report": lambda: [(k, float(v)) for k, v in strategy.finalize().items()]}
        return pd.DataFrame([(*key, *r) for r in picks[output]()], columns=names)

    return bars.groupBy("win", "ticker").applyInPandas(run, schema)


class SignalStrategy:
    """A strategy as columns: ``indicators`` adds them, ``signal`` says from them when to buy (1) and sell (-1)."""

    def indicators(self, bars: DataFrame) -> DataFrame:
        return bars

    def signal(self) -> Column:
        raise NotImplementedError

    def signals(self, bars: DataFrame) -> DataFrame:
        """Bars (symbol, date, ...) with ``signal``."""
        return self.indicators(bars).withColumn("signal", self.signal())

    def run(self, bars: DataFrame, config: TradeConfig = TradeConfig(), output: str = "equity", by_broker: bool = False) -> DataFrame:
        """Signals over each symbol's whole history, traded by (win, ticker)."""
        rows = self.signals(bars).withColumnRenamed("symbol", "ticker")
        return run_signals(rows, config, output) if by_broker else backtest(rows, on_signal, config, output)


def selected(bars: DataFrame, windows: list[tuple[str, str]], select: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(win, symbol, ...) of a selector, a function of the bars and a window's first day, for every window (win, first)."""
    parts = [select(bars, first).select(F.lit(win).alias("win"), "*") for win, first in windows]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def normalised(panel: DataFrame, how: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A panel through a user's own function; it must keep the rows' keys."""
    out = panel.transform(how)
    if not {"symbol", "date"} <= set(out.columns):
        raise ValueError("a normaliser must keep symbol and date")
    return out


def with_external_cost(bars: DataFrame, costs: DataFrame, name: str = "external_cost") -> DataFrame:
    """Bars with a day's outside cost (date, cost), 0 where there is none."""
    return bars.join(costs.select("date", F.col("cost").alias(name)), "date", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))

"""Next-day-execution back-test: strategies run in parallel, one task each, since cash ties a strategy's days together.

Each day: shares bought before become sellable, dividends are paid, the orders of the day before are
filled at the close (sales first), positions are marked, and the day's signals become tomorrow's
orders.  Refused orders (limit reached, suspended, too little cash for a lot) are not tried again.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    cash: float = 1_000_000.0
    lot: int = 100
    commission: float = 0.00025
    least_commission: float = 5.0
    stamp: float = 0.0005
    limit: float = 0.1  # of the close before, where prices have a column pre_close


def validate(prices: DataFrame, signals: DataFrame) -> list[str]:
    """What is wrong with the inputs: repeated keys, prices or weights out of range, weights over 1 a day."""
    wrong = []
    for name, df in (("prices", prices), ("signals", signals)):
        keys = ["ts_code", "trade_date"] + (["strategy"] if "strategy" in df.columns else [])
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            wrong.append(f"{name}: repeated keys")
    if not prices.where("close is null or close <= 0").isEmpty():
        wrong.append("prices: a close is not positive")
    if not signals.where("weight < 0 or weight > 1").isEmpty():
        wrong.append("signals: a weight is outside 0..1")
    if not signals.groupBy("strategy", "trade_date").agg(F.sum("weight").alias("w")).where("w > 1 + 1e-9").isEmpty():
        wrong.append("signals: the weights of a day are over 1")
    return wrong


def with_limits(prices: DataFrame, limit: float | dict[str, float]) -> DataFrame:
    """at_limit_up, at_limit_down and suspended for each row.

    Columns limit_up, limit_down and suspended that the prices have already count as they are (null is false).  Else a close is at its limit
    by pre_close and the code's rate (0.1 where a table of rates lacks it), without a pre_close never; a row without volume is suspended.
    """
    rate = F.lit(limit) if not isinstance(limit, dict) else F.coalesce(F.create_map(*(F.lit(x) for pair in limit.items() for x in pair))[F.col("ts_code")], F.lit(0.1))
    before = F.col("pre_close") if "pre_close" in prices.columns else F.lit(None).cast("double")
    price = lambda s: F.rint(before * (1 + s * rate) * 100) / 100
    told = lambda name, derived: F.coalesce(F.col(name).cast("boolean") if name in prices.columns else derived, F.lit(False))
    still = F.coalesce("volume", F.lit(0.0)) <= 0 if "volume" in prices.columns else F.lit(False)
    return prices.withColumns({
        "at_limit_up": told("limit_up", F.col("close") >= price(1) - 1e-9), "at_limit_down": told("limit_down", F.col("close") <= price(-1) + 1e-9), "suspended": told("suspended", still),
    })


class _Ledger:
    """Cash and positions of one strategy: per code [shares, sellable shares, cost]."""

    def __init__(self, rules: Rules):
        self.rules, self.cash, self.held, self.last = rules, rules.cash, {}, {}

    def fee(self, side: str, value: float) -> float:
        r = self.rules
        return (max(value * r.commission, r.least_commission) if r.commission else 0.0) + (value * r.stamp if side == "SELL" else 0.0)

    def equity(self) -> float:
        return self.cash + sum(p[0] * self.last.get(c, 0.0) for c, p in self.held.items())

    def sell(self, code: str, shares: int, price: float) -> float:
        p = self.held[code]
        value, fee = shares * price, self.fee("SELL", shares * price)
        cost = p[2] * shares / p[0]
        self.cash += value - fee
        p[0], p[1], p[2] = p[0] - shares, p[1] - shares, p[2] - cost
        if not p[0]:
            del self.held[code]
        return value - fee - cost

    def buy(self, code: str, shares: int, price: float) -> int:
        lot = self.rules.lot
        shares = shares // lot * lot
        while shares > 0 and shares * price + self.fee("BUY", shares * price) > self.cash + 1e-9:
            shares -= lot
        if shares > 0:
            value = shares * price
            cost = value + self.fee("BUY", value)
            self.cash -= cost
            p = self.held.setdefault(code, [0, 0, 0.0])
            p[0], p[2] = p[0] + shares, p[2] + cost
        return max(shares, 0)


def run(prices: DataFrame, signals: DataFrame, rules: Rules = Rules(), dividends: DataFrame | None = None) -> DataFrame:
    """strategy, trade_date, equity, cash, realised, filled, refused for every day from each strategy's first signal on.

    signals: strategy, ts_code, trade_date, weight; only codes that a strategy names reach its task.
    """
    rows = with_limits(prices, rules.limit)
    codes = signals.select("strategy", "ts_code").distinct()
    book = codes.join(rows, "ts_code").join(signals, ["strategy", "ts_code", "trade_date"], "left")
    if dividends is not None:
        book = book.join(dividends.select("ts_code", F.col("ex_date").alias("trade_date"), "cash_per_share"), ["ts_code", "trade_date"], "left")
    else:
        book = book.withColumn("cash_per_share", F.lit(None).cast("double"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ledger, orders, out = _Ledger(rules), {}, []
        realised = 0.0
        for day, rows_of in pdf.sort_values(["trade_date", "ts_code"]).groupby("trade_date", sort=True):
            filled = refused = 0
            today = {r.ts_code: r for r in rows_of.itertuples()}
            for code, p in ledger.held.items():
                p[1] = p[0]
                if code in today and today[code].cash_per_share == today[code].cash_per_share and today[code].cash_per_share is not None:
                    ledger.cash += p[0] * today[code].cash_per_share
            for code, r in today.items():
                ledger.last.setdefault(code, r.close)
            base = ledger.equity()
            wanted = {}
            for code, weight in orders.items():
                if code not in today or today[code].suspended:
                    refused += 1
                    continue
                wanted[code] = int(base * weight / today[code].close) - ledger.held.get(code, [0])[0]
            for code, change in sorted(wanted.items(), key=lambda x: x[1] > 0):
                r = today[code]
                if change < 0:
                    have = ledger.held[code]
                    shares = have[1] if orders[code] == 0 else min(-change // rules.lot * rules.lot, have[1])
                    if r.at_limit_down or shares <= 0:
                        refused += bool(r.at_limit_down)
                        continue
                    realised += ledger.sell(code, shares, r.close)
                    filled += 1
                elif change >= rules.lot:
                    bought = 0 if r.at_limit_up else ledger.buy(code, change, r.close)
                    filled += bought > 0
                    refused += bought == 0
            ledger.last |= {c: r.close for c, r in today.items()}
            orders = {c: r.weight for c, r in today.items() if r.weight is not None and r.weight == r.weight}
            out.append((pdf["strategy"].iloc[0], day, ledger.equity(), ledger.cash, realised, filled, refused))
        return pd.DataFrame(out, columns=["strategy", "trade_date", "equity", "cash", "realised", "filled", "refused"])

    book = book.select("strategy", "ts_code", "trade_date", "close", "at_limit_up", "at_limit_down", "suspended", "weight", "cash_per_share")
    return book.groupBy("strategy").applyInPandas(one, "strategy string, trade_date date, equity double, cash double, realised double, filled int, refused int")

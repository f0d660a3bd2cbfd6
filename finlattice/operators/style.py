"""Returns-based style: constrained least squares of fund returns on sector returns over rolling windows.

Weights lie in [0, 1] and sum to at most 1; the rest is cash.  The problem is convex and is solved
exactly by accelerated projected gradients.  It asks for second moments alone, so each fund's days are sent once: running sums of their
products, and every window is the difference of two of them.  A window with fewer than `least` common observations, with a value that is
not finite, or of fewer than two sectors gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import change_signal


def project(w: np.ndarray) -> np.ndarray:
    """Nearest point with components in [0, 1] and sum at most 1."""
    inside = np.clip(w, 0, 1)
    if inside.sum() <= 1:
        return inside
    down = np.sort(w)[::-1]
    k = np.arange(1, len(w) + 1)
    shift = (np.cumsum(down) - 1) / k
    return np.maximum(w - shift[np.flatnonzero(down > shift)[-1]], 0)


def solve(h: np.ndarray, g: np.ndarray, steps: int = 5000, tolerance: float = 1e-12) -> np.ndarray:
    """Weights of least w'hw / 2 - g'w, h and g being the centred second moments of the sectors and of sectors and fund."""
    rate = 1 / max(np.linalg.norm(h, 2), 1e-300)
    w = z = np.zeros(len(g))
    t = 1.0
    for _ in range(steps):
        new = project(z - rate * (h @ z - g))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, t = new + (t - 1) / after * (new - w), after
        done, w = np.abs(new - w).max() < tolerance, new
        if done:
            break
    return w


class Moments:
    """Running sums of the products of (1, sectors, fund) over days in order."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rows = np.column_stack((np.ones(len(y)), x, y))
        bad = ~np.isfinite(rows).all(axis=1)
        rows[bad] = 0
        self.bad = np.concatenate(([0], np.cumsum(bad)))
        self.sums = np.zeros((len(y) + 1, rows.shape[1], rows.shape[1]))
        np.cumsum(rows[:, :, None] * rows[:, None, :], axis=0, out=self.sums[1:])

    def fit(self, first: int, last: int) -> tuple[np.ndarray, float | None, float, float] | None:
        """Exposures, r squared, mean and standard deviation of the rest over days first to last - 1; None if one of them is not finite."""
        if self.bad[last] > self.bad[first]:
            return None
        m = self.sums[last] - self.sums[first]
        n = m[0, 0]
        mean = m[0] / n
        c = m - n * np.outer(mean, mean)
        h, g, total = c[1:-1, 1:-1], c[1:-1, -1], c[-1, -1]
        w = solve(h, g)
        rest = max(total - 2 * w @ g + w @ h @ w, 0.0)
        return w, 1 - rest / total if total > 1e-14 * max(m[-1, -1], 1e-300) else None, mean[-1] - mean[1:-1] @ w, (rest / (n - 1)) ** 0.5


_STYLE = pa.schema([("fund", pa.string()), ("end_date", pa.date32()), ("sector", pa.string()), *((c, pa.float64()) for c in ("exposure", "r_squared", "alpha", "residual_volatility", "cash"))])


def decompose(funds: DataFrame, sectors: DataFrame, ends: DataFrame, window: int = 60, least: int = 20, year: int = 252) -> DataFrame:
    """fund, end_date, sector, exposure, r_squared, alpha, residual_volatility, cash.

    funds: fund, day, r; sectors: sector, day, r; ends: end_date.  Only common days count, the last `window` up to each end.
    """
    names = sorted(r.sector for r in sectors.select("sector").distinct().collect())  # a few dozen sectors
    wanted = np.array(sorted(r[0] for r in ends.select(F.col("end_date").cast("date")).distinct().collect() if r[0]), "datetime64[D]")  # days of a calendar
    wide = sectors.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("sector", "r"))).alias("x")).where(F.size("x") == len(names))
    days = funds.where("r is not null").join(wide.select("day", F.transform("x", lambda p: p["r"].cast("double")).alias("x")), "day")
    days = days.select(F.col("fund").cast("string").alias("fund"), F.col("day").cast("date").alias("day"), F.col("r").cast("double").alias("r"), "x")

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("day").combine_chunks()
        day = rows.column("day").to_numpy().astype("datetime64[D]")
        x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(day), len(names))
        moments = Moments(x, rows.column("r").to_numpy())
        out: dict[str, list] = {c: [] for c in _STYLE.names}
        for end, last in zip(wanted, np.searchsorted(day, wanted, side="right"), strict=True):
            first = max(0, int(last) - window)
            found = moments.fit(first, int(last)) if last - first >= least and len(names) > 1 else None
            if found is None:
                continue
            exposure, r_squared, mean, deviation = found
            k = len(names)
            for c, v in zip(_STYLE.names, ([key[0].as_py()] * k, [end.item()] * k, names, exposure.tolist(), [r_squared] * k, [mean * year] * k, [deviation * year**0.5] * k, [1 - exposure.sum()] * k), strict=True):
                out[c] += v
        return pa.table({c: pa.array(v, f.type) for (c, v), f in zip(out.items(), _STYLE, strict=True)})

    return days.groupBy("fund").applyInArrow(one, "fund string, end_date date, sector string, exposure double, r_squared double, alpha double, residual_volatility double, cash double")


def signals(exposures: DataFrame) -> DataFrame:
    """Change of each exposure against 1, 5 and 20 steps before, its label and the fund's turnover against the step before."""
    w = Window.partitionBy("fund", "sector").orderBy("end_date")
    rows = exposures.select("*", *((F.col("exposure") - F.lag("exposure", k).over(w)).alias(f"change_{k}step") for k in (1, 5, 20)))
    turnover = F.sum(F.abs("change_1step")).over(Window.partitionBy("fund", "end_date")) / 2
    return rows.withColumn("signal", F.when(F.col("change_1step").isNotNull(), change_signal("change_1step"))).withColumn("turnover", turnover)


#: Signals from the strongest increase to the strongest decrease.
ORDER = ("strong_increase", "increase", "slight_increase", "neutral", "slight_decrease", "decrease", "strong_decrease")
_LOWER = {"high": "medium", "medium": "low", "low": "low"}


def signal_place(signal: str = "signal"):
    """Place of a signal in ORDER; others come last."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), F.col(signal)), F.lit(99)).cast("int") - F.when(F.col(signal).isin(*ORDER), 1).otherwise(0)


def vote(signals: DataFrame, directions: DataFrame, keys: list[str]) -> DataFrame:
    """Signals (change, signal, confidence) after the vote of other windows (directions: keys, window, direction).

    Of the windows with a direction, the share that agrees with the change is the consistency: below a half confidence goes one
    tier down, below 0.3 the signal is neutral.  Without votes, for neutral changes and where all signals of the group
    are neutral nothing changes.
    """
    votes = directions.where("direction <> 0").groupBy(*keys).agg(F.collect_list("direction").alias("_votes"))
    rows = signals.join(votes, keys, "left").withColumn("_main", F.signum("change").cast("int"))
    share = F.when((F.col("_main") != 0) & (F.size("_votes") > 0), F.size(F.filter("_votes", lambda v: v == F.col("_main"))) / F.size("_votes"))
    rows = rows.withColumn("consistency", share)
    lower = F.coalesce(F.create_map(*(F.lit(x) for pair in _LOWER.items() for x in pair))[F.col("confidence")], F.col("confidence"))
    return rows.withColumn("confidence", F.when(F.col("consistency") < 0.5, lower).otherwise(F.col("confidence"))).withColumn(
        "signal", F.when(F.col("consistency") < 0.3, "neutral").otherwise(F.col("signal"))
    ).drop("_votes", "_main")


def factor_returns(rows: DataFrame, keys: list[str], day: str = "trade_date") -> DataFrame:
    """keys, day, r from `return`, else `factor_return`, else changes of `close`; rows without one go."""
    name = next((c for c in ("return", "factor_return") if c in rows.columns), None)
    w = Window.partitionBy(*keys).orderBy(day)
    r = F.col(name).cast("double") if name else F.try_divide(F.col("close").cast("double"), F.lag("close").over(w)) - 1
    return rows.select(*keys, day, r.alias("r")).where("r is not null")

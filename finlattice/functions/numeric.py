"""Column expressions for numbers: nothing here divides by zero, makes NaN or invents a value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(a, b) -> Column:
    """a / b; null when b is 0 or null."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def log_positive(x) -> Column:
    return F.when(_c(x) > 0, F.ln(_c(x)))


def growth(current, previous) -> Column:
    """Change against the absolute previous value."""
    return safe_divide(_c(current) - _c(previous), F.abs(_c(previous)))


def numeric(x) -> Column:
    """Coercing cast: text that is no finite number becomes null."""
    return finite(_c(x).try_cast("double"))


def finite(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def round_half_even(x, digits: int) -> Column:
    return F.rint(_c(x) * 10**digits) / 10**digits


def amount(x) -> Column:
    """Amount text with units (亿, 万, 元) and thousands commas, in units of one."""
    raw = F.regexp_replace(F.trim(_c(x)), "[,元]", "")
    scale = F.when(raw.endswith("亿"), 1e8).when(raw.endswith("万"), 1e4).otherwise(1.0)
    return numeric(F.regexp_replace(raw, "[亿万]$", "")) * scale


def percent_text(x) -> Column:
    return numeric(F.regexp_replace(_c(x), "[%,]", ""))


def weights_as_fractions(w, total) -> Column:
    """Weights that sum to more than 1.5 are percentages."""
    return _c(w) / F.when(_c(total) > 1.5, 100.0).otherwise(1.0)


def return_on_invested_capital(operating_profit, tax, profit, equity, debt) -> Column:
    """After-tax operating profit over capital; the tax rate is 0 where the profit is not positive."""
    rate = F.when(_c(profit) <= 0, 0.0).otherwise(safe_divide(tax, profit))
    return safe_divide(_c(operating_profit) * (1 - rate), _c(equity) + _c(debt))


def switching_cost_bps(turnover, commission=2.5, stamp=10.0, slippage=2.5, model="sqrt", most=0.5) -> Column:
    """Cost of a one-sided switch in basis points: a flat part and a slippage that grows with the turnover."""
    t = _c(turnover)
    grown = {"sqrt": slippage * F.sqrt(F.least(t, F.lit(most)) / 0.1), "linear": slippage * t / 0.1}.get(model, F.lit(slippage))
    return F.lit(commission + slippage) + F.when(t > 0, stamp).otherwise(0.0) + grown


def trade_cost(side, amount_traded, rate=0.00025, least=5.0, stamp_rate=0.0005) -> Column:
    """Commission with a minimum, and stamp duty on sales."""
    amt = _c(amount_traded)
    return F.greatest(amt * rate, F.lit(least)) + F.when(_c(side) == "SELL", amt * stamp_rate).otherwise(0.0)


def seven_levels(pct) -> Column:
    """Rating of a percentile."""
    p = _c(pct)
    return (
        F.when(p.isNull(), "-").when(p < 10, "extremely_low").when(p < 20, "low").when(p < 40, "fairly_low").when(p < 60, "middle")
        .when(p < 80, "fairly_high").when(p < 90, "high").otherwise("extremely_high")
    )


def change_signal(change) -> Column:
    """Seven labels by thresholds of 0.5, 2 and 5 percentage points."""
    c = _c(change)
    return (
        F.when(c >= 0.05, "strong_increase").when(c >= 0.02, "increase").when(c >= 0.005, "slight_increase").when(c <= -0.05, "strong_decrease")
        .when(c <= -0.02, "decrease").when(c <= -0.005, "slight_decrease").otherwise("neutral")
    )


def confidence_score(r_squared, correlation, change, confirmed) -> Column:
    """0.4 R2 + 0.3 |corr| - 0.2 min(5 |change|, 0.2), plus or minus 0.1 for confirmation, within 0..1."""
    score = 0.4 * F.least(F.coalesce(_c(r_squared), F.lit(0.0)), F.lit(1.0))
    score += F.coalesce(0.3 * F.least(F.abs(_c(correlation)), F.lit(1.0)), F.lit(0.0))
    score -= F.coalesce(0.2 * F.least(F.abs(_c(change)) * 5, F.lit(0.2)), F.lit(0.0))
    score += F.when(_c(confirmed).isNull(), 0.0).when(_c(confirmed), 0.1).otherwise(-0.1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def confidence_tier(score) -> Column:
    return F.when(_c(score) >= 0.7, "high").when(_c(score) >= 0.4, "medium").otherwise("low")


def correlation(a, b) -> Column:
    """Aggregate correlation of two columns that are null together; null without variance."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _six(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else f"{v:.6g}").astype(object)


def six_digits(x) -> Column:
    """A number as a text of six significant digits at most, null without one.

    Which of two texts is nearer hangs on the number's binary digits, which no expression shows, so this goes through Arrow batches.
    """
    return F.pandas_udf(_six, T.StringType())(_c(x).cast("double"))

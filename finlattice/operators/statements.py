"""Ratios of income statements and balance sheets, each visible from the later of both announcements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import growth, return_on_invested_capital, safe_divide
from .point_in_time import latest, with_previous_year


def later_date(a: str, b: str) -> Column:
    """The later of two dates; the one that is there where the other is not."""
    return F.greatest(a, b)


def indicators(income: DataFrame, balance: DataFrame | None) -> DataFrame:
    """ts_code, report_period, announce_date, available_date, source and nine ratios of every income statement.

    The balance sheet of a period is its last announced one; growth is against the same period a year before.
    Without a balance, the income rows already have its columns beside them, its day as balance_date.
    """
    rows = with_previous_year(income, ["ts_code"], ["revenue", "net_profit", "eps"])
    if balance is not None:
        sheet = latest(balance, ["ts_code", "report_period"], ["announce_date"])
        rows = rows.join(sheet.select("ts_code", "report_period", F.col("announce_date").alias("balance_date"), "equity", "total_assets", "interest_bearing_debt"), ["ts_code", "report_period"], "left")
    announced = later_date("announce_date", "balance_date")
    return rows.select(
        "ts_code", "report_period", announced.alias("announce_date"), announced.alias("available_date"), "source",
        safe_divide("net_profit_attributable", "equity").alias("roe"), safe_divide("net_profit", "total_assets").alias("roa"),
        return_on_invested_capital("operating_profit", "income_tax", "total_profit", "equity", "interest_bearing_debt").alias("roic"),
        safe_divide(F.col("revenue") - F.col("operating_cost"), "revenue").alias("gross_margin"), safe_divide("operating_profit", "revenue").alias("operating_margin"), safe_divide("net_profit", "revenue").alias("net_margin"),
        growth("revenue", "revenue_prev").alias("revenue_yoy"), growth("net_profit", "net_profit_prev").alias("profit_yoy"), growth("eps", "eps_prev").alias("eps_yoy"),
    )

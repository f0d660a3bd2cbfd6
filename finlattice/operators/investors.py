"""Investors with their accounts and quotes: what a panel lists, and one investor's profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pages


def listed(investors: DataFrame, accounts: DataFrame, quotes: DataFrame, key: str = "investor_code", status: str = "status", time: str = "published_at", verified: str = "verified") -> DataFrame:
    """Every investor with account_count, quote_count, verified_count and last_captured; those without quotes stay."""
    q = quotes.groupBy(key).agg(F.count(F.lit(1)).alias("quote_count"), F.count_if(F.col(status) == verified).alias("verified_count"), F.max(time).alias("last_captured"))
    a = accounts.groupBy(key).agg(F.count(F.lit(1)).alias("account_count"))
    rows = investors.join(a, key, "left").join(q, key, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("account_count", "quote_count", "verified_count")})


def summary(quotes: DataFrame, status: str = "status") -> DataFrame:
    """How many quotes each state of verification has."""
    return quotes.groupBy(F.coalesce(status, F.lit("unknown")).alias(status)).agg(F.count(F.lit(1)).alias("n"))


def profile(investors: DataFrame, accounts: DataFrame, quotes: DataFrame, code, key: str = "investor_code", time: str = "published_at", quote_key: str = "quote_id", size: int = 20, cursor: str | None = None) -> dict[str, DataFrame] | None:
    """investor, accounts, quotes (a page, the newest first) and summary; None where nobody has this code."""
    one = investors.where(F.col(key) == F.lit(code))
    if one.isEmpty():
        return None
    mine = lambda df: df.where(F.col(key) == F.lit(code))
    return {"investor": one, "accounts": mine(accounts), "quotes": pages.page(mine(quotes), [f"-{time}"], quote_key, size, cursor), "summary": summary(quotes)}

"""Queries over funds: exposure, attribution, style, back-tests, capital flows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import backtest, portfolio, series, style
from ..sources import views as V
from .registry import query

_r = lambda c, n=6: F.round(c, n) + F.lit(0.0)  # noqa: E731  (no negative zero)
_EXPOSURE = """x AS (SELECT fund, report_date, l1 AS sector, sum(weight) AS w, count(*) AS stocks FROM holdings LEFT JOIN sectors USING (stock) GROUP BY ALL),
  exposure AS (SELECT fund, report_date, sector, stocks, w / sum(w) FILTER (WHERE sector IS NOT NULL) OVER (PARTITION BY fund, report_date) AS weight, sum(w) FILTER (WHERE sector IS NOT NULL) OVER (PARTITION BY fund, report_date) / sum(w) OVER (PARTITION BY fund, report_date) AS coverage FROM x QUALIFY sector IS NOT NULL)"""


@query(f"WITH {_EXPOSURE} SELECT fund, report_date, sector, stocks, round(weight, 6) AS weight, round(coverage, 6) AS coverage FROM exposure")
def fund_exposure(spark, d):
    """Industry exposure of every fund and report from its holdings."""
    out = portfolio.sector_weights(V.holdings(spark, d), V.sectors(spark, d), ["fund", "report_date"])
    return out.select("fund", "report_date", "sector", "stocks", _r("weight").alias("weight"), _r("coverage").alias("coverage"))


_BRINSON = f"""{_EXPOSURE}, ret AS (SELECT sector, last_day(date_trunc('quarter', month)::DATE + INTERVAL 2 MONTH) AS report_date, max_by(close, month) / min_by(close, month) - 1 AS rb FROM sector_index GROUP BY ALL HAVING count(*) >= 2),
  bench AS (SELECT report_date, sector, sum(weight) AS w FROM exposure GROUP BY ALL), wb AS (SELECT report_date, sector, w / sum(w) OVER (PARTITION BY report_date) AS wb FROM bench),
  g AS (SELECT f.fund, wb.report_date, wb.sector, wb.wb, coalesce(e.weight, 0) AS wp, coalesce(rb, 0) AS rb, coalesce(rb * (1 + e.stocks / 100.0), coalesce(rb, 0)) AS rp FROM (SELECT DISTINCT fund, report_date FROM exposure) f JOIN wb USING (report_date)
    LEFT JOIN exposure e ON e.fund = f.fund AND e.report_date = wb.report_date AND e.sector = wb.sector LEFT JOIN ret ON ret.report_date = wb.report_date AND ret.sector = wb.sector),
  t AS (SELECT *, sum(wb * rb) OVER (PARTITION BY fund, report_date) AS total FROM g)"""


@query(f"""WITH {_BRINSON} SELECT fund, report_date, round(sum((wp - wb) * (rb - total)), 6) + 0.0 AS allocation, round(sum(wb * (rp - rb)), 6) + 0.0 AS selection, round(sum((wp - wb) * (rp - rb)), 6) + 0.0 AS interaction, round(sum(wp * rp - wb * rb), 6) + 0.0 AS excess FROM t GROUP BY ALL""")
def brinson_attribution(spark, d):
    """Allocation, selection and interaction of every fund and report against the mean fund."""
    e = portfolio.sector_weights(V.holdings(spark, d), V.sectors(spark, d), ["fund", "report_date"]).select("fund", "report_date", "sector", "stocks", "weight")
    quarter = F.last_day(F.add_months(F.trunc("month", "quarter"), 2))
    ret = portfolio.interval_returns(V.sector_index(spark, d).withColumn("report_date", quarter), ["sector", "report_date"], "close", "month").withColumnRenamed("ret", "rb")
    # the fund's sectors as a map beside each day's list of benchmark sectors: exposures are read twice and joined on the day alone
    mine = e.groupBy("fund", "report_date").agg(F.map_from_entries(F.collect_list(F.struct("sector", F.struct("weight", "stocks")))).alias("mine"))
    bench = e.groupBy("report_date", "sector").agg(F.sum("weight").alias("wb")).join(ret, ["sector", "report_date"], "left")
    bench = bench.groupBy("report_date").agg(F.collect_list(F.struct("sector", "wb", "rb")).alias("bench"))
    rows = mine.join(bench, "report_date").select("fund", "report_date", "mine", F.explode("bench").alias("b")).withColumn("own", F.col("mine")[F.col("b.sector")])
    rows = rows.select("fund", "report_date", "b.sector", F.col("own.weight").alias("wp"), "b.wb", (F.col("b.rb") * (1 + F.col("own.stocks") / 100)).alias("rp"), "b.rb")
    out = portfolio.attribution_totals(portfolio.brinson(rows, ["fund", "report_date"]), ["fund", "report_date"])
    return out.select("fund", "report_date", *(_r(c).alias(c) for c in ("allocation", "selection", "interaction", "excess")))


@query("""WITH l AS (SELECT fund, max(report_date) AS report_date FROM holdings GROUP BY 1) SELECT fund, report_date, stock, round(weight, 6) AS weight FROM holdings JOIN l USING (fund, report_date)""")
def latest_holdings(spark, d):
    h = V.holdings(spark, d)
    return h.join(h.groupBy("fund").agg(F.max("report_date").alias("report_date")), ["fund", "report_date"]).select("fund", "report_date", "stock", _r("weight").alias("weight"))


@query("""WITH t AS (SELECT sector, trade_date, net FROM flows) SELECT sector, round(sum(net), 6) AS net, round(sum(turnover), 6) AS turnover, round(sum(net) / nullif(sum(turnover), 0) * 100, 6) AS rate, count(*) AS days FROM flows GROUP BY 1""")
def sector_flows(spark, d):
    return V.flows(spark, d).groupBy("sector").agg(
        _r(F.sum("net")).alias("net"), _r(F.sum("turnover")).alias("turnover"), _r(F.try_divide(F.sum("net"), F.sum("turnover")) * 100).alias("rate"), F.count(F.lit(1)).alias("days")
    )


@query(f"""WITH {_EXPOSURE}, a AS (SELECT fund, sector, sum(weight) AS a FROM exposure WHERE report_date < DATE '1998-07-01' GROUP BY ALL), b AS (SELECT fund, sector, sum(weight) AS b FROM exposure WHERE report_date >= DATE '1998-07-01' GROUP BY ALL)
  SELECT fund, count_if(a IS NOT NULL AND b IS NOT NULL) AS common, round(CASE WHEN count_if(a IS NOT NULL AND b IS NOT NULL) >= 3 AND isfinite(corr(a, b)) THEN corr(a, b) END, 5) AS correlation, round(count_if(a IS NOT NULL AND b IS NOT NULL) / count(*)::DOUBLE, 6) AS coverage FROM a FULL JOIN b USING (fund, sector) GROUP BY 1""")
def exposure_comparison(spark, d):
    e = portfolio.sector_weights(V.holdings(spark, d), V.sectors(spark, d), ["fund", "report_date"])
    half = lambda test: e.where(test).groupBy("fund", "sector").agg(F.sum("weight").alias("w"))
    out = portfolio.compare_maps(half("report_date < '1998-07-01'"), half("report_date >= '1998-07-01'"), ["fund"], "sector", "w")
    near = F.round("correlation", 5)
    signed = F.when((near == 0) & (F.col("correlation") < 0), F.lit(-0.0)).otherwise(near)  # the SQL keeps the sign of a correlation that rounds to zero
    return out.select("fund", "common", signed.alias("correlation"), _r("coverage").alias("coverage"))


def _style_inputs(spark, d):
    w = series.by(["fund"], "month")
    funds = V.fund_nav(spark, d).select("fund", F.col("month").alias("day"), series.simple_return("nav", w).alias("r"))
    v = series.by(["sector"], "month")
    sectors = V.sector_index(spark, d).select("sector", F.col("month").alias("day"), series.simple_return("close", v).alias("r")).where("r is not null")
    return funds, sectors


@query(None)
def style_exposures(spark, d):
    """Rolling style decomposition and its signals; a constrained optimum, so without SQL."""
    funds, sectors = _style_inputs(spark, d)
    ends = sectors.select(F.col("day").alias("end_date")).distinct()
    out = style.signals(style.decompose(funds, sectors, ends, window=36, least=20, year=12))
    return out.select("fund", "end_date", "sector", *(_r(c, 5).alias(c) for c in ("exposure", "r_squared", "cash", "change_1step", "turnover")), "signal")


def strategies(spark, d):
    """Monthly prices of brands, and a strategy for each number of brands and months of look-back: the best so far in equal weights."""
    m = V.table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("ts_code"))
    p = V.daily_prices(spark, d).withColumnRenamed("ts_code", "part").join(m, "part")
    p = p.groupBy("ts_code", F.trunc("trade_date", "month").alias("trade_date")).agg((F.sum("amount") / F.sum("volume") / 100).alias("close"), F.sum("volume").alias("volume"))
    w, day = series.by(["ts_code"]), Window.partitionBy("months", "trade_date")
    rows = p.select("ts_code", "trade_date", F.map_from_arrays(F.array(*map(F.lit, (1, 3, 6))), F.array(*(F.try_divide("close", F.lag("close", k).over(w)) for k in (1, 3, 6)))).alias("past"))
    rows = rows.select("ts_code", "trade_date", F.explode("past").alias("months", "past"))
    ranked = rows.where("past is not null").withColumn("n", F.row_number().over(day.orderBy(F.desc("past"), "ts_code")))
    k = F.explode(F.array(*map(F.lit, (1, 2, 5, 10)))).alias("k")
    chosen = ranked.select("*", k).where("n <= k")
    p = p.withColumn("pre_close", F.lag("close").over(w))
    return p, chosen.select(F.format_string("top %d of %d months", "k", "months").alias("strategy"), "ts_code", "trade_date", (F.lit(0.95) / F.col("k")).alias("weight"))


@query(None)
def backtest_equity(spark, d):
    """Equity curves of many strategies side by side, one task each; path-dependent, so without SQL."""
    prices, signals = strategies(spark, d)
    out = backtest.run(prices, signals)
    return out.select("strategy", "trade_date", _r("equity", 2).alias("equity"), _r("cash", 2).alias("cash"), _r("realised", 2).alias("realised"), "filled", "refused")

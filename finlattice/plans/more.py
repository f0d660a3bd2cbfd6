"""Queries over alignment, normalisation and composed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import seven_levels
from ..operators import alignment as A
from ..operators import percentiles as P
from ..operators import portfolio, series
from ..sources import normalize
from ..sources import views as V
from .market import _LEVEL
from .registry import query

_r = lambda c, n=6: F.round(c, n)


@query("""WITH s AS (SELECT l_partkey AS ts_code, l_returnflag AS f, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY ALL)
  SELECT ts_code, round(price, 10) AS price, CASE f WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS source FROM s QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY CASE f WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) = 1""")
def first_available_source(spark, d):
    l = V.table(spark, d, "lineitem")  # noqa: E741
    one = lambda f: l.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("ts_code")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    return normalize.first_source([one("N"), one("A"), one("R")], ["ts_code"], "price").withColumn("price", _r("price", 10))


@query("""WITH steps AS (SELECT DISTINCT sector, trade_date FROM flows WHERE net > 0), s AS (SELECT sector, trade_date, lag(trade_date) OVER (PARTITION BY sector ORDER BY trade_date) AS before FROM steps)
  SELECT s.sector, s.trade_date, round(sum(f.net), 6) AS net, count(*) AS n FROM s JOIN flows f ON f.sector = s.sector AND f.trade_date > s.before AND f.trade_date <= s.trade_date GROUP BY ALL""")
def interval_flows(spark, d):
    """Flows summed over the intervals between a sector's positive days."""
    f = V.flows(spark, d)
    steps = f.where("net > 0").select("sector", "trade_date").distinct()
    return A.step_sums(steps, f, ["sector"], "trade_date", "net").withColumn("net", _r("net"))


@query("""WITH k AS (SELECT month FROM sector_index GROUP BY month HAVING count(DISTINCT sector) = (SELECT count(DISTINCT sector) FROM sector_index) ORDER BY month DESC LIMIT 36)
  SELECT sector, month, round(close, 9) AS close FROM sector_index JOIN k USING (month)""")
def aligned_indices(spark, d):
    return A.common_days(V.sector_index(spark, d), "sector", "month", "close", 36).select("sector", "month", _r("close", 9).alias("close"))


@query("""SELECT pos, k AS ts_code, name FROM (VALUES (0, 7), (1, 999999999), (2, 3), (3, 11)) t(pos, k) LEFT JOIN securities ON ts_code = k""")
def reindexed(spark, d):
    names = V.table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), F.col("p_name").alias("name"))
    return A.reindex(names, "ts_code", [7, 999999999, 3, 11])


@query("""WITH n AS (SELECT fund, month, nav, CASE WHEN month(month) % 3 = 0 THEN 1.5::DOUBLE END AS pct, CASE WHEN month(month) % 3 = 1 THEN nav * 1.1 END AS acc FROM fund_nav)
  SELECT fund, month, round(coalesce(pct / 100, (acc - lag(acc) OVER w) / lag(nav) OVER w, nav / lag(nav) OVER w - 1), 6) AS r FROM n WINDOW w AS (PARTITION BY fund ORDER BY month)""")
def fund_return_tiers(spark, d):
    nav = V.fund_nav(spark, d).withColumn("pct", F.when(F.month("month") % 3 == 0, 1.5)).withColumn("acc", F.when(F.month("month") % 3 == 1, F.col("nav") * 1.1))
    return A.fund_returns(nav, ["fund"], "month").select("fund", "month", _r("r").alias("r"))


@query("""WITH b AS (SELECT month, sum(close) AS base FROM sector_index GROUP BY 1), x AS (SELECT sector, month, close * 100 / first_value(close) OVER w AS own, base * 100 / first_value(base) OVER w AS benchmark FROM sector_index JOIN b USING (month) WINDOW w AS (PARTITION BY sector ORDER BY month))
  SELECT sector, month, round(own, 6) AS own, round(benchmark, 6) AS benchmark, round(own - benchmark, 6) AS excess FROM x""")
def excess_returns(spark, d):
    s = V.sector_index(spark, d)
    bench = s.groupBy("month").agg(F.sum("close").alias("base"))
    out = A.excess_over_benchmark(s, bench, ["sector"], "month", "close", "base")
    return out.select("sector", "month", *(_r(c).alias(c) for c in ("own", "benchmark", "excess")))


@query("""WITH k AS (SELECT unnest(['ps', 'pcf', 'pb']) AS indicator), s AS (SELECT 'ps' AS indicator, count(ps) AS n, round(max(ps), 6) AS high FROM valuations UNION ALL SELECT 'pb', count(pb), round(max(pb), 6) FROM valuations)
  SELECT indicator, n, high FROM k LEFT JOIN s USING (indicator)""")
def unavailable_indicators(spark, d):
    rows = P.unpivot(V.valuations(spark, d), ["ts_code", "trade_date"], ["ps", "pb"]).groupBy("indicator").agg(F.count("value").alias("n"), _r(F.max("value")).alias("high"))
    return A.with_unavailable(rows, "indicator", ["ps", "pcf", "pb"])


_FLOW = """f AS (SELECT l_suppkey AS stock, sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) AS inflow, sum(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice / 2 ELSE 0 END) AS outflow, sum(l_extendedprice) AS turnover FROM lineitem GROUP BY 1)"""


def _stock_flows(spark, d):
    came = F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice")).otherwise(0.0)
    went = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") / 2).otherwise(0.0)
    f = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("stock")).agg(F.sum(came).alias("inflow"), F.sum(went).alias("outflow"), F.sum("l_extendedprice").alias("turnover"))
    return f.withColumn("net", F.col("inflow") - F.col("outflow")), V.sectors(spark, d).select("stock", F.col("l1").alias("sector"), F.lower("l1").alias("name"))


@query(f"""WITH {_FLOW} SELECT l1 AS sector, lower(l1) AS name, round(sum(inflow), 2) AS inflow, round(sum(outflow), 2) AS outflow, round(sum(inflow - outflow), 2) AS net, round(sum(turnover), 2) AS turnover, count(DISTINCT stock) AS stocks,
  round(sum(inflow - outflow) * 100 / nullif(sum(turnover), 0), 6) AS rate FROM f JOIN sectors USING (stock) GROUP BY 1""")
def stock_to_sector_flows(spark, d):
    out = normalize.sector_flows(*_stock_flows(spark, d))
    return out.select("sector", "name", *(_r(c, 2).alias(c) for c in ("inflow", "outflow", "net", "turnover")), "stocks", _r("rate").alias("rate"))


@query(f"WITH {_FLOW} SELECT count(DISTINCT l1) AS sector_count, count(l1) AS stock_matched, count(*) AS stock_total, round(count(l1) / count(*)::DOUBLE, 4) AS stock_coverage FROM f LEFT JOIN sectors USING (stock)")
def flow_coverage(spark, d):
    """How many of the stocks with flows have a sector."""
    return normalize.flow_coverage(*_stock_flows(spark, d))


@query("""WITH e AS (SELECT c_mktsegment AS fund, report_date, l1 AS sector, avg(weight) AS w FROM holdings JOIN sectors USING (stock) JOIN customer ON c_custkey = fund GROUP BY ALL),
  sp AS (SELECT fund, min(report_date) AS a, max(report_date) AS b FROM e GROUP BY 1), nm AS (SELECT DISTINCT fund, sector FROM e),
  g AS (SELECT fund, sector, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM sp JOIN nm USING (fund)), u AS (SELECT fund, sector, d FROM g WHERE isodow(d) < 6 UNION SELECT fund, sector, report_date FROM e),
  x AS (SELECT u.fund, u.sector, u.d, w, CASE WHEN w IS NOT NULL THEN u.d END AS kd FROM u LEFT JOIN e ON e.fund = u.fund AND e.sector = u.sector AND e.report_date = u.d),
  y AS (SELECT *, last_value(w IGNORE NULLS) OVER p AS pw, last_value(kd IGNORE NULLS) OVER p AS pd, first_value(w IGNORE NULLS) OVER n AS nw, first_value(kd IGNORE NULLS) OVER n AS nd FROM x
    WINDOW p AS (PARTITION BY fund, sector ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY fund, sector ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  z AS (SELECT fund, sector, d AS report_date, coalesce(w, pw + (nw - pw) * (d - pd) / (nd - pd), pw) AS w FROM y WHERE isodow(d) < 6) SELECT fund, sector, report_date, round(w, 6) AS w FROM z WHERE w > 1e-6""")
def daily_exposure(spark, d):
    """Exposures of each segment's funds between reports, weekday by weekday."""
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("fund"), "c_mktsegment")
    e = V.holdings(spark, d).join(V.sectors(spark, d).select("stock", F.col("l1").alias("sector")), "stock").join(c, "fund")
    e = e.groupBy(F.col("c_mktsegment").alias("fund"), "report_date", "sector").agg(F.avg("weight").alias("w"))
    return series.business_days(e, ["fund"], ["sector"], "w", "report_date").withColumn("w", _r("w"))


@query(f"""WITH s AS (SELECT p_type AS symbol, trade_date, sum(amount) / sum(volume) AS close FROM daily_prices JOIN part ON p_partkey = ts_code GROUP BY ALL), l AS (SELECT symbol, max_by(close, trade_date) AS cur, max(trade_date) AS last FROM s GROUP BY 1),
  c AS (SELECT symbol, cur, last, count(*) AS n, 100.0 * count_if(close < cur) / count(*) AS pct, max_by(close, trade_date) FILTER (WHERE trade_date <= last - 30) AS b FROM s JOIN l USING (symbol) GROUP BY symbol, cur, last)
  SELECT symbol, round(cur, 6) AS price, last AS as_of, n, round(pct, 6) AS pct, {_LEVEL} AS level, round((cur / b - 1) * 100, 4) AS change_30d FROM c""")
def commodity_catalogue(spark, d):
    """Per symbol the last price, its percentile and level, and the change over 30 days."""
    m = V.table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), F.col("p_type").alias("symbol"))
    s = V.daily_prices(spark, d).join(m, "ts_code").groupBy("symbol", "trade_date").agg((F.sum("amount") / F.sum("volume")).alias("close"))
    out = P.percentile(s, ["symbol"], "close").join(series.changes(s, ["symbol"], "close", (30,)), "symbol")
    return out.select("symbol", _r("current").alias("price"), "as_of", "n", _r("pct").alias("pct"), seven_levels("pct").alias("level"), _r("change_30d", 4).alias("change_30d"))


@query("""SELECT p_brand AS brand, strftime(trade_date, '%Y') AS year, round(max_by(close, trade_date), 6) AS v FROM (SELECT p_brand, trade_date, avg(close) AS close FROM daily_prices JOIN part ON p_partkey = ts_code GROUP BY ALL) GROUP BY ALL""")
def price_map_rows(spark, d):
    """The map of maps of year-end prices, as rows."""
    m = V.table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), F.col("p_brand").alias("brand"))
    p = V.daily_prices(spark, d).join(m, "ts_code").groupBy("brand", "trade_date").agg(F.avg("close").alias("close"))
    return A.price_maps(p, ["brand"], F.date_format("trade_date", "yyyy"), "close", "trade_date").select("brand", F.explode("values").alias("year", "v")).withColumn("v", _r("v"))


@query("""WITH s AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), q AS (SELECT last_day(unnest(generate_series(date_trunc('quarter', a), b, INTERVAL 3 MONTH))::DATE + INTERVAL 2 MONTH) AS quarter_end, a, b FROM s),
  o AS (SELECT last_day(date_trunc('quarter', o_orderdate)::DATE + INTERVAL 2 MONTH) AS quarter_end, count(*) AS orders FROM orders GROUP BY 1) SELECT quarter_end, orders FROM q LEFT JOIN o USING (quarter_end) WHERE quarter_end BETWEEN a AND b""")
def quarter_calendar(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    ends = o.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(A.quarter_ends(F.col("a"), F.col("b"))).alias("quarter_end"))
    counts = o.groupBy(F.last_day(F.add_months(F.trunc("day", "quarter"), 2)).alias("quarter_end")).agg(F.count(F.lit(1)).alias("orders"))
    return ends.join(counts, "quarter_end", "left")


@query("""WITH e AS (SELECT l1 AS sector, report_date, sum(market_value) AS mv FROM holdings JOIN sectors USING (stock) GROUP BY ALL) SELECT sector, report_date, round(mv / sum(mv) OVER (PARTITION BY report_date), 6) AS weight,
  round(mv / sum(mv) OVER (PARTITION BY report_date) - lag(weight_) OVER (PARTITION BY sector ORDER BY report_date), 6) AS change FROM (SELECT *, mv / sum(mv) OVER (PARTITION BY report_date) AS weight_ FROM e)""")
def benchmark_weights(spark, d):
    """Weight of every sector in all holdings of a report day, and its change."""
    out = portfolio.sector_weights(V.holdings(spark, d), V.sectors(spark, d), ["report_date"], weight="market_value")
    w = series.by(["sector"], "report_date")
    return out.select("sector", "report_date", _r("weight").alias("weight"), _r(F.col("weight") - F.lag("weight").over(w)).alias("change"))


@query("""WITH m AS (SELECT * FROM securities WHERE industry <> 'PROMO'), l AS (SELECT * FROM securities WHERE industry = 'PROMO'), x AS (SELECT * FROM securities WHERE delist_date IS NOT NULL OR industry = 'PROMO')
  SELECT coalesce(m.ts_code, x.ts_code) AS ts_code, coalesce(m.name, x.name) AS name, coalesce(m.list_date, x.list_date) AS list_date, coalesce(m.delist_date, x.delist_date) AS delist_date, m.ts_code IS NOT NULL AS was_known FROM m FULL JOIN x ON m.ts_code = x.ts_code""")
def merged_lifecycle(spark, d):
    s = V.securities(spark, d)
    known = s.where("industry <> 'PROMO'").select("ts_code", "name", "list_date", "delist_date")
    return normalize.merge_lifecycle(known, s.where("industry = 'PROMO'"), s.where("delist_date is not null or industry = 'PROMO'"))

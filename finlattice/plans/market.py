"""Queries over prices and valuations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import seven_levels
from ..operators import percentiles as P
from ..operators import point_in_time as pit
from ..operators import series as S
from ..operators.risk import against_benchmark, performance, risk
from ..sources import views as V
from .registry import query

_r = lambda c, n=6: F.round(c, n)
_LEVEL = """CASE WHEN pct IS NULL THEN '-' WHEN pct < 10 THEN 'extremely_low' WHEN pct < 20 THEN 'low' WHEN pct < 40 THEN 'fairly_low' WHEN pct < 60 THEN 'middle'
  WHEN pct < 80 THEN 'fairly_high' WHEN pct < 90 THEN 'high' ELSE 'extremely_high' END"""
_PCT = """cur AS (SELECT ts_code, max_by(pe_ttm, trade_date) AS cur, max(trade_date) AS as_of FROM valuations WHERE pe_ttm IS NOT NULL GROUP BY 1),
  pct AS (SELECT v.ts_code, cur AS current, as_of, CASE WHEN cur > 0 THEN 100.0 * count_if(pe_ttm < cur) / count(*) END AS pct, count(*) AS n, min(pe_ttm) AS low, median(pe_ttm) AS median, max(pe_ttm) AS high
    FROM valuations v JOIN cur USING (ts_code) WHERE pe_ttm > 0 GROUP BY v.ts_code, cur, as_of)"""


@query(f"""WITH {_PCT} SELECT p.ts_code, name, round(current, 6) AS current, as_of, round(pct, 6) AS pct, n, round(low, 6) AS low, round(median, 6) AS median, round(high, 6) AS high, {_LEVEL} AS level
  FROM pct p JOIN securities USING (ts_code)""")
def market_percentile(spark, d):
    """Historical percentile of every security, with its rating (the flagship)."""
    names = V.table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), F.col("p_name").alias("name"))
    out = P.percentile(V.valuations(spark, d), ["ts_code"], "pe_ttm").join(names, "ts_code")
    return out.select("ts_code", "name", _r("current").alias("current"), "as_of", _r("pct").alias("pct"), "n", _r("low").alias("low"), _r("median").alias("median"), _r("high").alias("high"), "level")


@query(f"""WITH {_PCT} SELECT least(floor(pct / 10), 9)::INT AS decile, count(*) AS n, round(median(pct), 6) AS median_pct FROM pct WHERE pct IS NOT NULL GROUP BY 1""")
def percentile_deciles(spark, d):
    out = P.deciles(P.percentile(V.valuations(spark, d), ["ts_code"], "pe_ttm"))
    return out.withColumn("median_pct", _r("median_pct"))


@query(f"""WITH {_PCT} SELECT ts_code, round(pct, 6) AS pct, {_LEVEL} AS level FROM pct ORDER BY pct ASC NULLS LAST, ts_code LIMIT 20 OFFSET 20""")
def ranking_page(spark, d):
    """Second page of the ranking, nulls last."""
    out = P.percentile(V.valuations(spark, d), ["ts_code"], "pe_ttm").select("ts_code", _r("pct").alias("pct"), "level")
    return out.orderBy(F.asc_nulls_last("pct"), "ts_code").offset(20).limit(20)


@query("""WITH u AS (UNPIVOT (SELECT ts_code, trade_date, pe_ttm, pb, ps FROM valuations) ON pe_ttm, pb, ps INTO NAME indicator VALUE value),
  cur AS (SELECT ts_code, indicator, max_by(value, trade_date) AS cur FROM u WHERE value IS NOT NULL GROUP BY ALL)
  SELECT ts_code, indicator, round(CASE WHEN cur > 0 THEN 100.0 * count_if(value < cur) / count(*) END, 6) AS pct, count(*) AS n FROM u JOIN cur USING (ts_code, indicator) WHERE value > 0 GROUP BY ts_code, indicator, cur""")
def indicator_percentiles(spark, d):
    rows = P.unpivot(V.valuations(spark, d), ["ts_code", "trade_date"], ["pe_ttm", "pb", "ps"])
    return P.percentile(rows, ["ts_code", "indicator"], "value").select("ts_code", "indicator", _r("pct").alias("pct"), "n")


@query("""WITH l AS (SELECT ts_code, max(trade_date) AS last FROM valuations GROUP BY 1), s(span, years) AS (VALUES ('all', 1000), ('5y', 5), ('3y', 3), ('1y', 1)),
  w AS (SELECT v.*, span FROM valuations v JOIN l USING (ts_code), s WHERE span = 'all' OR trade_date > (last - to_years(years))::DATE),
  cur AS (SELECT ts_code, span, max_by(pe_ttm, trade_date) AS cur FROM w GROUP BY ALL)
  SELECT ts_code, span, round(CASE WHEN cur > 0 THEN 100.0 * count_if(pe_ttm < cur) / count(*) END, 6) AS pct, count(*) AS n FROM w JOIN cur USING (ts_code, span) WHERE pe_ttm > 0 GROUP BY ts_code, span, cur""")
def window_percentiles(spark, d):
    return P.windows(V.valuations(spark, d), ["ts_code"], "pe_ttm", {"all": None, "5y": 5, "3y": 3, "1y": 1}).select("ts_code", "span", _r("pct").alias("pct"), "n")


_LAST = "last AS (SELECT ts_code, max_by(pe_ttm, trade_date) AS pe_ttm, max_by(pb, trade_date) AS pb, max(trade_date) AS as_of FROM valuations GROUP BY 1)"


def _last(spark, d):
    return V.valuations(spark, d).groupBy("ts_code").agg(F.max_by("pe_ttm", "trade_date").alias("pe_ttm"), F.max_by("pb", "trade_date").alias("pb"), F.max("trade_date").alias("as_of"))


@query(f"""WITH {_LAST}, g AS (SELECT *, CASE WHEN pe_ttm > 0 THEN pe_ttm END AS v FROM last)
  SELECT count(*) AS total, count(v) AS valid, count_if(pe_ttm IS NULL) AS missing, count_if(pe_ttm <= 0) AS not_positive, count_if(pe_ttm > 1000) AS extreme, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean,
  round(avg(v) FILTER (WHERE v <= 1000), 6) AS trimmed_mean, list_transform(quantile_cont(v, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]), lambda x: round(x, 6)) AS quantiles FROM g""")
def market_profile(spark, d):
    out = P.profile(_last(spark, d), "pe_ttm")
    return out.withColumns({c: _r(c) for c in ("low", "high", "mean", "trimmed_mean")}).withColumn("quantiles", F.transform("quantiles", lambda x: F.round(x, 6)))


@query(f"""WITH {_LAST}, b(bucket, label, a, z) AS (VALUES (0, '0-10', 0, 10), (1, '10-20', 10, 20), (2, '20-30', 20, 30), (3, '30-40', 30, 40), (4, '40-50', 40, 50), (5, '50-70', 50, 70), (6, '70-100', 70, 100), (7, '100-1000', 100, 1000), (8, '>1000', 1000, 1e300))
  SELECT bucket, label, count(ts_code) AS n FROM b LEFT JOIN last ON pe_ttm > a AND pe_ttm <= z GROUP BY ALL""")
def valuation_histogram(spark, d):
    return P.histogram(_last(spark, d), "pe_ttm")


@query(f"""WITH {_LAST} SELECT market, count(*) AS n, round(median(pe_ttm), 6) AS median, round(min(pe_ttm), 6) AS low, round(max(pe_ttm), 6) AS high FROM last JOIN securities USING (ts_code) WHERE pe_ttm > 0 AND trim(market) <> '' GROUP BY market""")
def market_breakdown(spark, d):
    m = V.table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), F.col("p_brand").alias("market"))
    return P.by_market(_last(spark, d).join(m, "ts_code"), "pe_ttm").select("market", "n", *(_r(c).alias(c) for c in ("median", "low", "high")))


@query("SELECT p_brand AS index_code, trade_date, round(median(pe_ttm), 6) AS median_pe, count(*) AS n FROM valuations JOIN part ON p_partkey = ts_code GROUP BY ALL")
def index_median_series(spark, d):
    members = V.table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), F.col("p_brand").alias("index_code"))
    return V.valuations(spark, d).join(members, "ts_code").groupBy("index_code", "trade_date").agg(_r(F.median("pe_ttm")).alias("median_pe"), F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT p_brand AS index_code, trade_date, median(pe_ttm) AS v FROM valuations JOIN part ON p_partkey = ts_code GROUP BY ALL), cur AS (SELECT index_code, max_by(v, trade_date) AS cur FROM m GROUP BY 1)
  SELECT index_code, round(cur, 6) AS current, round(CASE WHEN cur > 0 THEN 100.0 * count_if(v < cur) / count(*) END, 6) AS pct FROM m JOIN cur USING (index_code) WHERE v > 0 GROUP BY index_code, cur""")
def index_percentiles(spark, d):
    members = V.table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), F.col("p_brand").alias("index_code"))
    m = V.valuations(spark, d).join(members, "ts_code").groupBy("index_code", "trade_date").agg(F.median("pe_ttm").alias("v"))
    return P.percentile(m, ["index_code"], "v").select("index_code", _r("current").alias("current"), _r("pct").alias("pct"))


@query("SELECT ts_code, trade_date, round(close, 10) AS close, volume FROM daily_prices WHERE trade_date BETWEEN DATE '1999-01-01' AND DATE '1999-01-31'")
def price_window(spark, d):
    """Scan of a span of days; the date filter reaches the scan as a range of timestamps."""
    l = V.table(spark, d, "lineitem").where((F.col("l_shipdate") >= "1999-01-01") & (F.col("l_shipdate") < "1999-02-01"))  # noqa: E741
    out = l.groupBy(F.col("l_partkey").alias("ts_code"), F.col("l_shipdate").cast("date").alias("trade_date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))
    return out.withColumn("close", _r("close", 10))


@query("SELECT DISTINCT trade_date FROM daily_prices ORDER BY 1 DESC LIMIT 60")
def recent_dates(spark, d):
    return V.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("trade_date")).distinct().orderBy(F.desc("trade_date")).limit(60)


@query("SELECT max(l_shipdate)::DATE AS last_date, count(*) AS n, min(l_shipdate)::DATE AS first_date FROM lineitem")
def watermark(spark, d):
    return V.table(spark, d, "lineitem").agg(F.max("l_shipdate").cast("date").alias("last_date"), F.count(F.lit(1)).alias("n"), F.min("l_shipdate").cast("date").alias("first_date"))


@query("SELECT ts_code, industry, list_date, delist_date FROM securities WHERE (list_date IS NULL OR list_date <= DATE '1998-06-30') AND (delist_date IS NULL OR delist_date > DATE '1998-06-30')")
def universe_as_of(spark, d):
    return pit.universe(V.securities(spark, d), "1998-06-30").select("ts_code", "industry", "list_date", "delist_date")


@query("""WITH w AS (SELECT * FROM daily_prices WHERE trade_date <= DATE '2000-12-31' AND trade_date >= DATE '2000-12-31' - 400),
  a AS (SELECT ts_code, max_by(close, trade_date) AS c, max_by(close, trade_date) FILTER (WHERE trade_date <= DATE '2000-12-31' - 30) AS a1, max_by(close, trade_date) FILTER (WHERE trade_date <= DATE '2000-12-31' - 180) AS a6 FROM w GROUP BY 1)
  SELECT ts_code, round(c, 10) AS last_close, round(c / a1 - 1, 6) AS ret_1m, round(c / a6 - 1, 6) AS ret_6m FROM a""")
def momentum_anchors(spark, d):
    out = pit.anchors(V.daily_prices(spark, d), "2000-12-31", {"ret_1m": 30, "ret_6m": 180})
    return out.select("ts_code", _r("last_close", 10).alias("last_close"), _r("ret_1m").alias("ret_1m"), _r("ret_6m").alias("ret_6m"))


_W = "WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)"


@query(f"""SELECT ts_code, trade_date, round(close / lag(close) OVER w - 1, 6) AS r, round(close / max(close) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1, 6) AS dd,
  round(CASE WHEN count(close) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 4 PRECEDING) = 5 THEN avg(close) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 4 PRECEDING) END, 6) AS ma5,
  round(100 * close / first_value(close) OVER w, 6) AS rebased FROM daily_prices {_W}""")
def technical_series(spark, d):
    """Returns, drawdowns, moving averages and rebased prices: one shuffle, one sort, all windows."""
    w = S.by(["ts_code"])
    return V.daily_prices(spark, d).select(
        "ts_code", "trade_date", _r(S.simple_return("close", w)).alias("r"), _r(S.drawdown("close", w)).alias("dd"), _r(S.moving_average("close", 5, w)).alias("ma5"), _r(S.rebased("close", w)).alias("rebased")
    )


@query("""WITH x AS (SELECT ts_code, trade_date, close, row_number() OVER w AS pos, max(close) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS peak FROM daily_prices WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)),
  y AS (SELECT *, close / peak - 1 AS dd FROM x), t AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY dd, pos) = 1),
  p AS (SELECT y.ts_code, max(y.pos) AS peak_pos, max(y.trade_date) AS peak_date FROM y JOIN t USING (ts_code) WHERE y.close = t.peak AND y.pos <= t.pos GROUP BY 1),
  r AS (SELECT y.ts_code, min(y.pos) AS rec_pos, min(y.trade_date) AS rec FROM y JOIN t USING (ts_code) WHERE y.pos > t.pos AND y.close >= t.peak GROUP BY 1)
  SELECT t.ts_code, round(dd, 6) AS max_drawdown, peak_date, trade_date AS trough_date, rec AS recovery_date, pos - peak_pos AS drawdown_rows, rec_pos - pos AS recovery_rows FROM t JOIN p USING (ts_code) LEFT JOIN r USING (ts_code)""")
def drawdown_episodes(spark, d):
    return S.drawdown_episodes(V.daily_prices(spark, d), ["ts_code"], "close").withColumn("max_drawdown", _r("max_drawdown")).withColumns({c: F.col(c).cast("long") for c in ("drawdown_rows", "recovery_rows")})


@query("""WITH o AS (SELECT ts_code, trade_date, close, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS k, count(*) OVER (PARTITION BY ts_code) AS n FROM daily_prices),
  e(ts_code, k, n, close, up, down) AS (SELECT ts_code, k, n, close, NULL::DOUBLE, NULL::DOUBLE FROM o WHERE k = 1 UNION ALL
    SELECT o.ts_code, o.k, o.n, o.close, CASE WHEN e.up IS NULL THEN greatest(o.close - e.close, 0) ELSE greatest(o.close - e.close, 0) / 14 + (1 - 1.0::DOUBLE / 14) * e.up END,
      CASE WHEN e.down IS NULL THEN greatest(e.close - o.close, 0) ELSE greatest(e.close - o.close, 0) / 14 + (1 - 1.0::DOUBLE / 14) * e.down END FROM e JOIN o ON o.ts_code = e.ts_code AND o.k = e.k + 1)
  SELECT ts_code, round(CASE WHEN n - 1 < 14 THEN NULL WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 4) AS rsi FROM e WHERE k = n AND n > 1""")
def rsi_latest(spark, d):
    return S.rsi(V.daily_prices(spark, d), ["ts_code"]).withColumn("rsi", _r("rsi", 4))


@query("""WITH o AS (SELECT ts_code, close, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS k, count(*) OVER (PARTITION BY ts_code) AS n FROM daily_prices),
  e(ts_code, k, n, a, b, s) AS (SELECT ts_code, k, n, close, close, 0.0::DOUBLE FROM o WHERE k = 1 UNION ALL
    SELECT ts_code, k, n, a, b, (a - b) * 0.2 + s * 0.8 FROM (SELECT o.ts_code, o.k, o.n, o.close * 2.0::DOUBLE / 13 + e.a * (1 - 2.0::DOUBLE / 13) AS a, o.close * 2.0::DOUBLE / 27 + e.b * (1 - 2.0::DOUBLE / 27) AS b, e.s FROM e JOIN o ON o.ts_code = e.ts_code AND o.k = e.k + 1))
  SELECT ts_code, round(CASE WHEN n >= 26 THEN a - b END, 4) AS dif, round(CASE WHEN n >= 26 THEN s END, 4) AS dea, round(CASE WHEN n >= 26 THEN 2 * (a - b - s) END, 4) AS hist FROM e WHERE k = n""")
def macd_latest(spark, d):
    return S.macd(V.daily_prices(spark, d), ["ts_code"]).select("ts_code", *(_r(c, 4).alias(c) for c in ("dif", "dea", "hist")))


@query("""WITH o AS (SELECT ts_code, close, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS k FROM daily_prices)
  SELECT ts_code, round(max(close) FILTER (WHERE k = 1) / max(close) FILTER (WHERE k = 6) - 1, 6) AS mom_5, round(max(close) FILTER (WHERE k = 1) / max(close) FILTER (WHERE k = 21) - 1, 6) AS mom_20 FROM o GROUP BY 1""")
def row_momentum(spark, d):
    return S.momentum(V.daily_prices(spark, d), ["ts_code"], "close", (5, 20)).select("ts_code", _r("mom_5").alias("mom_5"), _r("mom_20").alias("mom_20"))


@query("SELECT ts_code, last_day(trade_date) AS month, round(max_by(close, trade_date), 10) AS close FROM daily_prices GROUP BY ts_code, last_day(trade_date)")
def month_end_prices(spark, d):
    return S.month_end(V.daily_prices(spark, d, dealt=True), ["ts_code"], "close").withColumn("close", _r("close", 10))


@query("""WITH l AS (SELECT ts_code, max(trade_date) AS last FROM daily_prices GROUP BY 1), b AS (SELECT ts_code, max_by(close, trade_date) AS c, max_by(close, trade_date) FILTER (WHERE trade_date <= last - 30) AS b30,
  max_by(close, trade_date) FILTER (WHERE trade_date <= last - 365) AS b365 FROM daily_prices JOIN l USING (ts_code) GROUP BY 1)
  SELECT ts_code, round(c, 10) AS last, round(CASE WHEN b30 > 0 THEN (c / b30 - 1) * 100 END, 6) AS change_30d, round(CASE WHEN b365 > 0 THEN (c / b365 - 1) * 100 END, 6) AS change_365d FROM b""")
def calendar_changes(spark, d):
    return S.changes(V.daily_prices(spark, d), ["ts_code"], "close", (30, 365)).select("ts_code", _r("last", 10).alias("last"), _r("change_30d").alias("change_30d"), _r("change_365d").alias("change_365d"))


@query("""SELECT sector, trade_date, round(net, 6) AS net, round(CASE WHEN count(net) OVER f >= 5 THEN (net - avg(net) OVER f) / (stddev_samp(net) OVER f + 1e-8) END, 5) AS z FROM flows
  WINDOW f AS (PARTITION BY sector ORDER BY trade_date ROWS 19 PRECEDING)""")
def flow_zscores(spark, d):
    return V.flows(spark, d).select("sector", "trade_date", _r("net").alias("net"), _r(S.rolling_zscore("net", S.by(["sector"])), 5).alias("z"))


@query("""WITH x AS (SELECT ts_code, trade_date, close, close / lag(close) OVER w - 1 AS r, close / max(close) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM daily_prices WHERE close > 0 WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)),
  a AS (SELECT ts_code, count(r) AS n, pow(max_by(close, trade_date) / min_by(close, trade_date), 252.0 / nullif(count(r), 0)) - 1 AS ar, stddev_samp(r) * sqrt(252) AS vol, stddev_samp(r) FILTER (WHERE r < 0) AS down, min(dd) AS mdd FROM x GROUP BY 1)
  SELECT ts_code, n, round(least(ar, 1000), 4) AS annual_return, round(vol, 6) AS volatility, round(mdd, 6) AS max_drawdown FROM a WHERE n >= 2""")
def risk_measures(spark, d):
    out = risk(V.daily_prices(spark, d), ["ts_code"])
    return out.select("ts_code", "n", _r(F.least("annual_return", F.lit(1000.0)), 4).alias("annual_return"), _r("volatility").alias("volatility"), _r("max_drawdown").alias("max_drawdown"))


@query("""WITH m AS (SELECT trade_date, avg(close) AS b FROM daily_prices GROUP BY 1), x AS (SELECT ts_code, trade_date, close / lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS r FROM daily_prices),
  y AS (SELECT trade_date, b / lag(b) OVER (ORDER BY trade_date) - 1 AS b FROM m), z AS (SELECT ts_code, r, b FROM x JOIN y USING (trade_date) WHERE r IS NOT NULL AND b IS NOT NULL)
  SELECT ts_code, count(*) AS n, round(CASE WHEN count(*) >= 3 AND var_samp(b) > 0 THEN covar_samp(r, b) / var_samp(b) END, 5) AS beta, round(CASE WHEN count(*) >= 3 AND var_samp(b) > 0 THEN corr(r, b) ** 2 END, 6) AS r_squared FROM z GROUP BY 1""")
def benchmark_beta(spark, d):
    """The market's daily means are few (days), so their window is small; stocks are windows of their own."""
    p = V.daily_prices(spark, d)
    w = S.by(["ts_code"])
    market = p.groupBy("trade_date").agg(F.avg("close").alias("b"))
    market = market.withColumn("all", F.lit(1)).withColumn("b", S.simple_return("b", S.by(["all"]))).drop("all")
    rows = p.select("ts_code", "trade_date", S.simple_return("close", w).alias("r")).join(market, "trade_date")
    return against_benchmark(rows, ["ts_code"]).select("ts_code", "n", _r("beta", 5).alias("beta"), _r("r_squared").alias("r_squared"))


@query("""WITH x AS (SELECT fund, month, nav, nav / lag(nav) OVER w - 1 AS r, nav / max(nav) OVER (PARTITION BY fund ORDER BY month ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM fund_nav WINDOW w AS (PARTITION BY fund ORDER BY month))
  SELECT fund, round(avg(r) * 252, 6) AS annual_return, round(stddev_samp(r) * sqrt(252), 6) AS volatility, round(avg(r) * 252 / (stddev_samp(r) * sqrt(252)), 6) AS sharpe, round(avg(r) * 252 / (sqrt(avg(least(r, 0) ** 2)) * sqrt(252)), 6) AS sortino, round(min(dd), 6) AS max_drawdown FROM x GROUP BY 1""")
def equity_performance(spark, d):
    out = performance(V.fund_nav(spark, d), ["fund"], "nav", "month")
    return out.select("fund", *(_r(c).alias(c) for c in ("annual_return", "volatility", "sharpe", "sortino", "max_drawdown")))


@query("SELECT ts_code, trade_date, count(*) OVER (PARTITION BY ts_code) AS days FROM (SELECT ts_code, trade_date FROM daily_prices QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) <= 5)")
def tail_rows(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("ts_code").orderBy(F.desc("trade_date"))
    rows = V.daily_prices(spark, d).select("ts_code", "trade_date").withColumn("n", F.row_number().over(w)).where("n <= 5")
    return rows.select("ts_code", "trade_date", F.count(F.lit(1)).over(Window.partitionBy("ts_code")).alias("days"))


@query("""WITH d AS (SELECT DISTINCT trade_date FROM daily_prices WHERE trade_date >= DATE '2001-06-01'), c AS (SELECT DISTINCT ts_code FROM daily_prices WHERE trade_date >= DATE '2001-10-01'),
  g AS (SELECT ts_code, trade_date, close FROM d CROSS JOIN c LEFT JOIN daily_prices p USING (ts_code, trade_date))
  SELECT ts_code, trade_date, round(close, 10) AS close, round(last_value(close IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 10) AS carried FROM g""")
def dense_grid(spark, d):
    """Every recently traded code on every day of the span: gaps stay null beside the carried price."""
    p = V.daily_prices(spark, d)
    span = p.where("trade_date >= '2001-06-01'")
    days = span.select("trade_date").distinct().agg(F.sort_array(F.collect_set("trade_date")).alias("days"))  # calendar days: bounded
    codes = p.where("trade_date >= '2001-10-01'").select("ts_code").distinct()
    grid = codes.join(F.broadcast(days)).select("ts_code", F.explode("days").alias("trade_date")).join(span, ["ts_code", "trade_date"], "left")
    return grid.select("ts_code", "trade_date", _r("close", 10).alias("close"), _r(S.forward_fill("close", S.by(["ts_code"])), 10).alias("carried"))


@query("SELECT ts_code, trade_date, round(pe_ttm, 6) AS pe_ttm FROM (SELECT ts_code, max_by(pe_ttm, trade_date) AS pe_ttm, max(trade_date) AS trade_date FROM valuations GROUP BY 1) WHERE pe_ttm > 0 ORDER BY pe_ttm DESC, ts_code LIMIT 10")
def highest_valued(spark, d):
    return _last(spark, d).where("pe_ttm > 0").orderBy(F.desc("pe_ttm"), "ts_code").limit(10).select("ts_code", F.col("as_of").alias("trade_date"), _r("pe_ttm").alias("pe_ttm"))


@query(f"""WITH {_LAST} SELECT {_LEVEL.replace('pct', 'pb')} AS level, count(*) AS n FROM last GROUP BY 1""")
def level_counts(spark, d):
    return _last(spark, d).groupBy(seven_levels("pb").alias("level")).agg(F.count(F.lit(1)).alias("n"))

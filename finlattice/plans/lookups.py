"""Queries by key, day and list, normalised vendor tables, and pages that put several securities side by side."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.numeric import change_signal, confidence_tier
from ..operators import compare, lookups, percentiles, portfolio, series, style
from ..sources import normalize
from ..sources import views as V
from .market import _LEVEL
from .registry import query

_r = lambda c, n=6: F.round(c, n)


@query("SELECT trade_date, round(close, 10) AS close, volume FROM daily_prices WHERE ts_code = 7 AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def price_history_of(spark, d):
    return lookups.by_key(V.daily_prices(spark, d), "ts_code", 7, "1997-01-01", "1999-12-31").select("trade_date", _r("close", 10).alias("close"), "volume")


@query("SELECT ts_code, round(close, 10) AS close FROM daily_prices WHERE trade_date = DATE '1998-03-02'")
def prices_on_day(spark, d):
    return lookups.on_day(V.daily_prices(spark, d), "1998-03-02").select("ts_code", _r("close", 10).alias("close"))


@query("SELECT sector, month, round(close, 9) AS close FROM sector_index WHERE sector IN ('ASIA', 'EUROPE') AND month >= DATE '1998-01-01'")
def series_of_sectors(spark, d):
    return lookups.in_keys(V.sector_index(spark, d), "sector", ["ASIA", "EUROPE", "ASIA"], "1998-01-01", "month").select("sector", "month", _r("close", 9).alias("close"))


_SYMBOLS = "s AS (SELECT '8010' || lpad(c_nationkey::VARCHAR, 2, '0') || CASE WHEN c_nationkey % 2 = 0 THEN '.SI' ELSE '' END AS symbol, count(*) AS n FROM customer GROUP BY 1)"


@query(f"WITH {_SYMBOLS} SELECT symbol, n FROM s WHERE replace(symbol, '.SI', '') IN ('801002', '801003', '801004')")
def series_by_symbol_variants(spark, d):
    c = V.table(spark, d, "customer")
    symbol = F.concat(F.lit("8010"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.when(F.col("c_nationkey") % 2 == 0, ".SI").otherwise(""))
    return lookups.by_symbols(c.groupBy(symbol.alias("symbol")).agg(F.count(F.lit(1)).alias("n")), "symbol", ["801002", "801003.SI", "801004.si", "801003"])


@query("""SELECT fund, report_date, stock, round(weight, 6) AS weight FROM holdings h WHERE fund <= 50 AND report_date = (SELECT max(report_date) FROM holdings x WHERE x.fund = h.fund AND report_date <= DATE '1998-12-31')""")
def effective_holdings(spark, d):
    """Holdings of the last report by a day."""
    found = lookups.latest_effective(V.holdings(spark, d).where("fund <= 50"), ["fund"], "1998-12-31", "report_date")
    return lookups.find(found, [F.col("fund"), F.desc("weight")]).select("fund", "report_date", "stock", _r("weight").alias("weight"))


@query("SELECT ts_code, trade_date, round(pe_ttm, 6) AS pe_ttm FROM valuations WHERE ts_code IN (3, 7, 11) AND pe_ttm > 0")
def positive_histories(spark, d):
    return lookups.positive_histories(V.valuations(spark, d), [3, 7, 11, 7], "pe_ttm").withColumn("pe_ttm", _r("pe_ttm"))


@query("SELECT 'schema_v3@' || max(trade_date)::VARCHAR AS data_version FROM daily_prices WHERE trade_date <= DATE '1999-12-31'")
def data_version(spark, d):
    return lookups.version_stamp(V.daily_prices(spark, d), 3, "1999-12-31")


@query("SELECT CASE WHEN datediff('day', max(trade_date), DATE '2001-11-06') <= 7 THEN max(trade_date) ELSE DATE '2001-11-06' END AS trade_date FROM daily_prices WHERE trade_date <= DATE '2001-11-06'")
def snapshot_trading_day(spark, d):
    return lookups.snapshot_day(V.daily_prices(spark, d), "2001-11-06")


@query("""SELECT c_custkey AS user_id, coalesce(last, TIMESTAMP '2023-12-06') AS since, coalesce(undated, 0)::BIGINT AS undated FROM customer LEFT JOIN (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN ts END) AS last, count_if(event_type = 'error') AS undated FROM events GROUP BY 1) ON user_id = c_custkey""")
def entity_watermarks(spark, d):
    """From when each entity is read on; rows of no time are counted."""
    items = V.table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("published"))
    entities = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    out = lookups.since_by_entity(entities, items, "user_id", "published", "2024-01-05")
    return out.select("user_id", F.col("since").cast("timestamp_ntz").alias("since"), "undated")


@query("SELECT symbol, name, category, sort_order, count(p_partkey) AS parts FROM (VALUES " + ", ".join(f"('{s}', '{n}', '{c}', {k})" for s, n, c, _, _, k in lookups.COMMODITIES) + ") t(symbol, name, category, sort_order) LEFT JOIN part ON p_size = sort_order / 2 GROUP BY ALL")
def commodity_registry(spark, d):
    """The registry with the parts of each commodity's number."""
    parts = V.table(spark, d, "part").groupBy((F.col("p_size") * 2).cast("int").alias("sort_order")).agg(F.count(F.lit(1)).alias("parts"))
    return lookups.commodities(spark).join(parts, "sort_order", "left").select("symbol", "name", "category", "sort_order", F.coalesce("parts", F.lit(0)).alias("parts"))


@query("""WITH l AS (SELECT ts_code, trade_date, close FROM daily_prices WHERE ts_code % 2 = 0), r AS (SELECT ts_code, trade_date, close + 1 AS close FROM daily_prices WHERE ts_code % 3 = 0)
  SELECT ts_code, trade_date, round(close, 10) AS close FROM (SELECT * FROM l UNION ALL SELECT * FROM r WHERE ts_code NOT IN (SELECT ts_code FROM l))""")
def local_first_prices(spark, d):
    p = V.daily_prices(spark, d).select("ts_code", "trade_date", "close")
    answer, _ = lookups.local_first(p.where("ts_code % 2 = 0"), p.where("ts_code % 3 = 0").withColumn("close", F.col("close") + 1), ["ts_code"])
    return answer.withColumn("close", _r("close", 10))


# several securities and indicators


_CODES = (3, 7, 11, 999999999)
_COMPARED = f"""WITH h AS (SELECT ts_code, trade_date, pe_ttm, pb, ps FROM valuations WHERE ts_code IN {_CODES}), r AS (SELECT * FROM h WHERE trade_date >= (SELECT max(trade_date) FROM h) - INTERVAL 60 MONTH),
  u AS (UNPIVOT r ON pe_ttm, pb, ps INTO NAME indicator VALUE value), c AS (SELECT ts_code, indicator, max_by(value, trade_date) AS current FROM u GROUP BY ALL),
  g AS (SELECT u.ts_code, u.indicator, any_value(current) AS current, count(*) FILTER (WHERE value < current) * 100.0::DOUBLE / count(*) AS p, median(value) AS median, min(value) AS low, max(value) AS high, count(*) AS n FROM u JOIN c USING (ts_code, indicator) WHERE value > 0 GROUP BY ALL),
  a AS (SELECT * FROM (VALUES {', '.join(f'({c})' for c in _CODES)}) t(ts_code), (VALUES ('pe_ttm'), ('pb'), ('ps')) i(indicator)), q AS (SELECT *, CASE WHEN current > 0 AND n >= 2 THEN p END AS pct, CASE WHEN current > 0 THEN p END AS rated FROM g)
  SELECT a.ts_code, name, a.indicator, round(current, 4) AS current, round(pct, 2) AS pct, round(median, 4) AS median, n, CASE WHEN n IS NULL THEN NULL ELSE {_LEVEL.replace('pct', 'rated')} END AS level FROM a LEFT JOIN q USING (ts_code, indicator) LEFT JOIN securities s ON s.ts_code = a.ts_code"""


@query(_COMPARED)
def compared_securities(spark, d):
    """Percentiles of several indicators of several securities over five years."""
    out = compare.compare_page(V.valuations(spark, d), V.securities(spark, d), list(_CODES), ["pe_ttm", "pb", "ps"], 5)
    return out.select("ts_code", "name", "indicator", _r("current", 4).alias("current"), _r("pct", 2).alias("pct"), _r("median", 4).alias("median"), "n", "level")


@query("""SELECT coalesce(a.ts_code, b.ts_code) AS ts_code, coalesce(a.trade_date, b.trade_date) AS trade_date, round(pe_ttm * 1.0000000001::DOUBLE, 6) AS pe_ttm, round(ps * 1.0000000001::DOUBLE, 6) AS ps FROM (SELECT ts_code, trade_date, pe_ttm FROM valuations WHERE pe_ttm > 100) a
  FULL JOIN (SELECT ts_code, trade_date, ps FROM valuations WHERE ps > 20) b ON a.ts_code = b.ts_code AND a.trade_date = b.trade_date""")
def merged_indicators(spark, d):
    v = V.valuations(spark, d)
    keys = ["ts_code", "trade_date"]
    out = compare.merge_indicators([v.where("pe_ttm > 100").select(*keys, "pe_ttm"), v.where("ps > 20").select(*keys, "ps")], keys)
    return out.select(*keys, *(_r(F.col(c) * 1.0000000001).alias(c) for c in ("pe_ttm", "ps")))  # off the ties that two engines round apart


@query("""WITH pe AS (SELECT ts_code, date_trunc('month', trade_date) AS m, max_by(pe_ttm, trade_date) AS pe_ttm FROM valuations WHERE ts_code % 2 = 0 GROUP BY ALL), p AS (SELECT ts_code, date_trunc('month', trade_date) AS m, max(trade_date) AS trade_date, max_by(close, trade_date) AS close FROM daily_prices GROUP BY ALL)
  SELECT ts_code, trade_date, round(close, 10) AS close, round(pe_ttm, 6) AS pe_ttm FROM p LEFT JOIN pe USING (ts_code, m)""")
def month_joined(spark, d):
    """Month-end prices with the valuation of the same month."""
    prices = V.daily_prices(spark, d).groupBy("ts_code", F.trunc("trade_date", "month").alias("m")).agg(F.max("trade_date").alias("trade_date"), F.max_by("close", "trade_date").alias("close")).drop("m")
    out = compare.month_join(prices, V.valuations(spark, d).where("ts_code % 2 = 0").select("ts_code", "trade_date", "pe_ttm"), ["ts_code"])
    return out.select("ts_code", "trade_date", _r("close", 10).alias("close"), _r("pe_ttm").alias("pe_ttm"))


@query("""WITH l AS (SELECT ts_code, max_by(pe_ttm, trade_date) AS v FROM valuations WHERE pe_ttm IS NOT NULL GROUP BY 1), b AS (SELECT least(floor(v / 50), 9)::INT AS bucket, count(*) AS n FROM l WHERE v > 0 GROUP BY 1),
  t AS (SELECT count(*) AS total, count_if(v > 0) AS valid FROM l) SELECT bucket, n, round(n / valid::DOUBLE, 6) AS ratio, round(valid / total::DOUBLE, 6) AS coverage, valid >= 1000 AS representative FROM b, t""")
def distribution_ratios(spark, d):
    last = V.valuations(spark, d).where("pe_ttm is not null").groupBy("ts_code").agg(F.max_by("pe_ttm", "trade_date").alias("v"))
    buckets = last.where("v > 0").groupBy(F.least(F.floor(F.col("v") / 50), F.lit(9)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    out = percentiles.profile_ratios(last.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("v") > 0).alias("valid")), buckets)
    return out.select("bucket", "n", _r("ratio").alias("ratio"), _r("coverage").alias("coverage"), "representative")


@query("""WITH m AS (SELECT month, sector, close FROM sector_index), a AS (SELECT month, sector, close / sum(close) OVER (PARTITION BY month) AS w FROM m WHERE sector <> 'ASIA'), b AS (SELECT month, sector, close / sum(close) OVER (PARTITION BY month) AS w FROM m WHERE sector <> 'AFRICA'),
  j AS (SELECT coalesce(a.month, b.month) AS month, coalesce(a.sector, b.sector) AS sector, round(coalesce(a.w, 0) - coalesce(b.w, 0), 9) AS difference FROM a FULL JOIN b ON a.month = b.month AND a.sector = b.sector)
  SELECT month, sector, difference, row_number() OVER (PARTITION BY month ORDER BY abs(difference) DESC, sector) AS place FROM j QUALIFY place <= 3""")
def weight_differences(spark, d):
    s = V.sector_index(spark, d)
    share = lambda df: df.withColumn("w", F.col("close") / F.sum("close").over(Window.partitionBy("month")))
    out = portfolio.top_differences(share(s.where("sector <> 'ASIA'")), share(s.where("sector <> 'AFRICA'")), ["month"], "sector", "w", 3)
    return out.select("month", "sector", _r("difference", 9).alias("difference"), "place")


# signals


_FLOW = "c AS (SELECT sector, trade_date, net / nullif(turnover, 0) / 10 AS x FROM flows), w AS (SELECT *, x - lag(x, 1) OVER k AS change, x - lag(x, 2) OVER k AS short, x - lag(x, 5) OVER k AS long FROM c WINDOW k AS (PARTITION BY sector ORDER BY trade_date))"
_SIGNAL = "CASE WHEN change >= 0.05 THEN 'strong_increase' WHEN change >= 0.02 THEN 'increase' WHEN change >= 0.005 THEN 'slight_increase' WHEN change <= -0.05 THEN 'strong_decrease' WHEN change <= -0.02 THEN 'decrease' WHEN change <= -0.005 THEN 'slight_decrease' ELSE 'neutral' END"


@query(f"""WITH {_FLOW}, s AS (SELECT sector, trade_date, change, {_SIGNAL} AS signal, CASE WHEN abs(change) * 10 >= 0.7 THEN 'high' WHEN abs(change) * 10 >= 0.4 THEN 'medium' ELSE 'low' END AS confidence,
    (CASE WHEN short <> 0 THEN (sign(short) = sign(change))::INT END) AS a, (CASE WHEN long <> 0 THEN (sign(long) = sign(change))::INT END) AS b FROM w WHERE change IS NOT NULL),
  v AS (SELECT *, CASE WHEN change <> 0 AND (a IS NOT NULL OR b IS NOT NULL) THEN (coalesce(a, 0) + coalesce(b, 0))::DOUBLE / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END AS consistency FROM s),
  r AS (SELECT sector, trade_date, round(change, 6) AS change, consistency, CASE WHEN consistency < 0.3 THEN 'neutral' ELSE signal END AS signal,
    CASE WHEN consistency < 0.5 THEN CASE confidence WHEN 'high' THEN 'medium' ELSE 'low' END ELSE confidence END AS confidence FROM v)
  SELECT *, CASE signal WHEN 'strong_increase' THEN 0 WHEN 'increase' THEN 1 WHEN 'slight_increase' THEN 2 WHEN 'neutral' THEN 3 WHEN 'slight_decrease' THEN 4 WHEN 'decrease' THEN 5 ELSE 6 END AS place FROM r""")
def voted_signals(spark, d):
    """Signals of changes, with the vote of a shorter and a longer window, in order of strength."""
    w = Window.partitionBy("sector").orderBy("trade_date")
    x = V.flows(spark, d).select("sector", "trade_date", (F.try_divide("net", F.nullif("turnover", F.lit(0.0))) / 10).alias("x"))
    x = x.select("sector", "trade_date", *((F.col("x") - F.lag("x", k).over(w)).alias(n) for n, k in (("change", 1), ("short", 2), ("long", 5)))).where("change is not null")
    main = x.select("sector", "trade_date", "change", change_signal("change").alias("signal"), confidence_tier(F.abs("change") * 10).alias("confidence"))
    votes = x.select("sector", "trade_date", F.explode(F.array(F.signum("short"), F.signum("long"))).alias("direction")).where("direction is not null").withColumn("direction", F.col("direction").cast("int"))
    out = style.vote(main, votes, ["sector", "trade_date"]).withColumn("place", style.signal_place())
    return out.orderBy("place", "sector", "trade_date").select("sector", "trade_date", _r("change").alias("change"), "consistency", "signal", "confidence", "place")


@query("SELECT sector, month, round(close / lag(close) OVER (PARTITION BY sector ORDER BY month) - 1, 6) AS r FROM sector_index QUALIFY r IS NOT NULL")
def factor_return_series(spark, d):
    return style.factor_returns(V.sector_index(spark, d), ["sector"], "month").select("sector", "month", _r("r").alias("r"))


_LONG = "p AS (SELECT event_id % 2 AS k, event_id AS i, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) AS j, 100 + value AS v FROM events)"


@query(f"""WITH {_LONG}, e(k, j, v, up, down) AS (SELECT k, j, v, NULL::DOUBLE, NULL::DOUBLE FROM p WHERE j = 1 UNION ALL SELECT p.k, p.j, p.v, CASE WHEN e.up IS NULL THEN greatest(p.v - e.v, 0) ELSE greatest(p.v - e.v, 0) / 14 + (1 - 1.0::DOUBLE / 14) * e.up END,
    CASE WHEN e.down IS NULL THEN greatest(e.v - p.v, 0) ELSE greatest(e.v - p.v, 0) / 14 + (1 - 1.0::DOUBLE / 14) * e.down END FROM e JOIN p ON p.k = e.k AND p.j = e.j + 1)
  SELECT k, round(max_by(100 - 100 / (1 + up / down), j), 6) AS rsi FROM e GROUP BY k""")
def rsi_of_long_series(spark, d):
    """Over series of thousands of rows, from the first one on."""
    rows = V.table(spark, d, "events").select((F.col("event_id") % 2).alias("k"), "event_id", (F.col("value") + 100).alias("v"))
    return series.rsi(rows, ["k"], "v", day="event_id").withColumn("rsi", _r("rsi"))


@query(f"""WITH {_LONG}, e(k, j, a, b, s) AS (SELECT k, j, v, v, 0.0::DOUBLE FROM p WHERE j = 1 UNION ALL SELECT k, j, a, b, (a - b) * 0.2 + s * 0.8 FROM (SELECT p.k, p.j, p.v * 2.0::DOUBLE / 13 + e.a * (1 - 2.0::DOUBLE / 13) AS a, p.v * 2.0::DOUBLE / 27 + e.b * (1 - 2.0::DOUBLE / 27) AS b, e.s
    FROM e JOIN p ON p.k = e.k AND p.j = e.j + 1)) SELECT k, round(max_by(a - b, j), 6) AS dif, round(max_by(s, j), 6) AS dea FROM e GROUP BY k""")
def macd_of_long_series(spark, d):
    rows = V.table(spark, d, "events").select((F.col("event_id") % 2).alias("k"), "event_id", (F.col("value") + 100).alias("v"))
    return series.macd(rows, ["k"], "v", day="event_id").select("k", _r("dif").alias("dif"), _r("dea").alias("dea"))


# vendor tables


@query("""WITH v AS (SELECT * FROM valuations) SELECT b.ts_code, b.trade_date, round(b.pe_ttm, 10) AS pe_ttm, NULL::DOUBLE AS pe_static, round(x.pb, 10) AS pb, round(y.ps, 10) AS ps, NULL::DOUBLE AS pcf FROM (SELECT * FROM v WHERE pe_ttm > 0) b
  LEFT JOIN (SELECT * FROM v WHERE pb > 1) x ON x.ts_code = b.ts_code AND x.trade_date = b.trade_date LEFT JOIN (SELECT * FROM v WHERE ps < 30) y ON y.ts_code = b.ts_code AND y.trade_date = b.trade_date""")
def valuation_history_table(spark, d):
    v = V.valuations(spark, d)
    keys = ["ts_code", "trade_date"]
    frames = {"pe_ttm": v.where("pe_ttm > 0").select(*keys, "pe_ttm"), "pb": v.where("pb > 1").select(*keys, "pb"), "ps": v.where("ps < 30").select(*keys, "ps")}
    return normalize.valuation_history(frames).withColumns({c: _r(c, 10) for c in ("pe_ttm", "pb", "ps")})


@query("""SELECT DISTINCT lpad(s_suppkey::VARCHAR, 6, '0') || CASE WHEN left(lpad(s_suppkey::VARCHAR, 6, '0'), 1) IN ('6', '5') OR left(lpad(s_suppkey::VARCHAR, 6, '0'), 2) = '90' THEN '.SH' WHEN left(lpad(s_suppkey::VARCHAR, 6, '0'), 1) IN ('4', '8') OR left(lpad(s_suppkey::VARCHAR, 6, '0'), 2) = '92' THEN '.BJ' ELSE '.SZ' END AS ts_code,
  n_regionkey::VARCHAR AS index_code, n_name AS index_name, DATE '1998-06-30' AS effective_date FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def index_membership_table(spark, d):
    s, n = V.table(spark, d, "supplier"), V.table(spark, d, "nation")
    raw = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".0")).alias("代码"), F.col("n_regionkey").alias("指数"), F.col("n_name").alias("名称"), F.lit("1998-06-30").alias("日期"))
    raw = raw.unionAll(raw.where("`指数` = 1"))
    return normalize.index_membership(raw, {"ts_code": "代码", "index_code": "指数", "index_name": "名称", "effective_date": "日期"})


@query("""SELECT n_nationkey::VARCHAR AS industry_code, trim(n_name) AS industry_name, n_regionkey::INT AS industry_level, DATE '1999-12-31' AS stat_date, 'x' AS classification, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 1.5::DOUBLE END AS pe_median FROM nation""")
def industry_valuation_table(spark, d):
    n = V.table(spark, d, "nation")
    pe = F.when(F.col("n_nationkey") % 3 == 0, "-").otherwise((F.col("n_nationkey") * 1.5).cast("string"))
    raw = n.select(F.col("n_nationkey").alias("编码"), F.concat(F.lit(" "), "n_name", F.lit("  ")).alias("名称"), F.col("n_regionkey").cast("string").alias("层级"), pe.alias("中位数"))
    return normalize.industry_valuation(raw, {"industry_code": "编码", "industry_name": "名称", "industry_level": "层级", "pe_median": "中位数"}, "1999-12-31", "x")


@query("""SELECT p_partkey::VARCHAR AS sector_code, p_brand AS sector_name, 'concept' AS sector_type, DATE '2024-01-05' AS trade_date, NULL::DOUBLE AS inflow, NULL::DOUBLE AS outflow, p_size * 1.0::DOUBLE + p_partkey - p_size * 2 + 3 AS net_inflow, p_size / 10.0::DOUBLE AS net_inflow_rate, (p_size + p_partkey)::DOUBLE AS main_net_inflow, 3.0::DOUBLE AS retail_net_inflow FROM part""")
def vendor_sector_flow_table(spark, d):
    p = V.table(spark, d, "part")
    size = F.col("p_size").cast("double")
    raw = p.select(F.col("p_partkey").cast("string").alias("代码"), F.col("p_brand").alias("名称"), (size + F.col("p_partkey")).alias("主力"), (size / 10).alias("占比"), size.alias("超大"), F.col("p_partkey").cast("string").alias("大"), (-2 * size).alias("中"), F.lit("3").alias("小"))
    names = {"sector_code": "代码", "sector_name": "名称", "main_net_inflow": "主力", "main_net_inflow_rate": "占比", "super_net_inflow": "超大", "large_net_inflow": "大", "medium_net_inflow": "中", "small_net_inflow": "小"}
    return normalize.vendor_sector_flows(raw, names, "2024-01-05", "concept")


@query("""SELECT p_partkey AS id, trim(replace('<' || p_name || '> ' || p_brand, '&', '&')) AS title, strftime(DATE '1998-01-01' + p_size::INT, '%Y%m%d') AS day, p_size AS size FROM part""")
def announcement_titles(spark, d):
    """Titles without highlighting and references, days as compact text, and a round trip of a column through JSON."""
    p = V.table(spark, d, "part")
    raw = F.concat(F.lit(" <em>&lt;"), "p_name", F.lit("</em>&gt; <EM class='x'>"), "p_brand", F.lit("</EM>&nbsp;"))
    day = F.date_add(F.lit("1998-01-01").cast("date"), F.col("p_size").cast("int"))
    packed = F.to_json(F.struct("p_size"))
    return p.select(F.col("p_partkey").alias("id"), X.clean_title(raw).alias("title"), X.compact_date(day).alias("day"), F.from_json(packed, "p_size long")["p_size"].alias("size"))


# market pages

_PCT = "h AS (SELECT ts_code, trade_date, pe_ttm FROM valuations WHERE pe_ttm IS NOT NULL), cu AS (SELECT ts_code, max_by(pe_ttm, trade_date) AS current FROM h GROUP BY 1), pc AS (SELECT ts_code, any_value(current) AS current, CASE WHEN any_value(current) > 0 THEN count(*) FILTER (WHERE pe_ttm < current) * 100.0::DOUBLE / count(*) END AS pct FROM h JOIN cu USING (ts_code) WHERE pe_ttm > 0 GROUP BY 1)"


@query(f"""WITH {_PCT}, n AS (SELECT pc.ts_code, coalesce(CASE WHEN pc.ts_code % 5 <> 0 THEN name END, pc.ts_code::VARCHAR) AS name, pct FROM pc LEFT JOIN securities USING (ts_code) WHERE pct IS NOT NULL),
  r AS (SELECT *, row_number() OVER (ORDER BY pct, ts_code) AS low, row_number() OVER (ORDER BY pct DESC, ts_code) AS high FROM n) SELECT 'lowest' AS side, low AS place, ts_code, name, round(pct, 6) AS pct FROM r WHERE low <= 10 UNION ALL SELECT 'highest', high, ts_code, name, round(pct, 6) FROM r WHERE high <= 10""")
def extreme_percentiles(spark, d):
    """The ten lowest and highest percentiles of the market; a code stands in for a missing name."""
    names = V.securities(spark, d).select("ts_code", F.when(F.col("ts_code") % 5 != 0, F.col("name")).alias("name"))
    found = percentiles.percentile(V.valuations(spark, d), ["ts_code"], "pe_ttm").where("pct is not null").join(names, "ts_code", "left")
    return compare.extremes(found.withColumn("name", F.coalesce("name", F.col("ts_code").cast("string"))), "pct", "ts_code", 10).select("side", "place", "ts_code", "name", _r("pct").alias("pct"))


@query(f"""WITH {_PCT}, r AS (SELECT pc.*, industry, row_number() OVER (PARTITION BY industry ORDER BY pct NULLS LAST, ts_code) AS place, count(pct) OVER (PARTITION BY industry) AS ranked FROM pc JOIN securities USING (ts_code))
  SELECT ts_code, industry, CASE WHEN pct IS NOT NULL THEN place END AS place, ranked, round(pct, 6) AS pct FROM r""")
def industry_ranks(spark, d):
    """Each security's place by percentile in its industry, out of those that have one."""
    rows = percentiles.percentile(V.valuations(spark, d), ["ts_code"], "pe_ttm").join(V.securities(spark, d).select("ts_code", "industry"), "ts_code")
    return compare.ranked(rows, ["industry"], "pct", "ts_code").select("ts_code", "industry", "place", "ranked", _r("pct").alias("pct"))


@query(f"""WITH {_PCT}, m AS (SELECT ts_code, median(pe_ttm) AS med FROM h WHERE pe_ttm > 0 GROUP BY 1) SELECT industry, count(*) AS securities, count(pct) AS priced, round(median(med), 6) AS median_of_medians, round(sum(CASE WHEN current > 0 THEN current END), 4) AS total
  FROM securities LEFT JOIN pc USING (ts_code) LEFT JOIN m USING (ts_code) GROUP BY 1""")
def industry_summary(spark, d):
    """Per industry: securities, those with a percentile, the median of their medians and the sum of their current values."""
    p = percentiles.percentile(V.valuations(spark, d), ["ts_code"], "pe_ttm")
    rows = V.securities(spark, d).select("ts_code", "industry").join(p, "ts_code", "left")
    return rows.groupBy("industry").agg(
        F.count(F.lit(1)).alias("securities"), F.count("pct").alias("priced"), _r(F.median("median")).alias("median_of_medians"), _r(F.sum(F.when(F.col("current") > 0, F.col("current"))), 4).alias("total")
    )


@query(f"""WITH {_PCT}, w AS (SELECT t.ts_code, t.threshold, pct FROM (SELECT p_partkey AS ts_code, (p_size + 10)::DOUBLE AS threshold FROM part WHERE p_size <= 25 UNION ALL SELECT 999999999, 50.0) t LEFT JOIN pc USING (ts_code))
  SELECT count(*) AS watched, count_if(pct < threshold) AS alerted, count_if(pct IS NULL) AS missing, round(median(pct), 6) AS median_pct FROM w""")
def watch_list(spark, d):
    """How many watched securities are below their own threshold or without a percentile, and the median."""
    watched = V.table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("ts_code"), (F.col("p_size") + 10).cast("double").alias("threshold"))
    watched = watched.unionAll(spark.createDataFrame([(999999999, 50.0)], "ts_code long, threshold double"))
    out = compare.watch(watched, percentiles.percentile(V.valuations(spark, d), ["ts_code"], "pe_ttm").select("ts_code", "pct"), "ts_code", "pct")
    return out.withColumn("median_pct", _r("median_pct"))

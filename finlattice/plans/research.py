"""Queries over statements, factors, screens and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import factors, preprocess, screener, tables
from ..operators import point_in_time as pit
from ..sources import views as V
from .registry import query

_r = lambda c, n=6: F.round(c, n)
DAY = "1999-12-31"
_CS = f"cs AS (SELECT * FROM fundamentals WHERE available_date <= DATE '{DAY}' QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY report_period DESC, available_date DESC, source DESC) = 1)"


@query(f"WITH {_CS} SELECT ts_code, report_period, available_date, source, round(revenue, 2) AS revenue FROM cs")
def statements_as_of(spark, d):
    """Latest visible statement of every company on a day."""
    return pit.cross_section(V.fundamentals(spark, d), DAY).select("ts_code", "report_period", "available_date", "source", _r("revenue", 2).alias("revenue"))


_YOY = """b AS (SELECT ts_code, source, (report_period + INTERVAL 12 MONTH)::DATE AS report_period, max(revenue) AS prev FROM fundamentals GROUP BY ALL)"""


@query(f"WITH {_YOY} SELECT ts_code, source, report_period, round((revenue - prev) / nullif(abs(prev), 0), 6) AS revenue_yoy FROM fundamentals LEFT JOIN b USING (ts_code, source, report_period)")
def year_on_year(spark, d):
    out = pit.with_previous_year(V.fundamentals(spark, d), ["ts_code", "source"], ["revenue"])
    return out.select("ts_code", "source", "report_period", _r(N.growth("revenue", "revenue_prev")).alias("revenue_yoy"))


@query("""SELECT ts_code, report_period, source, round((revenue - cost) / nullif(revenue, 0), 6) AS gross_margin, round(profit / nullif(revenue, 0), 6) AS net_margin,
  round(revenue * 0.2 * (1 - CASE WHEN profit <= 0 THEN 0 ELSE tax / nullif(profit, 0) END) / nullif(shares + cost, 0), 6) + 0.0 AS roic FROM fundamentals""")
def statement_ratios(spark, d):
    f = V.fundamentals(spark, d)
    roic = N.return_on_invested_capital(F.col("revenue") * 0.2, "tax", "profit", "shares", "cost")
    return f.select("ts_code", "report_period", "source", _r(N.safe_divide(F.col("revenue") - F.col("cost"), "revenue")).alias("gross_margin"), _r(N.safe_divide("profit", "revenue")).alias("net_margin"), (_r(roic) + F.lit(0.0)).alias("roic"))


def frame(spark, d):
    """One row per security alive on the day: visible statement, last valuation and momentum, as the factors want them."""
    universe = pit.universe(V.securities(spark, d), DAY).select("ts_code", "industry")
    cs = pit.cross_section(V.fundamentals(spark, d), DAY).select("ts_code", "revenue", "cost", "profit", "shares")
    val = V.valuations(spark, d).where(F.col("trade_date") <= F.lit(DAY).cast("date"))
    val = val.groupBy("ts_code").agg(F.max_by("pe_ttm", "trade_date").alias("pe_ttm"), F.max_by("pb", "trade_date").alias("pb"), F.max_by("ps", "trade_date").alias("ps"))
    ret = pit.anchors(V.daily_prices(spark, d), DAY, {"ret_3m": 90, "ret_6m": 180}).drop("last_close")
    rows = universe.join(cs, "ts_code", "left").join(val, "ts_code", "left").join(ret, "ts_code", "left")
    rows = rows.withColumns({
        "roe": N.safe_divide("profit", "shares"), "gross_margin": N.safe_divide(F.col("revenue") - F.col("cost"), "revenue"), "total_mv": F.col("pb") * F.col("shares"),
        "net_profit": F.col("profit"), "cfo": F.col("profit") + F.col("cost") / 10, "interest_bearing_debt": F.col("cost"), "equity": F.col("shares") * 10,
    })
    return factors.with_absent_inputs(rows)


_FRAME = f"""{_CS}, val AS (SELECT ts_code, max_by(pe_ttm, trade_date) AS pe_ttm, max_by(pb, trade_date) AS pb, max_by(ps, trade_date) AS ps FROM valuations WHERE trade_date <= DATE '{DAY}' GROUP BY 1),
  anc AS (SELECT ts_code, max_by(close, trade_date) AS c, max_by(close, trade_date) FILTER (WHERE trade_date <= DATE '{DAY}' - 90) AS c3, max_by(close, trade_date) FILTER (WHERE trade_date <= DATE '{DAY}' - 180) AS c6
    FROM daily_prices WHERE trade_date <= DATE '{DAY}' AND trade_date >= DATE '{DAY}' - 400 GROUP BY 1),
  frame AS (SELECT u.ts_code, u.industry, pe_ttm, pb, ps, c / c3 - 1 AS momentum_3m, c / c6 - 1 AS momentum_6m, profit / nullif(shares, 0) AS roe, (revenue - cost) / nullif(revenue, 0) AS gross_margin, pb * shares AS total_mv,
    (profit + cost / 10) / nullif(profit, 0) AS cfo_to_net_profit, cost / nullif(shares * 10, 0) AS debt_to_equity
    FROM securities u LEFT JOIN cs USING (ts_code) LEFT JOIN val USING (ts_code) LEFT JOIN anc USING (ts_code) WHERE (list_date IS NULL OR list_date <= DATE '{DAY}') AND (delist_date IS NULL OR delist_date > DATE '{DAY}'))"""
_NAMES = ("pe_ttm", "pb", "ps", "roe", "gross_margin", "cfo_to_net_profit", "debt_to_equity", "momentum_3m", "momentum_6m")


@query(f"WITH {_FRAME} SELECT ts_code, industry, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM frame")
def factor_frame(spark, d):
    return factors.compute(frame(spark, d)).select("ts_code", "industry", *(_r(n).alias(n) for n in _NAMES))


@query(f"""WITH {_FRAME}, u AS (UNPIVOT (SELECT {', '.join(f'(count({n}) * 100.0 / count(*))::DOUBLE AS {n}' for n in (*_NAMES, ))}, 0::DOUBLE AS ev_ebitda FROM frame) ON COLUMNS(*) INTO NAME factor VALUE coverage)
  SELECT factor, round(coverage, 6) AS coverage, CASE WHEN coverage >= 50 THEN 'ready' WHEN coverage > 0 THEN 'sparse' ELSE 'none' END AS tier FROM u""")
def factor_coverage(spark, d):
    return factors.coverage(factors.compute(frame(spark, d)), [*_NAMES, "ev_ebitda"]).withColumn("coverage", _r("coverage"))


@query(f"""WITH {_FRAME}, q AS (SELECT quantile_cont(pe_ttm, 0.05) AS a, quantile_cont(pe_ttm, 0.95) AS b FROM frame), w AS (SELECT ts_code, industry, total_mv, CASE WHEN pe_ttm IS NOT NULL THEN least(greatest(pe_ttm, a), b) END AS x FROM frame, q),
  z AS (SELECT *, (x - avg(x) OVER ()) / nullif(stddev_samp(x) OVER (), 0) AS z FROM w)
  SELECT ts_code, round(x, 6) AS winsorized, round(z, 6) AS zscore, round(z - avg(z) OVER (PARTITION BY trim(industry)), 6) AS neutral FROM z""")
def preprocessed_factor(spark, d):
    f = frame(spark, d).select("ts_code", "industry", "pe_ttm")
    w = preprocess.winsorize(f, ["pe_ttm"], 0.05, 0.05).withColumn("z", F.col("pe_ttm"))
    z = preprocess.zscore(w, ["z"]).withColumn("n", F.col("z"))
    return preprocess.neutralize_groups(z, ["n"], "industry").select("ts_code", _r("pe_ttm").alias("winsorized"), _r("z").alias("zscore"), _r("n").alias("neutral"))


@query(f"""WITH {_FRAME}, g AS (SELECT regr_slope(roe, ln(total_mv)) AS b, regr_intercept(roe, ln(total_mv)) AS a FROM frame WHERE total_mv > 0)
  SELECT ts_code, round(CASE WHEN total_mv > 0 THEN roe - (a + b * ln(total_mv)) END, 4) AS residual FROM frame, g""")
def size_neutral_factor(spark, d):
    out = preprocess.neutralize_size(frame(spark, d).select("ts_code", "roe", "total_mv"), ["roe"], "total_mv")
    return out.select("ts_code", _r("roe", 4).alias("residual"))


@query(f"""WITH {_FRAME} SELECT ts_code, round(CASE WHEN gross_margin IS NOT NULL THEN (rank() OVER (PARTITION BY industry, gross_margin IS NULL ORDER BY gross_margin) + (count(*) OVER (PARTITION BY industry, gross_margin) - 1) / 2.0) / count(gross_margin) OVER (PARTITION BY industry) END, 6) AS pct_rank,
  round(coalesce(gross_margin, median(gross_margin) OVER (PARTITION BY industry)), 6) AS filled FROM frame""")
def ranked_factor(spark, d):
    f = frame(spark, d).select("ts_code", "industry", "gross_margin").withColumn("r", F.col("gross_margin"))
    out = preprocess.fill_missing(preprocess.rank(f, "r", ["industry"]), ["gross_margin"], "median", by=["industry"])
    return out.select("ts_code", _r("r").alias("pct_rank"), _r("gross_margin").alias("filled"))


SCREEN = {"all": [{"field": "pe_ttm", "op": "lt", "value": 100}, {"any": [{"field": "gross_margin", "op": "gt", "value": 0.6}, {"field": "momentum_6m", "op": "ge", "value": 0.5}]}, {"field": "roe", "op": "notna"}]}
_RULES = (("pe_ttm gt 0", "pe_ttm > 0", "pe_ttm"), ("pe_ttm lt 100", "pe_ttm < 100", "pe_ttm"), ("gross_margin gt 0.6", "gross_margin > 0.6", "gross_margin"), ("momentum_6m ge 0.5", "momentum_6m >= 0.5", "momentum_6m"), ("roe notna", "roe IS NOT NULL", "roe"))
_OK = [f"coalesce({t}, false)" for _, t, _ in _RULES]
_PASS = f"({_OK[0]} AND {_OK[1]} AND ({_OK[2]} OR {_OK[3]}) AND {_OK[4]})"


def _screened(spark, d):
    return factors.compute(frame(spark, d)).select("ts_code", "industry", *_NAMES), screener.with_positive_guard(SCREEN)


@query(f"WITH {_FRAME} SELECT ts_code, {_PASS} AS passed, list_filter([{', '.join(f'CASE WHEN NOT {o} THEN {chr(39)}{t}{chr(39)} END' for o, (t, _, _) in zip(_OK, _RULES))}], lambda x: x IS NOT NULL) AS failed_rules FROM frame")
def screen_summary(spark, d):
    return screener.summary(*_screened(spark, d))


@query(f"WITH {_FRAME} " + " UNION ALL ".join(f"SELECT ts_code, {k} AS rule, '{t}' AS text, round({c}, 6) AS value, {o} AS passed, printf('%.6g', {c}) AS shown, CASE WHEN {c} IS NULL THEN 'no data' WHEN {o} THEN 'satisfied' ELSE 'not satisfied' END AS explanation FROM frame" for k, ((t, _, c), o) in enumerate(zip(_RULES, _OK))))
def screen_detail(spark, d):
    return screener.detail(*_screened(spark, d)).withColumn("value", _r("value"))


@query(f"WITH {_FRAME} " + " UNION ALL ".join(f"SELECT {k} AS rule, '{t}' AS text, count_if({o}) AS passed, count(*) - count_if({o}) AS failed FROM frame" for k, ((t, _, _), o) in enumerate(zip(_RULES, _OK))))
def screen_funnel(spark, d):
    return screener.funnel(*_screened(spark, d))


@query(f"WITH {_FRAME} SELECT industry, count(*) AS n, count_if({_PASS}) AS passed, count_if({_PASS}) * 100.0::DOUBLE / count(*) AS rate FROM frame GROUP BY 1 HAVING count(*) >= 5 ORDER BY rate DESC, industry LIMIT 20")
def screen_pass_rates(spark, d):
    return screener.pass_rates(*_screened(spark, d))


@query("""WITH a AS (SELECT p_partkey AS k, p_retailprice AS price, p_size AS size FROM part WHERE p_size <= 40), b AS (SELECT p_partkey AS k, p_retailprice + CASE WHEN p_size > 30 THEN 1 ELSE 0 END AS price, p_size AS size FROM part WHERE p_size >= 10)
  SELECT k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS kind, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN ['price'] END AS columns
  FROM a FULL JOIN b USING (k) WHERE a.k IS NULL OR b.k IS NULL OR abs(a.price - b.price) > 1e-9""")
def snapshot_difference(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    after = p.where("size >= 10").withColumn("price", F.col("price") + F.when(F.col("size") > 30, 1).otherwise(0))
    return tables.difference(p.where("size <= 40"), after, ["k"], ["price", "size"])


@query("""SELECT coalesce(t.k, s.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.price ELSE t.price END AS price, coalesce(t.name, s.name) AS name FROM (SELECT p_partkey AS k, p_retailprice AS price, p_name AS name FROM part WHERE p_size <= 25) t
  FULL JOIN (SELECT p_partkey AS k, p_retailprice * 2 AS price, upper(p_name) AS name FROM part WHERE p_size >= 20) s ON t.k = s.k""")
def upserted(spark, d):
    """Only the price of rows that are there is taken over; new rows come whole."""
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"), "p_size")
    source = p.where("p_size >= 20").select("k", (F.col("price") * 2).alias("price"), F.upper("name").alias("name"))
    return tables.upsert(p.where("p_size <= 25").drop("p_size"), source, ["k"], ["price"])


@query("SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) GROUP BY 1")
def inserted_new(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    there = e.where("event_type = 'error' and value > 60").select("user_id").distinct()
    return tables.insert_new(there, e.where("event_type <> 'error'"), ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("""SELECT p_partkey AS ts_code, 100 * (p_retailprice - 900) AS raw, round(2.5 + 2.5 + CASE WHEN t > 0 THEN 10 ELSE 0 END + 2.5 * sqrt(least(t, 0.5) / 0.1), 6) AS bps, greatest(p_retailprice * 100 * 0.00025, 5) + p_retailprice * 100 * 0.0005 AS sale_cost,
  round(greatest(0, least(1, 0.4 * least(t, 1) + 0.3 * least(abs(t - 0.5), 1) - 0.2 * least(abs(t) * 5, 0.2) + 0.1)), 6) AS confidence FROM (SELECT *, p_size / 50.0::DOUBLE AS t FROM part)""")
def cost_models(spark, d):
    p = V.table(spark, d, "part").withColumn("t", F.col("p_size") / 50.0)
    score = N.confidence_score("t", F.col("t") - 0.5, "t", F.lit(True))
    return p.select(F.col("p_partkey").alias("ts_code"), (100 * (F.col("p_retailprice") - 900)).alias("raw"), _r(N.switching_cost_bps("t")).alias("bps"), N.trade_cost(F.lit("SELL"), F.col("p_retailprice") * 100).alias("sale_cost"), _r(score).alias("confidence"))

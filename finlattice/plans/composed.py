"""Queries that put several operators together: screens with preprocessing, adjusted prices, registers of investors, details of one key."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import pages, percentiles, portfolio, screener, search, style
from ..operators import point_in_time as pit
from ..sources import normalize
from ..sources import views as V
from ..sources.shared import new_folder
from ..streaming import events as E
from . import corpus, research
from .registry import query

_r = lambda c, n=6: F.round(c, n)

_SPEC = {"preprocess": [("winsorize", {"columns": ["roe", "gross_margin"], "lower": 0.05, "upper": 0.05}), ("zscore", {"columns": ["roe"]})], "rules": {"all": [{"field": "roe", "op": "gt", "value": 0.25}, {"any": [{"field": "gross_margin", "op": "lt", "value": 0.55}, {"field": "pe_ttm", "op": "isna"}]}]}, "factors": ["pb"]}
_PREPARED = f"""{research._FRAME}, q AS (SELECT quantile_cont(roe, 0.05) AS ra, quantile_cont(roe, 0.95) AS rb, quantile_cont(gross_margin, 0.05) AS ga, quantile_cont(gross_margin, 0.95) AS gb FROM frame),
  w AS (SELECT ts_code, pe_ttm, pb, CASE WHEN roe IS NOT NULL THEN least(greatest(roe, ra), rb) END AS r, CASE WHEN gross_margin IS NOT NULL THEN least(greatest(gross_margin, ga), gb) END AS gross_margin FROM frame, q),
  z AS (SELECT *, (r - avg(r) OVER ()) / nullif(stddev_samp(r) OVER (), 0) AS roe FROM w), t AS (SELECT *, coalesce(roe > 0.25, false) AS a, coalesce(gross_margin < 0.55, false) AS b, pe_ttm IS NULL AS c FROM z)"""


def _run(spark, d):
    frame, _ = research._screened(spark, d)
    return screener.run(frame, _SPEC)


@query(f"WITH {_PREPARED}, s AS (SELECT *, row_number() OVER (ORDER BY roe DESC NULLS LAST, ts_code) AS n FROM t) SELECT ts_code, round(roe, 6) AS roe, round(gross_margin, 6) AS gross_margin, round(pe_ttm, 6) AS pe_ttm, round(pb, 6) AS pb, a AND (b OR c) AS passed, list_filter([CASE WHEN NOT a THEN 'roe gt 0.25' END, CASE WHEN NOT b THEN 'gross_margin lt 0.55' END, CASE WHEN NOT c THEN 'pe_ttm isna' END], lambda x: x IS NOT NULL) AS failed_rules FROM s WHERE n <= 300")
def prepared_screen(spark, d):
    """A screen over winsorised and standardised factors: the first page by one of them."""
    out = pages.page(_run(spark, d)["summary"], ["-roe"], "ts_code", 300)
    return out.select("ts_code", *(_r(c).alias(c) for c in ("roe", "gross_margin", "pe_ttm", "pb")), "passed", "failed_rules")


@query(f"WITH {_PREPARED} SELECT count(*) AS total, count_if(a AND (b OR c)) AS passed, count_if(NOT (a AND (b OR c))) AS failed FROM t")
def screen_counts(spark, d):
    return _run(spark, d)["counts"]


@query(f"WITH {_PREPARED} SELECT ts_code FROM t WHERE a AND (b OR c)")
def screened_codes(spark, d):
    return _run(spark, d)["codes"]


@query("SELECT ts_code, report_period, available_date, source, round(revenue, 2) AS revenue FROM fundamentals WHERE ts_code = 11 AND available_date <= DATE '1998-06-30' ORDER BY available_date DESC, report_period DESC, source DESC LIMIT 1")
def statement_of_one(spark, d):
    """One company's last statement by a day."""
    out = pit.latest_of(V.fundamentals(spark, d), "ts_code", 11, "1998-06-30", order=("report_period", "source"))
    return out.select("ts_code", "report_period", "available_date", "source", _r("revenue", 2).alias("revenue"))


@query("""WITH e AS (SELECT ts_code, trade_date, 1 + row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) * 0.13::DOUBLE AS factor FROM daily_prices WHERE ts_code % 2 = 0 AND day(trade_date) = 15),
  s AS (SELECT p.ts_code, p.trade_date, p.close, coalesce(e.factor, 1.0) AS factor FROM daily_prices p ASOF LEFT JOIN e ON e.ts_code = p.ts_code AND e.trade_date <= p.trade_date), l AS (SELECT ts_code, max_by(factor, trade_date) AS last FROM s GROUP BY 1)
  SELECT ts_code, trade_date, factor, abs(close * factor / last - round(close * factor / last, 4)) < 0.00005001 AS near, round(close * factor * 1.0000000001::DOUBLE, 6) AS backward FROM s JOIN l USING (ts_code)""")
def adjusted_prices(spark, d):
    """Closes adjusted by factors that step up at events."""
    p = V.daily_prices(spark, d).select("ts_code", "trade_date", "close")
    e = p.where("ts_code % 2 = 0 and dayofmonth(trade_date) = 15").select("ts_code", "trade_date", (1 + F.row_number().over(Window.partitionBy("ts_code").orderBy("trade_date")) * F.lit(0.13)).alias("factor"))
    out = pit.adjusted(p, e)
    last = out.groupBy("ts_code").agg(F.max_by("factor", "trade_date").alias("last"))
    out = out.join(last, "ts_code")
    return out.select("ts_code", "trade_date", "factor", (F.abs(F.col("close") * F.col("factor") / F.col("last") - F.col("forward")) < 0.00005001).alias("near"), _r(F.col("close") * F.col("factor") * 1.0000000001).alias("backward"))


_SELECTED = "m AS (SELECT trade_date, median(pe_ttm) AS v FROM valuations JOIN part ON p_partkey = ts_code WHERE p_brand = 'Brand#13' GROUP BY 1)"


@query(f"WITH {_SELECTED}, c AS (SELECT max_by(v, trade_date) AS cur FROM m) SELECT trade_date, round(v, 4) AS v, round(CASE WHEN trade_date = (SELECT max(trade_date) FROM m) AND (SELECT cur FROM c) > 0 THEN (SELECT 100.0 * count_if(v < cur) / count(*) FROM m, c WHERE v > 0) END, 2) AS pct FROM m")
def index_detail(spark, d):
    """One index: its whole series of medians, with the percentile beside the last day."""
    members = V.table(spark, d, "part").where("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("ts_code"), F.lit("Brand#13").alias("index_code"))
    m = V.valuations(spark, d).join(members, "ts_code").groupBy("index_code", "trade_date").agg(F.median("pe_ttm").alias("v"))
    p = percentiles.percentile(m, ["index_code"], "v").select("index_code", F.col("as_of").alias("trade_date"), "pct")
    return m.join(p, ["index_code", "trade_date"], "left").select("trade_date", _r("v", 4).alias("v"), _r("pct", 2).alias("pct"))


@query("""WITH s AS (SELECT s_suppkey AS stock, CASE WHEN s_suppkey % 3 <> 0 THEN r_name END AS l1, n_name AS l2, r_name AS parent FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT stock, coalesce(l1, parent) AS l1, l2 FROM s""")
def stock_sector_map(spark, d):
    """Sectors of stocks of two levels; the parent of the second stands in for a missing first."""
    s, n, r = (V.table(spark, d, t) for t in ("supplier", "nation", "region"))
    named = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = s.join(F.broadcast(named), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("stock"), F.when(F.col("s_suppkey") % 3 != 0, F.col("r_name")).alias("l1"), F.col("n_name").alias("l2"))
    return normalize.back_filled_mapping(leaves, named.select(F.col("n_name").alias("code"), F.col("r_name").alias("parent")))


_EVENTS = "ev AS (SELECT DISTINCT * FROM (SELECT ts_code, list_date AS event_date, 'LISTED' AS event_type FROM securities UNION ALL SELECT ts_code, delist_date, 'DELISTED' FROM securities) WHERE event_date IS NOT NULL)"


@query(f"WITH {_EVENTS} SELECT ts_code, event_date, event_type FROM ev WHERE event_date <= DATE '2001-03-31' AND event_type = 'DELISTED'")
def lifecycle_event_rows(spark, d):
    """Delistings by a day, from calendars of listings and delistings."""
    s = V.securities(spark, d)
    return search.events(normalize.lifecycle_events(s.select("ts_code", "list_date"), s.select("ts_code", "delist_date").unionAll(s.where("ts_code % 2 = 0").select("ts_code", "delist_date"))), None, "2001-03-31", "DELISTED")


@query("""SELECT n_nationkey::VARCHAR AS investor_code, n_name AS name, n_name || ' Co,' || lower(n_name) AS aliases, CASE WHEN n_regionkey > 0 THEN 'region ' || n_regionkey::VARCHAR END AS role, CASE WHEN n_nationkey % 2 = 0 THEN 'value' END AS style_tags, CASE WHEN n_nationkey % 3 = 0 THEN 'https://x/' || n_nationkey::VARCHAR END AS profile_url, n_nationkey % 5 <> 1 AS is_active,
  TIMESTAMP '2024-01-02' AS created_time FROM nation WHERE n_nationkey % 7 <> 6""")
def investor_register(spark, d):
    """A register of investors with tags, spaces, references and rows without a name."""
    n, k = V.table(spark, d, "nation"), F.col("n_nationkey")
    raw = n.select(
        F.concat(F.lit(" "), k.cast("string")).alias("investor_code"), F.when(k % 7 == 6, " <br> ").otherwise(F.concat(F.lit("<b>"), "n_name", F.lit("</b>&nbsp; "))).alias("name"), F.array(F.concat("n_name", F.lit(" Co")), F.lit(" "), F.lower("n_name")).alias("aliases"),
        F.when(F.col("n_regionkey") > 0, F.concat(F.lit("region  "), F.col("n_regionkey").cast("string"))).alias("role"), F.when(k % 2 == 0, " value ").otherwise(" ").alias("style_tags"), F.when(k % 3 == 0, F.concat(F.lit("https://x/"), k.cast("string"))).otherwise("x").alias("profile_url"), F.when(k % 5 == 1, "no").when(k % 5 == 2, "1").alias("is_active"),
    )
    return normalize.investors(raw.unionAll(raw), "2024-01-02 00:00:00").withColumn("created_time", F.col("created_time").cast("timestamp_ntz"))


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'id' || c_custkey::VARCHAR WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'guba' ELSE 'manual' END || ':u' || c_custkey::VARCHAR ELSE CASE WHEN c_custkey % 2 = 0 THEN 'guba' ELSE 'manual' END || ':' || c_name END AS account_id, c_nationkey::VARCHAR AS investor_code,
  CASE WHEN c_custkey % 2 = 0 THEN 'guba' ELSE 'manual' END AS platform, c_name AS account_name, CASE WHEN c_custkey % 3 = 1 THEN 'u' || c_custkey::VARCHAR END AS account_uid, NULL::VARCHAR AS home_url, true AS is_enabled FROM customer WHERE c_nationkey <> 4""")
def investor_account_register(spark, d):
    c, k = V.table(spark, d, "customer"), F.col("c_custkey")
    raw = c.select(
        F.when(F.col("c_nationkey") != 4, F.col("c_nationkey")).alias("investor_code"), F.when(k % 2 == 0, "guba").alias("platform"), F.concat(F.lit("  "), "c_name").alias("account_name"), F.when(k % 3 == 1, F.concat(F.lit("u"), k.cast("string"))).alias("account_uid"),
        F.when(k % 3 == 0, F.concat(F.lit("id"), k.cast("string"))).alias("account_id"), F.lit("nowhere").alias("home_url"), F.lit(None).cast("string").alias("is_enabled"),
    )
    return normalize.investor_accounts(raw, "manual")


@query("""SELECT o_custkey AS code, strftime(max(o_orderdate), '%Y-%m-%d') AS as_of, list(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ORDER BY o_orderkey) AS times, count(*) AS n FROM orders GROUP BY 1""")
def dated_payloads(spark, d):
    """Nested rows with their days and times as text."""
    o = V.table(spark, d, "orders")
    rows = o.groupBy(F.col("o_custkey").alias("code")).agg(F.struct(F.max("o_orderdate").cast("date").alias("as_of"), F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("o_orderdate").alias("t")))).alias("rows")).alias("payload"), F.count(F.lit(1)).alias("n"))
    return X.iso_payload(rows).select("code", "payload.as_of", F.transform("payload.rows", lambda r: r["t"]).alias("times"), "n")


@query("""WITH h AS (SELECT c_mktsegment AS fund, report_date AS end_date, l1 AS sector, sum(market_value) AS mv FROM holdings JOIN sectors USING (stock) JOIN customer ON c_custkey = fund GROUP BY ALL), e AS (SELECT fund, end_date, sector, mv / sum(mv) OVER (PARTITION BY fund, end_date) AS x FROM h),
  l AS (SELECT *, x - lag(x, 1) OVER w AS c1, x - lag(x, 5) OVER w AS c5, x - lag(x, 20) OVER w AS c20 FROM e WINDOW w AS (PARTITION BY fund, sector ORDER BY end_date))
  SELECT fund, end_date, sector, round(x, 6) AS exposure, round(c1, 6) AS change_1step, round(c5, 6) AS change_5step, round(c20, 6) AS change_20step, CASE WHEN c1 >= 0.05 THEN 'strong_increase' WHEN c1 >= 0.02 THEN 'increase' WHEN c1 >= 0.005 THEN 'slight_increase' WHEN c1 <= -0.05 THEN 'strong_decrease' WHEN c1 <= -0.02 THEN 'decrease' WHEN c1 <= -0.005 THEN 'slight_decrease' WHEN c1 IS NOT NULL THEN 'neutral' END AS signal,
  round(sum(abs(c1)) OVER (PARTITION BY fund, end_date) / 2, 6) AS turnover FROM l""")
def exposure_signals(spark, d):
    """Exposures of segments' holdings against 1, 5 and 20 reports before, with signals and turnover."""
    held = V.segment_holdings(spark, d).select(F.col("segment").alias("fund"), F.col("report_date").alias("end_date"), "stock", "market_value")
    e = portfolio.sector_weights(held, V.sectors(spark, d), ["fund", "end_date"], weight="market_value").select("fund", "end_date", "sector", F.col("weight").alias("exposure"))
    out = style.signals(e)
    return out.select("fund", "end_date", "sector", *(_r(x).alias(x) for x in ("exposure", "change_1step", "change_5step", "change_20step")), "signal", _r("turnover").alias("turnover"))


@query(f"""WITH {corpus._CLEAN_SQL}, q AS (SELECT conv_id, turn, clean, {corpus._HASH_SQL} AS content_hash FROM c WHERE length(clean) >= 4),
  n AS (SELECT CASE WHEN turn % 2 = 0 THEN 'guba' ELSE 'manual' END AS platform, CASE WHEN turn % 3 = 0 THEN conv_id::VARCHAR || '-' || turn::VARCHAR ELSE 'h' || left(content_hash, 16) END AS own, turn, conv_id, content_hash FROM q)
  SELECT platform || ':' || own AS quote_id, conv_id::VARCHAR AS investor_code, platform, content_hash, CASE WHEN platform = 'manual' THEN CASE WHEN conv_id % 2 = 0 THEN 'checked' ELSE 'unverified' END ELSE 'unverified' END AS verification, CASE WHEN conv_id % 2 = 0 THEN 'https://x/' || turn::VARCHAR END AS source_url
  FROM n QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY platform || ':' || own DESC) = 1""")
def quote_rows(spark, d):
    """Conversation turns as stored quotes: long enough, with ids of their own or of their content, one per content; of turns with one id the first conversation's stays."""
    c = V.table(spark, d, "conversations")
    raw = c.select(
        F.col("conv_id").cast("string").alias("investor_code"), F.when(F.col("turn") % 2 == 0, "guba").otherwise("manual").alias("platform"), F.when(F.col("turn") % 3 == 0, F.concat_ws("-", "conv_id", "turn")).alias("platform_id"), F.col("text").alias("content"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("https://x/"), F.col("turn").cast("string"))).otherwise("x").alias("source_url"), F.lit("2024-01-02 03:04:05").alias("published_at"), F.when(F.col("conv_id") % 2 == 0, "checked").alias("verification"), "conv_id", "turn",
    )
    return normalize.quotes(raw, ["conv_id", "turn"]).select("quote_id", "investor_code", "platform", "content_hash", "verification", "source_url")


@query("""WITH f AS (SELECT * FROM events WHERE event_id % 3 <> 0 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)) SELECT event_id, user_id, event_type, value FROM f UNION ALL SELECT event_id, user_id, event_type, value FROM events WHERE ts > (SELECT max(ts) FROM f)""")
def appended_events(spark, d):
    """Events that came in two loads: the first twice, the second from the first one's last time on, by day partitions."""
    e = V.table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    bounds = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    path = new_folder(spark, "appended")
    write = E.append_new(path, ["event_id", "day"], "day")
    first = e.where((F.col("event_id") % 3 != 0) & (F.col("ts") < F.lit(bounds["a"] + (bounds["b"] - bounds["a"]) / 2)))
    write(first, 0)
    write(first, 0)
    loaded = spark.read.schema(e.schema).parquet(path)
    last = loaded.agg(F.max("ts")).first()[0]
    write(E.since(e, "ts", F.lit(last)), 1)
    return spark.read.schema(e.schema).parquet(path).select("event_id", "user_id", "event_type", "value")

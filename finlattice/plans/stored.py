"""Queries that read back what was stored: writes by key, kept results, parsed responses, postings, and pages by cursor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, benchmarks, cache, commodities, investors, lookups, pages, percentiles, portfolio, screener, search
from ..sources import responses
from ..sources import views as V
from ..sources.shared import keep, new_folder
from ..sources.store import SPECS, KeyedTable
from . import research
from .market import _LEVEL, _PCT
from .registry import query

_r = lambda c, n=6: F.round(c, n)


@query("""SELECT ts_code, trade_date, round(CASE WHEN ts_code % 4 = 0 AND year(trade_date) IN (1996, 1997) THEN close * 2 ELSE close END, 9) AS close, CASE WHEN ts_code % 4 = 0 AND year(trade_date) IN (1996, 1997) AND ts_code % 3 <> 0 THEN volume WHEN ts_code % 3 <> 0 THEN volume END AS volume
  FROM daily_prices WHERE ts_code % 3 <> 0 OR (ts_code % 4 = 0 AND year(trade_date) IN (1996, 1997))""")
def stored_prices(spark, d):
    """Prices by year, of which a second write changes two years and adds codes; its rows have no volume, so a known one stays."""
    p = V.daily_prices(spark, d).select("ts_code", "trade_date", "close", "volume")
    table = KeyedTable(spark, new_folder(spark, "prices"), p.schema, SPECS["daily_prices"])
    table.upsert(p.where("ts_code % 3 <> 0"))
    table.upsert(p.where("ts_code % 4 = 0 and year(trade_date) in (1996, 1997)").select("ts_code", "trade_date", (F.col("close") * 2).alias("close")))
    return table.read().withColumn("close", _r("close", 9))


@query("""SELECT ts_code, CASE WHEN ts_code % 5 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN ts_code % 5 = 0 THEN NULL ELSE industry END AS industry, list_date, delist_date,
  CASE WHEN delist_date <= DATE '2001-01-01' THEN 'DELISTED' WHEN list_date > DATE '2001-01-01' THEN 'PRE_LIST' ELSE 'LISTED' END AS status FROM securities""")
def stored_securities(spark, d):
    """Names and life cycles of securities, written by two owners in turn."""
    s = V.securities(spark, d)
    status = F.when(F.col("delist_date") <= "2001-01-01", "DELISTED").when(F.col("list_date") > "2001-01-01", "PRE_LIST").otherwise("LISTED")
    schema = s.select("ts_code", "name", "industry", "market", "list_date", "delist_date", status.alias("status")).schema
    table = KeyedTable(spark, new_folder(spark, "securities"), schema, SPECS["securities"])
    table.upsert(s.select("ts_code", "name", "industry", "market"), "identity")
    table.upsert(s.select("ts_code", "list_date", "delist_date", status.alias("status")), "lifecycle")
    table.upsert(s.where("ts_code % 5 = 0").select("ts_code", F.upper("name").alias("name"), F.lit(None).cast("string").alias("industry")), "identity")
    return table.read().drop("market")


_CONSTITUENTS = """c AS (SELECT c_mktsegment AS benchmark_code, report_date AS as_of_date, stock, sum(market_value) AS weight FROM holdings JOIN customer ON c_custkey = fund WHERE c_mktsegment <> 'MACHINERY' AND (c_mktsegment <> 'HOUSEHOLD' OR report_date < DATE '2001-06-30') GROUP BY ALL),
  l AS (SELECT benchmark_code, max(as_of_date) AS as_of_date FROM c GROUP BY 1), w AS (SELECT benchmark_code, as_of_date, l1 AS sector_code, weight FROM c JOIN l USING (benchmark_code, as_of_date) LEFT JOIN sectors USING (stock)),
  t AS (SELECT benchmark_code, as_of_date, sum(weight) FILTER (WHERE sector_code IS NOT NULL) AS mapped, sum(weight) AS whole FROM w GROUP BY ALL)"""
_ASKED = [("BUILDING",), ("HOUSEHOLD",), ("MACHINERY",), ("FURNITURE",)]


def _benchmarks(spark, d):
    """Weights of three benchmarks after two were stored before, and notes on all that were asked for."""
    held = V.segment_holdings(spark, d).select(F.col("segment").alias("benchmark_code"), F.col("report_date").alias("as_of_date"), "stock", F.col("market_value").alias("weight"))
    held = keep(held.where("benchmark_code <> 'MACHINERY' and (benchmark_code <> 'HOUSEHOLD' or as_of_date < '2001-06-30')"), "constituents")
    stored, sectors = benchmarks.table(spark, new_folder(spark, "weights")), V.sectors(spark, d)
    codes = spark.createDataFrame(_ASKED, "benchmark_code string")
    benchmarks.snapshot(stored, codes.where("benchmark_code in ('BUILDING', 'HOUSEHOLD')"), held, sectors, 1, "2001-12-31")
    return benchmarks.snapshot(stored, codes, held, sectors, 1, "2002-01-31")


@query(f"WITH {_CONSTITUENTS} SELECT benchmark_code, 1 AS level, sector_code, round(sum(weight) / any_value(mapped), 6) AS weight, round(any_value(mapped / whole), 6) AS coverage, as_of_date FROM w JOIN t USING (benchmark_code, as_of_date) WHERE sector_code IS NOT NULL AND benchmark_code IN ('BUILDING', 'HOUSEHOLD', 'FURNITURE') GROUP BY benchmark_code, sector_code, as_of_date")
def benchmark_snapshots(spark, d):
    weights, _ = _benchmarks(spark, d)
    return weights.select("benchmark_code", "level", "sector_code", _r("weight").alias("weight"), _r("coverage").alias("coverage"), "as_of_date")


@query(f"""WITH {_CONSTITUENTS}, n AS (SELECT benchmark_code, as_of_date, mapped / whole AS coverage, (SELECT count(DISTINCT sector_code) FROM w WHERE w.benchmark_code = t.benchmark_code AND sector_code IS NOT NULL) AS k FROM t WHERE mapped IS NOT NULL)
  SELECT a.benchmark_code, 1 AS level, as_of_date, round(coverage, 6) AS coverage, coalesce(k, 0)::BIGINT AS sector_count, a.benchmark_code IN ('BUILDING', 'HOUSEHOLD') AS cached, a.benchmark_code IN ('BUILDING', 'HOUSEHOLD') AND datediff('day', as_of_date, DATE '2002-01-31') > 45 AS stale,
  CASE WHEN k IS NULL THEN 'no constituents' END AS reason FROM (VALUES {', '.join(f"('{c}')" for (c,) in _ASKED)}) a(benchmark_code) LEFT JOIN n USING (benchmark_code)""")
def benchmark_notes(spark, d):
    """Which weights were stored before, which are stale, and why there are none."""
    _, notes = _benchmarks(spark, d)
    return notes.withColumn("coverage", _r("coverage"))


@query("""WITH x AS (SELECT fund, report_date, l1 AS sector, sum(weight) AS w FROM holdings LEFT JOIN sectors USING (stock) GROUP BY ALL) SELECT fund, report_date, sector, round(w / sum(w) OVER (PARTITION BY fund, report_date), 6) AS weight FROM x WHERE sector IS NOT NULL""")
def kept_exposures(spark, d):
    """Exposures from the second call for the same specification and files, which reads what the first one kept."""
    kept = cache.ResultCache(spark, new_folder(spark, "kept"))
    data = cache.files_version(*(V.table(spark, d, t) for t in ("lineitem", "orders", "supplier", "nation", "region")))
    make = lambda: portfolio.sector_weights(V.holdings(spark, d), V.sectors(spark, d), ["fund", "report_date"])
    kept.get("exposure", {"level": "l1", "by": ["fund", "report_date"]}, data, make)
    out = kept.get("exposure", {"by": ["fund", "report_date"], "level": "l1"}, data, lambda: None)
    return out.select("fund", "report_date", "sector", _r("weight").alias("weight"))


# responses of forums, packed from conversations

_ITEMS = """i AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS item, CASE WHEN turn > 0 THEN turn::VARCHAR WHEN conv_id % 2 = 0 THEN (conv_id * 100)::VARCHAR END AS post, CASE WHEN turn % 2 = 0 THEN role END AS title, CASE WHEN turn % 5 <> 4 AND turn <> 3 THEN left(text, 50) ELSE '' END AS body, role FROM conversations),
  p AS (SELECT *, trim(CASE WHEN title IS NOT NULL THEN title || chr(10) || body ELSE body END, E' \\t\\r\\n') AS content FROM i WHERE conv_id % 7 NOT IN (0, 1, 3))"""


def _posts(spark, d):
    """One response per conversation: whole, with the list at the top, an array, cut off, or of other fields."""
    c = V.table(spark, d, "conversations")
    text = F.when((F.col("turn") % 5 != 4) & (F.col("turn") != 3), F.left("text", F.lit(50)))
    item = F.struct("turn", F.col("turn").alias("post_id"), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("post_title"), text.alias("post_content"), F.col("role").alias("user_nickname"), F.format_string("2024-01-02 03:04:%02d", "turn").alias("post_publish_time"))
    packed = c.groupBy(F.col("conv_id").alias("response")).agg(F.sort_array(F.collect_list(item)).alias("list"))
    kind = F.col("response") % 7
    whole = F.to_json(F.struct(F.struct("list").alias("data")))
    payload = (
        F.when(kind == 0, F.to_json("list")).when(kind == 1, F.left(whole, F.length(whole) - 3)).when(kind == 2, F.to_json(F.struct("list")))
        .when(kind == 3, F.to_json(F.struct(F.col("list").alias("rows"), F.lit(1).alias("code")))).otherwise(whole)
    )
    return responses.board_posts(packed.select("response", payload.alias("payload"), (F.col("response") + 7000).alias("user_id")))


@query(f"WITH {_ITEMS} SELECT conv_id AS response, item::INT AS item, post AS platform_id, role AS account_name, 'https://guba.eastmoney.com/news,' || (conv_id + 7000)::VARCHAR || ',' || post || '.html' AS source_url, TIMESTAMP '2024-01-02 03:04:00' + to_seconds(turn) AS published_at, content FROM p WHERE post IS NOT NULL AND content <> ''")
def board_posts(spark, d):
    posts, _ = _posts(spark, d)
    return posts.select("response", "item", "platform_id", "account_name", "source_url", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "content")


@query(f"""WITH {_ITEMS} SELECT conv_id AS response, item::INT AS item, CASE WHEN post IS NULL THEN 'no identifier' ELSE 'no text' END AS reason FROM p WHERE post IS NULL OR content = ''
  UNION ALL SELECT DISTINCT conv_id, NULL::INT, CASE conv_id % 7 WHEN 0 THEN 'no object at the top' WHEN 1 THEN 'no JSON' ELSE 'no list; fields: code, rows' END FROM conversations WHERE conv_id % 7 IN (0, 1, 3)""")
def rejected_posts(spark, d):
    """Items and responses that are no posts, and why."""
    _, rejected = _posts(spark, d)
    return rejected


# pages and searches


@query(f"""WITH {_PCT}, r AS (SELECT ts_code, round(pct, 6) AS pct, {_LEVEL} AS level, row_number() OVER (ORDER BY pct DESC NULLS LAST, ts_code) AS n FROM pct) SELECT ((n - 1) // 50 + 1)::INT AS page, ts_code, pct, level FROM r WHERE n <= 150""")
def ranking_by_cursor(spark, d):
    """Three pages of the ranking, each from the row after the one before."""
    rows = percentiles.percentile(V.valuations(spark, d), ["ts_code"], "pe_ttm").select("ts_code", "pct", "level")
    out, cursor = None, None
    for number in range(1, 4):
        page = pages.page(rows, ["-pct"], "ts_code", 50, cursor).withColumn("page", F.lit(number))
        out = page if out is None else out.unionByName(page)
        _, cursor = pages.with_cursor(rows, ["-pct"], "ts_code", 50, cursor)
        if cursor is None:
            break
    return out.select("page", "ts_code", _r("pct").alias("pct"), "level")


_WORDS = ("12", "7", "al", "brown", "o")


@query("WITH s AS (SELECT p_partkey AS ts_code, p_name AS name, lower(p_partkey::VARCHAR) AS c, lower(p_name) AS n FROM part), q(asked) AS (VALUES " + ", ".join(f"('{w}')" for w in _WORDS) + """)
  SELECT asked, ts_code, name, CASE WHEN starts_with(c, asked) THEN 0 WHEN contains(c, asked) THEN 1 WHEN starts_with(n, asked) THEN 2 WHEN contains(n, asked) THEN 3 END AS rank FROM s, q WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asked ORDER BY rank, ts_code) <= 20""")
def indexed_suggestions(spark, d):
    """Suggestions for several texts from postings that were written once."""
    dim, path = V.table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), F.col("p_name").alias("name")), new_folder(spark, "grams")
    search.index_grams(dim, path)
    index, out = spark.read.parquet(path), None
    for word in _WORDS:
        found = search.suggest_indexed(index, dim, word).select(F.lit(word).alias("asked"), "ts_code", "name", "rank")
        out = found if out is None else out.unionByName(found)
    return out


_FIELDS = ["pe_ttm", *(leaf["field"] for _, leaf in screener.leaves(research.SCREEN))]
_ORDERED = sorted(set(_FIELDS), key=lambda f: (-_FIELDS.count(f), f))


@query(f"""WITH {research._FRAME}, k AS (SELECT list_filter([{', '.join(f"CASE WHEN count({f}) * 100.0 / count(*) >= 50 THEN '{f}' END" for f in _ORDERED)}], lambda x: x IS NOT NULL)[1:2] AS f FROM frame),
  v AS (SELECT ts_code, f[1] AS x_name, f[2] AS y_name, CASE f[1] {' '.join(f"WHEN '{f}' THEN {f}" for f in _ORDERED)} END AS x, CASE f[2] {' '.join(f"WHEN '{f}' THEN {f}" for f in _ORDERED)} END AS y, {research._PASS} AS passed FROM frame, k WHERE len(f) = 2),
  o AS (SELECT *, row_number() OVER (ORDER BY ts_code) - 1 AS pos, count(*) OVER () AS n FROM v WHERE x IS NOT NULL AND y IS NOT NULL), g AS (SELECT *, (pos * 400 + n - 1) // n AS k FROM o)
  SELECT ts_code, x_name, y_name, round(x, 4) AS x, round(y, 4) AS y, passed FROM g WHERE n <= 400 OR (k < 400 AND k * n // 400 = pos)""")
def scatter_points(spark, d):
    """The two factors that a screen names most often and that are there often enough, at 400 evenly spaced securities."""
    frame, spec = research._screened(spark, d)
    passed = screener.compile_rules(spec).alias("passed")
    chosen, rows = alignment.scatter(frame.select("*", passed), [leaf["field"] for _, leaf in screener.leaves(spec)], ["ts_code"], 400)
    if not chosen:
        return frame.where("1 = 0").select("ts_code", F.lit("").alias("x_name"), F.lit("").alias("y_name"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(True).alias("passed"))
    return rows.select("ts_code", F.lit(chosen[0]).alias("x_name"), F.lit(chosen[1]).alias("y_name"), _r(chosen[0], 4).alias("x"), _r(chosen[1], 4).alias("y"), "passed")


@query(f"""WITH r AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{n}', {k})" for s, n, _, _, _, k in lookups.COMMODITIES)}) t(symbol, name, sort_order)),
  p AS (SELECT symbol, trade_date, sum(amount) / sum(volume) AS close FROM daily_prices JOIN r ON sort_order = (ts_code % 11) * 10 WHERE ts_code % 11 <> 4 AND (ts_code % 11 <> 5 OR trade_date < DATE '2001-06-01') AND (ts_code % 11 <> 6 OR trade_date >= DATE '2001-11-01') GROUP BY ALL),
  l AS (SELECT symbol, max(trade_date) AS as_of, max_by(close, trade_date) AS price FROM p GROUP BY 1), w AS (SELECT p.* FROM p JOIN l USING (symbol) WHERE trade_date > (as_of - INTERVAL 120 MONTH)::DATE),
  s AS (SELECT symbol, any_value(price) AS price, any_value(as_of) AS as_of, count(*) AS n, 100.0 * count_if(close < price) / count(*) AS pct, {', '.join(f"max_by(close, trade_date) FILTER (WHERE trade_date <= as_of - {k}) AS b{k}" for k in (30, 90, 365))} FROM w JOIN l USING (symbol) GROUP BY 1),
  j AS (SELECT *, datediff('day', as_of, DATE '2001-12-10') AS lag_days FROM r LEFT JOIN s USING (symbol)), g AS (SELECT *, CASE WHEN n >= 60 AND lag_days <= 15 THEN pct END AS shown FROM j)
  SELECT symbol, name, sort_order, round(price, 6) AS price, as_of, lag_days, lag_days > 15 AS stale, CASE WHEN n >= 60 THEN n ELSE 0 END AS n, round(shown, 6) AS pct, {_LEVEL.replace('pct', 'shown')} AS level, {', '.join(f"round(CASE WHEN b{k} > 0 THEN (price / b{k} - 1) * 100 END, 2) AS change_{k}d" for k in (30, 90, 365))} FROM g""")
def commodity_page(spark, d):
    """The registry's commodities over given prices: one without any, one that is stale, one of too few days."""
    registry = lookups.commodities(spark).select("symbol", "name", "sort_order")
    kind = F.col("ts_code") % 11
    p = V.daily_prices(spark, d).where((kind != 4) & ((kind != 5) | (F.col("trade_date") < "2001-06-01")) & ((kind != 6) | (F.col("trade_date") >= "2001-11-01")))
    p = p.withColumn("sort_order", (kind * 10).cast("int")).join(F.broadcast(registry.select("symbol", "sort_order")), "sort_order")
    p = p.groupBy("symbol", "trade_date").agg((F.sum("amount") / F.sum("volume")).alias("close"))
    out = commodities.catalogue(registry, p, "2001-12-10")
    return out.select("symbol", "name", "sort_order", _r("price").alias("price"), "as_of", "lag_days", "stale", "n", _r("pct").alias("pct"), "level", *(_r(f"change_{k}d", 2).alias(f"change_{k}d") for k in (30, 90, 365)))


# investors


def _people(spark, d):
    nation = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("investor_code"), F.col("n_name").alias("name"))
    accounts = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("investor_code"), F.col("c_custkey").alias("account"))
    orders = V.table(spark, d, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("quote_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("published_at"))
    return nation, accounts, orders.join(accounts.where("investor_code <> 3"), "account")


_QUOTES = "q AS (SELECT c_nationkey AS investor_code, o_orderkey AS quote_id, o_orderstatus AS status, o_orderdate::DATE AS published_at FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 3 <> 0 AND c_nationkey <> 3)"


@query(f"""WITH {_QUOTES}, a AS (SELECT c_nationkey AS investor_code, count(*) AS account_count FROM customer GROUP BY 1), s AS (SELECT investor_code, count(*) AS quote_count, count_if(status = 'F') AS verified_count, max(published_at) AS last_captured FROM q GROUP BY 1)
  SELECT n_nationkey AS investor_code, n_name AS name, coalesce(account_count, 0) AS account_count, coalesce(quote_count, 0) AS quote_count, coalesce(verified_count, 0) AS verified_count, last_captured FROM nation LEFT JOIN a ON a.investor_code = n_nationkey LEFT JOIN s ON s.investor_code = n_nationkey""")
def investor_list(spark, d):
    """Every investor with accounts and quotes; one has no quotes."""
    return investors.listed(*_people(spark, d), verified="F")


@query(f"""WITH {_QUOTES} SELECT 'quote' AS part, quote_id AS id, published_at, status, 1 AS n FROM q WHERE investor_code = 7 QUALIFY row_number() OVER (ORDER BY published_at DESC, quote_id) <= 20
  UNION ALL SELECT 'account', c_custkey, NULL, NULL, 1 FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'summary', NULL, NULL, status, count(*) FROM q GROUP BY status""")
def investor_profile(spark, d):
    """One investor's newest quotes and accounts, and how far all quotes are verified."""
    found = investors.profile(*_people(spark, d), 7)
    none = lambda kind: F.lit(None).cast(kind)
    quote = found["quotes"].select(F.lit("quote").alias("part"), F.col("quote_id").alias("id"), "published_at", "status", F.lit(1).cast("long").alias("n"))
    account = found["accounts"].select(F.lit("account").alias("part"), F.col("account").alias("id"), none("date").alias("published_at"), none("string").alias("status"), F.lit(1).cast("long").alias("n"))
    summary = found["summary"].select(F.lit("summary").alias("part"), none("long").alias("id"), none("date").alias("published_at"), "status", "n")
    return quote.unionByName(account).unionByName(summary)

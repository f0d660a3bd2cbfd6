"""The domain's tables as views over the star schema, and the same views as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that a task groups at once where lines are dealt by code.
TASK_LINES = 500_000


def daily_prices(spark, d, dealt: bool = False) -> DataFrame:
    """ts_code, trade_date, close, volume, amount: one row per part and ship day.

    If dealt, lines go by code to as many tasks as they need: a task's groups do not grow with the table, and what is grouped by code next needs no exchange.
    """
    lines = table(spark, d, "lineitem")
    if dealt:
        tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_LINES))
        lines = lines.select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity").repartition(tasks, "l_partkey")
    return (
        lines.groupBy(F.col("l_partkey").alias("ts_code"), F.col("l_shipdate").cast("date").alias("trade_date"))
        .agg(F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("volume"))
        .select("ts_code", "trade_date", (F.col("amount") / F.col("volume")).alias("close"), "volume", "amount")
    )


def securities(spark, d) -> DataFrame:
    """ts_code, name, industry, market, list_date, delist_date (where trading ended early)."""
    days = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ts_code")).agg(F.min("l_shipdate").cast("date").alias("list_date"), F.max("l_shipdate").cast("date").alias("last"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), F.col("p_name").alias("name"), F.col("p_type").alias("industry"), F.col("p_brand").alias("market"))
    return p.join(days, "ts_code", "left").withColumn("delist_date", F.when(F.col("last") < F.lit("2001-06-01").cast("date"), F.col("last"))).drop("last")


def valued_prices(spark, d) -> DataFrame:
    """daily_prices with pe_ttm (some not positive), pb and ps."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), "p_retailprice", "p_size")
    valued = {"pe_ttm": F.col("close") / (F.col("p_retailprice") / 100) - 5, "pb": F.col("close") / 1000, "ps": F.col("close") / (50 + F.col("p_size"))}
    return daily_prices(spark, d).join(p, "ts_code").select("ts_code", "trade_date", "close", "volume", "amount", *(c.alias(n) for n, c in valued.items()))


def valuations(spark, d) -> DataFrame:
    """ts_code, trade_date, pe_ttm, pb, ps."""
    return valued_prices(spark, d).select("ts_code", "trade_date", "pe_ttm", "pb", "ps")


def fundamentals(spark, d) -> DataFrame:
    """ts_code, report_period, available_date, source, revenue, cost, tax, profit: one row per key, the latest available first."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("report_period"))
    l = table(spark, d, "lineitem").join(o, "l_orderkey")  # noqa: E741
    l = l.repartition("l_partkey")  # noqa: E741  (one exchange for this grouping and what groups or ranks a code's statements after it)
    return l.groupBy(F.col("l_partkey").alias("ts_code"), "report_period", F.col("l_returnflag").alias("source")).agg(
        F.max(F.greatest(F.col("l_shipdate").cast("date"), F.col("report_period"))).alias("available_date"),
        F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * F.col("l_discount") * 8).alias("cost"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"), F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("profit"), F.sum("l_quantity").alias("shares"),
    )


def sectors(spark, d) -> DataFrame:
    """stock (supplier), l1 (region), l2 (nation); suppliers of negative balance are unmapped."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.where("s_acctbal >= 0").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("s_suppkey").alias("stock"), F.col("r_name").alias("l1"), F.col("n_name").alias("l2")
    )


def holdings(spark, d) -> DataFrame:
    """fund (customer), report_date (quarter end), stock (supplier), market_value, weight within the report."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("fund"), F.last_day(F.add_months(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), 2)).alias("report_date"))
    from pyspark.sql.window import Window

    held = table(spark, d, "lineitem").join(o, "l_orderkey").groupBy("fund", "report_date", F.col("l_suppkey").alias("stock")).agg(F.sum("l_extendedprice").alias("market_value"))
    return held.withColumn("weight", F.col("market_value") / F.sum("market_value").over(Window.partitionBy("fund", "report_date")))


def segment_holdings(spark, d) -> DataFrame:
    """segment (of the customer), report_date, stock, market_value: the funds' holdings by segment, summed from the lines at once."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    o = table(spark, d, "orders").join(c, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "segment", F.last_day(F.add_months(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), 2)).alias("report_date"))
    return table(spark, d, "lineitem").join(o, "l_orderkey").groupBy("segment", "report_date", F.col("l_suppkey").alias("stock")).agg(F.sum("l_extendedprice").alias("market_value"))


def fund_nav(spark, d) -> DataFrame:
    """fund (market segment), month, nav: monthly sums of orders in millions."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("fund"))
    return table(spark, d, "orders").join(c, "o_custkey").groupBy("fund", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg((F.sum("o_totalprice") / 1e6).alias("nav"))


def sector_index(spark, d) -> DataFrame:
    """sector (region), month, close: monthly sums of orders by the customer's region in millions."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("sector"))
    return table(spark, d, "orders").join(c, "o_custkey").groupBy("sector", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg((F.sum("o_totalprice") / 1e6).alias("close"))


def flows(spark, d) -> DataFrame:
    """sector (user), trade_date, net: what each user's events add up to per day, purchases in and the rest out."""
    # a day's events are added in order of time, as one after another in the SQL: whether a net of about zero is positive hangs on it
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("trade_date"), "ts", "event_id", "event_type", "value")
    e = e.repartition("user_id", "trade_date").sortWithinPartitions("user_id", "trade_date", "ts", "event_id")
    return e.groupBy(F.col("user_id").alias("sector"), "trade_date").agg(
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value") / 4)).alias("net"), F.sum("value").alias("turnover")
    )


#: The same views for DuckDB.
SQL = """
daily_prices AS (SELECT l_partkey AS ts_code, l_shipdate::DATE AS trade_date, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lineitem GROUP BY ALL),
securities AS (SELECT p_partkey AS ts_code, p_name AS name, p_type AS industry, p_brand AS market, list_date, CASE WHEN last < DATE '2001-06-01' THEN last END AS delist_date
  FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate)::DATE AS list_date, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
valuations AS (SELECT ts_code, trade_date, close / (p_retailprice / 100) - 5 AS pe_ttm, close / 1000 AS pb, close / (50 + p_size) AS ps FROM daily_prices JOIN part ON p_partkey = ts_code),
fundamentals AS (SELECT l_partkey AS ts_code, o_orderdate::DATE AS report_period, l_returnflag AS source, max(greatest(l_shipdate::DATE, o_orderdate::DATE)) AS available_date, sum(l_extendedprice) AS revenue,
  sum(l_extendedprice * l_discount * 8) AS cost, sum(l_extendedprice * l_tax) AS tax, sum(l_extendedprice * (l_discount - 0.05)) AS profit, sum(l_quantity) AS shares FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
sectors AS (SELECT s_suppkey AS stock, r_name AS l1, n_name AS l2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal >= 0),
held AS (SELECT o_custkey AS fund, last_day(date_trunc('quarter', o_orderdate)::DATE + INTERVAL 2 MONTH) AS report_date, l_suppkey AS stock, sum(l_extendedprice) AS market_value FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
holdings AS (SELECT *, market_value / sum(market_value) OVER (PARTITION BY fund, report_date) AS weight FROM held),
fund_nav AS (SELECT c_mktsegment AS fund, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) / 1e6 AS nav FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
sector_index AS (SELECT r_name AS sector, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) / 1e6 AS close FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
flows AS (SELECT user_id AS sector, ts::DATE AS trade_date, sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value / 4 END) AS net, sum(value) AS turnover FROM events GROUP BY ALL)
"""

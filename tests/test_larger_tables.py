"""Queries on tables where sums come in any order, keys are long and copies tie."""

import datetime as dt
import random

import duckdb
from oracle import rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

from finlattice.operators import alignment, portfolio, search
from finlattice.plans.catalogue import ORACLES, QUERIES
from finlattice.sources import vendor_pages
from finlattice.sources import views as V


def test_a_sector_that_stands_alone_weighs_one(spark):
    rng = random.Random(5)
    held = [(fund, report, sector * 50 + k, rng.random()) for fund in range(300) for report, sector in ((1, 0), (2, 1), (3, 2)) for k in range(12)]
    rows = spark.createDataFrame(held, "fund int, report int, stock int, weight double").repartition(16)
    mapping = spark.createDataFrame([(s * 50 + k, f"s{s}") for s in range(3) for k in range(12)], "stock int, l1 string")
    weights = portfolio.sector_weights(rows, mapping, ["fund", "report"])
    assert {tuple(r) for r in weights.select("stocks", "weight", "coverage").collect()} == {(12, 1.0, 1.0)}
    other = spark.createDataFrame([(f, f"s{s}", float(s)) for f in range(300) for s in range(3)], "fund int, sector string, weight double")
    compared = portfolio.compare_maps(weights.groupBy("fund", "sector").agg(F.sum("weight").alias("weight")), other, ["fund"], "sector", "weight")
    assert {tuple(r) for r in compared.select("common", "correlation").collect()} == {(3, None)}


def _events(spark, folder):
    """Events of many users and one day whose cents nearly cancel, in order of time, dealt over several files."""
    rng = random.Random(7)
    start, rows = dt.datetime(2024, 1, 1), []
    for user in range(400):
        cents = [rng.randint(1, 900) for _ in range(4)]
        values = [(c / 100, "purchase") for c in cents] + [(sum(cents) * 4 / 100, "view")]
        for day in range(2):
            rng.shuffle(values)
            rows += [(day, k, user, kind, v) for k, (v, kind) in enumerate(values)]
    rows = [(n, start + dt.timedelta(days=r[0], seconds=r[1]), *r[2:]) for n, r in enumerate(sorted(rows, key=lambda r: (r[0], r[1])))]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(16).write.parquet(str(folder / "events.parquet"))
    return rows


def test_flows_add_a_day_in_order_of_time(spark, tmp_path):
    rows = _events(spark, tmp_path)
    expected = {}
    for _, ts, user, kind, value in rows:
        expected[user, ts.date()] = expected.get((user, ts.date()), 0.0) + (value if kind == "purchase" else -value / 4)
    assert {(r.sector, r.trade_date): r.net for r in V.flows(spark, str(tmp_path)).select("sector", "trade_date", "net").collect()} == expected
    assert any(0 < abs(v) < 1e-9 for v in expected.values()) and 0.0 in expected.values()


def test_copies_of_a_turn_keep_the_first_conversation(spark, tmp_path):
    texts = [f"a text that {n} conversations share" for n in range(40)]
    rows = [(c + copy * 1000, 1 + c % 2, "user", text) for copy in range(6) for c, text in enumerate(texts)]
    duckdb.connect().execute("CREATE TABLE t(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)").executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows).execute(f"COPY t TO '{tmp_path}/conversations.parquet'")
    found = {r.quote_id: r.investor_code for r in QUERIES["quote_rows"](spark, str(tmp_path)).collect()}
    assert sorted(found.values(), key=int) == [str(c) for c in range(40)]
    assert set(found) == {k for k in found if ":h" in k}
    assert _compared(spark, "quote_rows", tmp_path, ["conversations"])


def _compared(spark, name, folder, tables):
    """Whether a query gives its SQL's rows in a folder that has only these tables."""
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if t not in tables and not (folder / f"{t}.parquet").exists():
            (folder / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    return rows_of_spark(QUERIES[name](spark, str(folder))) == rows_of_sql(ORACLES[name], str(folder))


def test_listings_whose_codes_are_cut_alike_stay_apart(spark, tmp_path):
    parts = (118000, 1180001, 1180003, 1180007, 7, 17)
    duckdb.sql(f"COPY (SELECT k::BIGINT AS l_partkey, TIMESTAMP '1998-01-05' + to_days(d::INT) AS l_shipdate, (k % 97 + 1) * 100.0::DOUBLE AS l_extendedprice, 10.0::DOUBLE AS l_quantity FROM (VALUES {', '.join(f'({k})' for k in parts)}) p(k), range(3) t(d)) TO '{tmp_path}/lineitem.parquet'")
    assert QUERIES["vendor_prices_table"](spark, str(tmp_path)).count() == 3 * sum(k % 13 != 0 for k in parts)
    assert _compared(spark, "vendor_prices_table", tmp_path, ["lineitem"])


def _times_read(spark, name, folder, table):
    """How many times a query reads each row of a table."""
    read, counter = V.table, spark.sparkContext.accumulator(0)

    def tick(_):
        counter.add(1)
        return True

    ticked = F.udf(tick, "boolean").asNondeterministic()
    V.table = lambda session, d, t: read(session, d, t).where(ticked(F.lit(1))) if t == table else read(session, d, t)
    try:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    finally:
        V.table = read
    return counter.value / read(spark, folder, table).count()


def test_constituents_are_made_once(spark, sf):
    for name in ("benchmark_snapshots", "benchmark_notes"):
        assert _times_read(spark, name, sf, "lineitem") == 1, name


def test_the_frame_of_a_scatter_is_made_once(spark):
    counter = spark.sparkContext.accumulator(0)

    def tick(x):
        counter.add(1)
        return x

    frame = spark.range(1000).select(F.col("id").alias("ts_code"), F.udf(tick, "double")(F.col("id").cast("double")).alias("a"), F.lit(2.0).alias("b"))
    chosen, rows = alignment.scatter(frame, ["a", "b", "a"], ["ts_code"], 400)
    assert (chosen, rows.count(), counter.value) == (["a", "b"], 400, 1000)


def test_statements_are_made_once(spark, sf):
    assert _times_read(spark, "statement_indicators", sf, "lineitem") == 1


def test_postings_are_written_in_bounded_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "TASK_POSTINGS", 2000)
    dim = spark.range(3000).select(F.col("id").alias("ts_code"), F.lit("oo common name").alias("name"))
    search.index_grams(dim, str(tmp_path / "grams"))
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "grams")).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 4000 and sum(sizes) > 60000
    found = search.suggest_indexed(spark.read.parquet(str(tmp_path / "grams")), dim, "o").collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in search.suggest(dim, "o").collect()]


def test_pages_of_holdings_are_made_once(spark, sf):
    assert _times_read(spark, "vendor_holdings", sf, "lineitem") == 1


def test_plain_tables_are_split_as_they_are_parsed():
    rng = random.Random(9)
    pieces = ["<table>", '<table class=" w782  comm">', "<table class='x'>", "</table>", "<tr>", "</tr>", "<td>", "<th>", "</td>", "</th>", '<td colspan="2">', '<th colspan="0">', '<td rowspan="2">', "<a href='x y'>", '<b class="">', "</a>", "<br>", "<t<b>d>", "<TD>", "<!-- <td>-->", "<script>", " a  b ", "股票代码", ">", '"', "&lt;", "&", "\n", "<", "\0"]
    row = lambda: "<tr>" + "".join(f"<td>{rng.choice(['', ' x <a>y</a>', '1>2', '<b>股票代码</b>'])}</td>" for _ in range(rng.randint(0, 4))) + "</tr>"
    plain = 0
    for _ in range(4000):
        parts = ["<table>", *(row() for _ in range(rng.randint(0, 4))), "</table>"]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(parts))
            parts[at:at] = rng.choices(pieces, k=rng.randint(1, 2))
        html = "".join(parts)
        parser = vendor_pages._Grids()
        parser.feed(html)
        found = vendor_pages._plain_grids(html)
        plain += found is not None
        assert found is None or found == parser.grids(), html
    assert plain > 500 and vendor_pages._plain_grids("<table><tr><td>a&amp;b</td></tr></table>") is None


def test_month_ends_are_grouped_in_bounded_tasks(spark, sf, monkeypatch):
    lines = V.table(spark, sf, "lineitem").count()
    expected = rows_of_sql(ORACLES["month_end_prices"], sf)
    monkeypatch.setattr(V, "TASK_LINES", 100, raising=False)
    found = QUERIES["month_end_prices"](spark, sf)
    assert found.rdd.getNumPartitions() == -(-lines // 100)
    assert rows_of_spark(found) == expected

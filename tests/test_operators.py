"""Hand-computed cases of the operators."""

import datetime as dt
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from finlattice.functions import numeric as N
from finlattice.functions import text as X
from finlattice.operators import backtest, compare, factors, lookups, percentiles, portfolio, preprocess, risk, screener, search, series, snapshots, style, tables
from finlattice.operators import point_in_time as pit
from finlattice.sources import normalize

D = dt.date


def col(df, name):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize(
    "op,value,expected",
    [("lt", 20, "TFF"), ("le", 15, "TFF"), ("gt", 20, "FTF"), ("ge", 25, "FTF"), ("eq", 25, "FTF"), ("ne", 25, "TFF"), ("in", [15, 25], "TTF"), ("isna", None, "FFT"), ("notna", None, "TTF")],
)
def test_rules(spark, op, value, expected):
    df = spark.createDataFrame([(1, 15.0), (2, 25.0), (3, None)], "ts_code int, x double")
    out = screener.summary(df, {"field": "x", "op": op, "value": value}).orderBy("ts_code")
    assert "".join("T" if p else "F" for p in col(out, "passed")) == expected


def test_screen_errors_name_the_path():
    with pytest.raises(ValueError, match=r"condition.all\[1\]"):
        screener.compile_rules({"all": [{"field": "a", "op": "isna"}, {"field": "a", "op": "like"}]})


def test_guard_is_added_once():
    spec = {"field": "pb", "op": "lt", "value": 1}
    assert screener.with_positive_guard(screener.with_positive_guard(spec)) == screener.with_positive_guard(spec)


def test_universe_leaves_on_the_delisting_day(spark):
    s = spark.createDataFrame([("a", D(2010, 1, 1), None), ("b", D(2010, 1, 1), D(2016, 7, 25)), ("c", D(2020, 1, 1), None), ("d", None, None)], "ts_code string, list_date date, delist_date date")
    assert sorted(col(pit.universe(s, "2016-07-24"), "ts_code")) == ["a", "b", "d"]
    assert sorted(col(pit.universe(s, "2016-07-25"), "ts_code")) == ["a", "d"]


def test_statement_is_hidden_until_it_is_available(spark):
    f = spark.createDataFrame([("a", D(2023, 12, 31), D(2024, 4, 1), "x", 1.0), ("a", D(2024, 12, 31), D(2025, 4, 1), "x", 2.0)], "ts_code string, report_period date, available_date date, source string, v double")
    assert col(pit.cross_section(f, "2025-03-31"), "v") == [1.0]
    assert col(pit.cross_section(f, "2025-04-01"), "v") == [2.0]


def test_previous_year_of_leap_day(spark):
    f = spark.createDataFrame([("a", D(2023, 2, 28), 10.0), ("a", D(2024, 2, 28), 15.0)], "ts_code string, report_period date, v double")
    out = {r.report_period: r.v_prev for r in pit.with_previous_year(f, ["ts_code"], ["v"]).collect()}
    assert out == {D(2023, 2, 28): None, D(2024, 2, 28): 10.0}


def test_step_factors(spark):
    p = spark.createDataFrame([("a", D(2024, 1, k), 1.0) for k in (1, 2, 3)], "ts_code string, trade_date date, close double")
    e = spark.createDataFrame([("a", D(2024, 1, 2), 0.5)], "ts_code string, trade_date date, factor double")
    assert col(pit.step_factors(p, e).orderBy("trade_date"), "factor") == [1.0, 0.5, 0.5]


def test_percentile_is_strict_and_positive_only(spark):
    h = spark.createDataFrame([("a", D(2024, 1, k + 1), v) for k, v in enumerate([10.0, 20.0, 30.0, -5.0, 40.0])] + [("b", D(2024, 1, 1), 5.0), ("b", D(2024, 1, 2), -1.0), ("c", D(2024, 1, 1), None)], "ts_code string, trade_date date, pe double")
    out = {r.ts_code: r for r in percentiles.percentile(h, ["ts_code"], "pe").collect()}
    assert out["a"].pct == 75.0 and out["a"].n == 4
    assert out["b"].pct is None and out["b"].level == "-"
    assert "c" not in out


def test_histogram_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(10.0,), (10.5,), (5000.0,), (-1.0,), (None,)], "v double")
    out = {r.label: r.n for r in percentiles.histogram(df, "v").collect()}
    assert len(out) == 9 and out["0-10"] == 1 and out["10-20"] == 1 and out[">1000"] == 1 and out["70-100"] == 0


def test_winsorize_and_zscore(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 1000.0), (6, None)], "k int, x double")
    w = preprocess.winsorize(df, ["x"], 0.2, 0.2).orderBy("k")
    low, high = np.quantile([1, 2, 3, 4, 1000], [0.2, 0.8])
    assert col(w, "x") == pytest.approx([low, 2, 3, 4, high, None])
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, x double")
    assert col(preprocess.zscore(same, ["x"]), "x") == [None, None]


def test_neutralizers(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 20.0), (" ", 7.0, 40.0), ("b", 5.0, 80.0)], "g string, x double, mv double")
    out = {(r.g, r.mv): r.x for r in preprocess.neutralize_groups(df, ["x"], "g").collect()}
    assert out == {("a", 10.0): -1.0, ("a", 20.0): 1.0, (" ", 40.0): None, ("b", 80.0): 0.0}
    rest = np.array(col(preprocess.neutralize_size(df, ["x"], "mv").orderBy("mv"), "x"))
    assert rest.sum() == pytest.approx(0) and rest @ np.log([10, 20, 40, 80]) == pytest.approx(0)


def test_rank_averages_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None)], "k int, x double").withColumn("d", F.lit(1))
    assert col(preprocess.rank(df, "x", ["d"]).orderBy("k"), "x") == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3, None])


def test_factors(spark):
    assert len(factors.FACTORS) == 27
    df = spark.createDataFrame([(250.0, 10.0, 12.0, 10.0, 0.3, 0.27), (250.0, -1.0, 5.0, 0.0, None, 0.1)], "enterprise_value double, ebitda double, free_cash_flow double, free_cash_flow_prev double, roe double, roe_prior_year double")
    a, b = factors.compute(df, ["ev_ebitda", "fcf_growth", "roe_trend"]).collect()
    assert (a.ev_ebitda, a.fcf_growth, round(a.roe_trend, 9)) == (25.0, 0.2, 0.03)
    assert (b.ev_ebitda, b.fcf_growth, b.roe_trend) == (None, None, None)
    with pytest.raises(ValueError, match="ebitda"):
        factors.compute(df.drop("ebitda"), ["ev_ebitda"])


def test_brinson(spark):
    df = spark.createDataFrame([(1, "x", 0.6, 0.3, 0.12, 0.08), (1, "y", 0.4, 0.7, -0.05, 0.01)], "k int, sector string, wp double, wb double, rp double, rb double")
    for method in ("BF", "HB"):
        r = portfolio.attribution_totals(portfolio.brinson(df, ["k"], method), ["k"]).first()
        assert r.allocation + r.selection + r.interaction == pytest.approx(r.excess, abs=1e-12)
        assert method == "BF" or r.interaction == 0


def test_sector_weights(spark):
    c = spark.createDataFrame([(1, 1, 0.30), (1, 2, 0.20), (1, 3, 0.25), (1, 4, 0.25)], "f int, stock int, weight double")
    m = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "stock int, l1 string")
    out = {r.sector: (round(r.weight, 9), r.coverage) for r in portfolio.sector_weights(c, m, ["f"]).collect()}
    assert out == {"a": (0.4, 0.75), "b": (0.6, 0.75)}


def test_trade_costs(spark):
    df = spark.createDataFrame([("BUY", 10000.0), ("SELL", 100000.0)], "side string, amt double")
    assert col(df.select(N.trade_cost("side", "amt").alias("c")), "c") == [5.0, 75.0]


def prices(spark, closes, **more):
    rows = [("a", D(2024, 1, 2 + k), float(c), *(float(v[k]) for v in more.values())) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ts_code string, trade_date date, close double" + "".join(f", {n} double" for n in more))


def signals(spark, *rows):
    return spark.createDataFrame([("s", "a", D(2024, 1, day), w) for day, w in rows], "strategy string, ts_code string, trade_date date, weight double")


FREE = backtest.Rules(cash=10000, commission=0, stamp=0)


def equity(df):
    return [round(r.equity, 2) for r in df.orderBy("trade_date").collect()]


def test_backtest_next_day_fill(spark):
    out = backtest.run(prices(spark, [10, 11, 12, 13]), signals(spark, (2, 1.0)), FREE)
    assert equity(out) == [10000, 10000, 10900, 11800]


def test_backtest_round_trip_with_costs(spark):
    out = backtest.run(prices(spark, [10, 11, 12, 13]), signals(spark, (2, 1.0), (4, 0.0)), backtest.Rules(cash=10000)).orderBy("trade_date").collect()
    assert out[-1].equity == pytest.approx(11784.15) and out[-1].realised == pytest.approx(1784.15)


def test_backtest_refusals(spark):
    up = backtest.run(prices(spark, [10, 11, 12], pre_close=[10, 10, 11]), signals(spark, (2, 1.0)), FREE)
    assert equity(up) == [10000] * 3
    halted = backtest.run(prices(spark, [10, 10, 12], volume=[1, 0, 1]), signals(spark, (2, 1.0)), FREE)
    assert equity(halted) == [10000] * 3


def test_backtest_dividend(spark):
    d = spark.createDataFrame([("a", D(2024, 1, 4), 0.5)], "ts_code string, ex_date date, cash_per_share double")
    out = backtest.run(prices(spark, [10, 10, 10]), signals(spark, (2, 1.0)), FREE, d)
    assert equity(out) == [10000, 10000, 10500]



def test_beta_of_twice_the_benchmark(spark):
    df = spark.createDataFrame([(1, 2 * b, b) for b in (0.01, -0.02, 0.03, 0.0)], "k int, r double, b double")
    out = risk.against_benchmark(df, ["k"], free=0.0).first()
    assert (round(out.beta, 9), round(out.alpha, 9), round(out.r_squared, 9)) == (2, 0, 1)


def test_performance(spark):
    df = spark.createDataFrame([(1, D(2024, 1, k), e) for k, e in ((1, 100.0), (2, 110.0), (3, 104.5))], "k int, trade_date date, equity double")
    r = risk.performance(df, ["k"]).first()
    assert r.volatility == pytest.approx(math.sqrt(2 * 0.075**2) * math.sqrt(252))
    assert r.annual_return == pytest.approx(0.025 * 252) and r.max_drawdown == pytest.approx(104.5 / 110 - 1) and r.cagr == pytest.approx(1.045**126 - 1)


def test_closed_trades(spark):
    df = spark.createDataFrame([(1, p) for p in (100.0, -50.0, 200.0, -25.0)], "k int, pnl double")
    r = risk.closed_trades(df, ["k"]).first()
    assert (r.win_rate, r.profit_factor) == (0.5, 4.0)


def test_drawdown_episode(spark):
    r = series.drawdown_episodes(prices(spark, [10, 8, 6, 8, 10]), ["ts_code"], "close").first()
    assert r.max_drawdown == pytest.approx(-0.4) and r.peak_date == D(2024, 1, 2) and r.trough_date == D(2024, 1, 4) and r.recovery_date == D(2024, 1, 6) and r.drawdown_rows == 2


def test_oscillators(spark):
    rising = prices(spark, range(1, 28))
    assert series.rsi(rising, ["ts_code"]).first().rsi == 100
    assert series.rsi(prices(spark, [5] * 20), ["ts_code"]).first().rsi == 50
    assert series.rsi(prices(spark, [5, 6]), ["ts_code"]).first().rsi is None
    assert series.macd(prices(spark, range(1, 26)), ["ts_code"]).first().dif is None
    assert series.macd(rising, ["ts_code"]).first().dif > 0


def test_business_days(spark):
    df = spark.createDataFrame([("f", "s", D(2024, 1, 5), 0.2), ("f", "s", D(2024, 1, 12), 0.9)], "f string, s string, d date, v double")
    out = series.business_days(df, ["f"], ["s"], "v", "d", "2024-01-16").orderBy("d").collect()
    assert [r.d.day for r in out] == [5, 8, 9, 10, 11, 12, 15, 16]
    assert [round(r.v, 6) for r in out] == [0.2, 0.5, 0.6, 0.7, 0.8, 0.9, 0.9, 0.9]


def test_style_recovers_weights(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.01, (60, 3))
    y = x @ [0.4, 0.3, 0.2]
    days = [D(2024, 1, 1) + dt.timedelta(k) for k in range(60)]
    funds = spark.createDataFrame([("f", d, float(v)) for d, v in zip(days, y)], "fund string, day date, r double")
    sectors = spark.createDataFrame([(f"s{j}", d, float(x[k, j])) for k, d in enumerate(days) for j in range(3)], "sector string, day date, r double")
    ends = spark.createDataFrame([(days[-1],)], "end_date date")
    out = {r.sector: r for r in style.decompose(funds, sectors, ends).collect()}
    assert [out[f"s{j}"].exposure for j in range(3)] == pytest.approx([0.4, 0.3, 0.2], abs=1e-6)
    assert out["s0"].r_squared == pytest.approx(1) and out["s0"].cash == pytest.approx(0.1, abs=1e-6)


def test_projection():
    rng = np.random.default_rng(2)
    for _ in range(50):
        w = style.project(rng.normal(0, 1, 5))
        assert (w >= 0).all() and w.sum() <= 1 + 1e-12


def test_writes_by_key(spark):
    t = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "k int, a double, b string")
    s = spark.createDataFrame([(2, 9.0, "z"), (3, 3.0, "w")], "k int, a double, b string")
    assert sorted(map(tuple, tables.upsert(t, s, ["k"], ["a"]).collect())) == [(1, 1.0, "x"), (2, 9.0, "y"), (3, 3.0, "w")]
    assert col(tables.insert_new(t, s, ["k"]), "k") == [3]
    with pytest.raises(ValueError):
        tables.insert_or_reject(t, s, ["k"])
    kinds = {r.k: (r.kind, r.columns) for r in tables.difference(t, s, ["k"], ["a", "b"]).collect()}
    assert kinds == {1: ("removed", None), 2: ("changed", ["a", "b"]), 3: ("added", None)}
    assert tables.version({"a": 1, "b": 2}) == tables.version({"b": 2, "a": 1})


def test_replace_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    tables.replace_partition(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (9, "b")]


def test_conform(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([("x", "1.5", 1), ("y", "bad", 2)], "b string, a string, extra int")
    assert [tuple(r) for r in tables.conform(df, schema).collect()] == [(1.5, "x"), (None, "y")]
    with pytest.raises(ValueError, match="a"):
        tables.conform(df.drop("a"), schema)


def test_texts(spark):
    raw = "<p>买了６００５１９</p><b>Ａ股</b>&amp;茅台​ 转发微博 来自雪球客户端"
    r = spark.createDataFrame([(raw,), (None,), ("sh600519与000001.SZ，周期与估值",)], "t string").withColumn("c", X.clean_text("t"))
    a, b, c = r.select("c", X.content_hash("c").alias("h"), X.quote_type("c").alias("k"), X.themes("c").alias("m"), X.stock_codes("c").alias("s")).collect()
    assert a.c == "买了600519 A股&茅台" and a.s == ["600519"] and len(a.h) == 64
    assert (b.c, b.h, b.k, b.m) == ("", "", None, [])
    assert c.s == ["600519", "000001"] and c.k == "macro_view" and c.m == ["估值"]


def test_codes_and_numbers(spark):
    df = spark.createDataFrame([("600519",), ("920001",), ("900901",), ("000001",), ("600519.sh",), ("HK01",)], "c string")
    assert col(df.select(X.security_code("c").alias("x")), "x") == ["600519.SH", "920001.BJ", "900901.SH", "000001.SZ", "600519.SH", "HK01"]
    df = spark.createDataFrame([("39.39亿",), ("1,696.46万",), ("12元",), ("--",), (None,)], "c string")
    assert col(df.select(N.amount("c").alias("x")), "x") == pytest.approx([3.939e9, 1.69646e7, 12.0, None, None])
    assert spark.range(1).select(X.epoch_day(F.lit(1704042000000)).alias("d")).first().d == D(2024, 1, 1)


def test_search(spark):
    dim = spark.createDataFrame([("600519", "maotai"), ("000600", "six"), ("1", "600 club")], "ts_code string, name string")
    assert col(search.suggest(dim, "600"), "ts_code") == ["600519", "000600", "1"]
    assert search.resolve(dim, "mao") == "600519"
    with pytest.raises(ValueError):
        search.resolve(dim, "zzz")


def test_backtest_validation(spark):
    found = backtest.validate(prices(spark, [10, -1]), signals(spark, (2, 0.7), (2, 0.6)))
    assert found == ["signals: repeated keys", "prices: a close is not positive", "signals: the weights of a day are over 1"]


def test_price_inputs(spark):
    days = [date(2024, 6, 30) - timedelta(days=k) for k in range(390, -1, -1)]
    rows = [("flat", d, 10.0) for d in days] + [("up", d, 10.0 * 1.001**k) for k, d in enumerate(days)] + [("half", d, 10.0 if k < 300 else 5.0) for k, d in enumerate(days)] + [("new", days[-1], 3.0)]
    out = {r.ts_code: r for r in pit.price_inputs(spark.createDataFrame(rows, "ts_code string, trade_date date, close double"), "2024-06-30").collect()}
    assert (out["flat"].ret_12m, out["flat"].vol_6m, out["flat"].max_dd_12m) == (0.0, 0.0, 0.0)
    assert out["up"].ret_1m == pytest.approx(1.001**30 - 1) and out["up"].vol_12m == pytest.approx(0, abs=1e-9) and out["up"].max_dd_12m == 0
    assert out["half"].max_dd_12m == -0.5 and out["half"].ret_12m == -0.5 and out["half"].ret_1m == 0 and out["half"].vol_6m > 0
    assert (out["new"].ret_1m, out["new"].vol_6m, out["new"].max_dd_12m) == (None, None, 0.0)


def test_frame_reads_only_what_is_needed(spark):
    universe = spark.createDataFrame([("a",), ("b",)], "ts_code string")
    mv = spark.createDataFrame([("a", 30.0)], "ts_code string, total_mv double")
    debt = spark.createDataFrame([("a", 5.0, 2.0, 1.0)], "ts_code string, interest_bearing_debt double, cash double, ebitda double")
    unread = spark.createDataFrame([("a", 1.0)], "ts_code string, roe double").withColumn("roe", F.raise_error(F.lit("read")).cast("double"))
    out = {r.ts_code: r for r in factors.build_frame(universe, [mv, debt, unread], ["ev_ebitda"]).collect()}
    assert out["a"].enterprise_value == 33.0 and out["b"].enterprise_value is None and "roe" not in out["a"].asDict()
    with pytest.raises(Exception, match="twice"):
        factors.build_frame(universe.unionAll(universe), [mv], ["ps"]).collect()


def test_compare_and_lookups(spark):
    names = spark.createDataFrame([(1, "n")], "ts_code long, name string")
    h = spark.createDataFrame([(1, date(2024, 1, k), float(k), None) for k in (1, 2, 3)], "ts_code long, trade_date date, pe double, pb double")
    rows = {(r.ts_code, r.indicator): r for r in compare.compare_page(h, names, [1, 2, 1], ["pe", "pb"]).collect()}
    assert rows[1, "pe"].pct == pytest.approx(200 / 3) and rows[1, "pb"].n is None and rows[2, "pe"].current is None and len(rows) == 4
    with pytest.raises(ValueError):
        compare.compare_page(h, names, [1, 1], ["pe"])
    assert lookups.in_keys(h, "ts_code", []).count() == 0 and lookups.in_keys(h, "ts_code", None).count() == 3
    assert lookups.in_keys(h, "ts_code", list(range(600))).count() == 3
    answer, missing = lookups.local_first(h, h.withColumn("ts_code", F.col("ts_code") + 1).unionAll(h), ["ts_code"])
    assert answer.count() == 6 and {r.ts_code for r in missing.collect()} == {2}
    assert lookups.register_frame(spark, [(1,)], "x int", "one_row").count() == 1 and spark.sql("SELECT x FROM one_row").first().x == 1
    assert lookups.benchmarks(spark).count() == 8


def test_votes_and_order(spark):
    signals = spark.createDataFrame([("a", 0.06, "strong_increase", "high"), ("b", -0.03, "decrease", "medium"), ("c", 0.0, "neutral", "low"), ("d", 0.01, "slight_increase", "high")], "sector string, change double, signal string, confidence string")
    votes = spark.createDataFrame([("a", 20, 1), ("a", 120, -1), ("b", 20, 1), ("b", 120, 1), ("c", 20, 1), ("d", 20, 0)], "sector string, window int, direction int")
    out = {r.sector: r for r in style.vote(signals, votes, ["sector"]).withColumn("place", style.signal_place()).collect()}
    assert (out["a"].consistency, out["a"].signal, out["a"].confidence, out["a"].place) == (0.5, "strong_increase", "high", 0)
    assert (out["b"].consistency, out["b"].signal, out["b"].confidence, out["b"].place) == (0.0, "neutral", "low", 3)
    assert (out["c"].consistency, out["d"].consistency, out["d"].place) == (None, None, 2)


def test_noise_is_stripped_to_the_last_layer(spark):
    noise = "转发微博" * 9 + " 来自手机客户端 " + "点赞 3 " * 7
    rows = [(1, f"<p>好公司&hellip;&eacute;</p>{noise}"), (2, "转发转发微博微博"), (3, None), (4, "\ufeff１２ＡＢ｜")]
    out = {r.k: r.c for r in spark.createDataFrame(rows, "k int, t string").select("k", X.clean_text("t").alias("c")).collect()}
    assert out == {1: "好公司…é", 2: "", 3: "", 4: "12AB"}


def test_normalised_tables(spark):
    h = {"pb": spark.createDataFrame([("a", date(2024, 1, 1), 1.0)], "ts_code string, trade_date date, pb double"), "ps": spark.createDataFrame([("a", date(2024, 1, 1), 3.0)] * 2, "ts_code string, trade_date date, ps double")}
    assert [tuple(r) for r in normalize.valuation_history(h).collect()] == [("a", date(2024, 1, 1), None, None, 1.0, 3.0, None)]
    with pytest.raises(ValueError):
        normalize.valuation_history({"ps": h["ps"]})
    raw = spark.createDataFrame([("c", "n", 5.0, "-")], "code string, name string, main double, rate string")
    row = normalize.vendor_sector_flows(raw, {"sector_code": "code", "sector_name": "name", "main_net_inflow": "main", "main_net_inflow_rate": "rate", "small_net_inflow": "small"}, "2024-01-02", "industry").first()
    assert (row.net_inflow, row.net_inflow_rate, row.inflow, row.retail_net_inflow) == (5.0, None, None, None)
    profile = normalize.company_profile(spark.createDataFrame([("1", "--", "1999-07-27")], "ts_code string, i string, l string"), {"ts_code": "ts_code", "industry": "i", "list_date": "l", "index_membership": "m"}).first()
    assert (profile.industry, profile.list_date) == ("", date(1999, 7, 27))


def test_backtest_honours_given_flags(spark):
    flagged = prices(spark, [10, 11, 12]).withColumn("limit_up", F.col("trade_date") == F.lit(D(2024, 1, 3)))
    out = backtest.run(flagged, signals(spark, (2, 1.0)), FREE)
    assert sum(col(out, "refused")) == 1 and sum(col(out, "filled")) == 0
    rows = spark.createDataFrame([("a", 12.0, 10.0), ("b", 11.0, 10.0), ("b", 12.0, 10.0), ("c", 9.0, None)], "ts_code string, close double, pre_close double")
    assert col(backtest.with_limits(rows, {"b": 0.2}), "at_limit_up") == [True, False, True, False]


def test_all_metrics(spark):
    equity = spark.createDataFrame([("s", D(2024, 1, k), v) for k, v in ((2, 100.0), (3, 110.0), (4, 104.5))], "k string, trade_date date, equity double")
    trades = spark.createDataFrame([("s", side, a, p) for side, a, p in (("SELL", 500.0, 100.0), ("SELL", 300.0, -50.0), ("SELL", 300.0, 200.0), ("SELL", 200.0, -25.0), ("BUY", 200.0, None))], "k string, side string, amount double, pnl double")
    m = risk.all_metrics(equity, ["k"], trades, equity).first()
    assert (m.win_rate, m.profit_factor, m.excess_return) == (0.5, 4.0, 0.0) and m.turnover == pytest.approx(1500 / 104.83333333) and m.cagr == pytest.approx(1.045**126 - 1)
    alone = risk.all_metrics(equity, ["k"]).first()
    assert (alone.turnover, alone.win_rate, alone.excess_return) == (0.0, None, None)


def test_saved_snapshots(spark, tmp_path):
    frame = spark.createDataFrame([(1, 5.0), (2, None)], "ts_code int, x double")
    names = [snapshots.create(frame, {"field": "x", "op": "gt", "value": v}, day, str(tmp_path)) for v, day in ((1, "2024-01-01"), (2, "2024-02-01"))]
    assert [(r.name, r.as_of, r.rows) for r in snapshots.saved(spark, str(tmp_path)).collect()] == [(names[1], "2024-02-01", 2), (names[0], "2024-01-01", 2)]


def test_neutralising_without_groups_or_sizes_fails(spark):
    df = spark.createDataFrame([("a", " ", 1.0, 5.0), ("b", None, 2.0, 5.0), ("c", "", 3.0, 5.0)], "k string, g string, x double, mv double")
    with pytest.raises(Exception, match="g is blank in every row"):
        preprocess.neutralize_groups(df, ["x"], "g").collect()
    for rows in (df, df.limit(2).withColumn("mv", F.col("x"))):
        with pytest.raises(Exception, match="rows with a mv"):
            preprocess.neutralize_size(rows, ["x"], "mv").collect()
    assert col(preprocess.neutralize_size(df.withColumn("by", F.lit(1)), ["x"], "mv", ["by"]), "x") == [None] * 3


def test_a_mapping_counts_each_stock_once(spark):
    flows = spark.createDataFrame([("a", 5.0, 2.0, 3.0, 10.0), ("b", None, 1.0, -1.0, 0.0), ("z", 1.0, 1.0, 0.0, 1.0)], "stock string, inflow double, outflow double, net double, turnover double")
    mapping = spark.createDataFrame([("a", "S2", "n2"), ("a", "S1", "n1"), ("b", "S3", "n3"), ("z", " ", "x")], "stock string, sector string, name string")
    out = {r.sector: tuple(r) for r in normalize.sector_flows(flows, mapping).collect()}
    assert out == {"S1": ("S1", "n1", 5.0, 2.0, 3.0, 10.0, 1, 30.0), "S3": ("S3", "n3", 0.0, 1.0, -1.0, 0.0, 1, None)}
    assert tuple(normalize.flow_coverage(flows, mapping).first()) == (2, 2, 3, 0.6667)


def test_snapshot_of_short_series(spark):
    rows = [("a", D(2024, 1, 1) + dt.timedelta(k), 10.0 + k) for k in range(30)] + [("b", D(2024, 1, 1), 5.0), ("n", D(2024, 1, 1), None)]
    out = {r.k: r for r in series.snapshot(spark.createDataFrame(rows, "k string, trade_date date, close double"), ["k"], offsets=(5, 40)).collect()}
    assert set(out) == {"a", "b"} and (out["a"].close, out["a"].ma5, out["a"].ma20, out["a"].ma60, out["a"].rsi, out["a"].mom_40) == (39.0, 37.0, 29.5, None, 100.0, None)
    assert out["a"].mom_5 == pytest.approx(39 / 34 - 1) and out["a"].dif is not None and (out["b"].ma5, out["b"].rsi, out["b"].dif) == (None, None, None)


def test_a_stock_that_is_mapped_twice_weighs_once(spark):
    held = spark.createDataFrame([("f", "a", 3.0), ("f", "b", 1.0), ("f", "z", 4.0)], "fund string, stock string, weight double")
    mapping = spark.createDataFrame([("a", "S2"), ("a", "S1"), ("b", "S2")], "stock string, l1 string")
    assert {r.sector: (r.weight, r.coverage) for r in portfolio.sector_weights(held, mapping, ["fund"]).collect()} == {"S1": (0.75, 0.5), "S2": (0.25, 0.5)}

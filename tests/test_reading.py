"""Responses, pages by cursor, postings, rule trees, rolling moments, thinned rows and comment texts against plain versions."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finlattice.functions import text as X
from finlattice.functions.numeric import six_digits
from finlattice.operators import point_in_time as pit
from finlattice.operators import alignment, benchmarks, commodities, investors, lookups, pages, screener, search, style
from finlattice.sources import responses

# responses


def parsed(spark, parser, payloads):
    df = spark.createDataFrame([(k, p, 77, "given") for k, p in enumerate(payloads)], "response int, payload string, user_id long, account_name string")
    posts, bad = parser(df)
    return {(r.response, r.item): r for r in posts.collect()}, {(r.response, r.item): r.reason for r in bad.collect()}


def test_board_posts(spark):
    items = [{"post_id": 5, "post_title": " T ", "post_content": "body ", "user_nickname": "n", "post_publish_time": "2024-05-06 07:08:09", "post_type": 1}, {"id": "x9", "post_content": "only"}, {"post_id": 0, "post_title": "t"}, {"post_id": 6, "post_title": "", "post_content": "  "}, "text", None, {"post_id": 7, "post_title": "title"}]
    payloads = [json.dumps({"data": {"list": items}}), json.dumps({"list": items[:1]}), json.dumps(items), "{broken", None, json.dumps({"data": {"list": 3}, "b": 1}), json.dumps({"data": {"list": []}}), json.dumps("text")]
    posts, bad = parsed(spark, responses.board_posts, payloads)
    assert set(posts) == {(0, 0), (0, 1), (0, 6), (1, 0)}
    first = posts[0, 0]
    assert (first.platform_id, first.content, first.account_name, first.published_at, first.source_url) == ("5", "T \nbody", "n", dt.datetime(2024, 5, 6, 7, 8, 9), "https://guba.eastmoney.com/news,77,5.html")
    assert json.loads(first.meta) == {"post_id": "5", "post_type": "1", "title": " T "}
    assert (posts[0, 1].platform_id, posts[0, 1].account_name, posts[0, 1].published_at, posts[0, 6].content) == ("x9", "given", None, "title")
    assert bad == {(0, 2): "no identifier", (0, 3): "no text", (0, 4): "no object", (0, 5): "no object", (2, None): "no object at the top", (3, None): "no JSON", (4, None): "no JSON", (5, None): "no list; fields: b, data", (7, None): "no object at the top"}


def test_timeline_posts(spark):
    items = [{"id": 11, "text": "a", "created_at": 1700000000123, "like_count": 4}, {"description": "b", "target": "/77/22/"}, {"text": "c"}, {"id": 1}, 3]
    posts, bad = parsed(spark, responses.timeline_posts, [json.dumps({"list": items}), json.dumps({"data": 1}), json.dumps({"list": None})])
    assert {k: (r.platform_id, r.content, r.source_url) for k, r in posts.items()} == {(0, 0): ("11", "a", "https://xueqiu.com/u/77"), (0, 1): ("22", "b", "https://xueqiu.com/77/22/")}
    assert posts[0, 0].published_at == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert bad == {(0, 2): "no identifier", (0, 3): "no text", (0, 4): "no object", (1, None): "no list; fields: data", (2, None): "no list; fields: list"}


# pages


@pytest.mark.parametrize("sort", [["v"], ["-v"], ["name", "-v"], ["-day", "v"], []])
def test_pages_follow_each_other(spark, sort):
    rng = random.Random(7)
    rows = [(k, rng.choice([None, 1.5, 2.0, -3.0, 7.25]), rng.choice([None, "a", "Ü", "b"]), rng.choice([None, dt.date(2024, 1, 1), dt.date(2023, 5, 5)])) for k in range(57)]
    df = spark.createDataFrame(rows, "k int, v double, name string, day date")
    whole = [r.k for r in df.orderBy(*(F.desc_nulls_last(s[1:]) if s[0] == "-" else F.asc_nulls_last(s) for s in sort), "k").collect()]
    seen, cursor = [], None
    while True:
        found, cursor = pages.with_cursor(df, sort, "k", 8, cursor)
        seen += [r.k for r in found]
        if cursor is None:
            break
    assert seen == whole


def test_a_page_is_a_top_k(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    _, cursor = pages.with_cursor(df, ["-v"], "id", 10)
    plan = pages.page(df, ["-v"], "id", 10, cursor)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan.replace("ExchangeSingle", "")
    for call, words in ((lambda: pages.page(df, ["x"], "id"), "no column x"), (lambda: pages.page(df, ["v"], "id", 501), "1 to 500"), (lambda: pages.page(df, ["v"], "id", 5, "??"), "no cursor"), (lambda: pages.page(df, ["v", "id"], "id", 5, pages.cursor_of([1])), "another order")):
        with pytest.raises(ValueError, match=words):
            call()


def test_ranking_filters_levels_and_counts_all(spark):
    df = spark.createDataFrame([(1, 5.0, "low"), (2, None, "high"), (3, 1.0, "low")], "k int, v double, level string")
    page, counts = pages.ranking(df, ["v"], "k", 5, levels=["low"])
    assert [r.k for r in page.collect()] == [3, 1] and {r.level: r.n for r in counts.collect()} == {"low": 2, "high": 1}


# postings


def test_indexed_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(3)
    names = ["".join(rng.choice("abÄ ") for _ in range(rng.randrange(0, 9))) for _ in range(120)] + [None, "aaaa", "AAAAAA"]
    dim = spark.createDataFrame([(f"{rng.randrange(10**6):06d}.SZ", n) for n in names], "ts_code string, name string").dropDuplicates(["ts_code"])
    search.index_grams(dim, str(tmp_path / "grams"))
    index = spark.read.parquet(str(tmp_path / "grams"))
    for asked in ("a", "A", "ab", "aaa", "aaaa", "ä a", "00", "12", "999999", ".sz", "zzz", "b ab"):
        got = [(r.ts_code, r["rank"]) for r in search.suggest_indexed(index, dim, asked).collect()]
        assert got == [(r.ts_code, r["rank"]) for r in search.suggest(dim, asked).collect()], asked
    plan = search.suggest_indexed(index, dim, "aaaa")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "PushedFilters" in plan and "gram" in plan.split("PushedFilters")[1][:120]


# rule trees

leaf = st.one_of(
    st.builds(lambda f, o, v: {"field": f, "op": o, "value": v}, st.sampled_from("abc"), st.sampled_from(["lt", "le", "gt", "ge", "eq", "ne"]), st.integers(-2, 2)),
    st.builds(lambda f, o: {"field": f, "op": o}, st.sampled_from("abc"), st.sampled_from(["isna", "notna"])),
    st.builds(lambda f, v: {"field": f, "op": "in", "value": v}, st.sampled_from("abc"), st.lists(st.integers(-2, 2), min_size=1, max_size=3)),
)
specs = st.recursive(leaf, lambda s: st.builds(lambda w, x: {w: x}, st.sampled_from(["all", "any"]), st.lists(s, min_size=1, max_size=4)), max_leaves=12)


def holds(spec, row):
    for word, of in (("all", all), ("any", any)):
        if word in spec:
            return of(holds(s, row) for s in spec[word])
    x, v = row[spec["field"]], spec.get("value")
    if spec["op"] in ("isna", "notna"):
        return (x is None) == (spec["op"] == "isna")
    return x is not None and {"lt": lambda: x < v, "le": lambda: x <= v, "gt": lambda: x > v, "ge": lambda: x >= v, "eq": lambda: x == v, "ne": lambda: x != v, "in": lambda: x in v}[spec["op"]]()


@given(specs, st.fixed_dictionaries({c: st.one_of(st.none(), st.integers(-2, 2)) for c in "abc"}), st.randoms())
@settings(max_examples=300, deadline=None)
def test_specifications_come_back(spec, row, rng):
    assert screener.to_spec(screener.parse(spec)) == spec
    normal = screener.normal_form(spec)
    assert screener.normal_form(normal) == normal and holds(normal, row) == holds(spec, row)

    def shuffled(s):
        for word in ("all", "any"):
            if word in s:
                parts = [shuffled(x) for x in s[word]]
                parts += [parts[0]]
                rng.shuffle(parts)
                return {word: [{word: parts}]}
        return s

    assert screener.normal_form(shuffled(spec)) == normal


def test_specification_errors_name_the_place(spark):
    for spec, words in (({"all": [{"any": []}]}, r"condition.all\[0\].any is empty"), ({"any": [3]}, r"condition.any\[0\]: a rule or"), ({"field": "a", "op": "in", "value": "xy"}, "in needs a list"), ({"all": [{"field": "a", "op": "lt"}]}, r"condition.all\[0\]: lt needs a value")):
        with pytest.raises(ValueError, match=words):
            screener.parse(spec)


@pytest.mark.parametrize("seed", range(3))
def test_rules_in_spark_hold_as_told(spark, seed):
    rng = random.Random(seed)
    rows = [tuple(rng.choice([None, -1, 0, 1, 2]) for _ in "abc") for _ in range(40)]
    make = lambda d: {"field": rng.choice("abc"), "op": rng.choice(["lt", "ge", "ne"]), "value": rng.randrange(-1, 3)} if d == 0 or rng.random() < 0.3 else {rng.choice(["all", "any"]): [make(d - 1) for _ in range(rng.randrange(1, 4))]}
    spec = make(3)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a int, b int, c int")
    got = {r.k: r.passed for r in df.select("k", screener.compile_rules(screener.normal_form(spec)).alias("passed")).collect()}
    assert got == {k: holds(spec, dict(zip("abc", r, strict=True))) for k, r in enumerate(rows)}


def test_six_digits(spark):
    values = [0.0, 1.0, -2.5, 1234567.0, 999999.5, 0.0001, 0.00001234567, 46.56885, 1e300, -1e-300, 100000.5, float("nan"), None]
    out = [r.t for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(six_digits("v").alias("t")).collect()]
    assert out == [None if v is None or v != v else "%.6g" % v for v in values]


# rolling decomposition


def plain_fit(x, y):
    x, y = x - x.mean(axis=0), y - y.mean()
    return style.solve(x.T @ x, x.T @ y)


def test_windows_by_differences_equal_windows_of_their_own(spark):
    rng = np.random.default_rng(5)
    n, k = 140, 4
    x = rng.normal(0.001, 0.02, (n, k))
    y = x @ [0.5, 0.2, 0.0, 0.1] + rng.normal(0, 0.003, n)
    moments = style.Moments(x, y)
    for first, last in ((0, 20), (3, 63), (80, 140), (0, 140)):
        w, r2, mean, deviation = moments.fit(first, last)
        want = plain_fit(x[first:last], y[first:last])
        rest = y[first:last] - x[first:last] @ want
        assert w == pytest.approx(want, abs=1e-7)
        assert (r2, mean, deviation) == pytest.approx((1 - rest.var() / y[first:last].var(), rest.mean(), rest.std(ddof=1)), rel=1e-6, abs=1e-9)
    x[70, 2] = np.nan
    assert style.Moments(x, y).fit(60, 100) is None and style.Moments(x, y).fit(71, 100) is not None
    assert style.Moments(x[:30], np.full(30, 0.01)).fit(0, 30)[1] is None


def test_decomposition_takes_each_funds_own_days(spark):
    rng = np.random.default_rng(6)
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(90)]
    x = rng.normal(0, 0.01, (90, 2))
    y = x @ [0.6, 0.3] + rng.normal(0, 0.001, 90)
    funds = [("all", d, float(v)) for d, v in zip(days, y, strict=True)] + [("late", d, float(v)) for d, v in zip(days[50:], y[50:], strict=True)] + [("gaps", d, float(v) if k % 3 else None) for k, (d, v) in enumerate(zip(days, y, strict=True))]
    rng.shuffle(funds)
    df = spark.createDataFrame([(f, d, None if v is None else float(v)) for f, d, v in map(tuple, funds)], "fund string, day date, r double")
    sectors = spark.createDataFrame([(f"s{j}", d, float(x[k, j])) for k, d in enumerate(days) for j in range(2)], "sector string, day date, r double")
    ends = spark.createDataFrame([(days[30],), (days[89] + dt.timedelta(5),), (days[30],), (None,)], "end_date date")
    out = {(r.fund, r.end_date, r.sector): r.exposure for r in style.decompose(df, sectors, ends, window=40, least=20).collect()}
    assert {k[:2] for k in out} == {("all", days[30]), ("all", days[89] + dt.timedelta(5)), ("late", days[89] + dt.timedelta(5)), ("gaps", days[30]), ("gaps", days[89] + dt.timedelta(5))}
    own = [k for k in range(90) if k % 3][-40:]
    for fund, end, rows in (("all", days[30], range(31)), ("late", days[89] + dt.timedelta(5), range(50, 90)), ("gaps", days[89] + dt.timedelta(5), own)):
        assert [out[fund, end, f"s{j}"] for j in range(2)] == pytest.approx(list(plain_fit(x[list(rows)], y[list(rows)])), abs=1e-6)


# thinned rows


@pytest.mark.parametrize("n, most", [(0, 5), (5, 5), (6, 5), (1003, 10), (400, 399)])
def test_thinned_rows_are_evenly_spaced(spark, n, most):
    rows = [(k * 7 % n if n else 0, k) for k in range(n)]
    out = alignment.thinned(spark.createDataFrame(rows, "o int, k int").repartition(5), ["o"], most)
    assert sorted(r.o for r in out.collect()) == (list(range(n)) if n <= most else [k * n // most for k in range(most)])


def test_scatter_takes_covered_fields(spark):
    df = spark.createDataFrame([(k, float(k), None if k % 3 else 1.0, float(-k)) for k in range(12)], "k int, a double, b double, c double")
    chosen, rows = alignment.scatter(df, ["b", "b", "c", "a", "zz"], ["k"], 4)
    assert chosen == ["a", "c"] and [r.k for r in rows.orderBy("k").collect()] == [0, 3, 6, 9]
    assert alignment.scatter(df, ["b", "a"], ["k"]) == ([], None)


# texts


def test_comments_are_cleaned(spark):
    rows = {
        "<p>A&amp;B</p><b>c</b>": "A&B c", "x&lt;y&nbsp;z&#12354;": "x<y zあ", "ＡＢｃ１２﻿3": "ABc123", "好文 转转发微博发微博": "好文", "看法 分享给我的好朋友": "看法", " -｜ok|- ": "ok", "a　\n b": "a b", "点赞 12评论 3": "", "plain": "plain", "&lt;p&gt;kept": "<p>kept",
    }
    out = {r.t: r.c for r in spark.createDataFrame([(t,) for t in rows], "t string").withColumn("c", X.clean_text("t")).collect()}
    assert out == rows


def test_noise_is_taken_off_to_the_last_layer(spark):
    rng = random.Random(1)
    parts = ["转发微博", "转发", "微博", "点赞", " 3", "评论", "1", "来自", "客户端", "网页", "链接", "（来自x）", "好", " ", "阅读", "全文"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))).strip(),) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string").withColumn("once", X.without_noise("t"))
    for r in df.withColumn("twice", X.without_noise("once")).withColumn("left", F.regexp_replace("once", X.NOISE, "")).collect():
        assert r.twice == r.once == r["left"].strip(" ")


def test_titles_know_all_references(spark):
    df = spark.createDataFrame([("<em>A</em>&eacute;&#x4e2d;&mdash;&nbsp;",), (None,)], "t string")
    assert [r.c for r in df.select(X.clean_title("t").alias("c")).collect()] == ["Aé中—", ""]


# small pages


def test_commodities_that_mislead(spark):
    registry = lookups.commodities(spark)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [("gold", day(k), 100.0 + k) for k in range(80)] + [("copper", day(k), 5.0) for k in range(59)] + [("coke", day(k), 9.0 - k / 100) for k in range(60)]
    out = {r.symbol: r for r in commodities.catalogue(registry, spark.createDataFrame(rows, "symbol string, trade_date date, close double"), day(80)).collect()}
    assert len(out) == 10 and out["gold"].pct == 98.75 and (out["gold"].stale, out["gold"].n) == (False, 80)
    assert (out["copper"].pct, out["copper"].n, out["copper"].lag_days) == (None, 0, 22) and (out["coke"].pct, out["coke"].n, out["coke"].stale) == (None, 60, True)
    assert out["rebar"].price is None and out["rebar"].level == "-"
    assert [r.symbol for r in commodities.by_symbol(registry, " Gold ").collect()] == ["gold"]


def test_benchmarks_are_cached_or_made(spark, tmp_path):
    stored = benchmarks.table(spark, str(tmp_path / "w"))
    mapping = spark.createDataFrame([("s1", "A"), ("s2", "B")], "stock string, l1 string")
    parts = spark.createDataFrame([("x", dt.date(2024, 1, 31), "s1", 3.0), ("x", dt.date(2024, 1, 31), "s2", 1.0), ("x", dt.date(2024, 1, 31), "s9", 4.0), ("x", dt.date(2023, 1, 31), "s1", 9.0), ("z", dt.date(2024, 1, 31), "s9", 1.0)], "benchmark_code string, as_of_date date, stock string, weight double")
    ask = lambda today, anew=False: benchmarks.snapshot(stored, spark.createDataFrame([("x",), ("y",), ("z",)], "benchmark_code string"), parts, mapping, 1, today, anew)
    weights, notes = ask("2024-02-10")
    assert {r.sector_code: (r.weight, r.coverage) for r in weights.collect()} == {"A": (0.75, 0.5), "B": (0.25, 0.5)}
    assert {r.benchmark_code: (r.cached, r.stale, r.reason) for r in notes.collect()} == {"x": (False, False, None), "y": (False, False, "no constituents"), "z": (False, False, "no constituent has a sector")}
    parts = parts.unionAll(spark.createDataFrame([("x", dt.date(2024, 6, 30), "s2", 1.0)], parts.schema))
    weights, notes = ask("2024-07-01")
    assert {r.benchmark_code: (r.cached, r.stale) for r in notes.collect()}["x"] == (True, True) and weights.count() == 2
    weights, notes = ask("2024-07-01", True)
    assert [(r.sector_code, r.weight) for r in weights.collect()] == [("B", 1.0)]


def test_nobody_has_a_profile(spark):
    people = spark.createDataFrame([("a",)], "investor_code string")
    none = spark.createDataFrame([], "investor_code string, quote_id long, status string, published_at date")
    assert investors.profile(people, people, none, "b") is None
    found = investors.profile(people, people, none, "a")
    assert found["investor"].count() == 1 and found["quotes"].count() == 0
    assert investors.listed(people, people, none).first().asDict() == {"investor_code": "a", "account_count": 1, "quote_count": 0, "verified_count": 0, "last_captured": None}


def test_adjusted_prices_step_at_events(spark):
    p = spark.createDataFrame([("a", dt.date(2024, 1, k), 10.0) for k in range(1, 6)], "ts_code string, trade_date date, close double")
    e = spark.createDataFrame([("a", dt.date(2024, 1, 2), 1.5), ("a", dt.date(2024, 1, 4), 3.0)], "ts_code string, trade_date date, factor double")
    assert [(r.forward, r.backward) for r in pit.adjusted(p, e).orderBy("trade_date").collect()] == [(3.3333, 10.0), (5.0, 15.0), (5.0, 15.0), (10.0, 30.0), (10.0, 30.0)]
    assert pit.latest_of(p, "ts_code", "z", day="trade_date").count() == 0
    assert pit.latest_of(p, "ts_code", "a", "2024-01-03", "trade_date").first().trade_date == dt.date(2024, 1, 3)


def test_days_become_text_at_any_depth(spark):
    df = spark.sql("select date'2024-01-02' d, array(named_struct('t', timestamp'2024-01-02 03:04:05', 'n', 1), null) a, map('k', date'2023-05-06') m, map(date'2022-02-03', 2) k, 'x' s, cast(null as struct<d: date>) z")
    r = X.iso_payload(df).first()
    assert (r.d, r.a[0].t, r.a[1], r.m, r.k, r.s, r.z) == ("2024-01-02", "2024-01-02 03:04:05", None, {"k": "2023-05-06"}, {"2022-02-03": 2}, "x", None)


def test_a_screen_with_preprocessing_names_what_is_missing(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(5)], "ts_code int, x double")
    out = screener.run(df, {"preprocess": [("zscore", {"columns": ["x"]})], "rules": {"field": "x", "op": "gt", "value": 0}})
    assert tuple(out["counts"].first()) == (5, 2, 3) and [r.ts_code for r in out["codes"].collect()] == [3, 4]
    assert out["summary"].columns == ["ts_code", "x", "passed", "failed_rules"] and out["detail"].count() == 5
    with pytest.raises(ValueError, match="factors missing: y"):
        screener.run(df, {"rules": {"field": "y", "op": "isna"}})
    with pytest.raises(ValueError, match="rules"):
        screener.run(df, {})


def test_events_by_what_is_given(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 2), "X"), ("b", dt.date(2024, 1, 1), "Y"), ("a", dt.date(2023, 1, 1), "Y")], "ts_code string, event_date date, event_type string")
    pick = lambda *a: [(r.ts_code, r.event_type) for r in search.events(df, *a).collect()]
    assert (pick(), pick("a"), pick(None, "2024-01-01"), pick("a", None, "X")) == ([("a", "Y"), ("b", "Y"), ("a", "X")], [("a", "Y"), ("a", "X")], [("a", "Y"), ("b", "Y")], [("a", "X")])

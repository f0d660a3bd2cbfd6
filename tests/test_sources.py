"""Raw shapes to the engine's tables, and alignment along time."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from finlattice.operators import alignment, snapshots
from finlattice.sources import normalize, vendor_pages

D = dt.date


def test_prices_are_coerced_and_deduplicated(spark):
    raw = spark.createDataFrame([("600519", "2024-01-02", "10.5", "200"), ("600519", "20240102", "10.5", "200"), ("1", "bad", "3", "1"), ("000001", "2024-01-02", "-", "1")], "`代码` string, `日期` string, `收盘` string, `成交量` string")
    out = normalize.prices(raw, {"ts_code": "代码", "trade_date": "日期", "close": "收盘", "volume": "成交量", "amount": "成交额"}, 100).collect()
    assert [(r.ts_code, r.trade_date, r.close, r.volume, r.amount) for r in out] == [("600519.SH", D(2024, 1, 2), 10.5, 2.0, None)]


def test_statements(spark):
    raw = spark.createDataFrame([("a", "2023-12-31", "2024-04-01", "5", None, "7", "2"), ("a", "2023-12-31", None, "5", "1", "7", "2")], "c string, p string, n string, d1 string, d2 string, cfo string, capex string")
    out = normalize.statements(raw, {"ts_code": "c", "report_period": "p", "announce_date": "n", "d1": "d1", "d2": "d2", "cfo": "cfo", "capex": "capex"}, "x", ["d1", "d2"], "cfo", "capex").collect()
    assert [(r.available_date, r.interest_bearing_debt, r.free_cash_flow, r.source) for r in out] == [(D(2024, 4, 1), 5.0, 5.0, "x")]


def test_series_cleaner(spark):
    raw = spark.createDataFrame([("g", "2024-01-01", "1", 1), ("g", "2024-01-01", "2", 2), ("g", "x", "2", 3), ("g", "2024-01-02", "-1", 4), ("g", "2024-01-03", "NaN", 5)], "s string, d string, v string, k int")
    assert [tuple(r) for r in normalize.clean_series(raw, ["s"], "d", "v", ["k"]).collect()] == [("g", D(2024, 1, 1), 2.0)]


def test_source_order(spark):
    a = spark.createDataFrame([(1, None), (2, 5.0)], "k int, v double")
    b = spark.createDataFrame([(1, 7.0), (2, 6.0)], "k int, v double")
    assert sorted(map(tuple, normalize.first_source([a, b], ["k"], "v").collect())) == [(1, 7.0, 1), (2, 5.0, 0)]


def test_manual_quotes(spark, tmp_path):
    rows = [
        {"investor_code": "a", "platform": "manual", "content": "<p>估值便宜，买入600519</p>", "published_at": "2024-01-02 10:00:00", "verification": "verified", "source_url": "https://x"},
        {"investor_code": "b", "platform": "web", "platform_id": "9", "content": "估值便宜，买入６００５１９", "verification": "verified"}, {"investor_code": "c", "platform": "web", "content": "赞"},
    ]
    for shape in (rows, {"quotes": rows}):
        path = tmp_path / "q.json"
        path.write_text(json.dumps(shape, ensure_ascii=False), encoding="utf-8")
        out = normalize.manual_quotes(spark, str(path)).collect()
        assert len(out) == 1 and out[0].stock_codes == ["600519"] and out[0].quote_type == "position"
    path.write_text("[{\"content\": \"x\", \"platform\": ]")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        normalize.manual_quotes(spark, str(path)).collect()


def test_announcements_and_flows(spark):
    raw = spark.createDataFrame([("1", "a", 1704042000000, "t"), ("1", "a", 1704042000001, "t"), ("2", "a", 1704042000000, "t"), ("3", "a", 1704142000000, "t")], "announcement_id string, ts_code string, publish_time long, title string")
    assert sorted(r.announcement_id for r in normalize.announcements(raw).collect()) == ["1", "3"]
    f = spark.createDataFrame([("600519", "1.5亿", 1), ("600519", "2亿", 2), ("HK1", "1亿", 1)], "code string, net string, k int")
    assert [(r.code, r.net) for r in normalize.stock_flows(f, "code", ["net"], ["k"]).collect()] == [("600519", 2e8)]


def test_holding_tables_and_jsonp(spark):
    page = "<table><tr><th>序号</th><th>股票代码</th><th>占净值比例</th></tr><tr><td>1</td><td>600519</td><td>9.5%</td></tr><tr><td>2</td><td>000001</td><td>1%</td></tr></table>"
    out = normalize.holding_tables(spark.createDataFrame([(1, page), (2, None)], "k long, html string"), "k", "html", {"stock": ("代码",), "weight": ("占净值",)})
    assert [tuple(r) for r in out.collect()] == [(1, 1, "600519", "9.5%"), (1, 2, "000001", "1%")]
    df = spark.createDataFrame([('cb([{"d":"2024-01-01","c":"5"}]);',)], "t string").select(normalize.jsonp_rows(F.col("t"), "struct<d:string,c:string>").alias("r"))
    assert df.first().r[0].c == "5"


def test_lifecycle_and_mapping(spark):
    l = spark.createDataFrame([("a", "A", D(2020, 1, 1))], "ts_code string, name string, list_date date")  # noqa: E741
    d = spark.createDataFrame([("z", "Z", D(1999, 1, 1), D(2010, 1, 1))], "ts_code string, name string, list_date date, delist_date date")
    assert normalize.lifecycle_events(l, d).count() == 2
    m = normalize.back_filled_mapping(spark.createDataFrame([("s", None, "x1"), ("t", "Y", "x1")], "stock string, l1 string, l2 string"), spark.createDataFrame([("x1", "X")], "code string, parent string"))
    assert sorted(map(tuple, m.collect())) == [("s", "X", "x1"), ("t", "Y", "x1")]


def test_step_sums_are_open_closed(spark):
    steps = spark.createDataFrame([("s", D(2024, 1, k)) for k in (1, 5, 9)], "s string, d date")
    flows = spark.createDataFrame([("s", D(2024, 1, k), float(k)) for k in (1, 2, 5, 6, 10)], "s string, d date, v double")
    assert sorted((r.d.day, r.v, r.n) for r in alignment.step_sums(steps, flows, ["s"], "d", "v").collect()) == [(5, 7.0, 2), (9, 6.0, 1)]


def test_thinning(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    kept = sorted(r.k for r in alignment.thinned(df, ["k"], 100).collect())
    assert len(kept) == 100 and kept[0] == 0 and max(b - a for a, b in zip(kept, kept[1:])) == 100
    assert alignment.thinned(df, ["k"], 20_000).count() == 10_000


def test_snapshots_are_immutable(spark, tmp_path):
    frame = spark.createDataFrame([("a", 5.0), ("b", 50.0)], "ts_code string, pe double")
    spec = {"field": "pe", "op": "lt", "value": 20}
    name = snapshots.create(frame, spec, "2024-06-30", str(tmp_path))
    with pytest.raises(Exception, match="exist"):
        snapshots.create(frame, spec, "2024-06-30", str(tmp_path))
    assert snapshots.rerun(spark, str(tmp_path), name, frame).count() == 0
    changed = spark.createDataFrame([("a", 25.0), ("c", 1.0)], "ts_code string, pe double")
    assert {r.ts_code: r.kind for r in snapshots.rerun(spark, str(tmp_path), name, changed).collect()} == {"a": "changed", "b": "removed", "c": "added"}


def test_vendor_pages_by_header_place_span_and_unit():
    head = "<tr><th>序号</th><th>股票代码</th><th>股票名称</th><th>占净值比例</th><th>持股数（万股）</th><th>持仓市值（{}）</th></tr>"
    row = "<tr><td>{}</td><td>{}</td><td>{}</td><td>{}</td><td>{}</td><td>{}</td></tr>"
    table = "<table>" + head.format("万元") + row.format(3, "600519", "<a>贵州&amp;茅台</a>", "9.53%", "1,000.5", "1,234.5") + row.format("", "700", "腾讯", "--", "-", "") + "<tr><td>9</td></tr></table>"
    menu = "<table><tr><td>menu</td></tr></table>"
    assert vendor_pages.rows_of(menu + table) == [(3, "600519", "贵州&茅台", pytest.approx(0.0953), 12_345_000.0, 1000.5), (2, "700", "腾讯", None, None, None)]
    assert vendor_pages.rows_of("<table>" + head.format("元") + row.format(1, "1", "n", "1%", "2", "7") + "</table>")[0][4] == 7.0
    # a vendor's class without a header: by place, in ten thousands
    assert vendor_pages.rows_of(f"{menu}<table class='tzxq big'><tr><td colspan=6>x</td></tr>{row.format(1, '000001', 'n', '5', '6', '7')}</table>") == [(1, "000001", "n", 0.05, 70_000.0, 6.0)]
    # a name that spans two rows stands in both, and a cell over two columns moves the next ones
    spans = "<table><tr><th colspan=2>股票名称</th><th>股票代码</th><th>占净值比例</th></tr><tr><td rowspan=2>A</td><td>a</td><td>600000</td><td>1</td></tr><tr><td>b</td><td>600001</td><td>2</td></tr></table>"
    assert [(r[1], r[2], r[3]) for r in vendor_pages.rows_of(spans)] == [("600000", "A", 0.01), ("600001", "A", 0.02)]
    assert vendor_pages.rows_of(menu) == vendor_pages.rows_of(None) == vendor_pages.rows_of("<table>") == []


def test_script_strings(spark):
    cases = {r'var a={ content:"x\"y\'z\\ \/ \u4e2d\n\t\v\q",b:1}': "x\"y'z\\ / 中\n\t\x0b", 'content : "line\nbreak"': "line\nbreak", 'content:"cut off': None, "nothing": None, 'content:""': ""}
    assert {k: vendor_pages.script_string(k) for k in cases} == cases and vendor_pages.script_string(None) is None
    assert vendor_pages.script_string('content:"' + "<td>\\/" * 100_000 + '"') == "<td>/" * 100_000
    page = "<table><tr><th>股票代码</th><th>a</th><th>占净值比例</th></tr><tr><td>700</td><td></td><td>5%</td></tr></table>"
    df = spark.createDataFrame([(1, 'x={content:"' + page.replace("/", "\\/") + '"}'), (2, page), (3, None)], "k long, t string")
    assert [(r.k, r.rank, r.stock_code, r.weight) for r in vendor_pages.holdings(df, "k", "t", True).collect()] == [(1, 1, "000700.SZ", 0.05)]

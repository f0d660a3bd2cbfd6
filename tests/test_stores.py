"""Writes by key, kept results and percentiles in a stream: what is killed, replayed or changed leaves right tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from finlattice.operators import cache, percentiles
from finlattice.sources import shared, store
from finlattice.streaming import percentiles as SP


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


@pytest.fixture
def prices(spark, tmp_path):
    schema = spark.createDataFrame([], "ts_code string, trade_date date, close double").schema
    return store.KeyedTable(spark, str(tmp_path / "prices"), schema, store.SPECS["daily_prices"])


def price(spark, *rows):
    return spark.createDataFrame([(c, dt.date.fromisoformat(d), v) for c, d, v in rows], "ts_code string, trade_date date, close double")


def test_upsert_rewrites_only_touched_partitions(spark, prices, tmp_path):
    assert prices.upsert(price(spark, ("a", "2023-01-02", 1.0), ("a", "2024-01-02", 2.0), ("b", "2024-01-02", 3.0))) == 2
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "prices" / "part=2023").iterdir()}
    assert prices.upsert(price(spark, ("a", "2024-01-02", 9.0), ("c", "2024-05-01", 4.0), ("c", "2024-05-01", 4.0))) == 1
    assert rows_of(prices) == [("a", dt.date(2023, 1, 2), 1.0), ("a", dt.date(2024, 1, 2), 9.0), ("b", dt.date(2024, 1, 2), 3.0), ("c", dt.date(2024, 5, 1), 4.0)]
    assert kept == {p: p.stat().st_mtime_ns for p in (tmp_path / "prices" / "part=2023").iterdir()}
    assert prices.insert(price(spark, ("a", "2024-01-02", 0.0), ("d", "2023-01-02", 5.0))) == 2
    assert [r for r in rows_of(prices) if r[0] in "ad"] == [("a", dt.date(2023, 1, 2), 1.0), ("a", dt.date(2024, 1, 2), 9.0), ("d", dt.date(2023, 1, 2), 5.0)]


def test_upsert_of_null_keys_repeats_and_nothing(spark, prices):
    assert prices.upsert(price(spark)) == 0 and rows_of(prices) == []
    source = price(spark, ("a", "2024-01-02", 1.0), ("a", "2024-01-02", 2.0)).unionAll(spark.sql("select cast(null as string), date'2024-01-02', 3.0D"))
    assert prices.upsert(source, order=["close"]) == 1
    assert rows_of(prices) == [("a", dt.date(2024, 1, 2), 2.0)]
    with pytest.raises(ValueError, match="trade_date"):
        prices.upsert(source.drop("trade_date"))


def test_a_write_killed_before_its_mark_changes_nothing(spark, prices):
    prices.upsert(price(spark, ("a", "2024-01-02", 1.0)))
    broken = price(spark, ("a", "2024-01-02", 2.0)).withColumn("close", F.when(F.col("close") > 1, F.raise_error(F.lit("killed"))).cast("double"))
    with pytest.raises(Exception, match="killed"):
        prices.upsert(broken)
    assert rows_of(prices) == [("a", dt.date(2024, 1, 2), 1.0)]
    prices.upsert(price(spark, ("b", "2024-01-02", 3.0)))
    assert [r[0] for r in rows_of(prices)] == ["a", "b"]


def test_a_write_killed_after_its_mark_counts_and_is_finished(spark, prices, monkeypatch, tmp_path):
    prices.upsert(price(spark, ("a", "2023-01-02", 1.0), ("a", "2024-01-02", 1.0)))
    real = store.KeyedTable.recover
    calls = []
    monkeypatch.setattr(store.KeyedTable, "recover", lambda self: calls.append(1) or (real(self) if len(calls) == 1 else None))
    prices.upsert(price(spark, ("a", "2024-01-02", 7.0), ("b", "2025-01-02", 8.0)))
    want = [("a", dt.date(2023, 1, 2), 1.0), ("a", dt.date(2024, 1, 2), 7.0), ("b", dt.date(2025, 1, 2), 8.0)]
    assert rows_of(prices) == want and shared.names(spark, str(tmp_path / "prices" / "_staged"))
    monkeypatch.setattr(store.KeyedTable, "recover", real)
    shared.delete(spark, str(tmp_path / "prices" / "part=2024"))  # as if it was killed in the middle of the overwrite
    assert rows_of(prices) == want
    prices.recover()
    prices.recover()
    assert rows_of(prices) == want and not shared.names(spark, str(tmp_path / "prices" / "_staged"))


def test_owners_never_overwrite_each_other(spark, tmp_path):
    schema = spark.createDataFrame([], "ts_code string, name string, industry string, market string, list_date date, delist_date date, status string").schema
    table = store.KeyedTable(spark, str(tmp_path / "s"), schema, store.SPECS["securities"])
    table.upsert(spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], "ts_code string, name string, industry string"), "identity")
    table.upsert(spark.createDataFrame([("a", "LISTED"), ("c", "PRE_LIST")], "ts_code string, status string"), "lifecycle")
    table.upsert(spark.createDataFrame([("a", "AA", None)], "ts_code string, name string, industry string"), "identity")
    assert sorted((r.ts_code, r.name, r.industry, r.status) for r in table.read().collect()) == [("a", "AA", None, "LISTED"), ("b", "B", "y", None), ("c", None, None, "PRE_LIST")]
    with pytest.raises(ValueError, match="does not own status"):
        table.upsert(spark.createDataFrame([("a", "X")], "ts_code string, status string"), "identity")
    with pytest.raises(ValueError, match="identity, lifecycle"):
        table.upsert(spark.createDataFrame([("a", "X")], "ts_code string, name string"))


def test_replace_takes_out_what_has_the_prefix(spark, tmp_path):
    schema = spark.createDataFrame([], "benchmark_code string, level int, sector_code string, weight double").schema
    table = store.KeyedTable(spark, str(tmp_path / "w"), schema, store.SPECS["benchmark_weights"])
    make = lambda *rows: spark.createDataFrame(rows, schema)
    table.upsert(make(("x", 1, "s", 0.4), ("x", 1, "t", 0.6), ("x", 2, "s", 1.0), ("y", 1, "s", 1.0)))
    table.replace(make(("x", 1, "u", 1.0)), ["benchmark_code", "level"])
    assert rows_of(table) == [("x", 1, "u", 1.0), ("x", 2, "s", 1.0), ("y", 1, "s", 1.0)]
    with pytest.raises(ValueError, match="level"):
        table.replace(make(("x", 1, "u", 1.0)), ["level"])


def test_results_are_made_once_a_version(spark, tmp_path):
    source, made = str(tmp_path / "source"), []
    spark.range(10).write.parquet(source)
    kept = cache.ResultCache(spark, str(tmp_path / "kept"))

    def ask(spec):
        table = spark.read.parquet(source)
        data = cache.files_version(table)
        return kept.get("sums", spec, data, lambda: made.append(spec) or table.agg(F.sum("id").alias("s"))).first()["s"]

    assert [ask({"a": 1, "b": 2}), ask({"b": 2, "a": 1})] == [45, 45] and len(made) == 1
    assert ask({"a": 2}) == 45 and len(made) == 2
    spark.range(10, 12).write.mode("append").parquet(source)
    assert ask({"a": 1, "b": 2}) == 66 and len(made) == 3
    assert [n for n in shared.names(spark, kept._place("sums", {"a": 1, "b": 2}))] == [cache.files_version(spark.read.parquet(source))]
    kept.invalidate("sums", {"a": 1, "b": 2})
    assert ask({"a": 1, "b": 2}) == 66 and len(made) == 4


def test_a_result_that_fails_leaves_nothing(spark, tmp_path):
    kept = cache.ResultCache(spark, str(tmp_path / "kept"))
    with pytest.raises(Exception, match="broken"):
        kept.get("r", {}, "v1", lambda: spark.range(3).select(F.raise_error(F.lit("broken")).cast("string").alias("x")))
    assert not kept.has("r", {}, "v1")
    assert kept.get("r", {}, "v1", lambda: spark.range(3)).count() == 3 and kept.has("r", {}, "v1")


# percentiles of a stream


def _run(spark, tmp_path, batches, **settings):
    """The last row of every key after all batches, each a file of the stream."""
    for k, v in SP.STATE_STORE.items():
        spark.conf.set(k, v)
    place, schema = tmp_path / "in", "ts_code string, trade_date date, pe_ttm double"
    place.mkdir()
    seen = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(place))
        stream = SP.running_percentiles(spark.readStream.schema(schema).parquet(str(place)), "ts_code", "pe_ttm", **settings)
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: seen.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    last = {}
    for r in seen:
        last[r.key] = r
    return last, seen


def test_stream_percentiles_equal_the_batch_after_replays(spark, tmp_path):
    rng = random.Random(4)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(c, day(k), rng.choice([rng.lognormvariate(2, 1), 7.0, -3.0, 0.0])) for c in "abc" for k in range(25)] + [("z", day(3), -1.0), ("n", day(1), None), (None, day(1), 1.0)]
    rng.shuffle(rows)
    corrected = [("a", day(3), 123.0), ("b", day(24), 7.0)]
    last, _ = _run(spark, tmp_path, [rows[:30], rows[20:60], rows[30:], rows[:40], corrected])
    final = {(c, k): v for c, k, v in rows if c and v is not None} | {(c, k): v for c, k, v in corrected}
    batch = percentiles.percentile(spark.createDataFrame([(c, k, v) for (c, k), v in final.items()], "ts_code string, trade_date date, pe_ttm double"), ["ts_code"], "pe_ttm")
    want = {r.ts_code: (r.as_of, r.current, r.pct, r.n) for r in batch.collect()}
    assert {k: (r.as_of, r.current, r.pct, r.n) for k, r in last.items() if k != "z"} == want
    assert (last["z"].pct, last["z"].n) == (None, 0) and not any(r.stale for r in last.values())


def test_stream_percentiles_of_a_window_and_stale_keys(spark, tmp_path):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    batches = [[("a", day(k), float(k + 1)) for k in range(10)] + [("b", day(0), 5.0)], [("a", day(60), 4.5), ("a", day(59), 9.0), ("a", day(1), 100.0)], [("a", day(120), 1.0)]]
    last, seen = _run(spark, tmp_path, batches, window_days=55, idle_days=10, late="1 day")
    news = [(r.n, r.pct) for r in seen if r.key == "a" and not r.stale]
    assert news[0] == (10, 90.0) and news[1][0] == 6  # days 6 to 9 of the first batch, 59 and 60
    assert (last["a"].as_of, last["a"].n, last["a"].pct) == (day(120), 1, 0.0)
    assert [r.as_of for r in seen if r.key == "b" and r.stale] == [day(0)]


def test_buckets_are_in_order():
    values = sorted(random.Random(2).lognormvariate(0, 5) for _ in range(5000))
    assert [SP.bucket(v) for v in values] == sorted(SP.bucket(v) for v in values)


def test_routes_write_back_what_they_fetch(spark, prices):
    prices.upsert(price(spark, ("a", "2024-01-02", 1.0), ("c", "2024-01-02", 3.0)))
    asked = []

    def fetch(wanted):
        asked.append(sorted(r[0] for r in wanted.collect()))
        return price(spark, ("a", "2024-01-02", 10.0), ("b", "2024-01-02", 20.0)).join(wanted, "ts_code", "left_semi")

    codes = lambda *c: spark.createDataFrame([(x,) for x in c], "ts_code string")
    get = lambda *a, **k: {r.ts_code: r.close for r in store.routed(prices, *a, **k).collect()}
    assert get(codes("a", "b", "b"), fetch) == {"a": 1.0, "b": 20.0} and asked == [["b"]]
    assert get(codes("a", "b"), fetch) == {"a": 1.0, "b": 20.0} and len(asked) == 1
    assert get(codes("a", "b", "c", "z"), fetch, remote_first=True) == {"a": 10.0, "b": 20.0, "c": 3.0}
    assert {r[0]: r[2] for r in rows_of(prices)} == {"a": 10.0, "b": 20.0, "c": 3.0}

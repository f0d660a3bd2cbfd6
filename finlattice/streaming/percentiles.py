"""Historical percentiles that are kept up to date by a stream of (key, day, value).

Each key has its days in one state map, and in another the sorted positive values of every rank bucket (a power of two cut into
sixteen) beside the buckets' sizes, so that a new value touches one bucket and a percentile adds sizes up to the current value's
bucket and looks inside that one alone.  A day that comes again replaces what it had, so replays change
nothing; days before the window of the key's last day are taken out.  A timer tells of keys without news: they are
reported once as stale when the watermark has passed their last day by `idle` days.

The results equal `operators.percentiles.percentile` over the days that are in the window: strictly smaller positive
values over all positive ones, null where the current value is not positive.
"""

from __future__ import annotations

import bisect
import datetime as dt
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "key string, as_of date, current double, pct double, n long, stale boolean"


def bucket(value: float) -> int:
    """The rank bucket of a positive value: larger values have larger buckets."""
    mantissa, exponent = math.frexp(value)
    return exponent * 16 + int((mantissa - 0.5) * 32)


class RankBuckets(StatefulProcessor):
    def __init__(self, window_days: int | None, idle_days: int | None):
        self.window_days, self.idle_days = window_days, idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "value double")
        self.values = handle.getMapState("values", "bucket int", "sorted array<double>")
        self.sizes = handle.getMapState("sizes", "bucket int", "n long")
        self.last = handle.getValueState("last", "day int")

    def _put(self, value: float, sign: int) -> None:
        """Add a value to its bucket, or take it out."""
        if not value > 0:
            return
        at = (bucket(value),)
        held = list(self.values.getValue(at)[0]) if self.values.containsKey(at) else []
        place = bisect.bisect_left(held, value)
        if sign > 0:
            held.insert(place, value)
        else:
            held.pop(place)
        if held:
            self.values.updateValue(at, (held,))
            self.sizes.updateValue(at, (len(held),))
        else:
            self.values.removeKey(at)
            self.sizes.removeKey(at)

    def _set(self, day: int, value: float | None) -> None:
        if self.days.containsKey((day,)):
            self._put(self.days.getValue((day,))[0], -1)
            self.days.removeKey((day,))
        if value is not None:
            self.days.updateValue((day,), (value,))
            self._put(value, 1)

    def _row(self, key: tuple, last: int, stale: bool) -> pd.DataFrame:
        current = self.days.getValue((last,))[0]
        n = smaller = 0
        mine = bucket(current) if current > 0 else None
        for (b,), (size,) in self.sizes.iterator():
            n += size
            smaller += size if mine is not None and b < mine else 0
        if mine is not None:
            smaller += bisect.bisect_left(list(self.values.getValue((mine,))[0]), current)
        pct = 100.0 * smaller / n if mine is not None else None
        day = dt.date(1970, 1, 1) + dt.timedelta(days=last)
        return pd.DataFrame({"key": [key[0]], "as_of": [day], "current": [current], "pct": pd.Series([pct], dtype=object), "n": [n], "stale": [stale]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for pdf in rows:
            pdf = pdf.dropna(subset=["day", "value"])
            for day, value in sorted(zip(pdf["day"].astype(int), pdf["value"], strict=True)):
                if self.window_days is not None and last is not None and day <= last - self.window_days:
                    continue  # it has left the window
                self._set(int(day), float(value))
                last = int(day) if last is None else max(last, int(day))
        if last is None:
            return
        self.last.update((last,))
        if self.window_days is not None and last != before:
            for (day,) in [d for d in self.days.keys() if d[0] <= last - self.window_days]:
                self._set(day, None)
        if self.idle_days is not None and last != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer((last + self.idle_days) * 86_400_000)
        yield self._row(key, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.last.exists():
            yield self._row(key, self.last.get()[0], True)

    def close(self) -> None:
        pass


def running_percentiles(stream: DataFrame, key: str, value: str, day: str = "trade_date", window_days: int | None = None, idle_days: int | None = None, late: str = "30 days") -> DataFrame:
    """key, as_of, current, pct, n, stale: a row for every key that a batch has news of (see RESULT); in update mode."""
    slim = stream.select(F.col(key).cast("string").alias("key"), F.unix_date(F.col(day).cast("date")).alias("day"), F.col(value).cast("double").alias("value"), F.col(day).cast("timestamp").alias("at"))
    slim = slim.where("key is not null and day is not null and value is not null and not isnan(value)")
    mode = "None"
    if idle_days is not None:
        slim, mode = slim.withWatermark("at", late), "EventTime"
    return slim.groupBy("key").transformWithStateInPandas(RankBuckets(window_days, idle_days), RESULT, "Update", mode)


#: The state store that these processors need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

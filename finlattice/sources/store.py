"""Stored tables that are written by key: plain Parquet in partitions, every write staged before it counts.

A write finds the partitions of its keys first, reads and merges these alone, and writes them whole into a folder `_staged` of the table
(Spark reads no names that begin with an underscore).  From Spark's success mark on the write counts: readers take the staged
partitions in place of the table's.  A dynamic overwrite then puts them in place and the staged folder goes.  A write that is
killed before the mark has changed nothing; one killed after it is finished by recover(), which every write calls first.
There is one writer at a time; readers need not know of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.point_in_time import latest
from ..operators.tables import conform, upsert
from .shared import delete, exists, names

_PART = "part"  # the partition column


@dataclass(frozen=True)
class Spec:
    """keys; part: the partition of a key, as an SQL expression of whole numbers; owners: which columns each writer may change (none: all)."""

    keys: list[str]
    part: str
    owners: dict[str, list[str]] = field(default_factory=dict)

    def update(self, columns: list[str], owner: str | None) -> list[str]:
        """The columns that this writer changes, or an error if the rows hold others."""
        if not self.owners:
            return [c for c in columns if c not in self.keys]
        if owner not in self.owners:
            raise ValueError(f"the writers of this table are {', '.join(self.owners)}")
        strange = [c for c in columns if c not in self.keys and c not in self.owners[owner]]
        if strange:
            raise ValueError(f"{owner} does not own {', '.join(strange)}")
        return [c for c in columns if c not in self.keys]


_YEAR, _BUCKET = "year(trade_date)", "cast(pmod(xxhash64(ts_code), 64) as int)"
SPECS = {
    "securities": Spec(["ts_code"], _BUCKET, {"identity": ["name", "industry", "market"], "lifecycle": ["list_date", "delist_date", "status"]}),
    "daily_prices": Spec(["ts_code", "trade_date"], _YEAR),
    "daily_valuations": Spec(["ts_code", "trade_date"], _YEAR),
    "valuation_history": Spec(["ts_code", "trade_date"], _YEAR),
    "index_memberships": Spec(["ts_code", "index_code", "effective_date"], "year(effective_date)", {"membership": ["index_name"]}),
    "industry_valuations": Spec(["industry_code", "stat_date"], "year(stat_date)"),
    "statements": Spec(["ts_code", "report_period", "source"], "year(report_period)"),
    "lifecycle_events": Spec(["ts_code", "event_type", "event_date"], "year(event_date)", {"events": ["detail", "source"]}),
    "benchmark_weights": Spec(["benchmark_code", "level", "sector_code"], "cast(pmod(xxhash64(benchmark_code, level), 64) as int)"),
}


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, spec: Spec):
        missing = [k for k in spec.keys if k not in schema.names]
        if missing or _PART in schema.names:
            raise ValueError(f"keys missing: {', '.join(missing)}" if missing else f"a column may not be called {_PART}")
        self.spark, self.path, self.schema, self.spec = spark, path, schema, spec
        self._stored = T.StructType([*schema.fields, T.StructField(_PART, T.IntegerType())])

    # reading

    def _staged(self) -> list[str]:
        """Writes that count but are not in place yet, oldest first."""
        place = f"{self.path}/_staged"
        return [f"{place}/{n}" for n in names(self.spark, place) if exists(self.spark, f"{place}/{n}/rows/_SUCCESS")]

    def _parts(self, staged: str) -> list[int]:
        return [r[0] for r in self.spark.read.parquet(f"{staged}/parts").collect()]  # a row per partition that was touched

    def _rows(self) -> DataFrame:
        there = any(n.startswith(f"{_PART}=") for n in names(self.spark, self.path))
        rows = self.spark.read.schema(self._stored).parquet(self.path) if there else self.spark.createDataFrame([], self._stored)
        for staged in self._staged():
            new = self.spark.read.schema(self._stored).parquet(f"{staged}/rows")
            rows = rows.where(~F.col(_PART).isin(self._parts(staged))).unionByName(new)
        return rows

    def read(self) -> DataFrame:
        return self._rows().select(*self.schema.names)

    # writing

    def upsert(self, source: DataFrame, owner: str | None = None, order: list[str] = ()) -> int:
        """Rows of known keys take the writer's columns, new keys are added; of a key's rows in source the last by `order` counts.

        Rows with a null in their key cannot be stored and stay out.  The number of partitions that were written is returned.
        """
        columns = [c for c in source.columns if c in self.schema.names or c in self.spec.keys]
        new, update = self._conformed(source, columns, list(order)), self.spec.update(columns, owner)
        return self._write(new, lambda old, rows: upsert(old, rows, self.spec.keys, update))

    def insert(self, source: DataFrame) -> int:
        """Rows of new keys only; what is stored never changes."""
        new = self._conformed(source, [c for c in source.columns if c in self.schema.names], [])
        return self._write(new, lambda old, rows: upsert(old, rows, self.spec.keys, []))

    def replace(self, source: DataFrame, prefix: list[str]) -> int:
        """Rows that agree with source in `prefix`, the first of the keys, go and source comes; the partition must follow from the prefix."""
        if self.spec.keys[: len(prefix)] != list(prefix):
            raise ValueError(f"{', '.join(prefix)} are not the first keys")
        new = self._conformed(source, self.schema.names, [])
        return self._write(new, lambda old, rows: old.join(rows.select(*prefix).distinct(), list(prefix), "left_anti").select(*rows.columns).unionByName(rows))

    def _conformed(self, source: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
        wanted = T.StructType([self.schema[c] for c in dict.fromkeys([*self.spec.keys, *columns])])
        extra = [c for c in order if c not in wanted.names]
        rows = conform(source, wanted) if not extra else conform(source.select("*"), T.StructType([*wanted.fields, *(source.schema[c] for c in extra)]))
        rows = rows.dropna(subset=self.spec.keys)
        if len(rows.columns) == len(self.spec.keys):
            return rows.distinct()
        return latest(rows, self.spec.keys, order or [c for c in wanted.names if c not in self.spec.keys]).select(*wanted.names)

    def _write(self, new: DataFrame, merge) -> int:
        self.recover()
        part = F.expr(self.spec.part).cast("int").alias(_PART)
        delete(self.spark, f"{self.path}/_staged")  # of a write that was killed before its mark
        stage = f"{self.path}/_staged/0"
        new.select(part).distinct().write.parquet(f"{stage}/parts")
        parts = self._parts(stage)
        if not parts:
            delete(self.spark, stage)
            return 0
        old = self._rows().where(F.col(_PART).isin(parts)).select(*self.schema.names)  # partitions are pruned by literals
        absent = [f for f in self.schema if f.name not in new.columns]
        whole = new.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}).select(*self.schema.names) if absent else new
        merged = merge(old, whole).select(*self.schema.names)
        merged.select("*", part).hint("rebalance", _PART).write.partitionBy(_PART).parquet(f"{stage}/rows")
        self.recover()
        return len(parts)

    def recover(self) -> None:
        """Put staged writes in place: the same however often it is begun."""
        for staged in self._staged():
            rows = self.spark.read.schema(self._stored).parquet(f"{staged}/rows")
            left = {int(n.removeprefix(f"{_PART}=")) for n in names(self.spark, f"{staged}/rows") if n.startswith(f"{_PART}=")}
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(self.path)
            for gone in set(self._parts(staged)) - left:
                delete(self.spark, f"{self.path}/{_PART}={gone}")
            delete(self.spark, staged)


def routed(table: KeyedTable, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], remote_first: bool = False, owner: str | None = None) -> DataFrame:
    """Rows of the wanted keys (or first keys): the table's, with what it lacks fetched and written back.

    With remote_first all are fetched and written, and the table's rows answer for keys that the source does not have.
    """
    by = [k for k in table.spec.keys if k in wanted.columns]
    wanted = wanted.select(*by).distinct()
    asked = wanted if remote_first else wanted.join(table.read().select(*by).distinct(), by, "left_anti")
    if not asked.isEmpty():
        table.upsert(fetch(asked), owner)
    return table.read().join(wanted, by, "left_semi")

"""Results that are kept under the digest of their specification and the version of the data behind them.

A result is written to a folder of its own and put in place by one rename, so that it is there whole or not at all; of two
writers the first one's stays.  A table that changed has another version and so another place; older versions of
the same specification go when the new one is in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, exists, move, names
from .tables import version


def files_version(*tables: DataFrame) -> str:
    """A digest of the files that tables are read from (path, size, time of change), found by Spark from the scans' metadata columns."""
    parts = []
    for table in tables:
        files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        row = files.agg(F.count(F.lit(1)), F.sum("file_size"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()
        parts.append(list(row))
    return version({"files": parts}, 24)


class ResultCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _place(self, name: str, spec: dict) -> str:
        return f"{self.path}/{name}/{version(spec, 32)}"

    def has(self, name: str, spec: dict, data: str) -> bool:
        return exists(self.spark, f"{self._place(name, spec)}/{data}/_SUCCESS")

    def get(self, name: str, spec: dict, data: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The kept result, or make()'s after it was kept; `data` is the version of what make() reads."""
        place = self._place(name, spec)
        if not self.has(name, spec, data):
            work = f"{place}/_work-{uuid.uuid4().hex}"
            make().write.parquet(work)
            if not move(self.spark, work, f"{place}/{data}"):
                delete(self.spark, work)
            for old in names(self.spark, place):
                if old != data and not old.startswith("_work"):
                    delete(self.spark, f"{place}/{old}")
        return self.spark.read.parquet(f"{place}/{data}")

    def invalidate(self, name: str, spec: dict | None = None) -> None:
        """Forget a result, or all of a name."""
        delete(self.spark, self._place(name, spec) if spec is not None else f"{self.path}/{name}")

"""Pages of a sorted table by cursor: the page after a row, not the page after so many rows.

A page is a filter and a top-k: every task keeps a page of rows, and nothing before the cursor is read into a sort.  The key
settles ties, nulls come last in either direction, and a cursor is the last row's sort values as text.
"""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 500  # rows of a page


def _sorts(df: DataFrame, sort: list[str], key: str) -> list[tuple[str, bool, bool]]:
    """(column, descending, numeric) of sort keys such as `pct` or `-pct`; the key comes last, unless it is there already."""
    out = []
    for s in [*sort, key]:
        name, down = s.removeprefix("-"), s.startswith("-")
        if name not in df.columns:
            raise ValueError(f"there is no column {name}")
        if name not in [c for c, _, _ in out]:
            out.append((name, down, isinstance(df.schema[name].dataType, T.NumericType)))
    return out


def cursor_of(values: list) -> str:
    plain = [v if v is None or isinstance(v, (int, float, str)) else str(v) for v in values]
    return base64.urlsafe_b64encode(json.dumps(plain, ensure_ascii=False).encode()).decode()


def _values(cursor: str, n: int) -> list:
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as error:
        raise ValueError("this is no cursor") from error
    if not isinstance(values, list) or len(values) != n:
        raise ValueError("the cursor belongs to another order")
    return values


def after(df: DataFrame, sort: list[str], key: str, cursor: str) -> Column:
    """Whether a row comes after the cursor."""
    sorts = _sorts(df, sort, key)
    tests, same = [], []
    for (name, down, _), value in zip(sorts, _values(cursor, len(sorts)), strict=True):
        c, v = F.col(name), F.lit(value).cast(df.schema[name].dataType)
        if value is not None:  # after a null nothing but nulls comes
            tests.append(reduce(lambda a, b: a & b, [*same, c.isNull() | (c < v if down else c > v)]))
        same.append(c.eqNullSafe(v))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def page(df: DataFrame, sort: list[str], key: str, size: int = 200, cursor: str | None = None) -> DataFrame:
    """The first `size` rows after the cursor; `key` names each row and is not null."""
    if not 1 <= size <= MOST:
        raise ValueError(f"a page has 1 to {MOST} rows")
    order = [F.desc_nulls_last(name) if down else F.asc_nulls_last(name) for name, down, _ in _sorts(df, sort, key)]
    rows = df if cursor is None else df.where(after(df, sort, key, cursor))
    return rows.orderBy(*order).limit(size)


def with_cursor(df: DataFrame, sort: list[str], key: str, size: int = 200, cursor: str | None = None) -> tuple[list, str | None]:
    """A page's rows on the driver and the cursor of the next one; None after the last."""
    rows = page(df, sort, key, size, cursor).collect()  # MOST rows at most
    names = [name for name, _, _ in _sorts(df, sort, key)]
    return rows, cursor_of([rows[-1][n] for n in names]) if len(rows) == size else None


def ranking(df: DataFrame, sort: list[str], key: str, size: int = 200, cursor: str | None = None, levels: list[str] | None = None, level: str = "level") -> tuple[DataFrame, DataFrame]:
    """A page of the rows of these levels, and how many rows each level has without the filter."""
    counts = df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    return page(df.where(F.col(level).isin(levels)) if levels else df, sort, key, size, cursor), counts

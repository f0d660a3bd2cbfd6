"""Rows of a query and of its SQL in comparable form."""

from collections import Counter

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 9)
    if isinstance(v, (int, np.integer)) and not isinstance(v, bool):
        return int(v)
    return v if v is None or isinstance(v, (str, bool)) else str(v)


def rows_of_sql(sql, sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(repr(tuple(plain(r[k]) for k in order)) for r in cursor.fetchall())


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())

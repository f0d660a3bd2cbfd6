"""Searches over dimensions and commentary.

`suggest` scans; `index_grams` writes a posting table of a dimension's character grams once, and `suggest_indexed` reads only the
postings of the grams that the asked text has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suggest(dim: DataFrame, text: str, code: str = "ts_code", name: str = "name", top: int = 20) -> DataFrame:
    """Code prefix before code match before name prefix before name match; ties by code."""
    c, n = F.lower(F.col(code).cast("string")), F.lower(name)
    t = text.lower()
    order = F.when(c.startswith(t), 0).when(c.contains(t), 1).when(n.startswith(t), 2).when(n.contains(t), 3)
    return dim.withColumn("rank", order).where("rank is not null").orderBy("rank", code).limit(top)


#: Length of the grams; shorter texts have grams of their own length, each at its first place.
GRAM = 3


def postings(dim: DataFrame, code: str = "ts_code", name: str = "name") -> DataFrame:
    """gram, code, field (0: code, 1: name), at: every character gram of a row's lower-cased fields with its place."""
    fields = F.array(*(F.struct(F.lit(k).alias("field"), F.lower(F.col(c).cast("string")).alias("text")) for k, c in enumerate((code, name))))
    rows = dim.select(F.col(code).alias("code"), F.explode(fields).alias("f")).select("code", "f.*").where("text <> ''")
    at = lambda n: F.sequence(F.lit(1), F.length("text") - (n - 1))
    gram = lambda i, n: F.substring(F.col("text"), i, F.lit(n))
    places = lambda n: F.transform(at(n), lambda i: F.struct(gram(i, n).alias("gram"), i.alias("at")))
    firsts = lambda n: F.transform(F.array_distinct(F.transform(at(n), lambda i: gram(i, n))), lambda g: F.struct(g.alias("gram"), F.position(g, F.col("text")).alias("at")))
    parts = [rows.where(F.length("text") >= n).select("code", "field", F.explode((firsts if n < GRAM else places)(n)).alias("g")).select("g.gram", "code", "field", "g.at") for n in range(1, GRAM + 1)]
    return reduce(lambda a, b: a.unionAll(b), parts)


#: Postings that one task explodes, sorts and writes, about; the number of tasks grows with the dimension.
TASK_POSTINGS = 1_000_000


def _part(gram, parts: int):
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


def index_grams(dim: DataFrame, path: str, code: str = "ts_code", name: str = "name", parts: int = 64) -> None:
    """Write the posting table: partitioned by the gram's hash, sorted by gram, so that a search reads some row groups of some partitions."""
    length = reduce(lambda a, b: a + b, (F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in (code, name)))
    total = dim.agg(F.sum(GRAM * length)).first()[0] or 0
    tasks = max(1, -(-total // TASK_POSTINGS))
    rows = postings(dim.repartition(tasks), code, name).withColumn("part", _part("gram", parts))
    order = ["part", "gram", "code", "field", "at"]  # a frequent gram is cut between codes
    rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write.partitionBy("part").parquet(path)


def suggest_indexed(index: DataFrame, dim: DataFrame, text: str, code: str = "ts_code", name: str = "name", top: int = 20, parts: int = 64) -> DataFrame:
    """As `suggest`, from the posting table of `dim`: a place where all grams of the text stand in a row is a match."""
    t = text.lower()
    if not t:
        raise ValueError("the text is empty")
    n = min(GRAM, len(t))
    grams: dict[str, list[int]] = {}
    for i in range(len(t) - n + 1):
        grams.setdefault(t[i : i + n], []).append(i)
    spark = index.sparkSession
    where = sorted({r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_part("g", parts)).collect()})
    found = index.where(F.col("part").isin(where) & F.col("gram").isin(list(grams)))
    offsets = F.create_map(*(x for g, at in grams.items() for x in (F.lit(g), F.array(*map(F.lit, at)))))
    starts = found.select("code", "field", "at", F.explode(offsets[F.col("gram")]).alias("i")).select("code", "field", (F.col("at") - F.col("i")).alias("start"), "i")
    whole = starts.groupBy("code", "field", "start").agg(F.size(F.collect_set("i")).alias("n")).where(F.col("n") == len(t) - n + 1)
    rank = F.min(2 * F.col("field") + F.when(F.col("start") == 1, 0).otherwise(1)).cast("int")
    best = whole.groupBy(F.col("code").alias(code)).agg(rank.alias("rank")).orderBy("rank", code).limit(top)
    return dim.join(F.broadcast(best), code).orderBy("rank", code)  # `top` rows


def quotes(df: DataFrame, keyword: str | None = None, within: tuple[str, ...] = ("content",), isin: dict[str, list] | None = None, has: dict[str, str] | None = None, since=None, time: str = "published_at") -> DataFrame:
    """Rows that meet every criterion given; `has` asks an array column for an element."""
    tests = [reduce(lambda a, b: a | b, (F.col(c).contains(keyword) for c in within))] if keyword else []
    tests += [F.col(c).isin(v) for c, v in (isin or {}).items()]
    tests += [F.array_contains(c, v) for c, v in (has or {}).items()]
    tests += [F.col(time) >= since] if since is not None else []
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def resolve(dim: DataFrame, text: str, code: str = "ts_code", name: str = "name") -> str:
    """The only code whose name is the text, else the only one whose name holds it; otherwise an error with a few samples."""
    for test in (F.col(name) == text, F.col(name).contains(text)):
        found = [r[0] for r in dim.where(test).select(code).orderBy(code).limit(5).collect()]
        if len(found) == 1:
            return found[0]
        if found:
            raise ValueError(f"{text!r} may be {', '.join(map(str, found[:4]))}")
    raise ValueError(f"nothing is called {text!r}")


def tag_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Elements of a comma-joined column by frequency."""
    rows = df.select(F.explode(F.split(column, ",")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "tag").limit(top) if top else rows


def events(df: DataFrame, key: str | None = None, as_of=None, kind: str | None = None, code: str = "ts_code", day: str = "event_date", event: str = "event_type") -> DataFrame:
    """Events of a code, by a day and of a type, whichever are given, in order of day, code and type."""
    for given, holds in ((key, lambda: F.col(code) == F.lit(key)), (as_of, lambda: F.col(day) <= F.lit(as_of).cast("date")), (kind, lambda: F.col(event) == F.lit(kind))):
        df = df.where(holds()) if given is not None else df
    return df.orderBy(day, code, event)

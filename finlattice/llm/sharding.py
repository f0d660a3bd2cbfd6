"""Range shards of near equal bytes, by sampled splitters; DataFrame functions only.

1. Records larger than a small part of a shard are few (their number is bounded by the shards): they are set aside and
   dealt to the shards by size, each to the emptiest; what is left of every shard is its capacity.
2. Of the others, a sample weighted by size is drawn by a hash of the key, and its quantiles split the key space into ranges.
3. The ranges are measured.  An overfull one is subdivided at quantiles of its own (before and after each, so that a hot key
   gets a range to itself), until all are small; one of a single key is cut by row number.
4. Records are dealt to the ranges, a range's records are ordered and numbered in one small group, and the ranges' totals,
   summed in key order, turn that into each record's place among all.  Shards are intervals of places that fill
   the capacities, so each shard differs from the next by no more than a record or two.

The key is a hash of the text in the high bits and of the identifier in the low ones: copies of a text stand
together, and a text with a third of all rows is cut along its identifiers.  The driver gets a row per large record and per
range, which are as many as there are hundreds of thousands of records (65,536 at least); nothing else.

Defined results: a null or empty text has no bytes (size 8, checksum 0); null identifiers are sorted first and
returned; repeated rows are records of their own; more shards than records leave shards empty; an empty
table gives an empty result; extra columns are carried by `shard` (columns named shard or slot are an error) and ignored by the query.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._tables import drop, keep

#: A record over 1/LARGE of a shard is dealt by size.
LARGE = 64
#: Ranges per shard at least, records and times the mean size of a range at most, and sampled keys per range.
RANGES, ROWS, OVERFULL, SAMPLED = 32, 200_000, 2, 32


def text_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """36 bits of the text's digest before 24 of the identifier's."""
    high, low = F.substring(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), 1, 9), F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 6)
    return F.conv(F.concat(high, low), 16, 10).cast("long")


def _place(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most the value, by binary search."""
    if not bounds:
        return F.lit(0)
    size = 1 << len(bounds).bit_length()
    padded = [*bounds, *[(1 << 63) - 1] * (size - 1 - len(bounds))]  # values are smaller than that
    table = F.expr(f"array({','.join(f'{b}L' for b in padded)})")  # folded into a constant
    steps = F.array(*(F.lit(size >> k) for k in range(1, size.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) <= value, low + step).otherwise(low))


def capacities(total: int, taken: list[int]) -> list[int]:
    """What the rest may bring to each shard, so that all are filled to one level (those above it get nothing)."""
    rest, order = total - sum(taken), sorted(range(len(taken)), key=lambda i: (taken[i], i))
    filled = 0
    for k, i in enumerate(order, 1):
        filled += taken[i]
        level = (rest + filled) // k
        if k == len(order) or level <= taken[order[k]]:
            break
    out = [0] * len(taken)
    for i in order[:k]:
        out[i] = level - taken[i]
    for i in order[: rest - sum(out)]:
        out[i] += 1
    return out


def deal(sizes: list[int], n_shards: int) -> tuple[list[int], list[int]]:
    """(shard of each, bytes of each shard) for sizes in falling order: each goes to the emptiest."""
    heap, shards, taken = [(0, i) for i in range(n_shards)], [], [0] * n_shards
    for size in sizes:
        has, i = heapq.heappop(heap)
        shards.append(i)
        taken[i] = has + size
        heapq.heappush(heap, (taken[i], i))
    return shards, taken


def _quantiles(n: int, accuracy: int) -> Column:
    """n - 1 quantiles of the keys that were drawn."""
    return F.percentile_approx("key", F.expr(f"array({','.join(f'{k / n!r}D' for k in range(1, n))})"), F.lit(accuracy))


def _drawn(rows: DataFrame, draws: int, total: int) -> DataFrame:
    """Each key floor(size * draws / total + u) times, u being a hash of the record in [0, 1)."""
    u = F.pmod(F.xxhash64("key", "row"), F.lit(1 << 20)) / (1 << 20)
    times = F.floor(F.col("size") * (draws / total) + u).cast("int")
    return rows.withColumn("times", times).where("times > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("times"))))


def _ranges(rows: DataFrame, n: int, total: int) -> tuple[list[int], list]:
    """Bounds of ranges, none overfull but of a single key, and the measures of each (place, rows, bytes, low, high) in order."""
    most = OVERFULL * max(1, total // n)
    found = _drawn(rows, SAMPLED * n, total).agg(_quantiles(n, 100 * n).alias("q")).first()["q"] if n > 1 else None
    bounds = sorted(set(found or ()))
    while True:
        measured = rows.groupBy(_place(bounds, F.col("key")).alias("place")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")
        ).collect()  # a row per range
        over = [m for m in measured if (m["bytes"] > most or m["rows"] > OVERFULL * ROWS) and m["low"] < m["high"]]
        if not over:
            return bounds, sorted(measured)
        add = {m["high"] for m in over}
        inside = rows.withColumn("place", _place(bounds, F.col("key"))).where(F.col("place").isin([m["place"] for m in over]))
        draws = SAMPLED * 16 * len(over)
        drawn = _drawn(inside, draws, sum(m["bytes"] for m in over)).groupBy("place").agg(_quantiles(16, 1000).alias("q"))
        for row in drawn.collect():
            add |= {b for q in row["q"] for b in (q, q + 1)}
        bounds = sorted(set(bounds) | add)


def shard(docs: DataFrame, n_shards: int, size: str = "size", key: str = "key", doc_id: str = "doc_id") -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (gapless from 0); size is not null and positive, key is a long over 0."""
    carried = [c for c in docs.columns if c not in (size, key, doc_id)]
    if {c.lower() for c in docs.columns} & {"shard", "slot"}:
        raise ValueError("the table has a column shard or slot")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(size).cast("long").alias("size"), F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), (F.struct(*carried) if carried else F.lit(0)).alias("carried"))
    rows = keep(named, "records")  # row numbers stay as written
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    out = [F.col("doc_id").alias(doc_id), F.col("size").alias(size), F.col("key").alias(key), *(F.col("carried")[c].alias(c) for c in carried)]
    if not count:
        return rows.select(*out, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    least = total // (n_shards * LARGE)
    is_large = F.col("size") > least
    large = rows.where(is_large).select("size", "key", "doc_id", "row").orderBy(F.desc("size"), "key", "doc_id", "row").collect()  # n_shards * LARGE at most
    shards, taken = deal([r["size"] for r in large], n_shards)
    rest, rest_rows = total - sum(taken), count - len(large)
    ends, end = [], 0
    for room in capacities(total, taken)[:-1]:
        end += room
        ends.append(2 * end)

    small = rows.where(~is_large)
    n = max(n_shards * RANGES, -(-rest_rows // ROWS))
    bounds, measured = _ranges(small, min(n, max(1, rest_rows)), rest) if rest_rows else ([], [])
    # records of one key that are too many for a group are cut by row number
    cut = {m["place"]: -(-m["rows"] // ROWS) for m in measured if m["rows"] > OVERFULL * ROWS}
    place = _place(bounds, F.col("key")).alias("place")
    parts = F.coalesce(F.create_map(*(F.lit(x) for pair in cut.items() for x in pair))[F.col("place")], F.lit(1)) if cut else F.lit(1)
    part = F.pmod(F.xxhash64("row"), parts).cast("int").alias("part")
    small = small.select("*", place).select("*", part)
    totals = [(m["place"], 0, m["rows"], m["bytes"]) for m in measured if m["place"] not in cut]
    if cut:
        totals += [tuple(r) for r in small.where(F.col("place").isin(list(cut))).groupBy("place", "part").agg(F.count(F.lit(1)), F.sum("size")).collect()]
    offsets, rows_before, bytes_before = [], 0, 0
    for where, piece, n_rows, n_bytes in sorted(totals):
        offsets.append((where, piece, rows_before, bytes_before))
        rows_before, bytes_before = rows_before + n_rows, bytes_before + n_bytes

    spark = docs.sparkSession
    offset = spark.createDataFrame(offsets, "place int, part int, rows_before long, bytes_before long")
    inside = Window.partitionBy("place", "part").orderBy("key", "doc_id", "row")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = small.withColumn("number", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(running))
    numbered = numbered.join(F.broadcast(offset), ["place", "part"])  # a row per range
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    numbered = numbered.select("doc_id", "size", "key", "carried", (F.col("rows_before") + F.col("number") - 1).alias("at"), _place(ends, middle).alias("shard"))
    numbered = keep(numbered, "numbered")
    first = {r["shard"]: (r["first"], r["n"]) for r in numbered.groupBy("shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
    firsts = F.array(*(F.lit(first.get(i, (0, 0))[0]).cast("long") for i in range(n_shards)))
    done = numbered.select(*out, F.col("shard").cast("int").alias("shard"), (F.col("at") - F.get(firsts, F.col("shard"))).alias("slot"))
    if not large:
        return done
    slots, dealt = [first.get(i, (0, 0))[1] for i in range(n_shards)], []
    for r, i in zip(large, shards, strict=True):
        dealt.append((r["row"], i, slots[i]))
        slots[i] += 1
    dealt = spark.createDataFrame(dealt, "row long, shard int, slot long")
    return done.unionByName(rows.where(is_large).join(F.broadcast(dealt), "row").select(*out, "shard", "slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int, files: int = 1) -> None:
    """Write documents (doc_id, text and more) as one folder of Parquet per shard, its rows in the order of their slots over `files` files."""
    sized = docs.withColumns({"_size": F.coalesce(F.octet_length("text"), F.lit(0)) + 8, "_key": text_key()})
    placed = keep(shard(sized, n_shards, "_size", "_key").drop("_size", "_key"), "placed")
    per_file = max(1, -(-placed.count() // (n_shards * files)))
    placed.withColumn("_file", F.floor(F.col("slot") / per_file)).repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)
    drop(placed)


def document_shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), text_key().alias("key"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = shard(slim, n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned to the principal axes of the valid ones (from their summed second moments), so that the
leading dimensions carry most of a product.  Equal vectors of a label are one class.  The classes of a label are dealt to
blocks of at most about `block` by the side of the label's median that each leading coordinate is on (and by hash where one
such cell holds more), and a block
knows the range of its leading coordinates.  Two blocks are a tile of their own only if these ranges do not keep all their
pairs below the threshold, which is settled before any vector is shuffled.  In a tile, products accumulate
leading dimensions first; after each step a pair is given up once its product so far plus the
product of the two suffix norms cannot reach the threshold, and a tile without pairs stops.
The pairs that are left are decided by the cosine of the original components in double precision.  Tiles return sums of
links and stars of components, never pairs.

Defined results: a vector that is null, zero, or with null or non-finite components links with nothing, and so does one of a
null label; each is its own component and kept.  Vectors of other lengths never link.  Null ids are returned as null and link with
nothing.  Repeated rows of one vec_id are vectors of their own: each has its own links, and linked copies one component.  An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._tables import keep
from .components import components, roots

_STEPS = (16, 32)  # leading dimensions after which pairs are given up
_LEAD = 8  # coordinates whose ranges a block knows
_BINS = 1024  # of a coordinate, from -1 to 1
_SLACK = 1e-4  # for coordinates of single precision


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, of the original components; of scaled ones only where their squares are beyond double precision."""
    square = lambda x: np.einsum("nk,nk->n", x, x)
    with np.errstate(all="ignore"):
        pp, qq = square(p), square(q)
        out = np.einsum("nk,nk->n", p, q) / np.sqrt(pp * qq)
    odd = ~((np.minimum(pp, qq) > 1e-140) & (np.maximum(pp, qq) < 1e140))
    if odd.any():
        out[odd] = np.einsum("nk,nk->n", _units(p[odd]), _units(q[odd]))
    return out


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, dims, vector (its own kind of numbers) of the vectors that can link."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = F.exists(x, lambda c: c != 0)
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").where((F.size(x) > 0) & finite & some)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.size(x).alias("dims"), x.alias("vector"))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for each number of dimensions: columns from the largest eigenvalue down.

    Second moments are summed in each task; the driver gets one small matrix per task and length.
    """

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                x = _units(_matrix(batch.filter(pa.array(dims == d)).column("vector")))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d * d, pa.int32()), pa.array(np.arange(d * d, dtype=np.int64)), pa.array(m.reshape(-1))], names=["dims", "cell", "v"]
            )

    total = vectors.select("dims", "vector").mapInArrow(moments, "dims int, cell long, v double").groupBy("dims", "cell").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, part in total.groupby("dims"):
        m = np.zeros(d * d)
        m[part["cell"]] = part["v"]
        out[int(d)] = np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy()
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, turned_x: np.ndarray, turned_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of x and y whose cosine is >= threshold; turned_*: the unit vectors on the principal axes."""
    d, slack = turned_x.shape[1], 1e-6
    a, b = turned_x.astype(np.float32), turned_y.astype(np.float32)
    i = j = None
    product = np.zeros((len(a), len(b)), np.float32)
    at = 0
    for step in [s for s in _STEPS if s < d]:
        tail_a, tail_b = np.linalg.norm(a[:, step:], axis=1), np.linalg.norm(b[:, step:], axis=1)
        if i is None:
            product += a[:, at:step] @ b[:, at:step].T
            i, j = np.nonzero(product + tail_a[:, None] * tail_b > threshold - slack * 10)
            product = product[i, j]
        else:
            product = product + np.einsum("nk,nk->n", a[i, at:step], b[j, at:step])
            alive = product + tail_a[i] * tail_b[j] > threshold - slack * 10
            i, j, product = i[alive], j[alive], product[alive]
        at = step
        if not len(i):
            return i, j
    if i is None:
        i, j = (k.ravel() for k in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 65536):
        out[k : k + 65536] = _cosines(x[i[k : k + 65536]], y[j[k : k + 65536]]) >= threshold
    return i[out], j[out]


def _with_lead(classes: DataFrame, turn) -> DataFrame:
    """The classes with their leading coordinates on the principal axes."""
    schema = pa.schema([("lead", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            dims, vectors = batch.column("dims").to_numpy(), batch.column("vector")
            lead = np.zeros((len(dims), _LEAD), np.float32)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                turned = _units(_matrix(vectors.take(pa.array(rows)))) @ turn.value[d][:, :_LEAD]
                lead[rows, : turned.shape[1]] = turned
            column = pa.array(list(lead), schema.field("lead").type)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "lead"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("lead", T.ArrayType(T.FloatType()))]))


def _small(df: DataFrame, tag: str, most: int = 500_000) -> DataFrame:
    """A kept table that joins by broadcast if it is small, else by shuffle."""
    df = keep(df, tag)
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def _dealt(classes: DataFrame, block: int) -> DataFrame:
    """The classes with cell (the sides of their label's medians that the leading coordinates are on, as many as it has blocks for) and sub (by hash, in a cell of more than a block)."""
    group = ["label", "dims"]
    coordinate = classes.select(*group, F.posexplode("lead").alias("k", "x")).withColumn("bin", F.floor((F.col("x") + 1) * (_BINS / 2)).cast("int"))
    counts = coordinate.groupBy(*group, "k", "bin").agg(F.count(F.lit(1)).alias("c"))
    by_bin = Window.partitionBy(*group, "k").orderBy("bin")  # _BINS + 1 rows at most
    counts = counts.withColumn("below", F.sum("c").over(by_bin)).withColumn("n", F.sum("c").over(Window.partitionBy(*group, "k")))
    middles = counts.where(2 * F.col("below") >= F.col("n")).groupBy(*group, "k").agg(F.min("bin").alias("bin"), F.max("n").alias("n"))
    middles = middles.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "bin"))), lambda m: m["bin"]).alias("middle"), F.max("n").alias("n"))
    bits = F.least(F.lit(_LEAD), F.ceil(F.log2(F.ceil(F.col("n") / block))).cast("int"))
    out = classes.join(_small(middles.withColumn("bits", bits), "middles"), group)
    side = F.transform("lead", lambda x, k: F.when((k < F.col("bits")) & ((x + 1) * (_BINS / 2) >= F.get("middle", k)), F.lit("1")).otherwise("0"))
    out = out.withColumn("cell", F.array_join(side, "")).drop("middle", "bits", "n")
    crowd = out.groupBy(*group, "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    return out.join(_small(crowd, "crowd"), [*group, "cell"]).withColumn("sub", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).drop("parts")


def tile_pairs(dealt: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Blocks (bid, how they are told), and bid with the tiles (bi <= bj) it takes part in: those whose ranges of coordinates are near enough."""
    told = ["label", "dims", "cell", "sub"]
    ends = [f(F.get("lead", F.lit(k))).alias(f"{name}{k}") for k in range(_LEAD) for name, f in (("lo", F.min), ("hi", F.max))]
    blocks = keep(dealt.groupBy(*told).agg(*ends).withColumn("bid", F.monotonically_increasing_id()), "blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    gap = [F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")) for k in range(_LEAD)]
    apart = sum((g * g for g in gap), F.lit(0.0))  # squared distance of unit vectors is 2 - 2 cos
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.dims") == F.col("b.dims")) & (F.col("a.bid") <= F.col("b.bid"))
    pairs = a.join(b, same).where(apart <= 2 - 2 * threshold + _SLACK).select(F.col("a.bid").alias("bi"), F.col("b.bid").alias("bj"))
    pairs = keep(pairs, "tiles")
    return blocks.select(*told, "bid"), pairs.select(F.col("bi").alias("bid"), "bi", "bj").unionAll(pairs.where("bi <> bj").select(F.col("bj").alias("bid"), "bi", "bj"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    vectors = keep(valid(embeddings), "vectors")
    turn = vectors.sparkSession.sparkContext.broadcast(axes(vectors))
    classes = vectors.groupBy("label", "dims", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = keep(_with_lead(classes.withColumn("cid", F.monotonically_increasing_id()), turn), "classes")
    dealt = keep(_dealt(classes, block).select("cid", "label", "dims", "cell", "sub", "copies", "vector", "lead"), "dealt")
    blocks, pairs = tile_pairs(dealt, threshold)
    placed = dealt.drop("lead").join(_small(blocks, "bids"), ["label", "dims", "cell", "sub"])
    tiles = placed.join(_small(pairs.groupBy("bid").agg(F.collect_list(F.struct("bi", "bj")).alias("tiles")), "partners"), "bid")
    tiles = tiles.select("cid", "copies", "vector", F.col("bid").alias("own"), F.explode("tiles").alias("t")).select("cid", "copies", "vector", "own", "t.bi", "t.bj")

    def compare(table: pa.Table) -> pa.Table:
        x, own = _matrix(table.column("vector")), table.column("own").to_numpy()
        ids, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        unit = _units(x) @ turn.value[x.shape[1]]
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        for k in range(0, len(left), 512):
            rows = left[k : k + 512]
            i, j = close_pairs(x[rows], x[right], unit[rows], unit[right], threshold)
            i, j = rows[i], right[j]
            wanted = i < j if bi == bj else slice(None)
            out_a.append(i[wanted])
            out_b.append(j[wanted])
        i, j = np.concatenate(out_a), np.concatenate(out_b)
        # links of each class to others (times their copies) and a star of the tile's components
        n = np.zeros(len(x), np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        near = np.flatnonzero(n)
        root = dict(zip(*(r.tolist() for r in roots(ids[i], ids[j])), strict=True)) if len(i) else {}
        return pa.table({"cid": ids[near], "n": n[near], "root": [root.get(v, v) for v in ids[near].tolist()]}, schema=pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    found = keep(tiles.groupBy("bi", "bj").applyInArrow(compare, "cid long, n long, root long"), "links")
    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    groups = components(found.where("cid <> root"), "cid", "root").withColumnRenamed("node", "cid")
    joined = keep(classes.select("cid", "id", "copies", "label", "dims", "vector").join(links, "cid", "left").join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "judged")
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    judged = joined.join(least, "component").select("label", "dims", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = vectors.join(judged, ["label", "dims", "vector"]).select("vec_id", "n_links", "component_id")
    # the rest links with nothing
    good = vectors.select("vec_id")
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    alone = ids.exceptAll(good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))

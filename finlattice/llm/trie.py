"""A prefix trie of conversations, from padded turn-id matrices.

A turn is known by two 64-bit hashes of its role and text, so a conversation is a row of numbers and texts are never
shuffled.  Rows are range-partitioned by (turn ids, conversation), so every task holds an interval of the trie's order, a shard:

1. the task orders its rows by lexsort over blocks of padded columns (only rows that go on and are not yet alone);
2. in each block the columns that change against the row before are OR-accumulated from left to right: a mask
   whose column d marks the rows at which a node of depth d starts;
3. reduceat over these starts gives every node's members and smallest member, and over nodes, from the deepest up,
   its leaves and tokens;
4. nodes on the path of a shard's first or last row may go on in the next shard.  They leave as partial sums under a
   digest of their path and are recombined; all others are complete.

The recombined nodes (two paths a shard) are summed up the tree in one task: they are as many as a shard or two of
turns where a corpus has a hundred thousand shards.  A node's ends are hashed as a stream of identifiers in order.

Defined results: a null role or text is empty; turns of one number are ordered by role and then by a hash of their text;
rows of a null conversation are left out; repeated rows are turns of their own; an empty table has no root and gives an
empty result; extra columns are ignored.  A conversation is one matrix row: a million turns are 24 MB in a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import drop, keep

_WIDTH = 32  # columns of a block
_NONE = hashlib.sha256(b"").hexdigest()
_LOWEST = np.iinfo(np.int64).min


def rebuilt(conversations: DataFrame, share: int = 5, most: int = 9) -> DataFrame:
    """conv_id, turns (array of a, b, bytes): the first h turns of conversation c - c % share, then c's own after its first h; h = crc32(c) % most."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    a, b = F.xxhash64(role, text), F.xxhash64(F.lit(1), text, role)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), a.alias("a"), b.alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = keep(whole.select("conv_id", F.transform("t", lambda t: F.struct(t["a"], t["b"], t["bytes"])).alias("turns")), "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = whole.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("start"))
    own = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % share).withColumn("h", h)
    joined = own.join(base.hint("merge"), "base", "left")
    start = F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.slice("turns", F.lit(1), F.lit(0)))
    return joined.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("h")))).alias("turns"))


def _block(flat: np.ndarray, first: np.ndarray, length: np.ndarray, s: int) -> np.ndarray:
    """Columns s to s + _WIDTH of the rows that start at `first` in flat, padded with the lowest number."""
    width = int(min(_WIDTH, (length - s).max()))
    column = np.arange(s, s + width)
    at = first[:, None] + column
    inside = column < length[:, None]
    return np.where(inside, flat[np.where(inside, at, 0)], _LOWEST)


def _ordered(a: np.ndarray, b: np.ndarray, first: np.ndarray, length: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """The order of rows by their turns, shorter ones first, then by conversation."""
    rank, s = np.zeros(len(conv), np.int64), 0
    active = np.arange(len(conv))
    while len(active := active[length[active] > s]):
        x, y = _block(a, first[active], length[active], s), _block(b, first[active], length[active], s)
        keys = [m[:, k] for k in range(x.shape[1] - 1, -1, -1) for m in (y, x)]
        order = np.lexsort((*keys, rank[active]))
        x, y, r = x[order], y[order], rank[active][order]
        new = np.concatenate(([False], (x[1:] != x[:-1]).any(axis=1) | (y[1:] != y[:-1]).any(axis=1) | (r[1:] != r[:-1])))
        sub = np.zeros(len(conv), np.int64)  # rows that end here come first of their rank
        sub[active[order]] = np.cumsum(new) + 1
        whole = np.lexsort((sub, rank))
        step = np.concatenate(([0], (rank[whole][1:] != rank[whole][:-1]) | (sub[whole][1:] != sub[whole][:-1])))
        rank[whole] = np.cumsum(step)
        several = np.bincount(rank, minlength=1) > 1
        active = active[several[rank[active]]]
        s += _WIDTH
    return np.lexsort((conv, rank))


def nodes(a: np.ndarray, b: np.ndarray, size: np.ndarray, first: np.ndarray, length: np.ndarray, conv: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The nodes of one shard by depth (depth, parent, row where it starts, n, ends, conv, bytes, weighted: sum of n times bytes of its subtree,
    children) and the order of its rows; a node's rows are those after its start that are long enough."""
    order = _ordered(a, b, first, length, conv)
    first, length, conv = first[order], length[order], conv[order]
    found = [{"depth": np.zeros(1, np.int64), "parent": np.full(1, -1), "row": np.zeros(1, np.int64), "n": np.full(1, len(conv)), "ends": np.full(1, (length == 0).sum()), "conv": np.full(1, conv.min()), "bytes": np.zeros(1, np.int64)}]
    of_row, count, s = np.zeros(len(conv), np.int64), 1, 0  # the node of each row at the last depth
    while len(rows := np.flatnonzero(length > s)):
        x, y = _block(a, first[rows], length[rows], s), _block(b, first[rows], length[rows], s)
        change = np.ones(x.shape, bool)
        change[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        change[1:, 0] |= of_row[rows[1:]] != of_row[rows[:-1]]
        mask = np.logical_or.accumulate(change, axis=1)
        for k in range(x.shape[1]):
            long_enough = length[rows] > s + k
            sub = rows[long_enough]
            start = np.flatnonzero(mask[long_enough, k])
            at = sub[start]
            last = length[sub] == s + k + 1
            n = np.diff(np.append(start, len(sub)))
            found.append({"depth": np.full(len(start), s + k + 1), "parent": of_row[at], "row": at, "n": n, "ends": np.add.reduceat(last.astype(np.int64), start), "conv": np.minimum.reduceat(conv[sub], start), "bytes": size[first[at] + s + k]})
            of_row[sub] = count + np.repeat(np.arange(len(start)), n)
            count += len(start)
        s += _WIDTH
    out = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    out["weighted"], out["children"] = out["n"] * out["bytes"], np.bincount(out["parent"][1:], minlength=count)
    return out, order


def _sum_up(values: list[np.ndarray], depth: np.ndarray, parent: np.ndarray) -> None:
    """Adds every node's values to those of the nodes above it; nodes stand by depth, and those of one parent together."""
    ends = np.searchsorted(depth, np.arange(int(depth.max(initial=0)) + 2))
    for d in range(len(ends) - 2, 0, -1):
        at = slice(ends[d], ends[d + 1])
        up = parent[at]
        start = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
        for v in values:
            v[up[start]] += np.add.reduceat(v[at], start)


_NODE = pa.schema(
    [("kind", pa.int32()), ("key", pa.binary()), ("up", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64())]
    + [("weighted", pa.int64()), ("bytes", pa.int64()), ("below", pa.int64()), ("ends_sha256", pa.string()), ("shard", pa.int64()), ("chunk", pa.int64()), ("ends", pa.binary())]
)
_SQL = "kind int, key binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, weighted long, bytes long, below long, ends_sha256 string, shard long, chunk long, ends binary"
_WHOLE, _PART, _ENDS = 0, 1, 2


def _path_keys(a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """A digest of every prefix, the empty one included."""
    h = hashlib.blake2b(digest_size=16)
    keys = [h.digest()]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        h.update(x.to_bytes(8, "little", signed=True) + y.to_bytes(8, "little", signed=True))
        keys.append(h.digest())
    return keys


def _of_shard(batches):
    """A shard's complete nodes, the partial sums of those on its first and last row's paths, and their ends in chunks."""
    batches = [x for x in batches if x.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    shard = TaskContext.get().partitionId()
    conv, ids = table.column("conv_id").to_numpy(), table.column("ids").combine_chunks()
    offsets = ids.offsets.to_numpy()
    flat = ids.values.to_numpy()[offsets[0] : offsets[-1]]
    a, b, size = (np.ascontiguousarray(flat[k::3]) for k in range(3))
    first, length = (offsets[:-1] - offsets[0]) // 3, np.diff(offsets) // 3
    a, b = (x if len(x) else np.zeros(1, np.int64) for x in (a, b))
    node, order = nodes(a, b, size, first, length, conv)
    conv, first, length = conv[order], first[order], length[order]
    n_nodes, depth, parent = len(node["n"]), node["depth"], node["parent"]

    # nodes on the paths of the first and last row: the first one of each depth, and the last one, as far as the rows go
    by_depth = np.searchsorted(depth, np.arange(depth.max() + 2))
    keys: dict[int, bytes] = {}
    for row, side in ((0, 0), (len(conv) - 1, 1)):
        path = _path_keys(a[first[row] : first[row] + length[row]], b[first[row] : first[row] + length[row]])
        for d, key in enumerate(path):
            keys[int(by_depth[d + side]) - side] = key
    open_ = np.zeros(n_nodes, bool)
    open_[list(keys)] = True

    leaves = ((node["children"] == 0) & ~open_).astype(np.int64)
    weighted, below = node["weighted"].copy(), np.where(open_, 0, node["bytes"])
    children = node["children"] - np.bincount(parent[1:][open_[1:]], minlength=n_nodes)
    _sum_up([leaves, weighted, below], depth, parent)

    starts, ends = node["row"], node["ends"]
    text = [str(c) for c in conv.tolist()]
    held: list[tuple] = []
    for lo in range(0, n_nodes, 20_000):
        for k in range(lo, min(lo + 20_000, n_nodes)):
            up = int(parent[k])
            up_key = keys.get(up) if up >= 0 else None
            d, e, at = int(depth[k]), int(ends[k]), int(starts[k])
            if k not in keys:
                sha = hashlib.sha256(",".join(text[at : at + e]).encode()).hexdigest() if e else _NONE
                held.append((_WHOLE, None, up_key, int(node["conv"][k]), d, None if up_key else int(node["conv"][up]), int(node["n"][k]), int(children[k]), int(leaves[k]), int(weighted[k]), int(node["bytes"][k]), int(below[k]), sha, shard, 0, None))
                continue
            held.append((_PART, keys[k], up_key, int(node["conv"][k]), d, None, int(node["n"][k]), int(children[k]), int(leaves[k]), int(weighted[k]), int(node["bytes"][k]), int(below[k]), None, shard, 0, None))
            for c in range(0, e, 50_000):
                chunk = ",".join(text[at + c : at + min(c + 50_000, e)]).encode()
                held.append((_ENDS, keys[k], None, None, d, None, None, None, None, None, None, None, None, shard, c, chunk))
        yield _batch(held)
        held = []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE)


def _hash_ends(batches):
    """The digest of each key's chunks, joined by commas in their order; a stream, whatever a key holds."""
    now, sha = None, None
    for batch in batches:
        keys, out = [], []
        for key, chunk in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    keys.append(now)
                    out.append(sha.hexdigest())
                now, sha = key, hashlib.sha256(chunk)
            else:
                sha.update(b"," + chunk)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "sha"])


def _joined(batches):
    """Recombined nodes in one task: each one's parent, and what the recombined nodes below it add."""
    batches = [x for x in batches if x.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    key, up = table.column("key").to_pylist(), table.column("up").to_pylist()
    place = {k: i for i, k in enumerate(key)}
    parent = np.array([place[u] if u is not None else -1 for u in up], np.int64)
    depth = table.column("depth").to_numpy()
    order = np.lexsort((parent, depth))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    above = np.where(parent[order] >= 0, number[parent[order]], -1)
    column = {c: table.column(c).to_numpy()[order] for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "weighted", "bytes", "below")}
    children = column["n_children"] + np.bincount(above[above >= 0], minlength=len(above))
    leaves, below = (children == 0).astype(np.int64), column["bytes"].copy()
    # what complete nodes hold is in the sums of every recombined node above them already
    _sum_up([leaves, below], column["depth"], above)
    parents = np.where(above >= 0, column["conv_id"][np.maximum(above, 0)], 0)
    arrays = [
        table.column("key").take(pa.array(order)).combine_chunks(), pa.array(column["conv_id"]), pa.array(column["depth"]), pa.array(parents, mask=above < 0), pa.array(column["n_convs"]), pa.array(children),
        pa.array(column["n_leaves"] + leaves), pa.array(column["weighted"] - column["below"] - below),
    ]
    yield pa.RecordBatch.from_arrays(arrays, names=["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"])


_OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, turns_per_shard: int = 500_000, most_broadcast: int = 200_000) -> DataFrame:
    """A row per node of the trie of conversations (conv_id, turns): see _OUT."""
    slim = keep(conversations.select("conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"], t["bytes"]))).alias("ids")), "sequences")
    spark = slim.sparkSession
    turns, rows = slim.agg(F.sum(F.size("ids")) / 3, F.count(F.lit(1))).first()
    shards = max(1, -(-int((turns or 0) + rows) // turns_per_shard), min(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # equal sequences may go to several shards: the conversation is part of the key
    by = F.filter("ids", lambda _, i: i % 3 < 2)
    found = slim.withColumn("by", by).repartitionByRange(shards, "by", "conv_id").drop("by").mapInArrow(_of_shard, _SQL)
    found = keep(found, "nodes")
    drop(slim)
    whole, part = found.where(F.col("kind") == _WHOLE), found.where(F.col("kind") == _PART)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weighted", "below")]
    open_ = part.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("up").alias("up"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"), *sums)
    kind = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    combined = keep(open_.coalesce(1).mapInArrow(_joined, kind), "combined")
    chunks = found.where(F.col("kind") == _ENDS).select("key", "shard", "chunk", "ends")
    hashed = chunks.repartition("key").sortWithinPartitions("key", "shard", "chunk").mapInArrow(_hash_ends, "key binary, sha string")
    recombined = combined.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_NONE)))
    above = combined.select(F.col("key").alias("up"), F.col("conv_id").alias("parent"))
    above = F.broadcast(above) if above.count() <= most_broadcast else above.hint("merge")
    whole = whole.withColumn("saved_tokens", F.col("weighted") - F.col("below"))
    inner, outer = whole.where("up is null"), whole.where("up is not null").join(above, "up").withColumn("parent_conv_id", F.col("parent"))
    return inner.select(*_OUT).unionByName(outer.select(*_OUT)).unionByName(recombined.select(*_OUT))

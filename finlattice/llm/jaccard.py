"""N-gram Jaccard join as a T-occurrence search over an inverted index, by DivideSkip.

A document's shingles are hashed and put in one order for all documents: those of rare words first,
by the documents that hold each word.  A partner shares at least T of a document's n shingles.  The L = T - H lists of its last
shingles, the long ones, are set aside; the other n - L lists are merged, counting occurrences per candidate, and a
candidate must occur in H of them (H grows with n, so long texts meet no candidate by chance).  The lists of both documents are cut in
the same order, so the document whose short lists end first has counted all that it shares in them: only its long lists are
then probed, each by binary search in the other's sorted shingles, and the candidate stays if both counts reach T for the two sizes.

1. Documents of equal sets are one class; its smallest id stands for it.
2. Short lists are range-partitioned and sorted by shingle and size, so that a very common shingle is many
   tasks; ids that share a list with a partner of possible size stay.
3. To begin with, one partner a document: in each list the likeliest of the few before it (by size and by sketch) and of these the one
   of most lists.  The occurrences of these pairs are counted over all their short lists; those that occur in H are probed, in the long
   lists alone, and the links found give components.  As long as that finds links and lists of several components are long, it is done
   again among the long ones, with partners of other components: so a large group of near copies becomes one component in a few rounds of linear work,
   and later rounds read the rows of long lists alone.
4. Lists whose documents are all in one component have nothing more to tell (short ones are told apart after the first round only).  The others are merged in full: pairs of different components
   and possible size, whose sketches (parities of 1,024 places) differ in no more bits than the sets may differ in, are counted over all lists, and
   those that occur often enough are probed in the same way.  Lists of one smallest document meet in one task, which sums a pair over its lists.
   A list longer than `tile` is cut into tiles of pairs of blocks.

Every link between different components is found, so components are exact; links inside a component
are not counted.  Defined results: a null or empty text, or one without a word, has no shingles and is
a component of its own; a null id has a null component and links with nothing; repeated rows and equal
texts share a component; a text however long sends rows in proportion to its length; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rolling import Words, mix
from ._tables import drop, keep, sorted_groups, text_batches, without
from .components import components

_BITS = 1024  # of a sketch
_BEFORE = 4  # earlier documents of a list that one is compared with at first
_LONG = 12  # length of lists of several components, and mean length of all of them, beyond which partners are sought once more
_AT_HOME = 64  # length of lists up to which a task gets all of those with one smallest document
_MOST_BROADCAST = 1_000_000  # rows of (id, keys)
_PAIRS_TOGETHER = 1 << 18  # occurrences of pairs that a task sums at once
_WORD_BITS = 16  # words are counted by so many bits of their hashes


def shingle_set(data: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, A-Z lower-cased."""
    words = Words((data or b"").lower())
    if not words.n:
        return np.zeros(0, np.uint64)
    if words.n < width:
        return words.grams(words.n)
    return np.unique(words.grams(width))


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles at some places: two sketches differ in at most as many bits as the sets in members."""
    at = (mix(shingles) & np.uint64(_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=_BITS) & 1).astype(np.uint8)).tobytes()


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, _BITS // 64)


def _differ(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64)


def least_shared(n: int, percent: int) -> int:
    """T: the shingles that a partner shares at least."""
    return (percent * n + 99) // 100


def hits(n: int, percent: int) -> int:
    """H: the short lists that a partner occurs in at least."""
    return min(least_shared(n, percent), 1 + n // 50)


def n_short(n: int, percent: int) -> int:
    return n - least_shared(n, percent) + hits(n, percent)


def _word_places(words: Words) -> np.ndarray:
    return (words.grams(1) >> np.uint64(64 - _WORD_BITS)).astype(np.int64)


def word_levels(docs: DataFrame) -> np.ndarray:
    """How common the words of each hash place are: twice the binary logarithm of the documents that hold one, over all documents.

    Each task sums its own counts; the driver gets one number for each of 2**_WORD_BITS places.
    """

    def run(batches):
        total = np.zeros(1 << _WORD_BITS, np.int64)
        for _, texts in text_batches(batches):
            for text in texts:
                total[np.unique(_word_places(Words((text or b"").lower())))] += 1
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[place])], names=["place", "n"])

    counts = docs.selectExpr("cast(text as string) text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    levels = np.zeros(1 << _WORD_BITS, np.uint8)
    levels[counts["place"].to_numpy(np.int64)] = 2 * np.log2(counts["n"].to_numpy(float))
    return levels


def ordered_shingles(words: Words, width: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted set of shingle_set(), its members' numbers in the order of all documents, and the levels in that order."""
    if words.n < width:
        found = words.grams(words.n) if words.n else np.zeros(0, np.uint64)
        return found, np.arange(len(found)), np.zeros(len(found), np.int64)
    level = np.concatenate(([0], np.cumsum(levels[_word_places(words)], dtype=np.int64)))
    hashes, common = words.grams(width), level[width:] - level[:-width]
    order = np.argsort(hashes)
    hashes = hashes[order]
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    found, common = hashes[new], common[order[new]]
    rare_first = np.argsort(common, kind="stable")
    return found, rare_first, common[rare_first]


_TABLE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("short", pa.list_(pa.int64())), ("end_level", pa.int64()), ("end_hash", pa.int64()), ("sketch", pa.binary())])


def shingle_table(docs: DataFrame, width: int, percent: int, levels) -> DataFrame:
    """doc_id, n, digest, short (shingles of the short lists), end_level and end_hash (place of the last one in the order), sketch of every document."""
    def run(batches):
        for batch, texts in text_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                s, order, level = ordered_shingles(Words((text or b"").lower()), width, levels.value)
                k = n_short(len(s), percent)
                end = (int(level[k - 1]), int(s[order[k - 1]]) - (1 << 63)) if k else (None, None)
                rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[order[:k]].view(np.int64), *end, sketch(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TABLE, strict=True)], schema=_TABLE)

    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return slim.mapInArrow(run, "doc_id long, n long, digest binary, short array<long>, end_level long, end_hash long, sketch binary")


def _shared_lists(percent: int):
    """Of a stream sorted by token and n: the rows next to one of possible size in their list; a partition's ends stay, as lists may go on there."""

    def run(batches):
        held, near_before = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            token, n = table.column("token").to_numpy(), table.column("n").to_numpy()
            near = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])  # neighbours by size are the likeliest partners
            ok = np.concatenate(([near_before], near))
            ok[:-1] |= near
            near_before = bool(ok[-1])
            yield from table.slice(0, len(token) - 1).filter(pa.array(ok[:-1])).to_batches()
            held = table.slice(len(token) - 1).to_batches()[0]
        if held is not None:
            yield held

    return run


_PAIRS = ["u", "v", "nu", "nv", "shared"]


def _pair_rows(doc: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A column per occurrence of a pair, with the rows of _PAIRS."""
    first = doc[i] < doc[j]
    u, v = np.where(first, i, j), np.where(first, j, i)
    return np.stack((doc[u], doc[v], n[u], n[v], np.ones(len(i), np.int64)))


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Each pair of the parts once, with its occurrences in all of them."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort(rows[:4])]
    starts = np.flatnonzero(np.concatenate(([True], (rows[:4, 1:] != rows[:4, :-1]).any(axis=0))))
    return np.vstack((rows[:4, starts], np.add.reduceat(rows[4], starts)))


def _nearest(percent: int):
    """Of a stream sorted by token and n: each row with the one of least different sketch of the few before it that are of another component."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held, batch]).combine_chunks()
            token, doc, n, component = (table.column(c).to_numpy() for c in ("token", "doc_id", "n", "component"))
            sketches = _sketches(table.column("sketch"))
            best, partner = np.full(len(doc), np.iinfo(np.int64).max), np.full(len(doc), -1)
            for step in range(1, _BEFORE + 1):
                i = np.arange(len(doc) - step)
                i = i[(token[i] == token[i + step]) & (100 * n[i] >= percent * n[i + step]) & (component[i] != component[i + step])]
                j = i + step
                differ = _differ(sketches, i, j)
                better = (differ * (100 + percent) <= (100 - percent) * (n[i] + n[j])) & (differ < best[j])
                best[j[better]], partner[j[better]] = differ[better], i[better]
            j = np.flatnonzero(partner >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(doc[partner[j]]), pa.array(doc[j])], names=["u", "v"])
            held = table.slice(max(0, len(doc) - _BEFORE)).to_batches()

    return run


def _merged(percent: int):
    """Of whole lists or tiles, sorted by n inside: every pair of different components that may be similar, with its occurrences.

    Occurrences are summed over the lists of a task; a row leaves it once for each _PAIRS_TOGETHER occurrences that do not shrink by half.
    """

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        for table in sorted_groups(batches, "list"):
            group = np.unique(np.array(table.column("list").combine_chunks().cast(pa.large_binary()).to_pylist(), object), return_inverse=True)[1]
            doc, n, own, component = (table.column(c).to_numpy() for c in ("doc_id", "n", "own", "component"))
            tiled = table.column("tiled").to_numpy(zero_copy_only=False)
            sketches = _sketches(table.column("sketch"))
            rows, step = np.arange(len(doc)), 0
            while True:
                step += 1
                rows = rows[rows + step < len(doc)]
                rows = rows[(group[rows] == group[rows + step]) & (100 * n[rows] >= percent * n[rows + step])]
                if not len(rows):
                    break
                i = rows[(component[rows] != component[rows + step]) & (~tiled[rows] | (own[rows] != own[rows + step]))]
                i = i[_differ(sketches, i, i + step) * (100 + percent) <= (100 - percent) * (n[i] + n[i + step])]
                if not len(i):
                    continue
                held.append(_pair_rows(doc, n, i, i + step))
                size += len(i)
                if size >= _PAIRS_TOGETHER:
                    held = [_summed(held)]
                    size = held[0].shape[1]
                    if 2 * size > _PAIRS_TOGETHER:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=_PAIRS)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(held)], names=_PAIRS)

    return run


def _list_rows(lists_of: DataFrame) -> DataFrame:
    return lists_of.select("*", F.explode("lists").alias("token")).drop("lists")


def _several(rows: DataFrame) -> DataFrame:
    """token, length, first (smallest document) of the lists that hold several components."""
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("length"), F.min("doc_id").alias("first"), F.min("component").alias("x"), F.max("component").alias("y"))
    return keep(lists.where("x <> y").select("token", "length", "first"), "several")


def _crowded(several: DataFrame) -> bool:
    """Whether a document of these lists shares one with _LONG others on average."""
    squares, rows = several.agg(F.sum(F.col("length") * F.col("length")), F.sum("length")).first()
    return bool(rows) and squares > _LONG * rows


def _candidates(placed: DataFrame, several: DataFrame, percent: int, tile: int) -> DataFrame:
    """u, v, shared: pairs of different components that occur together in enough short lists.

    A pair's lists mostly have one smallest document and meet in the task of that one, which sums the pair; rows of a task stay bounded,
    as a document has so many short lists and longer lists go by themselves.
    """
    blocks = F.ceil(F.col("length") / tile).cast("int").alias("blocks")
    home = F.when(F.col("length") <= _AT_HOME, F.col("first")).otherwise(F.col("token")).alias("home")
    rows = _list_rows(placed).join(several.select("token", blocks, home).hint("merge"), "token")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile_name = F.concat(F.least("own", "other"), F.lit("/"), F.greatest("own", "other"))
    name = F.concat_ws("/", F.col("token").cast("string"), F.when(F.col("blocks") > 1, tile_name)).cast("binary")
    by = F.when(F.col("blocks") > 1, F.xxhash64(name)).otherwise(F.col("home"))  # tiles of a list are tasks of their own
    rows = rows.select(name.alias("list"), "doc_id", "n", "own", (F.col("own") != F.col("other")).alias("tiled"), "sketch", "component", by.alias("home"))
    pairs = rows.repartition("home").drop("home").sortWithinPartitions("list", "n", "doc_id").mapInArrow(_merged(percent), "u long, v long, nu long, nv long, shared long")
    counts = pairs.groupBy("u", "v", "nu", "nv").agg(F.sum("shared").alias("shared"))
    return counts.where(_often_enough(percent)).select("u", "v", "shared")


def _often_enough(percent: int):
    """Whether a pair (shared, nu, nv) occurs in the short lists that it must occur in; see hits()."""
    need = lambda n: F.least(F.floor((percent * F.col(n) + 99) / 100), 1 + F.floor(F.col(n) / 50))
    return F.col("shared") >= F.least(need("nu"), need("nv"))


def _counted(pairs: DataFrame, lists_of: DataFrame, percent: int) -> DataFrame:
    """u, v, shared of the pairs (u, v) that occur together in enough short lists: all that they share, not those that they were met in."""
    side = lambda name: lists_of.select(F.col("doc_id").alias(name), F.col("n").alias(f"n{name}"), F.col("lists").alias(f"l{name}"))
    joined = pairs.join(side("v").hint("merge"), "v").join(side("u").hint("merge"), "u")
    counts = joined.select("u", "v", "nu", "nv", F.size(F.array_intersect("lu", "lv")).cast("long").alias("shared"))
    return counts.where(_often_enough(percent)).select("u", "v", "shared")


_SENT = pa.schema([("u", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("self", pa.bool_()), ("shared", pa.int64()), ("shingles", pa.binary()), ("long", pa.binary()), ("end_level", pa.int64()), ("end_hash", pa.int64())])


def _compare(percent: int):
    """Of a stream sorted by u and part, u's own row first: the pairs whose counts reach T."""

    def run(batches):
        now, own = None, None
        for batch in batches:
            u, v = [], []
            for key_u, part, doc_id, is_self, shared, raw, bits, level, end in zip(*(batch.column(c.name).to_pylist() for c in _SENT), strict=True):
                shingles = np.frombuffer(raw, np.uint64)
                row = (shingles, bits, (level, end))
                if is_self:
                    if now != (key_u, part):
                        now, own = (key_u, part), row
                    continue
                query, other = (own, row) if own[2] <= row[2] else (row, own)
                probes = query[0][np.unpackbits(np.frombuffer(query[1], np.uint8), count=len(query[0])).astype(bool)]
                at = np.minimum(np.searchsorted(other[0], probes), len(other[0]) - 1)
                both = shared + int((other[0][at] == probes).sum())
                if 100 * both >= percent * (len(query[0]) + len(other[0]) - both):
                    u.append(key_u)
                    v.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def probe(docs: DataFrame, pairs: DataFrame, width: int, percent: int, levels, fan_in: int = 512) -> DataFrame:
    """The pairs (u, v; shared: occurrences in the short lists of both) whose sets are similar.

    u's shingles are sent to as many tasks as its number of partners asks for.
    """
    heavy = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / fan_in).cast("int").alias("parts"))
    one = pairs.join(heavy, "u").select("u", "v", "shared", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    none = F.lit(None).cast("long").alias("shared")
    keys = one.select(F.col("v").alias("doc_id"), F.struct("u", "part", "shared").alias("key")).unionAll(
        heavy.select(F.col("u").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "u").select("doc_id", F.struct("u", "part", none).alias("key"))
    )
    send = keep(keys.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "probes")
    if send.select(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0] <= _MOST_BROADCAST:
        send = F.broadcast(send)  # else by shuffle
    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").join(send, "doc_id")

    def sets(batches):
        for batch, texts in text_batches(batches):
            rows, size = [], 0
            for doc_id, keys_of, text in zip(batch.column("doc_id").to_pylist(), batch.column("keys").to_pylist(), texts, strict=True):
                s, order, level = ordered_shingles(Words((text or b"").lower()), width, levels.value)
                k = n_short(len(s), percent)
                if not k:
                    continue
                is_long = np.zeros(len(s), np.uint8)
                is_long[order[k:]] = 1
                sent = (s.tobytes(), np.packbits(is_long).tobytes(), int(level[k - 1]), int(s[order[k - 1]]) - (1 << 63))
                for key in keys_of:
                    rows.append((key["u"], key["part"], doc_id, key["u"] == doc_id, key["shared"], *sent))
                    size += len(sent[0])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    arrays = slim.mapInArrow(sets, "u long, part int, doc_id long, self boolean, shared long, shingles binary, long binary, end_level long, end_hash long")
    return arrays.repartition("u", "part").sortWithinPartitions("u", "part", F.desc("self"), "doc_id").mapInArrow(_compare(percent), "u long, v long")


def join(docs: DataFrame, width: int = 3, percent: int = 90, tile: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    levels = docs.sparkSession.sparkContext.broadcast(word_levels(docs))
    table = keep(shingle_table(docs, width, percent, levels), "shingles")
    able = table.where("doc_id is not null and n > 0")
    classes = keep(able.groupBy("digest", "n").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = classes.select(F.col("rep").alias("doc_id"), F.col("digest").alias("d"), F.col("n").alias("m"))
    reps = able.join(chosen.hint("merge"), "doc_id").where("digest = d and n = m").dropDuplicates(["doc_id", "digest"])

    tokens = keep(reps.select(F.explode("short").alias("token"), "doc_id", "n"), "tokens")
    by_list = tokens.repartitionByRange("token", "n", "doc_id").sortWithinPartitions("token", "n", "doc_id")
    shared = by_list.mapInArrow(_shared_lists(percent), "token long, doc_id long, n long")
    per_doc = shared.groupBy("doc_id").agg(F.collect_set("token").alias("lists"))
    lists_of = keep(per_doc.hint("merge").join(reps.select("doc_id", "n", "sketch"), "doc_id").select("doc_id", "n", "sketch", "lists"), "lists")

    placed, links, done, shorter, longer, crowd, most = lists_of.withColumn("component", F.col("doc_id")), None, None, None, None, None, 0
    rows = _list_rows(placed)
    while True:
        near = rows.repartitionByRange("token", "n", "doc_id").sortWithinPartitions("token", "n", "doc_id")
        pairs = near.mapInArrow(_nearest(percent), "u long, v long").groupBy("u", "v").agg(F.count(F.lit(1)).alias("lists"))
        pairs = pairs if done is None else pairs.join(done.unionAll(done.select(F.col("v").alias("u"), F.col("u").alias("v"))), ["u", "v"], "left_anti")
        met = keep(pairs.groupBy("v").agg(F.max(F.struct("lists", "u"))["u"].alias("u")).select("u", "v"), "met")  # one partner each: the one of most lists
        pairs = keep(_counted(met, lists_of, percent), "pairs")
        new = keep(probe(docs, pairs, width, percent, levels), "links")
        tried = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        links, done = (new, tried) if links is None else (links.unionAll(new), done.unionAll(tried))
        found = keep(components(links), "components")
        placed = lists_of.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        n_new = new.count()
        most = max(most, n_new)
        if shorter is None:
            several = _several(_list_rows(placed.select("doc_id", "lists", "component")))
            shorter, longer = several.where(F.col("length") <= _LONG), several.where(F.col("length") > _LONG)
        else:
            longer = _several(crowd.join(placed.select("doc_id", "component").hint("merge"), "doc_id"))
        several = shorter.unionAll(longer)
        if 20 * n_new <= most or not _crowded(several):  # what rounds no longer find is left to the search among components
            break
        if crowd is None:  # only long lists are gone through again; they never come to hold several components once they hold one
            tokens_of = longer.select("token")
            few = tokens_of.count() <= _MOST_BROADCAST
            crowd = keep(_list_rows(lists_of.select("doc_id", "lists")).join(F.broadcast(tokens_of) if few else tokens_of.hint("merge"), "token"), "crowd")
        rows = crowd.join(longer.select("token").hint("merge"), "token").join(placed.drop("lists").hint("merge"), "doc_id")
    rest = keep(_candidates(placed, several, percent, tile).join(done, ["u", "v"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = keep(probe(docs, rest, width, percent, levels), "links")
        found = components(links.unionAll(more))
    found = keep(found, "components")
    drop(tokens, lists_of, several, rest, *([] if crowd is None else [crowd]))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component"))
    out = table.select("doc_id", "n", "digest").join(named, ["digest", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """The document of least id of every component; rows of a null id stay."""
    others = join(docs, width, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, keep(others, "copies"))

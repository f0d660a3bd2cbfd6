"""Repeated passages by a sparse suffix array.

Of all word positions a text keeps only its minimisers: the position of the least hash of `seed` words
in every window of `least` words, so that two equal passages of `least` words keep the same
position.  Suffixes whose first `seed` words occur nowhere else have no neighbour and go.  Equal stretches
(all words of the windows that a position stands for) are one row; the rows are range-partitioned and
sorted by their text from the position on.  Common lengths of neighbours give the intervals of the array that agree
on any number of words to the right; inside an interval matches are extended word by word to the
left.  Both ends of a range partition may cut an interval: the rows of such an interval, and of one too long for
a block, are finished by a shuffle on digests of their windows, whose counts are summed in each task first.

A word is repeated if a window of `least` words over it occurs at two places, in one text or in two.
The first place of a window (least doc_id, then position) is where it stays.  without_repeats() cuts every word
that a window with an earlier place covers, also where a first window overlaps it: every word cut is left at an
earlier place, and no passage stays whole in two documents because its neighbours happen to be equal.

Words to the right are compared as text, words to the left by 64-bit hashes within one block; stretches are
equal if two hashes of 64 bits are.  Defined results: null or short texts have no repeats; rows of a null id are
ignored; several rows of one doc_id count as one document and its passages are not repeats of themselves if the
rows are equal; an empty table gives an empty result; extra columns are ignored.  A-Z are lower-cased first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rolling import Words, mix
from ._tables import drop, free_name, keep, text_batches

_BYTES = 8 << 20  # of a block's texts, each as wide as the widest
_OFFSET = np.uint64(0x9E3779B97F4A7C15)
#: The separator of words becomes the least byte, so suffixes that agree on whole words are neighbours.
_SORTABLE = bytes([32, *range(1, 32), 0, *range(33, 256)])


def minimisers(words: Words, least: int, seed: int) -> tuple[np.ndarray, ...]:
    """lo, hi (first and last window that a position stands for), the position, seed hash and stretch hash of each retained one."""
    windows = words.n - least + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 5
    hashes = words.grams(seed)
    width = least - seed + 1
    at = np.arange(windows) + np.lib.stride_tricks.sliding_window_view(hashes, width).argmin(axis=1)
    cuts = np.flatnonzero(np.diff(at)) + 1
    lo = np.concatenate(([0], cuts))
    hi = np.concatenate((cuts - 1, [windows - 1]))
    return lo, hi, at[lo], hashes[at[lo]].view(np.int64), _stretch(words, lo, hi, at[lo], least)


def _stretch(words: Words, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Hash of all words of some windows and of the position inside."""
    return mix(words.hash(words.starts[lo], words.ends[hi + least - 1]) + (at - lo).astype(np.uint64) * _OFFSET).view(np.int64)


def suffixes(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """doc_id, lo, span (last window - lo), at (position - lo), seed, stretch of every retained suffix."""

    def run(batches):
        for batch, texts in text_batches(batches):
            ids, parts = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                found = minimisers(Words((text or b"").lower()), least, seed)
                ids.append(np.full(len(found[0]), doc_id, np.int64))
                parts.append(found)
            lo, hi, at, seeds, stretch = (np.concatenate([p[k] for p in parts]) for k in range(5))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids)), *(pa.array(x.astype(np.int32)) for x in (lo, hi - lo, at - lo)), pa.array(seeds), pa.array(stretch)],
                names=["doc_id", "lo", "span", "at", "seed", "stretch"],
            )

    return docs.mapInArrow(run, "doc_id long, lo int, span int, at int, seed long, stretch long")


_TEXTS = pa.schema([("right", pa.binary()), ("left", pa.binary()), ("seed", pa.int64()), ("stretch", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("span", pa.int32()), ("at", pa.int32())])


def _with_text(docs: DataFrame, stretches: DataFrame, least: int, seed: int) -> DataFrame:
    """Each stretch with its words from the position on (sortable) and those before it, read from the text where it first occurs."""
    wanted = stretches.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "span", "at", "seed", "stretch", "n")).alias("parts")).hint("merge")

    def run(batches):
        for batch, texts in text_batches(batches):
            for doc_id, parts, text in zip(batch.column("doc_id").to_pylist(), batch.column("parts").to_pylist(), texts, strict=True):
                words = Words((text or b"").lower())
                parts = [p for p in parts if p["lo"] + p["span"] + least <= words.n]  # others are of another row of the same doc_id
                if not parts:
                    continue
                lo, span, at, seeds, stretch = (np.array([p[k] for p in parts], np.int64) for k in ("lo", "span", "at", "seed", "stretch"))
                own = (_stretch(words, lo, lo + span, lo + at, least) == stretch) & (words.grams(seed)[lo + at].view(np.int64) == seeds)
                joined = words.bytes.tobytes()
                start, middle, end = words.starts[lo].tolist(), words.starts[lo + at].tolist(), words.ends[lo + span + least - 1].tolist()
                rows = [
                    (joined[middle[k] : end[k]].translate(_SORTABLE), joined[start[k] : max(start[k], middle[k] - 1)], p["seed"], p["stretch"], p["n"], doc_id, p["lo"], p["span"], p["at"])
                    for k, p in enumerate(parts)
                    if own[k]
                ]
                for k in range(0, len(rows), 2000):
                    yield _batch(rows[k : k + 2000], _TEXTS)

    kind = "right binary, left binary, seed long, stretch long, n long, doc_id long, lo int, span int, at int"
    return docs.join(wanted, "doc_id").select("doc_id", "text", "parts").mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def common_words(texts: list[bytes]) -> np.ndarray:
    """For each of some sortable texts the words at its start that it has in common with the one before; 0 for the first."""
    n = [t.count(b"\0") + 1 for t in texts]
    out = np.zeros(len(texts), np.int64)
    if len(texts) > 1:
        width = max(map(len, texts)) + 1
        table = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)
        same = np.logical_and.accumulate(table[1:] == table[:-1], axis=1)  # of bytes from the start on
        out[1:] = np.minimum(np.count_nonzero(same & (table[1:] == 0), axis=1), np.minimum(n[1:], n[:-1]))
    return out


class _Block:
    """Rows of the suffix array that stand next to each other."""

    def __init__(self, rows: list[tuple], least: int):
        self.least = least
        right, left, *rest = zip(*rows, strict=True)
        self.seed, self.stretch, self.n, self.doc, self.lo, self.span, self.at = (np.array(c, np.int64) for c in rest)
        self.common = common_words(list(right))
        self.words = Words(b" ".join(left))
        self.last_left = np.cumsum(self.at)  # number of words before the end of each row's left text

    def left_hash(self, rows: np.ndarray, length: int) -> np.ndarray:
        if not length:
            return np.zeros(len(rows), np.uint64)
        end = self.last_left[rows]
        return self.words.hash(self.words.starts[end - length], self.words.ends[end - 1])

    def runs(self, chosen: np.ndarray) -> list[np.ndarray]:
        """seed, stretch, a, b, first_doc, first_start of the runs of repeated windows of the chosen rows, whose intervals are all here."""
        chosen = chosen[np.lexsort((self.lo[chosen] + self.at[chosen], self.doc[chosen]))]  # first places first
        row, window, first = [], [], []
        for length in range(int(self.at[chosen].max(initial=-1)) + 1):
            rows = chosen[(self.at[chosen] - self.span[chosen] <= length) & (length <= self.at[chosen])]
            if not len(rows):
                continue
            interval = np.cumsum(self.common < self.least - length)  # rows that agree on the rest of the window to the right
            _, at, inverse = np.unique(self.left_hash(rows, length) ^ mix(interval[rows].astype(np.uint64)), return_index=True, return_inverse=True)
            copies = np.bincount(inverse, self.n[rows], minlength=len(at))
            twice = copies[inverse] > 1
            row.append(rows[twice])
            window.append((self.at[rows] - length)[twice])
            first.append(rows[at[inverse]][twice])
        none = np.zeros(0, np.int64)
        row, window, first = (np.concatenate([none, *parts]) for parts in (row, window, first))
        if not len(row):
            return [none] * 6
        order = np.lexsort((window, row))
        row, window, first = row[order], window[order], first[order]
        start = self.lo[first] + self.at[first] - self.at[row] + window
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1) | (self.doc[first[1:]] != self.doc[first[:-1]]) | (start[1:] != start[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(row)) - 1
        return [self.seed[row[a]], self.stretch[row[a]], window[a], window[b], self.doc[first[a]], start[a]]


_COMPARED = pa.schema([*((c, pa.int64()) for c in ("seed", "stretch", "a", "b", "first_doc", "first_start", "n", "w1", "w2"))])


def _compare(least: int, seed: int, most_rows: int):
    """Of suffixes sorted by text: runs of repeated windows (w1 null), and for intervals that a partition or block may cut the windows themselves."""

    def windows(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for right, left, key, stretch, n, doc, lo, span, _ in rows:
            words = Words((left + b" " if left else b"") + right.translate(_SORTABLE))
            at = np.arange(span + 1)
            w1 = words.hash(words.starts[at], words.ends[at + least - 1])
            w2 = words.hash(words.starts[at + 1], words.ends[at + least - 2])
            out += [(key, stretch, k, k, doc, lo + k, n, x, y) for k, x, y in zip(at.tolist(), w1.view(np.int64).tolist(), w2.view(np.int64).tolist(), strict=True)]
        return _batch(out, _COMPARED)

    def block(rows: list[tuple], open_start: bool, open_end: bool):
        """The results of a block; its first (last) interval may go on before (after) it."""
        if not rows:
            return
        own = _Block(rows, least)
        group = np.cumsum(own.common < seed)
        cut = np.zeros(len(rows), bool)
        if open_start:
            cut |= group == group[0]
        if open_end:
            cut |= group == group[-1]
        found = own.runs(np.flatnonzero(~cut))
        none = pa.nulls(len(found[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([*map(pa.array, found), none, none, none], schema=_COMPARED)
        at = np.flatnonzero(cut).tolist()
        for k in range(0, len(at), 500):
            yield windows([rows[i] for i in at[k : k + 500]])

    def run(batches):
        held: list[tuple] = []
        width, open_start = 0, True
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:4] == held[-1][:4]:
                    continue  # a document that was read twice
                width = max(width, len(row[0]))
                if held and (len(held) >= most_rows or (len(held) + 1) * width > _BYTES):
                    starts = np.flatnonzero(common_words([r[0] for r in held]) < seed)
                    keep_from = int(starts[-1])
                    if keep_from:  # the last interval waits for the next block
                        yield from block(held[:keep_from], open_start, False)
                        held, open_start = held[keep_from:], False
                    else:  # one interval longer than a block
                        yield from block(held, True, True)
                        held, open_start = [], True
                    width = max([len(row[0]), *(len(r[0]) for r in held)])
                held.append(row)
        yield from block(held, open_start, True)

    return run


def _runs(batches):
    """Of a stream sorted by seed, stretch and a: runs of repeated windows with one source."""
    now = None
    for batch in batches:
        rows = []
        for key, stretch, at, doc, start in zip(*(batch.column(c).to_pylist() for c in ("seed", "stretch", "a", "first_doc", "first_start")), strict=True):
            if now and now[:2] == [key, stretch] and now[3] + 1 == at and now[4] == doc and now[5] + at - now[2] == start:
                now[3] = at
                continue
            if now:
                rows.append(tuple(now))
            now = [key, stretch, at, at, doc, start]
        yield _batch(rows, _RUN)
    if now:
        yield _batch([tuple(now)], _RUN)


_RUN = pa.schema([*((c, pa.int64()) for c in ("seed", "stretch", "a", "b", "first_doc", "first_start"))])


def _finish(windows: DataFrame) -> DataFrame:
    """Runs of the windows that occur twice, from windows of intervals that were cut; a very common window is one row a task before the shuffle."""
    place = F.struct("seed", "stretch", "a")
    sums = windows.groupBy("w1", "w2").agg(F.max("n").alias("m"), F.min(place).alias("p"), F.max(place).alias("q"), F.min(F.struct("first_doc", "first_start")).alias("f"))
    twice = keep(sums.where("m > 1 or p <> q").select("w1", "w2", F.col("f.first_doc").alias("first_doc"), F.col("f.first_start").alias("first_start")), "twice")
    matched = windows.select("w1", "w2", "seed", "stretch", "a").join(twice.hint("merge"), ["w1", "w2"]).select("seed", "stretch", "a", "first_doc", "first_start")
    ends = matched.repartition("seed", "stretch").sortWithinPartitions("seed", "stretch", "a")
    return ends.mapInArrow(_runs, "seed long, stretch long, a long, b long, first_doc long, first_start long")


def _merge(intervals: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _minus(intervals: list[list[int]], others: list[list[int]]) -> list[tuple[int, int]]:
    """Sorted disjoint intervals without other such ones."""
    out = []
    k = 0
    for a, b in intervals:
        while k < len(others) and others[k][1] <= a:
            k += 1
        j = k
        while j < len(others) and others[j][0] < b:
            x, y = others[j]
            if x > a:
                out.append((a, x))
            a = max(a, y)
            j += 1
        if a < b:
            out.append((a, b))
    return out


_SPANS = pa.schema(
    [("doc_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("first_doc_id", pa.int64()), *((c, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))) for c in ("cut", "covered"))]
)


def _spans(doc_id: int, rows: list[tuple], least: int):
    """The maximal repeated passages of one document from its (start, end, first_doc, first_start)."""
    own = [(s, e) for s, e, d, f in rows if (d, f) == (doc_id, s)]
    other = [(s, e) for s, e, d, f in rows if (d, f) != (doc_id, s)]
    cut = _minus(_merge(other), _merge(own))
    covered = _merge([(max(s, f + least) if d == doc_id else s, e) for s, e, d, f in rows if (d, f) != (doc_id, s)])
    rows = sorted(rows)
    at = [0, 0]
    k = 0
    for a, b in _merge([(s, e) for s, e, _, _ in rows]):
        first = doc_id
        while k < len(rows) and rows[k][0] < b:
            first = min(first, rows[k][2])
            k += 1
        lists = []
        for which, parts in enumerate((cut, covered)):
            i = at[which]
            while i < len(parts) and parts[i][0] < b:
                i += 1
            lists.append([{"from": x, "to": y} for x, y in parts[at[which] : i]])
            at[which] = i
        yield doc_id, a, b - a, first, *lists


def _gather(least: int):
    def run(batches):
        now, rows = None, []
        for batch in batches:
            out = []
            for doc_id, *row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "end", "first_doc", "first_start")), strict=True):
                if doc_id != now:
                    if rows:
                        out += _spans(now, rows, least)
                    now, rows = doc_id, []
                rows.append(tuple(row))
            yield _batch(out, _SPANS)
        if rows:
            yield _batch(list(_spans(now, rows, least)), _SPANS)

    return run


def repeats(docs: DataFrame, least: int = 50, seed: int = 16, block: int = 4096) -> DataFrame:
    """One row per maximal repeated passage of a document: doc_id, start_word, n_words, first_doc_id, cut, covered.

    first_doc_id is the least document that holds some window of the passage first; cut lists the word
    ranges [from, to) that occur earlier elsewhere and are not needed here as a first occurrence; covered lists
    all ranges that occur earlier, but for words of a window's own first place where it overlaps that.
    block is the number of suffixes that a task compares at once; it changes no result.
    """
    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").where("doc_id is not null")
    kept = keep(suffixes(slim, least, seed), "suffixes")
    counts = kept.groupBy("seed").agg(F.count(F.lit(1)).alias("c"), F.min("stretch").alias("x"), F.max("stretch").alias("y"))
    seeds = keep(counts.where("c > 1").select("seed", (F.col("x") != F.col("y")).alias("several")), "seeds")
    shared = keep(kept.join(seeds.hint("merge"), "seed"), "shared")
    place = F.struct("doc_id", "lo")
    classes = shared.groupBy("seed", "stretch").agg(
        F.count(F.lit(1)).alias("c"), F.min(place).alias("f"), F.max(place).alias("l"), F.max("span").alias("span"), F.max("at").alias("at"), F.max("several").alias("several")
    )
    n = F.when(F.col("f") == F.col("l"), 1).otherwise(F.col("c"))
    classes = keep(classes.select("seed", "stretch", n.alias("n"), F.col("f.doc_id").alias("doc_id"), F.col("f.lo").alias("lo"), "span", "at", "several"), "stretches")
    # the only neighbours agree on the whole stretch
    long = lambda c: F.col(c).cast("long")
    plain = classes.where("not several and n > 1").select("seed", "stretch", F.lit(0).cast("long").alias("a"), long("span").alias("b"), F.col("doc_id").alias("first_doc"), long("lo").alias("first_start"))
    # neighbours that differ somewhere: the sorted array
    texts = keep(_with_text(slim, classes.where("several"), least, seed), "texts")  # the range sample and the sort read it
    array = texts.repartitionByRange("right", "left").sortWithinPartitions("right", "left", "seed", "stretch")
    compared = keep(array.mapInArrow(_compare(least, seed, block), "seed long, stretch long, a long, b long, first_doc long, first_start long, n long, w1 long, w2 long"), "compared")
    runs = ["seed", "stretch", "a", "b", "first_doc", "first_start"]
    found = keep(plain.unionAll(compared.where("w1 is null").select(*runs)).unionAll(_finish(compared.where("w1 is not null"))), "runs")
    placed = shared.select("doc_id", "lo", "seed", "stretch").join(found.hint("merge"), ["seed", "stretch"]).select(
        "doc_id", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("b") + least).alias("end"), "first_doc", "first_start"
    )
    kind = "doc_id long, start_word long, n_words long, first_doc_id long, cut array<struct<from:long,to:long>>, covered array<struct<from:long,to:long>>"
    result = keep(placed.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_gather(least), kind), "repeats")
    drop(kept, seeds, shared, classes, texts, compared, found)
    return result


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def cut_words(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the words of some ranges [from, to) and without the white space after them."""
    if not ranges:
        return data
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate(([1], space.astype(np.int8), [1])))
    starts = np.append(np.flatnonzero(edge == -1), len(data))
    out, at = [], 0
    for a, b in sorted(ranges):
        out.append(data[at : starts[a]])
        at = int(starts[min(b, len(starts) - 1)])
    out.append(data[at:])
    return b"".join(out)


def without_repeats(docs: DataFrame, least: int = 50, seed: int = 16) -> DataFrame:
    """docs with every word cut that a repeated window covers where it is not first; a text that is nothing but such passages goes."""
    name = free_name(docs, "cut")
    ranges = repeats(docs, least, seed).select("doc_id", F.explode("covered").alias("c")).groupBy("doc_id").agg(F.collect_list("c").alias(name))
    fields = docs.schema

    def run(batches):
        for batch, texts in text_batches(batches):
            kept, out = [], []
            for text, ranges_of in zip(texts, batch.column(name).to_pylist(), strict=True):
                new = cut_words(text, [(r["from"], r["to"]) for r in ranges_of]) if text is not None and ranges_of else text
                kept.append(not ranges_of or bool(new.split()))
                out.append(None if new is None else new.decode())
            batch = batch.select([f.name for f in fields])
            batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(out, batch.schema.field("text").type))
            yield batch.filter(pa.array(kept))

    return docs.join(ranges, "doc_id", "left").mapInArrow(run, fields)


def summary(docs: DataFrame, least: int = 50, seed: int = 16, block: int = 4096) -> DataFrame:
    """repeats() with the number of words that would be cut in place of the ranges."""
    cut = F.aggregate("cut", F.lit(0).cast("long"), lambda s, c: s + c["to"] - c["from"])
    return repeats(docs, least, seed, block).select("doc_id", "start_word", "n_words", "first_doc_id", cut.alias("cut_words"))

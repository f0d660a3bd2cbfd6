"""Phrase collocations, counted in HAT-tries: burstable hash containers under a shallow trie of word numbers.

Phrases are counted by length.  A task numbers the words it meets (per language), cuts texts into words in numpy and
writes a phrase as one 64-bit code of its words' numbers.  Codes are added to hash containers (open addressing, in
numpy); a container of too many codes bursts into sixteen by the next four bits, first word first.  When the trie holds
too much, its largest subtrees are spilled as sorted runs of phrases, and all of them at the end.  Runs are written, then
range-partitioned by phrase, so that words of one beginning meet in a task and a common beginning is many tasks,
and merged as a stream.

A phrase that occurs often enough has only parts that do, so length n is counted where both parts of n - 1 words may be
frequent, as a bit map of fixed size says (2**FILTER_BITS bits, 16 MB, broadcast).  A bit that is set by chance costs work and no count.
Counts, cuts and scores are exact: 64-bit counts, 38-digit products.

Defined results: a null text is empty; a null language is `und`; texts without a word count nothing; phrases never
cross a piece or a text; repeated rows count as often as they are there; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._rolling import Spans, mix
from ._tables import drop, keep, text_batches

#: Bits of the map of frequent phrases; words that a task numbers at once (three numbers make a code).
FILTER_BITS, WORD_BITS = 27, 21
#: Codes of a container before it bursts, codes that a task's trie holds before it spills, bytes of text cut into words at once.
BURST, MOST_CODES, CHUNK = 1 << 16, 1_000_000, 1 << 20

_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
_FREE = np.uint64((1 << 64) - 1)


class Container:
    """A hash table of codes and their counts, by linear probing."""

    def __init__(self, bits: int = 10):
        self.codes, self.counts, self.n = np.full(1 << bits, _FREE), np.zeros(1 << bits, np.int64), 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Codes are distinct."""
        at = 0
        while at < len(codes):
            if 8 * self.n > 3 * len(self.codes):
                held, number = self.items()
                self.codes, self.counts, self.n = np.full(2 * len(self.codes), _FREE), np.zeros(2 * len(self.codes), np.int64), 0
                self._put(held, number)
            room = len(self.codes) // 2 - self.n
            self._put(codes[at : at + room], counts[at : at + room])
            at += room

    def _put(self, codes: np.ndarray, counts: np.ndarray) -> None:
        mask = len(self.codes) - 1
        slot = (mix(codes) & np.uint64(mask)).astype(np.int64)
        while len(codes):
            free = self.codes[slot] == _FREE
            self.codes[slot[free]] = codes[free]  # of several for one slot the last stays
            hit = self.codes[slot] == codes
            self.counts[slot[hit]] += counts[hit]
            self.n += int((free & hit).sum())
            left = ~hit
            codes, counts, slot = codes[left], counts[left], (slot[left] + 1) & mask

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.codes != _FREE
        return self.codes[used], self.counts[used]


class Node:
    """A container, or after bursting sixteen nodes by the next four bits of the codes."""

    def __init__(self, shift: int):
        self.shift, self.inside, self.below = shift, Container(), None

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        if self.below is None:
            self.inside.add(codes, counts)
            if self.inside.n > BURST and self.shift >= 0:
                codes, counts = self.inside.items()
                self.inside, self.below = None, {}
            else:
                return
        child = ((codes >> np.uint64(self.shift)) & np.uint64(15)).astype(np.int8)
        order = np.argsort(child, kind="stable")
        child, codes, counts = child[order], codes[order], counts[order]
        ends = np.searchsorted(child, np.arange(17))
        for k in range(16):
            if ends[k] < ends[k + 1]:
                if k not in self.below:
                    self.below[k] = Node(self.shift - 4)
                self.below[k].add(codes[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]])

    @property
    def n(self) -> int:
        return self.inside.n if self.below is None else sum(x.n for x in self.below.values())

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        if self.below is None:
            return self.inside.items()
        parts = [x.items() for x in self.below.values()]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class HatTrie:
    """Codes and their counts; spill() gives the largest subtrees until little is left."""

    def __init__(self, bits: int = 3 * WORD_BITS):
        self.top = -(-bits // 4) * 4 - 4
        self.root = Node(self.top)

    @property
    def n(self) -> int:
        return self.root.n

    def add(self, codes: np.ndarray) -> None:
        self.root.add(*np.unique(codes, return_counts=True))

    def spill(self, to: int = 0):
        """Takes out whole subtrees, the largest first, until at most `to` codes are left."""
        while self.n > to:
            node = self.root
            if node.below is None:
                yield node.items()
                self.root = Node(self.top)
                continue
            k = max(node.below, key=lambda i: node.below[i].n)
            while node.below[k].below is not None and node.below[k].n > MOST_CODES // 4:
                node = node.below[k]
                k = max(node.below, key=lambda i: node.below[i].n)
            taken = node.below.pop(k)
            if not node.below:
                node.inside, node.below = Container(), None
            yield taken.items()


def cut_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the piece of each."""
    kind = _KIND[np.frombuffer(data, np.uint8)]
    word = np.concatenate(([False], kind == 0, [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, np.cumsum(kind == 2)[starts] if len(starts) else starts


def _chunks(texts: list[bytes]):
    """The texts of one language, joined and cut into chunks of about CHUNK bytes: (data, words at its start that were counted before).

    A chunk ends between pieces where it can; within a long piece it ends between words and the next starts with its last two words."""
    held, size = [], 0
    for text in texts:
        if len(text) <= CHUNK:
            held.append(text)
            size += len(text)
            if size > CHUNK:
                yield b"\n".join(held), 0
                held, size = [], 0
            continue
        at, done, again = 0, 0, 0
        while done < len(text):
            end = max(at + CHUNK, done + 1)
            while end < len(text) and _KIND[text[end]] == 0:
                end += 1
            part = text[at:end]
            yield part, again
            starts, _, piece = cut_words(part)
            last = int((_KIND[np.frombuffer(part, np.uint8)] == 2).sum())
            again = int((piece[-2:] == last).sum())
            at, done = at + int(starts[-again]) if again else end, end
    if held:
        yield b"\n".join(held), 0


def _hash(lang: str, words: list[bytes]) -> list[int]:
    seed = xxhash.xxh3_64_intdigest(lang)
    return [xxhash.xxh3_64_intdigest(w, seed) for w in words]


def _pair(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + mix(g))


def _phrase_hash(hashes: np.ndarray) -> np.ndarray:
    """Of phrases, a column per word."""
    out = hashes[:, 0]
    for k in range(1, hashes.shape[1]):
        out = _pair(out, hashes[:, k])
    return out


class Dictionary:
    """Numbers of the words of a task, by language, with their filter hashes."""

    def __init__(self):
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.hashes = np.zeros(1024, np.uint64)
        self.known = 0

    def of(self, lang: str, words: list[bytes], wanted) -> np.ndarray:
        """Numbers of the words, -1 for those that wanted (a function of hashes) leaves out."""
        known = self.numbers.setdefault(lang, {})
        out = np.array([known.get(w, -2) for w in words], np.int64)
        new = np.flatnonzero(out == -2)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            hashes = np.array(_hash(lang, fresh), np.uint64)
            yes = wanted(hashes)
            number = np.where(yes, len(self.words) + np.cumsum(yes) - 1, -1)
            out[new] = number
            known.update(zip(fresh, number.tolist(), strict=True))
            while len(self.words) + len(fresh) > len(self.hashes):
                self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
            self.hashes[len(self.words) : len(self.words) + int(yes.sum())] = hashes[yes]
            self.words += [w for w, y in zip(fresh, yes.tolist(), strict=True) if y]
            self.langs += [lang] * int(yes.sum())
            self.known += len(fresh)
        return out

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        return pa.array(self.words, pa.binary()).cast(pa.string()), pa.array(self.langs, pa.string())

    @property
    def full(self) -> bool:
        return len(self.words) >= (1 << WORD_BITS) - CHUNK // 2 or self.known >= 2 << WORD_BITS


def _runs(spilled, n: int, words: Dictionary):
    """A sorted run (lang, phrase, n) of every subtree."""
    names, langs = words.arrays()
    for codes, counts in spilled:
        numbers = [pa.array(((codes >> np.uint64(WORD_BITS * (2 - k))) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)) for k in range(n)]
        phrase = names.take(numbers[0])
        if n > 1:
            phrase = pc.binary_join_element_wise(phrase, *(names.take(k) for k in numbers[1:]), " ")
        table = pa.table({"lang": langs.take(numbers[0]), "phrase": phrase, "n": pa.array(counts)}).sort_by([("phrase", "ascending"), ("lang", "ascending")])
        yield from table.combine_chunks().to_batches()
        pa.default_memory_pool().release_unused()


def _counted(n: int, filter_: Broadcast | None):
    """Sorted runs of the phrases of n words and their counts in a stream of texts."""

    def has(hashes: np.ndarray) -> np.ndarray:
        if filter_ is None:
            return np.ones(len(hashes), bool)
        bit = hashes & np.uint64((1 << FILTER_BITS) - 1)
        return (filter_.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0

    anything = lambda hashes: np.ones(len(hashes), bool)

    def run(batches):
        trie, words = HatTrie(), Dictionary()
        for batch, texts in text_batches(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                if text:
                    by_lang.setdefault("und" if lang is None else lang, []).append(text)
            for lang, of_lang in by_lang.items():
                for data, again in _chunks(of_lang):
                    data = data.lower()
                    starts, ends, piece = cut_words(data)
                    if len(starts) < n:
                        continue
                    hashes = Spans(data).hash(starts, ends)
                    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
                    number = words.of(lang, [data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], has if n == 2 else anything)[which]
                    last = np.arange(max(n - 1, again), len(starts))  # phrases by their last word
                    parts = [number[last - k] for k in range(n - 1, -1, -1)]
                    ok = (piece[last] == piece[last - (n - 1)]) & (np.min(parts, axis=0) >= 0)
                    if n > 2:
                        columns = np.stack([words.hashes[p] for p in parts], axis=1)
                        ok &= has(_phrase_hash(columns[:, :-1])) & has(_phrase_hash(columns[:, 1:]))
                    code = np.zeros(int(ok.sum()), np.uint64)
                    for k, p in enumerate(parts):
                        code |= p[ok].astype(np.uint64) << np.uint64(WORD_BITS * (2 - k))
                    trie.add(code)
                    if trie.n > MOST_CODES:
                        yield from _runs(trie.spill(MOST_CODES // 2), n, words)
                    if words.full:
                        yield from _runs(trie.spill(), n, words)
                        words = Dictionary()
        yield from _runs(trie.spill(), n, words)

    return run


def _merge(batches):
    """Sums of a stream sorted by phrase and lang."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        lang, phrase, n = table.column("lang"), table.column("phrase"), table.column("n").to_numpy()
        differ = pc.or_(pc.not_equal(phrase[1:], phrase[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy()
        start = np.flatnonzero(np.concatenate(([True], differ)))
        rows = table.take(pa.array(start)).set_column(2, "n", pa.array(np.add.reduceat(n, start)))
        out = rows.combine_chunks().to_batches()[0]
        yield out.slice(0, len(start) - 1)
        held = out.slice(len(start) - 1)
    if held is not None:
        yield held


def phrase_counts(docs: DataFrame, n: int, filter_: Broadcast | None = None, least: int = 1) -> DataFrame:
    """lang, phrase, n: the phrases of n words (joined by a space) that occur so often and whose parts of n - 1 words pass the filter."""
    slim = docs.selectExpr("cast(lang as string) lang", "cast(text as string) text")
    runs = keep(slim.mapInArrow(_counted(n, filter_), "lang string, phrase string, n long"), "runs")
    spread = runs.repartitionByRange("phrase", "lang").sortWithinPartitions("phrase", "lang")  # Spark's sort sees the first bytes of the first column
    merged = keep(spread.mapInArrow(_merge, "lang string, phrase string, n long").where(F.col("n") >= least), "phrases")
    drop(runs)
    return merged


def frequent_bits(phrases: DataFrame) -> np.ndarray:
    """The bit map of the phrases; the driver gets a number for each of its 64-bit words that is not zero, 2**(FILTER_BITS - 6) at most."""

    def run(batches):
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                h = np.array([_hash(lang, phrase.encode().split(b" "))], np.uint64)
                hashes.append(int(_phrase_hash(h)[0]) & ((1 << FILTER_BITS) - 1))
            bits = np.array(hashes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], names=["at", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


_SCORE = "1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0)))"


def collocations(docs: DataFrame, least: int = 10, within_percent: int = 50, top: int = 2000, per_group: int = 100_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two and three words of each language."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    words = phrase_counts(docs, 1)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    enough = F.col("n") >= least
    one = words.where(enough).select("lang", "phrase", F.col("n").alias("a"))
    map1 = send(frequent_bits(one))
    two = phrase_counts(docs, 2, map1, least).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    map2 = send(frequent_bits(two))
    three = phrase_counts(docs, 3, map2, least).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    map1.unpersist()
    map2.unpersist()

    def count_of(table: DataFrame, part: str, name: str) -> DataFrame:
        return table.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))

    pairs = two.select("*", F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2"))
    pairs = pairs.join(count_of(one, "w1", "l"), ["lang", "w1"]).join(count_of(one, "w2", "r"), ["lang", "w2"])
    pairs = pairs.withColumn("score", F.expr(_SCORE.format(l="l", r="r")))
    parts = three.select("lang", "a", F.explode(F.array(*(F.concat_ws(" ", F.slice("w", k, 2)) for k in (1, 2)))).alias("phrase"))
    longest = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    pairs = pairs.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within_percent * F.col("a")))
    triples = three.select("*", *(F.concat_ws(" ", F.slice("w", s, n)).alias(c) for c, s, n in (("p1", 1, 1), ("p2", 2, 2), ("q1", 1, 2), ("q2", 3, 1))))
    triples = triples.join(count_of(one, "p1", "l1"), ["lang", "p1"]).join(count_of(two, "p2", "r1"), ["lang", "p2"]).join(count_of(two, "q1", "l2"), ["lang", "q1"]).join(count_of(one, "q2", "r2"), ["lang", "q2"])
    triples = triples.withColumn("s1", F.expr(_SCORE.format(l="l1", r="r1"))).withColumn("s2", F.expr(_SCORE.format(l="l2", r="r2")))
    first = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", "phrase", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    scored = keep(pairs.select("lang", "phrase", "a", "l", "r", "score").unionAll(triples), "scored")
    order = (F.desc("score"), F.desc("a"), "phrase")
    groups = -(-scored.count() // per_group)
    if groups > 1:  # a language's best are among the best of its parts
        part = F.pmod(F.xxhash64("phrase"), F.lit(groups)).alias("part")
        scored = scored.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Conversation trie, collocations and shards against brute force on small fixtures with every edge in them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from finlattice.llm import collocations as C
from finlattice.llm import sharding as S
from finlattice.llm import trie as T

# ---- trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in sorted(made.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = {}
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(1 for r in members if len(r) == len(q) + 1 and r[: len(q)] == q)
        ends = ",".join(str(c) for c in cs if len(made[c]) == len(p))
        out[(min(cs), len(p))] = (min(members[p[:-1]]) if p else None, len(cs), kids(p), sum(kids(q) == 0 for q in below), sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest())
    return out


def got_trie(spark, rows, shards=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as ids", "'x' as key", "2 as depth")
    out = T.prefix_trie(T.rebuilt(df), *([shards] if shards else []))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = out.collect()
    assert len({(r.conv_id, r.depth) for r in found}) == len(found)
    return {(r.conv_id, r.depth): tuple(r)[2:] for r in found}


def conversations(seed, n, long=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        turns = rng.randrange(1, 7)
        hot = rng.random() < 0.3
        for t in range(turns):
            rows.append((c, t, "user" if t % 2 == 0 else None, "hello ü" if hot or t == 0 else rng.choice(["a", "bb", "", None, "ccc"])))
    for c in range(n, n + long):  # alike over several blocks of columns
        rows += [(c, t, "user", f"t{t}" if t < 75 or c % 2 else f"other {c}") for t in range(80 + c % 3)]
    rows += [(None, 1, "user", "lost"), (n + 50, None, "user", "first"), (n + 50, 0, "user", "second"), (n + 50, 0, "user", "second")]
    return rows


@pytest.mark.parametrize("seed, n, long, size", [(1, 120, 6, 40), (2, 60, 0, 500_000), (3, 40, 8, 5), (4, 1, 0, 1)])
def test_trie_by_brute_force(spark, seed, n, long, size):
    rows = conversations(seed, n, long)
    assert got_trie(spark, rows, size) == brute_trie(rows)


def test_trie_of_one_hot_conversation(spark):
    """A third of all conversations are equal, and all begin alike: their nodes are in every shard."""
    rows = [(c, t, "user", f"same {t}" if c % 3 == 0 or t == 0 else f"{c} {t}") for c in range(90) for t in range(4)]
    assert got_trie(spark, rows, 10) == brute_trie(rows)


def test_trie_without_conversations(spark):
    assert got_trie(spark, [(None, 1, "user", "x")]) == {}


def test_ordering_is_lexicographic():
    rng = random.Random(3)
    seqs = [tuple(rng.randrange(2) for _ in range(rng.choice([0, 1, 2, 31, 32, 33, 64, 65, 90]))) for _ in range(300)] + [(1,) * 70, (1,) * 70, (1,) * 71]
    conv = np.array(rng.sample(range(1000), len(seqs)))
    length = np.array([len(s) for s in seqs])
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    flat = np.array([x for s in seqs for x in s] + [0])
    order = T._ordered(flat, flat * 7, first, length, conv)
    assert [(seqs[i], conv[i]) for i in order] == sorted(zip(seqs, conv.tolist(), strict=True))


# ---- collocations


def brute_phrases(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def phrase_rows(seed, n):
    rng = random.Random(seed)
    words = "the of and New York über naïve 日本 x x x a\x00b   don't".split(" ")
    rows = []
    for k in range(n):
        ws = rng.choices(words, k=rng.randrange(0, 30))
        rows.append((rng.choice(["en", "de", None, "und", ""]), "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for w in ws)))
    return rows + [("en", None), (None, ""), ("fr", " \t "), ("en", "x " * 500), ("en", "x " * 500), ("xx", "once")]


@pytest.mark.parametrize("top, group", [(2000, 100_000), (7, 5)])
def test_collocations_by_brute_force(spark, top, group):
    rows = phrase_rows(5, 300)
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, n long, phrase string")
    out = sorted(map(tuple, C.collocations(df, top=top, per_group=group).collect()))
    assert out == brute_phrases(rows, top=top) and len(out) > 20


def test_collocations_of_nothing(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("chunk, burst, most", [(64, 8, 60), (1, 4, 20), (1 << 20, 1 << 16, 10**6)])
def test_runs_of_tries_that_burst_and_spill(monkeypatch, n, chunk, burst, most):
    """The runs are sorted and add up to the counts, whatever was cut, burst and spilled; one bit of the map lets all through."""
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "BURST", burst)
    monkeypatch.setattr(C, "MOST_CODES", most)
    rows = phrase_rows(6, 80)
    batch = pa.record_batch({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]}, schema=pa.schema([("lang", pa.string()), ("text", pa.string())]))
    everything = SimpleNamespace(value=np.full(1 << (C.FILTER_BITS - 6), np.uint64((1 << 64) - 1)))
    got, runs = Counter(), 0
    for run in C._counted(n, everything if n > 1 else None)([batch, batch]):
        keys = list(zip(run["lang"].to_pylist(), [p.encode() for p in run["phrase"].to_pylist()], strict=True))
        assert keys == sorted(set(keys), key=lambda k: k[::-1])
        runs += 1
        for k, c in zip(keys, run["n"].to_pylist(), strict=True):
            got[k] += c
    want = Counter()
    for lang, text in rows * 2:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            want.update(("und" if lang is None else lang, " ".join(ws[i : i + n]).encode()) for i in range(len(ws) - n + 1))
    assert got == want and (runs > 3 or most > 1000)


def test_containers_count_exactly():
    rng = np.random.default_rng(1)
    trie, want = C.HatTrie(), Counter()
    for _ in range(40):
        codes = rng.integers(0, 1 << 16, 9000).astype(np.uint64) << np.uint64(40)
        trie.add(codes)
        want.update(codes.tolist())
    codes, counts = trie.root.items()
    assert trie.n == len(codes) == len(want) and dict(zip(codes.tolist(), counts.tolist(), strict=True)) == want


# ---- shards


def brute_shards(rows, n_shards):
    """Sizes and order by the stated rules, one record after the other."""
    sized = []
    for doc_id, text in rows:
        data = (text or "").encode()
        key = int(hashlib.md5(data).hexdigest()[:9] + hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:6], 16)
        sized.append((len(data) + 8, key, -1 if doc_id is None else doc_id, zlib.crc32(data)))
    total = sum(s[0] for s in sized)
    least = total // (n_shards * S.LARGE)
    large = sorted((s for s in sized if s[0] > least), key=lambda s: (-s[0], *s[1:3]))
    load, placed = [0] * n_shards, defaultdict(list)
    for s in large:
        i = min(range(n_shards), key=lambda k: (load[k], k))
        load[i] += s[0]
        placed[i].append(s)
    ends, end = [], 0
    for room in S.capacities(total, load)[:-1]:
        end += room
        ends.append(2 * end)
    light, at = defaultdict(list), 0
    for s in sorted((s for s in sized if s[0] <= least), key=lambda s: s[1:3]):
        light[sum(e <= 2 * at + s[0] for e in ends)].append(s)
        at += s[0]
    return Counter((None if s[2] < 0 else s[2], s[0], s[3], i, k) for i in range(n_shards) for k, s in enumerate(light[i] + placed[i]))


def got_shards(spark, rows, n_shards):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, shard int, size int, key string").repartition(5)
    out = S.document_shards(df, n_shards)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = out.collect()
    assert {(r.law, r.grown_shard) for r in found} <= {("bytes", None)}
    return found


@pytest.mark.parametrize("n_shards", [1, 7, 24])
def test_shards_by_brute_force(spark, n_shards):
    rng = random.Random(8)
    rows = [(i, "w" * rng.randrange(0, 300)) for i in range(1500)] + [(2000 + i, "the same text in a third of all rows") for i in range(900)]
    rows += [(None, "none"), (None, None), (5, None), (6, ""), (7, "é" * 9000), (8, "z" * 200_000), (9, "same row"), (9, "same row"), (10, "日本")]
    found = got_shards(spark, rows, n_shards)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found) == brute_shards(rows, n_shards)


def test_shards_are_near_equal(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["tiny", "copy " * 50, "w" * rng.randrange(2000)])) for i in range(6000)]
    load = Counter()
    for r in got_shards(spark, rows, 24):
        load[r.shard] += r.size
    assert len(load) == 24 and max(load.values()) - min(load.values()) <= 2 * 2008


def test_more_shards_than_records_and_none(spark):
    assert len({r.shard for r in got_shards(spark, [(1, "a"), (2, "b")], 24)}) == 2
    assert got_shards(spark, [], 24) == []


def test_overfull_ranges_are_cut(spark, monkeypatch):
    """One identifier and text in most rows: a single key, cut by row number; ranges of many keys are cut by their own quantiles."""
    monkeypatch.setattr(S, "ROWS", 50)
    monkeypatch.setattr(S, "RANGES", 1)
    rows = [(1, "again and again")] * 1200 + [(i, f"t{i}") for i in range(800)]
    found = got_shards(spark, rows, 4)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found) == brute_shards(rows, 4)


def test_capacities_fill_to_one_level():
    rng = random.Random(1)
    for _ in range(300):
        taken = [rng.choice([0, 5, 90, 400]) for _ in range(rng.randrange(1, 9))]
        total = sum(taken) + rng.randrange(500)
        room = S.capacities(total, taken)
        assert sum(room) + sum(taken) == total and min(room) >= 0
        filled = [t + r for t, r in zip(taken, room, strict=True) if r]
        assert not filled or max(filled) - min(filled) <= 1


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    S.write_shards(df, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    assert sorted((r.shard, r.slot) for r in back.collect()) == sorted((r.shard, r.slot) for r in S.document_shards(df, 4).collect())
    for shard in range(4):
        slots = [r.slot for r in spark.read.parquet(str(tmp_path / "shards" / f"shard={shard}")).collect()]
        assert slots == list(range(len(slots)))
    with pytest.raises(ValueError, match="slot"):
        S.shard(df.selectExpr("*", "1 as slot", "8 as size", "1 as key"), 4)

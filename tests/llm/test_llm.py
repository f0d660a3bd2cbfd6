"""The training-data operators against SQL, brute force, round trips and edge cases on small fixtures."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import rows_of_spark, rows_of_sql

from finlattice.llm._tables import bounded, keep
from finlattice.llm import bpe, components, html, jaccard, language, licenses, packing, quality, queries, repeats, vectors, warc

CLASHING = "row long, n long, length long, chunk int, component long, kept boolean, score double, keys string, digest string, label_ string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(100)}" for _ in range(n))


def edge_texts():
    """Nulls, empties, white space, ties, repeated rows, near copies, shared passages, one very long text."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split()
    near[-1] = "changed"
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "One"), (8, "one"), (9, "one two"), (None, base), (10, "a\nb\na\n\n\na b c a b c"),
        (11, prose(3, 70) + " " + passage + " " + prose(4, 30)), (12, prose(5, 20) + " " + passage + " tail"), (13, "x " * 300), (14, prose(6, 12_000)), (15, "Übung, ça va? 日本語 テスト 123 ½ 😀 <|endoftext|>"),
        (16, "Licensed under the MIT License. Apache License, Version 2.0. CC BY-NC 4.0 under the mit license"), (17, "z" * 70_000), (18, prose(7, 80) + "\x00end"), (19, prose(9, 90)), (19, prose(9, 90)),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 5 == 0 else ("en", "de")[k % 2], None, None, k, 1, 2, 3, 4, True, 0.5, "k", "d", None) for k, (i, t) in enumerate(edge_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def by_id(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    names, rows = rows_of_spark(queries.queries()[name](spark, sf))
    expected_names, expected = rows_of_sql(queries.oracle_sql()[name], sf)
    assert names == expected_names and rows == expected


@pytest.mark.parametrize("operator", [quality.quality, licenses.scan, jaccard.join, repeats.summary, language.identify, lambda d: packing.pack(packing.pieces(d, public_tokenizers.path("word_bpe_49k.json")))])
def test_empty_tables(empty, operator):
    assert operator(empty).count() == 0


def test_quality_edges(docs):
    out = by_id(quality.quality(docs))
    assert sum(map(len, out.values())) == len(edge_texts())
    assert (out[4][0].n_words, out[4][0].base_failed, out[4][0].kept) == (0, True, False)
    assert out[10][0].n_dup_lines == 1 and out[10][0].n_repeat_words == 6
    assert out[1][0].kept and not out[13][0].kept
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r[0].kept}


def test_quality_coverage_by_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        words = [rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.randrange(60, 90))]
        got = quality.measure(" ".join(words).encode(), quality.QualityRules())
        for n, found in ((3, got[4]), (5, got[8][0])):
            grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
            seen = Counter(grams)
            inside = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(n)}
            if n == 3:
                assert found == len(inside)
            elif got[4] >= 5:
                assert found == sum(len(words[k]) for k in inside)


def test_each_quality_rule_decides():
    rules = quality.QualityRules()
    failed = lambda text, **own: quality.measure(text.encode(), quality.QualityRules(**own))[10].split(",")
    assert failed(prose(800, 400)) == [""]
    # a passage of n words twice in 100 words: its share is over the limit of this length only where longer ones are not repeated
    for width, most in zip(rules.gram_lengths, rules.most_gram_chars, strict=True):
        passages = [prose(810 + k, width) for k in range(4)]
        text = " ".join(w for k, p in enumerate(passages) for w in (prose(820 + k, 9), p, prose(830 + k, 9), p))
        assert [f for f in failed(text) if f"{width}" in f] == [f"gram{width}"] and not {f"gram{w}" for w in rules.gram_lengths if w > width} & set(failed(text))
    tenth = prose(850, 10)
    third = " ".join(f"{tenth} {prose(860 + k, 23)}" for k in range(4))  # 30 % in one n-gram of 10 words
    assert "gram10" in failed(third) and quality.measure(third.encode(), rules)[5:7] == (False, False)
    lines = "\n".join([prose(870, 6)] * 3 + [prose(880 + k, 6) for k in range(6)])  # a third of the lines are one
    assert "line_chars" in failed(lines) and quality.measure(lines.encode(), rules)[5:7] == (False, False)
    assert failed("\n".join(["short line"] * 4 + [prose(900 + k, 12) for k in range(5)])) == ["lines"]
    pair = " ".join(f"often enough {prose(910 + k, 5)}" for k in range(20))
    assert failed(pair) == ["top2"] and not quality.measure(pair.encode(), rules)[6]
    assert failed("# $ % & " * 20, most_symbols=30)[-1] == "symbols" and "symbols" not in failed("# $ % & " * 20)
    with pytest.raises(ValueError):
        quality.QualityRules(gram_lengths=(2,), most_gram_chars=(1,))


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = [*base, *(base[:20] + 0.05 * rng.normal(size=(20, 16))), base[0] * 3]
    rows = [(k, [float(v) for v in row], k % 2, "x") for k, row in enumerate(x)]
    rows[41] = (41, rows[41][1], None, "x")
    rows += [(100, None, 0, None), (101, [0.0] * 16, 0, None), (102, [float("nan")] * 16, 0, None), (103, [1.0, None] * 8, 0, None), (None, rows[0][1], 0, None), (104, rows[2][1], 0, None), (105, [], 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, own string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, block=7).collect()}
    good = [(i, np.array(e, np.float32).astype(float), label) for i, e, label, _ in rows if i is not None and label is not None and e and None not in e and np.isfinite(np.array(e, float)).all() and any(e)]
    links = {(i, j) for i, a, p in good for j, b, q in good if i != j and p == q and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93}
    for i, *_ in rows:
        near, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {b for a, b in links if a == k} - near
            near |= new
            todo += new
        low = None if i is None else min(near)
        assert got[i] == (len({b for a, b in links if a == i}), low, i is None or low == i)
    assert len(links) > 20
    assert vectors.near_duplicates(df.where("1 = 0")).count() == 0


def test_repeated_vector_ids_and_near_blocks(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.1, 0.0], 0), (3, [0.0, 1.0, 0.1], 0), (4, [0.1, 1.0, 0.0], 0), (5, [0.0, 1.0, 0.0], 0), (6, [1e200, 1e199, 0.0], 0), (7, [0.0, 1.0], 0)]
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=2).collect()
    assert sorted(map(tuple, out)) == [(1, 2, 1, True), (1, 3, 1, True), (2, 2, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 3, 1, False), (6, 2, 1, False), (7, 0, 7, True)]
    # clusters far apart: most pairs of blocks are left out before any vector is sent, and no link is lost
    rng = np.random.default_rng(4)
    centres = np.eye(8)[rng.integers(0, 8, 400)] + 0.03 * rng.normal(size=(400, 8))
    df = spark.createDataFrame([(k, [float(v) for v in c], 0) for k, c in enumerate(centres)], "vec_id long, embedding array<float>, label int")
    valid = vectors.valid(df)
    turn = spark.sparkContext.broadcast(vectors.axes(valid))
    classes = valid.selectExpr("vec_id cid", "label", "dims", "vector", "1L copies")
    blocks, pairs = vectors.tile_pairs(vectors._dealt(vectors._with_lead(classes, turn), 20), 0.93)
    n = blocks.count()
    assert n >= 20 and pairs.where("bid = bi").count() < 0.6 * n * (n + 1) / 2, (n, pairs.where("bid = bi").count())
    unit = centres.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.93).sum(axis=1) - 1).tolist()
    assert [r.n_links for r in vectors.near_duplicates(df, block=20).orderBy("vec_id").collect()] == want


def test_warc_round_trip(spark):
    big = "<p>" + "ü\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (3, None, big), (4, "u", None), (5, "u\r\nX: y", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", "null id"), (8, "u", "y" * 5000 + "\n\n"), (9, "u", "e" * 999), (10, "u", "e" * 999)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, row int, size string")
    for chunk in (262_144, 300, 7):
        path = warc.new_path(spark, "warc")
        warc.write(warc.records(df, 1000, chunk), path)
        read = warc.read(spark, path)
        assert max(len(r.text.encode()) for r in read.select("text").collect()) <= chunk
        out = by_id(warc.payloads(read), "page_id")
        assert sum(map(len, out.values())) == len(rows)
        for i, _, text in rows:
            raw = (text or "").encode()
            for r in out[i]:
                assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert [(r.record_type, r.refers_to) for r in out[1] + out[2]] == [("revisit", 3)] * 2
        assert sorted(r.record_type for r in out[3]) == ["response", "revisit"]
        assert {r.record_type for i in (4, 5, 6, 7, 8, 9, 10) for r in out[i]} == {"response"}
    assert warc.round_trip(df.where("1 = 0")).count() == 0


def test_warc_of_another_writer(spark, tmp_path):
    import gzip

    block = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz"
    head = lambda kind, n, more="": f"WARC/1.1\r\nwarc-type: {kind}\r\nWARC-Record-ID: <{kind}>\r\n{more}Content-Length: {n}\r\n\r\n"
    parts = [head("warcinfo", 2) + "hi\r\n\r\n", head("response", len(block), "WARC-Target-URI: http://x/\r\n") + block + "\r\n\r\n", head("request", 1) + "r\r\n\r\n", head("resource", 0) + "\r\n\r\n", head("response", 99) + "cut off"]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p.encode()) for p in parts))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress((head("response", 4) + "next\r\n\r\n").encode()))
    got = sorted((r.record_type, r.text, r.url) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == sorted([("response", block, "http://x/"), ("resource", "", None), ("response", "next", None)], key=lambda r: (r[0], r[1]))
    assert {r.payload_digest for r in warc.payloads(warc.read(spark, str(tmp_path))).collect()} == {hashlib.sha1(t.encode()).hexdigest() for t in (block, "", "next")}


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids} | ({None: (len(sets[None]), None)} if None in sets else {})


def chained(seed):
    """Chains of texts, each near the next one alone, with ids in any order."""
    rng = random.Random(seed)
    rows, ids = [], rng.sample(range(1000), 160)
    for k in range(16):
        words = prose(7000 + 31 * seed + k, 160).split()
        for _ in range(10):
            words[rng.randrange(160)] = f"new{rng.randrange(10**6)}"
            words[rng.randrange(160)] = f"new{rng.randrange(10**6)}"
            rows.append((ids.pop(), " ".join(words)))
    return rows


def test_jaccard_counts_before_it_probes(spark, monkeypatch):
    """Every pair that is probed, in either round, comes with all its occurrences in short lists, and both rounds find links."""
    rows = chained(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 3, 90)
    probed, probe, candidates = [], jaccard.probe, jaccard._candidates
    monkeypatch.setattr(jaccard, "probe", lambda docs, pairs, *a: probed.append([tuple(r) for r in pairs.select("u", "v", "shared").collect()]) or probe(docs, pairs, *a))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, 3, 90).collect()} == want
    levels = spark.sparkContext.broadcast(jaccard.word_levels(df))
    short = {r.doc_id: set(r.short) for r in jaccard.shingle_table(df, 3, 90, levels).collect()}
    assert len(probed) == 2 and all(len(p) > 5 for p in probed)
    assert all(shared == len(short[u] & short[v]) for pairs in probed for u, v, shared in pairs)
    # without the search among components the result is another one
    monkeypatch.setattr(jaccard, "_candidates", lambda placed, *a: candidates(placed, *a).where("1 = 0"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, 3, 90).collect()} != want
    # and nothing is found where nothing is counted
    monkeypatch.setattr(jaccard, "_counted", lambda pairs, *a: pairs.selectExpr("u", "v", "0L shared").where("1 = 0"))
    assert all(r.component_id == r.doc_id for r in jaccard.join(df, 3, 90).collect())


def test_later_rounds_of_jaccard_read_long_lists_only(spark, monkeypatch):
    rows = chained(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tags, read, keep, list_rows = [], [], jaccard.keep, jaccard._list_rows
    monkeypatch.setattr(jaccard, "_LONG", 1)
    monkeypatch.setattr(jaccard, "keep", lambda kept, tag: tags.append(tag) or keep(kept, tag))
    monkeypatch.setattr(jaccard, "_list_rows", lambda lists_of: read.append(1) or list_rows(lists_of))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, 3, 90).collect()} == brute_components(rows, 3, 90)
    assert tags.count("met") >= 2 and len(read) == 4  # for the first round, for the lists of several components, for the long ones and for the search among components


def test_a_task_of_jaccard_sums_a_pair_over_its_lists(monkeypatch):
    """Near copies that meet in many lists leave a task as one row with all their occurrences, however often rows are summed."""
    sketch = jaccard.sketch(np.arange(1000, dtype=np.uint64))
    rows = [(b"%03d" % k, doc, 1000, 0, False, sketch, doc) for k in range(60) for doc in range(1, 6)]
    names = ["list", "doc_id", "n", "own", "tiled", "sketch", "component"]
    batches = lambda: pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names).to_batches(max_chunksize=37)
    for together in (1 << 18, 100, 7):
        monkeypatch.setattr(jaccard, "_PAIRS_TOGETHER", together)
        found = [tuple(r.values()) for batch in jaccard._merged(80)(batches()) for r in batch.to_pylist()]
        shared = {}
        for u, v, nu, nv, n in found:
            assert (nu, nv) == (1000, 1000)
            shared[u, v] = shared.get((u, v), 0) + n
        assert shared == {(u, v): 60 for u in range(1, 6) for v in range(u + 1, 6)}
        assert together == 7 or len(found) == 10


def test_lists_of_one_smallest_document_meet_in_a_task(spark, monkeypatch):
    sketch = jaccard.sketch(np.arange(100, dtype=np.uint64))
    rows = [(doc, 100, bytearray(sketch), list(range(40 * (doc // 3), 40 * (doc // 3) + 40)), doc) for doc in range(30)]
    placed = spark.createDataFrame(rows, "doc_id long, n long, sketch binary, lists array<long>, component long")
    made, merged = spark.sparkContext.accumulator(0), jaccard._merged

    def counted(percent):
        run = merged(percent)

        def rows_of(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return rows_of

    monkeypatch.setattr(jaccard, "_merged", counted)
    got = jaccard._candidates(placed, jaccard._several(jaccard._list_rows(placed)), 80, 4096).collect()
    assert {(r.u, r.v): r.shared for r in got} == {(u, v): 40 for u in range(30) for v in range(u + 1, 30) if u // 3 == v // 3}
    assert made.value == len(got)


@pytest.mark.parametrize("width,percent,tile", [(3, 90, 4096), (5, 80, 3)])
def test_jaccard_by_brute_force(spark, docs, width, percent, tile):
    rng = random.Random(9)
    rows = list(edge_texts())
    for k in range(12):  # families of near copies around the threshold
        words = prose(100 + k % 4, 80).split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        rows.append((200 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, width, percent, tile).collect()}
    assert got == brute_components(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, width, percent, tile).collect()} == brute_components(edge_texts(), width, percent)


def test_sketch_is_a_bound():
    rng = np.random.default_rng(3)
    for n, m in ((10, 12), (600, 650), (3000, 3300), (500, 530)):
        pool = rng.integers(0, 2**63, 2 * m).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 10 : n // 10 + m])
        s = np.frombuffer(jaccard.sketch(a) + jaccard.sketch(b), np.uint64).reshape(2, -1)
        assert jaccard._differ(s, np.array([0]), np.array([1]))[0] <= len(np.setxor1d(a, b))


def test_short_lists_hold_every_partner():
    rng = np.random.default_rng(8)
    for percent in (80, 90):
        for _ in range(300):
            n = int(rng.integers(1, 300))
            pool = np.arange(2 * n)  # numbers stand for shingles in the order of all documents
            x = np.sort(rng.choice(pool, n, replace=False))
            y = np.sort(np.unique(np.concatenate((rng.choice(x, max(1, n - int(rng.integers(0, 1 + n // 8))), replace=False), rng.choice(pool, int(rng.integers(0, 1 + n // 8)))))))
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                short_x, short_y = x[: jaccard.n_short(len(x), percent)], y[: jaccard.n_short(len(y), percent)]
                shared = len(np.intersect1d(short_x, short_y))
                assert shared >= min(jaccard.hits(len(x), percent), jaccard.hits(len(y), percent))
                query, other, k = (x, y, len(short_x)) if short_x[-1] <= short_y[-1] else (y, x, len(short_y))
                assert shared + len(np.intersect1d(query[k:], other)) == both


def test_very_long_near_copies_send_little(spark):
    words = prose(5000, 150_000).split()
    other = words[:]
    for k in range(0, 150_000, 5000):
        other[k] = "changed"
    df = spark.createDataFrame([(7, " ".join(words)), (9, " ".join(other)), (11, prose(5001, 100_000))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(df).collect()}
    assert got == {7: 7, 9: 7, 11: 11}
    levels = spark.sparkContext.broadcast(jaccard.word_levels(df))
    table = jaccard.shingle_table(df, 3, 90, levels).collect()
    # bytes of list rows: token, id, size and sketch for each short list
    assert sum(len(r.short) * (24 + len(r.sketch)) for r in table) < 10 << 20


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1, 1), (None, 2)] + [(500 + k, 501 + k) for k in range(60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {i: find(i) for i in root if find(i) != i} == {i: c for i, c in got.items() if i != c}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    # the rounds of more edges than one lot
    chain = spark.range(3000).selectExpr("id + 1 as u", "id as v").repartition(7)
    steps, n = chain.mapInArrow(components._contract, "u long, v long").distinct(), 0
    while not components._is_stars(steps):
        steps, n = keep(components._step(steps), "edges"), n + 1
    assert n and {(r.u, r.v) for r in steps.collect()} == {(k, 0) for k in range(1, 3001)}


def test_license_rules(docs):
    out = by_id(licenses.scan(docs))
    r = out[16][0]
    assert (r.n_base, r.base_labels, r.first_word) == (4, "apache-2,cc-by-nc,mit", 1)
    assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert (out[4][0].n_words, out[4][0].labels, out[4][0].first_word) == (0, "", None)
    assert out[1][0].labels == ""
    assert len(licenses.rules()) > 200
    scan = lambda t: licenses.scan_text(t.encode())[5]
    assert scan("This work is licensed under the GNU General Public License, version 3 or later") == "gpl-3-or-later"
    assert scan("released under the BSD 3-Clause License") == "bsd-3-clause"
    assert scan("permission is hereby granted, free of charge, to any person obtaining a copy") == "mit"


def test_license_tags_and_notices_of_every_family():
    scan = lambda t: licenses.scan_text(t.encode())[5]
    tags = (
        "MIT mit, Apache-2.0 apache-2, BSD-2-Clause bsd-2-clause, BSD-3-Clause bsd-3-clause, BSD-4-Clause bsd-4-clause, ISC isc, Zlib zlib, BSL-1.0 bsl-1, OFL-1.1 ofl-1.1, Artistic-2.0 artistic-2, PostgreSQL postgresql, "
        "GPL-2.0-only gpl-2, GPL-3.0-or-later gpl-3-or-later, LGPL-2.1 lgpl-2.1, AGPL-3.0-only agpl-3, GFDL-1.3 gfdl-1.3, MPL-2.0 mpl-2, EPL-2.0 epl-2, CDDL-1.0 cddl-1, CPL-1.0 cpl-1, EUPL-1.2 eupl-1.2, OSL-3.0 osl-3, AFL-3.0 afl-3, "
        "PHP-3.01 php-3.01, ZPL-2.1 zpl-2.1, ODC-By-1.0 odc-by-1, ODbL-1.0 odbl-1, UPL-1.0 upl-1, MS-PL ms-pl, Unlicense unlicense, WTFPL wtfpl, CC0-1.0 cc0, CC-BY-SA-4.0 cc-by-sa-4.0, MIT-0 mit-0, 0BSD 0bsd"
    )
    for tag, label in map(str.split, tags.split(", ")):
        assert (tag, scan(f"// SPDX-License-Identifier: {tag}\nint main")) == (tag, label)
    assert scan("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT AND Apache-2.0") == "apache-2,gpl-2,mit"
    for label, names, versions in licenses._FAMILIES:
        name = names.split("|")[0].replace("licen[cs]e", "license")
        assert scan(f"This is licensed under the {name}.") == label
        for major, minor in (v.split() for v in versions):
            own = f"{label}-{major}" + (f".{minor}" if minor != "0" else "")
            assert {scan(f"licensed under the {name}{v}{major}.{minor} here") for v in (", version ", ", v", " v. ", " ")} == {own}
    assert [scan(f"released under {t} here") for t in ("GPL v2", "GPLv3", "the LGPLv2.1", "GPLv2 or later", "the Apache License, v2")] == ["gpl-2", "gpl-3", "lgpl-2.1", "gpl-2-or-later", "apache-2"]


def sample_of(parts, pick):
    """A text that a parsed pattern matches; pick chooses among ways and counts."""
    from re import _parser as p

    out = ""
    for kind, value in parts:
        if kind is p.LITERAL:
            out += chr(value)
        elif kind is p.IN:
            k, v = value[0]
            out += chr(v) if k is p.LITERAL else "7" if v is p.CATEGORY_DIGIT else "a"
        elif kind is p.ANY:
            out += "m"
        elif kind is p.SUBPATTERN:
            out += sample_of(value[3], pick)
        elif kind is p.BRANCH:
            out += sample_of(pick(value[1]), pick)
        elif kind in (p.MAX_REPEAT, p.MIN_REPEAT):
            out += "".join(sample_of(value[2], pick) for _ in range(max(value[0], pick([0, 1]) if value[1] else 0)))
    return out


def brute_resolve(hits):
    kept = []
    for a, b, rule in sorted(hits, key=lambda h: (h[2].priority, h[0] - h[1], h[0], h[2].label)):
        if not any(x <= a and b <= y for x, y, _ in kept):
            kept.append((a, b, rule))
    return kept


def test_license_signatures_by_brute_force(spark):
    from re import _parser

    rng = random.Random(21)
    assert len(licenses.signatures()) > 200 and len({p for _, _, p in licenses.signatures()}) == len(licenses.signatures())
    samples = []
    for label, kind, pattern in licenses.signatures():
        for pick in (lambda ways: ways[0], rng.choice):
            text = " ".join(sample_of(_parser.parse(pattern), pick).split())
            if pattern.startswith("licen[cs]e mit"):
                text += " copyright"
            samples.append(text)
            padded = f" before {text} after ".encode()
            own = licenses.matches(padded, licenses.rules())  # no prefilter
            found = licenses.detect(padded, licenses.rules(), licenses._prefilter(licenses.rules()))
            assert found == brute_resolve(own) and found, (label, text)
            assert label in {r.label for _, _, r in own}, (label, text)
            if kind == "text":
                assert max(r.relevance for _, _, r in found) >= 0.95
    for _ in range(40):  # several in one text, cut and run together
        words = " ".join(rng.choice(samples) for _ in range(12)).split()
        cut = rng.randrange(len(words))
        padded = f" {' '.join(words[cut:] + words[:cut])} ".encode()
        assert licenses.detect(padded, licenses.rules(), licenses._prefilter(licenses.rules())) == brute_resolve(licenses.matches(padded, licenses.rules()))
    rows = [(k, t) for k, t in enumerate(samples[:60])] + [(1000, "An example, simple reply: it complies and replies. Templates."), (1001, "the mit license " * 30_000)]
    out = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out[1000][0].labels == "" and out[1001][0].n_detections == 30_000
    prefilter = licenses._prefilter(licenses.rules())
    assert not list(prefilter.iter(" an example simple reply complies templates "))


def brute_repeats(rows, least):
    texts = {}
    for i, t in rows:
        if i is not None:
            texts[i] = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}
    places = defaultdict(list)
    for i in sorted(words):
        for k in range(len(words[i]) - least + 1):
            places[tuple(words[i][k : k + least])].append((i, k))
    out = set()
    for i, w in words.items():
        starts = [k for k in range(len(w) - least + 1) if len(places[tuple(w[k : k + least])]) > 1]
        spans = []
        for s in starts:
            if spans and s <= spans[-1][1]:
                spans[-1][1] = s + least
            else:
                spans.append([s, s + least])
        own = {q for k in starts if places[tuple(w[k : k + least])][0] == (i, k) for q in range(k, k + least)}
        other = {q for k in starts if places[tuple(w[k : k + least])][0] != (i, k) for q in range(k, k + least)}
        for a, b in spans:
            first = min([i, *(places[tuple(w[s : s + least])][0][0] for s in starts if a <= s < b)])
            out.add((i, a, b - a, first, len({q for q in other - own if a <= q < b})))
    return out


def test_repeats_by_brute_force(spark, docs):
    rng = random.Random(8)
    passages = [prose(50 + k, rng.randrange(15, 50)) for k in range(6)]
    rows = list(edge_texts()) + [(300 + k, " ".join([prose(400 + k, rng.randrange(40)), *rng.sample(passages, 3), prose(500 + k, 20)])) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least, seed, block in ((50, 16, 4096), (20, 6, 3), (20, 6, 40)):
        got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.cut_words) for r in repeats.summary(df, least, seed, block).collect()}
        assert got == brute_repeats(rows, least)
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns
    left = by_id(cut)
    passage = prose(2, 60)
    assert passage in left[11][0].text and passage not in left[12][0].text and left[12][0].text.endswith(" tail")
    assert 2 not in left and left[4][0].text is None and left[None][0].text == prose(1, 120)


def test_common_words():
    texts = [b"a b c", b"a b cc", b"a b", b"a", b"ab x", b"ab x y", b"ab x y"]
    assert repeats.common_words([t.translate(repeats._SORTABLE) for t in texts]).tolist() == [0, 2, 2, 1, 0, 2, 3]


def test_passage_with_equal_neighbours_is_cut(spark):
    passage = prose(700, 60)
    sides = [("one", "side"), ("east", "south"), ("east", "north"), ("west", "south"), ("low", "high"), ("low", "north"), ("west", "high"), ("west", "north")]
    rows = [(k, f"{prose(710 + k, 30)} {a} {passage} {b} {prose(730 + k, 30)}") for k, (a, b) in enumerate(sides)]
    rows += [(20, f"{prose(750, 20)} {passage} mid {prose(751, 20)} {passage} {prose(752, 20)}"), (21, " ".join(["again"] * 200)), (22, f"{prose(753, 9)} " + " ".join(["again"] * 70))]
    left = {r.doc_id: r.text for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = set(passage.split())
    assert [i for i in sorted(left) if passage in left[i]] == [0]
    assert left[7] == f"{prose(717, 30)} {prose(737, 30)}" and left[20].split() == [w for w in rows[8][1].replace(passage, "").split()]
    assert words <= set(left[0].split()) and left[21] == " ".join(["again"] * 50) + " " * left[21].endswith(" ") and left[22].split() == prose(753, 9).split()


def test_bpe_is_tiktoken(docs, empty):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = edge_texts()[15][1]
    assert len(text) > 50_000 and len(bpe.pieces(bpe.Bpe(path, public_tokenizers.PATTERN), text, 4_096, 512)) > 10
    for chunk, overlap, spread in ((4_096, 512, 131_072), (4_096, 512, 30_000), (300, 100, 1000), (300, 100, 0)):
        out = by_id(bpe.encode_documents(docs, path, public_tokenizers.PATTERN, chunk, overlap, spread))
        assert sum(map(len, out.values())) == len(edge_texts())
        for i, text in edge_texts():
            ids = own.encode_ordinary(text or "")
            for r in out[i]:
                assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    odd = [(1, "a" + "1234567890" * 400 + " then words " * 50), (2, " " * 3000 + "x" + "\n" * 900 + "end"), (3, "é" * 5000 + " 12 345 6789" * 99)]
    for spread in (10**6, 0):
        for i, n in ((r.doc_id, r) for r in bpe.encode_documents(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"), path, public_tokenizers.PATTERN, 300, 100, spread).collect()):
            ids = own.encode_ordinary(odd[i - 1][1])
            assert (n.n_tokens, n.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_kneser_ney_by_brute_force(spark):
    texts = {"en": "the cat sat on the mat and the dog ran off then", "de": "der hund und die katze und der hut"}
    model = language.fit(spark.createDataFrame(list(texts.items()), "lang string, text string")).prepare()
    for k, lang in enumerate(model.langs):
        s = "".join(map(chr, language.letters(texts[lang]).tolist()))
        counts = {4: Counter(s[i : i + 4] for i in range(len(s) - 3))}
        for n in (3, 2, 1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])

        def p(gram, counts=counts):
            lower = p(gram[1:]) if len(gram) > 1 else 1 / 65536
            same = {g: c for g, c in counts[len(gram)].items() if g[:-1] == gram[:-1]}
            if not same:
                return lower
            return max(same.get(gram, 0) - 0.75, 0) / sum(same.values()) + 0.75 * len(same) / sum(same.values()) * lower

        grams = [x + y for x in (" the", "und ", "xyz "[:3], "cat") for y in sorted(set(s))]
        grams = [g[-4:] for g in grams if len(g) >= 4]
        codes = np.array([language.codes(np.array(list(map(ord, g)), np.uint64))[0] for g in grams], np.uint64)
        assert model.log_probability(codes)[:, k] == pytest.approx(np.log([p(g) for g in grams]), abs=1e-4)


def test_language(spark, sf, docs):
    got = language.identify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    edges = by_id(language.identify(docs))
    assert all(edges[i][0].lang_pred == "und" and edges[i][0].score == 0 for i in (4, 5, 6))
    assert sum(map(len, edges.values())) == len(edge_texts()) and all(0 <= r.score <= 1 for rs in edges.values() for r in rs)


def test_language_rejects_junk_of_rare_lengths(spark):
    rng = random.Random(3)
    junk = lambda n: "".join(rng.choice("qxzjkwv bcdfghp") for _ in range(n))
    rows = [(k, prose(900 + k, 60), "en") for k in range(60)] + [(100, junk(9000), None), (101, junk(70), None), (102, prose(990, 3000), None), (103, prose(991, 12), None), (104, junk(500), None)]
    got = {r.doc_id: r.rejected for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {i for i, x in got.items() if x} == {100, 101, 104}


def test_many_languages_and_far_letters(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0x10400, 0x10428)))
    rows = []
    for lang in range(70):  # each writes with six letters of its own choice
        own = rng.sample(letters, 6)
        rows += [(lang * 10 + k, " ".join("".join(rng.choice(own) for _ in range(4)) for _ in range(60)), f"l{lang}") for k in range(8)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert sum(r.lang_pred == want[r.doc_id] for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)
    assert language.letters(chr(0x10400) + "a")[2:3] != language.letters(chr(0x400) + "a")[2:3]


def test_language_rejection_is_calibrated(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(2)
    foreign = [(10**6 + k, " ".join("".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(6)) for _ in range(80)), None) for k in range(20)]
    junk = [(2 * 10**6 + k, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(80)), None) for k in range(20)]
    got = language.identify(docs.unionByName(spark.createDataFrame(foreign + junk, docs.schema))).collect()
    assert all(r.rejected for r in got if r.doc_id >= 10**6)
    held = [r for r in got if r.held_out and r.doc_id < 10**6 and r.lang_pred != "und"]
    assert sum(r.rejected for r in held) <= 0.02 * len(held)


def test_texts_reach_python_in_batches_of_4_mb(spark):
    texts = spark.range(0, 60, 1, 1).selectExpr("id doc_id", "repeat('word and word ', 30000) text")
    bounded(spark)
    sizes = [r.size for r in texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"]) for b in batches), "size long").collect()]
    assert sum(sizes) > 20 << 20 and max(sizes) < 6 << 20


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    out = packing.pack(packing.pieces(docs, path), bucket_rows=8).collect()
    want = []
    for i, t in edge_texts():
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert Counter(tuple(r)[:5] for r in out) == Counter(want)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_vector_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 600, 400)
    for by in ("residual_norm", "dot_product"):
        capacity = packing.Capacity(tokens=1000, pieces=4, cost=300_000, by=by)
        lengths = lengths[lengths**2 <= capacity.cost]
        bins, offsets = packing.best_fit(lengths, capacity)
        for b in np.unique(bins):
            own = lengths[bins == b]
            assert own.sum() <= 1000 and len(own) <= 4 and (own**2).sum() <= 300_000
            assert sorted(offsets[bins == b]) == sorted(np.cumsum(own[np.argsort(offsets[bins == b])]) - own[np.argsort(offsets[bins == b])])
    with pytest.raises(ValueError):
        packing.best_fit(np.array([5000]), packing.Capacity())
    full, _ = packing.best_fit(rng.integers(1, 3000, 3000), packing.Capacity())
    assert full.max() + 1 <= 1.02 * np.ceil(rng.integers(1, 3000, 3000).sum() / 4096) * 1.05


def test_limits_of_attention_profile_bind(spark, docs):
    out = packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048), packing.ATTENTION).toPandas()
    bins = out.groupby("sequence_id")["length"].agg(["sum", "count", lambda x: (x**2).sum()]).to_numpy()
    most = np.array([packing.ATTENTION.tokens, packing.ATTENTION.pieces, packing.ATTENTION.cost])
    assert (bins <= most).all() and (bins[:, 1] == 8).any()  # of pieces
    lengths = np.array([2048] * 6 + [1000] * 6)
    dealt, _ = packing.best_fit(lengths, packing.ATTENTION)
    assert Counter(Counter(zip(dealt.tolist(), lengths.tolist())).values()) == Counter({1: 12})  # two long pieces would do by tokens, not by cost
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2)], "length long, offset long"))


def test_other_vocabularies_are_encoded_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    spec = json.load(open(path))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]  # keeps capitals
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    assert packing.wordwise(path) and not packing.wordwise(str(other))
    texts = ["Some Capital WORDS, here", "", "x Y"]
    own = Tokenizer.from_file(str(other))
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.WordEncoder(str(other)).encode([t.encode() for t in texts])] == [own.encode(t, add_special_tokens=False).ids for t in texts]


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header><a href=/>Site</a></header><nav><ul><li>Home<li>News</ul></nav><div class='cookie-notice'>We use cookies</div>"
    "<article><h1>Title &amp; more {k}</h1><p><b>First   part {k}<br>of it.<p>Second&nbsp;{k}<div class='ad'>Buy {k}</div><ul><li>one {k}<li>two {k}</ul><p>Printed by the house</p><form><input><button>Go</button></form></article>"
    "<section id=comments><article class=comment>Nice {k}</article></section><aside>Side</aside><footer>&copy; x</footer></body></html>"
)


def test_html(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{k}", f"n{k}")) for k in range(20)] + [(100, None, None), (101, "x", ""), (None, "http://h.example/n", "<p>plain<p>page"), (102, "http://other/", PAGE.replace("{k}", "o"))]
    out = by_id(html.extract(spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, row int, site string")), "page_id")
    text = lambda k, end="": f"Title & more {k}\nFirst part {k} of it.\nSecond {k}\none {k}\ntwo {k}{end}"
    assert out[3][0].text == text("n3") and out[3][0].n_removed == 1  # the line that every page of the site repeats
    assert out[102][0].text == text("o", "\nPrinted by the house")
    assert (out[100][0].text, out[100][0].n_chars) == ("", 0) and out[101][0].text == "" and out[None][0].text == "plain\npage"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_style_tree(pages, settings):
    """(site, node) cut and (site, key) cut of pages given as (site, Page), by recursion over one merged tree a site."""
    sites = defaultdict(dict)
    for site, page in pages:
        body = frozenset(c for _, _, c in page.blocks)
        chosen = ([c for _, _, c in page.blocks], page.paths, page)
        if body not in sites[site] or chosen[:2] < sites[site][body][:2]:
            sites[site][body] = chosen
    entropy = lambda counts, b: min(1.0, -sum(n / sum(counts) * np.log(n / sum(counts)) for n in counts) / np.log(b))
    cut, texts = set(), set()
    for site, bodies in sites.items():
        looks, contents, children = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
        for *_, page in bodies.values():
            full = set()
            for box, _, _ in page.blocks:
                while box >= 0:
                    full.add(box)
                    box = page.parents[box]
            for box in full:
                looks[page.paths[box]][page.looks[box]] += 1
                if page.parents[box] >= 0:
                    children[page.paths[page.parents[box]]].add(page.paths[box])
            for path, content in {(page.paths[b], c) for b, _, c in page.blocks}:
                contents[path][content] += 1
                if contents[path][content] > settings.most_share * (len(bodies) + settings.prior):
                    texts.add((site, path, content))

        def branch(node, looks=looks, contents=contents, children=children, n_bodies=len(bodies)):
            counts, styles, b = list(contents[node].values()), list(looks[node].values()), n_bodies + settings.prior
            own = max(np.mean([1 - np.log(n) / np.log(b) for n in counts]), entropy(counts, b)) if counts else 0.0
            look = 1.0 if sum(styles) == 1 else entropy(styles, b)
            s, t, most = own * len(counts) + settings.presentation * look, len(counts) + settings.presentation, own
            for child in children[node]:
                s2, t2, most2 = branch(child)
                s, t, most = s + s2, t + t2, max(most, most2)
            if s / t < settings.least_importance and most < settings.least_importance:
                cut.add((site, node))
            return s, t, most

        branch(0)
    return cut, texts


def test_style_tree_by_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for k in range(160):
        site = f"http://s{k % 4 if k < 120 else 3}.example/{k}"
        links = "".join(f"<li><a>{rng.choice(['Home', 'News', 'About', 'Contact'])}</a></li>" for _ in range(3))
        parts = [f"<p>{prose(3000 + rng.randrange(120), 12)}</p>" for _ in range(rng.randrange(1, 5))]
        rail = rng.choice(["", f"<div class=rail><h4>Read on</h4><ul>{links}</ul></div>", "<div class=rail><h4>Read on</h4></div>"])
        rows.append((k, site, f"<body><div class=top><div><ul>{links}</ul></div></div><div class=text{'' if k % 3 else k}>{''.join(parts)}<p>The house rules apply</p></div>{rail}<div class=end><p>All about us</p></div></body>"))
    settings = html.StyleTreeSettings()
    pages = {k: (url.split("/")[2], html.Page(page)) for k, url, page in rows}
    cut, texts = brute_style_tree(pages.values(), settings)
    out = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    removed = 0
    for k, (site, page) in pages.items():
        want = []
        for box, text, content in page.blocks:
            up, gone = box, (site, page.paths[box], content) in texts
            while up >= 0:
                gone |= (site, page.paths[up]) in cut
                up = page.parents[up]
            removed += gone
            want += [] if gone else [text]
        assert out[k].text == "\n".join(want)
    assert removed > 300 and sum(r.n_removed for r in out.values()) == removed
    assert not any("Home" in r.text or "All about us" in r.text for k, r in out.items() if k >= 120)
    assert all("alpha" in t or len(t) > 40 for r in out.values() for t in r.text.split("\n") if "The house" not in t and t not in ("Home", "News", "About", "Contact", "Read on", "All about us"))


def test_html_of_odd_pages(spark):
    texts = html.blocks
    assert texts("<p>lead</p><article><p>in it</p></article><p>after</p>") == ["lead", "in it", "after"]
    assert texts("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p><div class='side note'>kept</div></article>") == ["Let x=2 be", "kept"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table><select><option>no</select>") == ["a b", "c"]
    assert texts("<p>a <!-- no <p> --> b<script>x='<p>no</p>'</script> c <3 d & e") == ["a b c <3 d & e"]
    assert texts("<p title=\"a>b\">one<p title='x>y' class=ad>no") == ["one"]
    assert texts("<p>open <a href=\"x>two</a> three") == ["open two three"]
    hard = ["<div>" * 10_000 + "deep" + "</div>" * 10_000, "<a href=\"x' >t <b title='y " * 4000, "<b>" * 9000 + "<h1>x</h1>" * 900, "<ul><li>" + "<div>" * 4000 + "<li>x" * 4000, "<!-- " * 9000, "<i>" + "<b>" * 9000 + "</i>" * 9000 + "end", "w " * 300_000]
    began = time.process_time()
    for page in hard:
        texts(page)
    assert time.process_time() - began < 10
    rows = [(k, "http://hard/", page) for k, page in enumerate(hard)] + [(0, "http://hard/", hard[0]), (9, "http://hard/", None)]
    out = by_id(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert [r.text for r in out[0]] == ["deep"] * 2 and out[5][0].text == "end" and out[6][0].n_chars == 599_999


def test_html_copies_are_one_body(spark):
    page = lambda words: "<body><article>" + "".join(f"<p>{words} paragraph {k}" for k in range(4)) + "<p>Printed by the house</article></body>"
    rows = [(k, "http://hot.example/x", page("copied" if k < 70 else f"own{k}")) for k in range(100)] + [(200 + k, "http://small.example/", page(f"small{k}")) for k in range(4)]
    rows += [(300, "http://pair.example/", page("one")), (301, "http://pair.example/", page("two"))]
    out = by_id(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    text = lambda words: "\n".join(f"{words} paragraph {k}" for k in range(4))
    assert {out[k][0].text for k in range(70)} == {text("copied")}
    assert all(out[k][0].text == text(f"own{k}") for k in range(70, 100))
    assert all(out[200 + k][0].text == text(f"small{k}") for k in range(4))
    assert out[300][0].text == text("one") + "\nPrinted by the house"


def test_html_class_words_of_layout():
    texts = html.blocks
    long = "the text of the page " * 9
    for page in (
        '<body class="single right-sidebar"><div class=comments>no</div><p>{}</p>', '<main class="content with-sidebar"><p>{}</p><div class=sidebar>no</div></main>', '<article class="post comments-open"><p>{}</p></article>',
        '<div class="page has-sidebar"><div class=sidebar>no</div><p>{}</p></div>', '<div id="left-side"><p>{}</p></div><div class="ad-box">no</div>', '<div class="has-header"><p>{}</p></div><p class=comment>no</p>',
    ):
        assert texts(page.replace("{}", long)) == [long.strip()]
    card = "<article class=card><p>A card</p></article>"
    assert texts(f"<main><p>{long}</p>{card}</main><p>outside") == [long.strip(), "A card", "outside"]
    assert texts(f"<div><p>{long}</p></div>{card}") == [long.strip(), "A card"]
    assert texts(f"<article><p>short</p></article><section class=comments><p>{long}</p></section>") == ["short"]
    assert texts(f"<main><article><p>short</p></article></main><div><p>{long}</p></div>") == ["short", long.strip()]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf)
    want = {i for i, r in rows.items() if quality.measure((r.text or "").encode(), quality.QualityRules(most_symbols=30))[6]}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == want
    told = stages["language ID"](spark, good, sf)
    assert {r.doc_id for r in told.collect()} <= want
    single = stages["n-gram Jaccard join"](spark, told, sf)
    left = {r.doc_id: r.text for r in told.collect()}
    groups = brute_components(left.items(), 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in groups.items() if c == i}
    cut = stages["suffix-array dedup"](spark, single, sf)
    found = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and all(r.n_chars == len(r.text) for r in found.values())
    once = {r.doc_id: len(r.text.split()) for r in single.collect()}
    removed = defaultdict(int)
    for i, _, _, _, n in brute_repeats([(r.doc_id, r.text) for r in single.collect()], 50):
        removed[i] += n
    assert {i: n - removed[i] for i, n in once.items() if n > removed[i]} == {i: len(r.text.split()) for i, r in found.items()}
    packed = stages["best-fit packing"](spark, cut, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(found)


def test_leads_and_contents_of_an_article_stay(spark):
    page = "<body><div class=teaser>elsewhere</div><article><p class=teaser>The lead words</p><div class='toc widget'>Part one</div><p>Body</p><div class=ad>Buy</div></article></body>"
    assert html.extract(spark.createDataFrame([(1, "http://a.example/1", page)], "page_id long, url string, html string")).first().text == "The lead words\nPart one\nBody"


def test_near_copies_of_a_short_site_stay(spark):
    """Three pages of a host that share all paragraphs but one: many different texts, so no template."""
    rows = [(k, f"http://a.example/{k}", "<body><div>" + "".join(f"<p>{prose(4000 + j, 15)}</p>" for j in range(8)) + f"<p>{prose(k, 15)}</p></div></body>") for k in range(3)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), html.StyleTreeSettings(most_share=1.0)).collect()
    assert all(r.text.count("\n") == 8 and r.n_removed == 0 for r in out)


def test_the_tree_decides_on_templates_without_telling_names(spark):
    """Rails that pages choose from a few links: cut though nothing in their names says so, on every page that has one."""
    rng = random.Random(3)
    rows = []
    for k in range(60):
        links = "".join(f"<li>{w}</li>" for w in rng.sample(["Home", "News", "About", "Contact"], 2)) if k % 2 else ""
        rows.append((k, f"http://b.example/{k}", f"<body><div class=x><p>{prose(k, 30)}</p></div><div class=y><ul>{links}</ul></div></body>"))
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == prose(r.page_id, 30) and r.n_removed == 2 * (r.page_id % 2) and r.n_named == 0 for r in out)

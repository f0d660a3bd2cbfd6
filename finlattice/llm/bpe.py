"""Byte-level BPE: texts are pre-tokenised in overlapping chunks, stitched where boundaries resynchronise, then encoded.

A pre-token depends only on the text from its start on, so two chunks that agree on one boundary agree
on all that follow.  Each chunk's first true boundary is the last one that it shares inside their overlap with the chunk
before it, whose own boundaries are true by then; where they share none (a pre-token longer than the overlap, or numbers
cut in step), the text so far is pre-tokenised on from the last true boundary, or, across tasks, stays one piece to its end.  Pieces are encoded on their own, and a document's digests are carried over its pieces in order.
A text of up to `spread` code points is cut, stitched and encoded in one task; a longer one's chunks are dealt to
many, so neither its ids nor its text is needed at once but where its row is cut.

Defined results: a null or empty text has no tokens (the digests of nothing); null ids and repeated rows
are encoded as rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._tables import keep

_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_OUT_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Bpe:
    """Pre-tokenising, encoding and decoding of text by a rank file and a pattern."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.decimal = [str(i) for i in range(max(table.values()) + 1)]

    def boundaries(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]

    def sure(self, text: str, marks: list[int], least: int, end: int) -> list[int]:
        """The last few boundaries from `least` on and before `end` at which the text before may be cut off: its last pre-tokens stay as they are."""
        high = bisect_left(marks, end)
        out = []
        for i in range(max(1, bisect_left(marks, least), high - _MARKS), high):
            if all(self.pattern.match(text, marks[j], marks[i]).end() == marks[j + 1] for j in range(max(0, i - 4), i)):
                out.append(marks[i])
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), "<u4")

    def decimals(self, ids: np.ndarray) -> bytes:
        return " ".join(map(self.decimal.__getitem__, ids.tolist())).encode()

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


_GUARD = 64  # code points before a chunk's end whose boundaries settle nothing, as the cut may have moved them
_MARKS = 16  # boundaries of a chunk that the next one is compared with


def overlap_marks(bpe: Bpe, text: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk inside its overlaps with the chunk before and with the one after, both counted from their own start."""
    marks = bpe.boundaries(text)
    end = len(text) - _GUARD if len(text) == chunk + overlap else len(text)
    return marks[: bisect_left(marks, min(end, overlap))], [m - chunk for m in bpe.sure(text, marks, chunk, end)]


def pieces(bpe: Bpe, text: str, chunk: int, overlap: int) -> list[str]:
    """The text in pieces that begin at true boundaries."""
    if len(text) <= chunk:
        return [text] if text else []
    starts, before = [0], []
    for at in range(0, len(text), chunk):
        head, tail = overlap_marks(bpe, text[at : at + chunk + overlap], chunk, overlap)
        shared = set(head).intersection(before)
        if at and shared:
            starts.append(at + max(shared))
        elif at:  # its own boundaries prove nothing
            so_far = text[starts[-1] : at + chunk + overlap]
            end = len(so_far) - (_GUARD if at + chunk + overlap < len(text) else 0)
            skip = at + chunk - starts[-1]
            tail = [m - skip for m in bpe.sure(so_far, bpe.boundaries(so_far), skip, end)]
        before = tail
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, chunk: int = 4_096, overlap: int = 512, spread: int = 131_072) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; chunk, overlap and spread in code points."""
    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(cast(text as string), '') text")
    short = slim.where(F.length("text") <= spread).mapInArrow(_encode_whole(ranks, pattern, chunk, overlap), _OUT_DDL)
    return short.unionAll(_encode_long(slim.where(F.length("text") > spread), ranks, pattern, chunk, overlap))


def _encode_whole(ranks: str, pattern: str, chunk: int, overlap: int):
    def run(batches):
        bpe = Bpe(ranks, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()
                for piece in pieces(bpe, text, chunk, overlap):
                    ids = bpe.encode(piece)
                    ids_digest.update((b" " if n and len(ids) else b"") + bpe.decimals(ids))
                    text_digest.update(bpe.decode(ids))
                    n += len(ids)
                rows.append((doc_id, n, ids_digest.hexdigest(), text_digest.hexdigest()))
            if rows:
                yield _batch(rows, _OUT)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _encode_long(long: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    def cut_up(batches):
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("text", pa.string())])
        for batch in batches:
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for at in range(0, len(text), 256 * chunk):
                    yield _batch([(row, doc_id, k // chunk, text[k : k + chunk + overlap]) for k in range(at, min(len(text), at + 256 * chunk), chunk)], schema)

    rows = long.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    chunks = keep(rows.mapInArrow(cut_up, "row long, doc_id long, chunk int, text string"), "chunks")

    def edges(batches):
        """Each chunk's boundaries in its overlaps."""
        bpe = Bpe(ranks, pattern)
        schema = pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))])
        for batch in batches:
            yield _batch([(row, k, *overlap_marks(bpe, text, chunk, overlap)) for row, k, text in zip(*(batch.column(c).to_pylist() for c in ("row", "chunk", "text")), strict=True)], schema)

    marks = chunks.mapInArrow(edges, "row long, chunk int, head array<int>, tail array<int>")
    order = Window.partitionBy("row").orderBy("chunk")
    marks = marks.withColumn("shared", F.array_intersect("head", F.lag("tail").over(order)))
    # the last of the shared boundaries is the best attested one; they are true if all chunks so far share some
    start = F.when(F.col("chunk") == 0, 0).otherwise(F.array_max("shared"))
    marks = marks.withColumn("start", start).withColumn("start", F.when(F.min(F.col("start").isNotNull()).over(order), F.col("start")))
    runs = marks.select("row", "chunk", "start").withColumn("run", F.count("start").over(order)).withColumn("next", F.lead("start").over(order))
    cut = chunks.join(runs, ["row", "chunk"]).select(
        "row", "doc_id", "chunk", "run", F.coalesce("start", F.lit(0)).alias("a"),
        F.when(F.col("next").isNotNull(), F.lit(chunk) + F.col("next")).otherwise(F.lit(chunk)).alias("b"), "text",
    )
    # inside a run of several chunks each gives its own `chunk` code points; only the last runs on to the next run's start
    cut = cut.select("row", "doc_id", "chunk", "run", F.expr("substring(text, a + 1, b - a)").alias("text"))
    return _digest(_encode_runs(cut, ranks, pattern), ranks, pattern)


def _encode_runs(cut: DataFrame, ranks: str, pattern: str) -> DataFrame:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("run", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        bpe = Bpe(ranks, pattern)
        held: list = []

        def flush():
            row, doc_id, number = held[0][:3]
            return _batch([(row, doc_id, number, bpe.encode("".join(h[3] for h in held)).tobytes())], schema)

        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "run", "text")), strict=True):
                if held and (held[0][0], held[0][2]) != (item[0], item[2]):
                    yield flush()
                    held.clear()
                held.append(item)
        if held:
            yield flush()

    dealt = cut.repartition("row", "run").sortWithinPartitions("row", "run", "chunk")
    return dealt.mapInArrow(run, "row long, doc_id long, run long, ids binary")


def _digest(runs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Counts and digests of each document, carried over its runs in order."""

    def run(batches):
        bpe = Bpe(ranks, pattern)
        now, n = None, 0
        for batch in batches:
            rows = []
            for row, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "ids")), strict=True):
                if now is None or now[0] != row:
                    if now:
                        rows.append((now[1], n, now[2].hexdigest(), now[3].hexdigest()))
                    now, n = (row, doc_id, hashlib.sha256(), hashlib.sha256()), 0
                ids = np.frombuffer(raw, "<u4")
                now[2].update((b" " if n and len(ids) else b"") + bpe.decimals(ids))
                now[3].update(bpe.decode(ids))
                n += len(ids)
            yield _batch(rows, _OUT)
        if now:
            yield _batch([(now[1], n, now[2].hexdigest(), now[3].hexdigest())], _OUT)

    return runs.repartition("row").sortWithinPartitions("row", "run").mapInArrow(run, _OUT_DDL)

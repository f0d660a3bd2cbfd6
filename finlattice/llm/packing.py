"""Vector best-fit packing of token sequences, and the tokenising that feeds it.

`pieces(docs, tokenizer)` turns every whole text into token ids plus an end id and cuts only what is
longer than a sequence; `pack(pieces)` deals the pieces to buckets of bounded size and fills
sequences in each by best fit over three capacities: tokens, pieces and attention cost (the sum of
squared lengths).  The ids themselves never leave the task that made them.

FEWEST packs into as few sequences as it can: with pieces of up to the whole sequence its other two limits cannot
bind.  ATTENTION is for training where each document attends to itself alone: pieces of half a sequence at most, and limits of
pieces and of cost that do bind, at the price of more sequences.

Defined results: a null or empty text is its end id alone (one piece of length 1); null ids and
repeated rows are packed as rows of their own; columns of the result that the input has already are an error; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import free_name, keep, text_batches

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_CACHED = 400_000  # words whose ids a task remembers
_TOGETHER = 1 << 21  # bytes of text that are looked up at once


#: The kinds of vocabulary whose words can be encoded one by one: what lower-cases and cuts at white space, then splits letters, digits and the rest.
_WORDWISE = (
    ["NFC", "Replace", "Lowercase"],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    ["Split", "ByteLevel"],
)


def wordwise(path: str) -> bool:
    """Whether a tokenizer file normalises and splits as WordEncoder does by itself."""
    with open(path, "rb") as file:
        spec = json.load(file)
    steps = lambda part, name: part[name] if part and part.get("type") == "Sequence" else [part or {}]
    normalisers = steps(spec.get("normalizer"), "normalizers")
    splits = steps(spec.get("pre_tokenizer"), "pretokenizers")
    names, pattern, kinds = _WORDWISE
    found = [n.get("type") for n in normalisers] == names and [s.get("type") for s in splits] == kinds
    if not found or spec["model"].get("type") != "BPE" or spec.get("post_processor"):
        return False
    space, split, level = normalisers[1], splits[0], splits[1]
    return space.get("pattern") == {"Regex": r"\s+"} and split.get("pattern") == {"Regex": pattern} and bool(split.get("invert")) and not level.get("use_regex") and not level.get("add_prefix_space")


# Letters whose lower case and composed form are single and themselves; bytes as byte-level vocabularies write them.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([.,;:!?()\"*#$%&|\-]*)")
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class WordEncoder:
    """ids of texts as little-endian uint32 bytes, remembering the ids of words between ASCII white space.

    A vocabulary of a known kind has pre-tokens that never cross white space, so a text's ids are those of its words
    in turn; by any other one, texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.wordwise = wordwise(path)
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > _CACHED:
            self.known = {w: self.known[w] for w in words if w in self.known}
        tokenize, odd = self.model.tokenize, []
        for word in new:
            if word.isalpha():  # ASCII letters: one pre-token, given to the merges directly
                ids = [t.id for t in tokenize(word.lower().decode())]
            elif simple := _SIMPLE.fullmatch(text := word.decode("utf-8", "replace")):  # letters, then punctuation
                ids = []
                for part in simple.groups():
                    if part.isascii():
                        ids += [t.id for t in tokenize(part.lower())]
                    elif part:
                        ids += [t.id for t in tokenize(part.lower().encode().decode("latin-1").translate(_BYTE_CHARS))]
            else:
                odd.append((word, text))
                continue
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            starts = np.cumsum([0] + [len(t) + 1 for _, t in part])
            got = self.tokenizer.encode(" ".join(t for _, t in part), add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            cuts = np.searchsorted(np.array([a for a, _ in got.offsets], np.int64), starts)
            for (word, _), a, b in zip(part, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                self.known[word] = ids[a:b].tobytes()

    def encode(self, texts: list[bytes | None]):
        """The id bytes of each text, in order."""
        if not self.wordwise:
            for text in texts:
                yield np.array(self.tokenizer.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
            return
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < _TOGETHER):
                size += len(texts[end] or b"")
                end += 1
            split = [(t or b"").split() for t in texts[at:end]]
            self.learn(set().union(*split))
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))
            at = end


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = WordEncoder(tokenizer)
        for batch, texts in text_batches(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds at most; each piece counts its length, 1 and its length squared."""

    tokens: int = 4096
    pieces: int = 4096
    cost: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    by: str = "residual_norm"  # or "dot_product"


FEWEST = Capacity()
ATTENTION = Capacity(pieces=8, cost=2048 * 2048 * 5 // 4, weights=(1.0, 1.0, 1.0))  # for pieces of 2048 tokens at most


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken from the longest down; a new bin opens only where no open one can hold the piece."""
    limits = np.array([capacity.tokens, capacity.pieces, capacity.cost], float)
    weights = np.array(capacity.weights)
    if len(lengths) and (lengths.max() > capacity.tokens or lengths.max() ** 2 > capacity.cost):
        raise ValueError("a piece is beyond the capacity of a sequence")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    shortest = int(lengths.min()) if len(lengths) else 0
    left = np.empty((1024, 3))  # remaining capacities of open bins, as shares of the limits
    name = np.empty(1024, np.int64)
    n_open = n_bins = 0
    for i in order.tolist():
        length = int(lengths[i])
        need = np.array([length, 1, length * length], float) / limits
        pick = -1
        if n_open:
            after = left[:n_open] - need
            fits = (after >= -1e-12).all(axis=1)
            if fits.any():
                score = -(left[:n_open] @ (weights * need)) if capacity.by == "dot_product" else (after * after) @ weights
                pick = int(np.where(fits, score, np.inf).argmin())
        if pick < 0:
            if n_open == len(left):
                left, name = np.concatenate((left, left)), np.concatenate((name, name))
            pick, left[n_open], name[n_open] = n_open, 1.0, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i] = name[pick]
        offsets[i] = round((1.0 - left[pick, 0]) * limits[0])
        left[pick] -= need
        if round(left[pick, 0] * limits[0]) < shortest:  # closed
            n_open -= 1
            left[pick], name[pick] = left[n_open], name[n_open]
    return bins, offsets


def pack(rows: DataFrame, capacity: Capacity = Capacity(), bucket_rows: int = 20_000) -> DataFrame:
    """rows with sequence_id and offset; rows needs a column `length`.

    Rows are kept once with a row number, so a bucket holds the same rows whenever it is recomputed.
    """
    row, bucket = free_name(rows, "row"), free_name(rows, "bucket")
    if {"sequence_id", "offset"} & {c.lower() for c in rows.columns}:
        raise ValueError("sequence_id and offset are columns of the result")
    kept = keep(rows.withColumn(row, F.monotonically_increasing_id()), "pieces")
    buckets = max(1, -(-kept.count() // bucket_rows))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = rows.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity)
        return pdf[names].assign(sequence_id=(int(pdf[bucket].iloc[0]) << 32) + bins, offset=offsets)

    dealt = kept.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(buckets)))
    return dealt.groupBy(bucket).applyInPandas(run, schema)

"""Quality rules by repetition coverage: characters inside duplicated n-grams and duplicated lines.

The limits are the published ones for web text (20, 18 and 16 % for the n-gram of 2 to 4 words that takes most
characters, 15 to 10 % for duplicated n-grams of 5 to 10 words, 20 % for duplicated lines and 30 % of the lines).  The published shares of 5
to 10 words leave out an n-gram's first occurrence; here it is counted, so those limits are twice as high.

`quality(docs)` adds one row of counts and verdicts per document.  Every text is handled alone and
whole in Arrow batches, so the job needs no shuffle.

Defined results: a null or empty text, or one of white space only, has zero words, fails the base
rule and is not kept; a null id is returned as null; repeated rows give repeated results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._rolling import Words, covered, repeated
from ._tables import text_batches

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, dup_gram_chars array<long>, top_gram_chars array<long>, failed_rules string"
)


@dataclass(frozen=True)
class QualityRules:
    """Limits, in percent of the characters in words unless said otherwise."""

    least_words: int = 50
    most_repeat_words: int = 50  # percent of words in repeated 3-word windows
    gram_lengths: tuple[int, ...] = (5, 6, 7, 8, 9, 10)  # 3 words at least
    most_gram_chars: tuple[int, ...] = (30, 28, 26, 24, 22, 20)  # percent in duplicated n-grams, per length
    top_lengths: tuple[int, ...] = (2, 3, 4)
    most_top_chars: tuple[int, ...] = (20, 18, 16)  # percent that the n-gram with most characters in all its occurrences has, per length
    most_line_chars: int = 20  # percent in lines equal to an earlier line
    most_lines: int = 30  # percent of the lines with a word
    most_symbols: int | None = None  # symbols per 100 words; None: they decide nothing

    def __post_init__(self):
        if min(self.gram_lengths, default=3) < 3:
            raise ValueError("duplicated n-grams have 3 words at least")


_SPACE = b" \t\n\r\x0b\x0c"
_NOT_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))


def _line_repeats(data: bytes) -> tuple[int, int, int]:
    """Lines with a word, those of them that equal an earlier line, and the code points of the latter's words."""
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    seen: set[bytes] = set()
    count = chars = 0
    if len(set(lines)) < len(lines):
        for line in lines:
            if line in seen:
                count += 1
                chars += len(b"".join(line.split()).decode("utf-8", "replace"))
            else:
                seen.add(line)
    return len(lines), count, chars


def _top_chars(grams: np.ndarray, code_points: np.ndarray, width: int) -> int:
    """The most characters that all occurrences of one repeated n-gram have together."""
    _, first, counts = np.unique(grams, return_index=True, return_counts=True)
    again = counts > 1
    ends = np.concatenate(([0], np.cumsum(code_points)))
    first = first[again]
    return int((counts[again] * (ends[first + width] - ends[first])).max(initial=0))


def measure(data: bytes | None, rules: QualityRules) -> tuple:
    """All columns but doc_id for one text."""
    data = data or b""
    words = Words(data)
    n = words.n
    code_points = words.code_points()
    chars = int(code_points.sum())
    symbols = len(data.translate(None, _NOT_SYMBOLS))
    lines, dup_lines, line_chars = _line_repeats(data)
    repeat_words = int(covered(repeated(words.grams(3)), 3, n).sum())
    gram_chars, broken = [], []
    for width, most in zip(rules.gram_lengths, rules.most_gram_chars, strict=True):
        # every 3 words of a repeated n-gram are repeated, so there is none if those cover less
        flags = repeated(words.grams(width)) if repeat_words >= width else np.zeros(0, bool)
        gram_chars.append(int(code_points[covered(flags, width, n)].sum()) if flags.any() else 0)
        if 100 * gram_chars[-1] > most * chars:
            broken.append(f"gram{width}")
    top_chars = [_top_chars(words.grams(width), code_points, width) if n > width else 0 for width in rules.top_lengths]
    broken += [f"top{width}" for width, c, most in zip(rules.top_lengths, top_chars, rules.most_top_chars, strict=True) if 100 * c > most * chars]
    if 100 * line_chars > rules.most_line_chars * chars:
        broken.append("line_chars")
    if 100 * dup_lines > rules.most_lines * lines:
        broken.append("lines")
    if rules.most_symbols is not None and 100 * symbols > rules.most_symbols * n:
        broken.append("symbols")
    base = n < rules.least_words or 100 * repeat_words > rules.most_repeat_words * n
    return n, chars, symbols, dup_lines, repeat_words, base, not base and not broken, line_chars, gram_chars, top_chars, ",".join(broken)


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: counts, the base rule's verdict and the final one (`kept`)."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            ("base_failed", pa.bool_()),
            ("kept", pa.bool_()),
            ("dup_line_chars", pa.int64()),
            ("dup_gram_chars", pa.list_(pa.int64())),
            ("top_gram_chars", pa.list_(pa.int64())),
            ("failed_rules", pa.string()),
        ]
    )

    def run(batches):
        for batch, texts in text_batches(batches):
            columns = list(zip(*(measure(t, rules) for t in texts), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, all their columns unchanged: one pass, no join."""
    fields = docs.schema

    def run(batches):
        for batch, texts in text_batches(batches):
            yield batch.filter(pa.array([measure(t, rules)[6] for t in texts]))

    return docs.mapInArrow(run, fields)

"""Language ID by interpolated Kneser-Ney character models, one per language, kept as sorted hash arrays.

Training: a bounded, hashed sample of each language's learnable documents (`sample_docs` in all, whole texts) is reduced to
lower-case letters with single spaces and all its character n-grams of each order are counted (summed inside each
task, then by a shuffle).  Kneser-Ney statistics follow by aggregation.  A language's model is, for each order, a
sorted array of n-gram codes with probabilities and one of contexts with back-off weights, looked up by binary
search; a code holds its characters, so n-grams never collide.  A table of places only speeds up codes
that occurred in training.  Any number of languages is learned; the more there are, the fewer documents of each.

Prediction: the language of lowest cross-entropy per character.  Rejection is calibrated on a slice of the learnable
documents that the models have not seen: entropies are measured in robust deviations (of the median absolute deviation)
from the median of texts of the language and about that length (where those are few, of the nearest lengths too, up to
all of the language, then of all languages), and a text is rejected beyond the deviation that `most_false` of the
slice exceeds, and beyond `reject_spreads` at any rate.  A language of fewer than `least_sliced` documents gives all of
them to both purposes.

Defined results: a null text or one without a letter is `und` with score 0 and rejected; null languages
are not learned; with nothing to learn from, every text is `und`; a null id is returned as null;
repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import keep, without

_SPACE = 32
_ORDER = 4  # characters of 16 bits each make a 64-bit code
_TOGETHER = 1 << 21  # n-grams that a task gathers before it sums them
_CELLS = 1 << 23  # probabilities that a worker keeps ready
_PLACES = 21  # bits of the table of places
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PRIVATE = (0xE000, 6400)  # no letters there: those beyond 16 bits are put there


@dataclass(frozen=True)
class LanguageSettings:
    discount: float = 0.75
    sample_docs: int = 40_000  # learned from, over all languages, as many of each at most
    least_sliced: int = 50  # learnable documents of a language from which a slice is held back for calibration
    most_false: float = 0.005  # of the slice may be rejected
    reject_spreads: float = 6.0  # deviations within which nothing is rejected
    least_spread: float = 0.02  # of entropies, where texts are all but equal
    least_calibration: int = 30  # texts of a length class below which its neighbours are taken in


_letters = np.zeros(0x110000, np.int8)  # 0 not looked up yet, 1 letter, 2 other


def letters(text: str | None) -> np.ndarray:
    """Lower-case letters as code points, every run of other characters as one space, a space at both ends; empty without a letter."""
    if not text:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    known = _letters[points]
    if not known.all():
        for p in np.unique(points[known == 0]).tolist():
            _letters[p] = 1 if chr(p).isalpha() else 2
        known = _letters[points]
    is_letter = known == 1
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    wanted = is_letter.copy()
    wanted[1:] |= is_letter[:-1]
    out = np.where(is_letter, points, _SPACE)[wanted]
    first = [_SPACE] * (2 if out[0] != _SPACE else 1)
    out = np.concatenate((first, out, [_SPACE] * int(out[-1] != _SPACE))).astype(np.uint64)
    far = out > 0xFFFF
    if far.any():
        out[far] = _PRIVATE[0] + out[far] % _PRIVATE[1]
    return out


def codes(points: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each character from the fourth on, 16 bits a character."""
    n = len(points) - _ORDER + 1
    if n <= 0:
        points, n = np.concatenate((np.full(_ORDER - len(points), _SPACE, np.uint64), points)), 1
    out = points[:n].copy()
    for k in range(1, _ORDER):
        out <<= np.uint64(16)
        out |= points[k : k + n]
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, code, n: how often each 4-gram occurs in the texts of each language."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                points = letters(text)
                if len(points):
                    held.setdefault(lang, []).append(found := codes(points))
                    size += len(found)
                if size >= _TOGETHER:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, discount: float) -> DataFrame:
    """lang, order, code, p, context, weight: discounted probability of each n-gram and the back-off weight of its context.

    The highest order uses counts; each lower one counts the distinct characters seen before an n-gram.
    """
    parts, table = [], counts
    for order in range(_ORDER, 0, -1):
        context = F.shiftrightunsigned("code", 16)
        stats = table.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        parts.append(
            table.withColumn("context", context).join(stats, ["lang", "context"]).select(
                "lang", F.lit(order).alias("order"), "code", ((F.col("n") - discount) / F.col("total")).alias("p"), "context", (discount * F.col("types") / F.col("total")).alias("weight")
            )
        )
        if order > 1:
            shorter = F.col("code").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
            table = table.groupBy("lang", shorter.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
    """The values of keys in a sorted array; missing for others."""
    if not len(keys):
        return np.full(len(wanted), missing, np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.float32(missing))


class Model:
    """Of each language and order: sorted n-gram codes with probabilities, and sorted contexts with back-off weights."""

    def __init__(self, langs: list[str], grams: list[list[tuple]], contexts: list[list[tuple]]):
        self.langs, self.grams, self.contexts = langs, grams, contexts
        self._places = None

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """Natural logarithm of the interpolated probability of 4-grams, a column per language."""
        out = np.empty((len(code), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            p = np.full(len(code), 1 / 65536, np.float32)
            for order in range(1, _ORDER + 1):
                own = code if order == _ORDER else code & np.uint64((1 << 16 * order) - 1)
                (keys, values), (contexts, weights) = self.grams[k][order - 1], self.contexts[k][order - 1]
                p = _find(keys, own, values, 0) + _find(contexts, own >> np.uint64(16), weights, 1) * p
            out[:, k] = np.log(p)
        return out

    def prepare(self) -> Model:
        """Make the table of places of codes that occurred in training."""
        if self._places is None:
            codes_of = [grams[_ORDER - 1][0] for grams in self.grams]
            self._known = np.unique(np.concatenate(codes_of))[: _CELLS // len(self.langs)]
            self._rows = self.log_probability(self._known)
            self._places = np.full(1 << _PLACES, -1, np.int32)
            self._places[self._place(self._known)] = np.arange(len(self._known))
        return self

    @staticmethod
    def _place(code: np.ndarray) -> np.ndarray:
        return ((code * _MULTIPLIER) >> np.uint64(64 - _PLACES)).astype(np.int64)

    def entropy(self, points: np.ndarray) -> np.ndarray:
        """Cross-entropy per character under each language, over the whole text."""
        code = codes(points)
        at = self._places[self._place(code)]
        ready = (at >= 0) & (self._known[at] == code)
        total = self._rows[at[ready]].sum(axis=0, dtype=np.float64)
        if not ready.all():
            others, n = np.unique(code[~ready], return_counts=True)
            total += n @ self.log_probability(others).astype(np.float64)
        return -total / len(code)


def fit(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> Model:
    """A model of the languages of docs (lang, text); rows of null lang are not used."""
    counts = keep(count_grams(docs.where("lang is not null")), "grams")
    table = keep(kneser_ney(counts, settings.discount), "model")
    got = table.select("lang", "order", F.col("code").alias("key"), F.col("p").cast("float").alias("v")).toPandas()
    weights = table.groupBy("lang", "order", F.col("context").alias("key")).agg(F.max("weight").cast("float").alias("v")).toPandas()
    langs = sorted(got["lang"].unique())

    def arrays(frame) -> list[list[tuple]]:
        out = []
        parts = {key: part for key, part in frame.groupby(["lang", "order"])}
        for lang in langs:
            out.append([])
            for order in range(1, _ORDER + 1):
                keys, values = parts[lang, order]["key"].to_numpy(np.int64).view(np.uint64), parts[lang, order]["v"].to_numpy(np.float32)
                sort = np.argsort(keys)
                out[-1].append((keys[sort], values[sort]))
        return out

    return Model(langs, arrays(got), arrays(weights))


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score, entropy and n_letters; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("entropy", T.DoubleType()), ("n_letters", T.LongType()))
    fields = T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in added)])

    def run(batches):
        known = shared.value.prepare() if shared.value.langs else None
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                points = letters(text)
                if not len(points) or known is None:
                    rows.append(("und", 0.0, None, len(points)))
                    continue
                entropy = known.entropy(points)
                best = int(entropy.argmin())
                rows.append((known.langs[best], float(1 / np.exp((entropy[best] - entropy) * min(len(points), 40)).sum()), float(entropy[best]), len(points)))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "score", "entropy", "n_letters"])

    return docs.mapInArrow(run, fields)


_BINS = 512  # of entropy, a nat
_LENGTHS = 41  # length classes, powers of two


def _median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    return float(x[order][np.searchsorted(np.cumsum(n[order]), (n.sum() + 1) // 2)])


def limits(counts, langs: list[str], settings: LanguageSettings) -> list[tuple[str, int, float]]:
    """(language, length class, highest entropy) of every class, from counts n of calibration texts by lang_pred, length and bin; nothing if there are none."""
    spread: dict[tuple[str, int], tuple[float, float]] = {}
    for lang in langs if len(counts) else ():
        own = counts[counts["lang_pred"] == lang]
        own = own if len(own) else counts
        length, bins, n = (own[c].to_numpy(np.int64) for c in ("length", "bin", "n"))
        entropy = (bins + 0.5) / _BINS
        for k in range(_LENGTHS):
            away = np.abs(length - k)
            near = away <= next((w for w in range(_LENGTHS) if n[away <= w].sum() >= settings.least_calibration), _LENGTHS)
            middle = _median(entropy[near], n[near])
            spread[lang, k] = middle, max(settings.least_spread, 1.4826 * _median(np.abs(entropy[near] - middle), n[near]))
    if not spread:
        return []
    away, n = [], []
    for lang, k, b, m in zip(*(counts[c].tolist() for c in ("lang_pred", "length", "bin", "n")), strict=True):
        middle, width = spread[lang, min(k, _LENGTHS - 1)]
        away.append(((b + 0.5) / _BINS - middle) / width)
        n.append(m)
    away, n = np.array(away), np.array(n)
    order = np.argsort(away)
    beyond = away[order][np.searchsorted(np.cumsum(n[order]), (1 - settings.most_false) * n.sum())]
    most = max(settings.reject_spreads, float(beyond))
    return [(lang, k, middle + most * width) for (lang, k), (middle, width) in spread.items()]


def _learnable(slim: DataFrame, settings: LanguageSettings) -> tuple[DataFrame, DataFrame]:
    """lang, text of the documents to learn from; and lang, sliced of each language."""
    known = slim.where("not held_out and lang is not null")
    per_lang = keep(known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "langs")  # a row per language
    each = settings.sample_docs / F.greatest(F.lit(1), F.lit(per_lang.count()))
    rates = per_lang.select("lang", (F.col("docs") >= settings.least_sliced).alias("sliced"), (each / F.col("docs")).alias("rate"))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(1 << 20)
    return known.join(F.broadcast(rates), "lang").where((share < F.col("rate")) & ~(F.col("sliced") & F.col("slice"))).select("lang", "text"), rates.select("lang", "sliced")


def identify(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected per document; learns from the documents that are not held out."""
    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", "cast(lang as string) lang").withColumn("held_out", is_held_out())
    slim = slim.withColumn("slice", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 16 == 5, F.lit(False)))
    learned, sliced = _learnable(slim, settings)
    model = fit(learned, settings)
    # lang goes along for the calibration below only; predict() reads the text
    scored = keep(predict(slim, model).drop("text"), "languages")
    length = F.floor(F.log2(F.col("n_letters"))).cast("int").alias("length")
    right = scored.where("not held_out and lang_pred = lang and entropy is not null").join(F.broadcast(sliced), "lang").where("slice or not sliced")
    counts = right.groupBy("lang_pred", length, F.floor(F.col("entropy") * _BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    highest = docs.sparkSession.createDataFrame(limits(counts, model.langs, settings), "lang_pred string, length int, most double")
    # _LENGTHS rows a language
    judged = scored.withColumn("length", F.floor(F.log2(F.greatest("n_letters", F.lit(1)))).cast("int")).join(F.broadcast(highest), ["lang_pred", "length"], "left")
    rejected = (F.col("lang_pred") == "und") | F.coalesce(F.col("entropy") > F.col("most"), F.lit(False))
    return judged.select("doc_id", "held_out", "lang_pred", "score", "entropy", rejected.alias("rejected"))


def keep_identified(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """docs without the rejected ones; rows of a null id stay."""
    rejected = identify(docs, settings).where("rejected and doc_id is not null").select("doc_id").distinct()
    return without(docs, keep(rejected, "rejected"))

"""License scans: ordered signature rules behind a keyword prefilter, overlapping detections resolved.

A text is lower-cased (A-Z) and reduced to words with single spaces.  The rules are hand-written signatures
(license_signatures.py), SPDX identifiers, and the names of license families in sentences that grant them.  A rule runs only where one of its
keywords occurs, which are the longest plain words that every match must hold, from word edge to word edge.
Detections are taken by priority, then length; one that lies inside an accepted detection is
suppressed.  Base phrases are never suppressed.  Each text is handled alone and whole: no shuffle.

Defined results: a null or empty text has no words, labels or detections and score 0; a null id is
returned as null; repeated rows give repeated results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ._tables import text_batches
from .license_signatures import SIGNATURES

# Fixed values of the contract: phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]  # one of them is in every match
    pattern: re.Pattern
    priority: int  # lower runs first and wins overlaps
    relevance: float


# A family's label, names (alternatives) and versions; every name and version is put into each sentence below.
_FAMILIES = (
    ("gpl", r"gnu general public licen[cs]e|gnu gpl|gpl", ("1 0", "2 0", "3 0")),
    ("lgpl", r"gnu lesser general public licen[cs]e|gnu library general public licen[cs]e|gnu lgpl|lgpl", ("2 0", "2 1", "3 0")),
    ("agpl", r"gnu affero general public licen[cs]e|affero general public licen[cs]e|gnu agpl|agpl", ("1 0", "3 0")),
    ("gfdl", r"gnu free documentation licen[cs]e|gfdl", ("1 1", "1 2", "1 3")),
    ("apache", r"apache software licen[cs]e|apache licen[cs]e", ("1 0", "1 1", "2 0")),
    ("mpl", r"mozilla public licen[cs]e|mpl", ("1 0", "1 1", "2 0")),
    ("epl", r"eclipse public licen[cs]e|epl", ("1 0", "2 0")),
    ("cddl", r"common development and distribution licen[cs]e|cddl", ("1 0", "1 1")),
    ("cpl", r"common public licen[cs]e", ("0 5", "1 0")),
    ("eupl", r"european union public licen[cs]e|eupl", ("1 0", "1 1", "1 2")),
    ("osl", r"open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", r"academic free licen[cs]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", r"artistic licen[cs]e", ("1 0", "2 0")),
    ("bsl", r"boost software licen[cs]e", ("1 0",)),
    ("ofl", r"sil open font licen[cs]e|open font licen[cs]e", ("1 0", "1 1")),
    ("php", r"php licen[cs]e", ("3 0", "3 01")),
    ("zpl", r"zope public licen[cs]e", ("1 1", "2 0", "2 1")),
    ("odc-by", r"open data commons attribution licen[cs]e", ("1 0",)),
    ("odbl", r"open database licen[cs]e|odbl", ("1 0",)),
    ("upl", r"universal permissive licen[cs]e", ("1 0",)),
    ("ms-pl", r"microsoft public licen[cs]e", ()),
    ("zlib", r"zlib licen[cs]e|zlib libpng licen[cs]e", ()),
    ("isc", r"isc licen[cs]e", ()),
    ("unlicense", r"the unlicense", ()),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", ("1 0", "2 0")),
    ("postgresql", r"postgresql licen[cs]e", ()),
    ("mit", r"mit licen[cs]e|expat licen[cs]e|x11 licen[cs]e", ()),
    ("bsd", r"bsd licen[cs]e", ()),
    ("bsd-2-clause", r"2 clause bsd licen[cs]e|two clause bsd licen[cs]e|bsd 2 clause licen[cs]e|simplified bsd licen[cs]e|freebsd licen[cs]e", ()),
    ("bsd-3-clause", r"3 clause bsd licen[cs]e|three clause bsd licen[cs]e|bsd 3 clause licen[cs]e|new bsd licen[cs]e|modified bsd licen[cs]e|revised bsd licen[cs]e", ()),
    ("bsd-4-clause", r"4 clause bsd licen[cs]e|four clause bsd licen[cs]e|bsd 4 clause licen[cs]e|original bsd licen[cs]e", ()),
)
# Phrases around a family's name: relevance and pattern; {n} is the name, {v} the version.
_PHRASES = (
    (1.0, r"(?:licensed|released|distributed|available|redistribute it and or modify it|published) under (?:the )?(?:terms of )?(?:the )?(?:{n}){v}"),
    (0.9, r"(?:subject to|governed by|covered by|according to|in accordance with) (?:the )?(?:terms of )?(?:the )?(?:{n}){v}"),
    (0.8, r"spdx licen[cs]e identifier (?:{n}){v}"),
    (0.8, r"(?:the )?(?:{n}){v} (?:applies|as published by)"),
)
_BEFORE_VERSION = r"(?: (?:version |v ?)?|v)"  # version 2, v 2, v2, or v2 at the end of a short name
_VERSION = _BEFORE_VERSION + r"{major}(?: {minor})?(?! \d)"
# SPDX identifiers: the family's label, its name there and versions if they are other than the family's; versioned ones are name-version.
_SPDX = {
    **{label: label for label in ("gpl", "lgpl", "agpl", "gfdl", "apache", "mpl", "epl", "cddl", "cpl", "eupl", "osl", "afl", "artistic", "bsl", "ofl", "php", "zpl", "odbl", "upl", "zlib", "isc", "unlicense", "wtfpl", "postgresql", "mit", "cc0")},
    **{label: label.replace("-", " ") for label in ("odc-by", "ms-pl", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause")},
}
_SPDX_VERSIONS = {"wtfpl": (), "cc0": ()}
# Kinds of signatures: priority and relevance.
_KINDS = {"text": (5, 1.0), "notice": (15, 0.95), "named": (28, 0.85), "mention": (90, 0.5)}
_CC = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"))


def signatures() -> list[tuple[str, str, str]]:
    """label, kind and pattern of the hand-written signatures."""
    out, label = [], ""
    for line in SIGNATURES.splitlines():
        if line.startswith("["):
            label = line[1:-1]
        elif line:
            kind, pattern = line.split(maxsplit=1)
            out.append((label, kind, re.sub(r"license(?!\[)", "licen[cs]e", pattern)))
    return out


def keywords(pattern: str) -> frozenset[str]:
    """Plain texts of which every match between two word edges holds at least one: the set whose shortest is longest."""
    return _required([(_parser.LITERAL, 32), *_parser.parse(pattern), (_parser.LITERAL, 32)])


def _required(parts) -> frozenset[str]:
    found, run = [], ""
    for kind, value in [*parts, (None, None)]:
        if kind is _parser.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if kind is _parser.SUBPATTERN:
            found.append(_required(value[3]))
        elif kind is _parser.MAX_REPEAT and value[0] > 0:
            found.append(_required(value[2]))
        elif kind is _parser.BRANCH:
            ways = [_required(way) for way in value[1]]
            found.append(frozenset().union(*ways) if all(ways) else frozenset())
    return max(found, key=lambda words: min(map(len, words), default=0), default=frozenset())


def _spdx() -> list[tuple[str, str]]:
    """Labels and patterns of the SPDX identifiers; a match's group `id` is the identifier itself."""
    families = {label: versions for label, _, versions in _FAMILIES} | _SPDX_VERSIONS
    ids: list[tuple[str, str]] = [("0bsd", "0bsd"), ("mit-0", "mit 0")]
    for label, name in _SPDX.items():
        if not families[label]:
            ids.append((label, f"{name} 1 0" if label == "cc0" else name))
        for major, minor in (v.split(" ") for v in families[label]):
            own = f"{label}-{major}" + (f".{minor}" if minor != "0" else "")
            if label in ("gpl", "lgpl", "agpl", "gfdl"):
                ids += [(f"{own}-or-later", f"{name} {major} {minor} or later"), (own, f"{name} {major} {minor}(?: only)?(?! or later)")]
            else:
                ids.append((own, f"{name} {major} {minor}"))
    for label, _ in _CC:
        ids += [(f"cc-{label}-{v.replace(' ', '.')}", f"cc {label.replace('-', ' ')} {v}") for v in ("1 0", "2 0", "2 5", "3 0", "4 0")]
    known = "|".join(pattern for _, pattern in ids)
    before = rf"spdx licen[cs]e identifier (?:(?:{known})(?: with [a-z0-9 ]{{1,40}}? exception(?: \d \d)?)? (?:or|and) )*"
    return [(label, rf"{before}(?P<id>{pattern})(?! \d)") for label, pattern in ids]


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: longer, more specific signatures first."""
    found: list[tuple[str, str, int, float]] = [(label, pattern, *_KINDS[kind]) for label, kind, pattern in signatures()]
    for label, names, versions in _FAMILIES:
        for k, (relevance, phrase) in enumerate(_PHRASES):
            for version in versions:
                major, minor = version.split(" ")
                text = _VERSION.format(major=major, minor=minor)
                if minor != "0":
                    text = rf"{_BEFORE_VERSION}{major} {minor}(?! \d)"
                for later in (True, False) if label in ("gpl", "lgpl", "agpl", "gfdl") else (False,):
                    tail = r" (?:or (?:at your option )?any later version|or later|or newer)" if later else ""
                    name = f"{label}-{major}" + (f".{minor}" if minor != "0" else "") + ("-or-later" if later else "")
                    found.append((name, phrase.replace("{n}", names).replace("{v}", text + tail), 10 * k + (not later), relevance))
            found.append((label, phrase.replace("{n}", names).replace("{v}", r"(?! (?:version |v ?)?\d)"), 100 + 10 * k, relevance - 0.1))
    found += [(label, pattern, 25, 0.8) for label, pattern in _spdx()]
    for label, words in _CC:
        short = label.replace("-", " ")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0", ""):
            name = f"cc-{label}" + (f"-{version.replace(' ', '.')}" if version else "")
            tail = f" {version}(?! \\d)" if version else r"(?! (?:nc|nd|sa)\b)(?! \d \d)"
            found.append((name, rf"cc {short}{tail}", 60 + (not version), 0.9))
            found.append((name, rf"creative commons {words}(?: licen[cs]e| international| unported)*{tail}", 60 + (not version), 0.9))
    made = [Rule(a, tuple(sorted(k.encode() for k in keywords(b))), re.compile(rb"(?<= )(?:" + b.encode() + rb")(?= )"), p, r) for a, b, p, r in found]
    return tuple(sorted(made, key=lambda r: r.priority))


@cache
def _prefilter(own_rules: tuple[Rule, ...]) -> ahocorasick.Automaton:
    """Finds every keyword in one pass; a keyword's value is the rules that it gates."""
    gated: dict[bytes, list[int]] = {}
    for i, rule in enumerate(own_rules):
        for keyword in rule.keywords:
            gated.setdefault(keyword, []).append(i)
    automaton = ahocorasick.Automaton()
    for keyword, which in gated.items():
        automaton.add_word(keyword.decode("latin-1"), tuple(which))
    automaton.make_automaton()
    return automaton


def matches(padded: bytes, chosen) -> list[tuple[int, int, Rule]]:
    """Every match of some rules; of a rule with a group, the group's place."""
    return [(*m.span("id" if m.re.groups else 0), rule) for rule in chosen for m in rule.pattern.finditer(padded)]


def resolve(hits: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections by priority, then length, then place, without those inside an accepted one.

    The accepted ones that lie in no other are kept by start, and so by end too: only the last one that starts before can hold a hit.
    """
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for a, b, rule in sorted(hits, key=lambda h: (h[2].priority, h[0] - h[1], h[0], h[2].label)):
        k = bisect_right(starts, a)
        if k and ends[k - 1] >= b:
            continue
        kept.append((a, b, rule))
        first = k - 1 if k and starts[k - 1] == a else k
        last = first
        while last < len(ends) and ends[last] <= b:
            last += 1
        starts[first:last], ends[first:last] = [a], [b]
    return kept


def detect(padded: bytes, own_rules: tuple[Rule, ...], prefilter: ahocorasick.Automaton) -> list[tuple[int, int, Rule]]:
    """Accepted detections (byte start, byte end, rule) of one text."""
    found = {i for _, which in prefilter.iter(padded.decode("latin-1")) for i in which}
    return resolve(matches(padded, [own_rules[i] for i in sorted(found)]))


def scan_text(data: bytes | None, own_rules: tuple[Rule, ...] = ()) -> tuple:
    words = (data or b"").translate(_TABLE).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, 0
    padded = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in BASE.items():
        needle = f" {phrase} ".encode()
        at = padded.find(needle)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = padded.find(needle, at + 1)
    own_rules = own_rules or rules()
    kept = detect(padded, own_rules, _prefilter(own_rules))
    labels = base | {r.label for _, _, r in kept}
    score = max([0.95 if base else 0.0, *(r.relevance for _, _, r in kept)])
    first, last = (padded.count(b" ", 0, min(places)), padded.count(b" ", 0, max(places))) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, len(kept)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base places and labels, all labels, score and the number of accepted detections."""
    schema = pa.schema(
        [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_detections", pa.int64())]
    )

    def run(batches):
        for batch, texts in text_batches(batches):
            columns = list(zip(*map(scan_text, texts), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"
    )

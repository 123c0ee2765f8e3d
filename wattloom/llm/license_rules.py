"""License scans by ordered signature rules.

A rule is a regular expression over the words of a text (lower case, one space between words), with the words that must
all occur for it to be tried, a priority and a confidence. Detections are taken by priority, then by length; one whose
interval lies within an interval that was taken before is suppressed. Named phrases are found apart and never
suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators as bytes: all ASCII characters but digits and letters. Bytes above 127 belong to words.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else 32 if b < 128 else b for b in range(256))

#: Families: label, words that must occur, regular expression of the name; ~n stands for version n.
FAMILIES = (
    ("0bsd", "0bsd", "0bsd"),
    ("afl-3", "academic free", "academic free licen[cs]e~3"),
    ("agpl-3", "affero", "affero general public licen[cs]e~3"),
    ("agpl-3", "agpl", "agpl~3"),
    ("agpl-3", "agplv3", "agplv3"),
    ("apache-1.1", "apache", "apache (?:software )?licen[cs]e(?: version)? v?1 1"),
    ("apache-2", "apache", "apache(?: software)?(?: licen[cs]e)?~2"),
    ("artistic-2", "artistic", "(?:perl )?artistic licen[cs]e~2"),
    ("bsd-2", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?"),
    ("bsd-2", "freebsd", "freebsd licen[cs]e"),
    ("bsd-3", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?"),
    ("bsd-4", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?"),
    ("bsl-1", "boost", "boost software licen[cs]e(?:~1)?"),
    ("cc-by", "cc by", "cc by(?! n[cd]| sa)(?: [1-4] [05])?"),
    ("cc-by", "creative attribution", "creative commons attribution(?! non| no| share)(?: [1-4] [05])?"),
    ("cc-by-nc", "cc nc", "cc by nc(?! sa| nd)(?: [1-4] [05])?"),
    ("cc-by-nc", "creative attribution", "creative commons attribution non ?commercial(?! share| no)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc nd", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc nc sa", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc nd", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc sa", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-sa", "creative attribution", "creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc0-1", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cddl-1", "cddl", "cddl(?: 1 [01])?"),
    ("cddl-1", "common development", "common development and distribution licen[cs]e(?:~1(?: 1)?)?"),
    ("cpl-1", "common public", "common public licen[cs]e(?:~1)?"),
    ("ecl-2", "educational community", "educational community licen[cs]e(?:~2)?"),
    ("epl-1", "eclipse", "eclipse public licen[cs]e~1"),
    ("epl-2", "eclipse", "eclipse public licen[cs]e~2"),
    ("eupl-1.2", "european union", "european union public licen[cs]e(?: 1 [12])?"),
    ("gfdl-1.3", "free documentation", "free documentation licen[cs]e(?: 1 [123])?"),
    ("gpl-2", "general public", "general public licen[cs]e(?: as published by the free software foundation)?(?: either)?~2"),
    ("gpl-2", "gplv2", "gplv2"),
    ("gpl-2", "gpl", "gpl~2"),
    ("gpl-3", "general public", "general public licen[cs]e(?: as published by the free software foundation)?(?: either)?~3"),
    ("gpl-3", "gplv3", "gplv3"),
    ("gpl-3", "gpl", "gpl~3"),
    ("isc", "isc", "isc licen[cs]e"),
    ("lgpl-2.1", "lesser general", "lesser general public licen[cs]e~2(?: 1)?"),
    ("lgpl-3", "lesser general", "lesser general public licen[cs]e~3"),
    ("lgpl-2.1", "lgpl", "lgpl~2(?: 1)?"),
    ("lgpl-3", "lgpl", "lgpl~3"),
    ("mit", "mit", "mit(?: x11)? licen[cs]e"),
    ("mit", "expat", "expat licen[cs]e"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e~1(?: 1)?"),
    ("mpl-2", "mozilla", "mozilla public licen[cs]e~2"),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e"),
    ("odbl-1", "open database", "open database licen[cs]e"),
    ("ofl-1.1", "sil open", "sil open font licen[cs]e(?: 1 [01])?"),
    ("osl-3", "open software", "open software licen[cs]e~3"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("python-2", "python", "python(?: software foundation)? licen[cs]e(?:~2)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib licen[cs]e"),
)

#: Sentences around a name: expression before, expression after, priority, confidence.
FRAMES = (
    (r"spdx licen[cs]e identifier ", "", 5, 1.0),
    (r"(?:dual |multi )?licen[cs]ed under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:gnu )?", "", 4, 0.95),
    (r"(?:released|distributed|published|available|provided|offered|shared) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:gnu )?", "", 4, 0.9),
    (r"(?:subject to|governed by|redistribute (?:it|them) and or modify (?:it|them) under)(?: the terms of)?(?: the)? ", "", 3, 0.85),
    (r"under (?:the )?(?:terms of )?(?:the )?(?:gnu )?", "", 2, 0.7),
    ("", "(?: or(?: at your option)? (?:any )?later(?: version)?)? applies", 2, 0.7),
    ("", "", 1, 0.5),
)

#: Sentences of the license texts themselves: label, words that must occur, expression, priority, confidence.
TEXTS = (
    ("mit", "hereby granted charge", "permission is hereby granted free of charge to any person obtaining a copy of this software", 6, 0.95),
    ("isc", "permission fee", "permission to use copy modify and or distribute this software for any purpose with or without fee", 6, 0.95),
    ("bsd-3", "endorse promote", "neither the name of (?:\\S+ ){1,8}?may be used to endorse or promote products", 6, 0.95),
    ("bsd-2", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted", 5, 0.6),
    ("bsd-4", "advertising acknowledgement", "all advertising materials mentioning features or use of this software must display", 6, 0.95),
    ("apache-2", "apache www", "www apache org licenses license 2 0", 6, 1.0),
    ("apache-2", "warranties conditions kind", "distributed on an as is basis without warranties or conditions of any kind", 4, 0.7),
    ("gpl-3", "gnu www", "www gnu org licenses gpl 3 0", 6, 1.0),
    ("gpl-2", "gnu www", "www gnu org licenses (?:old licenses )?gpl 2 0", 6, 1.0),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 6, 1.0),
    ("public-domain", "dedicated domain", "(?:dedicated|released|placed) (?:in)?to the public domain", 3, 0.8),
    ("cc-by", "creativecommons by", "creativecommons org licenses by [1-4] [05]", 6, 1.0),
    ("cc-by-sa", "creativecommons sa", "creativecommons org licenses by sa [1-4] [05]", 6, 1.0),
    ("cc-by-nc", "creativecommons nc", "creativecommons org licenses by nc [1-4] [05]", 6, 1.0),
    ("cc0-1", "creativecommons zero", "creativecommons org publicdomain zero 1 0", 6, 1.0),
    ("mpl-2", "mozilla mpl", "mozilla org mpl 2 0", 6, 1.0),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[cs]e", 6, 1.0),
    ("proprietary", "rights reserved", "all rights reserved", 1, 0.4),
    ("proprietary", "confidential proprietary", "confidential and proprietary", 2, 0.6),
)

#: Identifiers of licenses as their words stand in a declaration, with the label. They differ from the names.
IDENTIFIERS = (
    ("mit", "mit"), ("mit-0", "mit 0"), ("isc", "isc"), ("zlib", "zlib"), ("wtfpl", "wtfpl"), ("unlicense", "unlicense"), ("0bsd", "0bsd"),
    ("apache-2", "apache 2 0"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("bsd-4", "bsd 4 clause"),
    ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"), ("agpl-3", "agpl 3 0"),
    ("mpl-1.1", "mpl 1 1"), ("mpl-2", "mpl 2 0"), ("epl-1", "epl 1 0"), ("epl-2", "epl 2 0"), ("osl-3", "osl 3 0"), ("eupl-1.2", "eupl 1 2"),
    ("cc0-1", "cc0 1 0"), ("cc-by", "cc by [1-4] [05]"), ("cc-by-sa", "cc by sa [1-4] [05]"), ("cc-by-nc", "cc by nc [1-4] [05]"),
    ("bsl-1", "bsl 1 0"), ("artistic-2", "artistic 2 0"), ("ms-pl", "ms pl"), ("odbl-1", "odbl 1 0"), ("ofl-1.1", "ofl 1 1"),
    ("postgresql", "postgresql"), ("python-2", "python 2 0"),
)

#: Phrases that are found wherever their words stand consecutively.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Rule:
    label: str
    needs: frozenset[bytes]
    pattern: re.Pattern[bytes]
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules: every family in every frame, the sentences of license texts, and declared identifiers."""
    version = lambda name: re.sub(r"~(\d)", r"(?: version)? v?\1(?: 0)?", name)
    drawn = [(label, needs, f"{before}(?:{version(name)}){after}", priority, sure) for label, needs, name in FAMILIES for before, after, priority, sure in FRAMES]
    stated = [(label, f"spdx identifier {words.split(' [')[0]}", f"spdx licen[cs]e identifier {words}(?: or later| only)?", 7, 1.0) for label, words in IDENTIFIERS]
    return [Rule(label, frozenset(needs.encode().split()), re.compile(f"(?<= )(?:{pattern})(?= )".encode()), priority, sure) for label, needs, pattern, priority, sure in (*drawn, *TEXTS, *stated)]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class _Covers:
    """Intervals, and whether one of them contains another; both in the order of starts and ends, so a look-up is a bisection."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Add an interval unless it lies in one that is there."""
        at = bisect_right(self.starts, start)
        if at and self.ends[at - 1] >= end:
            return False
        first, last = bisect_left(self.starts, start), bisect_right(self.ends, end)
        self.starts[first:max(first, last)] = [start]  # those that lie in the new one need not be asked again
        self.ends[first:max(first, last)] = [end]
        return True


class Scanner:
    """All rules with an inverted index from their rarest needed word."""

    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, gated: bool = True):
        self.rules = rules()
        self.phrases = [(b" " + phrase.encode() + b" ", frozenset(phrase.encode().split()), label) for phrase, label in phrases]
        self.gated = gated
        used: dict[bytes, int] = {}
        for rule in self.rules:
            for word in rule.needs:
                used[word] = used.get(word, 0) + 1
        self.by_word: dict[bytes, list[Rule]] = {}
        for rule in self.rules:
            self.by_word.setdefault(min(rule.needs, key=lambda w: (-len(w), used[w], w)), []).append(rule)
        self.keys = frozenset(self.by_word) | {max(needs, key=lambda w: (len(w), w)) for _, needs, _ in self.phrases}

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Number of words, phrases as (first word, label), detections as (first word, last word, label, confidence)."""
        words = words_of(text)
        known = set(words)
        if self.gated and known.isdisjoint(self.keys):
            return len(words), [], []
        line = b" " + b" ".join(words) + b" "
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))  # of each word, in the line
        base = []
        for phrase, needs, label in self.phrases:
            at = line.find(phrase) if needs <= known else -1
            while at >= 0:
                base.append((int(np.searchsorted(ends, at, "right")), label))
                at = line.find(phrase, at + 1)
        tried = [r for word in known & self.by_word.keys() for r in self.by_word[word] if r.needs <= known] if self.gated else self.rules
        found = [(-r.priority, m.start() - m.end(), m.start(), r.label, r.confidence) for r in tried for m in r.pattern.finditer(line)]
        taken, covers = [], _Covers()
        for _, length, start, label, sure in sorted(found):
            end = start - length
            if covers.add(start, end):
                taken.append((start, end, label, sure))
        spans = [(int(np.searchsorted(ends, a, "left")), int(np.searchsorted(ends, b, "left")), label, sure) for a, b, label, sure in taken]
        return len(words), sorted(base), sorted(spans)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are counted over the whole text. n_base: places of the phrases; first_word and last_word: the smallest and the
    largest start among them, null without one. labels: those of phrases and of detections that are not suppressed;
    score: 1 minus the product of (1 - confidence) over the labels' best detections, 0.9 for a phrase. spans: detections
    (first, last, label, confidence). Null and empty texts have no words and no labels (empty strings), score 0.
    Repeated rows and null keys stay; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for value in batch.column(1).cast(pa.binary()).to_pylist():
                count, base, spans = scanner.scan(value or b"")
                best = {label: 0.9 for _, label in base}
                for _, _, label, sure in spans:
                    best[label] = max(best.get(label, 0.0), sure)
                row = (count, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})),
                       ",".join(sorted(best)), 1.0 - float(np.prod([1 - s for s in best.values()])), [dict(zip(("first", "last", "label", "confidence"), s, strict=True)) for s in spans])
                for column, item in zip(out, row, strict=True):
                    column.append(item)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    fields = f"key {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<first: bigint, last: bigint, label: string, confidence: double>>"
    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, fields)
    return found.withColumnRenamed("key", key)

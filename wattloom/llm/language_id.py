"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Characters that are turned into n-grams at a time; longer texts go piece by piece.
PIECE = 1 << 19
#: Languages whose counts a task holds at a time.
HELD = 64
_LETTER = regex.compile(r"\p{L}")


def _pieces(texts: Sequence[str]) -> Iterator[list[tuple[int, str, int]]]:
    """Groups of (text number, characters, number of places where a gram may start)."""
    ahead, group, held = max(ORDERS) - 1, [], 0
    for number, text in enumerate(texts):
        text = text.lower()
        for begin in range(0, len(text), PIECE):
            part = text[begin:begin + PIECE + ahead]
            group.append((number, part, min(PIECE, len(text) - begin)))
            held += len(part)
            if held >= PIECE:
                yield group
                group, held = [], 0
    if group:
        yield group


def grams(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Number of the text and bucket of every n-gram of all texts, in lower case."""
    for group in _pieces(texts):
        sizes = np.array([len(part) for _, part, _ in group])
        codes = np.frombuffer("".join(part for _, part, _ in group).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        piece = np.repeat(np.arange(len(group)), sizes)
        owner = np.repeat(np.array([number for number, _, _ in group]), sizes)
        starts = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(np.array([keep for _, _, keep in group]), sizes)
        for order in ORDERS:
            count = len(codes) - order + 1
            if count <= 0:
                continue
            mixed = np.full(count, order, np.uint64)
            for k in range(order):
                mixed = (mixed ^ codes[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            whole = starts[:count] & (piece[:count] == piece[order - 1:])
            yield owner[:count][whole], (mixed[whole] % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and bucket of this task's texts; bucket -1 counts the texts."""
    counts: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1), pa.array(found[at])], ["lang", "bucket", "n"])
        counts.clear()

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(texts, langs, strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            if lang not in counts and len(counts) >= HELD:
                yield from flush()
            found = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            found[0] += len(own)
            for _, bucket in grams(own):
                found[1:] += np.bincount(bucket, minlength=BUCKETS)
    yield from flush()


@dataclass(frozen=True)
class Model:
    """Languages, logarithms of their shares of the texts, and of the grams in every language (languages x buckets)."""

    langs: list[str]
    prior: np.ndarray
    law: np.ndarray

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Most probable language and its probability; ``und`` and 0 for texts that are null or have no letter."""
        told = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if told:
            total = np.tile(self.prior, (len(told), 1))
            for owner, bucket in grams([texts[k] for k in told]):
                for k in range(len(self.langs)):  # the counts of a text are sparse: only buckets that occur are read
                    total[:, k] += np.bincount(owner, weights=self.law[k][bucket], minlength=len(told))
            total -= total.max(axis=1, keepdims=True)
            chance = np.exp(total)
            chance /= chance.sum(axis=1, keepdims=True)
            best = chance.argmax(axis=1)
            for place, k in enumerate(told):
                names[k] = self.langs[best[place]]
            scores[told] = chance[np.arange(len(told)), best]
        return names, scores


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model of all rows of ``docs`` that have a text and a language. Counts are summed by language and bucket.

    The driver gets one row per language and bucket (32,768 buckets), not per document.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sums = rows.mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sums["lang"].to_pylist()
    langs = sorted(set(names))
    place = {name: k for k, name in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS + 1))
    counts[np.array([place[n] for n in names], np.int64), sums["bucket"].to_numpy() + 1] = sums["n"].to_numpy()
    texts, found = counts[:, 0], counts[:, 1:] + SMOOTHING
    return Model(langs, np.log(texts / max(1.0, texts.sum())) if langs else np.zeros(0), np.log(found / found.sum(axis=1, keepdims=True)))


def identify(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang_pred and score (0 to 1) of every row, learned from the rows where ``training`` holds.

    Only the text is read for a prediction. Texts that are null, empty or without a letter give ``und`` and score 0, as
    does every text if nothing could be learned. Equal probabilities go to the language that sorts first. Repeated rows
    and null keys stay; other columns are not read; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(training), text, lang))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["key", "lang_pred", "score"])

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return found.withColumnRenamed("key", key)

"""Language identification against a plain count, and held-out accuracy."""

import math
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattloom.llm import language_id
from wattloom.llm.language_id import BUCKETS, ORDERS, SMOOTHING, fit, grams, identify

MASK = (1 << 64) - 1


def plain_grams(text):
    codes, found = [ord(c) for c in text.lower()], Counter()
    for n in ORDERS:
        for k in range(len(codes) - n + 1):
            h = n
            for c in codes[k:k + n]:
                h = (h ^ c) * 0x9E3779B97F4A7C15 & MASK
                h ^= h >> 29
            found[h % BUCKETS] += 1
    return found


ROWS = [(0, "the cat and the dog", "en"), (1, "der hund und die katze", "de"), (2, "THE END of the day", "en"), (3, "Straße ist groß", "de"),
        (4, None, "en"), (5, "no language here", None), (6, "", "de"), (7, "12 34 !!", "en"), (8, "x", "de"), (9, "½ ² ① Ⅳ", "en"), (None, "the sun", "en"), (0, "the cat and the dog", "en")]


def test_grams_do_not_cross_texts_or_pieces(monkeypatch):
    texts = ["abc", "", "a", "ÄÖ ü\U0001F600z" * 30]
    for piece in (1 << 19, 7):
        monkeypatch.setattr(language_id, "PIECE", piece)
        found = [Counter() for _ in texts]
        for owner, bucket in grams(texts):
            for o, b in zip(owner.tolist(), bucket.tolist()):
                found[o][b] += 1
        assert found == [plain_grams(t) for t in texts]


def test_predictions_match_plain_bayes(spark):
    df = spark.createDataFrame([(*r, "s") for r in ROWS], "doc_id bigint, text string, lang string, lang_pred string").repartition(3)
    out = {(r["doc_id"], r["i"]): r for r in identify(df.withColumn("i", F.col("doc_id")), F.lit(True), key="doc_id").withColumn("i", F.col("doc_id")).collect()}
    learn = [(t, lang) for _, t, lang in ROWS if t is not None and lang is not None]
    counts = {lang: sum((plain_grams(t) for t, l in learn if l == lang), Counter()) for lang in ("de", "en")}
    share = Counter(lang for _, lang in learn)
    for key, text, _ in ROWS:
        got = out[(key, key)]
        if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        total = {}
        for lang, c in counts.items():
            whole = sum(c.values()) + SMOOTHING * BUCKETS
            total[lang] = math.log(share[lang] / len(learn)) + sum(n * math.log((c[b] + SMOOTHING) / whole) for b, n in plain_grams(text).items())
        best = max(sorted(total), key=total.get)
        chance = 1 / sum(math.exp(v - total[best]) for v in total.values())
        assert got["lang_pred"] == best and got["score"] == pytest.approx(chance, abs=1e-9)
    assert identify(df, F.lit(True)).count() == len(ROWS)


def test_nothing_learned_and_empty_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in identify(df, F.lit(False)).collect()} == {"und"}
    assert identify(df.where("false"), F.lit(True)).count() == 0
    assert fit(df.where("false")).langs == []


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    told = identify(docs.withColumn("source", F.lit(None)), ~held_out).join(docs.select("doc_id", "lang"), "doc_id").where(held_out)
    right, every = told.where("lang = lang_pred").count(), told.count()
    assert every > 30 and right / every > 0.95

"""The pipeline on planted cases, and the library without it."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from wattloom.llm.common import word_count, written

ROOT = Path(corpus_pipeline.__file__).parent


def documents(spark):
    rng = random.Random(0)
    words = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(k, " ".join(prose(rng.randint(80, 300))), "en", f"s{k % 3}") for k in range(120)]
    rows += [(200 + k, rows[k][1], "en", "s0") for k in range(20)]  # exact copies
    passage = " ".join(prose(60))
    rows += [(300 + k, " ".join(prose(100)) + " " + passage + " " + " ".join(prose(100)), "en", "s1") for k in range(10)]
    rows += [(400 + k, " ".join(w + "$$$" for w in prose(150)), "en", "s2") for k in range(8)]  # junk
    rows += [(500, None, "en", "s0"), (501, "", None, None), (502, "too short", "en", "s0"), (None, " ".join(prose(100)), None, None), (3, rows[3][1], "en", "s0")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint"), passage


def test_stages(spark):
    docs, passage = documents(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""))
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        kept[name] = docs.collect()
    ids = {n: sorted(str(r["doc_id"]) for r in rows) for n, rows in kept.items()}
    clean = [str(k) for k in range(120)]
    assert ids["quality rules"] == sorted([*clean, "3", *[str(200 + k) for k in range(20)], *[str(300 + k) for k in range(10)], "None"])
    assert ids["SimHash near-dedup"] == ids["suffix-array dedup"] == sorted([*clean, *[str(300 + k) for k in range(10)], "None"])
    with_passage = [r["doc_id"] for r in kept["suffix-array dedup"] if passage in r["text"]]
    assert with_passage == [300] and all(r["n_chars"] == len(r["text"]) for r in kept["suffix-array dedup"])
    assert set(ids["mixing sources to target weights"]) <= set(ids["suffix-array dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r["length"] for r in packed) == docs.select(word_count(docs.text).alias("n")).agg({"n": "sum"}).first()[0]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "bin_id", "bin_length"} <= set(out.columns) and 0 < out.count()


def test_empty_documents(spark, tmp_path):
    docs, _ = documents(spark)
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_library_works_without_the_pipeline(tmp_path):
    shutil.copytree(ROOT / "wattloom", tmp_path / "wattloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)

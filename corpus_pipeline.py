"""Pipeline from documents to packed training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import covering_simhash, pareto_mix, quality_mcd, repeats, variable_packing
from wattloom.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _row_key() -> Column:
    """Document number and a hash of the text: tells rows apart that share a number; a null number sorts last."""
    return F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64("text").alias("text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keyed = docs.select(*COLUMNS, _row_key().alias("_key"))
    kept = quality_mcd.judge(keyed, key="_key").where("kept").select("_key")
    return keyed.join(kept, "_key", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates; of equal rows one."""
    keyed = docs.select(*COLUMNS, _row_key().alias("_key"))
    found = covering_simhash.near_duplicates(keyed, key="_key", shingle=3, radius=3)
    first = found.where(F.col("_key") == F.col("component_id")).select("_key")
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes and more that a document with a smaller number has.

    Characters that a cut halves go whole. A document of which nothing is left stays with an empty text.
    """
    cut = repeats.remove_repeats(docs.select(*COLUMNS), size=50, characters=True)
    text = F.col("kept").cast("string")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = pareto_mix.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a training sequence."""
    return variable_packing.pack_texts(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", long_repeats),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packing),
]

#: Robust estimates, the connected components and the packing have no SQL form; the stages are tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``; what a stage returns is written and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages, each over all that the one before it kept.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; what
it returns is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import common, decontaminate, minhash_dedup, quality_classifier, secret_scan, sentencepiece_sample

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; those without words are rejected."""
    return quality_classifier.classify(docs, carry=True).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one of the smallest doc_id, a null id last, then the first.

    Rows are numbered, so that rows that repeat an id are told apart; and written
    before use, as Spark might number them otherwise when it reads again.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = common.scratch(docs.select(F.monotonically_increasing_id().alias("n"), whole)).select("n", F.col("row.doc_id").alias("own"), F.col("row.text").alias("text"), "row")
    groups = minhash_dedup.near_duplicates(rows, "n").select("doc_id", "component_id")
    groups = groups.join(rows.select("n", "own"), F.col("doc_id") == F.col("n"))
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "n")).alias("best")).select(F.col("best.n").alias("keep"))
    return rows.select("n", "row").join(best, F.col("n") == F.col("keep"), "left_semi").select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"), carry=True).where("kept").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by their kinds, and n_chars is counted anew for those."""
    found = secret_scan.scan_secrets(docs, carry=True)
    hit = F.size("spans") > 0
    new = {"text": F.when(hit, F.col("redacted")).otherwise(F.col("row.text")), "n_chars": F.when(hit, F.char_length("redacted")).otherwise(F.col("row.n_chars")).cast("long")}
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that is left."""
    return sentencepiece_sample.digest(sentencepiece_sample.sample(docs))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scan", secrets),
    ("sentencepiece", pieces),
]
#: Neither trained weights nor hashed draws can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over ``documents``."""
    docs = common.read(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for _, stage in before:
        with common.step() as keep:  # what a stage wrote on its way goes when its result is written
            kept = keep(common.scratch(stage(spark, docs, sf_dir)))
        common.let_go(docs)
        docs = kept
    return last(spark, docs, sf_dir)

"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input.

Each stage works on all rows that the one before kept and returns the columns of
``documents``; the last returns the mix. Further columns are dropped, whatever their
names; an empty table gives an empty one with the same columns at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqtlake.llm import classifier, decontaminate, mixing, near_dup, pii
from eqtlake.llm.common import table
from eqtlake.plans.workspace import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts to be good. Null and empty texts are scored
    as documents without words; rows with a null or repeated id each by their text."""
    scored = classifier.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles at 0.8.

    The smallest id of a group stays. Null and empty texts are near nothing and
    stay, as do rows with a null id; rows that repeat an id stay or go together."""
    kept = near_dup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("k_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark; from those with a hit too
    small to condemn them, the hit words are cut. Null and empty texts have no hits
    and stay; rows with a null or repeated id are judged each by their text."""
    judged = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    clean = judged.where("not contaminated").withColumn("text", decontaminate.cut(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in the text replaced by its kind; null texts stay
    null. Of spans that overlap the first by start gives the label."""
    clean = pii.redact(F.col("text"), F.col("pii"))
    return (
        pii.annotate(docs.select(*COLUMNS))
        .withColumn("text", F.when(F.col("text").isNotNull(), clean))
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(*COLUMNS)
    )


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the rows by source: how many words of each are taken. A null source
    is a source; null and empty texts take nothing; ties go by id and size."""
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("source_mixing", source_mixing),
]

#: The classifier is trained and near-duplicates are components, so SQL has no
#: such rows; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

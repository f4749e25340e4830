"""From documents to training tokens: quality, near-duplicates, personal data, mixing, SentencePiece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import jaccard, mixing, pieces, pii, quality
from folioforge.llm.common import prepared, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labels of this input, scores 0.5 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("quality_score >= 0.5").drop("quality_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word-shingle similarity 0.8 or more."""
    prepared(spark)
    return jaccard.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that disclose it; n_chars is that of the new text."""
    prepared(spark)
    return pii.sanitise(docs).withColumn("text", F.col("pii_text")).withColumn("n_chars", F.char_length("pii_text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and the piece ids of each row's text."""
    prepared(spark)
    return pieces.encode(docs, pieces.load()).select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", sanitise),
    ("mixing", mix_sources),
    ("sentencepiece", tokenise),
]

#: SQL has no compression classifier and no SentencePiece: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""The corpus pipeline: STAGES applied in order to documents.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame that is written and read again as the next one's
docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import mixing, quality
from lodestone.llm.near_dedup import one_per_group
from lodestone.llm.queries import tokenised, tokenizer_path
from lodestone.llm.suffix_dedup import repeated_strings
from lodestone.shared import Scratch

#: A document is rejected when the classifier puts its odds of being good below this.
KEPT_QUALITY = 0.5
#: Bytes of a string that is removed where it occurs more than once: well under 50 words.
REPEATED_BYTES = 200


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train_quality(docs, labels)
    scored = quality.score_quality(docs, model, keep_text=True)
    return scored.where(F.col("quality_score") >= KEPT_QUALITY).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    return one_per_group(docs, shingle=5, percent=80)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur more than once; n_chars follows, documents stay even when nothing is left."""
    found = repeated_strings(docs, length=REPEATED_BYTES)
    text = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[text.get(c, F.col(c)).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time a document is taken; the last of a source may be cut after a word."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's text."""
    return tokenised(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", suffix_stage),
    ("source_mixing", mixing_stage),
    ("bpe_tokens", tokens_stage),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are written to the shared folder before the next reads them."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs

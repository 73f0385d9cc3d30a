"""The corpus pipeline: documents that pass the rules and the classifier, one of each group of near duplicates,
without passages that an earlier document holds, packed into training sequences.

Each stage takes (spark, docs, sf_dir) and gets all that its predecessor kept; all but the last return the columns
of documents. run() writes each stage's result to the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescape.llm import classifier, jaccard, packing, rules, suffixes
from rolescape.llm.common import shared_dir, table
from rolescape.llm.queries import word_vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside their compression bands that also pass the base rules. Null and empty texts go; a row is judged
    by its text alone, whatever its key or repeats; an empty table gives an empty result."""
    return rules.passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be good by a network trained on the labels of this stage's documents. A row is judged by its
    text alone, a null one as an empty one; without labelled documents all stay; an empty table gives an empty result."""
    return classifier.good(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked ones: that with the smallest doc_id (null is the largest), of repeated
    rows the first stored. Texts without words stay; an empty table gives an empty result."""
    return jaccard.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller doc_id holds (null is the largest; rows of one doc_id count
    as one document); n_chars counts what is left. None goes, a null text stays null; an empty table gives an empty result."""
    kept = suffixes.clean(docs)
    return kept.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequences and offsets; a null or empty text is its end id alone, repeated rows are
    packed as often as they occur, and an empty table gives an empty result."""
    return packing.pack(docs, word_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]

#: The bands compress, the network and the packing compute: no SQL form. The stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

"""From documents to training sequences: quality, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before kept, as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import common, decontaminate, jaccard_join, line_dedup, packing, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is scored like any other, rows without doc_id are judged by their text, repeated rows alike; an empty
    table stays empty; without labels nothing goes. Extra columns, whatever their names, pass through here and in all stages.
    """
    return quality.accept(docs, quality.training(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars, where the table has it, follows the text.

    A null text stays null, with null n_chars; rows without doc_id lose repeated lines and never hold the one that stays; rows that
    repeat a doc_id count as one document. No row goes, one that loses all its lines stays with an empty text.
    """
    out = line_dedup.dedup_lines(docs)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, that of the smallest doc_id.

    Rows are judged by their own texts, so of repeated rows one stays; null, empty and blank texts are linked with nothing, and all
    their rows stay.
    """
    return jaccard_join.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null and empty texts have no words and stay; repeated rows are judged alike."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, as pieces of documents. A null or empty text is the end id alone; repeated rows are packed once each."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = common.workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.store(docs, f"{path}/{i}")
    return docs


#: SQL can't express the classifier or the tokens; tests/llm checks the stages.
ORACLE_SQL = None

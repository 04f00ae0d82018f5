"""Corpus cleaning in stages; each works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm import decontaminate, line_dedup, ngram_join, quality, sentence_pieces
from gatelake.llm.common import bounded_broadcast, read_table
from gatelake.session import materialize


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Documents without those of a column of ids. A null id is never among them."""
    gone = materialize(ids.where("doc_id is not null").distinct(), name)
    return docs.join(bounded_broadcast(gone), "doc_id", "left_anti").select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of those given, does not reject."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scores = quality.score(docs, model)
    return _without(docs, scores.where("predicted = 0").select("doc_id"), "rejected")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus; those that lose all their text go."""
    cut = line_dedup.remove_repeats(docs)
    lost = (F.size("cut_lines") > 0) & (F.trim(F.translate("text", "\n\r\t", "   ")) == "")
    length = F.when(F.size("cut_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~F.coalesce(lost, F.lit(False))).withColumn("n_chars", length).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    groups = ngram_join.join_documents(docs)
    return _without(docs, groups.where("doc_id <> component_id").select("doc_id"), "near-copies")


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = decontaminate.find_passages(docs, read_table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id"), "contaminated")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left."""
    return sentence_pieces.encode(docs)


STAGES = [
    ("quality", good_quality), ("line_dedup", without_repeated_lines), ("near_duplicates", one_of_near_copies),
    ("decontamination", without_benchmark_passages), ("tokens", tokens),
]

#: The classifier and the tokens of the stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

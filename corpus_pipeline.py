"""Documents to a training mix: good, distinct, uncontaminated, redacted, weighted.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame, which ``run`` writes as Parquet and reads again. All of
them take null in any column, empty and very long texts, repeated rows, empty
tables (none come out) and columns of any other names, which they pass on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import common, decontaminate, mixing, pii, quality, similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts are rejected; repeated rows are judged alike."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The least id stays, null ids last; null and empty texts are one group; of
    repeated rows one stays.
    """
    return similar.keep_one_of_similar(docs, shingle_words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows are judged alike."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. Null and empty texts stay; repeated rows are treated alike."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, once and whole, with the words that the mix takes of each.

    ``taken`` is the decision: 0 leaves a document out of the mix, more than its
    size repeats it, and what reads the table draws that many words of it. Null and
    empty texts have no words to take; repeated rows are documents of their own.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: SimHash, alignment and the span classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return docs

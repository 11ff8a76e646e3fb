"""A corpus pipeline of five stages: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes the documents that its predecessor kept, whole, and returns a
DataFrame; ``run`` writes every stage as Parquet in the shared folder and reads it
back, so a lost executor costs no more than the stage at hand. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandforge.llm import exact_dedup, mixing, packing, simhash, toxicity
from strandforge.llm.queries import vocabulary
from strandforge.session import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go; null and empty texts score the bias alone, repeated rows and null ids stay or go by their text, and so do very long ones."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row of the largest doc_id stays, null ids last; null counts as empty, and of rows that share id and text one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints, that of the least doc_id stays, null ids last; null and wordless texts have fingerprint zero and are linked."""
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three times, or not at all; null sources are one source, texts without words come once at most."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; a document taken twice is packed twice, a null or empty text is its end id alone, and only longer ones are cut."""
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("source mix", mix_sources), ("packing", pack_sequences)]

#: SQL cannot express the classifier, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

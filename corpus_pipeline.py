"""The corpus pipeline: five stages over `documents`, each by one operator.

Every stage works on all rows that the one before it kept. All but the last
return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.decontamination import drop_contaminated
from tessera.llm.language_id import drop_unidentified, train
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.packing import pack_documents
from tessera.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that no language fits: no letter, or 50 letters and more that the best language makes improbable."""
    return drop_unidentified(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier place has, the same or similar; documents that lost every line go."""
    out = dedup_lines(docs).where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, words=5, min_similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that share ten consecutive words with the benchmark, those without a doc_id included."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return pack_documents(docs, capacity=1024)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: SQL can't express the fingerprints and tokens; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs

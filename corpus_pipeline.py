"""The corpus pipeline: quality rules, near-dedup, decontamination, surrogates, packing.

Each stage takes what the stage before it kept and all but the last return the columns of ``documents``.  Between
stages the rows are written as Parquet to the shared folder and read again, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krylark.llm import decontaminate, pii, quality_rules, simhash
from krylark.llm.common import discard, materialize, read_table, shared_dir, spread
from krylark.llm.queries import pack_query


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go.

    Null and empty texts have no words and go; very long texts are measured whole; repeated rows stay or go alike; an
    empty table stays empty; other columns, whatever their names, are kept.
    """
    return quality_rules.keep_documents(spread(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Of rows that share that id the one with the smallest hash of its text stays, of repeated rows one; rows without an id
    stay, once for each text; null and empty texts are copies of each other.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; rows that share an id share the verdict, null ids too; an empty benchmark, or null items,
    reject nothing.
    """
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; the count of characters follows the text.

    Null and empty texts, repeated rows and all other columns, whatever their names, stay as they are; a null text keeps
    its count.
    """
    out = pii.replace_text(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens.

    Null and empty texts have their end token alone, null sources are one source, null ids stay null, and repeated rows are
    packed as often as they occur; no rows give no pieces.
    """
    return pack_query(docs)


STAGES = [("quality_rules", quality), ("simhash_dedup", near_dedup), ("decontamination", decontamination), ("pii", private_data), ("packing", pack)]

#: SQL cannot express the fingerprints and the tokenizer; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a table between two stages is deleted once the table after it is written."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark)
            docs = materialize(docs, path)
            if last:
                discard(spark, last)
            last = path
    return docs

"""A corpus pipeline over the documents table: every stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dockpulse.llm import digest_index, minhash, mixing, packing, quality, simhash
from dockpulse.llm.workspace import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep. Null, empty and wordless texts go; repeated rows are judged alike; texts of any length whole; no rows give no rows."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space apart: the longest, then the smallest doc_id (null last). Null counts as empty; no rows give no rows."""
    return digest_index.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash fingerprints of two differing bits or fewer, or by a Jaccard similarity of 0.8 or more over shingles of five words:
    the smallest doc_id (null last). Texts without words, null ones too, are one group; texts of any length count whole; no rows give no rows."""
    return simhash.drop_near_duplicates(docs, minhash.grouped)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Texts without words, null ones too, stay once; a null source is the last one; no rows give no rows."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; `uid` tells the copies of a document apart. A null text is one end id; no rows give no rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing_sources),
    ("packing", best_fit_packing),
]

# Expectation-maximisation, linked groups, Newton steps and bin packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs

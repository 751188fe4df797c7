"""The operators of this subpackage as queries over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockpulse.llm import digest_index, licenses, mixing, packing, pii, quality, resample, simhash, suffix_tree, toxicity, urls, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    page = lambda c: F.substring_index(c, ":", -1).cast("bigint")
    return warc.archive_pages(spark, _table(spark, sf_dir, "pages")).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


OP1_SQL = """
  with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
  f as (select payload_digest, min(page_id) least from p where payload_bytes >= 100 group by 1)
  select page_id, payload_bytes, p.payload_digest,
         case when least is null or page_id = least then 'response' else 'revisit' end record_type,
         case when page_id <> least then least end refers_to
  from p left join f on p.payload_digest = f.payload_digest and payload_bytes >= 100"""


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the suffix tree of the learned ones."""
    return suffix_tree.score(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays, by way of a new digest index."""
    found = digest_index.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
  with d as (select doc_id, length(coalesce(text, '')) n,
                    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256 from documents),
  g as (select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) keep_id,
               count(*) over (partition by text_sha256) group_size from d)
  select doc_id, keep_id, group_size, doc_id = keep_id kept, text_sha256 from g"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity, learned from the labels."""
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and the verdict of the weighed rules."""
    found = quality.judge(_table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, "base_failed", "kept", "quality")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(_table(spark, sf_dir, "documents")).drop("uid")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path and verdict."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its group."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence notice, if it has one."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark, and its rank if it is drawn."""
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the places of personal data in it."""
    return pii.scan(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite embedding on the sixteen leading components, each scaled to variance one."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_simhash": op9_simhash,
    "op10_license_scan": op10_license_scan,
    "op11_resampling": op11_resampling,
    "op12_pii": op12_pii,
    "op13_whitening": op13_whitening,
}
SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op10_license_scan": licenses.oracle(),
}

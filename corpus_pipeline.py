"""From documents to token ids: quality rules, near-duplicates, secrets, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, mixing, quality, secrets, simhash
from sparkloom.llm.common import MADE, remove_made, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
NEAR_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep.

    A text that is null, empty or under 20 words goes; repeated rows are judged alike; without labels of both kinds only the
    counts decide; an empty table gives an empty one. As in all stages, texts of any length are read whole, and columns other than those of
    documents are left out.
    """
    return quality.judge_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, found by wide fingerprints and checked exactly.

    The smallest doc_id stays (null last). Null, empty and wordless texts are copies of each other; of repeated rows one stays; an
    empty table gives an empty one.
    """
    return simhash.drop_near_copies(docs.select(*COLUMNS), width=NEAR_WORDS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; n_chars follows the text where that changed.

    Null and empty texts stay as they are, repeated rows stay repeated, and an empty table gives an empty one.
    """
    found = secrets.scan_secrets(docs.select(*COLUMNS), shared_folder(spark, "ledger"))
    some = F.size("secrets") > 0
    clean = found.withColumn("_text", F.when(some, secrets.redact("text", F.col("secrets"))).otherwise(F.col("text")))
    n_chars = F.when(some, F.length("_text").cast("long")).otherwise(F.col("n_chars"))
    return clean.select("doc_id", F.col("_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null or empty text counts no words but is taken like others of its source; a null source is one like any other; repeated
    rows are taken equally often; an empty table gives an empty one.
    """
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed) and ids_sha256 of every row; a null or empty text has no ids."""
    out = bpe.encode_texts(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scan", secret_scan), ("mixing", mix_sources), ("encoding", encode)]

#: The stages train a classifier, link fingerprints and encode: SQL can't express them. tests/llm/test_pipeline.py holds each to plain Python or SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder and read again, then all that led to them is removed."""
    docs, since = table(spark, sf_dir, "documents"), len(MADE)
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove_made(spark, since, but=path)
    return docs

"""The operators applied to their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, divergence, lm, mixing, oracles, quality, resample, secrets, sharding, simhash, suffix, topk, urls
from sparkloom.llm.common import shared_folder, table

# The host rules of op3.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_chats(chats), arranged=True)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_report(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"), most=4, width=4)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_quality(docs, table(spark, sf_dir, "labels")).drop("text")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.scan_secrets(docs, shared_folder(spark, "ledger"))
    found = F.col("secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = secrets.as_string(F.filter(found, lambda s: s["kind"].isin(*secrets.BASE)))
    return out.select("doc_id", *map(count, secrets.BASE), F.sha2(base, 256).alias("base_sha256"), secrets.as_string(found).alias("spans"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"), least=30, top=50)


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.score_texts(table(spark, sf_dir, "documents"), ~lm.held_out(F.col("doc_id")))
    return scores.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10, bottom=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_chat, op3_urls, op4_shards, op5_bpe, op6_simhash, op7_topk, op8_quality, op9_secrets, op10_suffix, op11_divergence, op12_lm, op13_resample)
}
ORACLES: dict[str, str] = {
    "op1_mix": mixing.MIX_SQL,
    "op2_chat": chat.CHAT_SQL,
    "op6_simhash": oracles.SIMHASH_SQL,
    "op7_topk": topk.TOP_SQL,
    "op9_secrets": oracles.SECRETS_SQL,
    "op10_suffix": oracles.REMOVAL_SQL,
    "op11_divergence": divergence.AUDIT_SQL,
    "op13_resample": resample.RESAMPLE_SQL,
}

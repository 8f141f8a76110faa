"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, bpe, chat, forest, hosts, jaccard, manifest, maxent, neardup, packing, pii, quality, whitening
from .common import table
from .oracle import SQL

__all__ = ["QUERIES", "SQL"]


def vocabulary(name: str) -> str:
    """A public vocabulary's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels' ids stand for page ids: the tables have no other outcome of pages."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("case when quality = 0 or toxic = 1 then 1 when quality is not null or toxic is not null then 0 end").alias("bad"))
    return hosts.judge_pages(table(spark, sf_dir, "pages"), outcomes).withColumns({c: F.round(c, 6) for c in ("bad_share", "bad_share_low")})


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(probe)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"), words=4, percent=85)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_hosts": op2_hosts,
    "op3_chat": op3_chat,
    "op4_bpe": op4_bpe,
    "op5_jaccard": op5_jaccard,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_forest": op8_forest,
    "op9_maxent": op9_maxent,
    "op10_neardup": op10_neardup,
    "op11_whitening": op11_whitening,
    "op12_bestfit": op12_bestfit,
    "op13_manifest": op13_manifest,
}

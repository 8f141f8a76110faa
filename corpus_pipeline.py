"""A corpus pipeline out of the operators: reject, deduplicate, redact, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huskline.llm import jaccard, packing, pii, quality
from huskline.llm.common import discard, stash, table
from huskline.llm.queries import vocabulary


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labelled ones, does not reject.

    A null text is judged as an empty one; rows without doc_id and repeated rows are judged each, equal rows alike; a long text is judged
    whole; an empty table stays empty; without labels of both kinds nothing is told apart; all columns stay, whatever their names."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one of least id.

    Null, empty and blank texts are near nothing and stay; of rows with one doc_id one stays; rows without doc_id all stay; a long text is compared
    whole; an empty table stays empty; all columns stay, whatever their names."""
    return jaccard.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind, and their new length.

    A null text stays null and has a null length; empty texts, rows without doc_id and repeated rows stay as they are, redacted each; a long text is redacted whole;
    an empty table stays empty; all columns stay, whatever their names."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1,024 tokens, mixed by source.

    A null or empty text is one token; rows without doc_id and repeated rows are packed each; a long text is cut as often as needed; an empty table has no
    pieces; other columns are left out."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_poor),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: No SQL: a trained classifier and a tokenizer take part.  tests/llm holds the operators of the stages against brute force, and runs the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = []
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

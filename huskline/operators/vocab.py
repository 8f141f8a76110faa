"""Vocabularies: token counts, most frequent first.  Counts are summed within each task before they are shuffled, so common tokens do no harm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import KEYWORDS, lex, preclean, split_names
from .ranges import numbered

MODES = ("split_keyword", "nosplit_keyword", "only_keyword", "split_simple", "name_op")


def tokens(lines: DataFrame, mode: str) -> DataFrame:
    """token: one row for each counted token of `lines` (line)."""
    line = preclean(F.col("line")) if mode == "split_simple" else F.col("line")
    found = lex(line)
    if mode == "only_keyword":
        found = F.filter(found, lambda t: t["tok"].isin(KEYWORDS) | (t["kind"] == "OP"))
    found = F.filter(found, lambda t: t["kind"].isin("NAME", "OP"))
    if mode in ("split_keyword", "split_simple"):
        found = split_names(found)
    return lines.select(F.explode(found).alias("t")).select(F.col("t.tok").alias("token"))


def vocabulary(lines: DataFrame, mode: str, limit: int = -1) -> DataFrame:
    """rank (from 1), token, cnt; ties by token; limit -1 keeps all.

    A limit is a top-k, and its few rows are ranked in one task; ranks over all tokens are taken within ranges and moved by the sizes of the ranges before."""
    counts = tokens(lines, mode).groupBy("token").agg(F.count("*").alias("cnt"))
    if limit < 0:
        return numbered(counts, {"_down": -F.col("cnt"), "_name": F.col("token")}).select(F.col("place").cast("int").alias("rank"), "token", "cnt")
    counts = counts.orderBy(F.desc("cnt"), "token").limit(limit)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "token"))).select("rank", "token", "cnt")


def file_identifiers(lines: DataFrame, top: int | None = None) -> DataFrame:
    """doc_id, token, cnt of names that are no keywords; the `top` of each file if given."""
    names = lines.select("doc_id", F.explode(lex(F.col("line"))).alias("t")).where((F.col("t.kind") == "NAME") & ~F.col("t.tok").isin(KEYWORDS))
    counts = names.groupBy("doc_id", F.col("t.tok").alias("token")).agg(F.count("*").alias("cnt"))
    if top is None:
        return counts
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("cnt"), "token"))).where(F.col("place") <= top).drop("place")


def gaps(vocab: DataFrame) -> DataFrame:
    """size, distinct tokens, ranks missing between the least and the greatest."""
    return vocab.agg(F.count("*").alias("size"), F.count_distinct("token").alias("tokens"), (F.max("rank") - F.min("rank") + 1 - F.count_distinct("rank")).cast("long").alias("gaps"))

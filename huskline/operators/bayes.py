"""A line classifier that is counts: multinomial naive Bayes over tokens.  Counts add up, so it trains on rows as they come."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lex, preclean


def token_array(line: Column) -> Column:
    """What is counted of a line: names and operators by themselves, other tokens by kind."""
    return F.transform(lex(preclean(line)), lambda t: F.when(t["kind"].isin("NAME", "OP"), t["tok"]).otherwise(F.concat(F.lit("<"), t["kind"], F.lit(">"))))


def line_tokens(lines: DataFrame, key: list[str]) -> DataFrame:
    """key columns, token: one row a token."""
    return lines.select(*key, F.explode(token_array(F.col("line"))).alias("token"))


def counts(lines: DataFrame) -> DataFrame:
    """token, code, doc: how often it stands in lines of each label.  Adding two such tables trains on both."""
    is_doc = F.col("label") == 1
    return line_tokens(lines, ["label"]).groupBy("token").agg(F.count_if(~is_doc).alias("code"), F.count_if(is_doc).alias("doc"))


def kept(table: DataFrame) -> DataFrame:
    """`table`, worked out once for all that reads it: written to the folder that executors share (spark.checkpoint.dir), or kept on a single machine; as it is where neither is the case."""
    context = table.sparkSession.sparkContext
    if context.getCheckpointDir():
        return table.checkpoint()
    return table.localCheckpoint() if context.master.partition("[")[0] == "local" else table


def added(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("token").agg(F.sum("code").alias("code"), F.sum("doc").alias("doc"))


def model(counted: DataFrame) -> DataFrame:
    """token, code, doc, odds: natural log of its smoothed share in documentation over that in code."""
    total = counted.agg(F.sum("code").alias("all_code"), F.sum("doc").alias("all_doc"), F.count("*").alias("types"))
    odds = F.log((F.col("doc") + 1) / (F.col("all_doc") + F.col("types"))) - F.log((F.col("code") + 1) / (F.col("all_code") + F.col("types")))
    return counted.join(F.broadcast(total)).select("token", "code", "doc", odds.alias("odds"))


#: Shares that the rows of one token are dealt over, so that the commonest token is not one task's.
SALTS = 16


def on_token(rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """`rows` (key columns, token) joined to `table` by token; a token's rows are dealt over `SALTS` shares by key."""
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).join(salted, ["token", "_salt"], how).drop("_salt")


#: Occurrences in training from which on a token of a model counts as common.  There are at most the trained tokens over this number of them.
COMMON = 100_000


def on_common(rows: DataFrame, trained: DataFrame, key: list[str]) -> DataFrame:
    """As `on_token` with a model, but only common tokens are dealt over shares, so that a large model is not copied as often."""
    often = F.col("code") + F.col("doc") >= COMMON
    last = F.when(often, SALTS - 1).otherwise(0)
    salted = trained.select("token", "odds", F.explode(F.sequence(F.lit(0), last)).alias("_salt"))
    known = rows.join(F.broadcast(trained.where(often).select("token", F.lit(SALTS).alias("_shares"))), "token", "left")
    return known.withColumn("_salt", F.pmod(F.xxhash64(*key), F.coalesce("_shares", F.lit(1))).cast("int")).join(salted, ["token", "_salt"]).drop("_salt", "_shares")


def joined_score(lines: DataFrame, trained: DataFrame, key: list[str]) -> DataFrame:
    """key columns, score, by a join on the tokens: for models of any size."""
    # Equal tokens of a line are one row before the join.
    used = on_common(line_tokens(lines, key).groupBy(*key, "token").agg(F.count("*").alias("times")), trained, key)
    summed = used.groupBy(*key).agg(F.sum(F.col("times") * F.col("odds")).alias("sum"))
    return lines.select(*key).join(summed, key, "left").select(*key, probability(F.coalesce("sum", F.lit(0.0))).alias("score"))


def probability(odds: Column) -> Column:
    return F.round(1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0)))), 6)


#: Tokens of a model, and bytes of them, up to which its weights go to every task.
MOST_SENT, MOST_BYTES = 4_000_000, 1 << 27


def sent_weights(trained: DataFrame) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
    """The model's hashes in order, with the odds and the token of each; None if it is too large to be sent, or if two of its tokens have one hash."""
    size = trained.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("bytes")).first()
    if size.n > MOST_SENT or size.bytes > MOST_BYTES:
        return None
    known = trained.select(F.xxhash64("token").alias("hash"), "odds", "token").toArrow().sort_by("hash").combine_chunks()
    hashes, odds = known["hash"].to_numpy(), known["odds"].to_numpy()
    if (hashes[1:] == hashes[:-1]).any():
        return None
    return hashes, odds, pa.concat_arrays([pa.array([], pa.string()), *known["token"].chunks])


def added_odds(tokens: pa.Array, weights: tuple[np.ndarray, np.ndarray, pa.Array]) -> np.ndarray:
    """Odds of each token array (of token and hash), added in order.  A token is looked for by its hash, and must be the one that is found there."""
    hashes, odds, names = weights
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    flat = tokens.flatten()
    if not len(hashes) or not len(flat):
        return np.zeros(len(tokens))
    own, asked = flat.field("token"), flat.field("hash").to_numpy()
    at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
    hit = np.flatnonzero(hashes[at] == asked)
    hit = hit[pc.equal(own.take(pa.array(hit)), names.take(pa.array(at[hit]))).to_numpy(zero_copy_only=False)]
    return np.bincount(np.repeat(np.arange(len(tokens)), lengths)[hit], odds[at[hit]], len(tokens))


def sum_of_odds(tokens: Column, weights: Broadcast) -> Column:
    """Odds of a token array, added within the row."""

    @F.arrow_udf("double")
    def told(batch: pa.Array) -> pa.Array:
        return pa.array(added_odds(batch, weights.value))

    return told(F.transform(tokens, lambda t: F.struct(t.alias("token"), F.xxhash64(t).alias("hash"))))


def scored(lines: DataFrame, trained: DataFrame, key: list[str], text: str = "line") -> DataFrame:
    """`lines` with score: probability of documentation of `text`, at equal prior; lines without a known token get 0.5.

    No shuffle, as the weights (of `sent_weights`) go to the rows; a model of more than `MOST_SENT` tokens is joined instead, by key."""
    weights = sent_weights(trained)
    if weights is None:
        return lines.join(joined_score(lines.withColumn("line", F.col(text)), trained, key), key)
    sent = lines.sparkSession.sparkContext.broadcast(weights)
    return lines.withColumn("score", probability(sum_of_odds(token_array(F.col(text)), sent)))


def score(lines: DataFrame, trained: DataFrame, key: list[str]) -> DataFrame:
    """key columns, score of `line`."""
    return scored(lines, trained, key).select(*key, "score")

"""Samples, balance and splits, by hash of a key: repeatable, and the same on any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(key: Column, seed: int = 42, buckets: int = 10_000) -> Column:
    """A number below `buckets` from the md5 of key and seed."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("long") % buckets


def fraction(rows: DataFrame, key: Column, share: float, seed: int = 42) -> DataFrame:
    return rows.where(bucket(key, seed) < int(share * 10_000))


def draw(rows: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows: a top-k by hash, so no full sort."""
    return rows.orderBy(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), key).limit(n)


def draws(rows: DataFrame, key: Column, n: int, times: int) -> DataFrame:
    """`times` draws of n rows each, numbered by `draw`: the n least by hash.

    Copies are made only of rows whose hash lies below a bound that a little more than n rows are expected to pass; should a draw
    have fewer, the bound is doubled.  So no draw is sorted as a whole, and the rows are those of a full sort."""
    total = rows.count()
    order = lambda i: F.md5(F.concat(key.cast("string"), F.lit("-"), i.cast("string")))
    share = (n + 6 * n**0.5 + 20) / max(1, total)
    while True:
        # Hashes are texts of hexadecimal digits, so their order is that of the numbers.
        bound = F.lit(f"{min(int(share * 16**8), 16**8 - 1):08x}")
        passed = F.filter(F.sequence(F.lit(1), F.lit(times)), lambda i: F.substring(order(i), 1, 8) <= bound)
        copies = rows.withColumn("draw", F.explode(passed))
        if share >= 1 or (held := [r["count"] for r in copies.groupBy("draw").count().collect()]) and len(held) == times and min(held) >= n:
            break
        share *= 2
    return copies.withColumn("place", F.row_number().over(Window.partitionBy("draw").orderBy(order(F.col("draw")), key))).where(F.col("place") <= n).drop("place")


#: Parts of a label that rank their rows apart, so that no task holds a label.
PARTS = 64


def ranked(rows: DataFrame, key: Column, label: str = "label", seed: int = 42) -> DataFrame:
    """Rows with `place`: rank within the label by hash.  Ranks are taken within ranges of the hash and moved by the sizes of the ranges below, so a label is never in one task."""
    hashed = rows.withColumn("_h", F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))).withColumn("_part", (F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * PARTS / 65536).cast("int"))
    sizes = hashed.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    below = sizes.withColumn("_below", F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = hashed.withColumn("_own", F.row_number().over(Window.partitionBy(label, "_part").orderBy("_h", key)))
    return within.join(F.broadcast(below), [label, "_part"]).withColumn("place", (F.col("_own") + F.col("_below")).cast("long")).drop("_h", "_part", "_own", "_below")


def balanced(rows: DataFrame, key: Column, label: str = "label", only: int | None = None, seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarer has; with `only`, that label alone is cut, to the size of the other."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    least = counts.agg(F.min("n").alias("most")) if only is None else counts.where(F.col(label) != only).agg(F.sum("n").alias("most"))
    placed = ranked(rows, key, label, seed).join(F.broadcast(least))
    fits = F.col("place") <= F.col("most")
    return placed.where(fits if only is None else (F.col(label) != only) | fits).drop("place", "most")


def stratified(rows: DataFrame, key: Column, share: float, label: str = "label", seed: int = 42) -> DataFrame:
    """Rows with `part`: 'test' for this share of every label, else 'train'."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    placed = ranked(rows, key, label, seed).join(F.broadcast(counts), label)
    return placed.withColumn("part", F.when(F.col("place") <= F.floor(F.col("_n") * share), "test").otherwise("train")).drop("place", "_n")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight: with it, every label weighs as much."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return counts.join(F.broadcast(total)).select(label, "n", F.round(F.col("_all") / (F.col("_k") * F.col("n")), 6).alias("weight"))


def interleaved(rows: DataFrame, key: Column, label: str = "label", seed: int = 42) -> DataFrame:
    """Rows with `position`, from 0: labels take turns, and each label's rows come in seeded order, again and again, until the largest label is through.

    So every run of as many rows as there are labels has one of each.  No task holds a label; the rows are at most the labels times the largest of them."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    one = Window.orderBy(label)  # a row a label
    turns = counts.select(label, "_n", (F.row_number().over(one) - 1).alias("_turn"), F.max("_n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_most"), F.count("*").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_k"))
    placed = ranked(rows, key, label, seed).join(F.broadcast(turns), label)
    again = placed.withColumn("_round", F.explode(F.sequence(F.col("place") - 1, F.col("_most") - 1, F.col("_n"))))
    return again.withColumn("position", F.col("_round") * F.col("_k") + F.col("_turn")).drop("place", "_n", "_turn", "_most", "_k", "_round")

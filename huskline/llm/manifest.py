"""Operator 13: Merkle manifest of a dataset, with a proof for every row, by slot pivots.

A row's leaf is the digest of its columns.  Leaves of a language are ranked by doc_id: rows are range-partitioned,
numbered within their partition, and moved by the sizes of the partitions before.  A level groups eight
consecutive nodes: conditional aggregates spread a parent's children over eight slot columns, which are
combined in each task before they are shuffled; the columns' concatenation is hashed, and leaving out one slot's own column
gives that child's siblings.  The languages' subroots form a tree of the same kind, whose top is the root.  Proofs are handed down
from the root, level by level, from parents to children, so only the level above the leaves is as large as
an eighth of the rows; leaves themselves are shuffled as digests, never as texts.

Defined results: a null column counts as `-`, an empty text as `0:`; a null lang is a language of its own, before all others and apart from
the empty one; rows without doc_id come first in their language; equal doc_ids are ordered by their leaf, and equal
rows in any order, as they are alike; a long text is hashed whole; a sole row is subroot and root, and its
proof is the digest of nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, discard, stash

FANOUT = 8
#: One in so many rows, by the hash of doc_id, is tampered with.
TAMPERED = 3
#: Partition starts that are sent to all tasks; where there are more they are joined by shuffle.
MOST_SENT = 100_000
SLOTS = range(FANOUT)


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (doc_id.cast("string"), source, lang, n_chars.cast("string"), text)]
    return digest(F.concat(*parts))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the language's name as a key without nulls), leaf, altered (leaf of the tampered row, null where not tampered), place."""
    rows = docs.select(column(docs, "doc_id", "long"), column(docs, "source", "string"), column(docs, "lang", "string"), column(docs, "n_chars", "long"), column(docs, "text", "string"))
    c = {name: F.col(name) for name in rows.columns}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    altered = F.when(hit, leaf(**c | {"text": F.translate("text", ascii_uppercase, ascii_lowercase)}))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return stash(rows.select("doc_id", tree.alias("tree"), leaf(**c).alias("digest"), altered.alias("altered"), F.monotonically_increasing_id().alias("place")))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The rows of each `tree`, with idx, their place from 0 in `order`, and size, the number of the tree's rows; no task holds a tree."""
    made = stash(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()))
    runs = made.groupBy(F.shiftright("at", 33).alias("part"), "tree").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("k").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stash(runs.select("part", "tree", (before - F.col("first")).alias("move"), F.sum("k").over(whole).alias("size")))
    small = F.broadcast(starts) if starts.limit(MOST_SENT + 1).count() <= MOST_SENT else starts
    told = made.withColumn("part", F.shiftright("at", 33)).join(small, ["part", "tree"])
    return told.select(*rows.columns, (F.col("at") + F.col("move")).alias("idx"), "size")


def level_above(nodes: DataFrame, *carried: str) -> DataFrame:
    """The parents of `nodes` (tree, idx, size, digest): slot columns digest0 to digest7, those of carried columns, and the parents' own idx, size and digest."""
    spread = [F.expr(f"max(CASE WHEN idx % {FANOUT} = {k} THEN {name} END) AS {name}{k}") for name in ("digest", *carried) for k in SLOTS]
    pivot = nodes.groupBy("tree", F.expr(f"idx div {FANOUT} AS idx"), F.expr(f"(size + {FANOUT - 1}) div {FANOUT} AS size")).agg(*spread)
    return pivot.withColumn("digest", F.expr(f"sha2({joined(SLOTS)}, 256)"))


def joined(slots) -> str:
    """SQL for the digests of these slots, one after the other."""
    return f"concat({', '.join(['\'\'', *[f'coalesce(digest{k}, \'\')' for k in slots]])})"


def levels(nodes: DataFrame, *carried: str) -> list[DataFrame]:
    """The tables of parents from the leaves up, until every tree has one node; the first has the carried columns."""
    made: list[DataFrame] = []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        made.append(stash(level_above(nodes.where("size > 1"), *carried)))
        nodes, carried, most = made[-1].select("tree", "idx", "size", "digest"), (), -(-most // FANOUT)
    return made


def tops(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """tree and digest of each tree's last node."""
    out = nodes.where("size = 1").select("tree", "digest")
    for level in above:
        out = out.unionByName(level.where("size = 1").select("tree", "digest"))
    return out


def handed_down(level: DataFrame, known: DataFrame, *carried: str) -> DataFrame:
    """The children of a level's nodes: tree, idx, digest, the carried columns, and path, each step's left and right siblings from there to the root.

    known: tree, idx, path and further columns of the nodes of the level."""
    told = [c for c in known.columns if c not in ("tree", "idx", "path")]
    each = [", ".join([f"idx * {FANOUT} + {k} AS idx", f"digest{k} AS digest", *[f"{c}{k} AS {c}" for c in carried], f"struct({joined(range(k))} AS left, {joined(range(k + 1, FANOUT))} AS right) AS step"]) for k in SLOTS]
    children = f"explode(array({', '.join(f'struct({x})' for x in each)})) AS child"
    rows = level.drop("digest").join(known, ["tree", "idx"]).selectExpr("tree", "path", *told, children).where("child.digest is not null")
    return rows.selectExpr("tree", "child.idx", "child.digest", *[f"child.{c}" for c in carried], "concat(array(child.step), path) AS path", *told)


def proofs(nodes: DataFrame, above: list[DataFrame], start: DataFrame, *carried: str) -> DataFrame:
    """tree, digest, the carried columns, path and what `start` (tree, path, more) says of each tree, for every leaf."""
    known = None
    for i in range(len(above) - 1, -1, -1):
        begun = above[i].where("size = 1").select("tree", "idx").join(start, "tree")
        known = begun if known is None else known.select(begun.columns).unionByName(begun)
        known = handed_down(above[i], known, *(carried if i == 0 else ()))
    alone = nodes.where("size = 1").select("tree", "digest", *carried).join(start, "tree")
    return alone if known is None else alone.unionByName(known.select(alone.columns))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of `docs`."""
    read = leaves(docs)
    nodes = stash(ranked(read, "doc_id", "digest", "place").drop("place"))
    discard(read)
    above = levels(nodes, "doc_id", "altered")
    subroots = tops(nodes, above).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    crowns = stash(ranked(subroots, "name"))
    over = levels(crowns, "name")
    root = tops(crowns, over).select("tree", F.col("digest").alias("root"), F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path"))
    known = stash(proofs(crowns, over, root, "name").select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))
    rows = proofs(nodes, above, known, "doc_id", "altered")
    folded = F.aggregate("path", F.coalesce("altered", "digest"), lambda node, step: digest(F.concat(step.left, node, step.right)))
    out = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest(F.concat(F.lit(""), F.array_join(F.transform("path", lambda s: F.concat(s.left, s.right)), ""))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

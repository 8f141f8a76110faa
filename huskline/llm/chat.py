"""Operator 3: conversations out of reply trees.

Messages point at the message they answer.  Self-joins by pointer doubling give every message its depth
and its path's score in as many rounds as the logarithm of the depth; a tree's leaves are ranked by the mean
score of their path, and the path of each chosen leaf is walked back over the same pointers.  Each path
becomes one conversation in a template that marks turns and masks what the loss covers.

Template of a turn: `<s>[INST] role [/INST]text</s>`.  Inside roles and texts a control string gets a
backslash after its first character, and one more if it has some there already, so that taking one away
gives the text back.

Defined results: null roles and texts are empty; a null conversation id is a conversation of its own;
rows with the same turn are ordered by role, then text, null turns first, and repeated rows are
turns of their own; a message whose parent is missing begins a path; an empty table has no conversations;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

LOSS_ROLE = "assistant"
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
MAX_ROUNDS = 40


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2"), r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)(/?s>)", r"<$1$2"), r"\[\\(\\*)(/?INST\])", r"[$1$2")


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch (rank from 1), node, up (steps from the leaf) of the best root-to-leaf paths.

    nodes: tree, node, parent (null: a root), score; node is unique in its tree."""
    nodes = nodes.select("tree", "node", "parent", "score")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    held = nodes.where("parent is not null").join(known, ["tree", "parent"], "left")
    state = stash(nodes.where("parent is null").select("tree", "node", F.lit(None).cast("long").alias("ptr"), F.lit(1).cast("long").alias("size"), "score").unionByName(held.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("ptr"), F.lit(1).cast("long").alias("size"), "score")))
    levels = []
    while state.where("ptr is not null").limit(1).count():
        if len(levels) >= MAX_ROUNDS:
            raise ValueError("messages answer each other in a circle")
        levels.append(state.where("ptr is not null").select("tree", "node", "ptr"))
        above = state.select("tree", F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("size").alias("more"), F.col("score").alias("add"))
        moved = state.where("ptr is not null").join(above, ["tree", "ptr"]).select("tree", "node", F.col("next").alias("ptr"), (F.col("size") + F.col("more")).alias("size"), (F.col("score") + F.col("add")).alias("score"))
        state = stash(state.where("ptr is null").unionByName(moved))
    leaves = state.join(nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    by_score = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("size")), "node")
    paths = leaves.withColumn("branch", F.row_number().over(by_score)).where(F.col("branch") <= branches).select("tree", "branch", "node", F.lit(0).cast("long").alias("up"))
    for k, level in enumerate(levels):
        paths = stash(paths.unionByName(paths.join(level, ["tree", "node"]).select("tree", "branch", F.col("ptr").alias("node"), (F.col("up") + (1 << k)).alias("up"))))
    return paths


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch, formatted text, loss spans (start and length in code points) of every chosen path.

    messages: tree, node, parent, score, role, text."""
    content = messages.select("tree", "node", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = chosen_paths(messages, branches).join(content, ["tree", "node"])
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    turns = turns.select("tree", "branch", "up", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    before = Window.partitionBy("tree", "branch").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("loss"), F.struct("start", F.length("body").cast("long").alias("length")))
    rows = turns.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("text")))).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return rows.select("tree", "branch", F.array_join(F.col("turns.text"), "").alias("formatted"), "loss_spans")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as trees of one path: every row answers the one before it; longer replies score more."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and masked text parsed from the formatted text alone (and its spans), as digests."""
    piece = F.transform(F.filter(F.split("formatted", CLOSE), lambda p: p != ""), lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"), unescape(F.substr(p, F.instr(p, MIDDLE) + len(MIDDLE))).alias("text")))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = formatted.withColumns({"turns": piece, "masked": masked})
    return rows.select(
        F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "branch",
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One formatted conversation for each conversation: tree, branch, formatted, loss_spans."""
    return format_trees(conversation_messages(conversations))

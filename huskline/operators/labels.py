"""Code or documentation, line by line, and the lines around.

A file is one row and its lines one array: the scanner's order costs no sort, and the windows no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scanner's state is one letter: code (c), or inside of a block of single (s) or double quotes (d).
#: Fixed values.  What a line is in the state `code`, tried in this order: letter, pattern, label, next state.
IN_CODE = (
    ("h", r"^ *#|^\s*'''.*'''\s*\z|^\s*\"\"\".*\"\"\"\s*\z", 1, "c"),
    ("s", r"^\s*'''", 1, "s"),
    ("d", r'^\s*"""', 1, "d"),
    ("i", r"^\s*\S+.*\"\"\".*\"\"\".*|^\s*\S+.*'''.*'''.*", 0, "c"),
    ("t", r"^\s*\S+.*'''.*", 0, "s"),
    ("e", r'^\s*\S+.*""".*', 0, "d"),
)


def line_class(line: Column) -> Column:
    """Two letters: what the line is in code (o: plain code, b: blank), and which quotes it holds (0 none, 1 single, 2 double, 3 both)."""
    out = F.lit("o")
    for letter, pattern, _, _ in reversed(IN_CODE):
        out = F.when(line.rlike(pattern), letter).otherwise(out)
    out = F.when(line.rlike(r"^\s*\z"), "b").when(~line.contains("'''") & ~line.contains('"""') & ~line.contains("#"), "o").otherwise(out)
    return F.concat(out, (F.when(line.contains("'''"), 1).otherwise(0) + F.when(line.contains('"""'), 2).otherwise(0)).cast("string"))


def labels(lines: Column) -> Column:
    """array<int>: 0 code, 1 documentation, null blank."""
    classes = F.transform(lines, line_class)
    start = F.struct(F.lit("c").alias("state"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        kind, quotes, state = F.substring(x, 1, 1), F.substring(x, 2, 1).cast("int"), a["state"]
        label, after = F.lit("0"), F.lit("c")
        for letter, _, value, then in IN_CODE:
            label, after = F.when(kind == letter, str(value)).otherwise(label), F.when(kind == letter, then).otherwise(after)
        closed = F.when(state == "s", quotes % 2 == 1).otherwise(quotes >= 2)
        label = F.when(kind == "b", "-").when(state == "c", label).otherwise("1")
        after = F.when(kind == "b", state).when(state == "c", after).when(closed, "c").otherwise(state)
        return F.struct(after.alias("state"), F.concat(a["out"], label).alias("out"))

    told = F.aggregate(classes, start, step, lambda a: a["out"])
    return F.transform(F.filter(F.split(told, ""), lambda c: F.length(c) > 0), lambda c: F.when(c != "-", c.cast("int")))


def label_files(files: DataFrame) -> DataFrame:
    """The files with `text_lines` (empty lines left out) and their `labels`."""
    kept = files.withColumn("text_lines", F.filter("lines", lambda x: F.length(x) > 0))
    return kept.withColumn("labels", labels(F.col("text_lines")))


def label_lines(files: DataFrame) -> DataFrame:
    """doc_id, split, lang, idx (among lines that are not empty, from 1), line, label; blank lines left out."""
    rows = label_files(files).select("doc_id", "split", "lang", F.posexplode(F.arrays_zip("text_lines", "labels")).alias("pos", "x"))
    return rows.select("doc_id", "split", "lang", (F.col("pos") + 1).cast("long").alias("idx"), F.col("x.text_lines").alias("line"), F.col("x.labels").alias("label")).where("label is not null")


def context_lines(files: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """doc_id, split, lang, idx, before (array), text, after (array), label of every line that is not blank; neighbours are lines that are not empty."""
    texts = F.col("text_lines")

    def around(x: Column, i: Column) -> Column:
        ahead = F.slice(texts, F.greatest(i - before + 1, F.lit(1)), F.least(F.lit(before), i)) if before else F.array().cast("array<string>")
        behind = F.slice(texts, i + 2, after) if after else F.array().cast("array<string>")
        return F.struct((i + 1).cast("long").alias("idx"), ahead.alias("before"), x.alias("text"), behind.alias("after"), F.get("labels", i).alias("label"))

    return label_files(files).select("doc_id", "split", "lang", F.inline(F.transform(texts, around))).where("label is not null")


def merged(context: DataFrame) -> DataFrame:
    """Neighbours as one text each."""
    return context.withColumn("before", F.array_join("before", "\n")).withColumn("after", F.array_join("after", "\n"))


def file_text(files: DataFrame) -> Column:
    """A file's lines that are not empty, as one text."""
    return F.array_join(F.filter("lines", lambda x: F.length(x) > 0), "\n")


def file_context(lines: DataFrame, files: DataFrame, of=F.md5) -> DataFrame:
    """Lines with `context`: what `of` makes of the whole text of their file, once a file and before the join on doc_id, so no line carries a whole file."""
    return lines.join(files.select("doc_id", of(file_text(files)).alias("context")), "doc_id")

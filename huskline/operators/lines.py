"""Lines and comments of source files.  Each function takes and returns a DataFrame and needs no shuffle, unless it says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, strip_left, strip_right

#: Lines longer than this are marked `too_long` instead of being timed.
MOST_CHARS = 100_000


def line_array(code: Column) -> Column:
    """Physical lines: no element after a final line end."""
    lines = F.split(code, r"\r\n|\r|\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


def explode_lines(files: DataFrame) -> DataFrame:
    """One row a line: the files' key columns, lineno from 1, line, too_long."""
    keys = [c for c in files.columns if c not in ("code", "lines", "docstring")]
    rows = files.select(*keys, F.posexplode(line_array(F.col("code"))).alias("pos", "line"))
    return rows.select(*keys, (F.col("pos") + 1).cast("long").alias("lineno"), "line", (F.length("line") > MOST_CHARS).alias("too_long"))


def within_limit(lines: DataFrame) -> DataFrame:
    """The lines that patterns may be run on: those that explode_lines has not marked as too long."""
    return lines.where(~F.col("too_long"))


def comments(lines: DataFrame) -> DataFrame:
    """Lines that are comments, with their content: spaces and hashes off the left, all blanks off the right."""
    content = strip_right(strip_left(F.col("line"), " #"), BLANKS)
    return lines.where(strip_left(F.col("line"), BLANKS).startswith("#")).withColumn("content", content)


def leading_comments(code: Column, anchor: str = "line") -> Column:
    """Contents of pure comment lines, of more than one character; anchor 'file' looks at the file's start only."""
    found = F.regexp_extract_all(code, F.lit(r"(?m)^ *#+([^\n]*)" if anchor == "line" else r"\A *#+([^\n]*)"), F.lit(0))
    return F.filter(F.transform(found, lambda c: strip_right(strip_left(c, " #"), " \n")), lambda c: F.length(c) > 1)


def strip_docs(code: Column, anchor: str = "line") -> Column:
    """The code without pure comments and triple-quoted blocks; tabs and runs of four spaces end lines; blank lines (a bar counts as blank) fall away."""
    comment = r"(?m:^ *#+[^\n]*(?:\n|\z))" if anchor == "line" else r"\A *#+[^\n]*(?:\n|\z)"
    out = F.regexp_replace(code, comment + r'|(?s:""".*?""")|' + r"(?s:'''.*?''')", "")
    out = F.replace(F.replace(out, F.lit("    "), F.lit("\n")), F.lit("\t"), F.lit("\n"))
    return F.regexp_replace(out, r"\n[\s| ]*(\n|\z)", "\n")


def split_clean(text: Column) -> Column:
    """Lines without spaces and hashes on the left and spaces on the right, of more than one character."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: strip_right(strip_left(x, " #"), " ")), lambda x: F.length(x) > 1)


def line_dataset(files: DataFrame, anchor: str = "line") -> DataFrame:
    """doc_id, data, label: code lines (0), comments and docstring lines (1)."""
    code = F.transform(split_clean(strip_docs(F.col("code"), anchor)), lambda x: F.struct(x.alias("data"), F.lit(0).alias("label")))
    docs = F.transform(F.concat(leading_comments(F.col("code"), anchor), split_clean(F.coalesce("docstring", F.lit("")))), lambda x: F.struct(x.alias("data"), F.lit(1).alias("label")))
    return files.select("doc_id", F.explode(F.concat(code, docs)).alias("x")).select("doc_id", "x.data", "x.label")


def seeded_order(key: Column, seed: int) -> Column:
    """Order by this for a shuffle that any engine repeats."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))

"""Which comments are code: rules, models' votes, findings, and removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import comments as native
from ..functions import rules
from ..functions.parsing import code_comments, compiles, parses
from ..functions.text import bind


def triaged(comments: DataFrame) -> DataFrame:
    return comments.withColumn("rule", rules.triage(F.col("content")))


def confirmed(comments: DataFrame, check: str = "parse") -> DataFrame:
    """Triage where a candidate must parse (or compile) to be code, else it is undecided.  Only candidates reach the parser."""
    parser = compiles if check == "compile" else parses
    rows = triaged(comments).withColumn("fine", parser(F.when(F.col("rule") == "candidate", F.col("content"))))
    return rows.withColumn("rule", F.when((F.col("rule") == "candidate") & ~F.col("fine"), "undecided").otherwise(F.col("rule"))).drop("fine")


def is_rule_code(rule: Column) -> Column:
    return rule.isin("candidate", "main_guard")


def vote(rows: DataFrame, score: Column, name: str, usable: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """A boolean column: does the model call the row code?  A score above the threshold is documentation; rows that are not usable get no vote."""
    says = score <= threshold
    return rows.withColumn(name, says if usable is None else F.coalesce(usable & says, F.lit(False)))


def model_score(rows: DataFrame, features: str, width: int, load: Callable[[], Callable]) -> DataFrame:
    """Rows with `score` from any model: `load` gives, once a worker, a function from a numpy batch of features (arrays of `width`) to scores."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    return rows.withColumn("score", predict_batch_udf(load, return_type=DoubleType(), batch_size=1024, input_tensor_shapes=[[width]])(F.col(features)))


def combined(rule: Column, chars: Column, tokens: Column, aggressive: bool = False) -> Column:
    """Votes of one row: a rule or the character model; if aggressive the token model too."""
    return rule | chars | tokens if aggressive else rule | chars


def combine_tables(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, those of `second` only where `first` lacks the key."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti").select(first.columns))


#: What a finding says besides its place and content (fixed values).
KIND, ADVICE = "8_2", "Do not use comment lines to make the code invalid."


def findings(rows: DataFrame) -> DataFrame:
    """file_path, document: a file's findings (lineno, content) as one JSON text."""
    one = F.struct(
        F.col("file_path"), F.col("lineno"), F.col("content"), F.lit(0).alias("offset"), F.lit(0).alias("length"), F.lit("").alias("module"), F.struct(F.lit(KIND).alias("name"), F.lit("").alias("severity"), F.lit(KIND).alias("inspection_name"), F.lit("").alias("attribute_key")).alias("problem_class"),
        F.struct(F.lit("").alias("TYPE"), F.lit("").alias("FQNAME")).alias("entry_point"), F.lit(ADVICE).alias("description"),
    )
    grouped = rows.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("lineno", one.alias("one")))).alias("all"))
    return grouped.select("file_path", F.to_json(F.struct(F.col("all.one").alias("problems"))).alias("document"))


def flat_findings(documents: DataFrame) -> DataFrame:
    """file_path, lineno, content out of findings documents."""
    shape = "struct<problems:array<struct<file_path:string,lineno:bigint,content:string>>>"
    return documents.select(F.inline(F.from_json("document", shape)["problems"]))


def era_lines(lines: DataFrame, aggressive: bool = True, whitelist: tuple[str, ...] = rules.WHITELIST) -> DataFrame:
    return lines.withColumn("stage", rules.stage(F.col("line"), aggressive, whitelist))


def era_verdict(lines: DataFrame, aggressive: bool = True, whitelist: tuple[str, ...] = rules.WHITELIST) -> DataFrame:
    """Lines with stage and is_code; only what no rule decides reaches the parser."""
    rows = era_lines(lines, aggressive, whitelist)
    text = rules.without_print(rules.bare_comment(F.col("line")))
    return rows.withColumn("is_code", F.col("stage").isin(*rules.CODE_STAGES) | compiles(F.when(F.col("stage") == "needs_compile", text)))


def marked_lines(files: DataFrame, aggressive: bool = True, parser: bool = True) -> DataFrame:
    """The files with `marked`, one flag a line: is it a comment of code?

    With a parser, comments are told by Python's own tokens, and a comment is code by the rules, or where only the parser can tell
    by compiling.  Without, comments are told by the lexical automaton and judged by rules alone, and no Python runs.  What lies
    inside of strings is no comment either way.  All of a file stays in one row: no shuffle."""
    if not parser:
        # Bound as one value, as an array that a lambda names from outside would be made again for each line.
        code = lambda x, flag: flag & rules.stage(x, aggressive).isin(*rules.CODE_STAGES)
        return files.withColumn("marked", bind(F.col("lines"), lambda lines: F.zip_with(lines, native.comment_flags(lines), code)))
    # Rules come first, for all lines, so that one Python worker a task tells comments and compiles what is open.
    text = lambda x: rules.without_print(rules.bare_comment(x))
    told = lambda x: bind(rules.stage(x, aggressive), lambda s: F.struct(s.isin(*rules.CODE_STAGES).alias("known"), F.when(s == "needs_compile", text(x)).alias("open")))
    staged = files.withColumn("_told", F.transform("lines", told))
    return staged.withColumn("marked", code_comments(F.array_join("lines", "\n"), F.col("_told.known"), F.col("_told.open"))).drop("_told")


def removal(files: DataFrame, aggressive: bool = True, parser: bool = True) -> DataFrame:
    """The files with `parts`: array<struct<lineno, line, marked, gone>>; a marked line stays if the line before ends in a backslash."""

    def told(x: Column, i: Column) -> Column:
        gone = x["marked"] & ~F.rtrim(x["before"], F.lit(" \t\n\r\x0b\x0c")).endswith("\\")
        return F.struct((i + 1).alias("lineno"), x["line"].alias("line"), x["marked"].alias("marked"), gone.alias("gone"))

    before = F.concat(F.array(F.lit("")), F.col("lines"))
    parts = F.transform(F.arrays_zip(F.col("lines").alias("line"), F.col("marked"), F.slice(before, 1, F.size("lines")).alias("before")), told)
    return marked_lines(files, aggressive, parser).withColumn("parts", parts).drop("marked")


#: Lines that a hunk of a diff shows before and behind its changes.
AROUND = 3


def unified_diff(parts: Column, name: Column, around: int = AROUND) -> Column:
    """The unified diff of a file and what removal leaves of it, without a final line end; empty where nothing is gone.

    Only deletions occur, so a hunk is a run of gone lines with at most twice `around` kept ones between neighbours, and the
    lines around.  All by arrays of the file's own row."""

    def whole(gone: Column) -> Column:
        # Where in `gone` a hunk begins.
        heads = F.filter(F.sequence(F.lit(0), F.greatest(F.size(gone), F.lit(1)) - 1), lambda i: (i == 0) | (F.get(gone, i) - F.get(gone, i - 1) > 2 * around + 1))
        return bind(heads, lambda h: F.transform(h, lambda first, k: hunk(gone, first, F.coalesce(F.get(h, k + 1), F.size(gone)))))

    def hunk(gone: Column, first: Column, behind: Column) -> Column:
        start, end = F.greatest(F.get(gone, first) - around, F.lit(0)), F.least(F.get(gone, behind - 1) + around + 1, F.size(parts))
        told = F.transform(F.slice(parts, start + 1, end - start), lambda p: F.concat(F.when(p["gone"], "-").otherwise(" "), p["line"]))
        return F.concat(F.lit("@@ -"), span(start, end - start), F.lit(" +"), span(start - first, end - start - (behind - first)), F.lit(" @@\n"), F.array_join(told, "\n"))

    def span(start: Column, length: Column) -> Column:
        """As diffs write a range: its first line unless it is empty, and its length unless that is one."""
        return F.when(length == 1, (start + 1).cast("string")).otherwise(F.concat(F.when(length == 0, start).otherwise(start + 1).cast("string"), F.lit(","), length.cast("string")))

    gone = F.transform(F.filter(parts, lambda p: p["gone"]), lambda p: (p["lineno"] - 1).cast("int"))
    head = F.concat(F.lit("--- before/"), name, F.lit("\n+++ after/"), name, F.lit("\n"))
    return bind(gone, lambda g: F.when(F.size(g) == 0, "").otherwise(F.concat(head, F.array_join(whole(g), "\n"))))

"""A deterministic source-code view over the `documents` table, which holds prose only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line of code made of a line of prose; reads doc_id, pos, ln, w1, w2.  The same text runs in Spark SQL and DuckDB.
TEMPLATE = """CASE CAST((doc_id * 7 + pos) % 24 AS INT)
 WHEN 0 THEN concat('# ', ln)
 WHEN 1 THEN concat('    # ', w1, ' = ', w2, '(', CAST(pos AS STRING), ')')
 WHEN 2 THEN concat('import ', w1)
 WHEN 3 THEN concat('\"\"\"', ln)
 WHEN 4 THEN concat(ln, '\"\"\"')
 WHEN 5 THEN concat('    ', w1, '_', w2, 'Id2 = ', CAST(pos AS STRING))
 WHEN 6 THEN concat('x = ', chr(39), chr(39), chr(39), w1)
 WHEN 7 THEN concat(w2, chr(39), chr(39), chr(39))
 WHEN 8 THEN ''
 WHEN 9 THEN '    '
 WHEN 10 THEN concat('#from ', w1, ' import ', w2)
 WHEN 11 THEN concat('  ## self.', w1, '(', w2, ')')
 WHEN 12 THEN concat('def get', w1, '(', w2, '):')
 WHEN 13 THEN concat('\"\"\"', w1, ' ', w2, '.\"\"\"')
 WHEN 14 THEN concat('# ', w1, ' ', w2, ' TODO fix (later)')
 WHEN 15 THEN concat('    return ', w1, ' + ', chr(92))
 WHEN 16 THEN concat('# return ', w1)
 WHEN 17 THEN concat(chr(9), '# for ', w1, ' in ', w2, ':')
 WHEN 18 THEN '# if __name__ == \"__main__\":'
 WHEN 19 THEN concat('# [', w1, ', ', w2, '],')
 WHEN 20 THEN '#======'
 WHEN 21 THEN '# coding=utf-8'
 WHEN 22 THEN concat('#  \"', w1, '\": ', w2, ',')
 ELSE concat('print(', w1, ')  # ', w2) END"""

#: The case of a line, as the template has it.
CASE = "CAST((doc_id * 7 + pos) % 24 AS INT)"

#: Split of a file by its id.
SPLIT = "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'valid' ELSE 'train' END"


def code_files(documents: DataFrame) -> DataFrame:
    """One row a file: doc_id, file_path, split, lang, lines (array), docstring.  No shuffle."""
    w1 = "coalesce(nullif(regexp_extract(ln, '[A-Za-z]+', 0), ''), 'w')"
    w2 = "coalesce(nullif(regexp_extract(ln, '[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1), ''), 'v')"
    # Words and the number of the case are bound first, so that each is made once a line.
    bound = f"transform(transform(split(text, '\\n'), (ln, pos) -> struct(ln, pos, {CASE} AS k, {w1} AS w1, {w2} AS w2)), t -> {_of_struct()})"
    return documents.where("text is not null").select(
        "doc_id", F.expr("concat('/src/', source, '/', CAST(doc_id AS STRING), '.py')").alias("file_path"), F.expr(SPLIT).alias("split"), "lang", F.expr(bound).alias("lines"), F.substring_index("text", "\n", 1).alias("docstring"),
    )


def _of_struct() -> str:
    out = TEMPLATE.replace(f"CASE {CASE}", "CASE t.k")
    for name in ("pos", "ln", "w1", "w2"):
        for before, after in ((f"({name} ", f"(t.{name} "), (f" {name},", f" t.{name},"), (f" {name})", f" t.{name})"), (f"({name},", f"(t.{name},")):
            out = out.replace(before, after)
    return out


def with_code(files: DataFrame) -> DataFrame:
    """The files with their whole text as `code`."""
    return files.withColumn("code", F.array_join("lines", "\n"))


def code_lines(files: DataFrame) -> DataFrame:
    """doc_id, file_path, lineno (from 1), line; other columns of a file but its arrays stay."""
    return files.select("doc_id", "file_path", "split", "lang", F.posexplode("lines").alias("pos", "line")).select("doc_id", "file_path", "split", "lang", (F.col("pos") + 1).cast("long").alias("lineno"), "line")

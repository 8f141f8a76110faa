"""Comment tokens of a file without Python: a lexical automaton over the array of its lines.

A line is first told apart from its neighbours: for each state in which it can begin (code, or inside of one of four kinds of
strings) what it does to the brackets, and where it ends.  Then one `aggregate` runs over the lines and
takes from each what its state asks for.  So every line is matched once, and no file leaves its row.

What counts is what Python's tokenizer took for a comment while it was written in Python: a quote without partner is passed over, a string goes on
behind a backslash at the end of its line, brackets and backslashes continue a statement, and a dedent to a column
that no block has ends the file.  (The tokenizer of later versions also ends a file at lexical errors.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS, bind, strip_left

#: How a string goes on, by the quotes that end it: up to those quotes.
INSIDE = {
    "'''": r"[^'\\]*(?:(?:\\[^\n]|'{1,2}(?:[^'\\]|\\[^\n]))[^'\\]*)*'''",
    '"""': r'[^"\\]*(?:(?:\\[^\n]|"{1,2}(?:[^"\\]|\\[^\n]))[^"\\]*)*"""',
    "'": r"[^'\\]*(?:\\[^\n][^'\\]*)*'",
    '"': r'[^"\\]*(?:\\[^\n][^"\\]*)*"',
}
#: A backslash that ends the line.
BACKSLASH = r"\\\r?\z"
#: What matters in code, in this order: comments, strings whole and open, brackets, a backslash at the end.
MARKS = "|".join([
    r"#[^\n]*", *(q + p for q, p in INSIDE.items() if len(q) == 3), r"'''[^\n]*", r'"""[^\n]*', *(q + p for q, p in INSIDE.items() if len(q) == 1),
    r"'[^'\\]*(?:\\[^\n\r][^'\\]*)*" + BACKSLASH, r'"[^"\\]*(?:\\[^\n\r][^"\\]*)*' + BACKSLASH, r"[()\[\]{}]", BACKSLASH,
])


def steady(pattern: str) -> str:
    """The pattern with loops that give nothing back, so that long strings need no stack; it matches the same, as no loop could end elsewhere."""
    return pattern.replace(")*", ")*+")


#: States by letter, beside `c` for code.
LETTERS = {"'''": "t", '"""': "u", "'": "s", '"': "d"}
TAB = 8


def _effect(rest: Column) -> Column:
    """What code does: change of the depth of brackets, the state at the end, whether the statement goes on behind a backslash, and whether it holds a comment."""

    def told(marks: Column) -> Column:
        last = F.coalesce(F.get(marks, F.size(marks) - 1), F.lit(""))
        depth = F.size(F.filter(marks, lambda m: m.isin("(", "[", "{"))) - F.size(F.filter(marks, lambda m: m.isin(")", "]", "}")))

        def ends(x: Column) -> Column:
            state = F.lit("c")
            for quotes, letter in list(LETTERS.items())[::-1]:
                whole = x.rlike(steady(r"\A" + quotes + INSIDE[quotes] + r"\z"))
                state = F.when(x.startswith(quotes), F.when(whole, "c").otherwise(letter)).otherwise(state)
            return F.struct(depth.alias("depth"), state.alias("state"), (x.startswith("\\")).alias("goes_on"), x.startswith("#").alias("comment"))

        return bind(last, ends)

    return bind(F.regexp_extract_all(rest, F.lit(steady(MARKS)), F.lit(0)), told)


def _quiet(state: Column | str) -> Column:
    return F.struct(F.lit(0).alias("depth"), (F.lit(state) if isinstance(state, str) else state).alias("state"), F.lit(False).alias("goes_on"), F.lit(False).alias("comment"))


def _from_string(line: Column, quotes: str) -> Column:
    """What a line does that begins inside of a string."""
    letter = LETTERS[quotes]
    # Without its end a triple-quoted string goes on; another one only behind a backslash, else it is an error that ends with the line.
    unclosed = _quiet(letter if len(quotes) == 3 else F.when(line.rlike(BACKSLASH), letter).otherwise("c"))
    closing = bind(F.regexp_extract(line, steady(r"\A" + INSIDE[quotes]), 0), lambda head: F.when(F.length(head) > 0, _effect(F.substr(line, F.length(head) + 1))).otherwise(unclosed))
    return F.when(line.contains(quotes), closing).otherwise(unclosed)


def _column(line: Column) -> Column:
    """The column of the first sign: tabs go to the next multiple of eight, a form feed to zero."""
    indent = F.regexp_extract(line, r"\A[ \t\x0c]*", 0)
    step = lambda at, c: F.when(c == "\t", (F.floor(at / TAB) + 1).cast("int") * TAB).when(c == " ", at + 1).when(c == "\x0c", 0).otherwise(at)
    return F.when(indent.rlike(r"[\t\x0c]"), F.aggregate(F.split(indent, ""), F.lit(0), step)).otherwise(F.length(indent))


def told_apart(line: Column) -> Column:
    """All that the automaton asks of a line."""
    plain = ~line.rlike(r"['\"#()\[\]{}\\]")
    effects = [F.when(plain, _quiet("c")).otherwise(_effect(line)).alias("c"), *(_from_string(line, q).alias(letter) for q, letter in LETTERS.items())]
    # Blank lines and those that hold nothing but a comment begin no statement.
    return F.struct(*effects, strip_left(line, BLANKS).startswith("#").alias("hash"), (~line.rlike(r"\A[ \t\x0c]*(#|\r?\z)")).alias("begins"), _column(line).alias("column"))


def comment_flags(lines: Column) -> Column:
    """array<boolean>, one for each line: is it a comment, and nothing else?  What lies inside of strings is none."""
    start = F.struct(F.lit("c").alias("state"), F.lit(0).alias("depth"), F.lit(False).alias("goes_on"), F.array(F.lit(0)).alias("indents"), F.lit(False).alias("over"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        does = x["c"]
        for letter in LETTERS.values():
            does = F.when(a["state"] == letter, x[letter]).otherwise(does)

        def after(e: Column) -> Column:
            statement = (a["state"] == "c") & (a["depth"] == 0) & ~a["goes_on"] & x["begins"]
            deeper = x["column"] > F.element_at(a["indents"], -1)
            indents = F.when(~statement, a["indents"]).when(deeper, F.concat(a["indents"], F.array(x["column"]))).otherwise(F.filter(a["indents"], lambda i: i <= x["column"]))
            over = a["over"] | (statement & ~deeper & ~F.array_contains(a["indents"], x["column"]))
            flag = F.when(~over & x["hash"] & ((a["state"] == "c") | e["comment"]), "1").otherwise("0")
            return F.struct(e["state"].alias("state"), (a["depth"] + e["depth"]).alias("depth"), e["goes_on"].alias("goes_on"), indents.alias("indents"), over.alias("over"), F.concat(a["out"], flag).alias("out"))

        return bind(does, after)

    told = F.aggregate(F.transform(lines, told_apart), start, step, lambda a: a["out"])
    return F.transform(F.filter(F.split(told, ""), lambda c: F.length(c) > 0), lambda c: c == "1")

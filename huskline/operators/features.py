"""Tokens, ids and fixed-width features of lines; none needs a shuffle but where it says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CLS, KEYWORD_VOCABULARY, LAYOUTS, SEP, bind, lex, pad, preclean, split_names, token_ids
from .bayes import on_token
from .labels import file_context, label_files

#: Least ids of a usable row, and widths of rows.
LEAST, WIDTH = 3, 30


def ids_of(line: Column, vocabulary: list[str] = KEYWORD_VOCABULARY, layout: str = "plain", split: bool = False) -> Column:
    tokens = lex(line)
    return token_ids(split_names(tokens) if split else tokens, vocabulary, layout)


def token_features(lines: DataFrame, vocabulary: list[str] = KEYWORD_VOCABULARY, layout: str = "plain", least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """Lines of at least `least` tokens, with `ids` of exactly `width`; key columns stay."""
    rows = lines.withColumn("ids", ids_of(F.col("line"), vocabulary, layout))
    return rows.where(F.size("ids") >= least).withColumn("ids", pad(F.col("ids"), width))


#: Orders of the parts of a context row.
ORDERS = {"bta": ("before", "text", "after"), "bat": ("before", "after", "text"), "tba": ("text", "before", "after"), "ct": ("context", "text"), "tc": ("text", "context")}


def context_features(rows: DataFrame, order: str, width: int, vocabulary: list[str] = KEYWORD_VOCABULARY) -> DataFrame:
    """Rows with `ids`: a start id, then each part closed by a separator, padded to `width`.  The parts are texts."""
    parts = [F.array(F.lit(CLS))]
    for name in ORDERS[order]:
        parts += [ids_of_text(F.col(name), vocabulary), F.array(F.lit(SEP))]
    return rows.withColumn("ids", pad(F.concat(*parts), width))


def window_features(files: DataFrame, order: str, width: int, vocabulary: list[str] = KEYWORD_VOCABULARY) -> DataFrame:
    """As context_features of lines with one neighbour on each side, but each line is lexed once: doc_id, idx, label, ids."""
    known = label_files(files).withColumn("line_ids", F.transform("text_lines", lambda x: ids_of_text(x, vocabulary)))
    steps = {"before": -1, "text": 0, "after": 1}

    def row(label: Column, i: Column) -> Column:
        parts = [F.array(F.lit(CLS))]
        for name in ORDERS[order]:
            parts += [F.coalesce(F.get("line_ids", i + steps[name]), F.array().cast("array<int>")), F.array(F.lit(SEP))]
        return F.struct((i + 1).cast("long").alias("idx"), label.alias("label"), pad(F.concat(*parts), width).alias("ids"))

    return known.select("doc_id", F.inline(F.transform("labels", row))).where("label is not null")


def file_features(lines: DataFrame, files: DataFrame, order: str, width: int, vocabulary: list[str] = KEYWORD_VOCABULARY) -> DataFrame:
    """Lines (column `line`) with `ids` of their whole file and the line, padded to `width`, of which the last ids count.

    A file is lexed once and whole; only its last `width` ids, all that can be used, meet the lines."""
    last = lambda text: bind(ids_of_text(text, vocabulary), lambda x: F.slice(x, F.greatest(F.size(x) - width + 1, F.lit(1)), width))
    rows = file_context(lines, files, last).withColumn("text", ids_of_text(F.col("line"), vocabulary))
    parts = [F.array(F.lit(CLS))]
    for name in ORDERS[order]:
        parts += [F.col(name), F.array(F.lit(SEP))]
    return rows.withColumn("ids", pad(F.concat(*parts), width))


def ids_of_text(text: Column, vocabulary: list[str] = KEYWORD_VOCABULARY) -> Column:
    """Ids of a text of several lines, pre-cleaned as a whole."""
    lines = F.split(preclean(text), "\n")
    return F.flatten(F.transform(lines, lambda x: token_ids(lex(x), vocabulary, "context")))


def decode(ids: Column, vocabulary: list[str] = KEYWORD_VOCABULARY, layout: str = "plain") -> Column:
    """The tokens of ids, as text; classes by name, zeros left out."""
    names = LAYOUTS[layout]
    listed = F.array(*map(F.lit, vocabulary))

    def one(i: Column) -> Column:
        out = F.get(listed, i - names["first"])
        for kind, number in names.items():
            if kind != "first":
                out = F.when(i == number, f"<{kind}>").otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(ids, lambda i: i > 0), one), " ")


def ids_by_join(lines: DataFrame, vocabulary: DataFrame, key: list[str], layout: str = "plain") -> DataFrame:
    """As ids_of for a vocabulary table (rank, token) of any size: one row a key with `ids`.  Shuffles once by token and once by line, unless the vocabulary is small enough that Spark sends it out."""
    names = LAYOUTS[layout]
    tokens = lines.select(*key, F.posexplode(lex(F.col("line"))).alias("pos", "t")).select(*key, "pos", "t.kind", F.col("t.tok").alias("token"))
    known = on_token(tokens, vocabulary.select("token", "rank"), key, "left")
    other = F.lit(names["ERROR"])
    for kind in ("NAME", "OP", "NUMBER", "STRING", "COMMENT"):
        other = F.when(F.col("kind") == kind, names[kind]).otherwise(other)
    number = F.when(F.col("kind").isin("NAME", "OP"), F.col("rank") + names["first"])
    rows = known.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(number, other).cast("int").alias("id")))).alias("ids"))
    return rows.withColumn("ids", F.col("ids.id"))

"""Column rules that tell code from prose in a comment."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_left, strip_right

#: Parts of a comment that make it no code (fixed values; a parameter).
WHITELIST = ("pylint", "pyright", "noqa", r"type:\s*ignore", r"fmt:\s*(on|off)", "TODO", "FIXME", "XXX")
#: A comment without any of these is no code (fixed values).
INDICATORS = ("(", ")", "[", "]", "{", "}", ":", "=", "%", "print", "return", "break", "continue", "import")
#: Heads of blocks (fixed values).
BLOCKS = (r"elif\s+.*", "else", "try", "finally", r"except\s+.*")
HASH_BLANKS = " \t\x0b\n#"


def triage(content: Column) -> Column:
    """drop, candidate, main_guard or undecided; the first that fits."""
    bare = strip_right(content, ",")
    bracketed = (content.startswith("(") & bare.endswith(")")) | (content.startswith("[") & bare.endswith("]"))
    drop = (F.length(F.trim(content, F.lit("='\""))) <= 1) | (content == "coding=utf-8") | (content.rlike("^[A-Z]") & content.endswith(".")) | ~content.rlike(r"^[\x00-\x7F]*\z")
    code = content.startswith("from ") | content.startswith("import ") | content.startswith("self.") | content.contains(" = ") | bracketed
    return F.when(drop, "drop").when(code, "candidate").when(content.startswith("if __name__ =="), "main_guard").otherwise("undecided")


def bare_comment(line: Column) -> Column:
    """A comment line without hashes and outer blanks."""
    return F.trim(strip_left(strip_left(line, " \t\n\r\x0b\x0c"), HASH_BLANKS), F.lit(" \t\n\r\x0b\x0c"))


def whitelisted(text: Column, patterns: tuple[str, ...] = WHITELIST) -> Column:
    return text.rlike("(?i)" + "|".join(patterns)) if patterns else F.lit(False)


#: Shapes of lines that are a part of code that spans lines: always, and if judged aggressively (fixed values).
PLAIN_SHAPES = (r"^\s*\w+\s*=.*[(\[{]\z", r"^[()\[\]{}\s]+\z")
MORE_SHAPES = (r"[)\]}]:\z", r"def .+\)[\s]+->[\s]+[a-zA-Z_][a-zA-Z0-9_]*:\z", r"with .+ as [a-zA-Z_][a-zA-Z0-9_]*:\z", r"for [a-zA-Z_][a-zA-Z0-9_]* in .+:\z")
CLOSINGS = ("),", "],", "},")


def multiline_shape(text: Column, aggressive: bool = True) -> Column:
    """Is the text probably a part of code that spans lines?"""
    plain = reduce(or_, (text.rlike(p) for p in PLAIN_SHAPES), text.endswith("\\"))
    if not aggressive:
        return plain
    more = reduce(or_, (text.rlike(p) for p in MORE_SHAPES), text.isin(*CLOSINGS))
    return more | plain


def block_head(text: Column, aggressive: bool = True) -> Column:
    return text.rlike(r"^\s*(" + "|".join([*BLOCKS, r"if\s+.*"] if aggressive else BLOCKS) + r")\s*:\s*\z")


def without_print(text: Column) -> Column:
    return F.regexp_replace(text, r"^(print|return)\b\s*", "")


def stage(line: Column, aggressive: bool = True, whitelist: tuple[str, ...] = WHITELIST, need_hash: bool = True) -> Column:
    """Which rule decides a line; `needs_compile` where only a parser can tell.

    need_hash: only comment lines are judged; otherwise leading spaces and hashes are taken off first."""
    text = bare_comment(line) if need_hash else bare_comment(strip_left(line, " #"))
    has_sign = reduce(or_, (text.contains(s) for s in INDICATORS))
    out = F.when(~strip_left(line, " \t\n\r\x0b\x0c").startswith("#"), "not_comment") if need_hash else F.when(F.lit(False), "")
    return (
        out.when(text.rlike("#[0-9]"), "hash_number").when(whitelisted(text, whitelist), "whitelisted").when(text.rlike(r"^.*?coding[:=][ \t]*[-_.a-zA-Z0-9]+"), "coding").when(~has_sign, "no_indicator")
        .when(multiline_shape(text, aggressive), "multiline").when(block_head(text, aggressive), "block").when(without_print(text).rlike(r"^\s*['\"]\w+['\"]\s*:.+[,{]\s*\z"), "partial_dict").otherwise("needs_compile")
    )


#: Stages that mean code without a parser.
CODE_STAGES = ("multiline", "block", "partial_dict")

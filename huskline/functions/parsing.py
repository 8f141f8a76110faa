"""What only Python's own parser can tell; nothing is ever run."""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections import deque

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tree(text: str | None, how: str = "parse"):
    """The tree of a text of any length; None where Python's own parser refuses it, as it does what is nested deeper than its own fixed limits."""
    if text is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
            if how == "compile":
                compile(tree, "<string>", "exec")
            return tree
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError, OverflowError):
        return None


@F.pandas_udf(T.BooleanType())
def parses(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _tree(t) is not None).astype(bool)


@F.pandas_udf(T.BooleanType())
def compiles(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _tree(t, "compile") is not None).astype(bool)


def _preorder(tree: ast.AST) -> list[str]:
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out.append(type(node).__name__)
        todo += list(ast.iter_child_nodes(node))[::-1]
    return out


def _breadth_first(tree: ast.AST) -> list[str]:
    out, todo = [], deque([tree])
    while todo:
        node = todo.popleft()
        out.append(type(node).__name__)
        todo += ast.iter_child_nodes(node)
    return out


@F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("preorder", "breadth_first")]))
def node_types(text: pd.Series) -> pd.DataFrame:
    def one(t: str | None) -> tuple[list[str] | None, list[str] | None]:
        tree = _tree(t)  # one tree at a time, as trees are far larger than their texts
        return (_preorder(tree), _breadth_first(tree)) if tree else (None, None)

    return pd.DataFrame([one(t) for t in text], columns=["preorder", "breadth_first"], dtype=object)


def _comment_rows(text: str | None) -> list[int]:
    found: list[int] = []
    try:
        for token in tokenize.generate_tokens(io.StringIO(text or "").readline):
            if token.type == tokenize.COMMENT and token.line.lstrip().startswith("#"):
                found.append(token.start[0])
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass
    return found


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def comment_rows(code: pd.Series) -> pd.Series:
    """Numbers of lines that are nothing but a comment; what lies inside strings is none.  Ends where the text stops being Python."""
    return code.map(_comment_rows)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def code_comments(code: pd.Series, known: pd.Series, open_: pd.Series) -> pd.Series:
    """One flag a line: is it nothing but a comment, and `known` to be code, or does its `open_` text compile (a null does not)?"""

    def one(text: str | None, sure: list[bool] | None, asked: list[str | None] | None) -> list[bool] | None:
        if asked is None:
            return None
        rows = set(_comment_rows(text))
        return [i in rows and (bool(s) or _tree(t, "compile") is not None) for i, (s, t) in enumerate(zip(sure, asked), 1)]

    return pd.Series([one(*x) for x in zip(code, known, open_)], dtype=object)

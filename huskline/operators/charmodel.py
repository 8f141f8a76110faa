"""A line classifier over hashed character n-grams: logistic regression by gradients that are summed over rows.

A text is the share of each slot among its n-grams of one to three characters.  Weights begin as the log odds of the slots, which is naive
Bayes, and are moved by a fixed number of steps along the whole gradient.  A step is one pass over the rows in Arrow batches: each task gives
one sum a slot, and these are added up, so a step moves as many numbers as there are weights, whatever the rows.  Scores are made within the row.

Training takes every row, and texts count whole.  Only `train(most=...)` takes fewer, chosen by the hash of their key: the queries whose SQL has that bound (`MOST_ROWS`) ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import preclean
from .sampling import bucket

#: Slots of n-grams; one more is the bias.  A prime, so that slots depend on all characters.
SLOTS = 1021
#: How much the mean weight of a text's n-grams counts.
SCALE = 16.0
MOST_ROWS, STEPS, RATE = 20_000, 6, 4.0


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of one, two and three characters, and the text that each is of."""
    texts = [t or "" for t in texts]
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    two, three = of[1:] == of[:-1], of[2:] == of[:-2]
    slots = [c * 31 + 1, (c[:-1] * 131 + c[1:] * 31 + 2)[two], (c[:-2] * 17161 + c[1:-1] * 131 + c[2:] * 31 + 3)[three]]
    return np.concatenate(slots) % SLOTS, np.concatenate([of, of[:-1][two], of[:-2][three]])


def odds(texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of documentation of each text (the bias alone where it has no n-gram), its number of n-grams, and the n-grams."""
    slots, of = grams(texts)
    size = np.bincount(of, minlength=len(texts))
    return SCALE * np.bincount(of, weights[slots], len(texts)) / np.maximum(size, 1) + weights[SLOTS], size, slots, of


#: Characters whose n-grams are held at once; a longer text is held alone.
MOST_CHARS = 1 << 18


def pieces(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of at most `MOST_CHARS` characters, in order."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and held + n > MOST_CHARS:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def sample(lines: DataFrame, key: Column, most: int) -> DataFrame:
    """About `most` of the rows, by the hash of `key`; all if they are fewer."""
    total = lines.count()
    share = int(10_000 * min(1.0, most / max(1, total)))
    return lines.where(bucket(key) < share)


def _added(rows: DataFrame, of_batch, width: int) -> np.ndarray:
    """The sum of what `of_batch` makes of (labels, texts), an array of `width` numbers, over all rows."""

    def run(batches):
        total = np.zeros(width)
        for b in batches:
            if len(b):
                labels, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
                for part in pieces(texts):
                    total += of_batch(labels[part], texts[part])
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["slot", "x"])

    summed = rows.mapInArrow(run, "slot int, x double").groupBy("slot").agg(F.sum("x").alias("x")).collect()  # a row a slot
    out = np.zeros(width)
    for r in summed:
        out[r.slot] = r.x
    return out


def train(lines: DataFrame, key: Column, most: int | None = None, steps: int = STEPS) -> list[float]:
    """Weights of all slots, and the bias, from all lines (line, label: 1 is documentation), or about `most` of them; lines that are empty without blanks and quotes are left out."""
    rows = (lines if most is None else sample(lines, key, most)).select(F.col("label").cast("double").alias("label"), preclean(F.col("line")).alias("text")).where(F.length("text") > 0)
    rows = rows.persist(StorageLevel.DISK_ONLY)  # made again where it is lost

    def counted(labels, texts):
        slots, of = grams(texts)
        said = labels[of]
        return np.concatenate([np.bincount(slots, said, SLOTS), np.bincount(slots, 1 - said, SLOTS), [len(texts)]])

    def gradient(weights):
        def of_batch(labels, texts):
            z, size, slots, of = odds(texts, weights)
            error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
            return np.append(np.bincount(slots, (error * SCALE / np.maximum(size, 1))[of], SLOTS), error.sum())

        return of_batch

    try:
        told = _added(rows, counted, 2 * SLOTS + 1)
        doc, code, n = told[:SLOTS], told[SLOTS:-1], told[-1]
        all_doc, all_code = doc.sum(), code.sum()
        weights = np.array([log((d + 1) / (all_doc + SLOTS)) - log((c + 1) / (all_code + SLOTS)) for d, c in zip(doc, code)] + [0.0])
        for _ in range(steps if n else 0):
            weights = weights - RATE * _added(rows, gradient(weights), SLOTS + 1) / n
        return weights.tolist()
    finally:
        rows.unpersist()


def score(text: Column, weights: list[float]) -> Column:
    """Probability of documentation."""
    known = np.array(weights)

    @F.pandas_udf(T.DoubleType())
    def told(texts: pd.Series) -> pd.Series:
        listed = texts.tolist()
        z = np.concatenate([np.zeros(0), *(odds(listed[part], known)[0] for part in pieces(listed))])
        return pd.Series(np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 6))

    return told(preclean(text))

"""Operator 1: quality classifier, a factorisation machine.

A document's features are its hashed words, structure statistics and the metadata column `n_chars`
(statistics and metadata by bucket).  The machine adds to a linear score the interactions of all
feature pairs, each weighted by the dot product of two short vectors; the sum-of-squares identity gives
them in time linear in the document's features.  It is trained by AdaGrad on logistic loss over at most
about `SAMPLE_ROWS` labelled rows (a documented bound), in one task; scoring covers whole texts of all
rows, batch by batch.

Defined results: a null text scores as an empty one; a null `n_chars` is a bucket of its own; of several
labels of one document the least counts, null labels do not; with no labels, or labels of one kind
only, every score is the smoothed share of label 1; repeated rows get equal scores; extra columns are
ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, prepare

#: Labelled rows that the machine is fitted on, in expectation.
SAMPLE_ROWS = 12_000
WORD_SLOTS, RANK, BUCKETS = 1 << 14, 8, 24
EPOCHS, BATCH, RATE = 8, 128, 0.08
#: Steps at least: a few labels are gone through more often.
LEAST_STEPS = 400
THRESHOLD = 0.3
#: A document with this remainder of crc32(doc_id as text) mod FOLDS is held out.
FOLDS = 5
STATISTICS = ("bytes", "words", "word_length", "letters", "digits", "upper", "blank", "marks", "other", "sentence_ends", "lines", "line_length", "repeated_lines", "distinct_words", "longest_word", "marked_words", "metadata", "metadata_differs")
SLOTS = WORD_SLOTS + len(STATISTICS) * BUCKETS

_KINDS = np.full(256, 5, np.int64)
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \t\n\r\x0b\x0c", b".,;:!?'\"()-")):
    _KINDS[list(_set)] = _k
_KINDS[128:] = 0


class _Slots(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = slot = zlib.crc32(word) % WORD_SLOTS
        return slot


_slots = _Slots()


def _level(x: float) -> int:
    """Bucket of a count, by its logarithm."""
    return min(BUCKETS - 1, int(1.5 * np.log2(x + 1)))


def _part(x: float, of: float) -> int:
    """Bucket of a share; small shares are told apart more finely."""
    return min(BUCKETS - 1, int(np.sqrt(x / of) * (BUCKETS - 1))) if of else 0


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, int]:
    """Slots of a document, words first, and how many of them are words."""
    raw = (text or "").encode()
    words = raw.lower().split()
    seen = set(words)
    histogram = np.bincount(_KINDS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=6)
    lower, digits, upper, blank, marks, other = histogram
    n, w = len(raw), len(words)
    lines = raw.split(b"\n")
    told = [
        _level(n), _level(w), min(BUCKETS - 1, int(2 * (n - blank) / w)) if w else 0, _part(lower, n), _part(digits, n), _part(upper, n), _part(blank, n), _part(marks, n), _part(other, n),
        _part(raw.count(b". ") + raw.count(b".\n") + raw.endswith(b"."), max(1, w)), _level(len(lines)), _level(n / len(lines)), _part(len(lines) - len(set(lines)), len(lines)), _part(len(seen), w), _level(max(map(len, seen), default=0)),
        _part(sum(not x[-1:].isalnum() for x in seen), len(seen)), BUCKETS - 1 if n_chars is None or n_chars != n_chars else _level(max(0, n_chars)), BUCKETS - 1 if n_chars is None or n_chars != n_chars else int(n_chars != len(text or "")),
    ]
    at = np.arange(len(told)) * BUCKETS + WORD_SLOTS + np.array(told)
    return np.concatenate([np.fromiter(map(_slots.__getitem__, seen), np.int64, len(seen)), at]), len(seen)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray):
        """Scores of documents whose features begin at `starts`; also the factor sums, for training."""
        v = self.factors[slots] * values[:, None]
        total = np.add.reduceat(v, starts)
        squares = np.add.reduceat(v * v, starts)
        return self.bias + np.add.reduceat(self.linear[slots] * values, starts) + 0.5 * (total * total - squares).sum(1), total

    def save(self) -> bytes:
        np.savez(out := io.BytesIO(), bias=self.bias, linear=self.linear, factors=self.factors)
        return out.getvalue()


@lru_cache(maxsize=4)
def load(data: bytes) -> Machine:
    x = np.load(io.BytesIO(data))
    return Machine(float(x["bias"]), x["linear"], x["factors"])


def joined(parts: list[tuple[np.ndarray, int]]):
    """Slots, values and starts of several documents.  A document's words together weigh as much as one statistic does."""
    slots = np.concatenate([p for p, _ in parts])
    sizes = np.array([len(p) for p, _ in parts])
    words = np.array([w for _, w in parts])
    starts = np.cumsum(sizes) - sizes
    within = np.arange(len(slots)) - np.repeat(starts, sizes)
    word_value = 1 / np.sqrt(np.maximum(words, 1))
    values = np.where(within < np.repeat(words, sizes), np.repeat(word_value, sizes), 0.5).astype(np.float32)
    return slots, values, starts, sizes


def fit(parts: list[tuple[np.ndarray, int]], labels: np.ndarray) -> Machine:
    share = (labels.sum() + 1) / (len(labels) + 2)
    rng = np.random.default_rng(7)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SLOTS, np.float32), rng.normal(0, 0.03, (SLOTS, RANK)).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    seen_linear, seen_factors = np.full(SLOTS, 0.1, np.float32), np.full((SLOTS, RANK), 0.1, np.float32)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(parts)))):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            slots, values, starts, sizes = joined([parts[i] for i in pick])
            score, total = m.raw(slots, values, starts)
            error = (1 / (1 + np.exp(-score)) - labels[pick]).astype(np.float32) / len(pick) * 8
            e = np.repeat(error, sizes) * values
            v = m.factors[slots]
            to_factors = e[:, None] * (np.repeat(total, sizes, axis=0) - v * values[:, None])
            touched, where = np.unique(slots, return_inverse=True)
            g = np.bincount(where, e, len(touched)).astype(np.float32) + 1e-4 * m.linear[touched]
            gf = np.stack([np.bincount(where, to_factors[:, k], len(touched)) for k in range(RANK)], 1).astype(np.float32) + 1e-3 * m.factors[touched]
            seen_linear[touched] += g * g
            seen_factors[touched] += gf * gf
            m.linear[touched] -= RATE * g / np.sqrt(seen_linear[touched])
            m.factors[touched] -= RATE * gf / np.sqrt(seen_factors[touched])
            m.bias -= RATE * float(error.mean())
    return m


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Null ids are in training's folds, but no label joins them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> bytes:
    """The machine, fitted on labelled rows outside the held-out fold."""
    prepare(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label")).where(~held_out(F.col("doc_id")))
    share = min(1.0, SAMPLE_ROWS / max(1, usable.count()))
    # Bounded by SAMPLE_ROWS in expectation, so it may be broadcast.
    sample = F.broadcast(usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column(docs, "text", "string"), column(docs, "n_chars", "double")).join(sample, "doc_id").select("text", "n_chars", "label", "doc_id")

    def featurise(batches):
        for b in batches:
            parts = [features(t.as_py(), n) for t, n in zip(b.column(0), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([p.astype(np.int32).tobytes() for p, _ in parts], pa.binary()), pa.array([w for _, w in parts], pa.int32()), b.column(2), b.column(3)], names=["slots", "words", "label", "doc_id"])

    def learn(batches):
        got = sorted(((d, s, w, y) for b in batches for s, w, y, d in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:2])
        parts = [(np.frombuffer(s, np.int32).astype(np.int64), w) for _, s, w, _ in got]
        m = fit(parts, np.array([float(y > 0) for *_, y in got]))
        yield pa.RecordBatch.from_arrays([pa.array([m.save()], pa.binary())], names=["model"])

    made = rows.mapInArrow(featurise, "slots binary, words int, label int, doc_id long").repartition(1).mapInArrow(learn, "model binary").collect()
    return made[0].model


def score_column(model: bytes, text: Column, n_chars: Column) -> Column:
    """The probability of label 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = load(model)
        for texts, metadata in batches:
            out = np.zeros(len(texts))
            for at in range(0, len(texts), 64):
                parts = [features(t, n) for t, n in zip(texts.iloc[at : at + 64], metadata.iloc[at : at + 64])]
                slots, values, starts, _ = joined(parts)
                raw = m.raw(slots, values, starts)[0].astype(np.float64)
                out[at : at + 64] = 1 / (1 + np.exp(-np.clip(raw, -50, 50)))
            yield pd.Series(out)

    return score(text, n_chars)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column(docs, "text", "string"), column(docs, "n_chars", "double"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text"), F.col("n_chars")).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with their columns, that the classifier does not reject."""
    model = train(docs, labels)
    scored = docs.withColumn("_husk_score", score_column(model, F.col("text").cast("string"), column(docs, "n_chars", "double")))
    return scored.where(F.col("_husk_score") >= THRESHOLD).drop("_husk_score")

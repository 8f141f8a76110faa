"""Operator 9: hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(part | class, history) * P(word | class, part).  The first two
factors are softmaxes over `CLASSES` classes and over the `PARTS` parts of a class, whose scores are sums of weights of
hashed history features: the word before (bigram), the word before that (skip) and both (trigram); in
the second factor each of them is joined with the class.  The third has the unigram feature only, for which the maximum
entropy solution is the smoothed share of the part's counts.  Classes are bins of equal mass over the
frequent words, by frequency, and one for all others, seen or not; parts are bins of equal mass in a class, so a
frequent word has a part of its own.  All words' probabilities add to 1.

Counts are over all training tokens: each task adds up hashes of words, Spark sums by hash.  Weights are
trained by distributed gradient updates: each task makes gradient steps over its texts from common
weights, and the changes of a weight are averaged over the tasks, by how often each used it.  Texts are
scored in batches of sparse features.  At most `FREQUENT` words' counts go to every task; all others
are joined to the texts' other words by hash.

Defined results: a null or empty text is its end token alone; a null doc_id is not held out; words are
told apart by 64-bit hashes; repeated rows are scored each (and counted each); without training tokens
every word is unknown and the base is log10(0.1 / 0.1) = 0; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .quality import held_out
from .words import hashes, mixed

FOLDS = 10
FREQUENT = 1 << 19
CLASSES, SLOTS = 32, 1 << 14
PARTS, PART_SLOTS = 32, 1 << 15
#: Slots are sorted as 16-bit numbers, which is fastest.
assert max(SLOTS, PART_SLOTS) <= 1 << 16
#: Weights move between tasks in blocks of slots.
BLOCK = 256
ROUNDS, STEP, RATE = 1, 4096, 0.4
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ADD = 0.1
COUNTED_AT_ONCE = 1_500_000


def token_parts(batch: pa.Array):
    """Parts of a text column: first row, tokens (words, then the end, of each row), tokens of each row."""
    for row, words, n in hashes(batch):
        ends = np.cumsum(n)
        yield row, np.insert(words, ends, END), n + 1


def history(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of the history features of every token: three rows."""
    first = np.cumsum(n) - n
    one = np.empty_like(tokens)
    one[1:], one[first] = tokens[:-1], START
    two = np.empty_like(tokens)
    two[1:], two[first] = one[:-1], START
    return np.stack([mixed(one), mixed(two ^ START), mixed(one * np.uint64(3) + mixed(two))])


def class_slots(features: np.ndarray) -> np.ndarray:
    return (features % np.uint64(SLOTS)).astype(np.int64)


def part_slots(features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (mixed(features + (classes + 1).astype(np.uint64) * END) % np.uint64(PART_SLOTS)).astype(np.int64)


def equal_bins(mass: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each word: `bins` of about equal mass, in the given order."""
    middle = np.cumsum(mass) - mass / 2
    return np.minimum(middle / max(mass.sum(), 1e-9) * bins, bins - 1).astype(np.int64)


def _sums(p: np.ndarray, rows: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of `rows` of p over runs; most runs are of one row, which needs no sum."""
    out = p[rows[starts]]
    many = np.flatnonzero(n > 1)
    if len(many):
        inside = np.repeat(n > 1, n)
        out[many] = np.add.reduceat(p[rows[inside]], np.cumsum(n[many]) - n[many])
    return out


class Factor:
    """A softmax whose scores are a row of `bias` and the weights of three slots; outcomes without mass have no probability."""

    def __init__(self, slots: int, masses: np.ndarray):
        share = masses / np.maximum(masses.sum(1, keepdims=True), 1e-9)
        self.bias = np.where(share > 0, np.log(np.where(share > 0, share, 1)), -1e9).astype(np.float32)
        self.weights = np.zeros((slots, masses.shape[1]), np.float32)

    def logits(self, slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
        w = self.weights
        return w[slots[0]] + w[slots[1]] + w[slots[2]] + self.bias[rows]

    def learn(self, slots: np.ndarray, rows: np.ndarray, outcomes: np.ndarray, used: np.ndarray) -> None:
        """One gradient step; each slot moves by the mean gradient of its uses."""
        if not len(outcomes):
            return
        p = self.logits(slots, rows)
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(outcomes)), outcomes] -= 1
        flat = slots.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        own = slots.ravel()[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        n = np.diff(np.append(starts, len(own)))
        sums = _sums(p, order % len(outcomes), starts, n)
        touched = own[starts]
        # Later uses of a slot move it less; a slot used often in one step moves by more than one use would.
        pace = RATE * np.sqrt(n) / np.sqrt(1 + used[touched] / 8)
        self.weights[touched] -= (np.minimum(pace, n) / n)[:, None].astype(np.float32) * sums
        used[touched] += n

    def log10(self, slots: np.ndarray, rows: np.ndarray, outcomes: np.ndarray) -> np.ndarray:
        z = self.logits(slots, rows)
        top = z.max(1) if len(z) else z[:, 0]
        own = z[np.arange(len(outcomes)), outcomes]
        return ((own - top).astype(np.float64) - np.log(np.exp(z - top[:, None]).sum(1, dtype=np.float64))) / np.log(10)


class Model:
    """Counts of frequent words, their classes and parts; the two softmaxes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, types: int):
        order = np.argsort(words)
        self.words, mass = words[order], counts[order].astype(np.float64) + ADD
        self.total, self.whole = total, total + ADD * (types + 1)
        by = np.argsort(-mass, kind="stable")
        self.klass, self.part = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        self.klass[by] = equal_bins(mass[by], CLASSES - 1)
        for k in range(CLASSES - 1):
            own = by[self.klass[by] == k]
            self.part[own] = equal_bins(mass[own], PARTS)
        masses = np.bincount(self.klass, mass, CLASSES).astype(np.float64)
        masses[-1] = self.rest = max(self.whole - masses.sum(), ADD)
        parts = np.bincount(self.klass * PARTS + self.part, mass, CLASSES * PARTS).astype(np.float64).reshape(CLASSES, PARTS)
        self.base = np.log10(mass / self.whole)
        self.inner = np.log10(mass / parts[self.klass, self.part])
        self.factors = Factor(SLOTS, masses[None]), Factor(PART_SLOTS, parts)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens among the frequent words, and which are there."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return at, self.words[at] == tokens

    def outcomes(self, at: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and part of tokens found by `find`; all other words are the last class, which has no parts."""
        if not len(self.words):
            return np.full(len(at), CLASSES - 1), np.zeros(len(at), np.int64)
        return np.where(there, self.klass[at], CLASSES - 1), self.part[at]

    def learn(self, features: np.ndarray, classes: np.ndarray, parts: np.ndarray, used: list[np.ndarray]) -> None:
        self.factors[0].learn(class_slots(features), np.zeros_like(classes), classes, used[0])
        own = np.flatnonzero(classes < CLASSES - 1)
        self.factors[1].learn(part_slots(features[:, own], classes[own]), classes[own], parts[own], used[1])

    def log10_outcomes(self, features: np.ndarray, classes: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """log10 of P(class | history) * P(part | class, history)."""
        out = self.factors[0].log10(class_slots(features), np.zeros_like(classes), classes)
        own = np.flatnonzero(classes < CLASSES - 1)
        out[own] += self.factors[1].log10(part_slots(features[:, own], classes[own]), classes[own], parts[own])
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """h, n: how often each token, by hash, stands in `docs`."""

    def add_up(batches):
        held, size = [], 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for b in batches:
            for _, tokens, _ in token_parts(b.column(0)):
                held.append(tokens)
                size += len(tokens)
            if size > COUNTED_AT_ONCE:
                yield out()
                held, size = [], 0
        yield out()

    return docs.select("text").mapInArrow(add_up, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def fit_counts(counts: DataFrame) -> tuple[Model, int]:
    """The untrained model, and the least count of a frequent word.  Bins of counts and at most FREQUENT words come to the driver."""
    step = F.floor(F.log2("n") * 8).cast("int")
    bins = counts.groupBy(step.alias("bin")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.min("n").alias("least")).collect()
    types, total, kept, cut = sum(b.types for b in bins), sum(b.tokens for b in bins), 0, 1 << 62
    for b in sorted(bins, key=lambda b: -b.least):
        if kept + b.types > FREQUENT:
            break
        kept, cut = kept + b.types, b.least
    got = counts.where(F.col("n") >= cut).toArrow()
    return Model(got["h"].to_numpy().view(np.uint64), got["n"].to_numpy(), int(total), int(types)), cut


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Gradient updates over all texts of `docs`."""
    spark = docs.sparkSession
    for _ in range(rounds):
        known = spark.sparkContext.broadcast(model)

        def steps(batches):
            m = known.value
            starts, used = [f.weights for f in m.factors], [np.zeros(len(f.weights)) for f in m.factors]
            for f in m.factors:
                f.weights = f.weights.copy()
            for b in batches:
                for _, tokens, n in token_parts(b.column(0)):
                    features, (classes, parts) = history(tokens, n), m.outcomes(*m.find(tokens))
                    for at in range(0, len(tokens), STEP):
                        m.learn(features[:, at : at + STEP], classes[at : at + STEP], parts[at : at + STEP], used)
            for k, f in enumerate(m.factors):
                moved, f.weights = (f.weights - starts[k]) * used[k][:, None].astype(np.float32), starts[k]
                picked = [i for i in range(0, len(moved), BLOCK) if used[k][i : i + BLOCK].any()]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(picked), pa.int32()), pa.array([i // BLOCK for i in picked], pa.int32()), pa.array([moved[i : i + BLOCK].tobytes() for i in picked], pa.binary()), pa.array([used[k][i : i + BLOCK].tobytes() for i in picked], pa.binary())], names=["factor", "block", "moved", "used"])

        def average(key, rows):
            moved = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in sorted(rows["moved"].to_pylist())).reshape(BLOCK, -1)
            used = sum(np.frombuffer(x) for x in sorted(rows["used"].to_pylist()))
            return pa.table({"factor": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "change": pa.array([(moved / np.maximum(used, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())})

        changes = docs.select("text").mapInArrow(steps, "factor int, block int, moved binary, used binary").groupBy("factor", "block").applyInArrow(average, "factor int, block int, change binary").collect()
        for r in changes:
            model.factors[r.factor].weights[r.block * BLOCK : (r.block + 1) * BLOCK] += np.frombuffer(r.change, np.float32).reshape(BLOCK, -1)
    return model


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id"), FOLDS))
    learned = docs.where(~F.col("held_out"))
    counts = count_words(learned).persist(StorageLevel.DISK_ONLY)
    model, cut = fit_counts(counts)
    known = spark.sparkContext.broadcast(train(learned, model))
    n_train = model.total

    def score(batches):
        m = known.value
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for _, tokens, n in token_parts(b.column(0)):
                ends = np.cumsum(n)
                row = np.repeat(np.arange(len(n)), n)
                at, there = m.find(tokens)
                features, (classes, parts) = history(tokens, n), m.outcomes(at, there)
                got = np.concatenate([m.log10_outcomes(features[:, i : i + STEP], classes[i : i + STEP], parts[i : i + STEP]) for i in range(0, len(tokens), STEP)])
                base = np.where(there, m.base[at] if len(m.words) else 0, 0.0)
                got += np.where(there, m.inner[at] if len(m.words) else 0, 0.0)
                rare, where = tokens[~there].view(np.int64), np.cumsum(np.bincount(row[~there], minlength=len(n)))
                rows[0] += n.tolist()
                rows[1] += np.bincount(row, there, len(n)).astype(np.int64).tolist()
                rows[2] += np.add.reduceat(base, ends - n).tolist()
                rows[3] += np.add.reduceat(got, ends - n).tolist()
                for i, end in enumerate(where):
                    h, times = np.unique(rare[where[i - 1] if i else 0 : end], return_counts=True)
                    rows[4].append(h)
                    rows[5].append(times.astype(np.int32))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *(pa.array(r, k) for r, k in zip(rows, kinds))], names=["doc_id", "held_out", "n_tokens", "known", "base", "got", "rare", "times"])

    scored = docs.select("text", "doc_id", "held_out").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, known long, base double, got double, rare array<long>, times array<int>")
    # Ids depend on the scan's parts alone, so a part that is computed again has the same.
    scored = scored.withColumn("row", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    n = F.coalesce(F.col("n"), F.lit(0))
    more = rare.join(counts.where(F.col("n") < cut), "h", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((n + ADD) / model.whole)).alias("more_base"), F.sum(F.col("times") * F.log10((n + ADD) / model.rest)).alias("more_got"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("rare", "times").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"), (F.col("got") + zero("more_got")).alias("score"),
    )

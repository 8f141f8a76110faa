"""Operator 10: near-duplicate vectors by product quantisation.

Equal vectors are one class.  Class vectors, scaled to length 1, go into the coarse inverted lists of
`TABLES` quantisers, each of a rotation of its own: the parts of a rotated vector each have a nearest
centroid, and these together name the list.  What remains is coded by subspace.  In each of its
lists a vector is compared with the others by table look-ups, which give the distance to each coded
vector, off by the coding error at most; what may be near by that bound is compared exactly in
double precision.  A pair that shares several lists counts in the first of them.

How many lists are probed is thus fixed, and lists have about `LIST_ROWS` rows at every size, so rows
moved and compared grow with the input.  A pair is missed only where all quantisers part it: on the
supplied vectors one finds 99.7 % of the links and four 99.999 %; tests hold recall against brute force.
Centroids and codes are fitted to at most about `FIT_ROWS` rows (a documented bound).  Lists that are
longer than `LONG` are compared in blocks, so that no task holds a long list.

Defined results: a vector that is null, zero or has null or non-finite components has no links and is its
own component; a row without vec_id likewise, with null component; shorter vectors count as ending in
zeros; a repeated row (same id and vector) is one vector, and gives as many equal rows as it had; ties do
not occur, as links alone count; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stash
from .components import _roots, components
from .vectors import bounded_sample, listed, matrix, rows_of, usable

COSINE = 0.95
FIT_ROWS = 10_000
TABLES, LIST_ROWS, LONG = 8, 64, 8192
MOST_CENTRES, SUBSPACES, CODES, FIT_ROUNDS = 256, 8, 32, 8
#: Room for rounding in the bounds.
SLACK = 1e-5


def kmeans(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        near = (rows @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _split(width: int, parts: int) -> list[np.ndarray]:
    return np.array_split(np.arange(width), min(parts, width))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


class Quantiser:
    """A rotation, coarse centroids of its parts, and the code books of what remains."""

    def __init__(self, sample: np.ndarray, total: int, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
        lists = max(1, total / LIST_ROWS)
        parts = next((m for m in (2, 3) if MOST_CENTRES**m >= lists), 4)
        self.parts, self.cuts = _split(width, parts), _split(width, SUBSPACES)
        rows = sample @ self.rotation
        self.centres = [kmeans(rows[:, c], int(np.ceil(lists ** (1 / len(self.parts)))), rng) for c in self.parts]
        rest = rows - self.centre(self.lists(rows))
        self.books = [kmeans(rest[:, c], CODES, rng) for c in self.cuts]

    def lists(self, rows: np.ndarray) -> np.ndarray:
        """The list of each (rotated) row, as one number."""
        out = np.zeros(len(rows), np.int64)
        for cut, centres in zip(self.parts, self.centres):
            out = out * len(centres) + _nearest(rows[:, cut], centres)
        return out

    def centre(self, lists: np.ndarray) -> np.ndarray:
        out, left = [], lists
        for centres in self.centres[::-1]:
            out.append(centres[left % len(centres)])
            left = left // len(centres)
        return np.concatenate(out[::-1], 1)

    def encode(self, rows: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far the coded vectors are from the true ones."""
        rest = rows - self.centre(lists)
        codes = np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books)], 1).astype(np.uint8)
        made = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - made) ** 2).sum(1))

    def distances(self, rows: np.ndarray, where: int, codes: np.ndarray) -> np.ndarray:
        """Distances of (rotated) rows to coded vectors of one list, by table look-up."""
        rest = rows - self.centre(np.array([where]))
        out = np.zeros((len(rows), len(codes)), np.float32)
        for i, (c, b) in enumerate(zip(self.cuts, self.books)):
            x = rest[:, c]
            table = ((x**2).sum(1)[:, None] + (b**2).sum(1) - 2 * x @ b.T).astype(np.float32)
            out += table[:, codes[:, i]]
        return np.sqrt(np.maximum(out, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows with `block`, and `low` and `high`: the two blocks of its list (t, list) that a row is compared in.

    A list of up to `most` rows is one block; a longer one is dealt over blocks of half that size, and each meets itself and each other."""
    cut = rows.groupBy("t", "list").agg(F.count("*").alias("k")).where(F.col("k") > most).select("t", "list", F.ceil(2 * F.col("k") / most).alias("parts"))
    told = rows.join(cut, ["t", "list"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    told = told.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(11)), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return told.select("t", "list", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "members", "embedding", "codes", "error", "homes")


def compared(q: Quantiser, t: int, where: int, rows: dict[str, np.ndarray], cosine: float):
    """Rows' numbers of linked vectors, and pairs of linked rows, of one list; a pair that met in an earlier list is left out."""
    radius = float(np.sqrt(2 - 2 * cosine))
    x, cid, block, homes = rows["unit"], rows["cid"], rows["block"], rows["homes"]
    turned, reach, apart = x @ q.rotation, radius + rows["error"] + SLACK, block.min() != block.max()
    linked, a, b = np.zeros(len(x), np.int64), [], []
    for at in range(0, len(x), 256):
        i, j = np.nonzero(q.distances(turned[at : at + 256], where, rows["codes"]) <= reach)
        i += at
        fits = (cid[i] != cid[j]) & ((block[i] != block[j]) if apart else True)
        i, j = i[fits], j[fits]
        fits = (np.einsum("ij,ij->i", x[i], x[j]) >= cosine) & ~(homes[i, :t] == homes[j, :t]).any(1)
        i, j = i[fits], j[fits]
        linked += np.bincount(i, rows["members"][j], len(x)).astype(np.int64)
        a.append(i)
        b.append(j)
    return linked, np.concatenate(a), np.concatenate(b)


def class_links(classes: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """From classes (cid, embedding, members): links (cid, linked: members of linked classes), and edges a, b that connect the linked classes."""
    spark = classes.sparkSession
    shape = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not shape.n:
        none = spark.createDataFrame([], "cid long, linked long")
        return none, spark.createDataFrame([], "a long, b long")
    width = shape.width
    sample = bounded_sample(classes, FIT_ROWS, shape.n).select("embedding").toArrow()
    rows = unit(matrix(sample.column(0), width)) if len(sample) else np.eye(1, width)
    known = spark.sparkContext.broadcast([Quantiser(rows, shape.n, 5 + t) for t in range(TABLES)])

    def code(batches):
        for b in batches:
            if not len(b):
                continue
            rows = unit(matrix(b.column(1), width))
            turned = [rows @ q.rotation for q in known.value]
            homes = np.stack([q.lists(x) for q, x in zip(known.value, turned)], 1)
            coded = [q.encode(x, h) for q, x, h in zip(known.value, turned, homes.T)]
            codes = pa.ListArray.from_arrays(np.arange(0, TABLES * len(b) + 1, TABLES, dtype=np.int32), pa.array([c[i].tobytes() for i in range(len(b)) for c, _ in coded], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), codes, listed(np.stack([e for _, e in coded], 1)), listed(homes)], names=["cid", "embedding", "members", "codes", "error", "homes"])

    def compare(batches):
        for t, where, low, high, block, cid, members, vector, codes, error, homes in _lists(batches, width):
            x = unit(vector)
            for start, end in zip(*_bounds(t, where, low, high)):
                if end - start < 2:
                    continue
                own = slice(start, end)
                linked, a, b = compared(known.value[t[start]], int(t[start]), int(where[start]), {"unit": x[own], "cid": cid[own], "block": block[own], "homes": homes[own], "members": members[own], "codes": codes[own], "error": error[own]}, cosine)
                ids = cid[own]
                nodes, roots = _roots(ids[a], ids[b])
                some, far = linked > 0, nodes != roots
                n, e = int(some.sum()), int(far.sum())
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], nodes[far]])), pa.array(np.concatenate([linked[some], np.zeros(e, np.int64)])), pa.array(np.concatenate([np.full(n, -1), roots[far]]))], names=["cid", "linked", "root"])

    prepare(spark)
    coded = stash(classes.select("cid", "embedding", "members").mapInArrow(code, "cid long, embedding array<float>, members long, codes array<binary>, error array<double>, homes array<long>"))
    rows = coded.select("cid", "embedding", "members", "homes", F.posexplode(F.arrays_zip("homes", "codes", "error")).alias("t", "x")).select("t", F.col("x.homes").alias("list"), "cid", "embedding", "members", F.col("x.codes").alias("codes"), F.col("x.error").alias("error"), "homes")
    keys = ("t", "list", "low", "high")
    dealt = in_blocks(rows, LONG).repartition(*keys).sortWithinPartitions(*keys)
    found = stash(dealt.mapInArrow(compare, "cid long, linked long, root long"))
    return found.where("root = -1").groupBy("cid").agg(F.sum("linked").alias("linked")), found.where("root >= 0").select(F.col("cid").alias("a"), F.col("root").alias("b"))


def _bounds(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys."""
    change = np.any([k[1:] != k[:-1] for k in keys], 0)
    starts = np.concatenate([[0], np.flatnonzero(change) + 1])
    return starts, np.append(starts[1:], len(keys[0]))


def _lists(batches, width: int):
    """Columns of whole runs of (t, list, low, high), which the rows are sorted by."""
    held: list[list[np.ndarray]] = []

    def arrays(b):
        plain = [b.column(i).to_numpy() for i in range(7)]
        codes = b.column(8)
        return [*plain, matrix(b.column(7), width), np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1), b.column(9).to_numpy(), matrix(b.column(10), TABLES, np.int64)]

    for b in batches:
        if not len(b):
            continue
        part = arrays(b)
        start = int(_bounds(*part[:4])[0][-1])
        if held and (start or any(c[-1] != x[0] for c, x in zip(held[-1][:4], part[:4]))):
            yield [np.concatenate(c) for c in zip(*held, [c[:start] for c in part])]
            held = []
        elif start:
            yield [c[:start] for c in part]
        held.append([c[start:] for c in part])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def near_duplicates(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `table` (vec_id, embedding)."""
    rows = rows_of(table)
    classes = rows.groupBy("embedding").agg(F.count("*").alias("members"), F.min("vec_id").alias("first"))
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()))
    links, edges = class_links(classes, cosine)
    stars = stash(components(edges))
    told = classes.join(stars.withColumnRenamed("id", "cid"), "cid", "left").join(links, "cid", "left").select("embedding", "first", F.coalesce("component", "cid").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).alias("links"))
    # Most components are one class; only the others' classes meet to find the least id.
    least = told.groupBy("component").agg(F.min("first").alias("least"))
    told = told.join(least, "component").select("embedding", "links", "least")
    every = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    can = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    judged = every.where(can).join(told, "embedding").select("vec_id", F.col("links").alias("n_links"), F.col("least").alias("component_id"))
    rest = every.where(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

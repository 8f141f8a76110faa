"""Operator 5: n-gram Jaccard join by T-occurrence search.

A document is the set of its word shingles, as 64-bit hashes.  Documents of equal sets are one class.  A
pair of similar classes must share a token among the first tokens of each, in one order for all: by
how often a token occurs, as a sketch of fixed size estimates it.  So common tokens come last, and lists of
documents by first token stay short, also for passages that recur in a fixed share of all documents.  The
sketch only orders tokens; it decides no result.

Pairs are searched in two steps, each a T-occurrence query of a hub against its partners: the hub's tokens are
inverted lists of partners, the short ones are merged, and the partners that may still reach the
required number are looked up in the long ones by binary search (DivideSkip).  The first step
searches first tokens only and needs the overlap that similar sets must have there; the second searches whole sets.

In a short list all pairs are searched that size and place of the token allow.  In a long list every row meets the
pivot of its size, the row with the fewest rarer tokens: the original in a list of edited copies.
That leaves pairs within long lists that no link connects yet.  All of those that
size and place allow are searched last, in blocks.  So components are exact, and a group of
copies costs rows in proportion to its size.

Defined results: a null, empty or blank text has an empty set and links with nothing; a text of fewer words
than a shingle is one shingle; very long texts are handled whole, in parts of 512 KB; rows without doc_id take
part, but name no component; repeated rows are rows of one class; ties do not occur, as links alone count; classes and
shingles are told apart by 64-bit hashes; an empty table has no rows;
extra columns are ignored by `components_of`, kept by `one_of_each`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, stash
from .components import components
from .words import hashes, mixed

#: Shingle length in words, and least similarity in hundredths, unless a contract says otherwise.
WORDS, PERCENT = 5, 80
#: Counters of the sketch, the blocks they move in, and steps of a counter's logarithm.
COUNTERS, PARTS, STEPS = 1 << 22, 64, 8
#: Lists up to this length are searched pair by pair; longer ones from pivots first.
SHORT = 4
#: Rows of a list that meet in one task: longer lists are salted, and compared in blocks.
BLOCK = 500_000
SALTED = 50_000
#: Bits of the filter that is sent to all tasks, to skip most of the sets that are not wanted early.
FILTER_BITS = 1 << 27
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(texts: pa.Array, words: int):
    """For every row: its shingles' hashes, sorted."""
    for _, h, n in hashes(texts):
        ends = np.cumsum(n)
        joined = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words if len(h) >= words else 0):
            joined += h[k : len(h) - words + 1 + k] * _MIX[k % len(_MIX)] * np.uint64(2 * (k // len(_MIX)) + 1)
        joined = mixed(joined)
        for end, size in zip(ends.tolist(), n.tolist()):
            start = end - size
            if size >= words:
                yield np.unique(joined[start : end - words + 1])
            elif size:
                yield mixed(np.array([np.sum(h[start:end] * _MIX[:size]) + np.uint64(size)], np.uint64))
            else:
                yield joined[:0]


def set_hash(tokens: np.ndarray) -> int:
    """One number for a sorted set."""
    if not len(tokens):
        return 0
    x = mixed(tokens + mixed(np.arange(len(tokens), dtype=np.uint64)))
    return int(np.bitwise_xor.reduce(x) ^ np.sum(x * _MIX[0])) & 0xFFFFFFFFFFFFFFFF


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def needed(n, m, percent: int):
    """Least common tokens of similar sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def read_sets(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """Rows (doc_id, f, n), and the sketch: the logarithm of each counter, in steps."""

    def run(batches):
        counters = np.zeros(COUNTERS, np.int64)
        seen: set[int] = set()
        for b in batches:
            f, n, fresh = [], [], []
            for s in shingle_sets(b.column(1), words):
                f.append(set_hash(s))
                n.append(len(s))
                if f[-1] not in seen:
                    fresh.append(s)
                    if len(seen) < 1_000_000:
                        seen.add(f[-1])
            if fresh:
                np.add.at(counters, _slots(np.concatenate(fresh)), 1)
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(f)), pa.array(n, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=NAMES)
        if seen:
            yield _packed(counters, TaskContext.get().partitionId())

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                more = _unpacked(counts)
                sums[part] = sums[part] + more if part in sums else more
        for part, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_narrow(counts)], pa.binary())], names=["part", "counts"])

    made = stash(_texts(docs).mapInArrow(run, "doc_id long, f long, n long, part int, salt int, counts binary"))
    some = made.where("part is not null").repartition("part", "salt").select("part", "counts").mapInArrow(add_up, "part int, counts binary")
    sums = some.repartition("part").mapInArrow(add_up, "part int, counts binary").collect()  # one row a part
    counters = np.zeros(COUNTERS, np.int64)
    for r in sums:
        counters[r.part * (COUNTERS // PARTS) : (r.part + 1) * (COUNTERS // PARTS)] = _unpacked(r.counts)
    rows = made.where("part is null").select("doc_id", "f", "n")
    rows.stash_path = made.stash_path
    return rows, np.minimum(np.log2(counters + 1) * STEPS, 255).astype(np.uint8)


NAMES = ["doc_id", "f", "n", "part", "salt", "counts"]


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)


def _narrow(counts: np.ndarray) -> bytes:
    """A part's counters in as few bytes each as the largest needs, compressed."""
    return zlib.compress(counts.astype(np.min_scalar_type(counts.max())).tobytes(), 1)


def _unpacked(part: bytes) -> np.ndarray:
    plain = zlib.decompress(part)
    return np.frombuffer(plain, f"u{len(plain) // (COUNTERS // PARTS)}").astype(np.int64)


#: Shares of the tasks whose counters are added up before those of all.
SHARES = 8


def _packed(counters: np.ndarray, salt: int) -> pa.RecordBatch:
    counts = [_narrow(x) for x in np.split(counters, PARTS)]
    blank = pa.nulls(PARTS, pa.int64())
    return pa.RecordBatch.from_arrays([blank, blank, blank, pa.array(range(PARTS), pa.int32()), pa.array([salt % SHARES] * PARTS, pa.int32()), pa.array(counts, pa.binary())], names=NAMES)


def prefixes(docs: DataFrame, words: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """f, n, tokens, light, salts of every class once: its first tokens; those from place `light` on are so common that their lists are dealt over `salts` tasks."""
    known = docs.sparkSession.sparkContext.broadcast((sketch, float(2 ** (np.median(sketch) / STEPS))))

    def run(batches):
        levels, noise = known.value
        deals = np.ceil(np.maximum(2 ** ((np.arange(256) + 1) / STEPS) - 2 * noise, 1) / SALTED).astype(np.int64)
        seen: set[int] = set()
        for b in batches:
            fs, ns, lights, tokens, salts = [], [], [], [], []
            for s in shingle_sets(b.column(1), words):
                f = set_hash(s)
                if not len(s) or f in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(f)
                level = levels[_slots(s)]
                first = np.argsort(level, kind="stable")[: prefix_size(len(s), percent)]
                dealt = deals[level[first]]
                light = int((dealt == 1).sum())
                fs.append(f)
                ns.append(len(s))
                lights.append(light)
                tokens.append(s[first].view(np.int64))
                salts.append(dealt[light:])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(_signed(fs)), pa.array(ns, pa.int32()), pa.array(lights, pa.int32()), pa.array(tokens, lists), pa.array(salts, lists)], names=["f", "n", "light", "tokens", "salts"])

    return stash(_texts(docs).mapInArrow(run, "f long, n int, light int, tokens array<long>, salts array<long>").dropDuplicates(["f"]))


def postings(firsts: DataFrame) -> DataFrame:
    """token, salt, f, n, place: one row for each first token of a class; common tokens' rows are salted."""
    rows = firsts.select("f", "n", "light", "salts", F.posexplode("tokens").alias("place", "token"))
    salt = F.when(F.col("place") < F.col("light"), 0).otherwise(1 + F.pmod(F.xxhash64("f"), F.get("salts", F.col("place") - F.col("light")))).cast("int")
    return rows.select("token", salt.alias("salt"), "f", "n", "place")


def _may(n, i, m, j, percent: int):
    """Can sets of n and m be similar whose first common token is at places i and j?  By size, and by what is left from there on; a pair that is similar passes at its first common token, whatever happens at others."""
    size = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return size & (np.minimum(n - i, m - j) >= needed(n, m, percent))


def _runs(batches, keys: int):
    """Rows sorted by their first `keys` columns, as lists of column arrays that hold whole runs."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        part = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(part[0]):
            continue
        last = [c[-1] for c in part[:keys]]
        same = np.ones(len(part[0]), bool)
        for c, x in zip(part, last):
            same &= c == x
        start = 0 if same.all() else int(len(same) - np.argmin(same[::-1]))
        if held and (start or any(c[-1] != x for c, x in zip(held[-1], last))):
            # The run that is held ends in this batch, or before it.
            yield [np.concatenate(c) for c in zip(*held, [c[:start] for c in part])]
            held = []
        elif start:
            yield [c[:start] for c in part]
        held.append([c[start:] for c in part])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before in one of the keys."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def stars(group: np.ndarray, n: np.ndarray, f: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots (rows), one for each size of each group, and pairs of rows: each row with its pivot, and pivots of neighbouring sizes."""
    size = np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64) if percent < 100 else n.astype(np.int64)
    order = np.lexsort((mixed(f.view(np.uint64)), place, size, group))
    heads = _heads(group[order], size[order])
    pivots = order[heads]
    a, b = pivots[np.cumsum(heads) - 1], order
    near = np.flatnonzero((group[pivots][1:] == group[pivots][:-1]) & (size[pivots][1:] == size[pivots][:-1] + 1))
    a, b = np.concatenate([a, pivots[near]]), np.concatenate([b, pivots[near + 1]])
    fits = (a != b) & _may(n[a], place[a], n[b], place[b], percent)
    return pivots, a[fits], b[fits]


def list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Rows hub, f: pairs to search; rows with a token: postings of long or salted lists; with pivot: the pivots of salted lists."""

    def run(batches):
        for token, salt, n, f, place in _runs(batches, 2):
            head = _heads(token, salt)
            group = np.cumsum(head) - 1
            sizes = np.diff(np.append(np.flatnonzero(head), len(f)))
            brief = sizes[group] <= SHORT
            hub, own = [], []
            for step in range(1, SHORT):
                a = np.flatnonzero(brief[:-step] & (group[:-step] == group[step:]))
                a = a[_may(n[a], place[a], n[a + step], place[a + step], percent)]
                hub.append(np.minimum(f[a], f[a + step]))
                own.append(np.maximum(f[a], f[a + step]))
            rows = np.flatnonzero(~brief | (salt > 0))
            pivots, a, b = stars(group[rows], n[rows], f[rows], place[rows], percent)
            hub.append(f[rows[a]])
            own.append(f[rows[b]])
            pivots = rows[pivots][salt[rows[pivots]] > 0]
            hub, own = np.concatenate(hub), np.concatenate(own)
            told = np.concatenate([rows, pivots])
            k = len(told)
            zeros = np.zeros(len(hub), np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(hub), pa.nulls(k, pa.int64())]), pa.array(np.concatenate([own, f[told]])), pa.concat_arrays([pa.nulls(len(hub), pa.int64()), pa.array(token[told])]),
                    pa.array(np.concatenate([zeros, n[told]])), pa.array(np.concatenate([zeros, place[told]])), pa.array(np.arange(len(hub) + k) >= len(hub) + len(rows)),
                ],
                names=["hub", "f", "token", "n", "place", "pivot"],
            )

    sorted_lists = lists.repartition("token", "salt").sortWithinPartitions("token", "salt").select("token", "salt", "n", "f", "place")
    return stash(sorted_lists.mapInArrow(run, "hub long, f long, token long, n int, place int, pivot boolean"))


def pivot_pairs(pivots: DataFrame, percent: int) -> DataFrame:
    """Pairs of a token's pivots of different salts."""

    def run(batches):
        for token, n, f, place in _runs(batches, 1):
            _, a, b = stars(np.cumsum(_heads(token)), n, f, place, percent)
            yield pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], names=["hub", "f"])

    return pivots.select("token", "n", "f", "place").repartition("token").sortWithinPartitions("token").mapInArrow(run, "hub long, f long")


def search(hub: np.ndarray, partners: list[np.ndarray], required: np.ndarray) -> np.ndarray:
    """T-occurrence query: which partners hold at least `required` (one number each) of the hub's tokens; all are sorted sets."""
    tokens, who = np.concatenate(partners), np.repeat(np.arange(len(partners)), [len(p) for p in partners])
    at = np.minimum(np.searchsorted(hub, tokens), len(hub) - 1)
    hit = hub[at] == tokens
    at, who = at[hit], who[hit]
    # The inverted list of each of the hub's tokens: the partners that hold it, in order.
    order = np.lexsort((who, at))
    lists, ends = who[order], np.cumsum(np.bincount(at, minlength=len(hub)))
    length = np.diff(ends, prepend=0)
    # Long lists, fewer than any partner must reach, are set aside; the others are merged, and runs of one partner counted.
    most = min(int(required.min()) - 1, int((length > len(partners) / 2).sum()))
    aside = np.argsort(-length, kind="stable")[: max(0, most)]
    short = np.ones(len(hub), bool)
    short[aside] = False
    merged = np.sort(lists[np.repeat(short, length)], kind="stable")
    count = np.bincount(merged, minlength=len(partners))
    open_ = np.flatnonzero((count < required) & (count + len(aside) >= required))
    for t in aside:
        own = lists[ends[t] - length[t] : ends[t]]
        count[open_] += own[np.minimum(np.searchsorted(own, open_), len(own) - 1)] == open_
    return count >= required


def _searched(batch: pa.RecordBatch, required) -> np.ndarray:
    """Which rows (hub, f, n, m, own tokens, hub's tokens, as lists or as sorted bytes) pass, hub by hub."""
    hubs, n, m = (batch.column(i).to_numpy() for i in (0, 2, 3))
    plain = pa.types.is_binary(batch.column(4).type)
    read = lambda x: np.frombuffer(x.as_buffer(), np.uint64) if plain else np.sort(x.values.to_numpy().view(np.uint64))
    keep = np.zeros(len(hubs), bool)
    order = np.argsort(hubs, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(hubs[order])) + 1):
        if len(group):
            hub, partners = read(batch.column(5)[int(group[0])]), [read(batch.column(4)[int(i)]) for i in group]
            keep[group] = search(hub, partners, required(n[group], m[group], len(hub), np.array([len(p) for p in partners])))
    return keep


def matching(pairs: DataFrame, sets: DataFrame, required) -> DataFrame:
    """The pairs (hub, f) whose sets (f, n, tokens) share as many tokens as `required` says of sizes n, m and of the numbers of tokens given."""

    def run(batches):
        for b in batches:
            keep = pa.array(_searched(b, required))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["hub", "f"])

    # Named anew for both joins alike, so that Spark shuffles the sets once for both.
    named = lambda *names: sets.select(*(F.col(c).alias(new) for c, new in zip(("f", "n", "tokens"), names)))
    side = pairs.join(named("own", "size", "held"), F.col("f") == F.col("own"))
    both = side.join(named("hub", "m", "others"), "hub")
    return stash(both.select("hub", "f", F.col("size").alias("n"), "m", F.col("held").alias("tokens"), "others").mapInArrow(run, "hub long, f long"))


def likely(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, f), each once, that share enough first tokens.

    Of two sets, let a's first tokens end first in the common order.  Common tokens up to that place are
    first tokens of both, and beyond it a has n - p tokens only.  So similar sets share at least the
    needed number less n - p among first tokens; the larger n - p of both is safe."""
    pairs = stash(pairs.distinct())
    out = matching(pairs, asked_for(firsts, pairs), lambda n, m, k, ks: np.maximum(needed(n, m, percent) - np.maximum(n - ks, m - k), 1))
    discard(pairs)
    return out


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (hub, f) that are similar."""
    return matching(pairs, sets, lambda n, m, k, ks: needed(n, m, percent)).select(F.col("hub").alias("a"), F.col("f").alias("b"))


def filter_of(wanted: DataFrame) -> np.ndarray:
    """Words of a filter of fixed size with a bit for each f of `wanted`; only its words come to the driver."""
    bit = F.pmod(F.col("f"), F.lit(FILTER_BITS))
    words = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(f & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def may_hold(words: np.ndarray, f: np.ndarray) -> np.ndarray:
    bit = f.view(np.uint64) % np.uint64(FILTER_BITS)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def both_sides(pairs: DataFrame) -> DataFrame:
    return pairs.select("f").unionByName(pairs.select(F.col("hub").alias("f")))


def asked_for(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets without most of those that stand in no pair, so that these are not shuffled."""
    known = sets.sparkSession.sparkContext.broadcast(filter_of(both_sides(pairs)))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(may_hold(known.value, b.column(0).to_numpy())))

    return sets.select("f", "n", "tokens").mapInArrow(run, "f long, n int, tokens array<long>")


def read_again(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """f, n and tokens (sorted, as bytes) of the classes in `wanted`, each once."""
    known = docs.sparkSession.sparkContext.broadcast(filter_of(wanted))

    def run(batches):
        held = known.value
        seen: set[int] = set()
        for b in batches:
            f, sets = [], []
            for s in shingle_sets(b.column(1), words):
                own = int(_signed([set_hash(s)])[0])
                if not len(s) or own in seen or not may_hold(held, np.array([own]))[0]:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(own)
                f.append(own)
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array([len(s) // 8 for s in sets], pa.int32()), pa.array(sets, pa.binary())], names=["f", "n", "tokens"])

    sets = _texts(docs).mapInArrow(run, "f long, n int, tokens binary")
    return stash(sets.join(wanted, "f", "left_semi").dropDuplicates(["f"]))


def open_lists(long_lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings, with components, of lists that hold more than one component."""
    told = long_lists.join(labels.select(F.col("id").alias("f"), "component"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    mixed_up = told.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    return stash(told.join(mixed_up, "token"))


def blocks(lists: DataFrame) -> DataFrame:
    """The rows of lists with `block`, and `low` and `high`: the two blocks of its list that a row is compared in.

    A list of up to `BLOCK` rows is one block.  A longer one is dealt by hash over blocks of half that size,
    and each block meets itself and each other one, so every pair of rows meets and no task holds a list.
    The lists that are cut are at most as many as `BLOCK` goes into all rows."""
    cut = lists.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK).select("token", F.ceil(2 * F.col("k") / BLOCK).alias("parts"))
    told = lists.join(F.broadcast(cut), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    told = told.withColumn("block", F.pmod(F.xxhash64("f"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return told.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "n", "f", "place", "component", "block")


def crossing_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list that lie in different components and may be similar."""

    def run(batches):
        for token, low, high, n, f, place, component, block in _runs(batches, 3):
            starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            for start, end in zip(starts, np.append(starts[1:], len(token))):
                within = low[start] == high[start]
                reach = start + np.searchsorted(n[start:end], 100 * n[start:end].astype(np.int64) // percent, "right")
                # Rows behind which only their own component comes within reach are passed over.
                changes = np.append(start + 1 + np.flatnonzero(component[start + 1 : end] != component[start : end - 1]), end)
                behind = changes[np.searchsorted(changes, np.arange(start, end), "right").clip(max=len(changes) - 1)]
                for at in start + np.flatnonzero(behind < reach):
                    j = np.arange(at + 1, reach[at - start])
                    j = j[(component[j] != component[at]) & (f[j] != f[at]) & (within | (block[j] != block[at])) & _may(n[at], place[at], n[j], place[j], percent)]
                    if len(j):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), f[at])), pa.array(f[j])], names=["hub", "f"])

    rows = blocks(lists).repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "f")
    return rows.mapInArrow(run, "hub long, f long")


def found_links(docs: DataFrame, words: int, percent: int, pairs: DataFrame, firsts: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) among pairs and those known before, and the components that they make."""
    pairs = likely(pairs, firsts, percent)
    wanted = both_sides(pairs).distinct()
    sets = read_again(docs, words, wanted)
    found = links(pairs, sets, percent)
    discard(pairs, sets)
    if known is not None:
        found = known.unionByName(found)
    return found, stash(components(found))


def components_of(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`."""
    prepare(docs.sparkSession)
    rows, sketch = read_sets(docs, words)
    firsts = prefixes(docs, words, percent, sketch)
    found = list_pairs(postings(firsts), percent)
    long_lists = found.where("token is not null and not pivot").select("token", "f", "n", "place")
    pairs = found.where("hub is not null").select("hub", "f").unionByName(pivot_pairs(found.where("pivot"), percent))
    known, labels = found_links(docs, words, percent, pairs, firsts, None)
    lists = open_lists(long_lists, labels)
    if lists.limit(1).count():
        _, labels = found_links(docs, words, percent, crossing_pairs(lists, percent), firsts, known)
    discard(firsts, found, lists)
    classes = rows.where("n > 0").groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("k"))
    told = classes.join(labels.select(F.col("id").alias("f"), "component"), "f", "left")
    alone = told.where("component is null and k > 1").select("f", F.col("least").alias("component_id"))
    linked = told.where("component is not null").select("f", "least", "component")
    linked = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("f", "component_id")
    out = rows.join(alone.unionByName(linked), "f", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out.reads = (rows, labels)
    return out


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` whose id is their component's least, each id once; rows without id stay."""
    told = components_of(docs, words, percent)
    judged = stash(told)
    discard(*told.reads)
    gone = judged.where("doc_id <> component_id").select("doc_id").distinct()
    often = judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if not often.limit(1).count():
        return kept
    return kept.join(often, "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(often, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))

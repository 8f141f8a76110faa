"""Operator 12: best-fit packing by a grouping genetic algorithm on islands.

Every document is tokenised, closed with one id, and cut only where it is longer than a sequence; pieces of a whole
sequence stand alone.  The others are dealt at random into chunks of about 8,192, each a bin-packing problem of its own.
Several islands, each a task, search the same chunk: a population starts from best-fit decreasing and from best-fit in disturbed
orders; a crossover injects whole well-filled bins of one parent into the other, removes the bins that hold the
same documents twice, and puts what they held besides back by best-fit; a mutation dissolves the emptiest bins.
After each spell an island's best packing migrates to the next island of the chunk.  A chunk whose packing has as few bins as its
tokens need at least is done.  The emptiest bins of each chunk, at most a sixteenth of its pieces, are packed again
with those of all others, until one chunk is left, so the waste does not grow with the number of chunks; the bins that they come from take part as a packing, so
no level makes more of them.  Islands are rows that are written between spells, and seeds are fixed, so a lost task gives the same again.

Memory is bounded: a task holds an Arrow batch of texts, or one chunk with its population.

Defined results: a null or empty text is one piece of the closing id alone; a text of more than a sequence is cut into whole sequences and a
rest, however long; rows without doc_id and repeated rows are documents of their own; equal lengths are ties, which any order breaks as well;
an empty table has no pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import NOT_WHITE, WHITE
from .common import discard, prepare, stash

LENGTH = 4096
CLOSING = 1
#: Pieces of a chunk, islands that search it, packings of an island, spells between migrations, and crossovers of a spell.
CHUNK, ISLANDS, POPULATION, SPELLS, CROSSOVERS = 8192, 3, 4, 4, 12
#: Share of a chunk's pieces that may go on to the next level, and fill up to which a bin may.
LOOSE, LOOSE_FILL = 16, LENGTH * 63 // 64
#: Texts tokenised at once, unseen words kept, and the longest of these.
TEXTS, WORDS, WORD_CHARS = 256, 600_000, 48
#: Letters that stand alike in every normal form and have one small letter, and the signs behind them, which are a pre-token of their own.
PARTS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)").fullmatch
CLOSED = np.array([CLOSING], "<u4").tobytes()
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = [x.split()[0] for x in PIECE.split(", ")]


class Tokens:
    """Ids by the library, which is asked for unseen words only: white space ends every pre-token of this vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        import regex
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: The same model without what plain words do not need: normal forms, small letters, and the search for pre-tokens.
        self.bare = tokenizers.Tokenizer(self.library.model)
        self.bare.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([tokenizers.pre_tokenizers.CharDelimiterSplit(" "), tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.blank = regex.compile(f"[{WHITE}]+")
        #: Ids of words as they stand in texts, and of plain words; each with those of an older half.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {"": b""}
        self.older_plain: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return list(filter(None, self.blank.split(text))) if any(c in text for c in NOT_WHITE) else text.split()

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of any words, in one call: a token belongs to the word in which it starts."""
        found = self.library.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0, *[len(w) + 1 for w in words]])
        ends = np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), starts)
        return self.cut(words, np.array(found.ids, "<u4"), ends.tolist())

    def encoded_plain(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of small letters: each is one pre-token, which one token ends."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        return self.cut(words, ids, [0, *ends.tolist()]) if len(ends) == len(words) else self.encoded(words)

    @staticmethod
    def cut(words: list[str], ids: np.ndarray, ends: list[int]) -> dict[str, bytes]:
        raw = ids.tobytes()
        return {w: raw[4 * a : 4 * b] for w, a, b in zip(words, ends, ends[1:])}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of unseen words; a plain word is looked up without capitals and apart from the signs behind it."""
        parts = {w: m.groups() for w in words if (m := PARTS(w))}
        others = [w for w in words if w not in parts]
        plain, older = self.plain, self.older_plain
        stems, tails = {s.lower() for s, _ in parts.values()}.difference(plain), {x for _, x in parts.values()}.difference(plain)
        plain.update((s, older[s]) for s in (*stems, *tails) if s in older)
        if new := [s for s in stems if s not in older]:
            plain.update(self.encoded_plain(new))
        made = self.encoded([*others, *(x for x in tails if x not in older)])
        plain.update((x, made[x]) for x in tails if x in made)
        made.update((w, plain[s.lower()] + plain[x]) for w, (s, x) in parts.items())
        if len(plain) > WORDS:
            self.plain, self.older_plain = {"": b""}, {s: x for s, x in plain.items() if len(s) <= WORD_CHARS}
        return made

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the closing one."""
        words = [None if "<|" in t else self.split(t) for t in texts]
        if len(self.known) > WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        unseen = set().union(*filter(None, words)).difference(known)
        known.update((w, older[w]) for w in unseen if w in older)
        new = [w for w in unseen if w not in older]
        made = self.learn(new)
        known.update((w, made[w]) for w in new)
        out = []
        for text, ws in zip(texts, words):
            if ws is None:
                body = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                body = b"".join(map(known.__getitem__, ws))
            out.append(np.frombuffer(body + CLOSED, "<u4"))
        for w in new:
            if len(w) > WORD_CHARS:
                del known[w]
        return out


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every row, and uid, which is unique."""

    def run(batches):
        known = tokens(path)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                rows = []
                for doc_id, ids in zip(batch.column(0)[at : at + TEXTS].to_pylist(), known.ids(batch.column(1)[at : at + TEXTS].to_pylist())):
                    for i, start in enumerate(range(0, len(ids), LENGTH)):
                        own = ids[start : start + LENGTH]
                        rows.append((doc_id, i, start, len(own), zlib.crc32(own.tobytes())))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if name == "piece" else pa.int64()) for c, name in zip(columns, NAMES)], names=NAMES)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stash(texts.mapInArrow(run, PIECE).withColumn("uid", F.monotonically_increasing_id()))


class Rooms:
    """Bins by the room that is left in them; a bit for each room that occurs finds the best fit."""

    def __init__(self):
        self.bins: list[list[int]] = []
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0

    def add(self, items: list[int], room: int) -> None:
        self.file(len(self.bins), room)
        self.bins.append(items)

    def file(self, at: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(at)
            self.mask |= 1 << room

    def put(self, item: int, length: int) -> None:
        fits = self.mask >> length
        if not fits:
            self.add([item], LENGTH - length)
            return
        room = length + (fits & -fits).bit_length() - 1
        held = self.by_room[room]
        at = held.pop()
        if not held:
            self.mask ^= 1 << room
        self.bins[at].append(item)
        self.file(at, room - length)


def fills(bins: list[list[int]], lengths: list[int]) -> list[int]:
    return [sum([lengths[i] for i in b]) for b in bins]


def score(bins: list[list[int]], lengths: list[int]) -> tuple[int, int]:
    """Fewer bins are better, then fuller ones: less is better."""
    return len(bins), -sum(f * f for f in fills(bins, lengths))


def best_fit(order, lengths: list[int], rooms: Rooms | None = None) -> list[list[int]]:
    rooms = rooms or Rooms()
    for i in order:
        rooms.put(i, lengths[i])
    return rooms.bins


def decreasing(items, lengths: list[int]) -> list[int]:
    return sorted(items, key=lambda i: -lengths[i])


def cross(one: list[list[int]], two: list[list[int]], lengths: list[int], r: random.Random) -> list[list[int]]:
    """A child of `one` with a share of the best-filled bins of `two`; some of the emptiest bins are dissolved."""
    order = sorted(zip(fills(two, lengths), range(len(two))), reverse=True)
    count = max(1, int(len(two) * r.uniform(0.1, 0.5)))
    first = r.randrange(max(1, len(two) // 2 - count + 1))
    injected = [two[i] for _, i in order[first : first + count]]
    taken = {i for b in injected for i in b}
    child, displaced = Rooms(), []
    for b in injected:
        child.add(list(b), LENGTH - sum([lengths[i] for i in b]))
    clean = [(sum([lengths[i] for i in b]), b) for b in one if taken.isdisjoint(b)]
    for b in one:
        if not taken.isdisjoint(b):
            displaced += [i for i in b if i not in taken]
    clean.sort(key=lambda x: x[0])
    dissolved = min(len(clean), 1 + r.randrange(4))
    for _, b in clean[:dissolved]:
        displaced += b
    for fill, b in clean[dissolved:]:
        child.add(list(b), LENGTH - fill)
    return best_fit(decreasing(displaced, lengths), lengths, child)


def least_bins(lengths: list[int]) -> int:
    """No packing has fewer bins: by all tokens, or by pieces of which no two share a bin."""
    return max(-(-sum(lengths) // LENGTH), sum(2 * n > LENGTH for n in lengths))


def begun(lengths: list[int], held: list[int], r: random.Random) -> list[list[list[int]]]:
    """First packings; held: the bin of each piece before, or nothing."""
    out = [best_fit(decreasing(range(len(lengths)), lengths), lengths)]
    if held:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(held):
            bins.setdefault(b, []).append(i)
        out.append(list(bins.values()))
    if min(len(b) for b in out) > least_bins(lengths):
        while len(out) < POPULATION:
            noise = [n * r.uniform(0.7, 1) for n in lengths]
            out.append(best_fit(sorted(range(len(lengths)), key=lambda i: -noise[i]), lengths))
    return out


def evolve(population: list[list[list[int]]], lengths: list[int], seed: int) -> list[list[list[int]]]:
    """A spell of one island; the best packing comes first.  Ends early with as few bins as any packing needs."""
    r = random.Random(seed)
    least = least_bins(lengths)
    ranked = sorted(((score(b, lengths), k, b) for k, b in enumerate(population)), key=lambda x: x[:2])
    for k in range(len(ranked), len(ranked) + CROSSOVERS):
        if ranked[0][0][0] <= least or len(ranked) < 2:
            break
        # Each parent is the better one of two.
        one = ranked[min(r.randrange(len(ranked)), r.randrange(len(ranked)))][2]
        two = ranked[min(r.randrange(len(ranked)), r.randrange(len(ranked)))][2]
        child = cross(one, two, lengths, r)
        ranked.append((score(child, lengths), k, child))
        ranked.sort(key=lambda x: x[:2])
        ranked.pop()
    return [b for _, _, b in ranked]


def packed(bins: list[list[int]], n: int) -> bytes:
    """The bin of each piece."""
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def unpacked(bins: bytes) -> list[list[int]]:
    of = np.frombuffer(bins, "<i4")
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(x)]


def chunked(rows: DataFrame, chunks: int) -> DataFrame:
    """A row for each chunk of pieces (PIECE, uid, held): chunk, and its pieces' columns as binaries."""

    def run(key, table):
        table = table.sort_by("uid").combine_chunks()
        ids = table["doc_id"].fill_null(0).to_numpy()
        held = table["held"].to_numpy() if not table["held"].null_count else np.zeros(0, np.int64)
        told = [ids, table["doc_id"].is_null().to_numpy(), table["piece"].to_numpy(), table["start"].to_numpy(), table["length"].to_numpy(), table["ids_crc32"].to_numpy(), np.unique(held, return_inverse=True)[1].astype(np.int64)]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in told]], names=["chunk", "ids", "nulls", "piece", "start", "length", "crc", "held"])

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)))
    return stash(dealt.groupBy("chunk").applyInArrow(run, "chunk long, ids binary, nulls binary, piece binary, start binary, length binary, crc binary, held binary"))


ISLAND = "chunk long, island int, length binary, population array<binary>, bins int, least int"


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.int32()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in ISLAND.split(", ")])


def _row(chunk: int, island: int, length: bytes, population, lengths: list[int]) -> tuple:
    return chunk, island, length, [packed(b, len(lengths)) for b in population], len(population[0]), least_bins(lengths)


def settle(chunks: DataFrame) -> DataFrame:
    """The islands of every chunk with their first populations."""

    def run(batches):
        for batch in batches:
            for chunk, island, length, held in zip(*(c.to_pylist() for c in batch.columns)):
                lengths = np.frombuffer(length, np.int64).tolist()
                population = begun(lengths, np.frombuffer(held, np.int64).tolist(), random.Random(chunk * 1009 + island))
                yield _told([_row(chunk, island, length, sorted(population, key=lambda b: score(b, lengths)), lengths)])

    islands = chunks.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "length", "held").repartition("chunk", "island")
    return stash(islands.mapInArrow(run, ISLAND))


def spell(islands: DataFrame, number: int) -> DataFrame:
    """Each island takes in its neighbour's best packing, and goes on; islands of chunks that are done stay as they are."""

    def run(batches):
        for batch in batches:
            for chunk, island, length, population, came in zip(*(c.to_pylist() for c in batch.columns)):
                lengths = np.frombuffer(length, np.int64).tolist()
                known = dict.fromkeys([*population, came])
                evolved = evolve([unpacked(b) for b in known], lengths, (number * 1_000_003 + chunk) * 1009 + island)
                yield _told([_row(chunk, island, length, evolved[:POPULATION], lengths)])

    best = islands.groupBy("chunk").agg(F.min("bins").alias("fewest"))
    told = islands.join(best, "chunk")
    open_ = told.where("fewest > least").drop("fewest")
    elite = open_.select("chunk", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("population")[0].alias("came"))
    went = open_.join(elite, ["chunk", "island"]).select("chunk", "island", "length", "population", "came").mapInArrow(run, ISLAND)
    return stash(told.where("fewest <= least").drop("fewest").unionByName(went))


def searched(chunks: DataFrame) -> DataFrame:
    """chunk and bins (the bin of each piece): the best packing over all islands and spells."""
    islands = settle(chunks)
    for number in range(SPELLS):
        if not islands.groupBy("chunk").agg((F.min("bins") > F.min("least")).alias("open")).where("open").limit(1).count():
            break
        before, islands = islands, spell(islands, number)
        discard(before)
    best = stash(islands.groupBy("chunk").agg(F.min_by(F.col("population")[0], F.struct("bins", "island")).alias("bins")))
    discard(islands)
    return best


def written_out(chunks: DataFrame, best: DataFrame, level: int, last: bool) -> DataFrame:
    """Pieces with sequence_id and offset; those of loose bins with loose set, and uid and held for the next level."""
    names = [*NAMES, "sequence_id", "offset", "loose"]

    def run(batches):
        for batch in batches:
            for chunk, ids, nulls, piece, start, length, crc, bins in zip(*(c.to_pylist() for c in batch.columns)):
                n, of = np.frombuffer(length, np.int64), np.frombuffer(bins, "<i4").astype(np.int64)
                fill, count = np.bincount(of, n).astype(np.int64), np.bincount(of)
                order = np.argsort(of, kind="stable")
                ends = np.cumsum(n[order])
                heads = np.concatenate([[0], np.flatnonzero(np.diff(of[order])) + 1])
                offset = np.empty(len(n), np.int64)
                offset[order] = ends - n[order] - np.repeat((ends - n[order])[heads], np.diff(np.append(heads, len(n))))
                loose = np.zeros(len(fill), bool)
                if not last:
                    emptiest = np.argsort(fill, kind="stable")
                    emptiest = emptiest[(np.cumsum(count[emptiest]) <= max(len(n) // LOOSE, 1)) & (fill[emptiest] <= LOOSE_FILL)]
                    loose[emptiest] = True
                doc_ids = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(nulls, bool))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.frombuffer(piece, np.int32)), *[pa.array(x) for x in (np.frombuffer(start, np.int64), n, np.frombuffer(crc, np.int64), level << 56 | chunk << 16 | of, offset, loose[of])]], names=names)

    rows = chunks.drop("held").join(best, "chunk").mapInArrow(run, PIECE + ", sequence_id long, offset long, loose boolean")
    return stash(rows.withColumn("uid", F.monotonically_increasing_id()))


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of the pieces of all rows of `docs`.

    path: the vocabulary's JSON file, which every executor can read."""
    prepare(docs.sparkSession)
    made = pieces(docs, path)
    out = made.where(F.col("length") == LENGTH).select(*NAMES, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows, left = made.where(F.col("length") < LENGTH).withColumn("held", F.lit(None).cast("long")), None
    level = 0
    while count := rows.count():
        number = -(-count // CHUNK)
        chunks = chunked(rows, number)
        best = searched(chunks)
        left = written_out(chunks, best, level, last=number == 1)
        discard(chunks, best)
        out = out.unionByName(left.where("not loose").select(*NAMES, "sequence_id", "offset"))
        rows = left.where("loose").select(*NAMES, "uid", F.col("sequence_id").alias("held"))
        level += 1
    return out

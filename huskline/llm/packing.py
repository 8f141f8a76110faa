"""Operator 7: mixture-controlled packing by deficit round-robin over source queues.

The target proportion of a source is its share of all text (bytes), or what the caller gives.  Rows
are dealt evenly over partitions.  A partition tokenises its documents, queues them by source and
serves the queues in rounds: a round credits every source with its share of `round_tokens`, a source is
served while its credit lasts, and what it could not use or overdrew is carried into the next round.
The served tokens fill sequences of 1,024 one after the other, and a round is one sequence, so each
sequence has the target proportions while all sources wait.  What is left of a partition's last sequence
goes, together with the credits of all its sources, into a second run of the same procedure over the
leftovers of many partitions, where the partitions' credits are added up.  The
end of that is cut into powers of two, so nothing is padded.

Memory is bounded: a partition holds at most about `LOOKAHEAD` tokens besides one Arrow batch.

Defined results: a null or empty text is one document of a single token (the closing id 0); a null
source is a source of its own; repeated rows are separate documents, each packed whole; an empty table
has no pieces; extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stash

LENGTH = 1024
ROUND_TOKENS = LENGTH
LOOKAHEAD = 1 << 20
#: Sources with queues of their own; the rest share queues by hash.  Bounds what the driver sends out.
QUEUES = 4096
#: Partitions whose leftovers are packed together.
GROUP = 64
#: Splits a text into pre-tokens, as byte-level vocabularies of this kind do (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
NAMES = [x.split()[0] for x in PIECE.split(", ")]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The vocabulary as ranks; gives the ids of the JSON file of the same name."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(path: str, text: str) -> np.ndarray:
    ids = tokenizer(path).encode_to_numpy(text, allowed_special="all")
    return np.append(ids, np.uint32(0)).astype("<u4")


class Packer:
    """Queues, credits and the open sequence of one partition."""

    def __init__(self, shares: dict[str, float], first: int, credits: dict[str, float] | None = None):
        self.shares, self.next_id = shares, first
        self.queues: dict[str, deque] = {}
        self.credit: dict[str, float] = dict(credits or {})
        self.queued = 0
        self.open: list[tuple] = []
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, source: str, doc_id, start: int, total: int, ids: np.ndarray, label) -> None:
        self.queues.setdefault(source, deque()).append([doc_id, start, total, ids, label])
        self.queued += len(ids)

    def share(self, source: str) -> float:
        return max(self.shares.get(source, 0.0), 1e-6)

    def least(self, source: str) -> float:
        """Credit from which a source is worth a round."""
        own = self.share(source) * ROUND_TOKENS
        return min(own, LENGTH / 16) if own >= 1 else LENGTH / 16

    def serve(self, down_to: int) -> None:
        """Rounds over the queues until at most `down_to` tokens are queued."""
        while self.queued > down_to:
            waiting = [s for s in self.queues if self.queues[s]]
            # Where every waiting source is overdrawn, rounds that would serve none are credited at once; sources of under a token a round are served in larger pieces.
            need = min((self.least(s) - self.credit.get(s, 0.0)) / (self.share(s) * ROUND_TOKENS) for s in waiting)
            rounds = max(1, int(np.ceil(need)))
            for s in sorted(waiting):
                self.credit[s] = self.credit.get(s, 0.0) + rounds * self.share(s) * ROUND_TOKENS
                queue = self.queues[s]
                while queue and self.credit[s] >= 1 and self.queued > down_to:
                    self.credit[s] -= self.take(s, int(self.credit[s]))

    def take(self, source: str, most: int) -> int:
        """Move tokens of the queue's first document into the open sequence."""
        head = self.queues[source][0]
        doc_id, start, total, ids, label = head
        n = min(most, len(ids), LENGTH - self.filled)
        last = self.open[-1] if self.open else None
        if start and last and last[0] == doc_id and last[7] == source and last[1] + last[2] == start:
            # The document goes on in the same sequence: one piece.
            self.open[-1] = (doc_id, last[1], last[2] + n, zlib.crc32(ids[:n].tobytes(), last[3]), total, last[5], label, source, np.concatenate([last[8], ids[:n]]))
        else:
            self.open.append((doc_id, start, n, zlib.crc32(ids[:n].tobytes()), total, self.filled, label, source, ids[:n]))
        self.filled += n
        self.queued -= n
        if n == len(ids):
            self.queues[source].popleft()
        else:
            head[1], head[3] = start + n, ids[n:]
        if self.filled == LENGTH:
            self.close()
        return n

    def close(self) -> None:
        self.rows += [(d, s, n, c, t, self.next_id, o, label) for d, s, n, c, t, o, label, _, _ in self.open]
        self.next_id += 1
        self.open, self.filled = [], 0

    def finish(self) -> None:
        """Cut the open sequence into sequences whose lengths are powers of two."""
        left = [[d, s, t, ids, label] for d, s, _, _, t, _, label, _, ids in self.open]
        rest, self.open, self.filled = self.filled, [], 0
        while rest:
            room, offset = 1 << (rest.bit_length() - 1), 0
            rest -= room
            while offset < room:
                d, s, t, ids, label = left[0]
                n = min(len(ids), room - offset)
                self.rows.append((d, s, n, zlib.crc32(ids[:n].tobytes()), t, self.next_id, offset, label))
                offset += n
                if n == len(ids):
                    left.pop(0)
                else:
                    left[0][1:4:2] = s + n, ids[n:]
            self.next_id += 1

    def flush(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def queue_of(shares: dict[str, float], source: str | None) -> str:
    name = "" if source is None else "=" + source
    return name if name in shares else f"#{zlib.crc32(name.encode()) % 64}"


def text_shares(docs: DataFrame) -> dict[str, float]:
    """Share of every queue in the corpus' bytes; at most `QUEUES` sources and 64 shared queues come to the driver."""
    name = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    sums = docs.groupBy(name.alias("q")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n"))
    top = sums.orderBy(F.desc("n"), "q").limit(QUEUES).collect()
    shares = {r.q: float(r.n) for r in top}
    if len(top) == QUEUES:
        kept = docs.sparkSession.createDataFrame([(r.q,) for r in top], "q string")
        for r in sums.join(F.broadcast(kept), "q", "left_anti").groupBy((F.crc32(F.col("q").cast("binary")) % 64).alias("b")).agg(F.sum("n").alias("n")).collect():
            shares[f"#{r.b}"] = float(r.n)
    total = sum(shares.values()) or 1.0
    return {q: n / total for q, n in shares.items()}


def pack_documents(docs: DataFrame, path: str, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all rows of `docs`: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    path: ranks file of the vocabulary, which every executor can read.
    targets: share of tokens by source; the corpus' own shares if not given."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    shares = {"=" + k: v for k, v in targets.items()} if targets else text_shares(docs)
    known = spark.sparkContext.broadcast(shares)

    def first(batches):
        part = TaskContext.get().partitionId()
        packer = Packer(known.value, part << 32)
        for batch in batches:
            for d, text, source in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = token_ids(path, text.as_py())
                packer.add(queue_of(known.value, source), d, 0, len(ids), ids, source)
                if packer.queued > LOOKAHEAD:
                    packer.serve(LOOKAHEAD // 2)
            yield to_batch(packer.flush())
        packer.serve(0)
        rows = packer.flush()
        yield to_batch(rows, leftovers(packer, part // GROUP))

    def second(key, rows):
        rows = rows.to_pylist()
        credits = added_credits(rows)
        rows = sorted((r for r in rows if r["credit"] is None), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["ids_crc32"], r["offset"]))
        packer = Packer(known.value, (1 << 30) + int(key[0].as_py()) << 32, credits)
        for r in rows:
            packer.add(r["queue"], r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4"), r["source"])
        packer.serve(0)
        packer.finish()
        return pa.Table.from_batches([to_batch(packer.flush())]).select(NAMES)

    # Equal rows would meet in one partition; the text's length spreads repeated ids.
    dealt = docs.repartition("doc_id", F.octet_length("text"))
    packed = stash(dealt.mapInArrow(first, PIECE + ", queue string, ids binary, credit double"))
    tails = packed.where("ids is not null").withColumn("group", F.col("sequence_id"))
    ends = tails.groupBy("group").applyInArrow(second, PIECE)
    return packed.where("ids is null").select(*NAMES).unionByName(ends)


def leftovers(packer: Packer, group: int) -> list[tuple]:
    """Rows for the second run: the open sequence's pieces, and one row of credit, without ids, for every queue."""
    pieces = [(d, s, n, c, t, group, o, label, q, ids.tobytes(), None) for d, s, n, c, t, o, label, q, ids in packer.open]
    return pieces + [(None, None, 0, None, None, group, None, None, q, b"", credit) for q, credit in packer.credit.items()]


def added_credits(rows: list[dict]) -> dict[str, float]:
    """Credit of every queue over all partitions; the sum does not depend on the order of rows."""
    parts: dict[str, list[float]] = {}
    for r in rows:
        if r["credit"] is not None:
            parts.setdefault(r["queue"], []).append(r["credit"])
    return {q: math.fsum(x) for q, x in parts.items()}


def to_batch(rows: list[tuple], tail: list[tuple] = ()) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.string(), pa.binary(), pa.float64()]
    every = [r + (None, None, None) for r in rows] + list(tail)
    columns = list(zip(*every)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[*NAMES, "queue", "ids", "credit"])

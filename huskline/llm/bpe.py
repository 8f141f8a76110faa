"""Operator 4: exact BPE encoding in linear time, and decoding through an offset table.

A text is cut into pre-tokens.  In each, a reversed Aho-Corasick automaton lists the vocabulary
tokens that start at every position, longest first.  The encoder takes the longest token whose pair
with its predecessor is compatible, that is, whose boundary no earlier merge would have crossed; where
none fits it steps back and marks the position dead.  A prefix has one valid encoding at most, so no
position is tried twice: linear time, and the tokens are those that rank-ordered merging gives.

Defined results: null and empty texts have no tokens and decode to the empty string; a very long text is
encoded whole, word by word; every row gives one row, repeated rows give repeated rows, an empty table none;
there are no ties, as an encoding is unique; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White space of the Unicode property of that name (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Blank for Python's split() only.
NOT_WHITE = "\x1c\x1d\x1e\x1f"
#: Letters and numbers that Unicode assigned after version 16, which the library has as marks (fixed values).
MARKS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Capitals of Unicode 16 and 17 with their small letters, which Python does not know (fixed values); ranges run in step.
SMALL = "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70-10D85 16EA0-16EB8:16EBB-16ED3"
#: Marks of a combining class that Unicode assigned after version 9, which the library does not put in order; and the second half of a letter that it does not put together (fixed values).
UNORDERED = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E "
    "11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
END = "</w>"


def _points(ranges: str) -> list[int]:
    """Code points of hexadecimal ranges."""
    ends = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return [p for e in ends for p in range(e[0], e[-1] + 1)]


#: The small letters by capital.
LOWER = {a: b for pair in SMALL.split() for a, b in zip(*map(_points, pair.split(":")))}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Encoder:
    """Backtracking encoder of one vocabulary file (JSON of the tokenizers library)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (vocab | self.special).items()}
        self.letters = byte_letters()
        #: Symbols: a byte's letter, or that letter moved to a private area where the word ends.
        shape: dict[int, str] = {}
        for letter in self.letters:
            if letter in vocab:
                shape[vocab[letter]] = letter
            if letter + END in vocab:
                shape[vocab[letter + END]] = self.last(letter)
        self.pairs: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.pairs[a << 32 | b] = made
            self.halves.setdefault(made, (a, b))
            shape.setdefault(made, shape[a] + shape[b])
        self.length = {i: len(s) for i, s in shape.items()}
        self.automaton = ahocorasick.Automaton()
        for i, s in shape.items():
            self.automaton.add_word(s[::-1], i)
        self.automaton.make_automaton()
        self.forward = ahocorasick.Automaton()
        for i, s in shape.items():
            self.forward.add_word(s, i)
        self.forward.make_automaton()
        self.known: Recent = Recent(self.word)
        self.fits: dict[int, bool] = {}
        #: Offset table: the bytes of token i, with the space that decoding puts before it, are blob[at[i] : at[i + 1]].
        texts = [(" " + names.get(i, "")).encode() for i in range(max(names) + 1)]
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.as_marks = {c: "☃" for c in _points(MARKS)}
        self.late = frozenset(map(chr, self.as_marks))
        self.unordered = frozenset(map(chr, _points(UNORDERED)))
        self.at_unordered = regex.compile(f"([{''.join(sorted(self.unordered))}])")
        self.blank = regex.compile(f"[{WHITE}]+")
        self.cache: Recent = Recent(self.entry)

    @staticmethod
    def last(letter: str) -> str:
        return chr(0xE000 + ord(letter))

    def compatible(self, one: int, two: int) -> bool:
        """Does rank-ordered merging of both tokens' symbols keep the boundary between them?

        Undo merges around the boundary, latest first; the boundary falls if the tokens that meet
        there at some time form a merge ranked before the next one on either side."""
        key = one << 32 | two
        known = self.fits.get(key)
        if known is not None:
            return known
        a, b, before, answer = one, two, 1 << 62, True
        while True:
            if self.pairs.get(a << 32 | b, before) < before:
                answer = False
                break
            undo_left = a in self.halves and (a > b or b not in self.halves)
            if undo_left:
                before, a = a, self.halves[a][1]
            elif b in self.halves:
                before, b = b + 1, self.halves[b][0]  # of equal ranks the leftmost merges first
            else:
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = answer
        return answer

    def symbols(self, symbols: str) -> list[int]:
        """Token ids of one pre-token, given as symbols.

        The longest tokens from left to right are the answer if each pair is compatible, as no
        other cover of the pre-token is; otherwise the search steps back."""
        fits, out, place, one = self.fits, [], 0, -1
        for end, two in self.forward.iter_long(symbols):
            place += self.length[two]
            if place != end + 1:
                break
            if one >= 0:
                fit = fits.get(one << 32 | two)
                if not (self.compatible(one, two) if fit is None else fit):
                    break
            out.append(two)
            one = two
        else:
            if place == len(symbols) and (len(out) > 1 or self.built(one)):
                return out
        return self.search(symbols)

    def search(self, symbols: str) -> list[int]:
        n = len(symbols)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(symbols[::-1]):
            starts[n - 1 - end].append(token)
        dead, ordered = bytearray(n + 1), bytearray(n)
        out: list[int] = []
        place = 0
        while place < n:
            tokens, ahead = starts[place], False
            if ordered[place] == 0:
                tokens.reverse()  # found longest first, so pop() gives the longest
                ordered[place] = 1
            while tokens:
                token = tokens.pop()
                end = place + self.length[token]
                if not dead[end] and (self.compatible(out[-1], token) if out else end < n or self.built(token)):
                    out.append(token)
                    place, ahead = end, True
                    break
            if not ahead:
                dead[place] = 1
                if not out:
                    raise ValueError(f"no encoding of {symbols[:40]!r}")
                place -= self.length[out.pop()]
        return out

    def built(self, token: int) -> bool:
        """Is the token what merging its own symbols gives (its halves stand side by side)?"""
        return token not in self.halves or (self.built(self.halves[token][0]) and self.built(self.halves[token][1]) and self.joins(*self.halves[token]))

    @lru_cache(maxsize=100_000)  # noqa: B019  one encoder lives as long as its worker
    def joins(self, a: int, b: int) -> bool:
        saved = self.pairs.pop(a << 32 | b)
        self.fits.pop(a << 32 | b, None)
        fine = self.compatible(a, b)
        self.fits.pop(a << 32 | b, None)
        self.pairs[a << 32 | b] = saved
        return fine

    def word(self, word: str) -> list[int]:
        letters = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        return self.symbols(letters[:-1] + self.last(letters[-1]))

    def composed(self, text: str) -> str:
        """The text's normal form as the library has it: nothing moves or joins across a mark that it does not know as one."""
        if self.unordered.isdisjoint(text):
            return unicodedata.normalize("NFC", text)
        return "".join([unicodedata.normalize("NFC", part) for part in self.at_unordered.split(text)])

    def chunk(self, text: str) -> list[int]:
        """Token ids of a text without white space."""
        if text.isascii():
            lower = text.lower()
        else:
            text = self.composed(text)
            lower = ("".join(map(str.lower, text)) if "Σ" in text else text.lower()).translate(LOWER)
        if lower.isalpha():
            return self.known[lower]
        if lower[-1] in ".,;:!?" and lower[:-1].isalpha():
            return self.known[lower[:-1]] + self.known[lower[-1]]
        words = self.words.findall(lower)
        if not (lower.isascii() or self.late.isdisjoint(lower)):
            words = [lower[m.start() : m.end()] for m in self.words.finditer(lower.translate(self.as_marks))]
        return [i for word in words for i in self.known[word]]

    def entry(self, text: str) -> tuple[bytes, str]:
        """Ids of a text without white space: as 32-bit integers, and as decimal text."""
        ids = self.chunk(text)
        return array("I", ids).tobytes(), " ".join(map(str, ids))

    def plain(self, text: str) -> list[tuple[bytes, str]]:
        chunks = list(filter(None, self.blank.split(text))) if any(c in text for c in NOT_WHITE) else text.split()
        return [e for e in map(self.cache.__getitem__, chunks) if e[0]]

    def entries(self, text: str) -> list[tuple[bytes, str]]:
        """For each run of tokens: its ids as 32-bit integers, and as decimal text."""
        if "<|" not in text:
            return self.plain(text)
        out, place = [], 0
        for m in self.cut.finditer(text):
            out += self.plain(text[place : m.start()])
            i = self.special[m[0]]
            out.append((np.uint32(i).tobytes(), str(i)))
            place = m.end()
        return out + self.plain(text[place:])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(e[0] for e in self.entries(text or "")), np.uint32).tolist()

    def decode(self, ids) -> bytes:
        """UTF-8 of the tokens with a space between them, gathered from the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        start = self.at[ids]
        size = self.at[ids + 1] - start
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.blob[place].tobytes()[1:]


class Recent(dict):
    """A bounded memory of results: when full it becomes the older half, from which what is used again is taken over."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, text: str):
        made = self.older.get(text)
        if made is None:
            made = self.make(text)
            if len(text) > CACHE_CHARS:
                return made
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[text] = made
        return made


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for every row of `docs`.

    path: the vocabulary's JSON file, which every executor can read."""
    prepare(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for text in batch.column(1):
                entries = enc.entries(text.as_py())
                ids = np.frombuffer(b"".join([e[0] for e in entries]), np.uint32)
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join([e[1] for e in entries]).encode()).hexdigest())
                text_hex.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids themselves, for use as model input."""
    prepare(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")

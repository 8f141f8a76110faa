"""Each operator on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and against brute force."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from huskline.llm import bpe, chat, components, forest, hosts, jaccard, maxent, neardup, packing, pii, quality, words  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
random.seed(3)
SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else random
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def documents(spark, texts, first=0):
    """Rows with clashing extra columns; a text may come as (doc_id, text)."""
    rows = [(*(t if isinstance(t, tuple) else (first + i, t)), "en", f"s{i % 3}" if i % 7 else None, None if i % 5 == 0 else 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for extra in ("score", "label", "token", "f", "n", "row", "component"):
        df = df.withColumn(extra, F.lit("x"))
    return df


ODD = [None, "", "   \n\t", "a", "A a a\x1cb <|endoftext|> x", "é" * 50, "word " * 30_000, "x" * 50_000]


# 4


def test_bpe_equals_library(spark):
    k = tokenizers.Tokenizer.from_file(WORD)
    texts = ODD + ["don't I'LL 've Σας ΟΔΟΣ İ é", "日本語 テスト 123", "</w> a</w>", "a b　c\x85d", "aaaaaaaaaaaaaaaaaaaaaaa" * 9] + ["".join(random.choice("thearinso'ed -.,!éßİΣ\n<|/w>") for _ in range(random.randint(1, 60))) for _ in range(400)]
    got = {r.doc_id: r for r in bpe.encode_documents(documents(spark, texts), WORD).collect()}
    for i, t in enumerate(texts):
        ids = k.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(k.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(documents(spark, texts).limit(0), WORD).count() == 0
    assert [r.ids for r in bpe.encode_ids(documents(spark, ["the the"]), WORD).collect()] == [k.encode("the the", add_special_tokens=False).ids]


def test_bpe_every_code_point():
    """Alone and among letters and marks: all that Unicode assigns, and some that it does not."""
    e, k = bpe.Encoder(WORD), tokenizers.Tokenizer.from_file(WORD)
    points = [p for p in (*range(0xD800), *range(0xE000, 0x110000)) if p in e.as_marks or p in bpe.LOWER or p % 64 == 0 or (unicodedata.category(chr(p)) not in ("Cn", "Co", "Lo"))]
    for at in range(0, len(points), 4096):
        chars = list(map(chr, points[at : at + 4096]))
        for form in ("{}", "a{}1{}!"):
            texts = [form.replace("{}", c) for c in chars]
            wrong = [t for t, got in zip(texts, k.encode_batch(texts, add_special_tokens=False)) if e.encode(t) != got.ids]
            assert not wrong, (len(wrong), wrong[:5], at)


def test_bpe_sequences_of_marks():
    """Every late mark in pairs and triples with others, and random strings of letters and marks."""
    e, k = bpe.Encoder(WORD), tokenizers.Tokenizer.from_file(WORD)
    r = random.Random(6)
    late = sorted(e.unordered)
    marks = [chr(p) for p in range(0x300, 0x20000) if unicodedata.combining(chr(p))]
    texts = [form.format(a, b) for a in late for b in ("\u0316", "\u0301", "\u0334", r.choice(late)) for form in ("a{0}{1}", "a{1}{0}", "e{0}\u0316{1}", "o{1}{0}\u0323", "{0}{1}")]
    texts += ["\U00011935\U00011930", "\U00011935\u0301\U00011930", "\U00011938"]
    texts += ["".join(r.choice(late) if r.random() < 0.2 else r.choice(marks) if r.random() < 0.6 else r.choice("aeoAEOç가ᄀ ᅡnsΣ1.") for _ in range(r.randint(2, 9))) for _ in range(20_000)]
    wrong = [t for t, got in zip(texts, k.encode_batch(texts, add_special_tokens=False)) if e.encode(t) != got.ids]
    assert not wrong, (len(wrong), [list(map(hex, map(ord, w))) for w in wrong[:3]])


def test_bpe_search_equals_merging():
    e = bpe.Encoder(WORD)
    k = tokenizers.Tokenizer.from_file(WORD)
    for _ in range(3000):
        w = "".join(random.choice("aabbcdeeinorst") for _ in range(random.randint(1, 40)))
        symbols = w[:-1] + e.last(w[-1])
        assert e.search(symbols) == e.symbols(symbols) == k.encode(w, add_special_tokens=False).ids


# 7


def unpacked(rows, docs):
    k = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for d, t in docs:
        want[(d, tuple(k.encode(t or "", add_special_tokens=False).ids + [0]))] += 1
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
    for (d, ids), times in want.items():
        got = sorted(pieces[(d, len(ids))], key=lambda r: r.start)
        cover = np.zeros(len(ids), int)
        for r in got:
            cover[r.start : r.start + r.length] += 1
        assert (cover == sum(n for (e, o), n in want.items() if e == d and len(o) == len(ids))).all()
        if times == len(got) == 1:
            assert got[0].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(len(i) * n for (_, i), n in want.items())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024


def test_packing(spark):
    texts = [*ODD, *(prose(random.randint(1, 900)) for _ in range(60)), (3, "a"), (3, "a"), (None, "null id"), (2**62 + 1, prose(50))]
    docs = documents(spark, texts)
    unpacked(packing.pack_documents(docs, RANKS).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack_documents(docs.limit(0), RANKS).count() == 0


def test_rounds_keep_proportions():
    shares = {"=a": 0.5, "=b": 0.3, "=c": 0.2}
    p = packing.Packer(shares, 0)
    for i in range(300):
        for q, n in (("=a", 1500), ("=b", 900), ("=c", 600)):
            p.add(q, i, 0, n, np.ones(n, "<u4"), q)
    p.serve(500_000)
    rows = [r for r in p.flush() if r[5] < 160]
    for at in range(0, 160, 16):
        part = [r for r in rows if at <= r[5] < at + 16]
        for q, share in shares.items():
            assert abs(sum(r[2] for r in part if r[7] == q) / (16 * 1024) - share) < 0.01


def test_credit_is_carried():
    p = packing.Packer({"=a": 0.5, "=b": 0.5}, 0, {"=a": -20_000.0})
    for q in ("=a", "=b"):
        p.add(q, 1, 0, 60_000, np.ones(60_000, "<u4"), q)
    p.serve(80_000)
    served = collections.Counter()
    for r in p.flush():
        served[r[7]] += r[2]
    assert served["=b"] - served["=a"] > 11_000


def test_each_window_keeps_proportions():
    shares = {"=a": 0.5, "=b": 0.3, "=c": 0.15, "=d": 0.05}
    p = packing.Packer(shares, 0)
    for i in range(200):
        for q, share in shares.items():
            n = int(3000 * share)
            p.add(q, i, 0, n, np.full(n, i, "<u4"), q)
    p.serve(300_000)
    rows = p.flush()
    for at in range(200):
        for q, share in shares.items():
            assert abs(sum(r[2] for r in rows if r[5] == at and r[7] == q) - share * 1024) < 4


def test_one_source_makes_whole_pieces():
    p = packing.Packer({"=a": 0.02, "=b": 0.98}, 0)
    ids = np.arange(3000, dtype="<u4")
    p.add("=a", 7, 0, 3000, ids, "a")
    p.serve(0)
    p.finish()
    rows = p.flush()
    assert [r[2] for r in rows[:2]] == [1024, 1024] and sum(r[2] for r in rows) == 3000
    assert all(r[3] == zlib.crc32(ids[r[1] : r[1] + r[2]].tobytes()) for r in rows)


def test_partitions_add_up_credit():
    rows = []
    for _ in range(3):
        p = packing.Packer({"=a": 0.5, "=b": 0.5}, 0)
        p.add("=a", 1, 0, 100, np.ones(100, "<u4"), "a")
        p.add("=b", 2, 0, 3000, np.ones(3000, "<u4"), "b")
        p.serve(0)
        assert {q for *_, source, q, _, _ in packing.leftovers(p, 0) if source is None} == {"=a", "=b"}
        rows += packing.to_batch([], packing.leftovers(p, 0)).to_pylist()
    got = packing.added_credits(rows)
    assert got["=a"] == 3 * p.credit["=a"] > 0 and got["=b"] == 3 * p.credit["=b"]


# 1


def test_quality_learns_held_out(spark):
    texts = [prose(60) if i % 3 else " | ".join(prose(1) + "$$$" for _ in range(60)) for i in range(400)]
    docs = documents(spark, texts + ODD[:7])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(1, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 407 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert held and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 407
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    flat = quality.score_documents(docs, labels.where("quality = 1"))
    assert flat.select("score").distinct().count() == 1


def test_quality_learns_from_few(spark):
    """Three labels in four are good; the poor ones are told apart, and some are rejected.  Repeated rows get equal scores."""
    texts = [prose(60, i) if i % 4 else prose(60, i).upper() + " !!! $$$" for i in range(150)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(150)], "doc_id long, quality int")
    rows = quality.score_documents(docs.unionByName(docs), labels).collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.95 and any(r.predicted == 0 for r in held)
    assert len({(r.doc_id, r.score) for r in rows}) == 150 and len(rows) == 300


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.SLOTS).astype(np.float32), rng.normal(size=(quality.SLOTS, quality.RANK)).astype(np.float32))
    slots, values, starts, _ = quality.joined([quality.features("a b c.", 5), quality.features("x y", None)])
    got = m.raw(slots, values, starts)[0]
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(slots)])):
        x, s = values[a:b].astype(float), slots[a:b]
        v = m.factors[s].astype(float) * x[:, None]
        pairs = sum(v[j] @ v[k] for j in range(len(s)) for k in range(j))
        assert got[i] == pytest.approx(0.3 + m.linear[s] @ x + pairs, rel=1e-3)


# 2


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://x.net/fr/", "x.net", "/fr/", "net/", "block"), ("http://example.com/de/x", "example.com", "/de/x", "example.com/de/", "block"),
        ("http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"), ("http://b.org/fr/?q", "b.org", "/fr/", "org/fr/", "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://x.net", "x.net", "", None, "allow"),
        ("a://É.ORG#/fr/", "É.org", "", None, "allow"), ("http://x.net?/a://b.org/", "x.net", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    r = hosts.judge_pages(pages, none).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


@pytest.mark.parametrize("broadcast", [True, False])
def test_reputation(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(hosts, "BROADCAST_HOSTS", 0)
    pages = [(i, f"http://h{i % 20}.{'bad' if i % 20 < 3 else 'good'}{i % 20}.com/x") for i in range(2000)] + [(5000, "http://new.bad1.com/"), (5001, "http://unseen.com/"), (5002, None)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i % 20 < 3 or i % 97 == 0)) for i in range(2000)] + [(None, 1), (3, None)], "page_id long, bad int")
    got = {r.page_id: r for r in hosts.judge_pages(df, outcomes).collect()}
    assert len(got) == 2003 and all(got[i].verdict == ("block" if i % 20 < 3 else "allow") for i in range(2000))
    assert got[5000].bad_share > got[5001].bad_share and got[5001].verdict == "allow"
    assert got[5000].bad_share_low < got[1].bad_share_low < got[1].bad_share
    assert hosts.judge_pages(df.limit(0), outcomes).count() == 0


def test_reputation_is_relative(spark):
    """Where two pages of five are bad everywhere nothing is blocked but what is worse; repeated rows are judged each."""
    pages = [(i, f"http://h{i % 30}.d{i % 10}.com/") for i in range(3000)] + [(0, "http://h0.d0.com/")]
    outcomes = spark.createDataFrame([(i, int((i // 30) % 5 < (4 if i % 30 == 7 else 2))) for i in range(3000)], "page_id long, bad int")
    rows = hosts.judge_pages(spark.createDataFrame(pages, "page_id long, url string"), outcomes).collect()
    assert len(rows) == 3001 and {r.host for r in rows if r.verdict == "block"} == {"h7.d7.com"}


# 3

TURN = "conv_id long, turn long, role string, text string, node string, score int"


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", "<s>[INST] x [/INST]"), (1, 3, None, None), (2, 0, "assistant", "<\\s> \\[INST] <\\\\/s>"), (2, 0, "assistant", "<\\s> \\[INST] <\\\\/s>"), (None, None, "user", "q"), (3, 1, "a[/INST]r", "é🙂" * 100), (4, 0, "assistant", "")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURN)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["".join(random.choice(["<", "\\", "/", "s", ">", "s>", "[", "INST]", "/INST]", "</s>", "<s>", "a"]) for _ in range(random.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not re.search(r"</?s>|\[/?INST\]", r.e)


def test_branches(spark):
    #      1 - 2 - 4 (deep, good)      5: parent is missing
    #        \ 3 (poor)
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 0.0), ("t", 4, 2, 9.0), ("u", 5, 77, 1.0)]
    rows = spark.createDataFrame([(*n, "user", str(n[1])) for n in nodes], "tree string, node long, parent long, score double, role string, text string")
    got = collections.defaultdict(list)
    for r in sorted(chat.chosen_paths(rows, 2).collect(), key=lambda r: -r.up):
        got[r.tree, r.branch].append(r.node)
    assert got == {("t", 1): [1, 2, 4], ("t", 2): [1, 3], ("u", 1): [5]}
    assert sorted((r.tree, r.branch) for r in chat.format_trees(rows, 2).collect()) == [("t", 1), ("t", 2), ("u", 1)]
    circle = spark.createDataFrame([("c", 1, 2, 1.0), ("c", 2, 1, 1.0)], "tree string, node long, parent long, score double")
    with pytest.raises(ValueError):
        chat.chosen_paths(circle)


# 5


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}
    ids = sorted(sets)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = root(a), root(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies():
    texts = list(ODD) + ["one two", "One  TWO", "one two three four five six seven"]
    shared = prose(60, 5)
    for k in range(40):
        texts.append(shared + " " + prose(60))
    base = prose(150, 6).split()
    for k in range(80):
        w = list(base)
        for _ in range(random.randint(0, 6)):
            w[random.randrange(len(w))] = prose(1)
        texts.append(" ".join(w))
    for k in range(30):
        w = prose(random.randint(5, 40)).split()
        texts += [" ".join(w), " ".join(w), " ".join([*w, "tail"])]
    chain = prose(120, 7).split()
    for k in range(0, 40, 4):
        texts.append(" ".join(chain[k : k + 80]))
    return texts


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 60)])
@pytest.mark.parametrize("most", [3, 50_000])
def test_jaccard_components(spark, monkeypatch, size, percent, most):
    """Also where nearly every list is salted and compared in blocks."""
    monkeypatch.setattr(jaccard, "SALTED", most)
    monkeypatch.setattr(jaccard, "BLOCK", 2 * most)
    texts = near_copies()
    docs = documents(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs, size, percent).collect()}
    assert got == brute_components(enumerate(texts), size, percent)


def test_one_of_each(spark):
    docs = documents(spark, [(5, prose(30, 1)), (3, prose(30, 1)), (3, prose(30, 1)), (9, prose(30, 2)), (None, prose(30, 2)), (None, None), (7, "")])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [3, 7, 9]
    assert jaccard.components_of(docs.limit(0)).count() == 0 and jaccard.one_of_each(docs.limit(0)).count() == 0


def test_words_of_bytes():
    import pyarrow as pa

    texts = ["A b\x0bc", "", " é É x", "a B C", "\xa0\x85", "b"]
    got = [h[a - n : a] for _, h, ns in words.hashes(pa.array(texts)) for a, n in zip(np.cumsum(ns), ns)]
    assert [len(g) for g in got] == [len(t.encode().split()) for t in texts]
    assert got[0].tolist() == got[3].tolist() and got[2][0] != got[2][1] and got[5][0] == got[0][1]
    assert len({int(x) for x in np.concatenate([h for _, h, _ in words.hashes(pa.array([" ".join(map(str, range(100_000)))]))])}) == 100_000


def test_components_of_paths(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n - 1)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7)]
    random.shuffle(edges)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    assert got == {**dict.fromkeys(range(n), 0), **dict.fromkeys(range(1000, 1050), 1000)}


# 6

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((v - 9 if v > 9 else v) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def plain_spans(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    texts = ODD + ["\x01a@b.c é🙂 x@y.z.", "a@b.c.d_x@y.z a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (482) 555-7951. +49", "9" * 30_000, "1 " * 20_000, "a." * 20_000 + "@", "@" * 1000, "+1" + "(" * 10_000]
    texts += ["".join(random.choice("ab1.@+- ()4_9") for _ in range(random.randint(1, 60))) for _ in range(1500)]
    got = {r.doc_id: r for r in pii.find(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in want.split(",")) for k in PLAIN]
        assert not want or set(want.split(",")) <= set(got[i].spans.split(","))
    assert pii.find(documents(spark, texts).limit(0)).count() == 0


def bootstrapped():
    r = random.Random(1)
    texts = [f"{prose(20, i)} contact mail at user{i}@host.example.com {prose(10, i + 500)}" for i in range(30)]
    texts += [f"{prose(20, i + 900)} contact mail at user{i}(at)host7.example {prose(10, i)}" for i in range(5)]
    texts += [f"{prose(30, i + 2000)} section id{r.randint(1000, 9999)}x {prose(10, i)}" for i in range(20)]
    return texts


def test_contexts_discover(spark):
    docs = documents(spark, [t.replace("(at)", "=at=") if False else t.replace("(at)", "_at_") for t in bootstrapped()] + [None, ""])
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in range(30, 35):
        kind, a, b = got[i].split(":")
        assert kind == "email" and texts[i][int(a) : int(b)] == f"user{i - 30}_at_host7.example"
    assert all(got[i] == "" for i in range(35, 57))
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns and clean[55] is None and clean[56] == ""
    assert all("[EMAIL]" in clean[i] and "example" not in clean[i] for i in range(35)) and all(clean[i] == texts[i] for i in range(35, 55))


def test_one_word_discovers(spark):
    """The word in front, or the word behind, where the words further off never recur; a common word does not."""
    texts = [f"{prose(5)} mailbox u{i}x@h.example {prose(4)}" for i in range(12)] + [f"{prose(5)} v{i}x@h.example wrotethis {prose(4)}" for i in range(12)]
    texts += [f"{prose(5)} mailbox u9_at_h.example {prose(4)}", f"{prose(5)} v9_at_h.example wrotethis", f"{prose(3)} often w7_at_h.example {prose(4)}"]
    texts += [f"{prose(2)} often often often often {prose(4)} often w{i}x@h.example {prose(3)}" for i in range(12)]
    docs = documents(spark, texts)
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for i in (24, 25):
        kind, a, b = got[i].split(":")
        assert kind == "email" and "_at_h.example" in texts[i][int(a) : int(b)]
    assert got[26] == ""
    many = " ".join(f"m{i}@h.example" for i in range(3000))
    assert pii.redact(documents(spark, [many])).first().text == " ".join(["[EMAIL]"] * 3000)


def test_redacts_overlaps(spark):
    docs = documents(spark, ["x +12 10.20.30.40 y", "m@1.2.3.4 é🙂 4111111111111111!"])
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["x [PHONE] y", "[EMAIL] é🙂 [CARD]!"]


# 8 and 10


def vectors(spark, rows, more=()):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows] + [(*m, 0, 1) for m in more], "vec_id long, embedding array<float>, label int, cid int")


BAD = [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] + [1.0] * 7), (9004, [None] + [1.0] * 7), (9005, [float("inf")] * 8), (None, [1.0] * 8)]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, x[i].tolist()) for i in range(900)]
    got = collections.defaultdict(list)
    for r in forest.nearest(vectors(spark, rows + rows[:5], BAD)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hit = 0
    for q, found in got.items():
        score = x.astype(float) @ x[q].astype(float)
        order = sorted((-s, i) for i, s in enumerate(score) if i != q)[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - score[f[1]]) < 1e-12 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hit += len({f[1] for f in found} & {i for _, i in order})
    assert hit / (20 * len(got)) >= 0.9
    few = forest.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [1.0]), (2, [2.0, 1.0])])).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in few) == [(1, 2, 2.0), (2, 1, 1.0)]
    assert forest.nearest(vectors(spark, [], BAD[:5])).count() == 0


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LONG", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    for i in range(200, 400):
        x[i] = x[i % 20] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])
    x = x.astype(np.float32)
    x[400:440] = x[3]
    x[450] = x[3] * 2
    rows = [(i, x[i].tolist()) for i in range(500)]
    got = {r.vec_id: r for r in neardup.near_duplicates(vectors(spark, rows + rows[:3], BAD)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(500)
    for _ in range(60):
        label = np.minimum(label, np.where(near, label[None], 10**6).min(1))
    for i in range(500):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(9001, 9006))
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert neardup.near_duplicates(vectors(spark, [])).count() == 0


# 9


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 40)
    texts = ODD[:7] + [f"alpha beta gamma {prose(40)} alpha beta gamma" for _ in range(300)] + [(None, "alpha beta"), (8, "alpha"), (8, "alpha")]
    docs = documents(spark, texts)
    rows = maxent.score_documents(docs).collect()
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    every = [(r.doc_id, tokens(r.text)) for r in docs.collect()]
    c = collections.Counter(w for i, t in every if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i is not None, i or 0, len(t), sum(c[w] > 0 for w in t), n, round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in every)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-5)
    held = [r for r in rows if r.held_out and (r.doc_id or 0) > 8]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert maxent.score_documents(docs.limit(0)).count() == 0


def test_probabilities_add_to_one():
    rng = np.random.default_rng(1)
    vocabulary = rng.integers(1, 1 << 62, 500).astype(np.uint64)
    counts = rng.integers(1, 90, 500)
    m = maxent.Model(vocabulary[:300], counts[:300], int(counts.sum()), 500)
    for f in m.factors:
        f.weights[:] = rng.normal(size=f.weights.shape)
    features = maxent.history(vocabulary[:3], np.array([3]))[:, 2:]
    total = ((counts[300:] + 0.1).sum() + 0.1) / m.rest * 10 ** m.log10_outcomes(features, np.array([maxent.CLASSES - 1]), np.array([0]))[0]
    for i in range(300):
        total += 10 ** (m.log10_outcomes(features, m.klass[i : i + 1], m.part[i : i + 1])[0] + m.inner[i])
    assert total == pytest.approx(1, abs=1e-5)
    empty = maxent.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0)
    classes, parts = empty.outcomes(*empty.find(vocabulary[:3]))
    assert np.allclose(empty.log10_outcomes(maxent.history(vocabulary[:3], np.array([3])), classes, parts), 0)


def test_scores_equal_plain_sums(spark, monkeypatch):
    """Every score against loops over tokens and outcomes with the trained weights."""
    monkeypatch.setattr(maxent, "FREQUENT", 300)
    kept, train = [], maxent.train
    monkeypatch.setattr(maxent, "train", lambda *a: kept.append(train(*a)) or kept[0])
    texts = [None, "", "rare once", "A b A b"] + [f"a b {prose(25, i)} a b" for i in range(40)]
    docs = documents(spark, texts, first=100)
    got = {r.doc_id: r.score for r in maxent.score_documents(docs).collect()}
    m = kept[0]
    assert all(f.weights.any() for f in m.factors)
    coded = {i + 100: [int(h) for _, h, _ in maxent.token_parts(pa.array([t or ""])) for h in h] for i, t in enumerate(texts)}
    counts = collections.Counter(h for i, t in coded.items() if zlib.crc32(str(i).encode()) % 10 for h in t)
    place = {int(h): i for i, h in enumerate(m.words)}
    assert 0 < len(place) < len(counts)

    def chance(f, slots, row, outcome):
        z = [float(f.bias[row, k]) + sum(float(f.weights[s, k]) for s in slots) for k in range(f.weights.shape[1])]
        return math.exp(z[outcome] - max(z)) / sum(math.exp(x - max(z)) for x in z)

    for i, tokens in coded.items():
        total = 0.0
        for at, h in enumerate(tokens):
            past = [tokens[at - k] if at >= k else int(maxent.START) for k in (1, 2)]
            one, two = (np.array([x], np.uint64) for x in past)
            features = [words.mixed(one), words.mixed(two ^ maxent.START), words.mixed(one * np.uint64(3) + words.mixed(two))]
            k = m.klass[place[h]] if h in place else maxent.CLASSES - 1
            p = chance(m.factors[0], [int(x[0]) % maxent.SLOTS for x in features], 0, k)
            if h in place:
                joined = [int(words.mixed(x + np.uint64((int(maxent.END) * (int(k) + 1)) % 2**64))[0]) % maxent.PART_SLOTS for x in features]
                own = [c for j, c in ((j, counts[int(m.words[j])]) for j in range(len(place))) if (m.klass[j], m.part[j]) == (k, m.part[place[h]])]
                p *= chance(m.factors[1], joined, k, m.part[place[h]]) * (counts[h] + 0.1) / sum(c + 0.1 for c in own)
            else:
                p *= (counts[h] + 0.1) / m.rest
            total += math.log10(p)
        assert got[i] == pytest.approx(total, abs=1e-4)


LISTED = "token long, n int, f long, place int, component long"


def test_jaccard_pairs_across_a_million_rows(spark):
    # Rows 2i-1 and 2i are of one size, and the rows around the millionth of two components.
    i = F.col("id")
    rows = spark.range(0, 1_020_001, 1, 1).select(F.lit(7).cast("long").alias("token"), (1 + F.floor((i + 1) / 2)).cast("int").alias("n"), i.alias("f"), F.lit(0).alias("place"), F.when(i > 999_000, i % 2).otherwise(0).alias("component"))
    got = {tuple(sorted(r)) for r in jaccard.crossing_pairs(rows, 100).collect()}
    assert got == {(k, k + 1) for k in range(999_001, 1_020_000, 2)}


@pytest.mark.parametrize("block", [5, 16, 1000])
def test_jaccard_blocks_meet(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(block)
    data = [(t, r.randint(20, 40), f, r.randint(0, 3), r.randint(0, 4)) for t in range(6) for f in range(1 + 17 * t)]
    got = collections.Counter(tuple(sorted((a, b))) for a, b in jaccard.crossing_pairs(spark.createDataFrame(data, LISTED), 80).collect())
    want = collections.Counter()
    for t in range(6):
        rows = sorted((x for x in data if x[0] == t), key=lambda x: (x[1], x[2]))
        for k, (_, n, f, i, c) in enumerate(rows):
            want.update(tuple(sorted((f, g))) for _, m, g, j, d in rows[k + 1 :] if d != c and 100 * n >= 80 * m and min(n - i, m - j) >= jaccard.needed(n, m, 80))
    assert got == want


@pytest.mark.parametrize("size", [4, 5])
def test_shingles_of_few_words(size):
    for n in range(size + 2):
        words_ = [f"w{k}" for k in range(n)]
        got = list(jaccard.shingle_sets(pa.array([" ".join(words_)]), size))
        assert [len(x) for x in got] == [min(n, 1) if n < size else n - size + 1]


def test_jaccard_reads_again_what_is_wanted(spark):
    texts = [prose(20, k) for k in range(60)] + [prose(20, 3)]
    docs = documents(spark, texts)
    ids = [jaccard.set_hash(s) for s in jaccard.shingle_sets(pa.array(texts), 4)]
    signed = [x - 2**64 if x >= 2**63 else x for x in ids]
    for picked in (signed[:7], []):
        got = jaccard.read_again(docs, 4, spark.createDataFrame([(x,) for x in picked], "f long")).collect()
        assert sorted(r.f for r in got) == sorted(set(picked))
        assert all(jaccard.set_hash(np.frombuffer(r.tokens, np.uint64)) == ids[signed.index(r.f)] for r in got)


def test_jaccard_collects_no_fingerprints(spark, monkeypatch):
    wanted = spark.range(1000).select(F.xxhash64("id").alias("f"))
    words_ = jaccard.filter_of(wanted)
    assert len(words_) == jaccard.FILTER_BITS // 64
    f = np.array([r.f for r in wanted.collect()], np.int64)
    assert jaccard.may_hold(words_, f).all() and jaccard.may_hold(words_, f + 1).mean() < 0.1


@pytest.mark.parametrize("name", ["op2_hosts", "op3_chat", "op5_jaccard", "op10_neardup", "op13_manifest"])
def test_matches_sql(spark, name):
    import duckdb
    from conftest import TABLES
    from test_oracle import NAMES, rows

    from huskline.llm import queries

    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, TABLES).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_sets_of_pairs_are_shuffled_once(spark, monkeypatch):
    """Both joins of `matching` read one shuffle of the sets; counters of the sketch take few bytes and come back whole."""
    from huskline.llm import jaccard

    sets = spark.range(200).select(F.col("id").alias("f"), F.lit(3).alias("n"), F.expr("array(1L, 2L, if(id % 2 = 0, 3L, 100 + id))").alias("tokens"))
    pairs = spark.range(199).select(F.col("id").alias("hub"), (F.col("id") + 1).alias("f")).unionByName(spark.range(198).select(F.col("id").alias("hub"), (F.col("id") + 2).alias("f")))
    plans, limit = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(jaccard, "stash", lambda df: plans.append(df) or df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {(r.hub, r.f) for r in jaccard.matching(pairs, sets, lambda n, m, k, ks: np.full(len(n), 3)).collect()}
        plans[0].collect()
        assert "ReusedExchange" in plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found == {(i, i + 2) for i in range(0, 198, 2)}
    size = jaccard.COUNTERS // jaccard.PARTS
    for most in (1, 255, 256, 70_000, 2**40):
        counts = np.random.default_rng(1).integers(0, most, size)
        counts[0] = most
        assert (jaccard._unpacked(jaccard._narrow(counts)) == counts).all()
    assert len(jaccard._narrow(np.random.default_rng(1).poisson(2.0, size))) < size

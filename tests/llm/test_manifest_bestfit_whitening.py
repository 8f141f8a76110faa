"""Operators 11 to 13 against plain Python: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from huskline.llm import bestfit, manifest, whitening  # noqa: E402

WORD = P.path("word_bpe_49k.json")
EXTRA = ("idx", "size", "tree", "digest", "path", "place", "uid", "held", "chunk", "x", "w0")


def clashing(df):
    for name in EXTRA:
        df = df.withColumn(name, F.lit("?"))
    return df


# 11


@pytest.mark.parametrize("low,high,rows,width", [(-100, 100, 1000, 8), (0, 2, 70, 3), (-(2**62), 2**62, 200, 3), (5, 6, 10, 2), (-3, 4, 1, 5), (-9, 9, 130, 1)])
def test_scatter_is_exact(low, high, rows, width):
    x = np.random.default_rng(rows).integers(low, high, (rows, width))
    o = x.astype(object)
    sums, products = whitening.scatter(x)
    assert list(sums) == list(o.sum(axis=0)) and (np.triu(products) == np.triu(o.T.dot(o))).all()


def vectors(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))


def test_whitening(spark):
    r = np.random.default_rng(5)
    base = (r.normal(size=(300, 6)) @ np.diag([3, 2, 1.5, 1, 0.7, 0.2]) * 0.2).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(i, base[3].tolist()) for i in range(50)] + [(None, base[4].tolist()), (7, None), (8, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9, [float("nan")] * 6), (10, [float("inf")] + [0.0] * 5), (11, [-0.0] * 6), (12, []), (13, [0.5])]
    out = whitening.whiten(vectors(spark, rows)).collect()
    kept = [(i, np.array([*v, *[0.0] * (6 - len(v))])) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    assert len(out) == 4 * len(kept)
    x = {i: np.floor(256 * v.astype(float)).astype(int) for i, v in kept if i is not None and i >= 14}
    fit = np.unique(np.stack([np.floor(256 * v).astype(int) for _, v in kept]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh((n * fit.T @ fit - np.outer(s, s)) / n**2)
    for row in out:
        assert row.n == n and row.identity_error < 1e-9 and abs(row.explained - values[-row.component] / values.sum()) < 1e-12
        assert row.deviation_digits == str(row.deviation)
    signs = {}
    for row in out:
        if row.vec_id in x and row.vec_id >= 50:
            want = (x[row.vec_id] - s / n) @ axes[:, -row.component] / np.sqrt(values[-row.component])
            sign = signs.setdefault(row.component, 1 if want * row.whitened > 0 else -1)
            assert abs(row.whitened * sign - want) < 1e-9 and row.deviation == int(((n * x[row.vec_id] - s) ** 2).sum())


def test_whitening_without_variance(spark):
    empty = vectors(spark, [(1, [1.0])]).limit(0)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0
    (one,) = whitening.whiten(vectors(spark, [(1, [0.25])])).collect()
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, None, None, None)
    flat = whitening.whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert {(r.vec_id, r.component, abs(r.whitened) if r.whitened is not None else None) for r in flat} == {(1, 1, 1.0), (2, 1, 1.0), (1, 2, None), (2, 2, None)} and len(flat) == 6
    big = whitening.whiten(vectors(spark, [(1, [3e38]), (2, [-3e38]), (3, [0.0])])).collect()
    assert all(r.deviation is None and int(r.deviation_digits) >= 0 for r in big if r.vec_id < 3) and abs(big[0].identity_error) < 1e-9


# 12


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_words_have_the_library_ids():
    k = tokenizers.Tokenizer.from_file(WORD)
    r = random.Random(4)
    texts = ["", " \n", "don't I'LL", "a\x1cb\x1f c", "x <|endoftext|> y", "Σας ΟΔΟΣ İ é", "日本語 テスト 123", "x" * 5000, "á࣐̖ b́ ́c", "　a b\x85c"]
    texts += ["".join(r.choice("thearinso'ed -.,!éßİΣ\n<|/w>̖́‍日٣") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    t = bestfit.Tokens(WORD)
    for at in range(0, len(texts), 100):
        for text, got in zip(texts[at : at + 100], t.ids(texts[at : at + 100])):
            assert got.tolist() == [*k.encode(text, add_special_tokens=False).ids, bestfit.CLOSING], text


def docs_of(spark, texts):
    return clashing(spark.createDataFrame([(i if i % 11 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4))


def packing_of(out):
    rows = sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset))
    ends: dict[int, int] = {}
    for r in rows:
        assert ends.get(r.sequence_id, 0) == r.offset and r.offset + r.length <= bestfit.LENGTH
        ends[r.sequence_id] = r.offset + r.length
    return rows, len(ends)


@pytest.mark.parametrize("chunk", [8192, 64])
def test_best_fit(spark, monkeypatch, chunk):
    monkeypatch.setattr(bestfit, "CHUNK", chunk)
    k = tokenizers.Tokenizer.from_file(WORD)
    texts = [None, "", " ", prose(9000, 1), "same text"] + ["same text"] * 60 + [prose(random.Random(i).randint(1, 1500), i) for i in range(300)] + ["a " * 4095, "a " * 4096, "a " * 8191]
    rows, sequences = packing_of(bestfit.pack_documents(docs_of(spark, texts), WORD))
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*k.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i if i % 11 else None, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(want, key=order)
    least = -(-sum(w[3] for w in want) // 4096)
    assert sequences <= least + (chunk == 64)  # chunks of a few sequences each leave less to combine
    assert bestfit.pack_documents(docs_of(spark, texts).limit(0), WORD).count() == 0


def test_crossover_keeps_every_piece():
    r = random.Random(2)
    for low, high in ((1, 1500), (900, 1500), (2000, 2100), (4095, 4095)):
        lengths = [r.randint(low, high) for _ in range(400)]
        population = bestfit.begun(lengths, [i // 2 for i in range(400)] if high < 2049 else [], r)
        for _ in range(30):
            one, two = r.choice(population), r.choice(population)
            child = bestfit.cross(one, two, lengths, r)
            assert sorted(i for b in child for i in b) == list(range(400)) and max(bestfit.fills(child, lengths)) <= bestfit.LENGTH
            population.append(child)
            assert bestfit.unpacked(bestfit.packed(child, 400)) and len(bestfit.unpacked(bestfit.packed(child, 400))) == len(child)


def test_search_finds_what_best_fit_misses():
    """Bins of 2048 + 1024 + 1024 beside pieces that mislead best-fit decreasing."""
    worse = better = 0
    for seed in range(12):
        r = random.Random(seed)
        lengths = []
        for _ in range(40):
            a = r.randint(1000, 1700)
            b = r.randint(1000, 4096 - a - 900)
            lengths += [a, b, 4096 - a - b]
        population = bestfit.begun(lengths, [], r)
        start = len(bestfit.best_fit(bestfit.decreasing(range(120), lengths), lengths))
        for spell in range(6):
            population = bestfit.evolve(population, lengths, spell)[: bestfit.POPULATION]
        worse += len(population[0]) > start
        better += len(population[0]) < start
    assert not worse and better


# 13


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(nodes):
    """Root, and each leaf's steps of left and right siblings."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owned = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for o in owners[at + k]:
                    paths[o].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest(*run))
            owned.append([o for k in range(len(run)) for o in owners[at + k]])
        nodes, owners = above, owned
    return nodes[0], paths


def brute(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], []
    for name in names:
        by[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append(tree([leaf(r) for r in by[name]]))
    root, crowns = tree([t[0] for t in trees])
    for name, (subroot, paths), crown in zip(names, trees, crowns):
        for r, path in zip(by[name], paths):
            node = leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                node = leaf(r | {"text": r["text"].translate({c: c + 32 for c in range(65, 91)})})
            for a, b in path + crown:
                node = digest(a, node, b)
            out.append((r["doc_id"], leaf(r), subroot, root, digest(*(a + b for a, b in path + crown)), node, node == root))
    return out


def test_manifest(spark, monkeypatch):
    rows = [(i if i % 5 else None, "T x é" * (i % 4) if i % 3 else None, ["en", None, "", "de"][i % 4] if i < 90 else f"l{i % 19}", None if i % 2 else "s", i) for i in range(160)]
    rows += [(7, "A" * 60_000, "only", "s", 1), (-3, "low", "en", None, None)] + [(3, "B", "en", "s", 1)] * 70
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    order = lambda r: tuple((v is not None, v) for v in r)
    want = sorted(brute([r.asDict() for r in docs.collect()]), key=order)
    assert sorted(map(tuple, manifest.manifest(clashing(docs)).collect()), key=order) == want
    assert not all(w[-1] for w in want) and any(w[-1] for w in want)
    monkeypatch.setattr(manifest, "MOST_SENT", 0)
    assert sorted(map(tuple, manifest.manifest(docs).collect()), key=order) == want
    assert manifest.manifest(docs.limit(0)).count() == 0
    (one,) = manifest.manifest(docs.where("lang = 'only'")).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest("")

"""Comment tokens, diffs, scoring and orders against plain Python."""

import difflib
import io
import math
import random
import tokenize

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from huskline.functions import comments
from huskline.operators import bayes, charmodel, detect, metrics, ranges, sampling, vocab
from huskline.sources import trees


def flags(spark, files):
    df = spark.createDataFrame(list(enumerate(files)), "i int, lines array<string>").repartition(4)
    return [r.f for r in df.select("i", comments.comment_flags(F.col("lines")).alias("f")).orderBy("i").collect()]


def by_python(lines):
    """Flags by Python's tokens, or None where its tokenizer finds an error."""
    found = set()
    try:
        for t in tokenize.generate_tokens(io.StringIO("\n".join(lines)).readline):
            if t.type == tokenize.COMMENT and lines[t.start[0] - 1].lstrip().startswith("#"):
                found.add(t.start[0])
    except (tokenize.TokenError, SyntaxError):
        return None
    return [i + 1 in found for i in range(len(lines))]


def random_file(r):
    """Statements, blocks, open brackets, continued lines and strings, with things that look like comments in them."""
    out, depth = [], 0
    for _ in range(r.randint(1, 12)):
        pad = "    " * depth
        kind = r.randrange(11)
        if kind == 0:
            out += [pad + "if x:", pad + "    y = 1"]
            depth = r.randint(0, depth + 1)
        elif kind == 1:
            out += [pad + "f(1,", "# in brackets", "  2)  # behind"]
        elif kind == 2:
            out += [pad + "a = '''one", "# two", "    # three''' # four", ""]
        elif kind == 3:
            out += [pad + 'b = """it\'s \\""" # no', '# no', '"""']
        elif kind == 4:
            out += [pad + "c = 'x\\", "# still text'", pad + "# after"]
        elif kind == 5:
            out += [pad + "d = 1 + \\", "    2"]
        elif kind == 6:
            out += ["\t# tab", "  # odd", "#", "", "   "]
        elif kind == 7:
            out += [pad + "e = {'#': \"# '''\", 'k': [", "#deep", pad + "# '''", "]}"]
        elif kind == 8:
            out += [pad + "g = r'\\'' + \"\"\"x\"\"\" + '' # '''", pad + "# x = 1"]
        elif kind == 9:
            out += [pad + "ü = 'é'  # ü", pad + "# ü"]
        else:
            out += [pad + "'''doc # not'''", pad + "h = 0"]
        if kind == 0 and depth == 0:
            continue
    return out


def test_comment_tokens_equal_python(spark):
    r = random.Random(11)
    files = [random_file(r) for _ in range(600)]
    want = [by_python(f) for f in files]
    kept = [i for i, w in enumerate(want) if w is not None]
    assert len(kept) > 300 and sum(sum(want[i]) for i in kept) > 1000
    got = flags(spark, [files[i] for i in kept])
    assert [(files[i], g) for i, g in zip(kept, got) if g != want[i]] == []


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ([], []),
        ([""], [False]),
        (["it's", "# yes"], [False, True]),  # a quote without partner ends nothing
        (["'''", "# no", "''' x", "# yes"], [False, False, False, True]),
        (["'a\\", "b", "# yes"], [False, False, True]),  # a string that is not closed ends with its line
        (["if x:", "        y", "    z", "# no"], [False, False, False, False]),  # a dedent to no block ends the file
        (["if x:", "        y", "    # any", "        z", "# yes"], [False, False, True, False, True]),
        (["if x:", "\ty", "        z", "# yes"], [False, False, False, True]),  # a tab is eight columns
        (["(", "x", "    y", "  z", ")", "# yes"], [False] * 5 + [True]),
        (["x = 1 \\", "# yes", "y"], [False, True, False]),
        (["'''", "# a ''' # b"], [False, True]),
        (["# x = 1\r", "y \\\r", "   z\r", "w\r"], [True, False, False, False]),
        (["x" * 50_000 + " '" + "y" * 50_000, "# yes"], [False, True]),
        (["'" + "a\\'" * 20_000 + "'", "# yes"], [False, True]),
    ],
)
def test_comment_tokens(spark, lines, want):
    assert flags(spark, [lines]) == [want]


def test_unified_diff_equals_difflib(spark):
    r = random.Random(3)
    files = []
    for n in (0, 1, 2, 5, 40, 150):
        for share in (0, 0.05, 0.3, 1):
            files.append([(i + 1, f"line {i}", True, r.random() < share) for i in range(n)])
    files.append([(i + 1, f"line {i}", True, i in (0, 7, 15, 22, 39)) for i in range(40)])
    df = spark.createDataFrame(list(enumerate(files)), "i int, parts array<struct<lineno:int,line:string,marked:boolean,gone:boolean>>")
    for row in df.withColumn("diff", detect.unified_diff(F.col("parts"), F.lit("a.py"))).collect():
        before, after = [p.line for p in row.parts], [p.line for p in row.parts if not p.gone]
        assert row["diff"] == "\n".join(difflib.unified_diff(before, after, "before/a.py", "after/a.py", lineterm=""))


def test_removal_by_rules_is_narrow(spark):
    df = spark.createDataFrame([("f", ["x = '''", "# if a:", "'''", "# if b:", "y \\", "# else:", "# words"])], "file_path string, lines array<string>")
    out = detect.removal(df, parser=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert [(p.lineno, p.marked, p.gone) for p in out.first().parts if p.marked] == [(4, True, True), (6, True, False)]


# Scores


TRAINED = [("x = foo(1)", 0), ("return bar", 0), ("import os", 0), ("the end of it", 1), ("some words, here", 1), ("see the words", 1)]


def test_narrow_score_equals_join(spark, monkeypatch):
    rows = spark.createDataFrame(TRAINED, "line string, label int")
    trained = bayes.model(bayes.counts(rows))
    lines = spark.createDataFrame([(i, t) for i, t in enumerate([*[t for t, _ in TRAINED], "", "zzz qqq", "the the the", "'''open", None])], "key int, line string")
    wide = {r.key: r.score for r in bayes.joined_score(lines, trained, ["key"]).collect()}
    narrow = bayes.scored(lines, trained, ["key"])
    assert narrow._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert all(abs(wide[r.key] - r.score) < 2e-6 for r in narrow.collect() if r.line is not None) and len(wide) == lines.count()
    assert wide[6] == 0.5 == wide[7]
    monkeypatch.setattr(bayes, "MOST_SENT", 3)
    assert {r.key: r.score for r in bayes.scored(lines, trained, ["key"]).collect()} == wide


def test_model_of_many_tokens_goes_to_the_rows(spark):
    """More tokens than 200,000: no shuffle, each token as it is, and none is taken for another."""
    n = 210_000
    trained = spark.range(n).select(F.concat(F.lit("t"), "id").alias("token"), F.lit(1).alias("code"), F.lit(1).alias("doc"), (F.col("id") / n - 0.5).alias("odds"))
    lines = spark.createDataFrame([(0, "t0 t1 t209999"), (1, "t7 other"), (2, ""), (3, None), (4, "t105000 t105000")], "key int, line string")
    out = bayes.scored(lines, trained, ["key"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    odds = lambda *ids: sum(i / n - 0.5 for i in ids)
    wanted = [odds(0, 1, 209_999), odds(7), 0, 0, 0]
    assert [r.score for r in out.orderBy("key").collect()] == [round(1 / (1 + np.exp(-x)), 6) for x in wanted]
    hashes, names = np.array([5, 9]), pa.array(["a", "b"])
    asked = pa.array([[{"token": "a", "hash": 5}, {"token": "x", "hash": 9}], None, [{"token": "b", "hash": 9}, {"token": "b", "hash": 7}]])
    assert bayes.added_odds(asked, (hashes, np.array([1.0, 2.0]), names)).tolist() == [1.0, 0.0, 2.0]


def slots_of(text):
    c = [ord(x) for x in text]
    return [(a * 31 + 1) % 1021 for a in c] + [(a * 131 + b * 31 + 2) % 1021 for a, b in zip(c, c[1:])] + [(a * 17161 + b * 131 + d * 31 + 3) % 1021 for a, b, d in zip(c, c[1:], c[2:])]


def test_character_model(spark):
    """Against numpy: same n-grams, weights and scores; and it tells what it has not seen."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeiounrstl") for _ in range(r.randint(2, 8)))
    make = lambda: (f"{word()}_{word()} = {word()}({r.randint(0, 99)})", 0) if r.random() < 0.5 else (" ".join(word() for _ in range(5)), 1)
    rows = [(i, *make()) for i in range(300)] + [(300, "", 1), (301, "é", 1)]
    df = spark.createDataFrame(rows, "key int, line string, label int")
    slots, of = charmodel.grams([*[t for _, t, _ in rows], None, "ab"])
    assert all(sorted(slots[of == i]) == sorted(slots_of(t)) for i, t in enumerate([*[t for _, t, _ in rows], "", "ab"]))
    weights = charmodel.train(df, F.col("key"))
    x, y = np.zeros((301, 1022)), []
    kept = [t for t in rows if t[1]]
    for i, (_, text, label) in enumerate(kept):
        s = slots_of(text)
        x[i, :1021], x[i, 1021] = np.bincount(s, minlength=1021) * 16 / len(s), 1
        y.append(label)
    y = np.array(y)
    counts = [sum(np.bincount(slots_of(t), minlength=1021) for _, t, l in kept if l == label) for label in (1, 0)]
    w = np.append(np.log((counts[0] + 1) / (counts[0].sum() + 1021)) - np.log((counts[1] + 1) / (counts[1].sum() + 1021)), 0)
    for _ in range(charmodel.STEPS):
        w = w - charmodel.RATE * (x.T @ (1 / (1 + np.exp(-(x @ w))) - y)) / len(y)
    assert np.abs(w - weights).max() < 1e-9
    held = spark.createDataFrame([make() for _ in range(200)] + [("", 1)], "line string, label int").withColumn("score", charmodel.score(F.col("line"), weights))
    assert metrics.exact_auc(held, F.col("label") == 1, F.col("score")).first().auc > 0.95
    assert charmodel.train(df.limit(0), F.col("key"))[1021] == 0


# Orders


@pytest.mark.parametrize(("parts", "sampled"), [(1, 64), (3, 64), (64, 64), (16, 2)])
def test_numbers_of_a_total_order(spark, monkeypatch, parts, sampled):
    monkeypatch.setattr(ranges, "SAMPLED", sampled)
    r = random.Random(parts)
    rows = [(r.randint(0, 9), r.choice("abcdef") * r.randint(1, 3), i) for i in range(700)]
    df = spark.createDataFrame(rows, "a int, b string, i int").repartition(5)
    got = ranges.numbered(df, {"_a": -F.col("a"), "_b": F.col("b"), "_i": F.col("i")}, parts)
    assert got.columns == ["a", "b", "i", "place"]
    order = sorted(rows, key=lambda x: (-x[0], x[1], x[2]))
    assert [(x.a, x.b, x.i) for x in sorted(got.collect(), key=lambda x: x.place)] == order
    assert ranges.numbered(df.limit(0), {"_a": F.col("a")}, parts).count() == 0


def test_exact_auc(spark):
    r = random.Random(8)
    rows = [(r.choice([0.1, 0.2, 0.2000001, r.random()]), r.random() < 0.4) for _ in range(500)]
    df = spark.createDataFrame([*rows, (None, True), (0.5, None), (math.nan, True)], "score double, truth boolean")
    pairs = [(s > t) + (s == t) / 2 for s, a in rows if a for t, b in rows if not b]
    assert metrics.exact_auc(df, F.col("truth"), F.col("score")).first().auc == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)
    assert metrics.exact_auc(df.where("truth"), F.col("truth"), F.col("score")).first().auc is None
    assert metrics.exact_auc(df.limit(0), F.col("truth"), F.col("score")).first().auc is None


def test_unlimited_vocabulary_needs_no_single_task(spark):
    rows = spark.createDataFrame([(" ".join(f"w{i % 37} v{i % 11}" for i in range(k)),) for k in range(60)], "line string")
    made = vocab.vocabulary(rows, "name_op")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # of the totals: a row a range
    got = sorted(map(tuple, made.collect()))
    assert [r for r, _, _ in got] == list(range(1, 49)) and got == sorted(got, key=lambda x: (-x[2], x[1]))


@pytest.mark.parametrize(("total", "n"), [(0, 5), (3, 5), (50, 50), (2000, 30)])
def test_draws_equal_a_full_sort(spark, total, n):
    import hashlib

    rows = spark.range(total).select(F.col("id").alias("k"))
    got = {}
    for x in sampling.draws(rows, F.col("k"), n, 4).collect():
        got.setdefault(x.draw, set()).add(x.k)
    for draw in range(1, 5):
        order = sorted(range(total), key=lambda k: hashlib.md5(f"{k}-{draw}".encode()).hexdigest())
        assert got.get(draw, set()) == set(order[:n])


def test_interleaved_labels(spark):
    rows = [(i, 0 if i < 23 else 1 if i < 33 else 2) for i in range(40)]
    out = sampling.interleaved(spark.createDataFrame(rows, "k int, label int").repartition(3), F.col("k")).orderBy("position").collect()
    assert [x.position for x in out] == list(range(69)) and [x.label for x in out] == [0, 1, 2] * 23
    for label, size in ((0, 23), (1, 10), (2, 7)):
        own = [x.k for x in out if x.label == label]
        assert len(set(own)) == size and own == [own[i % size] for i in range(23)]


def test_percentiles_of_a_histogram(spark):
    df = spark.createDataFrame([("a", 1, 50), ("a", 2, 40), ("a", 9, 10), ("b", 4, 1)], "part string, length int, n long")
    got = {(r.part, r.share): r.length for r in metrics.percentiles(df, "part", "length", "n", (0.5, 0.9, 0.91, 1.0)).collect()}
    assert got == {("a", 0.5): 1, ("a", 0.9): 2, ("a", 0.91): 9, ("a", 1.0): 9, ("b", 0.5): 4, ("b", 0.9): 4, ("b", 0.91): 4, ("b", 1.0): 4}


def test_paired_detectors(spark):
    rows = [(True, True, True)] * 5 + [(True, True, False)] * 4 + [(False, True, False)] * 2 + [(False, False, False)] * 3
    got = {r.detector: r for r in metrics.paired(spark.createDataFrame(rows, "t boolean, a boolean, b boolean"), F.col("t"), one=F.col("a"), two=F.col("b")).collect()}
    assert (got["one"].tp, got["one"].fp, got["one"].n_only_right, got["two"].fn, got["two"].n_only_right, got["two"].n_both_right) == (9, 2, 4, 4, 2, 8)
    assert got["one"].chi_squared == pytest.approx(1 / 6, abs=1e-6)


# Files


def test_declared_encodings(spark):
    cases = {
        "plain": "x = 'é'\n".encode(),
        "cyrillic": "# coding: cp1251\nx = 'привет'\n".encode("cp1251"),
        "second": "#!/usr/bin/python\n# -*- coding: latin-1 -*-\nx = 'é'\n".encode("latin-1"),
        "third": "\n\n# coding: cp1251\nx = 'ö'\n".encode(),
        "mark": b"\xef\xbb\xbfx = 1\r\ny\r\n",
        "against": b"\xef\xbb\xbf# coding: cp1251\nx\n",
        "wide": "x = 1\n".encode("utf-16"),
        "unknown": b"# coding: no-such-codec\nx = '\xe9'\n",
        "untrue": b"# coding: utf-8\nx = '\xe9'\n",
        "bytes": b"\xff\xfe\xfd",
        "empty": b"",
    }
    df = spark.createDataFrame([*cases.items(), ("none", None)], "file_path string, content binary").repartition(3)
    got = {r.file_path: (r.encoding, r.codec, r.code) for r in trees.decode_declared(df).collect()}
    assert got["cyrillic"] == ("cp1251", "cp1251", "# coding: cp1251\nx = 'привет'\n") and got["second"][2].endswith("'é'\n") and got["plain"] == (None, "utf-8", "x = 'é'\n")
    assert got["third"][0] is None and got["third"][2].endswith("'ö'\n") and got["mark"] == (None, "utf-8-sig", "x = 1\r\ny\r\n")
    for name in ("against", "wide", "unknown", "untrue", "bytes"):
        assert got[name][1:] == ("latin-1", cases[name].decode("latin-1")), name
    assert got["unknown"][0] == "no-such-codec" and got["empty"][2] == "" and got["none"] == (None, None, None)


def test_trees_are_listed_level_by_level(spark, tmp_path):
    deep = tmp_path / "only" / "one" / "way"
    names = []
    for i in range(12):
        place = deep / f"d{i}" / ("_x" if i % 2 else ".y") / "z"
        place.mkdir(parents=True)
        for name in ("__init__.py", ".dot.py", f"m{i}.py", "note.txt"):
            (place / name).write_text(f"# {i}")
            names.append(str(place / name))
    want = {n for n in names if n.endswith(".py")}
    rows = trees.scan_tree(spark, str(tmp_path)).collect()
    assert {r.file_path for r in rows} == want and len(rows) == len(want) and all(bytes(r.content).startswith(b"# ") for r in rows)
    plain = {n for n in want if "/." not in n}
    assert {r.file_path for r in trees.scan_tree(spark, str(tmp_path), hidden=False).collect()} == plain
    assert {r.file_path for r in trees.scan_tree(spark, f"file://{tmp_path}").collect()} == {"file://" + n for n in want}
    assert trees.scan_tree(spark, str(deep / "d0")).count() == 3 and trees.scan_tree(spark, str(deep / "d0"), hidden=False).count() == 0
    (tmp_path / "empty").mkdir()
    assert trees.scan_tree(spark, str(tmp_path / "empty")).count() == 0
    one = str(deep / "d1" / "_x" / "z" / "m1.py")
    assert [r.file_path for r in trees.scan_tree(spark, one).collect()] == [one] and trees.scan_tree(spark, one, ".txt").count() == 0


def test_trees_that_only_spark_opens(spark, tmp_path):
    """A store that no other reader knows: a mounted view of a folder."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.py").write_text("x = 1")
    (tmp_path / "a" / "n.txt").write_text("no")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.trees.link./in", f"file://{tmp_path}")
    rows = trees.scan_tree(spark, "viewfs://trees/in").collect()
    assert [(r.file_path.rsplit("/", 1)[1], bytes(r.content)) for r in rows] == [("m.py", b"x = 1")]


def test_lines_that_are_too_long_are_passed_over(spark):
    from huskline.operators import lines

    rows = lines.explode_lines(spark.createDataFrame([("f", "# a\n# " + "b" * lines.MOST_CHARS)], "file_path string, code string"))
    assert rows.count() == 2 and [r.content for r in lines.comments(lines.within_limit(rows)).collect()] == ["a"]

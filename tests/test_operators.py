"""Single operators on small literal rows."""

import ast
import random
import re
import time
import weakref

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from huskline.functions import parsing, rules
from huskline.functions import text as tx
from huskline.operators import bayes, charmodel, detect, features, labels, lines, metrics, sampling, vocab
from huskline.plans import registry
from huskline.sources import trees


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one(spark, text, column):
    return values(spark, [(text,)], "line string", column)[0]


def test_lines_of_all_endings(spark):
    f = spark.createDataFrame([("a", "x\r\ny\rz\n"), ("b", ""), ("c", "\n\n")], "file_path string, code string")
    got = [(r.file_path, r.lineno, r.line) for r in lines.explode_lines(f).collect()]
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("c", 1, ""), ("c", 2, "")]


def test_comment_content(spark):
    f = spark.createDataFrame([("f", "# compile(text_line, '<string>', 'exec')\n\t# tab\nx = 1  # no\n  ## y \t")], "file_path string, code string")
    got = [(r.lineno, r.content) for r in lines.comments(lines.explode_lines(f)).collect()]
    assert got == [(1, "compile(text_line, '<string>', 'exec')"), (2, "\t# tab"), (4, "y")]


def test_long_docstring_needs_no_stack(spark):
    code = 'a\n"""' + "word\n" * 40_000 + '"""\nb'
    assert one(spark, code, lines.strip_docs(F.col("line"))) == "a\nb"


def test_anchors(spark):
    code = "# one\nx\n  # two\n"
    assert one(spark, code, lines.leading_comments(F.col("line"))) == ["one", "two"]
    assert one(spark, code, lines.leading_comments(F.col("line"), "file")) == ["one"]
    assert one(spark, code, lines.strip_docs(F.col("line"), "file")) == "x\n  # two\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (["x = '''open", "inside", "end''' y", "# doc", "\t# tab is code", "z"], [0, 1, 1, 1, 0, 0]),
        (["'''a''' b", "still", "'''"], [1, 1, 1]),
        (['"""whole line."""', "   ", 'y = """in""" + z', 'w = """open', "c'''", '"""'], [1, None, 0, 0, 1, 1]),
        ([], []),
    ],
)
def test_scanner(spark, text, want):
    assert values(spark, [(text,)], "a array<string>", labels.labels(F.col("a")))[0] == want


def test_context_edges(spark):
    f = spark.createDataFrame([(1, "train", "en", ["a", "", " ", "b", "c"])], "doc_id long, split string, lang string, lines array<string>")
    got = {r.text: (r.before, r.after) for r in labels.context_lines(f, 2, 1).collect()}
    assert got == {"a": ([], [" "]), "b": (["a", " "], ["c"]), "c": ([" ", "b"], [])}


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("for i in range(10):", "NAME:for NAME:i NAME:in NAME:range OP:( NUMBER:10 OP:) OP:):"[:-2] + ":"),
        ('r"""never closed', ""),
        ("except(", "NAME:except OP:("),
        ("x = 'a\\'b' # c", "NAME:x OP:= STRING:'a\\'b' COMMENT:# c"),
        ("$ ? 'lone", "ERROR:$ ERROR:? ERROR:' NAME:lone"),
        ("0xFF 1e5j .5", "NUMBER:0xFF NUMBER:1e5j NUMBER:.5"),
    ],
)
def test_lexer(spark, line, want):
    got = one(spark, line, F.array_join(F.transform(tx.lex(F.col("line")), lambda t: F.concat_ws(":", t["kind"], t["tok"])), " "))
    assert got == (want if not line.startswith("for") else "NAME:for NAME:i NAME:in NAME:range OP:( NUMBER:10 OP:) OP::")


@pytest.mark.parametrize(("name", "want"), [("getHTTPServer2x", ["get", "HTTPServer", "2", "x"]), ("__a_b__", ["a", "b"]), ("_", []), ("x1y2", ["x", "1", "y", "2"])])
def test_identifier_parts(spark, name, want):
    assert one(spark, name, tx.split_identifier(F.col("line"))) == want


@pytest.mark.parametrize("width", [1, 2, 3, 5])
@pytest.mark.parametrize("padding", ["pre", "post"])
@pytest.mark.parametrize("truncating", ["pre", "post"])
def test_padded_width(spark, width, padding, truncating):
    got = values(spark, [([1, 2, 3],), ([],)], "a array<int>", tx.pad(F.col("a"), width, padding, truncating))
    assert all(len(g) == width for g in got)
    if width < 3:
        assert got[0] == ([1, 2, 3][-width:] if truncating == "pre" else [1, 2, 3][:width])


def test_ids_and_back(spark):
    assert one(spark, "for zz in x:", features.ids_of(F.col("line"))) == [8 + tx.KEYWORD_VOCABULARY.index("for"), 2, 8 + tx.KEYWORD_VOCABULARY.index("in"), 2, 8 + tx.KEYWORD_VOCABULARY.index(":")]
    assert one(spark, "for zz in x:", features.decode(features.ids_of(F.col("line")))) == "for <NAME> in <NAME> :"
    assert one(spark, "é~A", tx.char_ids(F.col("line"))) == [1, 64, 2]


def test_prose_by_adjacent_names(spark):
    got = values(spark, [("this is prose text",), ("for x in y",), ("return x",), ("",)], "line string", tx.adjacent_names(tx.lex(F.col("line"))))
    assert got == [True, False, False, False]


def test_join_agrees_with_array(spark):
    rows = spark.createDataFrame([(1, "if x == 'a':"), (2, "def f(y):")], "id long, line string")
    words = spark.createDataFrame(list(enumerate(tx.KEYWORD_VOCABULARY)), "rank int, token string")
    by_join = {r.id: r.ids for r in features.ids_by_join(rows, words, ["id"]).collect()}
    assert by_join == {r.id: r.ids for r in rows.select("id", features.ids_of(F.col("line")).alias("ids")).collect()}


@pytest.mark.parametrize(
    ("content", "want"),
    [("=", "drop"), ("coding=utf-8", "drop"), ("A sentence.", "drop"), ("naïve", "drop"), ("from a import b", "candidate"), ("x = 1", "candidate"), ("(a, b),,", "candidate"), ("[a]", "candidate"), ('if __name__ == "__main__":', "main_guard"), ("some words", "undecided")],
)
def test_triage(spark, content, want):
    assert one(spark, content, rules.triage(F.col("line"))) == want


def test_parse_or_compile(spark):
    rows = spark.createDataFrame([("return x = 1",), ("x = 1",), ("(return x)",), ("self.x",), ("from a import (",)], "content string")
    assert [r.rule for r in detect.confirmed(rows).collect()] == ["undecided", "candidate", "undecided", "candidate", "undecided"]
    got = spark.createDataFrame([("return x",), ("a\0b",), (None,), ("(" * 5000,)], "c string").select(parsing.parses("c"), parsing.compiles("c")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False), (False, False)]


@pytest.mark.parametrize(
    ("line", "stage", "code"),
    [
        ("x = 1", "not_comment", False), ("# Issue #999", "hash_number", False), ("# noqa: x", "whitelisted", False), ("# -*- coding: utf-8 -*-", "coding", False), ("# words", "no_indicator", False), ("# foo(a):", "multiline", True), ("# else:", "block", True),
        ("# 'key': value,", "partial_dict", True), ("# print(x)", "needs_compile", True), ("# see (this) one", "needs_compile", False), ("# x = [", "multiline", True),
    ],
)
def test_eradicate(spark, line, stage, code):
    r = detect.era_verdict(spark.createDataFrame([(line,)], "line string")).first()
    assert (r.stage, r.is_code) == (stage, code)


def test_removed_and_left_make_the_file(spark):
    f = spark.createDataFrame([(1, ["a + \\", "# return x:", "# foo(a):", "b"])], "doc_id long, lines array<string>")
    parts = detect.removal(f).first().parts
    assert [p.gone for p in parts] == [False, False, True, False] and [p.line for p in parts] == ["a + \\", "# return x:", "# foo(a):", "b"]


def test_comments_in_strings_are_none(spark):
    code = 'x = """\n# no = 1\n"""\n# yes = 1\ny = 2 # tail\n'
    assert one(spark, code, parsing.comment_rows(F.col("line"))) == [4]


def test_node_types(spark):
    r = one(spark, "x = f(1)", parsing.node_types(F.col("line")))
    assert r.preorder[:3] == ["Module", "Assign", "Name"] and sorted(r.preorder) == sorted(r.breadth_first)
    assert r.breadth_first == [type(n).__name__ for n in ast.walk(ast.parse("x = f(1)"))]


def test_findings_round_trip(spark):
    rows = spark.createDataFrame([("f", 374, 'say "a"\t'), ("f", 2, "é"), ("g", 1, "x")], "file_path string, lineno long, content string")
    docs = detect.findings(rows)
    assert docs.count() == 2
    assert sorted(map(tuple, detect.flat_findings(docs).collect())) == sorted(map(tuple, rows.collect()))


def test_keyed_union(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a")], [(1, "b"), (2, "c")]))
    assert sorted(map(tuple, detect.combine_tables(a, b, ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_any_model(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "x array<float>")
    assert [r.score for r in detect.model_score(rows, "x", 2, lambda: lambda x: x.sum(axis=1).astype("float64")).collect()] == [3.0, 7.0]


def test_balance_and_split(spark):
    rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    assert {(r.label, r["count"]) for r in sampling.balanced(rows, F.col("key")).groupBy("label").count().collect()} == {(0, 100), (1, 100)}
    got = {(r.label, r.part): r["count"] for r in sampling.stratified(rows, F.col("key"), 0.33).groupBy("label", "part").count().collect()}
    assert got == {(0, "test"): 297, (0, "train"): 603, (1, "test"): 33, (1, "train"): 67}


def test_counts_add_up(spark):
    rows = spark.createDataFrame([("x = 1", 0), ("some words here", 1), ("y = x", 0)], "line string, label int")
    whole = {tuple(r) for r in bayes.counts(rows).collect()}
    parts = bayes.added(*(bayes.counts(rows.where(c)) for c in ("line like 'x%'", "line not like 'x%'")))
    assert {tuple(r) for r in parts.select("token", "code", "doc").collect()} == whole
    told = {r.line: r.score for r in bayes.score(rows, bayes.model(bayes.counts(rows)), ["line"]).collect()}
    assert told["x = 1"] < 0.5 < told["some words here"]


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 1), (0, 0)], "said int, truth int")
    r = metrics.binary(rows, F.col("truth") == 1, F.col("said") == 1).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.f1) == (2, 0, 1, 2, 0.8)
    assert metrics.binary(rows.where("truth = 2"), F.col("truth") == 1, F.col("said") == 1).first().precision is None
    s = spark.createDataFrame([(0.9, True), (0.8, False), (0.4, True), (0.1, False)], "score double, truth boolean")
    assert metrics.auc(metrics.roc(s, F.col("truth"), F.col("score"))).first().auc == 0.75
    assert [r.tp for r in metrics.sweep(s, F.col("truth"), F.col("score")).orderBy("threshold").collect()] == [2, 1, 1, 1, 1]


def test_vocabulary_ties_and_limit(spark):
    rows = spark.createDataFrame([("b a",), ("a b c",)], "line string")
    assert [(r.rank, r.token, r.cnt) for r in vocab.vocabulary(rows, "name_op", 2).orderBy("rank").collect()] == [(1, "a", 2), (2, "b", 2)]
    assert vocab.vocabulary(rows, "name_op").count() == 3


def test_trees(spark, tmp_path):
    (tmp_path / "pkg" / ".hidden").mkdir(parents=True)
    (tmp_path / "pkg" / "a.py").write_text("# x = 1\n")
    (tmp_path / "pkg" / "__init__.py").write_text("")
    (tmp_path / "pkg" / "b.txt").write_text("no")
    (tmp_path / "pkg" / ".hidden" / "c.py").write_text("y")
    (tmp_path / "pkg" / "latin.py").write_bytes(b"# -*- coding: latin-1 -*-\nx = '\xe9'\n")
    every = trees.scan_tree(spark, str(tmp_path))
    assert every.count() == 4 and trees.scan_tree(spark, str(tmp_path), hidden=False).count() == 3
    assert trees.scan_tree(spark, str(tmp_path / "pkg" / "a.py")).count() == 1
    strict = {r.file_path.rsplit("/", 1)[1]: r.code for r in trees.decode_utf8(every).collect()}
    assert strict["latin.py"] is None and strict["a.py"] == "# x = 1\n"
    loose = {r.file_path.rsplit("/", 1)[1]: (r.encoding, r.code) for r in trees.decode_declared(every).collect()}
    assert loose["latin.py"] == ("latin-1", "# -*- coding: latin-1 -*-\nx = 'é'\n") and loose["a.py"][0] is None


def test_tables(spark, tmp_path):
    (tmp_path / "train_1.jsonl").write_text('{"code": "x", "docstring": "d", "more": 1}\n')
    assert [tuple(r) for r in trees.read_corpus(spark, str(tmp_path / "*.jsonl")).collect()] == [("x", "d", "train")]
    words = spark.createDataFrame([(1, ",", 5), (2, '"', 3)], "rank int, token string, cnt long")
    trees.write_vocabulary(words, str(tmp_path / "vocab"))
    assert sorted(map(tuple, trees.read_vocabulary(spark, str(tmp_path / "vocab")).collect())) == [(1, ",", 5), (2, '"', 3)]
    (tmp_path / "list.txt").write_text("if\nelse\n")
    assert [tuple(r) for r in trees.read_token_list(spark, str(tmp_path / "list.txt")).collect()] == [(0, "if"), (1, "else")]
    (tmp_path / "l.csv").write_text('language,line,is_code\npy,x,1\njs,"a, b",0\n')
    assert [tuple(r) for r in trees.read_language_lines(spark, str(tmp_path / "l.csv")).collect()] == [("js", "a, b", 1)]


def test_plans_of_a_scan_are_narrow(spark):
    f = spark.createDataFrame([("f", "# x = 1\n")], "file_path string, code string")
    plan = detect.triaged(lines.comments(lines.explode_lines(f)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_stream(spark, tmp_path):
    from huskline.streaming.scan import scan_stream

    spark.createDataFrame([("f", "# x = 1\n# words\n")], "file_path string, code string").write.parquet(str(tmp_path / "in"))
    query = scan_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("scanned").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.rule for r in spark.sql("SELECT rule FROM scanned").collect()) == ["candidate", "undecided"]


def test_adjacent_names_of_long_lines(spark):
    """Work grows with the tokens of a line, not with their square."""
    r = random.Random(5)
    lines = [" ".join(r.choice(["one", "two", "for", "in", "(", "1", "'s t'", "="]) for _ in range(r.randint(0, 6))) for _ in range(200)]
    apart = " = ".join(["name"] * 10_000)

    def by_python(line):
        t = re.findall(r"'s t'|\S+", line)
        return any(a in ("one", "two", "name") and b in ("one", "two", "name") for a, b in zip(t, t[1:]))

    start = time.time()
    got = values(spark, [(x,) for x in [*lines, apart, apart + " name"]], "line string", tx.adjacent_names(tx.lex(F.col("line"))))
    assert got == [*map(by_python, lines), False, True]
    assert time.time() - start < 60


def test_models_are_counted_once_and_common_tokens_dealt_out(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"x{i % 7} = y{i % 3}", i % 2) for i in range(60)], "key int, line string, label int")
    counted = bayes.kept(bayes.counts(rows))
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()
    trained = bayes.model(counted)
    told = {r.key: r.score for r in bayes.score(rows, trained, ["key"]).collect()}
    monkeypatch.setattr(bayes, "MOST_SENT", 0)
    for common in (1, 30, 1000):
        monkeypatch.setattr(bayes, "COMMON", common)
        assert {r.key: r.score for r in bayes.score(rows, trained, ["key"]).collect()} == told


def test_python_holds_one_tree_and_few_characters_at_once(spark, monkeypatch):
    held, most, parse = weakref.WeakSet(), [], parsing._tree

    def counted(text):
        tree = parse(text)
        if tree:
            held.add(tree)
        most.append(len(held))
        return tree

    monkeypatch.setattr(parsing, "_tree", counted)
    told = parsing.node_types.func(pd.Series(["x", "a = 1", None, "(", "f()"]))
    assert [x and len(x) for x in told.preorder] == [4, 5, None, None, 5] and max(most) == 1
    monkeypatch.setattr(charmodel, "MOST_CHARS", 5)
    texts = ["abc", None, "de", "f", "", "a long text", "g", "hijk"]
    parts = [texts[p] for p in charmodel.pieces(texts)]
    assert sum(parts, []) == texts and parts == [["abc", None, "de"], ["f", ""], ["a long text"], ["g", "hijk"]] and not list(charmodel.pieces([]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    registry.files(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_removal_stages_each_line_once(spark):
    """No lambda over the lines holds the stages of all lines."""
    out = detect.removal(spark.createDataFrame([("f", ["x = 1", "# y = f(2)", "# prose here", "# ),", "# else:"])], "file_path string, lines array<string>"))
    assert not re.search(r"CASE WHEN \(transform\(", out._jdf.queryExecution().optimizedPlan().toString())
    assert [(p.lineno, p.gone) for p in out.first().parts] == [(1, False), (2, True), (3, False), (4, True), (5, True)]


def test_removal_starts_one_python_worker_a_task(spark):
    lines = ["x = '''", "# y = f(2)", "'''", "# y = f(2)", "# prose here", "# ),", "# print x", "z = 1  # q = 2"]
    df = spark.createDataFrame([("f", lines), ("g", []), ("h", None)], "file_path string, lines array<string>")
    out = detect.marked_lines(df)
    assert len(re.findall("ArrowEvalPython", out._jdf.queryExecution().executedPlan().toString())) == 1
    assert {r.file_path: r.marked and [bool(m) for m in r.marked] for r in out.collect()} == {"f": [False, False, False, True, False, True, True, False], "g": [], "h": None}


def test_texts_of_any_length_are_parsed(spark, tmp_path):
    code = "x = f(1)\n" * 30_000
    told = parsing.node_types.func(pd.Series([code, code + "("]))
    assert [x and len(x) for x in told.preorder] == [1 + 7 * 30_000, None] and [x and len(x) for x in told.breadth_first] == [1 + 7 * 30_000, None]
    assert list(parsing.parses.func(pd.Series([code, code + "("]))) == list(parsing.compiles.func(pd.Series([code, code + "("]))) == [True, False]
    assert parsing.parses.func(pd.Series(["-" * 300_000 + "1", "1+" * 150_000 + "1", "(" * 300_000])).sum() == 0  # Python itself refuses these
    spark.createDataFrame([(24, "a b " * 62_500, "en", "web"), (48, "b", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in registry.QUERIES["ast_sequences_files"](spark, str(tmp_path)).collect()) == [(24, "Module", "Module"), (48, "Module", "Module")]
    assert {r.split: r.parsing for r in registry.QUERIES["parse_pass_counts"](spark, str(tmp_path)).collect()} == {"train": 2}


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Tables with more training lines than the character model's bound, and its weights from all of them."""
    r = random.Random(3)
    text = lambda: "\n".join(" ".join(r.choice(["set", "a", "of", "Loop", "42", "the()", "é"]) for _ in range(r.randint(1, 4))) for _ in range(300))
    path = str(tmp_path_factory.mktemp("many"))
    spark.createDataFrame([(i, text(), "en", "web") for i in range(130)], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    lines = registry.labelled(spark, path).where("split = 'train'")
    assert lines.count() > charmodel.MOST_ROWS * 5 / 4
    return path, np.array(charmodel.train(lines, F.col("key"), most=10**9))


def test_auc_of_a_model_of_every_line(spark, many):
    path, weights = many
    told = registry.QUERIES["char_auc"](spark, path).first().auc
    held = registry.labelled(spark, path).where("split <> 'train'").withColumn("score", charmodel.score(F.col("line"), weights.tolist()))
    assert told == metrics.exact_auc(held, F.col("label") == 1, F.col("score")).first().auc
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        assert told == con.execute(registry.SQL["char_auc"]).fetchone()[0]


#: Queries with votes of the character model.
VOTED = ["model_votes", "code_flags", "combine_votes", "combine_votes_aggressive", "scan_findings", "scan_summary"]


@pytest.mark.parametrize("name", VOTED)
def test_votes_of_a_model_of_every_line(spark, many, monkeypatch, name):
    used, score = [], charmodel.score
    monkeypatch.setattr(charmodel, "score", lambda text, weights: used.append(weights) or score(text, weights))
    registry.QUERIES[name](spark, many[0])
    assert len(used) == 1 and np.abs(np.array(used[0]) - many[1]).max() < 1e-9

"""Every query that has SQL, against DuckDB on the smallest tables."""

import ast
import collections
import io
import json
import math
import tokenize

import duckdb
import pytest
from conftest import TABLES

import __spark_entry__ as entry
from huskline.plans import registry

NAMES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    return con


def rows(df):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
            return ""
        return str(v) if isinstance(v, (bool, str)) or type(v).__name__.startswith("bool") else repr(round(float(v), 8)) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, TABLES).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, TABLES).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def keyed(rows):
    return {(r.file_path, r.lineno): r for r in rows.collect()}


def test_votes_and_findings(spark):
    """Against Python over the rows of rules, parser and models."""
    q = lambda name: registry.QUERIES[name](spark, TABLES)
    rules = {k: r.rule for k, r in keyed(q("rule_triage")).items()}
    texts = {k: r.content for k, r in keyed(q("rule_triage")).items()}
    votes = keyed(q("model_votes"))

    def parses(text):
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return False
        return True

    told = {k: "undecided" if r == "candidate" and not parses(texts[k]) else r for k, r in rules.items()}
    assert {k: r.rule for k, r in keyed(q("triage_confirmed")).items()} == told
    sure = {k for k, r in told.items() if r in ("candidate", "main_guard")}
    char, token = ({k for k, v in votes.items() if told[k] == "undecided" and getattr(v, by)} for by in ("by_char", "by_token"))
    assert char and token and any(told[k] != rules[k] for k in told)
    assert {k for k, r in keyed(q("code_flags")).items() if r.is_code} == sure | char | token
    assert set(keyed(q("combine_votes"))) == sure | char and set(keyed(q("combine_votes_aggressive"))) == sure | char | token
    assert set(keyed(q("findings_flat"))) == sure
    found = {(r.file_path, p["lineno"]) for r in q("scan_findings").collect() for p in json.loads(r.document)["problems"]}
    assert found == sure | char | token
    summary = q("scan_summary").collect()
    assert sum(r.findings for r in summary) == len(found) and sum(r.by_char for r in summary) == len(char) and sum(r.by_token for r in summary) == len(token)


def test_removal_of_files(spark):
    """Against plain Python: marks are comment tokens whose verdict is code, but not after a backslash."""
    q = lambda name: registry.QUERIES[name](spark, TABLES).collect()
    code = collections.defaultdict(dict)
    for r in q("era_verdict"):
        code[r.doc_id][r.lineno] = r.is_code
    kept, gone = collections.defaultdict(dict), collections.defaultdict(dict)
    for rows, out in (("era_filtered", kept), ("era_identified", gone)):
        for r in q(rows):
            out[r.doc_id][r.lineno] = r.line
    numbers = {(r.doc_id, r.lineno) for r in q("era_line_numbers")}
    assert any(gone.values())
    for doc in kept:
        lines = kept[doc] | gone[doc]
        text = "\n".join(lines[i] for i in sorted(lines))
        comments = set()
        try:
            for t in tokenize.generate_tokens(io.StringIO(text).readline):
                if t.type == tokenize.COMMENT and t.line.lstrip().startswith("#"):
                    comments.add(t.start[0])
        except (tokenize.TokenError, SyntaxError):
            pass
        marked = {i for i in comments if code[doc][i]}
        assert marked == {n for d, n in numbers if d == doc}
        assert set(gone[doc]) == {i for i in marked if not lines.get(i - 1, "").rstrip().endswith("\\")}
    changed = {r.doc_id: (r.changed, r.removed) for r in q("era_changes")}
    assert all(changed[d] == (bool(gone[d]), len(gone[d])) for d in kept)

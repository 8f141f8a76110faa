"""The registered queries as DuckDB SQL, written apart from their Spark form."""

from __future__ import annotations

from ..functions import rules
from ..functions import text as tx
from ..functions.comments import BACKSLASH, INSIDE, LETTERS, MARKS
from ..operators.charmodel import MOST_ROWS, RATE, SCALE, SLOTS, STEPS
from ..operators.labels import IN_CODE
from ..operators.metrics import THRESHOLDS
from ..sources.code_view import SPLIT, TEMPLATE

SQL: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chars(s: str) -> str:
    """A text as SQL, control characters by code."""
    return "concat(" + ", ".join(f"chr({ord(c)})" for c in s) + ")"


def rx(s: str) -> str:
    return q(s.replace("\\z", "$"))


def array(items) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


VIEW = f"""WITH RECURSIVE raw AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, lang, source, unnest(range(len(a))) AS pos, unnest(a) AS ln FROM raw),
w AS (SELECT *, coalesce(nullif(regexp_extract(ln, '[A-Za-z]+', 0), ''), 'w') AS w1, coalesce(nullif(regexp_extract(ln, '[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1), ''), 'v') AS w2 FROM x),
cl AS (SELECT doc_id, lang, concat('/src/', source, '/', CAST(doc_id AS VARCHAR), '.py') AS file_path, {SPLIT} AS split, pos + 1 AS lineno, {TEMPLATE} AS line FROM w),
cm AS (SELECT *, rtrim(ltrim(line, ' #'), {chars(tx.BLANKS)}) AS content FROM cl WHERE starts_with(ltrim(line, {chars(tx.BLANKS)}), '#')),
fl AS (SELECT doc_id, any_value(split) AS split, any_value(lang) AS lang, any_value(file_path) AS file_path, string_agg(line, chr(10) ORDER BY lineno) AS code FROM cl GROUP BY doc_id),
ne AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lineno) AS idx FROM cl WHERE length(line) > 0)
"""


def _states() -> str:
    kind = "CASE WHEN regexp_matches(line, '^\\s*$') THEN 'b' " + " ".join(f"WHEN regexp_matches(line, {rx(p)}) THEN {q(k)}" for k, p, _, _ in IN_CODE) + " ELSE 'o' END"
    label = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {v}" for k, _, v, _ in IN_CODE) + " ELSE 0 END"
    then = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, _, _, t in IN_CODE) + " ELSE 'c' END"
    return f"""
, kinds AS (SELECT *, {kind} AS kind, contains(line, repeat(chr(39), 3)) AS s, contains(line, repeat(chr(34), 3)) AS d FROM ne),
scan AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS idx, 'c' AS state, CAST(NULL AS INT) AS label FROM ne
 UNION ALL SELECT k.doc_id, k.idx, CASE WHEN kind = 'b' THEN state WHEN state = 'c' THEN {then} WHEN (state = 's' AND k.s) OR (state = 'd' AND k.d) THEN 'c' ELSE state END,
 CASE WHEN kind = 'b' THEN NULL WHEN state = 'c' THEN {label} ELSE 1 END FROM scan JOIN kinds k ON k.doc_id = scan.doc_id AND k.idx = scan.idx + 1),
lab AS (SELECT ne.*, scan.label, concat(CAST(ne.doc_id AS VARCHAR), '-', CAST(ne.idx AS VARCHAR)) AS key FROM ne JOIN scan USING (doc_id, idx) WHERE scan.label IS NOT NULL)
"""


LABELLED = VIEW + _states()


def kind(t: str) -> str:
    ops = ", ".join(map(q, tx.OPERATORS))
    return (
        f"CASE WHEN starts_with({t}, '#') THEN 'COMMENT' WHEN regexp_matches({t}, {rx(tx.IS_NAME)}) THEN 'NAME' WHEN regexp_matches({t}, {rx(tx.IS_NUMBER)}) THEN 'NUMBER' "
        f"WHEN regexp_matches({t}, {rx(tx.OPENS_TRIPLE)}) AND NOT regexp_matches({t}, {rx(tx.IS_TRIPLE)}) THEN NULL WHEN length({t}) > 1 AND regexp_matches({t}, {rx(tx.IS_STRING)}) THEN 'STRING' WHEN {t} IN ({ops}) THEN 'OP' ELSE 'ERROR' END"
    )


def lex(line: str) -> str:
    made = f"list_transform(regexp_extract_all({line}, {q(tx.LEXER)}), lambda t: {{'kind': {kind('t')}, 'tok': t}})"
    return f"list_filter({made}, lambda t: t.kind IS NOT NULL)"


def preclean(line: str) -> str:
    return f"""replace(replace(rtrim(ltrim({line}, {chars(" #'" + '"')}), {chars(" '" + '"')}), repeat(chr(34), 3), chr(34)), repeat(chr(39), 3), chr(39))"""


def parts(name: str) -> str:
    out = f"regexp_replace({name}, '([a-z])([A-Z])', '\\1_\\2', 'g')"
    out = f"regexp_replace({out}, '([A-Za-z])([0-9])', '\\1_\\2', 'g')"
    out = f"regexp_replace({out}, '([0-9])([A-Za-z])', '\\1_\\2', 'g')"
    return f"list_filter(string_split({out}, '_'), lambda p: length(p) > 0)"


def split_names(tokens: str) -> str:
    return f"flatten(list_transform({tokens}, lambda u: CASE WHEN u.kind = 'NAME' THEN list_transform({parts('u.tok')}, lambda p: {{'kind': 'NAME', 'tok': p}}) ELSE [u] END))"


def ids(tokens: str, layout: str = "plain") -> str:
    n = tx.LAYOUTS[layout]
    other = "CASE u.kind " + " ".join(f"WHEN '{k}' THEN {n[k]}" for k in ("NAME", "OP", "NUMBER", "STRING", "COMMENT")) + f" ELSE {n['ERROR']} END"
    known = f"list_position({array(tx.KEYWORD_VOCABULARY)}, u.tok)"
    return f"list_transform({tokens}, lambda u: CASE WHEN u.kind IN ('NAME', 'OP') AND coalesce({known}, 0) > 0 THEN {known} - 1 + {n['first']} ELSE {other} END)"


def char_ids(line: str, alphabet: str, first: int) -> str:
    a = chars(alphabet)
    return f"list_transform(list_filter(string_split({line}, ''), lambda c: length(c) > 0), lambda c: CASE WHEN instr({a}, c) > 0 THEN instr({a}, c) - 1 + {first} ELSE 1 END)"


def pad(x: str, width: int, padding: str = "post", truncating: str = "pre") -> str:
    kept = f"({x})[greatest(len({x}) - {width} + 1, 1):]" if truncating == "pre" else f"({x})[1:{width}]"
    zeros = f"list_transform(range(greatest({width} - len({x}), 0)), lambda z: 0)"
    return f"list_concat({kept}, {zeros})" if padding == "post" else f"list_concat({zeros}, {kept})"


def text(x: str) -> str:
    return f"coalesce(array_to_string({x}, ' '), '')"


def md5_order(key: str, seed: str = "42") -> str:
    return f"md5(concat({key}, '-{seed}'))"


# Lines and comments
SQL["explode_lines"] = VIEW + "SELECT doc_id, file_path, lineno, line FROM cl WHERE NOT (line = '' AND lineno = (SELECT max(lineno) FROM cl c2 WHERE c2.doc_id = cl.doc_id))"
SQL["extract_comments"] = VIEW + "SELECT file_path, lineno, content FROM cm"
_lead = "list_filter(list_transform(regexp_extract_all(code, {p}), lambda c: rtrim(ltrim(c, ' #'), concat(' ', chr(10)))), lambda c: length(c) > 1)"
SQL["leading_comments"] = VIEW + f"SELECT doc_id, unnest({_lead.format(p=q('(?m)^ *#+([^' + chr(92) + 'n]*)'))}) AS content FROM fl"
SQL["leading_comments_file"] = VIEW + f"SELECT doc_id, unnest({_lead.format(p=q(chr(92) + 'A *#+([^' + chr(92) + 'n]*)'))}) AS content FROM fl"
_strip = (
    "regexp_replace(replace(replace(regexp_replace(code, "
    + q(r'(?m:^ *#+[^\n]*(?:\n|\z))|(?s:""".*?""")|' + r"(?s:'''.*?''')")
    + r", '', 'g'), '    ', chr(10)), chr(9), chr(10)), '\n[\s| ]*(\n|\z)', chr(10), 'g')"
)
SQL["strip_docs"] = VIEW + f"SELECT doc_id, {_strip} AS code FROM fl"
_clean = "list_filter(list_transform(string_split({t}, chr(10)), lambda x: rtrim(ltrim(x, ' #'), ' ')), lambda x: length(x) > 1)"
SQL["split_clean_lines"] = VIEW + f"SELECT doc_id, unnest({_clean.format(t='code')}) AS data FROM fl"
SQL["line_dataset"] = VIEW + (
    f", st AS (SELECT doc_id, code, {_strip} AS bare FROM fl) SELECT doc_id, unnest({_clean.format(t='bare')}) AS data, 0 AS label FROM st UNION ALL SELECT doc_id, unnest({_lead.format(p=q('(?m)^ *#+([^' + chr(92) + 'n]*)'))}), 1 FROM st "
    f"UNION ALL SELECT doc_id, unnest({_clean.format(t='string_split(text, chr(10))[1]')}), 1 FROM documents WHERE text IS NOT NULL"
)
_key = "concat(CAST(doc_id AS VARCHAR), '-', CAST(lineno AS VARCHAR))"
SQL["seeded_shuffle"] = VIEW + f"SELECT doc_id, lineno, row_number() OVER (ORDER BY {md5_order(_key)}, {_key}) AS rank FROM cm"
SQL["nonempty_lines"] = VIEW + "SELECT doc_id, line FROM ne"

# Labels and context
SQL["fsm_labels"] = LABELLED + "SELECT doc_id, idx, line, label FROM lab"


def _around(before: int, after: int, sep: str) -> str:
    w = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN {} AND {})"
    b, a = w.format(f"{before} PRECEDING", "1 PRECEDING"), w.format("1 FOLLOWING", f"{after} FOLLOWING")
    return f", ctx AS (SELECT doc_id, idx, lang, split, line AS text, coalesce(list(line) {b}, []) AS b, coalesce(list(line) {a}, []) AS a FROM ne), cx AS (SELECT ctx.*, lab.label, coalesce(array_to_string(b, {sep}), '') AS before, coalesce(array_to_string(a, {sep}), '') AS after FROM ctx JOIN lab USING (doc_id, idx)) "


SQL["context_lists"] = LABELLED + _around(2, 2, "'|'") + "SELECT doc_id, idx, len(b) AS n_before, before, text, len(a) AS n_after, after, label FROM cx"
SQL["context_merged"] = LABELLED + _around(1, 1, "chr(10)") + "SELECT doc_id, idx, before, text, after, label FROM cx"
_whole = ", wf AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY lineno) AS code FROM ne GROUP BY doc_id)"
SQL["context_file"] = LABELLED + _whole + " SELECT lab.doc_id, idx, label, md5(concat(md5(code), chr(10), line)) AS context_md5 FROM lab JOIN wf ON wf.doc_id = lab.doc_id"
SQL["label_counts"] = LABELLED + "SELECT label, count(*) AS n FROM lab GROUP BY label"

# Tokens, ids and features
_tk = f", tk AS (SELECT *, {lex('line')} AS t FROM cl) "
SQL["lex_lines"] = VIEW + _tk + f"SELECT doc_id, lineno, {text('list_transform(t, lambda x: x.kind)')} AS kinds, {text('list_transform(t, lambda x: x.tok)')} AS tokens FROM tk"
SQL["lex_pages"] = f"SELECT page_id, t.kind AS kind, count(*) AS n, CAST(sum(length(t.tok)) AS BIGINT) AS chars FROM (SELECT page_id, unnest({lex('html')}) AS t FROM pages) GROUP BY ALL"
SQL["preclean_lines"] = VIEW + f"SELECT doc_id, lineno, {preclean('line')} AS line FROM cl"
SQL["split_identifiers"] = VIEW + _tk + f"SELECT DISTINCT x.tok AS token, {text(parts('x.tok'))} AS parts FROM (SELECT unnest(t) AS x FROM tk) WHERE x.kind = 'NAME'"
for _name, _layout in (("token_ids", "plain"), ("token_ids_short", "short"), ("token_ids_context", "context")):
    SQL[_name] = VIEW + _tk + f"SELECT doc_id, lineno, {text(ids('t', _layout))} AS ids FROM tk"
SQL["token_ids_split"] = VIEW + _tk + f"SELECT doc_id, lineno, {text(ids(split_names('t')))} AS ids FROM tk"
_n = tx.LAYOUTS["plain"]
_other = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_n[k]}" for k in ("NAME", "OP", "NUMBER", "STRING", "COMMENT")) + f" ELSE {_n['ERROR']} END"
SQL["token_ids_join"] = VIEW + _tk + (
    ", ex AS (SELECT doc_id, lineno, unnest(range(len(t))) AS pos, unnest(t) AS x FROM tk), e2 AS (SELECT doc_id, lineno, pos, x.kind AS kind, x.tok AS tok FROM ex), "
    "vo AS (SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) - 1 AS rank FROM e2 WHERE kind IN ('NAME', 'OP') GROUP BY tok ORDER BY count(*) DESC, tok LIMIT 1000) "
    f"SELECT doc_id, lineno, string_agg(CAST(CASE WHEN kind IN ('NAME', 'OP') AND rank IS NOT NULL THEN rank + {_n['first']} ELSE {_other} END AS VARCHAR), ' ' ORDER BY pos) AS ids FROM e2 LEFT JOIN vo USING (tok) GROUP BY doc_id, lineno"
)
SQL["char_ids"] = VIEW + f", c AS (SELECT doc_id, lineno, {char_ids('content', tx.ALPHABET, 2)} AS i FROM cm) SELECT doc_id, lineno, {text(pad('i', 70))} AS ids FROM c"
SQL["char_ids_sep"] = VIEW + f"SELECT doc_id, lineno, {text(char_ids('content', tx.ALPHABET, 3))} AS ids FROM cm"
SQL["char_ids_200"] = VIEW + f", c AS (SELECT doc_id, lineno, {char_ids('lower(substring(line, 3, greatest(length(line) - 3, 0)))', tx.ALPHABET_200, 2)} AS i FROM cl) SELECT doc_id, lineno, {text(pad('i', 200, truncating='post'))} AS ids FROM c"
_id = _tk + f", id AS (SELECT *, {ids('t')} AS i FROM tk) "
SQL["pad_sequences"] = VIEW + _id + f"SELECT doc_id, lineno, {text(pad('i', 8))} AS post_pre, {text(pad('i', 8, 'pre', 'post'))} AS pre_post FROM id"
SQL["min_length_filter"] = VIEW + _id + f"SELECT doc_id, lineno, {text(pad('i', 30))} AS ids FROM id WHERE len(i) >= 3"
SQL["adjacent_names"] = VIEW + _tk + (
    f", b AS (SELECT doc_id, lineno, list_transform(t, lambda x: x.kind = 'NAME' AND NOT list_contains({array(tx.KEYWORDS)}, x.tok)) AS n FROM tk) SELECT doc_id, lineno, len(list_filter(range(1, len(n)), lambda i: n[i] AND n[i + 1])) > 0 AS prose FROM b"
)


def _text_ids(t: str) -> str:
    return f"flatten(list_transform(string_split({preclean(t)}, chr(10)), lambda z: {ids(lex('z'), 'context')}))"


for _order, _cols in (("bta", ("before", "text", "after")), ("bat", ("before", "after", "text")), ("tba", ("text", "before", "after"))):
    _all = "[1]"
    for _c in _cols:
        _all = f"list_concat(list_concat({_all}, {_text_ids(_c)}), [2])"
    SQL[f"context_features_{_order}"] = LABELLED + _around(1, 1, "chr(10)") + f", f AS (SELECT doc_id, idx, label, {_all} AS i FROM cx) SELECT doc_id, idx, label, {text(pad('i', 90))} AS ids FROM f"
for _order, _cols in (("ct", ("context", "text")), ("tc", ("text", "context"))):
    _all = "[1]"
    for _c in _cols:
        _all = f"list_concat(list_concat({_all}, {'context' if _c == 'context' else _text_ids(_c)}), [2])"
    SQL[f"context_features_{_order}"] = LABELLED + _whole + f", fi AS (SELECT doc_id, {_text_ids('code')} AS context FROM wf), cf AS (SELECT lab.doc_id, idx, label, line AS text, context FROM lab JOIN fi ON fi.doc_id = lab.doc_id), f AS (SELECT doc_id, idx, label, {_all} AS i FROM cf) SELECT doc_id, idx, label, {text(pad('i', 60))} AS ids FROM f"
_named = "CASE i " + " ".join(f"WHEN {v} THEN '<{k}>'" for k, v in _n.items() if k != "first") + f" ELSE {array(tx.KEYWORD_VOCABULARY)}[i - {_n['first']} + 1] END"
SQL["decode_ids"] = VIEW + _id + f"SELECT doc_id, lineno, {text(f'list_transform(list_filter({pad("i", 30)}, lambda z: z > 0), lambda i: {_named})')} AS text FROM id"
SQL["token_length_hist"] = LABELLED + _around(1, 1, "chr(10)") + "SELECT part, length, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS part, len({_text_ids(p)}) AS length FROM cx" for p in ("before", "text", "after")) + ") GROUP BY ALL"


def _vocab(line: str, keep: str, split: bool, limit: int) -> str:
    found = f"list_filter({lex(line)}, lambda t: {keep})"
    found = split_names(found) if split else found
    top = f" ORDER BY cnt DESC, token LIMIT {limit}" if limit >= 0 else ""
    return VIEW + f", t AS (SELECT unnest({found}) AS x FROM cl), c AS (SELECT x.tok AS token, count(*) AS cnt FROM t GROUP BY x.tok{top}) SELECT row_number() OVER (ORDER BY cnt DESC, token) AS rank, token, cnt FROM c"


_both = "t.kind IN ('NAME', 'OP')"
SQL["vocab_split_keyword"] = _vocab("line", _both, True, 500)
SQL["vocab_nosplit"] = _vocab("line", _both, False, 500)
SQL["vocab_only_keyword"] = _vocab("line", f"t.kind = 'OP' OR (t.kind = 'NAME' AND list_contains({array(tx.KEYWORDS)}, t.tok))", False, -1)
SQL["vocab_split_simple"] = _vocab(preclean("line"), _both, True, 500)
SQL["vocab_name_op"] = _vocab("line", _both, False, 1000)
_names = _tk + f", nm AS (SELECT doc_id, x.tok AS token, count(*) AS cnt FROM (SELECT doc_id, unnest(t) AS x FROM tk) WHERE x.kind = 'NAME' AND NOT list_contains({array(tx.KEYWORDS)}, x.tok) GROUP BY ALL) "
SQL["file_identifiers"] = VIEW + _names + "SELECT doc_id, token, cnt FROM nm"
SQL["file_identifiers_top"] = VIEW + _names + "SELECT doc_id, token, cnt FROM nm QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, token) <= 3"
SQL["vocab_gaps"] = "SELECT count(*) AS size, count(DISTINCT token) AS tokens, max(rank) - min(rank) + 1 - count(DISTINCT rank) AS gaps FROM (" + SQL["vocab_name_op"] + ") WHERE regexp_matches(token, '^[A-Za-z]')"

# Detection
_triage = (
    "CASE WHEN length(trim(content, concat('=', chr(39), chr(34)))) <= 1 OR content = 'coding=utf-8' OR (regexp_matches(content, '^[A-Z]') AND ends_with(content, '.')) OR NOT regexp_matches(content, '^[\\x00-\\x7F]*$') THEN 'drop' "
    "WHEN starts_with(content, 'from ') OR starts_with(content, 'import ') OR starts_with(content, 'self.') OR contains(content, ' = ') OR (starts_with(content, '(') AND ends_with(rtrim(content, ','), ')')) OR (starts_with(content, '[') AND ends_with(rtrim(content, ','), ']')) THEN 'candidate' "
    "WHEN starts_with(content, 'if __name__ ==') THEN 'main_guard' ELSE 'undecided' END"
)
_tr = f", tr AS (SELECT *, {_triage} AS rule FROM cm) "
SQL["rule_triage"] = VIEW + _tr + "SELECT file_path, lineno, content, rule FROM tr"
SQL["scan_rules"] = VIEW + _tr + "SELECT file_path, count(*) AS comments, " + ", ".join(f'count(*) FILTER (rule = \'{r}\') AS "{r}"' for r in ("drop", "candidate", "main_guard", "undecided")) + ", count(*) FILTER (rule IN ('candidate', 'main_guard')) AS findings FROM tr GROUP BY file_path"
_tok = "CASE WHEN t.kind IN ('NAME', 'OP') THEN t.tok ELSE concat('<', t.kind, '>') END"


def _bayes(where: str) -> str:
    return (
        f", bt AS (SELECT label, {_tok} AS token FROM (SELECT label, unnest({lex(preclean('line'))}) AS t FROM lab WHERE {where})), bc AS (SELECT token, count(*) FILTER (label = 0) AS code, count(*) FILTER (label = 1) AS doc FROM bt GROUP BY token), "
        "bs AS (SELECT sum(code) AS ac, sum(doc) AS ad, count(*) AS k FROM bc), nb AS (SELECT token, code, doc, ln((doc + 1) / (ad + k)) - ln((code + 1) / (ac + k)) AS odds FROM bc, bs) "
    )


def _score(rows: str, keys: str, line: str) -> str:
    return (
        f", us AS (SELECT {keys}, {_tok} AS token FROM (SELECT {keys}, unnest({lex(preclean(line))}) AS t FROM {rows})), sm AS (SELECT {keys}, sum(odds) AS odds FROM us JOIN nb USING (token) GROUP BY {keys}), "
        f"sc AS (SELECT r.*, round(1 / (1 + exp(-coalesce(odds, 0))), 6) AS score FROM {rows} r LEFT JOIN sm USING ({keys})) "
    )


def _grams(line: str) -> str:
    c = f"list_transform(list_filter(string_split({line}, ''), lambda y: length(y) > 0), lambda y: CAST(unicode(y) AS BIGINT))"
    two, three = "list_transform(range(1, len(c)), lambda i: (c[i] * 131 + c[i + 1] * 31 + 2) % {s})", "list_transform(range(1, len(c) - 1), lambda i: (c[i] * 17161 + c[i + 1] * 131 + c[i + 2] * 31 + 3) % {s})"
    return f"list_transform([{c}], lambda c: list_concat(list_concat(list_transform(c, lambda y: (y * 31 + 1) % {SLOTS}), {two.format(s=SLOTS)}), {three.format(s=SLOTS)}))[1]"


def _char_model(most: int | None = MOST_ROWS) -> str:
    """cw: the weights after all steps, from all training lines or from about `most` of them."""
    bound = "" if most is None else f" AND CAST(concat('0x', substring(md5(concat(key, '-42')), 1, 8)) AS BIGINT) % 10000 < floor(10000 * least(1.0, {most} / (SELECT count(*) FROM lab WHERE split = 'train')))"
    out = (
        f", ct AS MATERIALIZED (SELECT key, CAST(label AS DOUBLE) AS y, {_grams(preclean('line'))} AS s FROM lab WHERE split = 'train'{bound}), "
        f"cg AS MATERIALIZED (SELECT key, any_value(y) AS y, slot, count(*) * {SCALE} / any_value(n) AS x, count(*) AS k FROM (SELECT key, y, len(s) AS n, unnest(s) AS slot FROM ct) GROUP BY key, slot UNION ALL SELECT key, y, {SLOTS}, 1.0, 0 FROM ct WHERE len(s) > 0), "
        f"cs AS (SELECT slot, sum(k * y) AS doc, sum(k * (1 - y)) AS code FROM cg WHERE slot < {SLOTS} GROUP BY slot), "
        f"c0 AS MATERIALIZED (SELECT i AS slot, CASE WHEN i = {SLOTS} THEN 0.0 ELSE ln((coalesce(doc, 0) + 1) / ((SELECT sum(doc) FROM cs) + {SLOTS})) - ln((coalesce(code, 0) + 1) / ((SELECT sum(code) FROM cs) + {SLOTS})) END AS w FROM range({SLOTS} + 1) t(i) LEFT JOIN cs ON cs.slot = i)"
    )
    for k in range(STEPS):
        out += (
            f", e{k} AS (SELECT key, 1 / (1 + exp(-sum(x * w))) - any_value(y) AS e FROM cg JOIN c{k} USING (slot) GROUP BY key), "
            f"c{k + 1} AS MATERIALIZED (SELECT c.slot, any_value(w) - {RATE} * coalesce(sum(e * x), 0) / (SELECT count(*) FROM e{k}) AS w FROM c{k} c LEFT JOIN (SELECT slot, x, e FROM cg JOIN e{k} USING (key)) d ON d.slot = c.slot GROUP BY c.slot)"
        )
    return out + f", cw AS (SELECT list(w ORDER BY slot) AS w FROM c{STEPS})"


def _char_score(line: str) -> str:
    z = f"list_transform([{_grams(preclean(line))}], lambda s: CASE WHEN len(s) > 0 THEN {SCALE} * list_sum(list_transform(s, lambda i: w[i + 1])) / len(s) ELSE 0 END + w[{SLOTS} + 1])[1]"
    return f"round(1 / (1 + exp(-({z}))), 6)"


SQL["char_weights"] = LABELLED + _char_model() + f" SELECT CAST(slot AS INT) AS slot, round(w, 6) AS weight FROM c{STEPS}"
_char_held = f", cd AS (SELECT doc_id, idx, label, {_char_score('line')} AS score FROM lab, cw WHERE split <> 'train') "
SQL["char_score"] = LABELLED + _char_model() + _char_held + "SELECT * FROM cd"


def exact_auc(rows: str, truth: str) -> str:
    """Of all pairs of a true and a false row, how many are in order; a tie counts half."""
    return f"SELECT round(sum(n * (above + p / 2)) / nullif(max(all_p) * max(all_n), 0), 6) AS auc FROM (SELECT *, coalesce(sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(p) OVER () AS all_p, sum(n) OVER () AS all_n FROM (SELECT score, count(*) FILTER ({truth}) AS p, count(*) FILTER (NOT ({truth})) AS n FROM {rows} GROUP BY score))"


SQL["char_auc"] = LABELLED + _char_model(None) + _char_held + exact_auc("cd", "label = 1")
_held = LABELLED + _bayes("split = 'train'") + ", held AS (SELECT * FROM lab WHERE split <> 'train')" + _score("held", "doc_id, idx", "line")
_adjacent = f"len(list_filter(range(1, len(t)), lambda i: t[i].kind = 'NAME' AND t[i + 1].kind = 'NAME' AND NOT list_contains({array(tx.KEYWORDS)}, t[i].tok) AND NOT list_contains({array(tx.KEYWORDS)}, t[i + 1].tok))) > 0"


def _voted(most: int | None = MOST_ROWS) -> str:
    return (
        LABELLED + _tr + _bayes("split = 'train'") + _score("tr", "doc_id, lineno", "content") + _char_model(most)
        + f", v0 AS (SELECT sc.*, {lex('content')} AS t, {_char_score('content')} AS chars FROM sc, cw), v AS (SELECT *, len(t) >= 3 AND NOT ({_adjacent}) AND score <= 0.5 AS by_token, chars <= 0.5 AS by_char, rule IN ('candidate', 'main_guard') AS by_rule FROM v0) "
    )


SQL["model_votes"] = _voted(None) + "SELECT file_path, lineno, score, by_token, by_char FROM v"
SQL["combine_votes_rules"] = _voted() + "SELECT file_path, lineno, content FROM v WHERE by_rule OR (rule <> 'drop' AND by_char)"
SQL["combine_votes_aggressive_rules"] = _voted() + "SELECT file_path, lineno, content FROM v WHERE by_rule OR (rule <> 'drop' AND (by_char OR by_token))"
_one = "{'file_path': file_path, 'lineno': lineno, 'content': content, 'offset': 0, 'length': 0, 'module': '', 'problem_class': {'name': '8_2', 'severity': '', 'inspection_name': '8_2', 'attribute_key': ''}, 'entry_point': {'TYPE': '', 'FQNAME': ''}, 'description': 'Do not use comment lines to make the code invalid.'}"
SQL["findings_json_rules"] = VIEW + _tr + f"SELECT file_path, CAST(to_json({{'problems': list({_one} ORDER BY lineno)}}) AS VARCHAR) AS document FROM tr WHERE rule IN ('candidate', 'main_guard') GROUP BY file_path"
SQL["findings_flat_rules"] = VIEW + _tr + "SELECT file_path, lineno, content FROM tr WHERE rule IN ('candidate', 'main_guard')"


def _multiline(t: str, hard: bool) -> str:
    plain = [r"\\$", r"^\s*\w+\s*=.*[(\[{]$", r"^[()\[\]{}\s]+$"]
    more = [r"[)\]}]:$", r"^[)\]}],$", r"def .+\)[\s]+->[\s]+[a-zA-Z_][a-zA-Z0-9_]*:$", r"with .+ as [a-zA-Z_][a-zA-Z0-9_]*:$", r"for [a-zA-Z_][a-zA-Z0-9_]* in .+:$"]
    return "(" + " OR ".join(f"regexp_matches({t}, {q(p)})" for p in (more + plain if hard else plain)) + ")"


def _bare(line: str) -> str:
    return f"trim(ltrim(ltrim({line}, {chars(tx.BLANKS)}), {chars(rules.HASH_BLANKS)}), {chars(tx.BLANKS)})"


def _stage(hard: bool, need_hash: bool = True) -> str:
    first = f"WHEN NOT starts_with(ltrim(line, {chars(tx.BLANKS)}), '#') THEN 'not_comment' " if need_hash else ""
    heads = "|".join([*rules.BLOCKS, r"if\s+.*"] if hard else rules.BLOCKS)
    sign = " OR ".join(f"contains(b, {q(s)})" for s in rules.INDICATORS)
    partial = r"^\s*[\x22\x27]\w+[\x22\x27]\s*:.+[,{]\s*$"
    return (
        f"CASE {first}WHEN regexp_matches(b, '#[0-9]') THEN 'hash_number' WHEN regexp_matches(b, {q('(?i)' + '|'.join(rules.WHITELIST))}) THEN 'whitelisted' WHEN regexp_matches(b, {q(r'^.*?coding[:=][ ' + chr(92) + 't]*[-_.a-zA-Z0-9]+')}) THEN 'coding' WHEN NOT ({sign}) THEN 'no_indicator' "
        f"WHEN {_multiline('b', hard)} THEN 'multiline' WHEN regexp_matches(b, {q(r'^\s*(' + heads + r')\s*:\s*$')}) THEN 'block' WHEN regexp_matches(regexp_replace(b, {q(r'^(print|return)\b\s*')}, ''), {q(partial)}) THEN 'partial_dict' ELSE 'needs_compile' END"
    )


_bl = f", bl AS (SELECT *, {_bare('line')} AS b FROM cl) "
SQL["era_stage"] = VIEW + _bl + f"SELECT doc_id, lineno, {_stage(True)} AS stage FROM bl"
SQL["era_stage_mild"] = VIEW + _bl + f"SELECT doc_id, lineno, {_stage(False)} AS stage FROM bl"
SQL["era_stage_no_sharp"] = VIEW + f", bl AS (SELECT *, {_bare(chr(108) + 'trim(line, ' + q(' #') + ')')} AS b FROM cl) SELECT doc_id, lineno, {_stage(True, False)} AS stage FROM bl"
_bm = f", bm AS (SELECT *, {_bare('line')} AS b FROM cm) "
SQL["era_multiline"] = VIEW + _bm + f"SELECT doc_id, lineno, {_multiline('b', True)} AS hard, {_multiline('b', False)} AS mild FROM bm"
SQL["era_whitelist"] = VIEW + _bm + f"SELECT doc_id, lineno, regexp_matches(b, {q('(?i)' + '|'.join((*rules.WHITELIST, 'return')))}) AS extended, regexp_matches(b, '(?i)import') AS replaced FROM bm"
_code = "('multiline', 'block', 'partial_dict')"

# Comment tokens: what a line does from each state in which it can begin, then line by line
_BLANK = "[ \\t\\x0c]"


def _does(rest: str) -> str:
    marks = f"regexp_extract_all({rest}, {q(MARKS)})"
    state = "CASE " + " ".join(f"WHEN starts_with(z, {q(k)}) THEN CASE WHEN regexp_matches(z, {q(chr(94) + k + p + '$')}) THEN 'c' ELSE {q(LETTERS[k])} END" for k, p in INSIDE.items()) + " ELSE 'c' END"
    told = f"list_transform([coalesce(m[-1], '')], lambda z: {{'depth': len(list_filter(m, lambda y: y IN ('(', '[', '{{'))) - len(list_filter(m, lambda y: y IN (')', ']', '}}'))), 'state': {state}, 'goes_on': starts_with(z, chr(92)), 'comment': starts_with(z, '#')}})[1]"
    return f"list_transform([{marks}], lambda m: {told})[1]"


def _in_string(quotes: str) -> str:
    letter = q(LETTERS[quotes])
    stays = letter if len(quotes) == 3 else f"CASE WHEN regexp_matches(line, {q(BACKSLASH)}) THEN {letter} ELSE 'c' END"
    head = f"regexp_extract(line, {q(chr(94) + INSIDE[quotes])}, 0)"
    return f"CASE WHEN length({head}) > 0 THEN {_does(f'substring(line, length({head}) + 1)')} ELSE {{'depth': 0, 'state': {stays}, 'goes_on': false, 'comment': false}} END"


_indent = f"regexp_extract(line, '^{_BLANK}*', 0)"
_tokens = (
    f", ln AS MATERIALIZED (SELECT doc_id, file_path, lineno, line, {_does('line')} AS c, " + ", ".join(f"{_in_string(k)} AS {v}" for k, v in LETTERS.items())
    + f", starts_with(ltrim(line, {chars(tx.BLANKS)}), '#') AS hash, NOT regexp_matches(line, '^{_BLANK}*(#|\r?$)') AS begins, "
    + f"list_reduce(list_prepend(0, list_transform(list_filter(string_split({_indent}, ''), lambda y: y <> ''), lambda y: ascii(y))), lambda w, y: CASE y WHEN 9 THEN (w // 8 + 1) * 8 WHEN 32 THEN w + 1 ELSE 0 END) AS col FROM cl), "
    + "at0 AS (SELECT doc_id, CAST(1 AS BIGINT) AS lineno, 'c' AS state, CAST(0 AS BIGINT) AS depth, false AS goes_on, [CAST(0 AS BIGINT)] AS indents, false AS over, false AS flag, '' AS prev FROM (SELECT DISTINCT doc_id FROM cl)), "
    + "au AS (SELECT * FROM at0 UNION ALL SELECT doc_id, lineno + 1, e.state, depth + e.depth, e.goes_on, CASE WHEN NOT st THEN indents WHEN deeper THEN list_append(indents, col) ELSE list_filter(indents, lambda i: i <= col) END, "
    + "over OR (st AND NOT deeper AND NOT list_contains(indents, col)), NOT (over OR (st AND NOT deeper AND NOT list_contains(indents, col))) AND hash AND (state = 'c' OR e.comment), line FROM "
    + "(SELECT au.*, ln.line, hash, CAST(col AS BIGINT) AS col, CASE au.state WHEN 'c' THEN c WHEN 't' THEN t WHEN 'u' THEN u WHEN 's' THEN s ELSE d END AS e, au.state = 'c' AND au.depth = 0 AND NOT au.goes_on AND begins AS st, CAST(col AS BIGINT) > au.indents[-1] AS deeper FROM au JOIN ln ON ln.doc_id = au.doc_id AND ln.lineno = au.lineno)), "
    + f"fg AS (SELECT doc_id, lineno - 1 AS lineno, prev AS line, flag, lag(prev, 1, '') OVER (PARTITION BY doc_id ORDER BY lineno) AS before FROM au WHERE lineno > 1), mk AS (SELECT *, flag AND {_stage(True)} IN {_code} AS marked FROM (SELECT *, {_bare('line')} AS b FROM fg)), "
    + f"rm AS (SELECT *, marked AND NOT ends_with(rtrim(before, {chars(tx.BLANKS)}), chr(92)) AS gone FROM mk)"
)
SQL["era_line_numbers_rules"] = VIEW + _tokens + " SELECT doc_id, lineno FROM rm WHERE marked"
SQL["era_filtered_rules"] = VIEW + _tokens + " SELECT doc_id, lineno, line FROM rm WHERE NOT gone"
SQL["era_identified_rules"] = VIEW + _tokens + " SELECT doc_id, lineno, line FROM rm WHERE gone"


def _span(start: str, length: str) -> str:
    return f"CASE WHEN {length} = 1 THEN CAST({start} AS VARCHAR) ELSE concat(CASE WHEN {length} = 0 THEN {start} - 1 ELSE {start} END, ',', {length}) END"


SQL["era_changes_rules"] = VIEW + _tokens + (
    ", g AS (SELECT doc_id, lineno, row_number() OVER w - 1 AS nth, coalesce(lineno - lag(lineno) OVER w > 7, true) AS head FROM rm WHERE gone WINDOW w AS (PARTITION BY doc_id ORDER BY lineno)), "
    "h AS (SELECT doc_id, lineno, nth, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lineno) AS hunk FROM g), "
    "sz AS (SELECT doc_id, max(lineno) AS n FROM rm GROUP BY doc_id), r AS (SELECT doc_id, hunk, greatest(min(lineno) - 3, 1) AS a, least(max(lineno) + 3, any_value(n)) AS b, min(nth) AS before, count(*) AS k FROM h JOIN sz USING (doc_id) GROUP BY ALL), "
    "hk AS (SELECT r.doc_id, hunk, string_agg(concat(CASE WHEN gone THEN '-' ELSE ' ' END, line), chr(10) ORDER BY lineno) AS body, any_value(r.a) AS a, any_value(r.b - r.a + 1) AS len, any_value(r.a - r.before) AS a2, any_value(r.b - r.a + 1 - k) AS len2 FROM r JOIN rm ON rm.doc_id = r.doc_id AND lineno BETWEEN r.a AND r.b GROUP BY ALL), "
    f"df AS (SELECT doc_id, string_agg(concat('@@ -', {_span('a', 'len')}, ' +', {_span('a2', 'len2')}, ' @@', chr(10), body), chr(10) ORDER BY hunk) AS diff FROM hk GROUP BY doc_id), "
    "ft AS (SELECT doc_id, any_value(file_path) AS file_path FROM cl GROUP BY doc_id), "
    "s AS (SELECT doc_id, bool_or(gone) AS changed, count(*) FILTER (gone) AS removed, md5(coalesce(string_agg(line, chr(10) ORDER BY lineno) FILTER (NOT gone), '')) AS text_md5 FROM rm GROUP BY doc_id) "
    "SELECT s.*, CASE WHEN diff IS NULL THEN '' ELSE concat('--- before/', file_path, chr(10), '+++ after/', file_path, chr(10), diff) END AS diff FROM s JOIN ft USING (doc_id) LEFT JOIN df USING (doc_id)"
)

# Samples and training
_bucket = "CAST(concat('0x', substring(md5(concat(CAST(doc_id AS VARCHAR), '-42')), 1, 8)) AS BIGINT) % 10000"
SQL["sample_frac"] = f"SELECT doc_id FROM documents WHERE {_bucket} < 2000"
SQL["sample_n"] = f"SELECT doc_id FROM documents ORDER BY {md5_order('CAST(doc_id AS VARCHAR)')}, doc_id LIMIT 100"
SQL["resampled_accuracy"] = (
    "WITH c AS (SELECT l.*, d.draw FROM labels l, range(1, 11) d(draw)), r AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '-', CAST(draw AS VARCHAR))), doc_id) AS place FROM c) "
    "SELECT CAST(draw AS INT) AS draw, round(avg(CASE WHEN (quality = 1) = (toxic = 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r WHERE place <= 100 GROUP BY draw"
)
_pl = f", pl AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {md5_order('key')}, key) AS place, count(*) OVER (PARTITION BY label) AS n FROM lab), mn AS (SELECT min(n) AS most FROM pl) "
SQL["balance_min"] = LABELLED + _pl + "SELECT doc_id, idx, label FROM pl, mn WHERE place <= most"
SQL["balance_code_to_doc"] = LABELLED + _pl + "SELECT doc_id, idx, 1 - label AS label FROM pl WHERE label = 0 OR place <= (SELECT count(*) FROM lab WHERE label = 0)"
SQL["class_weights"] = LABELLED + ", c AS (SELECT label, count(*) AS n FROM lab GROUP BY label) SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c"
SQL["stratified_split"] = LABELLED + _pl + "SELECT doc_id, idx, label, CASE WHEN place <= floor(n * 0.33) THEN 'test' ELSE 'train' END AS part FROM pl"
SQL["label_share"] = LABELLED + "SELECT label, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM lab GROUP BY label"
SQL["label_split"] = LABELLED + "SELECT doc_id, idx, line AS data, label FROM lab ORDER BY doc_id, idx LIMIT 10000"
SQL["split_sizes"] = VIEW + ", c AS (SELECT doc_id, any_value(split) AS split, count(*) AS n FROM cl GROUP BY doc_id) SELECT split, count(*) AS files, CAST(sum(n) AS BIGINT) AS lines, round(avg(n), 4) AS mean_lines FROM c GROUP BY split"
SQL["nb_train"] = LABELLED + _bayes("split = 'train'") + "SELECT token, code, doc, round(odds, 6) AS odds FROM nb"
SQL["nb_score"] = _held + "SELECT doc_id, idx, label, score FROM sc"
SQL["nb_increment"] = LABELLED + _bayes("split IN ('train', 'valid')") + "SELECT token, code, doc, round(odds, 6) AS odds FROM nb"


# Evaluation
def _rates(truth: str, said: str, rows: str, group: str = "", tail: str = "", more: str = "") -> str:
    counts = f"count(*) FILTER (({truth}) AND ({said})) AS tp, count(*) FILTER (NOT ({truth}) AND ({said})) AS fp, count(*) FILTER (({truth}) AND NOT ({said})) AS fn, count(*) FILTER (NOT ({truth}) AND NOT ({said})) AS tn"
    d = lambda a, b: f"round(({a}) / nullif({b}, 0), 6)"
    return f"SELECT *, {d('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {d('tp', 'tp + fp')} AS precision, {d('tp', 'tp + fn')} AS recall, {d('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (SELECT {more}{group}{counts} FROM {rows} {tail})"


SQL["binary_metrics"] = _rates("quality = 1", "toxic = 0", "labels")
SQL["nb_metrics"] = _held + _rates("label = 1", "score > 0.5", "sc", "split, ", "GROUP BY split")
SQL["auc_rounded"] = f"SELECT round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS auc FROM ({_rates('quality = 1', 'toxic = 0', 'labels')})"
_vs = "WITH vs AS (SELECT label >= 5 AS truth, (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS score FROM embeddings), bn AS (SELECT floor(score * 10000) / 10000 AS threshold, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM vs GROUP BY 1), cv AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY threshold DESC) / sum(n) OVER () AS fpr FROM bn) "
SQL["roc_curve"] = _vs + "SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM cv"
SQL["roc_auc"] = _vs + "SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM (SELECT tpr, fpr, coalesce(lag(tpr) OVER (ORDER BY threshold DESC), 0) AS t0, coalesce(lag(fpr) OVER (ORDER BY threshold DESC), 0) AS f0 FROM cv)"
SQL["threshold_sweep"] = _vs + _rates("truth", "score > threshold", "vs, (SELECT unnest([" + ", ".join(f"CAST({t} AS DOUBLE)" for t in THRESHOLDS) + "]) AS threshold)", "threshold, ", "GROUP BY threshold")
SQL["metrics_by_language"] = _held + _rates("label = 1", "score > 0.6", "sc", "lang, ", "GROUP BY ROLLUP (lang)")
SQL["language_share"] = VIEW + "SELECT lang, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM cl GROUP BY lang"
SQL["code_share_by_language"] = LABELLED + "SELECT lang, label, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 2) AS percent FROM lab GROUP BY lang, label"
SQL["confirmed_comments"] = _held + "SELECT doc_id, idx, line, label, score FROM sc WHERE (label = 1 AND score > 0.6) OR (label = 0 AND score <= 0.6)"
SQL["suspect_comments"] = _held + "SELECT doc_id, idx, line, score FROM sc WHERE label = 0 AND score > 0.6"
SQL["detector_compare"] = VIEW + f", dc AS (SELECT {_triage} IN ('candidate', 'main_guard') AS by_triage, {_stage(True)} IN {_code} AS by_era FROM (SELECT *, {_bare('line')} AS b FROM cm)) SELECT by_triage, by_era, count(*) AS n FROM dc GROUP BY CUBE (by_triage, by_era)"
SQL["roc_exact"] = _vs.split(", bn AS")[0] + ", c AS (SELECT score, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM vs GROUP BY score) SELECT score, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr FROM c WINDOW w AS (ORDER BY score DESC)"
SQL["auc_exact"] = _vs.split(", bn AS")[0] + " " + exact_auc("vs", "truth")
SQL["token_length_percentiles"] = (
    f"WITH h AS ({SQL['token_length_hist']}), u AS (SELECT *, sum(n) OVER (PARTITION BY part ORDER BY length) AS upto, sum(n) OVER (PARTITION BY part) AS total FROM h) "
    "SELECT part, share, min(length) FILTER (upto >= ceil(total * share)) AS length FROM u, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE, 1.0::DOUBLE]) AS share) GROUP BY ALL"
)
SQL["interleave_classes"] = LABELLED + (
    f", pl AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {md5_order('key')}, key) - 1 AS place, count(*) OVER (PARTITION BY label) AS n, dense_rank() OVER (ORDER BY label) - 1 AS turn FROM lab WHERE split = 'train'), "
    "m AS (SELECT max(n) AS most, count(DISTINCT label) AS k FROM pl) SELECT r * k + turn AS position, doc_id, idx, label FROM (SELECT pl.*, k, unnest(range(place, most, n)) AS r FROM pl, m)"
)
_eight = "count(*) FILTER (t AND {x}) AS tp, count(*) FILTER (NOT t AND {x}) AS fp, count(*) FILTER (t AND NOT {x}) AS fn, count(*) FILTER (NOT t AND NOT {x}) AS tn, count(*) FILTER ({x} = t AND {y} <> t) AS n_only_right, count(*) FILTER (a = t AND b = t) AS n_both_right, round(pow(greatest(abs(count(*) FILTER (a = t AND b <> t) - count(*) FILTER (b = t AND a <> t)) - 1, 0), 2) / nullif(count(*) FILTER ((a = t) <> (b = t)), 0), 6) AS chi_squared"
_bare_era = _bare(f"ltrim(line, {q(' #')})")
_lines_triage = _triage.replace("content", "line")
_dm = f", dm AS (SELECT label = 0 AS t, {_stage(True, False)} IN {_code} AS a, rule IN ('candidate', 'main_guard') OR (rule = 'undecided' AND score <= 0.5) AS b FROM (SELECT lab.label, line, {_bare_era} AS b, {_lines_triage} AS rule, {_char_score('line')} AS score FROM lab, cw WHERE split <> 'train')) "
_rate = "round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"
SQL["detector_metrics"] = LABELLED + _char_model() + _dm + " UNION ALL ".join(f"SELECT *, {_rate} FROM (SELECT '{name}' AS detector, {_eight.format(x=x, y=y)} FROM dm)" for name, x, y in (("removal", "a", "b"), ("votes", "b", "a")))

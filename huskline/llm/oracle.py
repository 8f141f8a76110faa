"""Queries of this subpackage as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from . import chat, hosts, manifest, neardup

SQL: dict[str, str] = {}


def _lower(x: str) -> str:
    return f"translate({x}, '{ascii_uppercase}', '{ascii_lowercase}')"


# Host reputation
_after = "CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END"
_rule = "NULL"
for _r in sorted(hosts.RULES, key=lambda r: len(r.rule)):
    _rule = f"CASE WHEN (host = '{_r.host}' OR ends_with(host, '.{_r.host}')) AND starts_with(path, '{_r.path}') THEN '{_r.rule}' ELSE {_rule} END"
_verdicts = " ".join(f"WHEN rule = '{r.rule}' THEN '{r.verdict}'" for r in hosts.RULES)
_long = ", ".join(f"'{s}'" for s in hosts.LONG_SUFFIXES)


def _strength(table: str) -> str:
    return (
        f"(SELECT CASE WHEN count(*) < 2 OR coalesce(sum(n) - sum(n * n) / sum(n), 0) <= 0 OR any_value(mean) * (1 - any_value(mean)) <= 0 THEN 10.0 WHEN sum(n * pow(bad / n - mean, 2)) - (count(*) - 1) * any_value(mean) * (1 - any_value(mean)) > 0 "
        f"THEN least(1000.0, greatest(1.0, any_value(mean) * (1 - any_value(mean)) / ((sum(n * pow(bad / n - mean, 2)) - (count(*) - 1) * any_value(mean) * (1 - any_value(mean))) / (sum(n) - sum(n * n) / sum(n))) - 1)) ELSE 1000.0 END FROM {table}, mu WHERE n > 0)"
    )


SQL["op2_hosts"] = f"""WITH u AS (SELECT page_id, {_lower(f"regexp_extract({_after}, '^[^/?#]*', 0)")} AS host, regexp_extract({_after}, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM u LEFT JOIN o ON o.doc_id = u.page_id GROUP BY host),
h1 AS (SELECT *, string_split(host, '.') AS p FROM h0),
h2 AS (SELECT host, n, bad, array_to_string(p[greatest(len(p) - 1, 1):], '.') AS two, array_to_string(p[greatest(len(p) - 2, 1):], '.') AS three, p[len(p)] AS one FROM h1),
h AS (SELECT host, n, bad, CASE WHEN two IN ({_long}) THEN three ELSE two END AS domain, CASE WHEN two IN ({_long}) THEN two ELSE one END AS suffix FROM h2),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
mu AS (SELECT (sum(bad) + 0.5) / (sum(n) + 10.0) AS mean FROM s), k AS (SELECT {_strength("s")} AS ks, {_strength("d")} AS kd, {_strength("h")} AS kh),
s2 AS (SELECT suffix, (bad + mean * ks) / (n + ks) AS m FROM s, mu, k), d2 AS (SELECT domain, (bad + m * kd) / (n + kd) AS m FROM d JOIN s2 USING (suffix), k),
r AS (SELECT host, (bad + m * kh) / (n + kh) AS share, n + kh + 1 AS w FROM h JOIN d2 USING (domain), k),
j AS (SELECT page_id, u.host, path, {_rule.replace("host", "u.host")} AS rule, share, share - {hosts.BOUND} * sqrt(share * (1 - share) / w) AS low, mean FROM u JOIN r ON r.host = u.host, mu)
SELECT page_id, host, path, rule, CASE {_verdicts} WHEN low > {hosts.MAX_BAD} * mean THEN 'block' ELSE 'allow' END AS verdict, round(share, 6) AS bad_share, round(low, 6) AS bad_share_low FROM j"""

# Conversations
_said = "</s>[INST] ok [/INST]"


def _escaped(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"


_order = "ORDER BY turn, role, text"
SQL["op3_chat"] = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_said}'), (-1, 1, 'assistant', '{_said}')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' {_order})) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = '{chat.LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' {_order}) FILTER (role = '{chat.LOSS_ROLE}'), '')) AS loss_sha256, CAST(sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat.OPEN + chat.MIDDLE + chat.CLOSE)}) AS BIGINT) AS formatted_chars, 1 AS branch FROM c GROUP BY conv_id"""

# Components: links, then what they reach
_reach = "reach AS (SELECT x, y FROM ln UNION SELECT r.x, l.y FROM reach r JOIN ln l ON l.x = r.y)"
SQL["op5_jaccard"] = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
nn AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
ln AS (SELECT x, y FROM pr JOIN nn p ON p.doc_id = x JOIN nn q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)), {_reach}
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id FROM w LEFT JOIN nn USING (doc_id) LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) g ON g.x = w.doc_id"""
SQL["op10_neardup"] = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS r FROM v),
ln AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a, u b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.r * b.r) >= {neardup.COSINE}), {_reach}
SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept FROM u LEFT JOIN (SELECT x, count(*) AS k FROM ln GROUP BY x) a ON a.x = vec_id LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) g ON g.x = vec_id"""

# Merkle manifest: nodes level by level, then each leaf's steps to the root
_fan = manifest.FANOUT


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _above(nodes: str, keys: str) -> str:
    return f"SELECT {keys}lvl + 1, idx // {_fan}, (any_value(n) + {_fan - 1}) // {_fan}, sha256(string_agg(h, '' ORDER BY idx)) FROM {nodes} WHERE n > 1 GROUP BY {keys}lvl, idx // {_fan}"


def _beside(nodes: str, keys: str, same: str) -> str:
    side = "coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx {} a.idx), '')"
    return f"SELECT {keys}a.lvl, a.idx, {side.format('<')} AS lt, {side.format('>')} AS rt FROM {nodes} a JOIN {nodes} b ON {same}a.lvl = b.lvl AND a.idx // {_fan} = b.idx // {_fan} WHERE a.n > 1 GROUP BY ALL"


_crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295::BIGINT)"
SQL["op13_manifest"] = f"""WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda a, i: xor(a >> 1, 3988292384::BIGINT * (a & 1)))) AS t),
d AS (SELECT doc_id, lang, coalesce(concat('=', lang), '') AS tree, {_leaf("text")} AS leaf, CASE WHEN {_crc} % {manifest.TAMPERED} = 0 THEN {_leaf(_lower("text"))} ELSE {_leaf("text")} END AS start FROM documents, tb),
l AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
nd AS (SELECT tree, 0::BIGINT AS lvl, idx, n, leaf AS h FROM l UNION ALL {_above("nd", "tree, ")}),
sub AS (SELECT tree, 0::BIGINT AS lvl, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, h FROM nd WHERE n = 1),
rt AS (SELECT lvl, idx, n, h FROM sub UNION ALL {_above("rt", "")}),
sb AS ({_beside("nd", "a.tree, ", "a.tree = b.tree AND ")}), rs AS ({_beside("rt", "", "")}),
st AS (SELECT rid, 0 AS part, sb.lvl, lt, rt FROM l JOIN sb ON sb.tree = l.tree AND sb.idx = l.idx // CAST(pow({_fan}, sb.lvl) AS BIGINT) UNION ALL SELECT rid, 1, rs.lvl, lt, rt FROM l JOIN sub ON sub.tree = l.tree JOIN rs ON rs.idx = sub.idx // CAST(pow({_fan}, rs.lvl) AS BIGINT)),
pf AS (SELECT rid, string_agg(concat(lt, rt), '' ORDER BY part, lvl) AS proof, list(concat(lt, ',', rt) ORDER BY part, lvl) AS steps FROM st GROUP BY rid),
f AS (SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM rt WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, list_reduce(list_prepend(start, coalesce(steps, [])), lambda a, s: sha256(concat(split_part(s, ',', 1), a, split_part(s, ',', 2)))) AS folded_root FROM l JOIN sub ON sub.tree = l.tree LEFT JOIN pf USING (rid))
SELECT *, folded_root = root AS verified FROM f"""

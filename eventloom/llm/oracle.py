"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat import END, PROBE, START
from .quality import _CASED, COMMON
from .urlfilter import BLOCKED_SITES, RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_values = lambda rows: ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows)

OP1 = f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rule) AS (VALUES {_values(RULES)}),
split AS (SELECT verdict, rule, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM rules),
blocked(site) AS (VALUES {_values([(s,) for s in BLOCKED_SITES])}),
found AS (
  SELECT p.page_id, arg_max(struct_pack(v := s.verdict, r := s.rule), length(s.rule)) AS m
  FROM parts p JOIN split s ON (p.host = s.rhost OR ends_with(p.host, '.' || s.rhost)) AND starts_with(p.path, s.rpath)
  GROUP BY p.page_id),
bad AS (SELECT DISTINCT p.host FROM parts p JOIN blocked b ON p.host = b.site OR ends_with(p.host, '.' || b.site))
SELECT p.page_id, p.host, p.path, f.m.r AS rule,
       CASE WHEN f.m IS NOT NULL THEN f.m.v WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN found f ON p.page_id = f.page_id LEFT JOIN bad ON p.host = bad.host
"""

_CONTAM_WORDS = f"[x FOR x IN string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF x <> '']"

OP5 = f"""
WITH d AS (SELECT doc_id, {_CONTAM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_CONTAM_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, w[s:s + 9] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (
  SELECT doc_id, s, n, w[s:s + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_WORDS = "[x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> '']"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM win SEMI JOIN again USING (h)),
lists AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_LIST = lambda xs: "[" + ", ".join(repr(x) for x in xs) + "]"
_SIDE = lambda c, q: f"(CASE WHEN {c} > 0 THEN {c} * log2(2 * {c} / ({c} + {q})) ELSE 0.0 END)"
_JS = f"sqrt(greatest(0, sum({_SIDE('h.p', 'q.p')} + {_SIDE('q.p', 'h.p')}) / 2))"
_DISTANCES = lambda k: f"""
h{k} AS (SELECT r, lang, i, v / sum(v) OVER (PARTITION BY r) AS p FROM k{k} WHERE n >= 40),
s{k} AS (SELECT lang, i, sum(v) AS v FROM k{k} WHERE lang IS NOT NULL GROUP BY lang, i),
f{k} AS (SELECT lang, i, v / sum(v) OVER (PARTITION BY lang) AS p FROM s{k}),
g{k} AS (SELECT r, i, (s.v - k.v) / sum(s.v - k.v) OVER (PARTITION BY r) AS p FROM k{k} k JOIN s{k} s USING (lang, i) WHERE r IN (SELECT r FROM own)),
own{k} AS (SELECT h.r, {_JS} AS d FROM h{k} h JOIN g{k} q ON q.r = h.r AND q.i = h.i GROUP BY h.r),
all{k} AS (SELECT r, min(d) AS d FROM (SELECT h.r, {_JS} AS d FROM h{k} h JOIN f{k} q ON q.i = h.i AND q.lang IS DISTINCT FROM h.lang GROUP BY h.r, q.lang) GROUP BY r)"""  # noqa: E731
_NEAR = lambda c, w: f"{c} <= 0.3 AND {w} <= 0.45 AND (NOT has_own OR {w} <= 0.1 + 1.22 / sqrt(n))"

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
b AS (SELECT r, doc_id, lang, t, w, regexp_replace(t, '[a-z\\x20\\t-\\r\\p{{Ll}}\\p{{Lo}}]+', '', 'g') AS rest, CAST(length(array_to_string(w, '')) AS BIGINT) AS chars,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
five AS (SELECT r, s, md5(array_to_string(w[s:s + 4], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS s FROM b WHERE len(w) >= 5)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + 5)) AS p FROM five SEMI JOIN (SELECT r, h FROM five GROUP BY r, h HAVING count(*) > 1) USING (r, h)) GROUP BY r),
c AS (SELECT r, doc_id, lang, len(w) AS n, chars, len(regexp_extract_all(rest, '[#*$%&|<>]')) AS sym, len(lines) - len(list_distinct(lines)) AS dup,
  [chars - length(rest), len(regexp_extract_all(rest, '\\p{{Lu}}')), len(regexp_extract_all(rest, '[0-9]')), len(regexp_extract_all(rest, '[.,;:!?]')), sym, length(t) - chars] AS k, length(rest) AS rest_n,
  [lower(x) FOR x IN w IF list_contains({_LIST(_CASED)}, x)] AS hits FROM b),
e AS (SELECT *, list_append(k, rest_n - k[2] - k[3] - k[4] - k[5]) AS classes, list_append([len([x FOR x IN hits IF x = y]) FOR y IN {_LIST(COMMON)}], n - len(hits)) AS common FROM c),
k1 AS (SELECT r, lang, n, unnest(classes)::DOUBLE AS v, unnest(range(1, 8)) AS i FROM e),
k2 AS (SELECT r, lang, n, unnest(common)::DOUBLE AS v, unnest(range(1, {len(COMMON) + 2})) AS i FROM e),
own AS (SELECT r FROM k2 k JOIN (SELECT lang, sum(v) AS v FROM k2 GROUP BY lang) s USING (lang) GROUP BY r, s.v HAVING s.v - sum(k.v) >= 40),{_DISTANCES(1)},{_DISTANCES(2)},
o AS (SELECT e.*, coalesce(rep.n, 0) AS again, e.n < 10 OR 100 * coalesce(rep.n, 0) > 20 * e.n AS failed, own.r IS NOT NULL AS has_own, own1.d AS o1, own2.d AS o2, all1.d AS a1, all2.d AS a2
  FROM e LEFT JOIN rep ON rep.r = e.r LEFT JOIN own ON own.r = e.r LEFT JOIN own1 ON own1.r = e.r LEFT JOIN own2 ON own2.r = e.r LEFT JOIN all1 ON all1.r = e.r LEFT JOIN all2 ON all2.r = e.r),
z AS (SELECT *, CASE WHEN {_NEAR('o1', 'o2')} THEN o1 ELSE least(o1, a1) END AS d1, CASE WHEN {_NEAR('o1', 'o2')} THEN o2 ELSE least(o2, a2) END AS d2 FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, chars AS word_chars, CAST(sym AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(again AS BIGINT) AS n_repeat_words,
  failed AS base_failed, NOT failed AND coalesce({_NEAR('d1', 'd2')}, true) AS kept, round(d1, 6) AS class_distance, round(d2, 6) AS word_distance
FROM z
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM m JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
g(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, g.root FROM g JOIN e ON e.a = g.id)
SELECT d.doc_id, CAST(coalesce(any_value(z.n), 0) AS BIGINT) AS n_shingles, min(g.root) AS component_id
FROM d LEFT JOIN z USING (doc_id) JOIN g ON g.id = d.doc_id GROUP BY d.doc_id
"""

_CRC_TABLE = [0] * 256
for _i in range(256):
    _x = _i
    for _ in range(8):
        _x = _x >> 1 ^ (0xEDB88320 if _x & 1 else 0)
    _CRC_TABLE[_i] = _x


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text expression's UTF-8 bytes, for DuckDB."""
    octets = f"[('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT FOR i IN range(1, strlen({text}) + 1)]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, {_CRC_TABLE}[(xor(a, b) & 255) + 1])), 4294967295)"


OP11 = f"""
WITH t AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, dig) AS p, dig, b
  FROM (SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig, strlen(coalesce(text, '')) AS b
        FROM conversations WHERE conv_id IS NOT NULL)),
lens AS (SELECT c, count(*) AS n, c - c % 5 AS base, {crc32('CAST(c AS VARCHAR)')} % 9 AS h FROM t GROUP BY c),
k AS (SELECT x.c, x.base, x.h, least(x.h, coalesce(y.n, 0)) AS k FROM lens x LEFT JOIN lens y ON y.c = x.base),
r AS (
  SELECT k.c, p AS d, dig, b FROM k JOIN t ON t.c = k.base AND p <= k.h
  UNION ALL SELECT k.c, k.k + p - k.h, dig, b FROM k JOIN t ON t.c = k.c AND p > k.h),
l AS (SELECT k.c, coalesce(ds, []) AS ds, coalesce(bs, []) AS bs FROM k LEFT JOIN (SELECT c, list(dig ORDER BY d) AS ds, list(b ORDER BY d) AS bs FROM r GROUP BY c) USING (c)),
m AS (SELECT c, d, len(ds) AS n, sha256(array_to_string(ds[1:d], ',')) AS node, sha256(array_to_string(ds[1:d - 1], ',')) AS up, coalesce(bs[d], 0) AS b FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS d FROM l)),
nodes AS (
  SELECT node, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ids
  FROM m GROUP BY node, d),
kids AS (SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node, d)),
under AS (
  SELECT m.node, m.d, sum((x.n_convs - 1) * x.b) AS saved, count(*) FILTER (x.n_children = 0) AS leaves
  FROM full_nodes x JOIN m ON m.c = x.conv_id AND m.d <= x.d GROUP BY m.node, m.d)
SELECT x.conv_id, x.d AS depth, CASE WHEN x.d > 0 THEN y.conv_id END AS parent_conv_id, x.n_convs, x.n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ids) AS ends_sha256
FROM full_nodes x JOIN under USING (node, d) LEFT JOIN nodes y ON y.node = x.up AND y.d = x.d - 1
"""

OP12 = f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(r, '{_UP}', '{_LOW}') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)),
c AS (SELECT doc_id, w, count(*) AS n, {crc32("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)")} AS h FROM runs GROUP BY doc_id, w),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS l FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)),
ins AS (SELECT DISTINCT x.word AS a, v.word AS b FROM x JOIN v ON v.word = x.l),
near AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.l = b.l AND a.word <> b.word UNION SELECT a, b FROM ins UNION SELECT b, a FROM ins),
best AS (
  SELECT a, b, n, n_near FROM (
    SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM near JOIN v ON v.word = near.b) WHERE k = 1),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * v.n THEN b END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n
  FROM v LEFT JOIN best ON best.a = v.word),
chain(word, last) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.last AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain ON chain.word = f.word JOIN f g ON g.word = chain.last WHERE g.form IS NULL
"""

_GROWN = lambda c: f"length(regexp_replace({c}, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))"

OP13 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(START) + 1 + len(END)} + {_GROWN("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")} + {_GROWN('text')}) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


def sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op2_substring_dedup": OP2, "op5_decontamination": OP5, "op6_quality": OP6, "op10_jaccard_join": OP10, "op11_prefix_trie": OP11, "op12_spelling_variants": OP12, "op13_chat_format": OP13}

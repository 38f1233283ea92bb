"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM documents)"
_PLAIN = _WORDS.format(text="coalesce(text, '')")
_LOWER = _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

#: The CRC-32 of an ASCII string, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii({s}[i])::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT)"""


def _edit(state: int, cost: str, letter: str, text: str) -> str:
    """An edit of row r before the best of what follows it in a state: cost and audit as one string that sorts, and the lines."""
    return f"{{'k': lpad((left(p.f[{state}].k, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr(p.f[{state}].k, 10), 't': {text} || p.f[{state}].t}}"


def _inserted(f: str) -> str:
    """The best of each state, be it an insertion before the best of the next state."""
    after = ((3, "user"), (3, "user"), (4, "assistant"), (3, "user"))
    put = lambda q, role: f"{{'k': lpad((left({f}[{q}].k, 9)::BIGINT + 5)::VARCHAR, 9, '0') || 'I' || substr({f}[{q}].k, 10), 't': '{role}:' || chr(10) || {f}[{q}].t}}"
    return "[" + ", ".join(f"list_sort([{f}[{i}], {put(q, role)}])[1]" for i, (q, role) in enumerate(after, 1)) + "]"


def _edited() -> str:
    """The best of each state (start, after system, after user, after assistant) before row r, without insertions before it."""
    out, cut, line = [], "(CASE WHEN r.cut THEN 5 ELSE 0 END)", "r.role || ':' || r.text || chr(10)"
    for i, (q, role, keeps) in enumerate(((3, "user", {"s": 2, "u": 3}), (3, "user", {"u": 3}), (4, "assistant", {"a": 4}), (3, "user", {"u": 3})), 1):
        ways = [_edit(i, "2", "D", "''"), f"CASE WHEN NOT r.gone THEN {_edit(q, f'1 + {cut}', 'R', f"'{role}:' || r.text || chr(10)")} END"]
        ways += [f"CASE WHEN NOT r.gone AND r.initial = '{initial}' THEN {_edit(to, cut, 'K', line)} END" for initial, to in keeps.items()]
        out.append(f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]")
    return f"[{', '.join(out)}]"


_AT_END = "[{'k': '000000000', 't': ''}, {'k': '000000010II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}, {'k': '000000005I', 't': 'assistant:' || chr(10)}, {'k': '000000000', 't': ''}]"

ORACLE_SQL = {
    "op1_host_rules": rf"""WITH {_PLAIN},
v AS (SELECT doc_id, i, ws[i:i + 7] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(0, 8)) AS o) GROUP BY 1),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
d AS (SELECT l.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM l LEFT JOIN c USING (doc_id)),
e AS (SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, 10 * n_symbols > n_words AS f3, n_dup_lines > 2 AS f4, word_chars < 2 * n_words OR word_chars > 15 * n_words AS f5 FROM d),
u AS (UNPIVOT (SELECT source, f1, f2, f3, f4, f5 FROM e WHERE source IS NOT NULL) ON f1, f2, f3, f4, f5 INTO NAME rule VALUE failed),
h AS (SELECT source, rule, count(*) AS n, sum(failed::INT) AS f FROM u GROUP BY 1, 2),
p AS (SELECT rule, avg(f / n) AS m, var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS v FROM h GROUP BY 1),
z AS (SELECT source, bool_or(CASE WHEN v <= 0 THEN m WHEN m * (1 - m) / v - 1 <= 0 THEN f / n ELSE (f + m * (m * (1 - m) / v - 1)) / (n + m * (1 - m) / v - 1) END > 0.25) AS bad FROM h JOIN p USING (rule) GROUP BY 1)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, f1 OR f2 AS base_failed,
  NOT (f1 OR f2) AND NOT coalesce(bad, false) AS kept FROM e LEFT JOIN z USING (source)""",
    "op2_circulant_minhash": rf"""WITH RECURSIVE {_LOWER},
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r),
m AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op3_suffix_groups": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5(h[2 * i + 1:2 * i + 200]) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
l AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM l),
c AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM c GROUP BY doc_id, run),
g AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list_prepend(0, list(z ORDER BY a)) AS starts, list(a ORDER BY a) AS ends FROM r GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(starts) + 1), lambda k: h[2 * starts[k] + 1:2 * coalesce(ends[k], length(h) // 2)]), '') END)) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
    "op4_super_kmers": rf"""WITH {_PLAIN},
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
r AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM r, (SELECT unnest(range(0, 20)) AS o)),
u AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op11_prefix_tries": rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
s AS (SELECT conv_id, list({{'key': key, 'words': words}} ORDER BY turn NULLS FIRST, role, key) AS l FROM k GROUP BY 1),
h AS (SELECT *, {_CRC.format(s="(conv_id::VARCHAR)")} % 4 AS h FROM s),
b AS (SELECT h.conv_id, list_concat(coalesce(s.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN s ON s.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, d, sha256(array_to_string(list_transform(l[1:d], lambda x: x.key), '')) AS id, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(l[1:d - 1], lambda x: x.key), '')) END AS up, coalesce(l[d].words, 0) AS w, d = len(l) AS ended
  FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM b)),
g AS (SELECT d, id, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
c AS (SELECT d - 1 AS d, up AS id, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c USING (d, id)),
a AS (SELECT m.d, m.id, sum((f.n - 1) * f.w)::BIGINT AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves FROM f JOIN m ON m.conv_id = f.conv_id AND m.d <= f.d GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, o.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256 FROM f JOIN a USING (d, id) LEFT JOIN f o ON o.d = f.d - 1 AND o.id = f.up""",
    "op12_suffix_dawg": rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT *, {_CRC.format(s="name")} % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, left(role, 1) AS initial FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text), copy)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS twice, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM o),
r AS MATERIALIZED (SELECT *, blank OR twice AS gone FROM n),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND twice) AS duplicate, count(*) FILTER (NOT gone AND cut) AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
p AS (SELECT conv_id, n AS i, {_AT_END} AS f FROM s
  UNION ALL SELECT conv_id, i, {_inserted('h')} AS f FROM (SELECT conv_id, i, {_inserted('g')} AS h FROM (SELECT p.conv_id, p.i - 1 AS i, {_edited()} AS g FROM p JOIN r ON r.i = p.i AND r.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i > 0)))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(f[1].k, 9)::BIGINT, 0) AS cost, coalesce(substr(f[1].k, 10), '') AS audit, sha256(coalesce(left(f[1].t, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN (SELECT * FROM p WHERE i = 0) z ON z.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op13_cuckoo_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY 1),
r AS (SELECT doc_id, i, line, coalesce(doc_id > first, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY 1""",
}

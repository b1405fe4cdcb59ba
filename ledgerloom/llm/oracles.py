"""DuckDB SQL for the queries of this folder that SQL can express over whole tables."""

from __future__ import annotations

import string

from .pii import BOOST, CONTEXT, KEEP_SCORE, KINDS
from .quality_rules import RULES, STOP_WORDS, SYMBOLS

GAP = r"[^\x20\x09-\x0D]+"

REACH = """reach AS (SELECT id AS a, id AS b FROM ids UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"""

MINHASH = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{GAP}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
ids AS (SELECT doc_id AS id FROM documents), {REACH}
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON id = documents.doc_id"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
ids AS (SELECT vec_id AS id FROM embeddings), {REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id OR b = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON id = vec_id"""


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a} / CAST({b} AS DOUBLE) ELSE 0.0 END)"


_VALUES = {
    "mean_word_length": _ratio("word_chars", "n_words"), "symbols_per_word": _ratio("n_symbols", "n_words"), "stop_word_share": _ratio("n_stop", "n_words"),
    "dup_line_share": _ratio("n_dup_lines", "n_lines"), "words_per_line": _ratio("n_words", "n_lines"),
}


def _broken() -> str:
    out = []
    for r in RULES:
        v = _VALUES[r.metric]
        tests = [f"{v} < {r.low}"] * (r.low is not None) + [f"{v} > {r.high}"] * (r.high is not None)
        out.append(f"(n_words >= {r.from_words} AND ({' OR '.join(tests)}))")
    return " OR ".join(out)


QUALITY_RULES = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{GAP}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{GAP}')) AS l FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) > 5),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM windows) GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_broken()}) AS kept FROM b"""

#: Of each kind: the pattern in RE2's terms, what a match must look like, what confirms it. RE2 has no look-behind: a \\b
#: stands for it in texts whose _ are read as -, and an ssn is a whole run of digits and dashes.
BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = "list_sum([CASE WHEN i % 2 = 0 THEN CAST(g[len(g) - i] AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(g[len(g) - i] AS INTEGER) + 1] END for i in range(len(g))]) % 10 = 0".replace("g[", f"{DIGITS}[").replace("len(g)", f"len({DIGITS})")
MOD97 = """list_reduce([0] || [CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END for c in string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], '')],
  lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"""
PII_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "true", f"regexp_full_match(m, '{BYTE}([.]{BYTE}){{3}}')"),
    "card": (r"[0-9]([ -]?[0-9])+", f"len({DIGITS}) BETWEEN 14 AND 19", LUHN),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "true", f"len({DIGITS}) BETWEEN 10 AND 15"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}\b", "true", MOD97),
    "secret": (r"""\b(AKIA[A-Z0-9]{16}\b|(?i:password|passwd|secret|token|api-?key)["'']? ?[=:] ?["'']?[A-Za-z0-9+/-]{8,})""", "true", "regexp_matches(m, '[0-9]')"),
    "ssn": (r"[0-9-]+", "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')", "true"),
}


def _pii_kind(i: int) -> str:
    k = KINDS[i]
    pattern, shape, confirms = PII_KINDS[k.name]
    t = "translate(t, '_', '-')" if k.name in ("iban", "secret") else "t"
    return f"""SELECT r, {i} AS ord, '{k.name}' AS kind, start, start + len(m) AS stop, round(least(1, {k.score} + CASE WHEN regexp_matches(lower(near), '{k.words}') THEN {BOOST} ELSE 0 END)::DOUBLE, 2) AS score
 FROM (SELECT *, t[greatest(1, start - {CONTEXT - 1}):start] || chr(10) || t[start + len(m) + 1:least(start + len(m) + {CONTEXT}, coalesce(next, len(t)))] AS near
 FROM (SELECT *, lead(start) OVER (PARTITION BY r ORDER BY start) AS next
 FROM (SELECT r, t, m, sum(len(p) + coalesce(len(before), 0)) OVER (PARTITION BY r ORDER BY i) AS start
 FROM (SELECT *, lag(m) OVER (PARTITION BY r ORDER BY i) AS before
 FROM (SELECT r, t, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(ps[:len(ms)]) AS p
 FROM (SELECT r, t, regexp_extract_all({t}, '{pattern}') AS ms, string_split_regex({t}, '{pattern}') AS ps FROM d)))) WHERE {shape})) WHERE {confirms}"""


PII = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM ({" UNION ALL ".join(_pii_kind(i) for i in range(len(KINDS)))}) WHERE ord < {sum(k.base for k in KINDS)} OR score >= {KEEP_SCORE})
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)},
 sha256(coalesce(string_agg(span, ',' ORDER BY start, ord) FILTER (ord < {sum(k.base for k in KINDS)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, ord), '') AS spans,
 count(kind) > 0 AS flagged, max(score) AS top_score FROM d LEFT JOIN s USING (r) GROUP BY r"""

FILL_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS x FROM d),
c AS (SELECT *, len(l) AS n, least(x[1] % (len(l) + 1), x[2] % (len(l) + 1)) AS i, greatest(x[1] % (len(l) + 1), x[2] % (len(l) + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[1:i], '') AS p, array_to_string(l[i + 1:j], '') AS m, array_to_string(l[j + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLES = {"op1_minhash": MINHASH, "op2_embedding_dedup": EMBEDDINGS, "op5_pii": PII, "op6_quality_rules": QUALITY_RULES, "op13_fill_middle": FILL_MIDDLE}

"""SQL for the registered queries that SQL can express, written apart from the operators: plain joins over all rows."""

from __future__ import annotations

from tabscore.llm.license_scan import PHRASES, STRIDE, catalogue
from tabscore.llm.secret_scan import ALLOWED, ENTROPY

_CASE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_scan() -> str:
    rows = ", ".join(f"({i}, {_text(t.label)}, {t.need}, {len(t.tokens)}, {_text(w)}, {str(t.base).lower()})" for i, t in enumerate(catalogue()) for w in t.tokens)
    places = " UNION ALL ".join(
        f"SELECT rid, pos, {_text(label)} AS label FROM x WHERE " + " AND ".join(f"w{k} = {_text(w)}" for k, w in enumerate(phrase.split())) for label, phrase in PHRASES.items()
    )
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CASE}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    u AS (SELECT rid, unnest(w) AS w0, unnest(range(len(w))) AS pos FROM d),
    x AS (SELECT *, lead(w0, 1) OVER (PARTITION BY rid ORDER BY pos) AS w1, lead(w0, 2) OVER (PARTITION BY rid ORDER BY pos) AS w2 FROM u),
    p AS ({places}),
    t(id, label, need, size, word, base) AS (VALUES {rows}),
    b AS (SELECT DISTINCT rid, block, w0 FROM (SELECT rid, unnest([pos // {STRIDE}, pos // {STRIDE} - 1]) AS block, w0 FROM u) WHERE block >= 0),
    m AS (SELECT rid, block, id, label, count(*) AS n, any_value(need) AS need, any_value(size) AS size FROM b JOIN t ON b.w0 = t.word WHERE NOT base GROUP BY ALL HAVING count(*) >= any_value(need)),
    l AS (SELECT rid, label FROM p UNION SELECT rid, label FROM m),
    pa AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY rid),
    la AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM l GROUP BY rid),
    ma AS (SELECT rid, max(n / size) AS best FROM m GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
    FROM d LEFT JOIN pa USING (rid) LEFT JOIN la USING (rid) LEFT JOIN ma USING (rid)"""


LINE_DEDUP = rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    x AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
    k AS (SELECT *, regexp_replace(translate(line, {_CASE}), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM x),
    f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    g AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.top AS gone FROM k LEFT JOIN f USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM g GROUP BY rid"""

NGRAM_JOIN = rf"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CASE}), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
    n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    i AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
    l AS (SELECT a, b FROM i JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
    r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN c USING (rid)"""

#: Control strings of the template, as the operator lists them; its marks take 12 + 1 + 10 + 1 characters a turn.
_CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|user|>", "<|assistant|>", "<|system|>"]
_ADDED = " + ".join(f"(length(t) - length(replace(t, {_text(c)}, ''))) // {len(c)}" for c in _CONTROL)
CHAT_FORMAT = rf"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
      coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(12 + 1 + 10 + 1 + length(role) + length(t) + length(t) - length(replace(t, '\', '')) + {_ADDED})::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id"""

FILL_IN_MIDDLE = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    h AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
    f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    c AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
      sha256(t) AS restored_sha256
    FROM c"""

_KINDS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "run": r"[0-9A-Za-z+/_-]+=*",
    "alnum": r"[0-9A-Za-z]+=*",
    "dashed": r"[0-9A-Za-z-]+",
}
#: What a candidate is a maximal run of, the shapes that it has, and what can't follow it.
_SHAPES = {
    "entropy-hex": ("run", ["[0-9a-fA-F]{20,}"]),
    "entropy-base64": ("run", ["[0-9A-Za-z+/_-]{20,}={0,2}", ".*[0-9].*", ".*[a-z].*", ".*[A-Z].*"]),
    "entropy-lower": ("alnum", ["[0-9a-z]{20,}={0,6}", ".*[0-9].*", ".*[g-z].*"]),
    "entropy-upper": ("alnum", ["[0-9A-Z]{20,}={0,6}", ".*[0-9].*", ".*[G-Z].*"]),
    "entropy-letters": ("run", ["[A-Za-z]{32,}={0,2}", ".*[A-Z]{2}[a-z].*[A-Z]{2}.*"]),
    "entropy-dashed": ("dashed", ["([0-9A-Z]{4,6}-){3}[0-9A-Z]{4,6}[0-9A-Z-]*", ".{0,24}([0-9][A-Z]|[A-Z][0-9])[0-9A-Z]{0,6}-.{0,20}([0-9][A-Z]|[A-Z][0-9]).*"]),
}
_AFTER = {"run": "[0-9A-Za-z+/_=-]", "alnum": "[0-9A-Za-z=]", "dashed": "[0-9A-Za-z-]"}


def secret_scan() -> str:
    found = " UNION ALL ".join(
        f"""SELECT rid, {k} AS rank, {_text(kind)} AS kind, start, start + length(hit) AS stop, hit, part FROM (
          SELECT rid, hit, part, sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY place) - length(hit) AS start FROM (
            SELECT rid, unnest(range(len(m))) AS place, unnest(m) AS hit, unnest(g) AS part, unnest(s[1:len(m)]) AS gap FROM (
              SELECT rid, regexp_extract_all(t, {_text(p)}) AS m, regexp_extract_all(t, {_text(p)}, {int(kind == "assign")}) AS g, regexp_split_to_array(t, {_text(p)}) AS s FROM d)))"""
        for k, (kind, p) in enumerate(_KINDS.items())
    )
    least = {"assign": "length(part) >= 6", "access": "length(hit) >= 20", "hex": "length(hit) >= 24"}
    base = " OR ".join(f"kind = '{k}' AND {v}" for k, v in least.items())
    shape = lambda kind, of: " AND ".join(f"regexp_full_match({of}, '{p}')" for p in _SHAPES[kind][1])
    shaped = " UNION ALL ".join(
        f"SELECT rid, {3 + k} AS rank, '{kind}' AS kind, start, hit, {window} AS width, {threshold} AS least FROM f JOIN d USING (rid) WHERE kind = '{_SHAPES[kind][0]}' AND length(hit) >= {window} "
        + f"AND NOT regexp_matches(substr(t, (start + length(hit) + 1)::BIGINT, 1), '{_AFTER[_SHAPES[kind][0]]}') AND {shape(kind, 'hit')}"
        for k, (kind, _, window, threshold) in enumerate(ENTROPY)
    )
    still = " OR ".join(f"kind = '{kind}' AND {shape(kind, 'part')}" for kind, *_ in ENTROPY)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    f AS MATERIALIZED ({found}),
    b AS (SELECT rid, rank, kind, start, stop FROM f WHERE {base}),
    r AS (SELECT row_number() OVER () AS run, * FROM ({shaped})),
    u AS (SELECT *, unnest(regexp_split_to_array(hit, {_text(ALLOWED)})) AS part, unnest(list_append(regexp_extract_all(hit, {_text(ALLOWED)}), '')) AS word, unnest(range(len(regexp_extract_all(hit, {_text(ALLOWED)})) + 1)) AS nth FROM r),
    p AS (SELECT * EXCLUDE (start), start + sum(length(part) + length(word)) OVER (PARTITION BY run ORDER BY nth) - length(part) - length(word) AS start FROM u),
    s AS (SELECT row_number() OVER () AS sid, rid, rank, kind, start, part AS hit, width, least FROM p WHERE {still}),
    v AS (SELECT *, unnest(range(length(hit) - width + 1)) AS place FROM s),
    c AS (SELECT sid, place, any_value(rid) AS rid, any_value(rank) AS rank, any_value(kind) AS kind, any_value(start) AS start, any_value(width) AS width, any_value(least) AS least, letter, count(*) AS n
      FROM (SELECT *, unnest(string_split(substr(hit, place + 1, width), '')) AS letter FROM v) GROUP BY sid, place, letter),
    h AS (SELECT sid, place, any_value(rid) AS rid, any_value(rank) AS rank, any_value(kind) AS kind, any_value(start) AS start, any_value(width) AS width FROM c
      GROUP BY sid, place HAVING log2(any_value(width)) - sum(n * log2(n)) / any_value(width) > any_value(least)),
    e AS (SELECT any_value(rid) AS rid, any_value(rank) AS rank, any_value(kind) AS kind, any_value(start) + min(place) AS start, any_value(start) + max(place) + any_value(width) AS stop FROM h GROUP BY sid),
    a AS (SELECT *, true AS base FROM b UNION ALL SELECT *, false FROM e),
    g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank, stop) FILTER (base) AS based, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank, stop) AS spans FROM a GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan(),
        "op3_line_dedup": LINE_DEDUP,
        "op6_ngram_join": NGRAM_JOIN,
        "op9_chat_format": CHAT_FORMAT,
        "op10_secret_scan": secret_scan(),
        "op12_fill_in_middle": FILL_IN_MIDDLE,
    }

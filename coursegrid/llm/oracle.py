"""The registered queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from coursegrid.llm import max_sketch, secret_ledger, warc
from coursegrid.llm.cross_entropy import PRIOR
from coursegrid.llm.quality_rules import RULES, STOP_WORDS, Rule

WORD = r"[^\x20\x09-\x0D]+"


def _holds(rule: Rule) -> str:
    above, _, below = (part.strip() for part in rule.ratio.partition("/"))
    over = below or "1"
    bounds = [f"{above} {sign} {over} * {value}::DOUBLE" for sign, value in ((">=", rule.low), ("<=", rule.high)) if value is not None]
    return " AND ".join(bounds)


def quality_rules() -> str:
    stops = sorted({v for line in STOP_WORDS.values() for w in line.split() for v in (w, w.capitalize(), w.upper())})
    listed = ", ".join(f"'{w}'" for w in stops)
    rules = " AND ".join(f"({_holds(r)})" for r in RULES)
    base = " AND ".join(f"({_holds(r)})" for r in RULES if r.base)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, word, i FROM (
    SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
    FROM (SELECT r, regexp_extract_all(text, '{WORD}') AS ws FROM d))),
g AS (
  SELECT r, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
starts AS (
  SELECT r, i FROM (SELECT r, i, w3, count(*) OVER (PARTITION BY r, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL) WHERE n > 1),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM starts, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
per_word AS (
  SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars,
         count(*) FILTER (word IN ({listed})) AS n_stop_words FROM w GROUP BY r),
l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (regexp_matches(line, '^[\x20\x09]*[-*•]')) AS n_bullet_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{WORD}') GROUP BY r),
c AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop_words, 0) AS n_stop_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_bullet_lines, 0) AS n_bullet_lines,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclamations
  FROM d LEFT JOIN per_word USING (r) LEFT JOIN rep USING (r) LEFT JOIN l USING (r))
SELECT *, NOT ({base}) AS base_failed, ({rules}) AS kept FROM c"""


def secret_ledger_sql() -> str:
    parts = []
    for rank, rule in enumerate(secret_ledger.RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT r, {rank} AS rank, '{rule.kind}' AS kind, string_split_regex(text, '{p}') AS gaps,
         regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {rule.part}) AS parts, {rule.least} AS least FROM d""")
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e)"
    base = "rank < 3"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
u AS (SELECT r, rank, kind, least, unnest(gaps[:len(hits)]) AS gap, unnest(hits) AS hit, unnest(parts) AS part,
             unnest(range(len(hits))) AS i FROM m WHERE len(hits) > 0),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, rank ORDER BY i)::BIGINT AS e FROM u),
f AS (SELECT r, rank, kind, e - length(hit) AS s, e FROM p WHERE length(part) >= least),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, {joined} FILTER ({base}) AS base, {joined} AS spans
      FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""


def perspective_sql() -> str:
    def plain(x: str) -> str:
        return f"replace(replace({x}, '<|im_', '<im_'), '|>', '>')"

    return f"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS place, place // 256 AS part
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (
  SELECT t.conv_id, perspective, part, place, role, text, role = perspective AS own,
         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace({plain('role')}, '[\\r\\n]+', ' ', 'g') END || chr(10) AS head,
         {plain('text')} || '<|im_end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, (sum(length(head) + length(body) + 1) OVER
         (PARTITION BY conv_id, perspective, part ORDER BY place))::BIGINT - 1 AS e FROM s)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own_turns,
       string_agg(head || body || chr(10), '' ORDER BY e) AS text,
       string_agg((e - length(body)) || ':' || e, ',' ORDER BY e) FILTER (own) AS mask
FROM o GROUP BY conv_id, perspective, part"""


def warc_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    text = "html"
    for pattern, value in ((warc.silent(), ""), (warc.FOLDED, " "), (warc.BREAKS, "\n"), (warc.TAGS, "")):
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(value)}, 'g')"
    named = "MAP {" + ", ".join(f"{quoted(n)}: {quoted(v)}" for n, v in warc.NAMED.items()) + "}"
    code = "(CASE WHEN e[3] IN ('x', 'X') THEN '0x' || e[4:-2] ELSE e[3:-2] END)::INT"
    resolved = f"""list_transform(regexp_extract_all(raw, '{warc.ENTITY}'), lambda e:
      CASE WHEN e NOT LIKE '&#%' THEN coalesce(({named})[e], e) WHEN {code} = 160 THEN ' '
           WHEN {code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN chr(65533) ELSE chr({code}) END)"""
    raw, text = text, "array_to_string(list_transform(list_zip(gaps, list_append(hits, '')), lambda z: z[1] || z[2]), '')"
    for pattern, value in ((" *\\n[ \\n]*", "\n"), (" {2,}", " ")):
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(value)}, 'g')"
    text = f"trim({text}, ' ' || chr(10))"
    crlf = "chr(13) || chr(10)"

    def uuid(h: str) -> str:
        return "'<urn:uuid:' || " + " || '-' || ".join(f"{h}[{a}:{a + n - 1}]" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    def fields(pairs: list[tuple[str, str]]) -> str:
        each = ", ".join(f"'{n}: ' || regexp_replace(({v})::VARCHAR, '[\\r\\n]+', ' ', 'g')" for n, v in pairs)
        return f"concat_ws({crlf}, {each})"

    about = fields([("title", "nullif(title, '')"), ("languages", "nullif(lang, '')"), ("outlinks", "n_links"),
                    ("payload-bytes", "strlen(html)"), ("text-digest", "'sha256:' || sha256(body)")])
    head = fields([("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
                   ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"),
                   ("WARC-Date", "date"), ("WARC-Refers-To-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"),
                   ("X-Source-Headers", "regexp_replace(source_headers, '[\\r\\n]+', '; ', 'g')"),
                   ("Content-Type", "content_type"), ("Content-Length", "content_length")])
    return f"""
WITH p AS (
  SELECT page_id AS source_id, url AS target_uri, coalesce(html, '') AS html,
         sha256('response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(url, '') || chr(10)
                || 'sha256:' || sha256(coalesce(html, ''))) AS h
  FROM pages),
t AS (
  SELECT source_id, target_uri, {uuid('h')} AS refers_to, html, 'sha256:' || sha256(html) AS payload_digest, {raw} AS raw,
         string_split_regex(raw, '{warc.ENTITY}') AS gaps, {resolved} AS hits, {text} AS body,
         trim(regexp_replace(regexp_extract(html, {quoted(warc.TITLE)}, 1), '\\s+', ' ', 'g')) AS title,
         lower(regexp_extract(html, {quoted(warc.LANGUAGE)}, 1)) AS lang,
         len(regexp_extract_all(html, {quoted(warc.LINK)})) AS n_links
  FROM p),
i AS (SELECT *, sha256('metadata' || chr(10) || refers_to) AS m, sha256('conversion' || chr(10) || refers_to) AS c FROM t),
k AS (SELECT *, {uuid('m')} AS meta_id, {uuid('c')} AS text_id FROM i),
r AS (
  SELECT source_id, 'metadata' AS warc_type, meta_id AS record_id, refers_to, text_id AS concurrent_to, target_uri,
         'application/warc-fields' AS content_type, payload_digest, {about} AS block FROM k
  UNION ALL
  SELECT source_id, 'conversion', text_id, refers_to, NULL, target_uri, 'text/plain; charset=utf-8', payload_digest, body FROM k),
f AS (
  SELECT source_id, warc_type, record_id, refers_to, concurrent_to, target_uri, '{warc.UNDATED}' AS date, content_type,
         'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' AS source_headers, payload_digest,
         'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length, block FROM r)
SELECT *, sha256('WARC/1.1' || {crlf} || {head} || {crlf} || {crlf} || block || {crlf} || {crlf}) AS record_sha256 FROM f"""


def winnowing_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    own = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT DISTINCT doc_id, {own} AS ws FROM documents),
b AS (SELECT DISTINCT item_id, {own} AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i + 1:i + least(len(ws), 10)], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
n AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i + 1:i + n], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(greatest(len(ws) - n + 1, 0))) AS i FROM d, n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, w)),
k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)"""


def substring_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT r, i, sha256(array_to_string(ws[i + 1:i + 35], ' ')) AS h
      FROM (SELECT r, ws, unnest(range(len(ws) - 34)) AS i FROM d WHERE len(ws) >= 35)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM s),
k AS (
  SELECT r, count(*) FILTER (c.p IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY u.p) FILTER (c.p IS NULL) AS kept
  FROM (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d) u LEFT JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""


def cross_entropy_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def loss(which: str, off: str) -> str:
        p = f"({which}.w - {off} * own_w + 1.0) / ({which}.n - {off} * own_n + types)"
        return f"avg(-ln(({which}.vw - {off} * own_vw + {PRIOR} * {p}) / ({which}.v - {off} * own_v + {PRIOR})))"

    def counts(which: str, of: str) -> str:
        return f"""
{which}w AS (SELECT w, count(*) AS c FROM {of} GROUP BY w),
{which}p AS (SELECT v, w, count(*) AS c FROM {of} GROUP BY v, w),
{which} AS (
  SELECT r, coalesce(p.c, 0) AS vw, coalesce(a.c, 0) AS v, coalesce(b.c, 0) AS w, (SELECT count(*) FROM {of}) AS n, i
  FROM k LEFT JOIN {which}p p ON p.v = k.v AND p.w = k.w LEFT JOIN {which}w a ON a.w = k.v LEFT JOIN {which}w b ON b.w = k.w),"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{WORD}') AS ws FROM documents),
good AS (SELECT doc_id FROM labels WHERE quality = 1),
k AS (
  SELECT r, doc_id, i, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), '') AS v
  FROM (SELECT r, doc_id, unnest(list_append(ws, '')) AS w, unnest(range(len(ws) + 1)) AS i FROM d WHERE len(ws) > 0)),
kt AS (SELECT * FROM k WHERE doc_id IN (FROM good)),
own AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, v, w) AS own_vw, count(*) OVER (PARTITION BY r, v) AS own_v,
         count(*) OVER (PARTITION BY r, w) AS own_w, count(*) OVER (PARTITION BY r) AS own_n,
         CASE WHEN doc_id IN (FROM good) THEN 1 ELSE 0 END AS good
  FROM k),
{counts("b", "k")}{counts("t", "kt")}
s AS (
  SELECT r, count(*) AS n_tokens, {loss("t", "good")} AS target_loss, {loss("b", "1")} AS background_loss
  FROM b JOIN t USING (r, i) JOIN own USING (r, i), (SELECT count(DISTINCT w) AS types FROM k) GROUP BY r)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, round(target_loss, 6) AS target_loss,
       round(background_loss, 6) AS background_loss, round(target_loss - background_loss, 6) AS difference
FROM d LEFT JOIN s USING (r)"""


def prefix_trie_sql() -> str:
    """CRC-32 bit by bit; a node's subtree are the nodes whose smallest conversation has the node's prefix on its way."""
    bit = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {bit})"
    codes = "list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)"
    return f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (
           PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce([4294967295] || {codes}, lambda c, b: {byte}), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
u AS (
  SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.base AND p <= h
  UNION ALL SELECT conv_id, 1, p, role, text FROM t JOIN c USING (conv_id) WHERE p > h),
v AS (
  SELECT conv_id, length(text) AS chars, row_number() OVER o AS d,
         sha256(array_to_string(list(sha256(length(role) || ':' || role || text)) OVER (o ROWS UNBOUNDED PRECEDING), ',')) AS k
  FROM u WINDOW o AS (PARTITION BY conv_id ORDER BY own, p)),
way AS (SELECT conv_id, d, k, chars FROM v UNION ALL SELECT conv_id, 0, '', 0 FROM c),
node AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved FROM way GROUP BY d, k),
up AS (SELECT n.d, n.k, n.conv_id, w.k AS parent FROM node n JOIN way w ON w.conv_id = n.conv_id AND w.d = n.d - 1),
kids AS (SELECT d - 1 AS d, parent AS k, count(*) AS n FROM up GROUP BY ALL),
sub AS (
  SELECT w.d, w.k, sum(n.saved) AS saved, count(*) FILTER (kids.n IS NULL) AS n_leaves
  FROM node n LEFT JOIN kids USING (d, k) JOIN way w ON w.conv_id = n.conv_id AND w.d <= n.d GROUP BY w.d, w.k),
last AS (SELECT conv_id, max_by(d, d) AS d, max_by(k, d) AS k FROM way GROUP BY conv_id),
ends AS (SELECT d, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last GROUP BY d, k)
SELECT node.conv_id, node.d AS depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children,
       sub.n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN sub USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN ends USING (d, k)
LEFT JOIN up ON up.d = node.d AND up.k = node.k LEFT JOIN node above ON above.d = node.d - 1 AND above.k = up.parent"""


def max_sketch_sql() -> str:
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{max_sketch.UPPER}', '{max_sketch.LOWER}'), '{max_sketch.TERM}')"
    return rf"""
WITH q AS (
  SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY item_id, term),
d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ws FROM documents),
s AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
scored AS (
  SELECT item_id, r, doc_id,
         sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::BIGINT AS score
  FROM p JOIN q USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_derivatives": warc_sql(), "op3_winnowing": winnowing_sql(), "op5_cross_entropy_difference": cross_entropy_sql(), "op6_perspective_rotation": perspective_sql(), "op2_secret_ledger": secret_ledger_sql(), "op9_rabin_karp": substring_sql(), "op10_quality_rules": quality_rules(), "op11_prefix_trie": prefix_trie_sql(), "op13_max_sketches": max_sketch_sql()}

"""DuckDB twins of the registered queries that SQL can express."""

from sentier.llm.license_scan import COSINE, FILE_COSINE, NOTICES

ORACLE: dict[str, str] = {}

ORACLE["op7_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM s),
m AS (SELECT k, min(doc_id) AS lo FROM g GROUP BY k),
x AS (SELECT DISTINCT g.doc_id, g.i + o.o AS i FROM g JOIN m USING (k), (SELECT unnest(range(0, 13)) AS o) o
      WHERE m.lo < g.doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
         list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

_MARKS = ["</s>", "<s>", "[/INST]", "[/OUT]", "[/ROLE]", "[/SYS]", "[/TURN]", "[INST]", "[OUT]", "[ROLE]", "[SYS]"]


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), repeat(chr(92), 2))"
    for m in _MARKS:
        out = f"replace({out}, '{m}', '{m[0]}' || chr(92) || '{m[1:]}')"
    return out


ORACLE["op1_chat_format"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS txt FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, row_number() OVER w - 1 AS pos, coalesce(lag(role) OVER w, '<start>') AS prev FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt)),
t AS (
  SELECT *, NOT ((prev IN ('<start>', 'assistant') AND role = 'user') OR (prev = '<start>' AND role = 'system')
                 OR (prev = 'system' AND role = 'user') OR (prev = 'user' AND role = 'assistant')) AS bad,
    length({_escaped('txt')}) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 11
      ELSE 20 + length({_escaped('role')}) END AS n FROM s),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || txt || chr(10), '' ORDER BY pos) AS said,
    coalesce(string_agg(txt, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS under, sum(n) + 7 AS chars,
    min(pos) FILTER (bad) AS bad_turn, arg_max(role, pos) AS last_role FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(under) AS loss_chars, sha256(under) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, bad_turn IS NULL AND last_role = 'assistant' AS valid, bad_turn FROM g
"""

ORACLE["op10_decontamination"] = r"""
WITH lowered AS (SELECT item_id, translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
items AS (SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
starts AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM starts),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce("text", ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM grams),
spots AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT rid, i, s.n, item_id FROM spots s JOIN grams g ON g.n = s.n AND array_to_string(w[i:i + s.n - 1], ' ') = g.g),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""

ORACLE["op9_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS h FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, 3.0 * sum(size) AS top,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM d GROUP BY source),
rate(i, r) AS (
  SELECT 0, CAST((SELECT sum(source_size) / sum(w) FROM s) AS DOUBLE)
  UNION ALL
  SELECT i + 1, CAST((SELECT (sum(source_size) - coalesce(sum(top) FILTER (top < w * r), 0)) / sum(w) FILTER (top >= w * r) FROM s)
    AS DOUBLE) FROM rate WHERE i < 30),
t AS (
  SELECT source, source_size, least(CAST(top AS DOUBLE), CAST(w AS DOUBLE) * (SELECT r FROM rate WHERE i = 30)) AS target FROM s),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target * 256 / source_size) AS BIGINT) ELSE 0 END AS quota FROM t),
p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
b AS (
  SELECT p.doc_id, p.size, q.source_size, q.target, q.quota, least(start * 256 // greatest(q.source_size, 1), 255) AS block
  FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (quota // 256 + CASE WHEN block < quota % 256 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM b
"""


def _draw(name: str, weight: float) -> str:
    h = f"md5('shard|{name}|' || key)"
    return f"-ln((CAST('0x' || substr({h}, 1, 13) AS BIGINT) + 0.5) / {float(16 ** 13)!r}) / {float(weight)!r}"


def _descend(children: list[tuple[str, float, str]]) -> str:
    if len(children) == 1:
        return children[0][2]
    draws = [_draw(name, w) for name, w, _ in children]
    cases = " ".join(f"WHEN {i} THEN {value}" for i, (_, _, value) in enumerate(children))
    return f"(CASE list_position([{', '.join(draws)}], least({', '.join(draws)})) - 1 {cases} END)"


def _rack(k: int) -> tuple[str, float, str]:
    return f"r{k // 2}/k{k}", 2.0, _descend([(f"s{i}", 1.0, str(i)) for i in (2 * k, 2 * k + 1)])


_REGIONS = [(f"r{r}", 4.0, _descend([_rack(2 * r), _rack(2 * r + 1)])) for r in range(4)]

# CRC-32 by its rule: the table comes from eight shifts of each byte value
_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor(3988292384, {0} >> 1) ELSE {0} >> 1 END"

ORACLE["op8_sharding"] = f"""
WITH RECURSIVE crc(k, i, v) AS (
  SELECT 0, b, CAST(b AS BIGINT) FROM range(256) t(b)
  UNION ALL SELECT k + 1, i, {_CRC_STEP.format('v')} FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (
  SELECT doc_id, coalesce("text", '') AS txt, "text" IS NULL AS empty, coalesce(CAST(doc_id AS VARCHAR), '~') AS key,
    hex(encode(coalesce("text", ''))) AS hx FROM documents),
s AS (
  SELECT *, {_descend(_REGIONS)} AS shard, {_descend([*_REGIONS, ('r+16', 1.0, '16')])} AS grown_shard,
    md5('slot|' || key || '|' || CASE WHEN empty THEN '~' ELSE md5(txt) END) AS h FROM d)
SELECT doc_id, CAST(length(hx) // 2 + 1 AS BIGINT) AS size,
  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(hx, 2 * j + 1, 2) AS BIGINT)
    FOR j IN range(length(hx) // 2)]), lambda a, x: xor(a >> 8, tab.t[(xor(a, x) & 255) + 1]))) AS text_crc32,
  'key' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY h) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM s, tab
"""


ORACLE["op11_fill_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce("text", '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid,
    array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


ORACLE["op13_lexical_search"] = r"""
WITH lowered AS (
  SELECT item_id, translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
m AS (SELECT rid, doc_id, 100 - 50 + ((50 * CAST(len(w) AS BIGINT) * big_n) // l) AS m, w FROM d, s WHERE len(w) > 0),
p AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM m) WHERE term IN (SELECT term FROM asked)
  GROUP BY rid, term),
wt AS (
  SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(big_n) AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, s GROUP BY term),
sc AS (
  SELECT item_id, rid, CAST(sum(wt.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN p USING (term) JOIN wt USING (term) JOIN m USING (rid) GROUP BY item_id, rid)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM sc JOIN m USING (rid) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


def _license_sql() -> str:

    rows = ", ".join(f"('{k}', '{v}')" for k, v in sorted(NOTICES.items()))
    terms = "list_filter(list_distinct(regexp_split_to_array(lower({}), '[^a-z0-9]+')), lambda x: x <> '')"
    return f"""
WITH tpl(template, txt) AS (VALUES {rows}),
cell AS (SELECT template, unnest({terms.format('txt')}) AS term FROM tpl),
voc AS (SELECT list(DISTINCT term) AS v FROM cell),
f AS (SELECT doc_id, '/' || coalesce(source, '~') || '/' || coalesce(lang, '~') || '/' ||
  coalesce(CAST(CAST(floor(doc_id / 1000.0) AS BIGINT) AS VARCHAR), '~') || '/' ||
  coalesce(CAST(CAST(floor(doc_id / 100.0) AS BIGINT) AS VARCHAR), '~') AS dir,
  coalesce(CAST(doc_id AS VARCHAR), '~') || '.txt' AS name, "text" AS txt FROM documents),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM f),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_intersect({terms.format("coalesce(txt, '')")}, v)) AS term FROM f, voc) GROUP BY term),
idf AS (SELECT term, pow(ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1.0, 2) AS w2 FROM (SELECT DISTINCT term FROM cell) LEFT JOIN df USING (term), n),
pieces AS (
  SELECT doc_id, false AS whole, generate_subscripts(string_split(txt, chr(10)), 1) AS line, unnest(string_split(txt, chr(10))) AS txt FROM f WHERE txt IS NOT NULL
  UNION ALL SELECT doc_id, true, 0, coalesce(txt, '') FROM f),
sparse AS (SELECT doc_id, whole, line, t, list_intersect(t, v) AS hit FROM (SELECT *, {terms.format('txt')} AS t FROM pieces), voc),
cand AS (SELECT doc_id, whole, line, hit, len(t) - len(hit) AS others FROM sparse
  WHERE len(hit) > 0 AND len(hit) >= len(t) * (CASE WHEN whole THEN {FILE_COSINE * FILE_COSINE!r} ELSE {COSINE * COSINE!r} END)),
hits AS (SELECT doc_id, whole, line, others, term, w2 FROM (SELECT doc_id, whole, line, others, unnest(hit) AS term FROM cand) JOIN idf USING (term)),
norms AS (SELECT doc_id, whole, line, sum(w2) + max(others) * max((SELECT pow(ln(1.0 + n) + 1.0, 2) FROM n)) AS n2 FROM hits GROUP BY ALL),
m AS (SELECT template, sum(w2) AS m2 FROM cell JOIN idf USING (term) GROUP BY template),
dots AS (SELECT h.doc_id, h.whole, h.line, template, sum(h.w2) AS dot FROM hits h JOIN cell USING (term) GROUP BY ALL),
cos AS (SELECT doc_id, whole, line, template, round(dot / sqrt(n2 * m2), 6) AS cosine
  FROM dots JOIN norms USING (doc_id, whole, line) JOIN m USING (template)),
best AS (SELECT * FROM cos WHERE cosine >= CASE WHEN whole THEN {FILE_COSINE} ELSE {COSINE} END
  QUALIFY row_number() OVER (PARTITION BY doc_id, whole ORDER BY cosine DESC, template, line) = 1),
own AS (SELECT doc_id, arg_min(template, CAST(whole AS INT)) AS template, arg_min(cosine, CAST(whole AS INT)) AS cosine, bool_or(whole) AS is_file
  FROM best GROUP BY doc_id),
slim AS (SELECT f.doc_id, f.dir, f.name, o.template, o.cosine, coalesce(o.is_file, false) AS is_file FROM f LEFT JOIN own o USING (doc_id)),
stated AS (SELECT dir AS up, template AS lic FROM slim WHERE is_file
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, template) = 1),
ups AS (SELECT dir, array_to_string(string_split(dir, '/')[1:k], '/') AS up FROM (
  SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM slim))),
near AS (SELECT dir, arg_max(up, length(up)) AS up, arg_max(lic, length(up)) AS lic FROM ups JOIN stated USING (up) GROUP BY dir)
SELECT doc_id, dir || '/' || name AS path, coalesce(template, lic) AS license,
  CASE WHEN is_file THEN 'file' WHEN template IS NOT NULL THEN 'header' WHEN lic IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  cosine, CASE WHEN template IS NULL AND lic IS NOT NULL THEN up || '/' END AS from_dir
FROM slim LEFT JOIN near USING (dir)
"""


ORACLE["op5_license_scan"] = _license_sql()

"""DuckDB SQL for the queries that SQL expresses."""

SQL: dict[str, str] = {}

SQL["op2_warc_salvage"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, strlen(html) AS payload_bytes, unhex(sha1(html)) AS d,
             max(page_id) OVER (PARTITION BY html) AS last FROM p),
bits AS (SELECT page_id, payload_bytes, last, array_to_string(list_transform(range(0, 40), lambda i: lpad(bin(instr('0123456789abcdef', substr(lower(hex(d)), i::INT + 1, 1)) - 1), 4, '0')), '') AS b FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, (5 * i + j)::INT + 1, 1) AS INT) * (1 << (4 - j))))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM bits"""

_WORD = "[^\\x20\\x09-\\x0D]+"

SQL["op5_window_dedup"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM rep, range(0, 35) t(k)),
wd AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM wd ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

_POS = """SELECT doc_id, text, '{k}' AS kind, {i} AS ord, m, start, start + length(m) AS stop, substr(text, greatest(start + 1 - 40, 1), least(start, 40)) || ' ' || substr(text, start + length(m) + 1, 20) AS near
FROM (SELECT doc_id, text, m[i] AS m, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
      FROM (SELECT doc_id, text, m, string_split_regex(text, '{p}') AS g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m FROM t)))"""
_LUHN = "list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(n)[i] AS INT) WHEN CAST(reverse(n)[i] AS INT) > 4 THEN CAST(reverse(n)[i] AS INT) * 2 - 9 ELSE CAST(reverse(n)[i] AS INT) * 2 END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0, list_transform(string_split(substr(b, 5) || substr(b, 1, 4), ''), lambda c: CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (CASE WHEN v < 10 THEN a * 10 + v ELSE a * 100 + v END) % 97) = 1"


def _pii() -> str:
    from codelode.llm.pii import CONTEXT, PATTERNS, SCORES, THRESHOLD

    every = " UNION ALL ".join(_POS.format(k=k, i=i, p=p) for i, (k, p) in enumerate(PATTERNS.items()))
    score = " ".join(f"WHEN kind = '{k}' THEN CASE WHEN regexp_matches(near, '{CONTEXT[k]}') THEN {b} ELSE {a} END" for k, (a, b) in SCORES.items())
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), every AS ({every}),
f AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS n, replace(m, ' ', '') AS b, CASE {score} END AS score FROM every),
ok AS (SELECT doc_id, kind, ord, start, kind || ':' || start || ':' || stop AS s FROM f WHERE CASE kind
  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INT), 0) > 255)) = 0
  WHEN 'card' THEN length(n) BETWEEN 16 AND 19 AND {_LUHN}
  WHEN 'phone' THEN length(n) BETWEEN 8 AND 15
  WHEN 'iban' THEN {_MOD97} WHEN 'secret' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') ELSE true END
  AND (ord < 4 OR score >= {THRESHOLD}))
SELECT t.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(s, ',' ORDER BY ord, start) FILTER (ord < 4), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY ord, start), '') AS spans
FROM t LEFT JOIN ok USING (doc_id) GROUP BY t.doc_id"""


SQL["op9_pii_spans"] = _pii()


def _rules() -> str:
    from codelode.llm.quality_rules import FENCE, LEAST, METRICS

    m = {k: f"({scale} * {top} // greatest({bottom}, 1))" for k, (top, bottom, scale, _, _) in METRICS.items()}
    lows = {k: f"q1 - {FENCE} * greatest(q3 - q1, {floor})" if both else "-1" for k, (_, _, _, floor, both) in METRICS.items()}
    highs = {k: f"q3 + {FENCE} * greatest(q3 - q1, {floor})" for k, (_, _, _, floor, _) in METRICS.items()}
    rows = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {x} AS v FROM f WHERE NOT base_failed" for k, x in m.items())
    case = lambda d: "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + " END"
    levels = [("own", "lang, source"), ("lang", "lang"), ("every", "")]
    fence = ", ".join(
        f"""{n} AS (SELECT *, {case(lows)} AS low, {case(highs)} AS high FROM (SELECT {k + ',' if k else ''} metric, max(total) AS n, min(b) FILTER (upto * 4 >= total) AS q1, min(b) FILTER (upto * 4 >= total * 3) AS q3
        FROM (SELECT {k + ',' if k else ''} metric, b, sum(n) OVER (PARTITION BY {k + ',' if k else ''} metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {k + ',' if k else ''} metric) AS total
              FROM (SELECT {k + ',' if k else ''} metric, b, count(*) AS n FROM v GROUP BY ALL)) GROUP BY {k + ',' if k else ''} metric){f' WHERE n >= {LEAST}' if k else ''})"""
        for n, k in levels
    )
    out = " OR ".join(f"(g.metric = '{k}' AND ({x} > g.high OR {x} < g.low))" for k, x in m.items())
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win), range(0, 3) t(k) WHERE n > 1 GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
  SELECT r, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(ln.n, 0) AS n_lines, coalesce(ln.n - ln.u, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r))),
v AS (SELECT lang, source, metric, CAST(v // (1 << greatest(length(bin(v)) - 6, 0)) * (1 << greatest(length(bin(v)) - 6, 0)) AS BIGINT) AS b FROM ({rows})),
{fence},
g AS (SELECT f.*, m.metric, coalesce(own.low, lang.low, every.low) AS low, coalesce(own.high, lang.high, every.high) AS high FROM f CROSS JOIN (SELECT unnest({list(m)}) AS metric) m
  LEFT JOIN own ON own.metric = m.metric AND own.lang IS NOT DISTINCT FROM f.lang AND own.source IS NOT DISTINCT FROM f.source
  LEFT JOIN lang ON lang.metric = m.metric AND lang.lang IS NOT DISTINCT FROM f.lang LEFT JOIN every ON every.metric = m.metric),
bad AS (SELECT DISTINCT r FROM g WHERE {out})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM f LEFT JOIN bad USING (r)"""


SQL["op4_adaptive_rules"] = _rules()

SQL["op6_hamming_near_dups"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT reach.id, edge.y FROM reach JOIN edge ON edge.x = reach.r),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n USING (doc_id)"""


def _centroids() -> str:
    from codelode.llm.centroids import DIMS, K, LARGEST, ROUNDS, SCALE, SEED

    near = "{a} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, list_sum(list_transform(range(1, {n}), lambda j: (e.v[j] - m.v[j]) * (e.v[j] - m.v[j])))::BIGINT AS d FROM e, {m} m) GROUP BY r)"
    mean = "{m} AS MATERIALIZED (SELECT c, coalesce(new.v, old.v) AS v FROM {old} old LEFT JOIN (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM {a} JOIN p USING (r) GROUP BY c, i) GROUP BY c) new USING (c))"
    rounds = ", ".join(near.format(a=f"a{k}", m=f"c{k}", n=DIMS + 1) + (", " + mean.format(m=f"c{k + 1}", old=f"c{k}", a=f"a{k}") if k < ROUNDS else "") for k in range(ROUNDS + 1))
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: isfinite(x) AND abs(x::DOUBLE * {SCALE}) < {LARGEST})) = {DIMS} AND len(embedding) = {DIMS}),
p AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range({DIMS})) AS i FROM e),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM e ORDER BY h, v LIMIT {K})), {rounds}
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN e USING (r) JOIN c{ROUNDS} m USING (c)"""


SQL["op11_centroids"] = _centroids()


def _crc32(codes: str) -> str:
    """CRC-32 of a list of bytes, by the table of its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, ({table}::BIGINT[])[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"


def _shards() -> str:
    from codelode.llm.sharding import SEED, SHARDS

    codes = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"""
WITH t AS (SELECT doc_id, coalesce('=' || source, '') AS stratum, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, stratum, strlen(text) + 1 AS size, {_crc32(codes)} AS crc FROM t),
o AS (SELECT *, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) || lpad(crc::VARCHAR, 10, '0') AS h, ('0x' || md5('{SEED}/' || stratum)[1:5])::BIGINT / 1048576.0::DOUBLE AS u FROM k),
r AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h) - 1 + u) / count(*) OVER (PARTITION BY stratum) AS f FROM o),
p AS (SELECT *, row_number() OVER (ORDER BY f, stratum, h) - 1 AS p, count(*) OVER () AS n FROM r)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (p * {SHARDS} // n)::INT AS shard, p - (p * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard FROM p"""


def _trie() -> str:
    from codelode.llm.prefix_trie import EVERY, HEADS

    crc = _crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc} % {HEADS} AS h, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, list_concat(coalesce(base.turns[1:c.h], []), c.turns[c.h + 1:]) AS path FROM c LEFT JOIN c base ON base.conv_id = c.conv_id - c.conv_id % {EVERY}),
m AS (SELECT conv_id, d, path[1:d] AS k, d = len(path) AS whole FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM b)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole), '')) AS ends_sha256,
      (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[-1].text, '{_WORD}')) END AS own FROM m GROUP BY k, d),
u AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
s AS (SELECT k[1:a] AS k, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM (SELECT n.k, own, n_children IS NULL AS leaf, unnest(range(0, d + 1)) AS a FROM n LEFT JOIN u ON u.k = n.k) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(u.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN u ON u.k = n.k LEFT JOIN n p ON n.d > 0 AND p.k = n.k[1:n.d - 1]"""


SQL["op12_stratified_shards"] = _shards()
SQL["op13_prefix_trie"] = _trie()

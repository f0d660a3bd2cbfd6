"""DuckDB SQL giving the same rows as the queries of the same names."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _grams(n: int) -> str:
    """dup{n}: a column telling whether a word lies in an n-gram that the text has twice or more."""
    return f"""
  g{n} AS (SELECT doc_id, p, w, list_aggregate(list_slice(ws, p, p + {n - 1}), 'string_agg', ' ') g FROM pos WHERE p + {n - 1} <= n_words),
  f{n} AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) > 1 AS dup FROM g{n}),
  c{n} AS (SELECT pos.doc_id, pos.p, length(pos.w) AS chars,
           coalesce(bool_or(dup) OVER (PARTITION BY pos.doc_id ORDER BY pos.p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false) AS inside
           FROM pos LEFT JOIN f{n} USING (doc_id, p)),
  s{n} AS (SELECT doc_id, count_if(inside) AS words{n}, coalesce(sum(chars) FILTER (WHERE inside), 0) AS chars{n} FROM c{n} GROUP BY doc_id)"""


def _top(n: int) -> str:
    """t{n}: the most characters that all occurrences of one repeated n-gram have together."""
    return f"""
  t{n} AS (SELECT doc_id, max(k) AS top{n} FROM (SELECT doc_id, count(*) * any_value(length(g) - {n - 1}) AS k FROM g{n} GROUP BY doc_id, g HAVING count(*) > 1) GROUP BY doc_id)"""


_LENGTHS, _TOPS = (5, 6, 7, 8, 9, 10), (2, 3, 4)
_LIST = ", ".join
OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(text="text")} AS ws FROM documents),
  n AS (SELECT doc_id, t, ws, len(ws) AS n_words, length(list_aggregate(list_concat(ws, ['']), 'string_agg', '')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
  pos AS (SELECT doc_id, ws, n_words, unnest(range(1, n_words + 1)) AS p, unnest(ws) AS w FROM n),
  l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
  r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
  lines AS (SELECT doc_id, count(*) AS n_lines, count_if(k > 1) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) FILTER (WHERE k > 1), 0) AS dup_line_chars
    FROM r GROUP BY doc_id),
  g2 AS (SELECT doc_id, p, w, list_aggregate(list_slice(ws, p, p + 1), 'string_agg', ' ') g FROM pos WHERE p + 1 <= n_words),
  {_LIST(_grams(n) for n in (3, 4, *_LENGTHS))},{_LIST(_top(n) for n in _TOPS)},
  a AS (SELECT n.doc_id, n_words, word_chars, n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(words3, 0) AS n_repeat_words,
        coalesce(dup_line_chars, 0) AS dup_line_chars, [{_LIST(f"coalesce(chars{n}, 0)" for n in _LENGTHS)}] AS cs, [{_LIST(f"coalesce(top{n}, 0)" for n in _TOPS)}] AS ts
        FROM n LEFT JOIN lines USING (doc_id) {" ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in (3, *_LENGTHS))} {" ".join(f"LEFT JOIN t{n} USING (doc_id)" for n in _TOPS)}),
  v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        concat_ws(',', {_LIST(f"CASE WHEN 100 * cs[{k}] > {most} * word_chars THEN 'gram{n}' END" for k, (n, most) in enumerate(zip(_LENGTHS, (30, 28, 26, 24, 22, 20)), 1))},
        {_LIST(f"CASE WHEN 100 * ts[{k}] > {most} * word_chars THEN 'top{n}' END" for k, (n, most) in enumerate(zip(_TOPS, (20, 18, 16)), 1))},
        CASE WHEN 100 * dup_line_chars > 20 * word_chars THEN 'line_chars' END, CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 'lines' END) AS failed_rules FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, dup_line_chars::BIGINT AS dup_line_chars,
  list_transform(cs, lambda x: x::BIGINT) AS dup_gram_chars, list_transform(ts, lambda x: x::BIGINT) AS top_gram_chars, failed_rules FROM v
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
  r AS (SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN r.response <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN r.response <> d.page_id THEN r.response END AS refers_to
FROM d LEFT JOIN r ON r.payload_digest = d.payload_digest AND d.payload_bytes >= 1000
"""

OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  n AS (SELECT u AS vec_id, count(*) AS n FROM p GROUP BY u),
  r(vec_id, c) AS (SELECT u, u FROM p UNION SELECT p.v, r.c FROM r JOIN p ON p.u = r.vec_id),
  c AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, e.vec_id) AS component_id, coalesce(c.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
  g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [list_aggregate(ws, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS gs FROM d),
  e AS (SELECT DISTINCT doc_id, len(gs) AS n, unnest(gs) AS s FROM g),
  p AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n, b.n AS m, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
    GROUP BY ALL HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
  r(doc_id, c) AS (SELECT u, u FROM p UNION SELECT p.v, r.c FROM r JOIN p ON p.u = r.doc_id),
  c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT g.doc_id, len(gs)::BIGINT AS n_shingles, coalesce(c.c, g.doc_id) AS component_id FROM g LEFT JOIN c USING (doc_id)
"""

# DuckDB has no crc32: the usual table of 256 remainders, and a fold over the bytes of a hexadecimal text
_CRC_TABLE = "(SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) FROM (SELECT unnest(range(256)) AS n))"


def _crc32(text: str) -> str:
    """Of a text; crc.t must be in reach."""
    byte = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


OP11 = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
  own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS bytes
    FROM conversations WHERE conv_id IS NOT NULL),
  h AS (SELECT c, c - c % 5 AS base, {_crc32("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM own), crc),
  turns AS (SELECT h.c, b.i, b.x, b.bytes FROM h JOIN own b ON b.c = h.base AND b.i <= h.h
    UNION ALL SELECT h.c, o.i + 1000000, o.x, o.bytes FROM h JOIN own o ON o.c = h.c AND o.i > h.h),
  seq AS (SELECT h.c, coalesce(list(x ORDER BY i) FILTER (WHERE x IS NOT NULL), []) AS xs, coalesce(list(bytes ORDER BY i) FILTER (WHERE x IS NOT NULL), []) AS bs FROM h LEFT JOIN turns USING (c) GROUP BY h.c),
  prefix AS (SELECT c, len(xs) AS n, d, list_aggregate(list_concat([''], xs[1:d]), 'string_agg', '') AS p, list_aggregate(list_concat([''], xs[1:d - 1]), 'string_agg', '') AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes
    FROM (SELECT c, xs, bs, unnest(range(0, len(xs) + 1)) AS d FROM seq)),
  node AS (SELECT p, d, CASE WHEN d > 0 THEN any_value(up) END AS up, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes, string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM prefix GROUP BY p, d),
  child AS (SELECT up AS p, count(*) AS k FROM node WHERE up IS NOT NULL GROUP BY up),
  full_node AS (SELECT node.*, coalesce(child.k, 0) AS k FROM node LEFT JOIN child USING (p)),
  above AS (SELECT p AS top, p, up, k, n, bytes FROM full_node UNION ALL SELECT f.p, a.p, f.up, a.k, a.n, a.bytes FROM above a JOIN full_node f ON f.p = a.up),
  sums AS (SELECT top AS p, count_if(k = 0) AS leaves, sum((n - 1) * bytes)::BIGINT AS saved FROM above GROUP BY top)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, u.c AS parent_conv_id, f.n::BIGINT AS n_convs, f.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_node f JOIN sums USING (p) LEFT JOIN full_node u ON u.p = f.up
"""

OP12 = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, list_transform(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]'), lambda p: list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '')) AS ps FROM documents),
  piece AS (SELECT lang, unnest(ps) AS ws FROM d),
  gram AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: list_aggregate(ws[i:i + k - 1], 'string_agg', ' '))) AS phrase FROM piece, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
  f AS (SELECT lang, k, phrase, count(*) AS a FROM gram GROUP BY ALL),
  total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
  cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
  cut AS (SELECT lang, k, phrase, a, w, j, list_aggregate(w[1:j], 'string_agg', ' ') AS head, list_aggregate(w[j + 1:k], 'string_agg', ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
  scored AS (SELECT c.lang, c.k, c.phrase, c.a, j, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score FROM cut c
    JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
  inner_part AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a AS longer FROM cand WHERE k = 3),
  most AS (SELECT lang, phrase, max(longer) AS longer FROM inner_part GROUP BY ALL),
  left_over AS (SELECT best.* FROM best LEFT JOIN most USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM left_over JOIN total USING (lang) QUALIFY rank <= 2000
"""

ORACLES = {"op11_trie": OP11, "op12_collocations": OP12, "op4_jaccard": OP4, "op1_quality": OP1, "op2_vectors": OP2, "op3_warc": OP3}

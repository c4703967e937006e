"""DuckDB SQL of the queries that SQL can state."""

MIXING = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight FROM totals),
filled AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS fill FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY fill, source NULLS LAST) AS nth
  FROM filled),
first_open AS (SELECT level, nth FROM levels WHERE fill > level ORDER BY nth LIMIT 1),
targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.nth >= f.nth THEN f.level * l.weight ELSE l.cap END AS target
  FROM levels l LEFT JOIN first_open f ON true),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
upto AS (
  SELECT r.*, p.source_size, p.target, p.epochs, greatest(floor(p.target)::BIGINT - p.epochs * p.source_size, 0) AS extra,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.place, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(extra - (upto - size), 0)))::BIGINT AS taken
FROM upto
"""

TOPK = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

WARC = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN first END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)
"""

QUALITY_RULES = r"""
WITH texts AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT n, unnest(range(1, len(words) - 1)) AS i, words FROM texts WHERE len(words) >= 3),
keyed AS (SELECT n, i, [words[i], words[i + 1], words[i + 2]] AS w FROM windows),
marked AS (SELECT n, i FROM keyed QUALIFY count(*) OVER (PARTITION BY n, w) > 1),
repeats AS (
  SELECT n, count(DISTINCT j) AS n_repeat_words FROM (SELECT n, unnest([i, i + 1, i + 2]) AS j FROM marked) GROUP BY n),
bare AS (
  SELECT n, list_transform(lines, lambda x: {'x': x, 'b': trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))}) AS lines FROM texts),
spaced AS (
  SELECT n, list_transform(lines, lambda x: {'x': x.x, 'last': right(x.b, 1), 'gaps': len(string_split_regex(x.b, '[\x20\x09-\x0D]+'))}) AS lines FROM bare),
good AS (
  SELECT n, list_transform(list_filter(lines, lambda x: NOT (
    (NOT contains('.!?:;,…。！？)]}"''”’»', x.last) AND x.gaps <= 40)
    OR length(x.x) - length(translate(x.x, '#*$%&|<>', '')) > 0.3 * x.gaps
    OR length(x.x) - length(translate(x.x, '!?¡¿', '')) > 0.4 * x.gaps + 1
    OR length(x.x) - length(translate(x.x, '|›»•·', '')) >= 3
    OR regexp_matches(lower(x.x), 'all rights reserved|copyright \(c\)|copyright ©|licen[sc]ed under|privacy policy|terms of (use|service)|use of cookies|accept cookies|enable javascript|lorem ipsum')
    OR regexp_matches(x.x, '(?i)^\W*(home|menu|login|log in|sign in|sign up|search|share|next|previous|back to top|read more)\W*$')
  )), lambda x: x.x) AS good FROM spaced),
counted AS (
  SELECT t.*, g.good, coalesce(r.n_repeat_words, 0) AS n_repeat_words, len(words) AS n_words,
         length(array_to_string(lines, '')) AS all_chars, length(array_to_string(g.good, '')) AS good_chars
  FROM texts t JOIN good g USING (n) LEFT JOIN repeats r USING (n)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words::BIGINT AS n_words,
       length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
       (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND all_chars - good_chars <= 0.5 * all_chars AS kept,
       len(lines)::BIGINT AS n_lines, (len(lines) - len(good))::BIGINT AS n_removed_lines
FROM judged
"""



def _secrets() -> str:
    """Matches of every rule by its pattern; their places follow from the lengths of what lies between."""
    kinds = [  # kind, pattern, group that is the body (0: the whole), its least length, least length of the whole
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, 1),
        ("access", "AKIA[A-Z0-9]+", 0, 1, 20),
        ("hex", "[0-9a-f]+", 0, 1, 24),
        ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 1, 40),
        ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 1, 20),
        ("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]+", 0, 1, 24),
        ("google", "AIza[A-Za-z0-9_-]+", 0, 1, 39),
        ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1, 40),
        ("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 16, 1),
        ("login", "[a-z]+://([A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%+!$=-]+@)", 1, 4, 1),
        ("private", r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----(?:[A-Za-z0-9+/=\x0A\x0D\x20]+-----END\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----)?", 0, 1, 1),
    ]
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = " UNION ALL ".join(
        f"""SELECT n, {k} AS nth, '{kind}' AS kind, {least_body} AS least_body, {least} AS least,
        regexp_extract_all(t, {quoted(pattern)}) AS found, regexp_extract_all(t, {quoted(pattern)}, {group}) AS bodies,
        string_split_regex(t, {quoted(pattern)}) AS gaps FROM texts"""
        for k, (kind, pattern, group, least_body, least) in enumerate(kinds))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({parts}),
placed AS (
  SELECT n, nth, kind, least_body, least, unnest(range(1, len(found) + 1)) AS i, found, bodies, gaps FROM matches WHERE len(found) > 0),
sized AS (
  SELECT n, nth, kind, least_body, least, i, length(found[i]) AS whole, length(bodies[i]) AS body, length(gaps[i]) AS gap FROM placed),
spans AS (
  SELECT *, sum(gap + whole) OVER (PARTITION BY n, nth ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM sized),
kept AS (
  SELECT n, nth, kind, stop - whole AS start, kind || ':' || (stop - whole)::BIGINT || ':' || stop::BIGINT AS said
  FROM spans WHERE body >= least_body AND whole >= least),
told AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(said, ',' ORDER BY start, nth) FILTER (nth < 3) AS base, string_agg(said, ',' ORDER BY start, nth) AS spans
  FROM kept GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(told.spans, '') AS spans
FROM texts LEFT JOIN told USING (n)
"""


RANKED = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
corpus AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS docs, sum(len(terms))::BIGINT AS length FROM texts),
counted AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, corpus GROUP BY term, docs),
sized AS (SELECT doc_id, r, 100 - 90 + (90 * len(terms)::BIGINT * docs) // length AS m FROM texts, corpus WHERE len(terms) > 0),
scored AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN counted USING (term) JOIN sized USING (r) GROUP BY item_id, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored JOIN sized USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""

PREFIX_TRIE = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY pos) AS said FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, said, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda x: list_concat([ascii(x)::BIGINT], [-1 for _ in range(8)])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 6 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) AS said
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
paths AS (
  SELECT conv_id, d AS depth, said[1:d] AS path, CASE WHEN d > 0 THEN length(said[d].text) ELSE 0 END AS chars, d = len(said) AS ends, len(said) AS size
  FROM (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY depth, path),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
told AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path),
above AS (SELECT *, unnest(range(0, depth + 1)) AS top FROM told),
subtrees AS (
  SELECT path[1:top] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM above GROUP BY 1)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n_convs::BIGINT AS n_convs, t.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, t.ends_sha256
FROM told t JOIN subtrees s ON s.path = t.path LEFT JOIN nodes p ON t.depth > 0 AND p.depth = t.depth - 1 AND p.path = t.path[1:t.depth - 1]
"""

ORACLES = {"op3_mixing": MIXING, "op4_topk": TOPK, "op8_warc": WARC, "op9_quality_rules": QUALITY_RULES, "op11_secrets": _secrets(),
           "op12_ranked": RANKED, "op13_prefix_trie": PREFIX_TRIE}

"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM per_source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(place - 1) % 3 + 1]::DOUBLE AS weight, 2.0 * source_size::DOUBLE AS cap
  FROM ranked
), lined AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS full_cap,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight
  FROM weighed WINDOW before AS (
    ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT (1.5 * (SELECT sum(source_size) FROM weighed)::DOUBLE - full_cap) / open_weight AS level
  FROM lined
  WHERE cap > weight * ((1.5 * (SELECT sum(source_size) FROM weighed)::DOUBLE - full_cap) / open_weight)
  ORDER BY cap / weight, place LIMIT 1
), aimed AS (
  SELECT source, source_size,
    CASE WHEN (SELECT count(*) FROM levels) = 0 THEN cap
      ELSE least(cap, weight * (SELECT level FROM levels)) END AS target
  FROM weighed
), placed AS (
  SELECT s.*, a.source_size, a.target,
    CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0 END AS epochs,
    ('0x' || md5('17:' || coalesce(s.source, ''))[1:8])::BIGINT::DOUBLE / 4294967296.0 AS start,
    row_number() OVER (PARTITION BY s.source
      ORDER BY s.size, md5('17:' || coalesce(s.doc_id::VARCHAR, ''))) AS place
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
), tried AS (
  SELECT source, i / 32.0::DOUBLE AS shift, max(target) AS target,
    sum(size * (floor(epochs) + floor((epochs - floor(epochs)) * place + (start + i / 32.0::DOUBLE))
      - floor((epochs - floor(epochs)) * (place - 1) + (start + i / 32.0::DOUBLE)))::BIGINT) AS taken
  FROM placed, range(32) t(i) GROUP BY source, i
), best AS (
  SELECT source, shift FROM tried
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(taken::DOUBLE - target), shift) = 1
), chosen0 AS (
  SELECT doc_id, p.source, size, source_size, target, place, floor(epochs)::BIGINT AS whole,
    epochs > floor(epochs) AS fractional,
    (floor((epochs - floor(epochs)) * place + (start + shift))
      - floor((epochs - floor(epochs)) * (place - 1) + (start + shift)))::BIGINT AS further
  FROM placed p JOIN best b ON p.source IS NOT DISTINCT FROM b.source
)""" + "".join(f""", off{i} AS (
  SELECT source, (sum(size * (whole + further))::BIGINT)::DOUBLE - max(target) AS off
  FROM chosen{i} GROUP BY source
), move{i} AS (
  SELECT c.source, place FROM chosen{i} c JOIN off{i} o ON c.source IS NOT DISTINCT FROM o.source
  WHERE fractional AND abs(off + CASE WHEN further > 0 THEN -size ELSE size END) < abs(off)
  QUALIFY row_number() OVER (PARTITION BY c.source
    ORDER BY abs(off + CASE WHEN further > 0 THEN -size ELSE size END), place) = 1
), chosen{i + 1} AS (
  SELECT doc_id, c.source, size, source_size, target, c.place, whole, fractional,
    CASE WHEN m.place = c.place THEN 1 - further ELSE further END AS further
  FROM chosen{i} c LEFT JOIN move{i} m ON c.source IS NOT DISTINCT FROM m.source
)""" for i in range(2)) + """
SELECT doc_id, source, size, source_size, target, size * (whole + further) AS taken FROM chosen2
"""

SQL["op3_prefix_targets"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(t)
), pieces AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    coalesce(role, '') = 'assistant' AS target,
    length('<|' || regexp_replace(coalesce(role, ''), '([\\|])', '\\\1', 'g') || '|>' || chr(10)
      || regexp_replace(coalesce(text, ''), '([\\|])', '\\\1', 'g') || '<|end|>' || chr(10)) AS chars
  FROM turns
), placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
    ROWS UNBOUNDED PRECEDING) AS upto FROM pieces
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (target), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (target), '')) AS loss_sha256,
  (coalesce(sum(upto) FILTER (target), 0) + max(upto) - coalesce(max(upto) FILTER (target), 0))::BIGINT
    AS formatted_chars, count(*) FILTER (target) AS n_examples
FROM placed GROUP BY conv_id
"""

SQL["op6_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle
  FROM words
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), ways AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reached r JOIN ways l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS component_id FROM reached GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN least l ON d.doc_id = l.a
"""

SQL["op11_shallot_clusters"] = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), parts AS MATERIALIZED (
  SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM kept
), c0 AS MATERIALIZED (
  SELECT c, unnest(range(64)) AS i, unnest(v) AS x FROM (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS c, v FROM kept
    QUALIFY c < 40)
)""" + "".join(f""", a{t} AS MATERIALIZED (
  SELECT r, c, d FROM (
    SELECT p.r, c.c, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d
    FROM parts p JOIN c{t} c ON p.i = c.i GROUP BY p.r, c.c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
), c{t + 1} AS MATERIALIZED (
  SELECT o.c, o.i, coalesce(n.x, o.x) AS x FROM c{t} o LEFT JOIN (
    SELECT a.c, p.i, ((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM a{t} a JOIN parts p ON a.r = p.r GROUP BY a.c, p.i) n ON o.c = n.c AND o.i = n.i
)""" for t in range(5)) + """, last AS (
  SELECT r, c, d FROM (
    SELECT p.r, c.c, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d
    FROM parts p JOIN c5 c ON p.i = c.i GROUP BY p.r, c.c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
), shown AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS digest FROM c5 GROUP BY c
)
SELECT k.vec_id, l.c::INTEGER AS cluster, l.d AS distance,
  (sum(l.d) OVER (PARTITION BY l.c))::BIGINT AS cluster_inertia, (sum(l.d) OVER ())::BIGINT AS inertia,
  s.digest AS centroid_sha256
FROM last l JOIN kept k ON l.r = k.r JOIN shown s ON s.c = l.c
"""

SQL["op13_skip_list_infill"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''),
      '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(tokens)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(tokens) + 1) AS h1,
    ('0x' || h[9:16])::BIGINT % (len(tokens) + 1) AS h2,
    ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4
  FROM cut
), formed AS (
  SELECT doc_id, n, text,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(tokens[1:least(h1, h2)], '') AS prefix,
    array_to_string(tokens[least(h1, h2) + 1:greatest(h1, h2)], '') AS middle,
    array_to_string(tokens[greatest(h1, h2) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM formed
"""

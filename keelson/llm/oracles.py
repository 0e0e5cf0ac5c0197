"""DuckDB SQL for the registered queries that SQL can express."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS ord
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
             WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, source_size * 3 AS cap FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM weighted),
aims AS (
  SELECT source, source_size,
         coalesce(least(max(CASE WHEN lv <= cap / w THEN lv END) OVER () * w, cap::DOUBLE), 0) AS target FROM levels),
queued AS (
  SELECT s.*, a.source_size, a.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY ord, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
passes AS (
  SELECT q.*, p.pass, (p.pass * source_size + upto)::DOUBLE / target AS finish
  FROM queued q CROSS JOIN (SELECT unnest([0, 1, 2]) AS pass) p WHERE target > 0),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, pass, ord, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM passes)
SELECT q.doc_id, q.size, q.source_size, q.target, q.source,
       (CASE WHEN q.target > 0 THEN count(s.doc_id) ELSE 1 END)::INTEGER AS copies,
       (CASE WHEN q.target > 0 THEN count(s.doc_id) ELSE 1 END * q.size)::BIGINT AS taken
FROM queued q LEFT JOIN served s
  ON s.doc_id = q.doc_id AND s.total <= (SELECT sum(size) FROM sized)
GROUP BY q.doc_id, q.size, q.source_size, q.target, q.source
"""

CHAT = r"""
WITH placed AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY pos) AS turns,
         string_agg('<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>')
                    || chr(10) || replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>')
                    || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
  FROM placed GROUP BY conv_id),
one AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS copies, any_value(n_turns) AS n_turns, any_value(rendered) AS rendered
  FROM whole GROUP BY turns),
prefixes AS (SELECT DISTINCT turns[1:k] AS p FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM one))
SELECT conv_id, 0::BIGINT AS segment, n_turns, copies, rendered
FROM one WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE p = turns)
"""

TOPK = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

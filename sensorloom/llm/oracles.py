"""DuckDB twins of those queries that SQL can express."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
windows AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM words WHERE len(ws) >= 8
),
named AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM windows
),
found_twice AS (
  SELECT doc_id, i FROM named
  QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
),
covered AS (
  SELECT doc_id, count(DISTINCT i + k.step) AS n_repeat_words
  FROM found_twice, (SELECT unnest(range(0, 8)) AS step) k GROUP BY doc_id
),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)),
                             lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM words
),
measured AS (
  SELECT w.doc_id,
         len(w.ws)::BIGINT AS n_words,
         length(array_to_string(w.ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l.ls)::BIGINT AS n_lines,
         (len(l.ls) - len(list_distinct(l.ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words w JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN covered c ON c.doc_id = w.doc_id
),
failing AS (
  SELECT *,
         ((n_words < 20)::INT
          + 2 * (100 * n_repeat_words > 30 * n_words)::INT
          + 4 * (100 * n_symbols > 10 * n_words)::INT
          + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
          + 16 * (word_chars < 2 * n_words)::INT
          + 32 * (word_chars > 15 * n_words)::INT)::BIGINT AS failures
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failures,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       failures = 0 AS kept
FROM failing
"""

MAXSCORE = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id, score
FROM scored
QUALIFY rank <= 5
"""

PERSPECTIVES = r"""
WITH spoken AS (
  SELECT conv_id, turn, lower(trim(role)) AS speaker, coalesce(text, '') AS content
  FROM conversations
  WHERE conv_id IS NOT NULL AND trim(role) <> ''
),
seats AS (
  SELECT *, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, content) - 1 AS place
  FROM spoken
),
perspectives AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM spoken WHERE speaker <> 'system'
),
lines AS (
  SELECT s.conv_id, p.perspective, s.place, s.place // 512 AS part,
         s.speaker = p.perspective AS own,
         '<|im_start|>' || CASE WHEN s.speaker = p.perspective THEN 'assistant'
                                WHEN s.speaker = 'system' THEN 'system'
                                ELSE 'user name='
           || replace(translate(s.speaker, chr(10) || chr(13), '  '), '<|', '<\|') END
           || chr(10) AS head,
         replace(s.content, '<|', '<\|') || '<|im_end|>' AS body
  FROM seats s JOIN perspectives p ON p.conv_id = s.conv_id
),
measured AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (
              PARTITION BY conv_id, perspective, part ORDER BY place) - length(body) - 1 AS body_from
  FROM lines
),
parts AS (
  SELECT conv_id, perspective, part, count(*) AS n_messages,
         string_agg(head || body || chr(10), '' ORDER BY place) AS rendered,
         coalesce(string_agg(CASE WHEN own THEN body_from::BIGINT || '-' || (body_from + length(body))::BIGINT END,
                             ',' ORDER BY place), '') AS mask
  FROM measured GROUP BY conv_id, perspective, part
)
SELECT conv_id, perspective, part,
       coalesce(sum(length(rendered)) OVER (
         PARTITION BY conv_id, perspective ORDER BY part
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
       n_messages, rendered, mask
FROM parts
"""

LICENSES = r"""
WITH templates(name, label, words, phrase, must, forms) AS (VALUES
  ('gpl-name', 'gpl', 'gnu general public license', true, '', ''),
  ('apache-name', 'apache', 'apache license', true, '', ''),
  ('cc-by-name', 'cc-by', 'cc by', true, '', ''),
  ('mit-name', 'mit', 'mit license', true, '', ''),
  ('mit-grant', 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction', false, '', ''),
  ('bsd-grant', 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', false, '', ''),
  ('gpl-notice', 'gpl', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation', false, 'gnu', ''),
  ('gpl-use', 'gpl', 'licensed under the gnu general public license version', false, '', 'licensed under the gnu general public license version'),
  ('apache-notice', 'apache', 'licensed under the apache license version 2 0 you may not use this file except in compliance with the license', false, 'apache', ''),
  ('apache-use', 'apache', 'licensed under the apache license version 2 0', false, '', 'licensed under the apache license version 2 0'),
  ('cc-by-nc-use', 'cc-by-nc', 'licensed under cc by nc 4 0', false, '', 'licensed under cc by nc 4 0|licensed under cc by nc sa 4 0|licensed under cc by nc nd 4 0'),
  ('cc-by-sa-use', 'cc-by-sa', 'licensed under cc by sa 4 0', false, '', 'licensed under cc by sa 4 0|licensed under cc by nc sa 4 0'),
  ('mit-use', 'mit', 'released under the mit license', false, '', 'released under the mit license'),
  ('mpl-notice', 'mpl', 'this source code form is subject to the terms of the mozilla public license', false, 'mozilla', ''),
  ('reserved', 'all-rights-reserved', 'all rights reserved', false, '', 'all rights reserved')
),
t AS (
  SELECT name, label, phrase, must, string_split(words, ' ') AS seq,
         CASE WHEN forms = '' THEN [] ELSE
           list_transform(string_split(forms, '|'), lambda f: string_split(f, ' ')) END AS forms,
         list_distinct(string_split(words, ' ')) AS ws
  FROM templates
),
d AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
blocks AS (
  SELECT doc_id, b, ws[b * 64 + 1 : b * 64 + 112] AS bw
  FROM (SELECT doc_id, ws, unnest(range(0, (len(ws) + 63) // 64)) AS b FROM d)
),
met AS (
  SELECT k.doc_id, k.b, k.bw, t.name, t.label, t.phrase, t.seq, t.must, t.forms,
         len(list_intersect(t.ws, list_distinct(k.bw))) AS shared, len(t.ws) AS n
  FROM blocks k JOIN t
    ON len(list_intersect(t.ws, list_distinct(k.bw)))
       >= CASE WHEN t.phrase THEN len(t.ws) ELSE (len(t.ws) * 800 + 999) // 1000 END
),
placed AS (
  SELECT *, CASE WHEN phrase THEN
           list_filter(range(0, least(64, len(bw))), lambda i: bw[i + 1 : i + len(seq)] = seq)
           ELSE [] END AS places,
         (must = '' OR list_contains(bw, must)) AND (len(forms) = 0 OR len(list_filter(forms,
           lambda f: len(list_filter(range(0, least(64, len(bw))),
                                     lambda i: bw[i + 1 : i + len(f)] = f)) > 0)) > 0) AS sure
  FROM met
),
hits AS (
  SELECT doc_id,
         sum(len(places))::BIGINT AS n_base,
         min(b * 64 + list_min(places))::BIGINT AS first_word,
         max(b * 64 + list_max(places))::BIGINT AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase), '') AS base_labels,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE sure), '') AS labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS near_labels,
         string_agg(DISTINCT name, ',' ORDER BY name) AS templates,
         max(shared / n) AS score
  FROM placed WHERE NOT phrase OR len(places) > 0 GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score,
       coalesce(templates, '') AS templates, coalesce(near_labels, '') AS near_labels
FROM d LEFT JOIN hits USING (doc_id)
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         regexp_matches(u.line, '[^\x20\x09-\x0D]') AS filled,
         len(regexp_extract_all(u.line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS z
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
       LATERAL (SELECT z[1] AS i, z[2] AS line) u
),
hashed AS (
  SELECT doc_id, i, ('0x' || substr(md5(line), 1, 15))::BIGINT::HUGEINT AS h
  FROM lines WHERE filled
),
borders AS (
  SELECT doc_id, i,
         (31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) + h) % 3 = 0 AS border
  FROM hashed
),
starting AS (
  SELECT l.*, (l.words >= 50 OR lag(coalesce(b.border, false) OR l.words >= 50, 1, false) OVER (
           PARTITION BY l.doc_id ORDER BY l.i))::INT AS starts
  FROM lines l LEFT JOIN borders b ON b.doc_id = l.doc_id AND b.i = l.i
),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM starting
),
chunks AS (
  SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body,
         sum(filled::INT) > 1 OR sum(words) >= 50 AS worth
  FROM numbered GROUP BY doc_id, chunk
),
judged AS (
  SELECT *, worth AND row_number() OVER (
           PARTITION BY worth, rtrim(body, chr(10)) ORDER BY doc_id, chunk) > 1 AS gone
  FROM chunks
),
texts AS (
  SELECT doc_id, string_agg(body, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone) AS kept,
         sum(gone::INT)::BIGINT AS chunks_removed
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN chunks_removed > 0 THEN rtrim(coalesce(kept, ''), chr(10)) ELSE d.text END AS text,
       coalesce(chunks_removed, 0) AS chunks_removed
FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id
"""

ORACLES = {
    "op3_line_dedup": LINE_DEDUP,
    "op2_license_scan": LICENSES,
    "op5_perspective_rotation": PERSPECTIVES,
    "op6_maxscore_top_k": MAXSCORE,
    "op10_quality_rules": QUALITY_RULES,
}

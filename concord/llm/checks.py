"""SQL that gives the rows of those operators whose method SQL can express."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: Every run of one to five words of every text, joined to all shingles of the items.
CONTAINMENT = f"""
WITH texts AS (
  SELECT 'doc' AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 'item', item_id, text FROM benchmark WHERE item_id IS NOT NULL
), listed AS (
  SELECT row_number() OVER () AS line, kind, id,
    regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM texts
), places AS (
  SELECT line, kind, id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM listed
), runs AS (
  SELECT kind, id, [word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w] AS run
  FROM places WINDOW w AS (PARTITION BY line ORDER BY place)
), sizes AS (
  SELECT id, least(5, max(len(words))) AS size FROM listed WHERE kind = 'item' GROUP BY id HAVING max(len(words)) > 0
), owned AS (
  SELECT DISTINCT id AS item_id, size, run[1:size] AS shingle FROM runs JOIN sizes USING (id) WHERE kind = 'item' AND run[size] IS NOT NULL
), held AS (
  SELECT DISTINCT id AS doc_id, size, run[1:size] AS shingle
  FROM runs, (SELECT DISTINCT size FROM sizes) WHERE kind = 'doc' AND run[size] IS NOT NULL
), long AS (SELECT item_id, count(*) AS n_shingles FROM owned GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM held JOIN owned USING (size, shingle) JOIN long USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""

#: Rules one by one for each page, then the totals of templates, their siblings and all pages.
TEMPLATES = f"""
WITH rules(says, site, root) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), addresses AS (
  SELECT page_id, regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^?#]*') AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(split_part(rest, '/', 1), {_LOWER}) AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM addresses
), ruled AS (
  SELECT *, (SELECT max_by({{'says': says, 'rule': site || root}}, length(site || root)) FROM rules
    WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, root)) AS fit,
    substr(regexp_replace(path, '[^/]*[0-9][^/]*', '*', 'g'), 2) AS general
  FROM split
), rows AS (
  SELECT page_id, host, path, fit.rule AS rule, fit.says AS says, split_part(general, '/', 1) AS branch,
    substr(general, length(split_part(general, '/', 1)) + 1) AS below
  FROM ruled
), branches AS (
  SELECT host, below, branch, count(*) AS pages, count(says) AS labelled, count(*) FILTER (says = 'allow') AS allowed
  FROM rows GROUP BY ALL
), families AS (
  SELECT host, below, sum(pages) AS pages_in, sum(labelled)::BIGINT AS labelled_in, sum(allowed)::BIGINT AS allowed_in
  FROM branches GROUP BY ALL
), compared AS (
  SELECT *, labelled_in - labelled AS labelled_beside, allowed_in - allowed AS allowed_beside, allowed_in / labelled_in AS pooled
  FROM branches JOIN families USING (host, below)
), nodes AS (
  SELECT *, CASE WHEN (pages > 1 OR pages_in < 20) AND labelled > 0 AND labelled_beside > 0
    AND pow(allowed / labelled - allowed_beside / labelled_beside, 2)
      > 4e0 * (pooled * (1 - pooled) * (1 / labelled + 1 / labelled_beside)) THEN branch ELSE '*' END AS node
  FROM compared
), prior AS (
  SELECT CASE WHEN count(says) > 0 THEN count(*) FILTER (says = 'allow') / count(says) ELSE 5e-1 END AS prior FROM rows
), shares AS (
  SELECT host, below, node, (sum(allowed)::BIGINT + 4e0 * any_value(prior)) / (sum(labelled)::BIGINT + 4e0) AS share
  FROM nodes, prior GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN share < 5e-1 THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || node || below AS template, share
FROM rows JOIN nodes USING (host, below, branch) JOIN shares USING (host, below, node)
"""

#: The checksum bit by bit, then all conversations a row at a time: the cheapest way to each state, of equal ones the ASCII-least.
REPAIR = """
WITH RECURSIVE named AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), summed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(name, '')]),
      LAMBDA sum, byte: xor(xor(sum, byte) >> 1, 3988292384::BIGINT * (xor(sum, byte) & 1))), 4294967295::BIGINT) % 20 AS fault
  FROM named
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fault WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM summed WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place, left(role, 1) AS initial,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS kind,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'b') AS blank,
    count(*) FILTER (kind = 'd') AS duplicate, count(*) FILTER (kind = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM faulty GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0::BIGINT AS place, [{'cost': 0::BIGINT, 'audit': '', 'state': 0, 'lines': []::VARCHAR[]}] AS best FROM counts
  UNION ALL
  SELECT conv_id, place, list_filter([list_min(list_filter(found, LAMBDA p: p.state = s)) FOR s IN [0, 1, 2, 3]], LAMBDA p: p IS NOT NULL)
  FROM (
    SELECT conv_id, place,
      [{'cost': p.cost + 4, 'audit': p.audit || 'D', 'state': p.state, 'lines': p.lines} FOR p IN begun]
      || [{'cost': p.cost + CASE kind WHEN 't' THEN 3 ELSE 0 END, 'audit': p.audit || 'K',
           'state': CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'lines': list_append(p.lines, role || ':' || text)}
          FOR p IN begun IF kind IN ('.', 't') AND
            CASE initial WHEN 's' THEN p.state = 0 WHEN 'u' THEN p.state <> 2 WHEN 'a' THEN p.state = 2 ELSE false END]
      || [{'cost': p.cost + CASE kind WHEN 't' THEN 6 ELSE 3 END, 'audit': p.audit || 'R', 'state': CASE p.state WHEN 2 THEN 3 ELSE 2 END,
           'lines': list_append(p.lines, CASE p.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || text)}
          FOR p IN begun IF kind IN ('.', 't')] AS found
    FROM (
      SELECT w.conv_id, f.place, f.kind, f.initial, f.role, f.text, w.best || [
        {'cost': p.cost + 3, 'audit': p.audit || 'I', 'state': CASE p.state WHEN 2 THEN 3 ELSE 2 END,
         'lines': list_append(p.lines, CASE p.state WHEN 2 THEN 'assistant:' ELSE 'user:' END)} FOR p IN w.best] AS begun
      FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.place + 1
    )
  )
), ended AS (
  SELECT w.conv_id, list_min([p FOR p IN best IF p.state IN (0, 3)] || [
    {'cost': p.cost + 3, 'audit': p.audit || 'I', 'state': 3, 'lines': list_append(p.lines, 'assistant:')} FOR p IN best IF p.state = 2]) AS least
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND place = n
)
SELECT everyone.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(least.cost, 0) AS cost, coalesce(least.audit, '') AS audit,
  sha256(coalesce(array_to_string(least.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) everyone
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM everyone.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM everyone.conv_id
"""

#: Every posting of a query term, joined to every query that holds it.
RANKED = f"""
WITH said AS (
  SELECT row_number() OVER () AS line, doc_id,
    regexp_extract_all(translate(text, {_LOWER}), '{_TERM}') AS terms
  FROM documents
), totals AS (
  SELECT count(*) AS docs, sum(len(terms))::BIGINT AS length FROM said WHERE len(terms) > 0
), asked AS (
  SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '{_TERM}')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))
), postings AS (
  SELECT line, doc_id, n, term, count(*) AS tf
  FROM (SELECT line, doc_id, len(terms) AS n, unnest(terms) AS term FROM said)
  SEMI JOIN asked USING (term) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM postings, totals GROUP BY term, docs
), scores AS (
  SELECT item, item_id, line, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL
)
SELECT item_id, row_number() OVER best AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY rank <= 10
"""

#: What has to come back, straight from the table, and the lengths of marks, roles, texts and escapes.
CHAT = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) added(turn, role)
), shown AS (
  SELECT *, len(replace(replace(role, '%', '%25'), chr(10), '%0A')) + len(text) + len(regexp_extract_all(role, controls))
    + len(regexp_extract_all(text, controls)) + len('<|im_start|>') + 1 + len('<|im_end|>') + 1 AS chars
  FROM said, (SELECT '<\\\\*(?:\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>|<SYS>>|</SYS>>)|\\[\\\\*(?:INST\\]|/INST\\])' AS controls)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""

"""DuckDB SQL of the corpus queries that SQL can express, from their definitions."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

#: Unsigned CRC-32 of an ASCII text, bit by bit.
_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,"
    " list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),"
    " lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),"
    " lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"
)

AUDIT = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words
  FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT t.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    [len(words) < 100,
     100 * len(list_distinct(words)) < 80 * len(words),
     100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
     regexp_matches(text, '[#$%&*|]'),
     coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), min(t.doc_id) OVER (PARTITION BY text) IS NOT NULL)
    ] AS fails
  FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id
), counted AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM docs GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter
  FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)
), removal AS (
  SELECT c.*, o.filter_order,
    coalesce(list_min([s FOR s IN range(1, 6) IF c.fails[ascii(substr(o.filter_order, s::INTEGER, 1)) - 64]]), 6) AS gone
  FROM counted c, orders o
), result AS (
  SELECT r.part, s.filter_order, s.step, s.letter,
    coalesce(sum(r.n) FILTER (r.gone > s.step), 0)::BIGINT AS kept,
    coalesce(sum(r.n) FILTER (r.gone = s.step), 0)::BIGINT AS removed,
    coalesce(sum(r.n) FILTER (r.gone < s.step AND r.fails[ascii(s.letter) - 64]), 0)::BIGINT AS redundant,
    coalesce(sum(r.n) FILTER (r.fails[ascii(s.letter) - 64] AND len(list_filter(r.fails, lambda f: f)) = 1), 0)::BIGINT
      AS unique_fails,
    coalesce(sum(r.n) FILTER (r.gone = s.step AND r.good), 0)::BIGINT AS good_lost,
    coalesce(sum(r.n) FILTER (r.gone = s.step AND r.toxic), 0)::BIGINT AS toxic_lost
  FROM removal r JOIN steps s ON r.filter_order = s.filter_order
  GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM result
"""


def _leaf(text: str) -> str:
    values = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    parts = (f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values)
    return f"sha256({' || '.join(parts)})"


# A tree over runs of 16: nodes by tree and level, then, from the leaf up, the digests before
# and after the own one in its run. ``only`` is the number of nodes of a tree in the level before.
MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
    CASE WHEN {_CRC32.format(text='doc_id::VARCHAR')} % 5 = 0
      THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
      ELSE {_leaf('text')} END AS found,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
  FROM documents
), lower_nodes(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM docs
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM lower_nodes WHERE n > 1 GROUP BY tree, level, pos // 16
), subroots AS (
  SELECT tree, digest FROM lower_nodes WHERE n = 1
), upper_nodes(level, pos, digest, n) AS (
  SELECT 0, tree, digest, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 16
), steps AS (
  SELECT tree, level, pos,
    coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (
    SELECT * FROM lower_nodes UNION ALL SELECT -1 AS tree, level, pos, digest, n FROM upper_nodes
  ) WHERE n > 1 WINDOW r AS (PARTITION BY tree, level, pos // 16 ORDER BY pos)
), walk(doc_id, tree, level, pos, home, proof, folded) AS (
  SELECT doc_id, tree, 0, pos, tree, '', found FROM docs
  UNION ALL
  SELECT w.doc_id, if(s.tree IS NULL, -1, w.tree), if(s.tree IS NULL, 0, w.level + 1),
    if(s.tree IS NULL, w.home, w.pos // 16), w.home,
    w.proof || coalesce(s.before || s.after, ''),
    if(s.tree IS NULL, w.folded, sha256(s.before || w.folded || s.after))
  FROM walk w LEFT JOIN steps s ON w.tree = s.tree AND w.level = s.level AND w.pos = s.pos
  WHERE s.tree IS NOT NULL OR w.tree >= 0
), ends AS (
  SELECT doc_id, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded
  FROM walk WHERE tree = -1 GROUP BY doc_id
), top AS (
  SELECT digest AS root FROM upper_nodes WHERE n = 1
)
SELECT d.doc_id, d.leaf, s.digest AS subroot, t.root, sha256(e.proof) AS proof_sha256,
  e.folded AS folded_root, e.folded = t.root AS verified
FROM docs d JOIN subroots s ON d.tree = s.tree JOIN ends e ON d.doc_id = e.doc_id CROSS JOIN top t
"""

# Two sets of similarity 0.85 differ by less than a factor in size and share a shingle.
NGRAM_JOIN = rf"""
WITH RECURSIVE cut AS (
  SELECT doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)])
    END AS shingles
  FROM cut
), classes AS (
  SELECT min(doc_id) AS c, any_value(len(shingles)) AS n, list_sort(shingles) AS shingles
  FROM sets WHERE len(shingles) > 0 GROUP BY list_sort(shingles)
), items AS (
  SELECT c, n, unnest(shingles) AS x FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.x = b.x AND a.c <> b.c
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)
), reached(c, r) AS (
  SELECT c, c FROM classes
  UNION
  SELECT l.a, x.r FROM reached x JOIN links l ON x.c = l.b
), named AS (
  SELECT c, min(r) AS component_id FROM reached GROUP BY c
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes k ON len(s.shingles) > 0 AND list_sort(s.shingles) = k.shingles
  LEFT JOIN named m ON k.c = m.c
"""

# Documents of the first operator: the same join at 80%, kept where a document names its component.
NEAR_DUPLICATES = (
    NGRAM_JOIN.replace("85 * greatest", "80 * greatest")
    .replace("185 * count(*) >= 85 *", "180 * count(*) >= 80 *")
    .replace(
        "AS component_id\nFROM sets s", "AS component_id,\n  coalesce(m.component_id, s.doc_id) = s.doc_id AS kept\nFROM sets s"
    )
)

_SPACED = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

QUALITY = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w
  FROM documents
), grams AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) > 1 AS twice
  FROM (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest([[w[i], w[i + 1], w[i + 2]] FOR i IN range(1, len(w) - 1)]) AS g
        FROM (SELECT row_number() OVER () AS rid, w FROM texts))
), measured AS (
  SELECT t.doc_id, t.text, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars,
    length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t.text, chr(10)), lambda l: length(trim(l, {_SPACED})) > 0) AS lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM (SELECT row_number() OVER () AS rid, * FROM texts) t LEFT JOIN (
    SELECT rid, count(DISTINCT p) AS n
    FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE twice) GROUP BY rid
  ) r ON t.rid = r.rid
), counted AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM measured
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 2 * (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g'))) > word_chars) AS kept
FROM counted
"""

PASSAGES = rf"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents
), windows AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) > 1 AS later
  FROM (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s,
          unnest([array_to_string(w[i:i + 19], ' ') FOR i IN range(1, len(w) - 18)]) AS x FROM cut)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM cut
), marked AS (
  SELECT x.doc_id, x.word, x.s,
    bool_or(coalesce(y.later, false)) OVER (PARTITION BY x.doc_id ORDER BY x.s ROWS 19 PRECEDING) AS gone
  FROM words x LEFT JOIN windows y ON x.doc_id = y.doc_id AND x.s = y.s
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY s) FILTER (NOT gone) AS left_over
  FROM marked GROUP BY doc_id
)
SELECT c.doc_id, len(c.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.left_over, '')) AS kept_sha256
FROM cut c LEFT JOIN kept k ON c.doc_id = k.doc_id
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM documents
), items AS (
  SELECT item_id, w, least(len(w), 10) AS n
  FROM (SELECT item_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM benchmark) WHERE len(w) > 0
), searched AS (
  SELECT DISTINCT item_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS x
  FROM items
), places AS (
  SELECT c.doc_id, l.n, unnest(range(1, len(c.w) - l.n + 2)) AS s,
    unnest([array_to_string(c.w[i:i + l.n - 1], ' ') FOR i IN range(1, len(c.w) - l.n + 2)]) AS x
  FROM cut c, (SELECT DISTINCT n FROM items) l
), found AS (
  SELECT p.doc_id, p.s, p.n, q.item_id FROM places p JOIN searched q ON p.n = q.n AND p.x = q.x
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id
)
SELECT c.doc_id, len(c.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
  coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN hits h ON c.doc_id = h.doc_id LEFT JOIN held i ON c.doc_id = i.doc_id
"""

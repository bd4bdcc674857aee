"""SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"""list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20),
again AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS n
  FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again WHERE n > 1),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS kept, count(*) AS n
  FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(root.b, v.vec_id)) AS component_id,
  v.vec_id <= coalesce(root.b, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN root ON root.a = v.vec_id""",
    "op5_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length('### : </turn>' || chr(10))
    + length(regexp_replace(role, '(\\|:|\n|###|</turn>)', '\\\1', 'g'))
    + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) AS chars
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, {ALNUM} AS words FROM documents),
b AS (SELECT item_id, {ALNUM} AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, l, array_to_string(words[i:i + l - 1], ' ') AS k FROM (
    SELECT item_id, words, least(10, len(words)) AS l, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i
    FROM b WHERE len(words) > 0)),
dw AS (
  SELECT doc_id, i, l, array_to_string(words[i:i + l - 1], ' ') AS k FROM (
    SELECT doc_id, words, l, unnest(range(1, len(words) - l + 2)) AS i
    FROM d CROSS JOIN (SELECT DISTINCT l FROM bw) WHERE len(words) >= l)),
hits AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, k)),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_hit,
  coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.items, '')) AS items_sha256,
  coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_minmax_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS k FROM (
    SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 0) + 2)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id
    GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(root.b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(root.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root ON root.a = d.doc_id""",
    "op11_phrase_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
f AS (
  SELECT lang, g AS words, array_to_string(w.words[i:i + g - 1], ' ') AS phrase, count(*) AS n
  FROM (SELECT lang, words, g, unnest(range(1, len(words) - g + 2)) AS i
    FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS g) WHERE len(words) >= g) w
  GROUP BY 1, 2, 3),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, phrase, words, n AS a, string_split(phrase, ' ') AS p FROM f WHERE words > 1 AND n >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(p[:k], ' ') AS head, array_to_string(p[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
rated AS (
  SELECT cuts.lang, cuts.phrase, a, k, h.n AS l, t.n AS r,
    (1000000::HUGEINT * a * a) // (h.n::HUGEINT * t.n) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = cuts.head
  JOIN f t ON t.lang = cuts.lang AND t.phrase = cuts.tail),
weakest AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(p[i:i + 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE words = 3) GROUP BY 1, 2),
ranked AS (
  SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, x.a DESC, x.phrase) AS rank
  FROM weakest x LEFT JOIN longer y ON y.lang = x.lang AND y.phrase = x.phrase
  WHERE y.a IS NULL OR 100 * y.a < 50 * x.a)
SELECT ranked.lang, rank, phrase, a, l, r, total.n, score::BIGINT AS score
FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000""",
    "op12_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text,
    {WORDS.format(text="coalesce(text, '')")} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
starts AS (
  SELECT row, i, array_to_string(words[i:i + 2], ' ') AS k
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) > 2)),
again AS (SELECT row, i FROM starts QUALIFY count(*) OVER (PARTITION BY row, k) > 1),
covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY row),
m AS (
  SELECT d.row, doc_id, stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
    length(regexp_replace(text, '[^!]', '', 'g')) AS marks
  FROM d LEFT JOIN covered USING (row)),
v AS (
  SELECT *, list_transform(list_transform([
    (1000 * n_symbols, word_chars), (1000 * n_dup_lines, n_lines), (1000 * n_repeat_words, n_words),
    (10 * word_chars, n_words), (1000 * capitals, letters), (1000 * marks, word_chars)],
    lambda x: CASE WHEN x[2] > 0 THEN x[1] // x[2] ELSE 0 END), lambda x: least(x, 1000)) AS numbers,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m),
marked AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
each_ AS (
  SELECT stratum, quality > 0 AS good, substr(md5(doc_id::VARCHAR), 1, 1) IN ('0', '1', '2', '3', '4') AS design,
    unnest(numbers) AS number, unnest(range(1, 7)) AS rule
  FROM v JOIN marked USING (doc_id)),
grid AS (SELECT unnest(range(0, 1001)) AS cutoff),
sums AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (design AND NOT good AND number > cutoff) AS bad,
    count(*) FILTER (design AND good AND number > cutoff) AS lost,
    count(*) FILTER (NOT design AND good AND number > cutoff) AS rejected, count(*) FILTER (NOT design AND good) AS n
  FROM each_ CROSS JOIN grid GROUP BY 1, 2, 3),
proposed AS (
  SELECT * FROM sums WHERE cutoff < 1000 AND bad > 20 * lost
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - 20 * lost DESC, cutoff DESC) = 1),
level AS (SELECT 0.05::DOUBLE / (6 * count(DISTINCT stratum)) AS level, 0.05::DOUBLE / 6 AS risk FROM each_),
tails AS (
  SELECT stratum, rule, cutoff, level, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln(risk) + (n - i) * ln(1 - risk))) AS tail
  FROM (SELECT s.*, level, risk, unnest(range(0, s.rejected + 1)) AS i
    FROM sums s JOIN proposed p USING (stratum, rule) CROSS JOIN level
    WHERE s.cutoff >= p.cutoff AND s.rejected <= s.n * risk)
  GROUP BY 1, 2, 3, 4),
cutoffs AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tails WHERE tail <= level GROUP BY 1, 2),
broken AS (
  SELECT v.row, string_agg(['symbols', 'dup_lines', 'repeats', 'word_length', 'capitals', 'marks'][rule], ',' ORDER BY rule) AS broken
  FROM v JOIN cutoffs c ON c.stratum = v.stratum AND v.numbers[c.rule] > c.cutoff GROUP BY v.row)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND broken IS NULL AS kept, coalesce(broken, '') AS broken
FROM v LEFT JOIN broken USING (row)""",
    "op13_prefix_trie": rf"""
WITH RECURSIVE crc(i, v, step) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, step + 1 FROM crc WHERE step < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE step = 8),
turns AS (
  SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns) CROSS JOIN tab),
rebuilt AS (
  SELECT x.c, row_number() OVER (PARTITION BY x.c ORDER BY own, p) AS d, role, text FROM (
    SELECT v.c, 0 AS own, p, role, text FROM convs v JOIN turns t ON t.c = v.c - v.c % 100 AND p <= h
    UNION ALL SELECT v.c, 1, p, role, text FROM convs v JOIN turns t ON t.c = v.c AND p > h) x),
whole AS (
  SELECT v.c, coalesce(list(r.role || chr(0) || r.text ORDER BY d) FILTER (d IS NOT NULL), []) AS s,
    coalesce(list(length(r.text) ORDER BY d) FILTER (d IS NOT NULL), []) AS n
  FROM convs v LEFT JOIN rebuilt r USING (c) GROUP BY v.c),
path AS (
  SELECT c, d, sha256(array_to_string(s[:d], chr(1) || chr(0))) AS k, d = len(s) AS whole, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM whole)),
node AS (
  SELECT d, k, min(c) AS c, count(*) AS n_convs, max(chars) AS chars,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (whole), '')) AS ends
  FROM path GROUP BY d, k),
spot AS (SELECT p.c AS conv, n.* FROM path p JOIN node n USING (d, k)),
linked AS (
  SELECT n.*, up.c AS parent FROM node n LEFT JOIN spot up ON up.conv = n.c AND up.d = n.d - 1),
kids AS (SELECT parent, d - 1 AS d, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY 1, 2),
full_ AS (SELECT l.*, coalesce(kids.n, 0) AS kids FROM linked l LEFT JOIN kids ON kids.parent = l.c AND kids.d = l.d),
sums AS (
  SELECT s.c, s.d, count(*) FILTER (f.kids = 0) AS leaves, sum((f.n_convs - 1) * f.chars) AS saved
  FROM full_ f JOIN spot s ON s.conv = f.c AND s.d <= f.d GROUP BY 1, 2)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, parent AS parent_conv_id, n_convs::BIGINT AS n_convs, kids::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM full_ f JOIN sums USING (c, d)""",
}

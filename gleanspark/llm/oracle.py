"""SQL that must give the same rows as a registered query, where SQL can express it."""

from __future__ import annotations

from gleanspark.llm.mixing import MOST_REPEATS, SEED, TAG, WEIGHTS
from gleanspark.llm.substrings import WINDOW

TURN = f"list_extract([{', '.join(map(str, WEIGHTS))}], (place % {len(WEIGHTS)} + 1)::BIGINT)"

# A source is at its limit if its share, with all that come before it at theirs, is above it.
MIXTURE = rf"""
WITH rows AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{TAG}:{SEED}:' || doc_id), 1, 13))::BIGINT AS bits
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM rows GROUP BY source),
weighed AS (
  SELECT *, {TURN}::BIGINT AS w, {MOST_REPEATS} * source_size AS most,
    row_number() OVER (ORDER BY {MOST_REPEATS} * source_size::DOUBLE / {TURN}, place) AS turn
  FROM sources),
shared AS (
  SELECT *,
    (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::BIGINT AS words,
    (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS weights
  FROM weighed
  WINDOW before AS (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (
  SELECT *, (words * w)::DOUBLE / weights::DOUBLE > most AS above FROM shared),
counted AS (
  SELECT *, count(*) FILTER (above) OVER () AS n_above FROM judged),
first_below AS (
  SELECT max(words) AS words, max(weights) AS weights FROM counted WHERE turn = n_above + 1),
goals AS (
  SELECT source, source_size,
    CASE WHEN turn <= n_above THEN most::DOUBLE
      ELSE (f.words * w)::DOUBLE / f.weights::DOUBLE END AS target
  FROM counted, first_below f),
along AS (
  SELECT r.doc_id, r.size, g.source_size, g.target,
    CASE WHEN g.source_size = 0 THEN 0
      ELSE least(floor(g.target / g.source_size)::BIGINT, {MOST_REPEATS}) END AS repeats,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.bits) AS upto
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * (repeats + (upto <= target - repeats * source_size)::INTEGER))::BIGINT AS taken
FROM along
"""


BLANKLESS = r"[^\x20\x09-\x0D]+"

# Every window as one string under its smallest id; a word goes if one starts at most 49 words before.
SUBSTRINGS = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '{BLANKLESS}'), []) AS words FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - {WINDOW} + 2)) AS place,
    words FROM docs WHERE len(words) >= {WINDOW}),
named AS (
  SELECT doc_id, place, md5(array_to_string(words[place : place + {WINDOW} - 1], ' ')) AS seen FROM windows),
firsts AS (SELECT seen, min(doc_id) AS first FROM named GROUP BY seen),
hits AS (
  SELECT n.doc_id, n.place FROM named n JOIN firsts f ON n.seen = f.seen AND f.first < n.doc_id),
words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs),
along AS (
  SELECT w.doc_id, w.word, w.place, max(h.place) OVER (
    PARTITION BY w.doc_id ORDER BY w.place ROWS BETWEEN {WINDOW} - 1 PRECEDING AND CURRENT ROW) AS hit
  FROM words w LEFT JOIN hits h ON w.doc_id = h.doc_id AND w.place = h.place),
kept AS (
  SELECT doc_id, count(hit) AS n_removed,
    string_agg(word, ' ' ORDER BY place) FILTER (hit IS NULL) AS kept
  FROM along GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

# crc32 of a text of ASCII characters, bit by bit.
def crc(text: str) -> str:
    return f"""
xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    range(8 * length({text})),
    lambda i: ((ascii(substr({text}, (i // 8 + 1)::INTEGER, 1)) >> (i % 8)::INTEGER) & 1)::BIGINT)),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))::BIGINT
"""


# Five equal words at two places of a text lie on the diagonal of their lag; neighbours on it are one stretch.
PERIODIC = rf"""
WITH read AS (
  SELECT doc_id, {crc('doc_id::VARCHAR')} AS h, coalesce(regexp_extract_all(text, '{BLANKLESS}'), []) AS words FROM documents),
marked AS (
  SELECT doc_id, words, len(words) AS n, h // 10 AS g, h % 10 = 0 AND len(words) > 0 AS plants FROM read),
placed AS (
  SELECT *, CASE WHEN plants THEN g % n END AS a,
    CASE WHEN plants THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM marked),
docs AS (
  SELECT doc_id, n, CASE WHEN plants THEN list_transform(range(n), lambda i:
    words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE words END AS words FROM placed),
grams AS (
  SELECT doc_id, place, array_to_string(words[place + 1 : place + 5], ' ') AS gram, n
  FROM (SELECT doc_id, words, n, unnest(range(n - 4)) AS place FROM docs WHERE n >= 6)),
pairs AS (
  SELECT a.doc_id, a.place, b.place - a.place AS lag FROM grams a JOIN grams b
    ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.place > a.place AND 4 * (b.place - a.place) <= a.n),
stretches AS (
  SELECT doc_id, min(place) AS start, count(*) + 4 + lag AS length, lag AS period
  FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id, lag ORDER BY place) AS island FROM pairs)
  GROUP BY doc_id, lag, island HAVING count(*) + 4 + lag >= greatest(6, 4 * lag)),
runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM stretches o WHERE o.doc_id = s.doc_id AND o.period < s.period
      AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
listed AS (
  SELECT doc_id, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id),
best AS (
  SELECT * FROM runs a WHERE NOT EXISTS (
    SELECT 1 FROM runs b WHERE b.doc_id = a.doc_id AND (b.length * a.period > a.length * b.period
      OR (b.length * a.period = a.length * b.period AND (b.start, b.period) < (a.start, a.period))))),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS place FROM docs),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS place FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.place) AS kept
  FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.place = g.place GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length,
  b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
  sha256(coalesce(l.listed, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id
LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


# The rows of a conversation are read one after the other. A way so far ends in a state of the grammar,
# with its cost and audit; of the ways of a state only the best goes on. Between two rows a way may
# insert up to two turns: two more would come back to the same state.
STEPS = """(VALUES ('start', 'u', 'I'), ('s', 'u', 'I'), ('u', 'a', 'I'), ('a', 'u', 'I'),
    ('start', 'a', 'II'), ('s', 'a', 'II'))"""
CONVERSATIONS = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (SELECT *, {crc('name')} % 20 AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
faulty AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE
    WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
figures AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, 'start' AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM figures
  UNION ALL
  SELECT conv_id, i, state, min({{'cost': cost, 'audit': audit}}) FROM (
    WITH waiting AS (
      SELECT conv_id, i, state, best.cost AS cost, best.audit AS audit FROM ways
      UNION ALL
      SELECT conv_id, i, s.after, best.cost + 3 * length(s.edits), best.audit || s.edits
      FROM ways JOIN {STEPS} s(before, after, edits) ON state = s.before)
    SELECT w.conv_id, w.i + 1 AS i, e.after AS state, w.cost + CASE
        WHEN e.edit = 'D' THEN 4 ELSE 3 * (e.edit = 'R')::INTEGER + 3 * (coalesce(f.fault, '') = 'truncated')::INTEGER END AS cost,
      w.audit || e.edit AS audit
    FROM waiting w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1
    JOIN (VALUES ('start', 'start', 'D', ''), ('s', 's', 'D', ''), ('u', 'u', 'D', ''), ('a', 'a', 'D', ''),
      ('start', 's', 'K', 's'), ('start', 'u', 'K', 'u'), ('s', 'u', 'K', 'u'), ('a', 'u', 'K', 'u'), ('u', 'a', 'K', 'a'),
      ('start', 'u', 'R', ''), ('s', 'u', 'R', ''), ('a', 'u', 'R', ''), ('u', 'a', 'R', ''))
      e(before, after, edit, initial) ON e.before = w.state
      AND (e.edit = 'D' OR coalesce(f.fault, '') NOT IN ('blank', 'duplicate')) AND (e.initial = '' OR e.initial = f.initial))
  GROUP BY conv_id, i, state),
ended AS (
  SELECT w.conv_id, state, best.cost AS cost, best.audit AS audit
  FROM ways w JOIN figures f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.n),
answers AS (
  SELECT conv_id, min({{'cost': cost, 'audit': audit}}) AS best FROM (
    SELECT conv_id, state, cost, audit FROM ended UNION ALL
    SELECT conv_id, s.after, cost + 3 * length(s.edits), audit || s.edits
    FROM ended JOIN {STEPS} s(before, after, edits) ON state = s.before)
  WHERE state IN ('start', 'a') GROUP BY conv_id),
edits AS (
  SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS k FROM answers),
numbered AS (
  SELECT conv_id, k, substr(audit, k, 1) AS edit,
    length(replace(substr(audit, 1, k), 'I', '')) AS i,
    length(replace(substr(audit, 1, k), 'D', '')) - length(replace(audit, 'D', '')) % 2 AS place FROM edits),
written AS (
  SELECT n.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole
  FROM numbered n LEFT JOIN faulty f ON n.conv_id IS NOT DISTINCT FROM f.conv_id AND n.i = f.i AND edit <> 'I'
  WHERE edit <> 'D' GROUP BY n.conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank,
  coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
  coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(a.best.cost, 0)::BIGINT AS cost,
  coalesce(a.best.audit, '') AS audit, sha256(coalesce(w.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN answers a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN written w ON c.conv_id IS NOT DISTINCT FROM w.conv_id
"""


def statements() -> dict[str, str]:
    return {"op6_mixture": MIXTURE, "op11_substrings": SUBSTRINGS, "op12_conversations": CONVERSATIONS, "op13_periodic": PERIODIC}

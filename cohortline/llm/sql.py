"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

SPACES = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')"


def mixing(levels: tuple[str, ...], weights: dict[str, dict[str, int]], max_epochs: int, seed: int) -> str:
    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{name}' THEN {w}" for name, w in weights.get(level, {}).items())
        return f"(CASE{cases} ELSE 1 END)" if cases else "1"

    steps, given = [], None
    for depth in range(1, len(levels) + 1):
        path, parent = ", ".join(levels[:depth]), ", ".join(levels[: depth - 1])
        family = f"PARTITION BY {parent}" if parent else "PARTITION BY 1"
        budget = f"(SELECT {path}, capacity, weight, budget FROM n{depth} JOIN {given} USING ({parent}))" if given else f"(SELECT *, total AS budget FROM n{depth}, whole)"
        order = f"{family} ORDER BY capacity::DOUBLE / weight, {levels[depth - 1]}"
        steps.append(f"""
n{depth} AS (SELECT {path}, (sum(tokens) * {max_epochs})::BIGINT AS capacity, {weight(levels[depth - 1])} AS weight FROM leaf GROUP BY {path}),
o{depth} AS (
  SELECT *, sum(weight) OVER ({family}) - coalesce(sum(weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left,
    budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_left FROM {budget}),
c{depth} AS (SELECT *, capacity * w_left <= weight * b_left AS short FROM o{depth}),
r{depth} AS (
  SELECT *, budget - sum(CASE WHEN short THEN capacity ELSE 0 END) OVER ({family}) AS b_rest,
    sum(CASE WHEN short THEN 0 ELSE weight END) OVER ({family}) AS w_rest,
    sum(CASE WHEN short THEN 0 ELSE weight END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS w_upto FROM c{depth}),
s{depth} AS (
  SELECT {path}, (CASE WHEN short THEN capacity ELSE (b_rest * w_upto) // w_rest - (b_rest * (w_upto - weight)) // w_rest END)::BIGINT AS budget FROM r{depth})""")
        given = f"s{depth}"
    path = ", ".join(levels)
    return f"""
WITH named AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS number, len({WORDS})::BIGINT AS n_tokens FROM documents),
d AS (
  SELECT *, CASE WHEN number = 0 THEN 'crawl' WHEN number < 10 THEN 'reference' ELSE 'community' END AS domain FROM named),
leaf AS (SELECT {path}, count(*) AS n_docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY {path}),
whole AS (SELECT sum(tokens)::BIGINT AS total FROM leaf),{",".join(steps)},
plan AS (
  SELECT {path}, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS whole_epochs,
    CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest FROM leaf JOIN {given} USING ({path})),
placed AS (
  SELECT *, ('0x' || substr(md5('{seed}:' || whole_epochs || ':' || doc_id), 1, 15))::BIGINT AS place FROM d JOIN plan USING ({path})),
summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY {path} ORDER BY place, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, epoch, n_tokens AS take_tokens FROM (
  SELECT *, unnest(range(whole_epochs)) AS epoch FROM placed)
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, whole_epochs AS epoch, least(n_tokens, rest - before)::BIGINT AS take_tokens
FROM summed WHERE before < rest"""


EXACT_DEDUP = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)"""

QUALITY_RULES = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NO_SPACE}')) AS ls FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
repeated AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM repeated WHERE n > 1) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, len(ls) AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS capitals,
    coalesce(list_sum(list_transform(range(1, len(ws)), lambda i: (ws[i] = ws[i + 1])::INTEGER)), 0) AS stutter
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * stutter > 3 * n_words
    OR 10 * capitals > 4 * letters OR 2 * letters < word_chars) AS kept
FROM judged"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE_HEX = "('0x' || substr(hex, 5 * k + 1, 5))::BIGINT"
_FOUR = " || ".join(f"substr('{_LETTERS}', (({_FIVE_HEX} >> {shift}) & 31)::INTEGER + 1, 1)" for shift in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS original FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: {_FOUR}), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM m"""

# The CRC-32 of the 16 half bytes, least significant bit first.
_NIBBLES = (
    "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, "
    "3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
)


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8 bytes, half a byte at a time."""
    data = f"hex(encode({text}))"
    nibbles = f"list_transform(range(len({data}) // 2), lambda i: ('0x' || substr({data}, 2 * i + 1, 2))::BIGINT)"
    half = "xor({c} >> 4, {t}[({c} & 15) + 1])"
    first = half.format(c="xor(c, b)", t=_NIBBLES)
    return f"xor(list_reduce({nibbles}, lambda c, b: {half.format(c=f'({first})', t=_NIBBLES)}, 4294967295), 4294967295)"


SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
chunks AS (
  SELECT doc_id, c, least(n_bytes - 399 - c, 1000) AS n, substr(h, 2 * c + 1, 2798) AS part FROM (SELECT *, unnest(range(0, n_bytes - 399, 1000)) AS c FROM d)),
w AS (SELECT doc_id, c + i AS i, md5_number(substr(part, 2 * i + 1, 800)) AS code FROM (SELECT *, unnest(range(0, n)) AS i FROM chunks)),
twice AS (SELECT code FROM w GROUP BY code HAVING count(*) > 1),
found AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 AS apart FROM w SEMI JOIN twice USING (code)),
islands AS (SELECT doc_id, i, count(*) FILTER (apart) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM found),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM islands GROUP BY doc_id, island),
listed AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY doc_id),
edges AS (
  SELECT d.*, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
    list_concat([0], coalesce(ends, [])) AS open, list_append(coalesce(starts, []), n_bytes) AS shut FROM d LEFT JOIN listed USING (doc_id))
SELECT doc_id, n_bytes, n_removed, n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(open) + 1), lambda k: substr(h, 2 * open[k] + 1, 2 * (shut[k] - open[k]))), ''))) AS kept_sha256
FROM edges"""

# States: 0 nothing yet, 1 after the system's turn, 2 after the user's, 3 after the assistant's.
CONVERSATIONS = rf"""
WITH RECURSIVE named AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("name")} % 20 AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS initial,
    regexp_extract(text, '({NO_SPACE}){SPACES.replace("+", "*")}$', 1) AS ending FROM damaged),
faulty AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
inserts(state, letters, price, here, lines) AS (VALUES
  (0, '', 0, 0, ''), (0, 'I', 5, 2, 'user:'), (0, 'II', 10, 3, 'user:' || chr(10) || 'assistant:'),
  (1, '', 0, 1, ''), (1, 'I', 5, 2, 'user:'), (1, 'II', 10, 3, 'user:' || chr(10) || 'assistant:'),
  (2, '', 0, 2, ''), (2, 'I', 5, 3, 'assistant:'), (2, 'II', 10, 2, 'assistant:' || chr(10) || 'user:'),
  (3, '', 0, 3, ''), (3, 'I', 5, 2, 'user:'), (3, 'II', 10, 3, 'user:' || chr(10) || 'assistant:')),
follows(here, initial, onward) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
fillers(here, name, onward) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
edits AS (
  SELECT f.conv_id, f.i, s.state, s.letters || 'D' AS letters, s.price + 2 AS price, s.here AS onward, s.lines
  FROM faulty f CROSS JOIN inserts s
  UNION ALL
  SELECT f.conv_id, f.i, s.state, s.letters || 'K', s.price + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, g.onward,
    s.lines || CASE s.lines WHEN '' THEN '' ELSE chr(10) END || role || ':' || text
  FROM faulty f CROSS JOIN inserts s JOIN follows g ON g.here = s.here AND g.initial = f.initial WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT f.conv_id, f.i, s.state, s.letters || 'R', s.price + 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, g.onward,
    s.lines || CASE s.lines WHEN '' THEN '' ELSE chr(10) END || g.name || ':' || text
  FROM faulty f CROSS JOIN inserts s JOIN fillers g ON g.here = s.here WHERE fault NOT IN ('blank', 'duplicate')),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS best FROM (SELECT DISTINCT conv_id FROM faulty)
  UNION ALL
  SELECT p.conv_id, p.i + 1, e.onward, min({{'cost': best.cost + e.price, 'audit': best.audit || e.letters,
    'lines': best.lines || CASE WHEN best.lines = '' OR e.lines = '' THEN '' ELSE chr(10) END || e.lines}})
  FROM steps p JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.state = p.state GROUP BY ALL),
ends AS (
  SELECT s.conv_id, min({{'cost': best.cost + n.price, 'audit': best.audit || n.letters,
    'lines': best.lines || CASE WHEN best.lines = '' OR n.lines = '' THEN '' ELSE chr(10) END || n.lines}}) AS best
  FROM steps s JOIN inserts n ON n.state = s.state AND (n.here = 3 OR n.state = 0 AND n.letters = '')
  WHERE s.i = (SELECT max(i) FROM faulty f WHERE f.conv_id IS NOT DISTINCT FROM s.conv_id) GROUP BY s.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""


def _runs(table: str, columns: str) -> str:
    """Every run of one to three words of a table's texts, a row each."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))"
    return f"SELECT {columns}, unnest({runs}) AS run FROM (SELECT *, {words} AS ws FROM {table})"


IMPORTANCE = rf"""
WITH source AS MATERIALIZED ({_runs("documents", "doc_id")}),
target AS MATERIALIZED ({_runs("benchmark", "item_id")}),
codes AS MATERIALIZED (SELECT run, {_crc32("run")} % 10000 AS bucket FROM (SELECT run FROM source UNION SELECT run FROM target)),
s AS (SELECT bucket, count(*) AS s FROM source JOIN codes USING (run) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN codes USING (run) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM source) + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM source JOIN codes USING (run) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
-- A text of n words has 3 n - 3 runs, from two words on.
numbered AS (
  SELECT *, n_features >= 57 AS open, row_number() OVER (PARTITION BY n_features >= 57 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND place <= 5 * (SELECT count(*) FROM numbered WHERE open) // 100 THEN place END AS rank
FROM numbered"""

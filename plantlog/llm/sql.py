"""DuckDB SQL of the queries that SQL can express, written from the contract."""

from plantlog.llm import licences
from plantlog.llm.mixing import SEED
from plantlog.llm.quality_rules import PHRASES, RULES

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {WORDS.format('t')} AS ws FROM d),
g AS (SELECT rid, i, len(ws) AS n, CASE WHEN i + 7 <= len(ws)
             THEN array_to_string(ws[i:i + 7], ' ') END AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
f AS (SELECT rid, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1 AS again FROM g),
c AS (SELECT rid, bool_or(again) OVER (PARTITION BY rid ORDER BY i
             ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM f),
r AS (SELECT rid, count(*) FILTER (inside) AS n_repeat FROM c GROUP BY rid),
l AS (SELECT rid, k, line, {WORDS.format('line')} AS lw FROM (
        SELECT rid, unnest(string_split(t, chr(10))) AS line,
               unnest(range(1, len(string_split(t, chr(10))) + 1)) AS k FROM d)),
m AS (SELECT rid, line, len(lw) AS n,
             len(list_filter(lw, lambda x: right(x, 1) = '!')) AS exclaims,
             length(line) - length(translate(line, '#*$%&|<>', '')) AS symbols,
             length(line) - length(replace(line, '|', '')) AS pipes,
             length(array_to_string(lw, '')) AS chars,
             unicode(right(lw[-1], 1)) > 127
               OR contains('.!?:;"'')]' || chr(125), right(lw[-1], 1)) AS closes,
             regexp_matches(line, '(?i){'|'.join(PHRASES)}') AS stock,
             row_number() OVER (PARTITION BY rid, line ORDER BY k) > 1 AS repeated
      FROM l WHERE len(lw) > 0),
s AS (SELECT rid, chars, repeated, repeated OR stock
             OR 100 * exclaims > {RULES.exclaim_pct} * n OR 100 * symbols > {RULES.symbol_pct} * n
             OR 100 * pipes > {RULES.separator_pct} * n
             OR (NOT closes AND n < {RULES.short_words}) AS failed FROM m),
a AS (SELECT rid, count(*) FILTER (repeated) AS dups, count(*) FILTER (failed) AS gone,
             coalesce(sum(chars) FILTER (failed), 0) AS lost FROM s GROUP BY rid),
j AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             coalesce(dups, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
             coalesce(lost, 0) AS lost, coalesce(gone, 0) AS n_lines_removed
      FROM w LEFT JOIN r USING (rid) LEFT JOIN a USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {RULES.max_lost_pct} * word_chars AS kept, n_lines_removed
FROM b"""

MIXING = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size,
         CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 13) AS BIGINT) AS draw
  FROM documents),
s AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (
         ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         CAST(3 * sum(size) AS DOUBLE) AS cap FROM d GROUP BY source),
t(step, level) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT step + 1, nxt FROM (
    SELECT step, level, (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (weight * level >= cap), 0))
                         / sum(weight) FILTER (weight * level < cap) FROM s) AS nxt FROM t)
  WHERE nxt > level),
g AS (SELECT source, source_size, least(weight * (SELECT max(level) FROM t), cap) AS target FROM s),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
k AS (SELECT *, CASE WHEN source_size > 0 THEN (target / source_size - whole) * source_size
                ELSE 0 END AS goal FROM h),
r AS (SELECT d.*, k.source_size, k.target, k.whole, k.goal, coalesce(sum(size) OVER (
        PARTITION BY d.source ORDER BY draw, doc_id NULLS FIRST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN running < goal
         AND running + size / 2 <= goal THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r"""

TOP_K = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
   AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.uid <> c.uid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def _canonical(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    t = rf"regexp_replace({t}, '{licences.COPYRIGHT_LINE}', chr(10), 'g')"
    t = rf"' ' || trim(regexp_replace({t}, '{licences.PUNCTUATION}', ' ', 'g')) || ' '"
    for spelling, same in licences.EQUAL_SPELLINGS:
        for _ in range(2):
            t = f"replace({t}, ' {spelling} ', ' {same} ')"
    return f"trim({t})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LICENCES = f"""
WITH known(name, txt) AS (VALUES {', '.join(f'({_quoted(n)}, {_quoted(t)})' for n, t in licences.KNOWN.items())}),
k AS MATERIALIZED (SELECT c, string_agg(name, ', ' ORDER BY name) AS names
      FROM (SELECT name, {_canonical('txt')} AS c FROM known) GROUP BY c),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, {_canonical('text')} AS c FROM d),
l AS (SELECT DISTINCT rid, names FROM (
        SELECT rid, {_canonical('line')} AS c
        FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)) JOIN k USING (c)),
n AS (SELECT rid, string_agg(names, ', ' ORDER BY names) AS notices FROM l GROUP BY rid)
SELECT doc_id, CASE WHEN w.c <> '' THEN sha256(w.c) END AS text_digest, k.names AS licence,
       coalesce(notices, '') AS notices
FROM w LEFT JOIN k ON w.c = k.c AND w.c <> '' LEFT JOIN n USING (rid)"""

_CRC_STEP = "xor(a >> 1, 3988292384 * (a & 1))"
MERKLE = f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
         lambda a, b: {_CRC_STEP})) AS tab),
f AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, doc_id, lang, n_chars IS NOT NULL AND doc_id IS NOT NULL AND xor(4294967295,
         list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
         lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 7 = 0 AS touched,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS own,
         strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) AS more,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents, crc),
l AS MATERIALIZED (
  SELECT uid, doc_id, lang, sha256(head || own || tail) AS leaf,
         sha256(head || CASE WHEN touched THEN more ELSE own END || tail) AS seen FROM f),
p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM l),
t(lang, level, pos, n, hash) AS (
  SELECT lang, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT lang, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(hash, '' ORDER BY pos))
  FROM t WHERE n > 1 GROUP BY lang, level, pos // 2),
nodes AS MATERIALIZED (SELECT * FROM t),
s AS MATERIALIZED (
  SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
u(level, pos, n, hash) AS (
  SELECT 0, pos, n, subroot FROM s
  UNION ALL
  SELECT level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(hash, '' ORDER BY pos))
  FROM u WHERE n > 1 GROUP BY level, pos // 2),
tops AS MATERIALIZED (SELECT * FROM u),
w(uid, lang, level, pos, n, value, proof) AS (
  SELECT uid, lang, 0, pos, n, seen, '' FROM p
  UNION ALL
  SELECT w.uid, w.lang, w.level + 1, w.pos // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.pos % 2 = 1 THEN coalesce(o.hash, '') || value ELSE value || coalesce(o.hash, '') END),
         proof || coalesce(o.hash, '')
  FROM w LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM w.lang AND o.level = w.level AND o.pos = xor(w.pos, 1)
  WHERE w.n > 1),
x(uid, lang, level, pos, n, value, proof) AS (
  SELECT uid, w.lang, 0, s.pos, s.n, value, proof FROM w JOIN s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT x.uid, x.lang, x.level + 1, x.pos // 2, (x.n + 1) // 2,
         sha256(CASE WHEN x.pos % 2 = 1 THEN coalesce(o.hash, '') || value ELSE value || coalesce(o.hash, '') END),
         proof || coalesce(o.hash, '')
  FROM x LEFT JOIN tops o ON o.level = x.level AND o.pos = xor(x.pos, 1)
  WHERE x.n > 1)
SELECT p.doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, value AS folded_root, value = hash AS verified
FROM p JOIN x USING (uid) JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN tops ON tops.n = 1
WHERE x.n = 1"""

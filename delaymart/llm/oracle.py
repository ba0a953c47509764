"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP4 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

# Places in the order by (text hash, id), cut into 40 equal parts of bytes; the
# CRC-32 table follows from its polynomial.
OP1 = """
WITH t AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS crc
  FROM range(256) r(i)),
b AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS key,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
c AS (
  SELECT doc_id, size, key, xor(list_reduce(list_prepend(4294967295, bytes),
           lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM b, t),
p AS (
  SELECT *, least(floor((sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT
                         - size / 2.0::DOUBLE) * 40 / (sum(size) OVER ())::BIGINT), 39)::INT AS shard
  FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM p
"""

# Near lines by their definition: equal variants at one place, or a line that is
# another's variant, over the words themselves.
OP5 = """
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM l),
g AS (SELECT w, len(w) AS n, min(row(doc_id IS NULL, doc_id, line_no)) AS first FROM f WHERE len(w) > 0 GROUP BY w),
v AS (SELECT w, n, first, place, list_concat(w[1:place - 1], w[place + 1:]) AS part
      FROM (SELECT *, unnest(range(1, n + 1)) AS place FROM g WHERE n >= 5)),
swap AS (SELECT w, min(first) OVER (PARTITION BY n, place, part) AS best FROM v),
gap AS (SELECT v.w, min(g.first) AS best FROM v JOIN g ON v.part = g.w WHERE g.n >= 5 GROUP BY v.w
        UNION ALL
        SELECT g.w, min(v.first) FROM v JOIN g ON v.part = g.w WHERE g.n >= 5 GROUP BY g.w),
b AS (SELECT w, min(best) AS best FROM (SELECT * FROM swap UNION ALL SELECT * FROM gap
                                        UNION ALL SELECT w, first FROM g) GROUP BY w)
SELECT doc_id, line_no, len(f.w)::INT AS n_words,
       CASE WHEN len(f.w) > 0 THEN best[2] ELSE doc_id END AS keep_id,
       (CASE WHEN len(f.w) > 0 THEN best[3] ELSE line_no END)::INT AS keep_line,
       coalesce(best = row(doc_id IS NULL, doc_id, line_no), true) AS kept
FROM f LEFT JOIN b ON f.w = b.w
"""

# The plain form of mixing.py: the same ranks over whole sources. ``level`` is
# the water-filling level; a round takes the longest prefix, in rank order, of
# the rows that are not taken yet and fit into what is left.
# Rounds in which nothing fits any more change nothing.
_ROUNDS = 16
_ROUND = """
c{k} AS (
  SELECT c.*, room{k} - coalesce(max(CASE WHEN fits AND upto <= room{k} THEN upto END)
                                 OVER (PARTITION BY c.source), 0) AS room{j},
         took OR coalesce(fits AND upto <= room{k}, false) AS took_
  FROM (SELECT *, NOT took AND size > 0 AND size <= room{k} AS fits,
               sum(CASE WHEN NOT took AND size > 0 AND size <= room{k} THEN size END)
                 OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS upto
        FROM {prev}) c),
d{k} AS (SELECT doc_id, source, size, source_size, target, rate, rank, room{j}, took_ AS took FROM c{k})"""

OP9 = f"""
WITH s AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             2.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM t),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, CASE WHEN cap / w <= level THEN cap ELSE w *
        (SELECT arg_min(level, cap / w) FROM l WHERE NOT (cap / w <= level)) END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g),
u AS (SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.rate, r.rate - floor(r.rate) AS f,
             (('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, 'null') || ':mix'), 1, 13))::BIGINT + 0.5::DOUBLE)
               / 4503599627370496.0::DOUBLE AS u
      FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, u / (1.0::DOUBLE - u) / (f / (1.0::DOUBLE - f)) AS q FROM u),
d AS (SELECT doc_id, source, size, source_size, target, rate,
             CASE WHEN f > 0 THEN q / (1.0::DOUBLE + q) ELSE 1.0 END AS rank,
             target - floor(rate) * source_size AS room0, false AS took FROM q),
{",".join(_ROUND.format(k=k, j=k + 1, prev="d" if k == 0 else f"d{k - 1}") for k in range(_ROUNDS))}
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN floor(rate)::BIGINT + took::BIGINT ELSE 0 END * size)::BIGINT AS taken
FROM d{_ROUNDS - 1}
"""

# The filters are applied to every order's prefixes as sets, cell by cell.
OP12 = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT concat(a.x, b.x, d.x, e.x, g.x) AS filter_order, [a.bit, b.bit, d.bit, e.bit, g.bit] AS bits
      FROM f a, f b, f d, f e, f g WHERE a.bit + b.bit + d.bit + e.bit + g.bit = 31
      AND len(list_distinct([a.x, b.x, d.x, e.x, g.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
      FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""

# Every phrase of one to four words counted on its own.
OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT lang, a AS most, unnest(flatten(list_transform(range(2, k), lambda j: list_transform(range(1, k - j + 2),
        lambda i: array_to_string(w[i:i + j - 1], ' '))))) AS phrase FROM c WHERE k > 2),
i AS (SELECT lang, phrase, max(most) AS most FROM x GROUP BY lang, phrase),
t AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS p1, array_to_string(w[cut + 1:], ' ') AS p2
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT t.lang, t.phrase, a, cut, f1.f AS l, f2.f AS r, ((a::HUGEINT * 2000000) // (f1.f + f2.f))::BIGINT AS score
      FROM t JOIN f f1 ON f1.lang = t.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = t.lang AND f2.phrase = p2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
      WHERE most IS NULL OR 100 * most < 80 * a),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM d)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op1_sharding": OP1,
    "op4_exact_dedup": OP4,
    "op5_line_dedup": OP5,
    "op9_mix_sources": OP9,
    "op12_filter_audit": OP12,
    "op13_phrase_mining": OP13,
}

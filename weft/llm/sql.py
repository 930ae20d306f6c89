"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import secret_scan

#: CRC-32 of a string: one step per byte, with the table made from its rule.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor(3988292384, {0} >> 1) ELSE {0} >> 1 END"


def _crc_table() -> str:
    e = "x"
    for k in range(8):
        e = f"list_transform({'[' + 'i::BIGINT' + ']' if k == 0 else e}, lambda v{k}: {_STEP.format(f'v{k}')})"
    return f"(SELECT list(({e})[1] ORDER BY i) FROM range(256) r(i))"


CRC = f"""crc_table AS (SELECT {_crc_table()} AS t),
crc_of AS (SELECT txt, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, b + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
    lambda a, c: xor(a >> 8, t[xor(a & 255, c) + 1]))) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS txt, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS b FROM documents), crc_table)"""

SHARDS = f"""WITH {CRC},
base AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, crc AS text_crc32,
    md5('17|' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents JOIN crc_of ON txt = coalesce(text, '')),
own AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, text_crc32, size) - 1)::DOUBLE
    / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS f FROM base),
placed AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS LAST, h, text_crc32, size) - 1 AS pos,
    count(*) OVER () AS n FROM own)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 8 // n)::INT AS shard,
    pos - ((pos * 8 // n) * n + 7) // 8 AS slot, NULL::INT AS grown_shard FROM placed"""

MIXING = r"""WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('23|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap FROM base GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM per),
steps AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM weighed),
unit AS (SELECT arg_min((total - used) / open, cap / w) FILTER ((total - used) / open <= cap / w) AS unit FROM steps),
goal AS (SELECT source, source_size, least(w * unit, cap) AS target,
    CASE WHEN source_size > 0 THEN least(w * unit, cap) / source_size ELSE 0 END AS rate FROM steps, unit)
SELECT doc_id, size, source_size, target,
    (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base JOIN goal ON base.source IS NOT DISTINCT FROM goal.source"""

#: Words, 3-word windows and lines of whole texts; a line's documents are counted by text.
LINE_RULES = r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS ls FROM docs),
windows AS (SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g,
    unnest(range(1, len(w) - 1)) AS i FROM split),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(3) s(k) GROUP BY r),
lines AS (SELECT r, host, text, unnest(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM split),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
norms AS (SELECT r, host, text, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM lines),
often AS (SELECT host, line FROM norms GROUP BY host, line HAVING count(DISTINCT text) > 30),
removed AS (SELECT r, sum(len(string_split(line, ' ')))::BIGINT AS n FROM norms JOIN often USING (host, line) GROUP BY r),
counted AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words
  FROM split LEFT JOIN covered USING (r) LEFT JOIN dups USING (r) LEFT JOIN removed USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_words - n_removed_words >= n_words * 0.5::DOUBLE AS kept FROM failed"""

_KINDS = [k[0] for k in (*secret_scan.BASE, *secret_scan.CLASSES)]


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _base(kind: str, pattern: str, group: int, least: int) -> str:
    size = f"length(regexp_extract(m, {_quote(pattern)}, {group}))" if group else "length(m)"
    return f"""SELECT r, {_quote(kind)} AS kind, before + sum(len(g)) OVER w AS start, before + sum(len(g)) OVER w + length(m) AS stop,
      m, {size} >= {least} AS ok FROM (SELECT r, m, g, k, coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
      SELECT r, unnest(regexp_extract_all(text, {_quote(pattern)})) AS m, unnest(list_resize(regexp_split_to_array(text, {_quote(pattern)}),
        len(regexp_extract_all(text, {_quote(pattern)})))) AS g, unnest(range(len(regexp_extract_all(text, {_quote(pattern)})))) AS k FROM docs))
      WINDOW w AS (PARTITION BY r ORDER BY k)"""


def _class(kind: str, alphabet: str, width: int, bits: float) -> str:
    pattern = "[" + alphabet.replace("-", "") + ("-" if "-" in alphabet else "") + "]{%d,}" % width
    sums = f"list_sum(list_transform(list_distinct(c), lambda x: {secret_scan.terms(width)}[len(list_filter(c, lambda y: y = x)) + 1]))"
    allowed = " OR ".join(f"regexp_full_match(m, {_quote(a)})" + (f" AND NOT regexp_matches(m, {_quote(b)})" if b else "")
                          for a, b in secret_scan.ALLOWED)
    return f"""SELECT r, {_quote(kind)} AS kind, min(p) AS start, max(p) + {width} AS stop FROM (
      SELECT *, sum(CASE WHEN p > before + {width} THEN 1 ELSE 0 END) OVER (PARTITION BY r, start ORDER BY p) AS part FROM (
        SELECT *, lag(p, 1, p) OVER (PARTITION BY r, start ORDER BY p) AS before FROM (
          SELECT r, start, start + o AS p, string_split(m[o + 1:o + {width}], '') AS c FROM (
            SELECT r, start, m, unnest(range(length(m) - {width} + 1)) AS o FROM ({_base(kind, pattern, 0, width)}) WHERE NOT ({allowed})))
        WHERE {sums} <= {secret_scan.most_sum(width, bits)})) GROUP BY r, start, part"""


SECRETS = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED (SELECT r, kind, start, stop FROM ({' UNION ALL '.join(_base(*b) for b in secret_scan.BASE)}) WHERE ok),
extra AS MATERIALIZED ({' UNION ALL '.join(_class(*c) for c in secret_scan.CLASSES)}),
spans AS (SELECT *, true AS b FROM base UNION ALL SELECT *, false FROM extra e WHERE NOT EXISTS (
    SELECT 1 FROM base WHERE base.r = e.r AND base.start <= e.start AND e.stop <= base.stop)),
said AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, list_position({_KINDS}, kind)) FILTER (b) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, list_position({_KINDS}, kind)) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN said USING (r)"""

CHUNKS = r"""WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM docs),
words AS (SELECT *, row_number() OVER d - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS m,
    ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 AS long
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
rolled AS (SELECT *, h + 31 * coalesce(lag(h) OVER d, 0) AS r, coalesce(lag(long) OVER d, true) AS long_before,
    coalesce(lead(long) OVER d, true) AS long_after, coalesce(lead(long, 2) OVER d, true) AS long_later
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
ended AS (SELECT *, k = m - 1 OR long OR long_after OR (NOT long_before AND NOT long_later
    AND coalesce(r < lag(r) OVER d AND r <= lead(r) OVER d, false)) AS ends FROM rolled WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ended),
chunks AS (SELECT doc_id, pos, list(i ORDER BY i) AS nums, list(line ORDER BY i) AS ll, string_agg(line, chr(10) ORDER BY i) AS bytes,
    count(*) > 1 OR bool_or(long) OR any_value(m) = 1 AS compared FROM numbered GROUP BY doc_id, pos),
sided AS (SELECT *, lag(nums) OVER d AS nums_before, lag(ll) OVER d AS before, lead(nums) OVER d AS nums_after, lead(ll) OVER d AS after
  FROM chunks WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
firsts AS (SELECT * FROM sided WHERE compared QUALIFY row_number() OVER (PARTITION BY bytes ORDER BY doc_id, pos) = 1),
later AS (SELECT s.*, f.before AS f_before, f.after AS f_after FROM sided s JOIN firsts f USING (bytes)
  WHERE s.compared AND (s.doc_id, s.pos) <> (f.doc_id, f.pos)),
met AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(before), len(f_before)) + 1),
      lambda j: before[len(before) - j + 1:] = f_before[len(f_before) - j + 1:])), 0) AS lead,
    coalesce(list_max(list_filter(range(1, least(len(after), len(f_after)) + 1), lambda j: after[1:j] = f_after[1:j])), 0) AS trail FROM later),
gone AS (SELECT DISTINCT doc_id, CASE WHEN lead > 0 THEN nums_before[len(nums_before) - lead + 1] ELSE nums[1] END AS start,
    CASE WHEN trail > 0 THEN nums_after[trail] ELSE nums[-1] END + 1 AS stop FROM met),
cut AS (SELECT DISTINCT doc_id, unnest(range(start, stop)) AS i FROM gone),
counted AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id),
per AS (SELECT doc_id, string_agg(start || ':' || stop, ',' ORDER BY start, stop) AS removed FROM gone GROUP BY doc_id),
stay AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN cut USING (doc_id, i)
  GROUP BY doc_id HAVING bool_or(regexp_matches(line, '[^\x20\x09-\x0D]')))
SELECT d.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(counted.n, 0)::BIGINT AS n_removed_lines, coalesce(removed, '') AS removed,
    CASE WHEN per.removed IS NULL THEN d.text ELSE coalesce(stay.text, '') END AS text
FROM docs d LEFT JOIN per USING (doc_id) LEFT JOIN counted USING (doc_id) LEFT JOIN stay USING (doc_id)"""

#: Pieces and words, counts of all phrases of one to five words, candidates with their cuts, and the rank.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (
  SELECT lang, ws FROM (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces)
  WHERE len(ws) > 0),
places AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)),
counts AS MATERIALIZED (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f FROM counts WHERE f >= 100),
inner_parts AS (
  SELECT lang, array_to_string(ws[1:k - 1], ' ') AS phrase, f FROM often WHERE k > 2
  UNION ALL SELECT lang, array_to_string(ws[2:k], ' '), f FROM often WHERE k > 2),
inside AS (SELECT lang, phrase, max(f) AS longer FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT o.* FROM often o LEFT JOIN inside USING (lang, phrase) WHERE k > 1 AND (longer IS NULL OR longer < f)),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, s.n, c.j,
    (1000::HUGEINT * c.f * s.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN sizes s USING (lang)
  JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.j], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.j + 1:c.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
listed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM listed WHERE rank <= 2000
"""

#: All windows of 50 words by MD5, the smallest id of each, and the words that later ones cover.
SUBSTRINGS = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
windows AS MATERIALIZED (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS f FROM windows GROUP BY h),
later AS (SELECT rid, i, i AS start FROM windows JOIN firsts USING (h) WHERE f < doc_id),
word AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
marked AS (SELECT rid, i, w, max(start) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM word LEFT JOIN later USING (rid, i)),
stretches AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS opens FROM marked),
texts AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_factors,
  string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM stretches GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_factors, 0)::BIGINT AS n_factors,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN texts USING (rid)
"""

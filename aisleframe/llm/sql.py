"""DuckDB statements for the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
three AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM three) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS x(o) GROUP BY doc_id),
lines AS (SELECT doc_id, host, t, line FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '{WORD}')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
folded AS (SELECT doc_id, host, len(regexp_extract_all(line, '{WORD}')) AS n,
                  array_to_string(regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '{WORD}'), ' ') AS line FROM lines),
common AS (SELECT host, line FROM folded GROUP BY host, line HAVING count(DISTINCT doc_id) > 100),
gone AS (SELECT doc_id, sum(n) AS n FROM folded SEMI JOIN common USING (host, line) GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
                coalesce(gone.n, 0)::BIGINT AS n_line_words
         FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND 100 * (n_words - n_line_words) >= 50 * n_words AS kept FROM judged
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to
FROM q
"""

WINDOWS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) > 12)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS head FROM g) WHERE head < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
lost AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(l), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(l, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""

SQL = {
    "op3_line_frequency": QUALITY,
    "op9_repeated_windows": WINDOWS,
    "op10_archive": WARC,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MASKS = ((0, 1, 2, 4, 5, 8, 10, 11), (0, 2, 3, 5, 6, 7, 9, 11), (0, 1, 3, 4, 6, 8, 9, 11))


def _seed_rows(source: str, key: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, ws, i, {k} AS mask, concat_ws(' ', {', '.join(f'ws[i+{p}]' for p in mask)}) AS seed FROM {source}"
        for k, mask in enumerate(_MASKS))


SEEDS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS ws FROM documents),
dp AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM d WHERE len(ws) > 11),
b AS (SELECT min(item_id) AS item_id, ws FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{WORD}') AS ws
      FROM benchmark) GROUP BY ws),
bp AS (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM b WHERE len(ws) > 11),
ds AS ({_seed_rows('dp', 'doc_id')}),
bs AS ({_seed_rows('bp', 'item_id')}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.i AS i, bs.i AS j, ds.ws AS w, bs.ws AS v
         FROM ds JOIN bs USING (mask, seed)),
equal AS (SELECT doc_id, item_id, i, list_sum([CASE WHEN i + t > 0 AND j + t > 0 AND w[i+t] = v[j+t] THEN 1 ELSE 0 END
          FOR t IN range(-8, 20)]) AS n, least(12, len(v) - len(v) // 6) AS least_n FROM hits),
sb AS (SELECT item_id, len(ws) AS l, array_to_string(ws, ' ') AS s FROM b WHERE len(ws) BETWEEN 1 AND 11),
sd AS (SELECT doc_id, l, i, array_to_string(ws[i:i+l-1], ' ') AS s
       FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i
             FROM d JOIN (SELECT DISTINCT l FROM sb) ON len(ws) >= l)),
found AS (SELECT doc_id, item_id, i, n FROM equal WHERE n >= least_n
          UNION ALL SELECT doc_id, item_id, i, l FROM sd JOIN sb USING (l, s))
SELECT doc_id, item_id, count(DISTINCT i) AS n_hits, max(n)::BIGINT AS n_equal FROM found
GROUP BY doc_id, item_id
"""
SQL["op1_spaced_seeds"] = SEEDS

#: Table t of the checksum's 256 steps, made from its polynomial.
_CRC_TABLE = """SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS b))"""


def _crc32(text: str) -> str:
    """Unsigned checksum of a text's UTF-8 bytes, by the table t."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295, {octets}), "
            "lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)")


SPELLING = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc32("concat(doc_id, ':', run)")} AS h FROM kinds, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n
          FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, k, word[:k] || word[k+2:] AS rest FROM (SELECT word, unnest(range(len(word))) AS k FROM v)),
pairs AS (SELECT a.word, b.word AS near FROM less a JOIN less b USING (k, rest) WHERE a.word <> b.word
          UNION SELECT less.word, rest FROM less JOIN v ON rest = v.word
          UNION SELECT rest, less.word FROM less JOIN v ON rest = v.word),
best AS (SELECT pairs.word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n
         FROM pairs JOIN v ON near = v.word GROUP BY pairs.word),
found AS (SELECT v.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
                 CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
paths AS (SELECT word, word AS root FROM found
          UNION ALL SELECT paths.word, found.form FROM paths JOIN found ON root = found.word WHERE form IS NOT NULL),
roots AS (SELECT paths.word, root FROM paths JOIN found ON root = found.word WHERE found.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN roots USING (word)
"""
SQL["op13_gram_blocks"] = SPELLING

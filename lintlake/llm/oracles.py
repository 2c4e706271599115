"""SQL for the operators that SQL can express (DuckDB dialect)."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base32 of a SHA-1 in hex: five hex digits at a time are four letters.
_BASE32 = (
    "array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], "
    f"lambda s: substr('{_ALPHABET}', CAST(((('0x' || substr(sha, CAST(i * 5 + 1 AS BIGINT), 5))::BIGINT >> s) & 31) + 1 AS BIGINT), 1)), '')), '')"
)

SQL = {}

SQL["op1_warc_dictionary"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS sha, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h"""

SQL["op7_exact_dedup_index"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)"""

_ODD = "#$%&*|<>{}[]=+\\^~_@!"
_LEVELS = "\n".join(
    f"""l{k} AS (SELECT *, CASE WHEN done THEN target ELSE weight * level END AS aim FROM
  (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(CASE WHEN done THEN target END) OVER (), 0.0::DOUBLE))
     / nullif(sum(CASE WHEN NOT done THEN weight END) OVER (), 0) AS level FROM t{k})),
t{k + 1} AS (SELECT source, source_size, weight, done OR aim >= 2.0::DOUBLE * source_size AS done, least(aim, 2.0::DOUBLE * source_size) AS target FROM l{k}),"""
    for k in range(24)
)
#: Targets by passes that cap sources until none is above (each pass caps one at least; sources here are
#: few), then documents in the order of their exponential keys.
SQL["op8_mixing_sources"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || md5(coalesce(text, ''))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / CASE WHEN length(text) > 0 THEN greatest(0.05::DOUBLE, length(translate(text, '{_ODD}', '')) / length(text)::DOUBLE) ELSE 0.05::DOUBLE END AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
t0 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight, FALSE AS done, 0.0::DOUBLE AS target FROM s),
{_LEVELS}
aims AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t24),
r AS (SELECT d.doc_id, d.size, a.source_size, a.target, a.epochs, CAST(floor(a.target + 0.5) AS BIGINT) - a.epochs * a.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r"""

#: Character classes as patterns; what is none of them is the last class.
_CLASSES = [
    "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]",
    "[a-z]", "[A-Z]", "\\p{N}", "[.,;:''\"!?()-]|\\p{Pd}|\\p{Pi}|\\p{Pf}",
]
_SUMS = ", ".join(f"sum(c{k}) AS s{k}" for k in range(9))


def _rate(value: str, of: str) -> str:
    return f"(({value}) / greatest({of}, 1)::DOUBLE)"


def _half(p: str, q: str) -> str:
    """One bin's share of the divergence."""
    m = f"(({p} + {q}) / 2)"
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END)"


_counts = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS c{k}" for k, p in enumerate(_CLASSES))
_letters = "len(regexp_extract_all(text, '\\p{L}')) - c1 - c2"
_upper = "len(regexp_extract_all(text, '\\p{Lu}|\\p{Lt}')) - c2"
_divergence = " + ".join(_half(_rate(f"d.c{k}", "length(d.text)"), _rate(f"r.s{k}", "r.chars")) for k in range(9))
SQL["op5_divergence_rules"] = f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM
  (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM w, unnest(range(1, len(ws) - 1)) u(i))),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id),
a AS (SELECT w.doc_id, lang, text, ws, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    {_counts} FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, len(regexp_extract_all(text, '[\\p{{P}}\\p{{S}}]')) - c4 AS c5, {_letters} - ({_upper}) AS c6, {_upper} AS c7,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a),
d AS (SELECT *, length(text) - c0 - c1 - c2 - c3 - c4 - c5 - c6 - c7 AS c8 FROM b),
words AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(ws) AS word FROM d WHERE NOT base_failed) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM words GROUP BY lang HAVING sum(n) >= 2000),
common AS (SELECT lang, word, n, total FROM (SELECT words.*, total, row_number() OVER (PARTITION BY words.lang ORDER BY n DESC, encode(word)) AS place
    FROM words JOIN totals ON words.lang IS NOT DISTINCT FROM totals.lang WHERE n * 2000 >= total) WHERE place <= 50),
rest AS (SELECT lang, total, total - sum(n) AS n FROM common GROUP BY lang, total),
ref AS (SELECT d.lang, {_SUMS}, sum(length(text)) AS chars FROM d JOIN rest ON d.lang IS NOT DISTINCT FROM rest.lang WHERE NOT base_failed GROUP BY d.lang),
near AS (SELECT doc_id, sqrt(greatest(({_divergence}) / 2, 0)) AS x FROM d JOIN ref r ON d.lang IS NOT DISTINCT FROM r.lang WHERE NOT base_failed),
own AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM d WHERE NOT base_failed) GROUP BY ALL),
bins AS (SELECT d.doc_id, coalesce(own.n, 0) / d.n_words::DOUBLE AS p, c.n / c.total::DOUBLE AS q FROM d JOIN common c ON d.lang IS NOT DISTINCT FROM c.lang
  LEFT JOIN own ON own.doc_id = d.doc_id AND own.word = c.word WHERE NOT d.base_failed),
others AS (SELECT d.doc_id, 1 - coalesce(k.p, 0) AS p, r.n / r.total::DOUBLE AS q FROM d JOIN rest r ON d.lang IS NOT DISTINCT FROM r.lang
  LEFT JOIN (SELECT doc_id, sum(p) AS p FROM bins GROUP BY doc_id) k ON k.doc_id = d.doc_id WHERE NOT d.base_failed),
far AS (SELECT doc_id, sqrt(greatest(sum({_half('p', 'q')}) / 2, 0)) AS x FROM (FROM bins UNION ALL FROM others) GROUP BY doc_id)
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(near.x > 0.16 + 2.0 / sqrt(n_words), FALSE) AND NOT (n_words >= 60 AND coalesce(far.x > 0.27 + 2.2 / sqrt(n_words), FALSE)) AS kept
FROM d LEFT JOIN near ON near.doc_id = d.doc_id LEFT JOIN far ON far.doc_id = d.doc_id"""

#: A byte of a CRC-32: the table's entry for each byte value, made by eight shifts.
_CRC_TABLE = "list_transform(range(0, 256), lambda b: list_reduce(list_concat([b], range(0, 8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
#: Two words are near if both are left with the same text without one letter: at the same place (a
#: replaced letter), or one of them whole (an inserted or deleted one).
SQL["op11_frequency_trie"] = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen(k)), lambda i: CAST('0x' || substr(hex(encode(k)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d, crc),
w0 AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w0 WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
s AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM x),
near AS (
  SELECT a.word, b.word AS near, b.n FROM s a JOIN s b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM s a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM s a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) JOIN f g ON walk.at = g.word WHERE g.form IS NULL"""

_ROUNDS = "".join(
    f"""
a{k} AS (SELECT r, arg_min(c, ROW(list_sum(list_transform(list_zip(v.e, c{k}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c)) AS c FROM v, c{k} GROUP BY r),
m{k} AS (SELECT c, i, CAST(sum(e[i]) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN v USING (r), range(1, 65) t(i) GROUP BY c, i),
n{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM m{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(n{k}.e, c{k}.e) AS e FROM c{k} LEFT JOIN n{k} USING (c)),"""
    for k in range(3)
)
SQL["op13_threshold_centroids"] = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c, e FROM v
  QUALIFY c < 16),{_ROUNDS}
z AS (SELECT r, CAST(min(list_sum(list_transform(list_zip(v.e, c3.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS BIGINT) AS distance,
  arg_min(c, ROW(list_sum(list_transform(list_zip(v.e, c3.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c)) AS c FROM v, c3 GROUP BY r)
SELECT vec_id, CAST(z.c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.e, ',')) AS centroid_sha256 FROM z JOIN v USING (r) JOIN c3 ON z.c = c3.c"""

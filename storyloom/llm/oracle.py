"""SQL for the numbered queries that SQL can express, over whole tables. It shares no code with the operators."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
_LONGEST = sorted(_RULES, key=lambda r: -len(r[0] + r[1]))
_FIT = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
OP4 = f"""WITH u AS (SELECT page_id, {low("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {_FIT.format(h, p)} THEN '{h}{p}'" for h, p, _ in _LONGEST)} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in _RULES)} WHEN contains(host || path, 'cheap-pills.') OR contains(host || path, 'free-bets.') OR contains(host || path, 'spam-farm.') OR contains(host || path, 'ads-track.') THEN 'block' ELSE 'allow' END AS verdict FROM r"""

OP7 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS g FROM p), f AS (SELECT *, min(page_id) OVER (PARTITION BY g) AS first FROM d)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to, NULL::varchar AS error FROM f"""

_W8 = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_L8 = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))"
OP8 = f"""WITH d AS (SELECT doc_id, {_W8} AS w, {_L8} AS l, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5), y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS k FROM x),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM y WHERE k > 1) GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, n_symbols::bigint AS n_symbols, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(r.n, 0)::bigint AS n_repeat_words, len(l) AS n_lines FROM d LEFT JOIN r ON r.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > n_words) AS kept,
(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END + CASE WHEN n_words > 100000 THEN 32 ELSE 0 END)::bigint AS failed FROM m"""

_ANY = "".join  # letters in either case, spelled out
_WORDS9 = "|".join(_ANY(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_V = "[A-Za-z0-9+/_.=-]+"
_ASSIGN = f"""(?:{_WORDS9})[\"'']?\\x20*[:=]\\x20*[\"'']?({_V})"""


def _spans(kind: str, rank: int, pattern: str, value: str) -> str:
    hits = f"regexp_extract_all(t, '{pattern}')"
    return f"""SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, sum(length(p) + length(h)) OVER w - length(h) AS s, sum(length(p) + length(h)) OVER w AS e, {value} AS v FROM (SELECT doc_id, source, unnest(string_split_regex(t, '{pattern}')[1:len({hits})]) AS p, unnest({hits}) AS h, unnest(range(1, len({hits}) + 1)) AS i FROM d) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


OP9 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), b AS (SELECT * FROM ({_spans("assign", 0, _ASSIGN, f"regexp_extract(h, '[:=]\\x20*[\"'']?({_V})$', 1)")}) WHERE length(v) >= 6
UNION ALL SELECT * FROM ({_spans("access", 1, "AKIA[A-Z0-9]+", "h")}) WHERE length(v) >= 20 UNION ALL SELECT * FROM ({_spans("hex", 2, "[0-9a-f]+", "h")}) WHERE length(v) >= 24),
o AS (SELECT * FROM ({_spans("opaque", 3, "[A-Za-z0-9+/_=-]{20,}", "h")}) x WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)),
a AS (SELECT * FROM b UNION ALL SELECT * FROM o), own AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS n FROM a GROUP BY 1),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3 OR n = 1), '') AS spans FROM a JOIN own USING (v) GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""

_W2 = "regexp_extract_all(" + low("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP2 = f"""WITH d AS (SELECT doc_id, {_W2} AS w FROM documents), b AS (SELECT item_id, {_W2} AS w FROM benchmark), k AS (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id::varchar AS item, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)), ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, item, dw.i, dw.k FROM dw JOIN iw ON dw.k = iw.k AND dw.x = iw.x), n AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

OP3 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d),
m AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS c, CASE WHEN 2 * i + 200 <= length(h) THEN md5(substr(h, 2 * i + 1, 200)) END AS k FROM p),
f AS (SELECT doc_id, i, c, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM m),
g AS (SELECT doc_id, i, c, max(again::int) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS head FROM g),
r AS (SELECT doc_id, count(*) AS n, sum(gone)::bigint AS x, count(*) FILTER (head) AS y, coalesce(string_agg(c, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(x, 0) AS n_removed, coalesce(y, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""

_W10 = "list_filter(regexp_split_to_array(" + low("coalesce(text, '')") + ", '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_W10} AS w FROM documents), s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS x FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), c(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, c.m FROM c JOIN e ON e.a = c.doc_id WHERE c.m < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.m) AS component_id, min(c.m) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""

_H11 = "('0x' || sha256('1:' || doc_id)[{0}:{1}])::bigint"
OP11 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS w, {", ".join(f"{_H11.format(8 * i + 1, 8 * i + 8)} AS h{i + 1}" for i in range(4))} FROM documents),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
e AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM c)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(p)::bigint END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::bigint END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM e"""

_CRC = "list_reduce(list_transform(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda x: x::bigint), lambda c, x: {0})"
_STEP = "xor(c, x)"
for _ in range(8):
    _STEP = f"list_transform([{_STEP}], lambda y: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)[1]"
OP13 = f"""WITH d AS (SELECT doc_id, {_W8} AS w, xor({_CRC.format(_STEP)}, 4294967295) AS h FROM documents), g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM d), a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) ELSE w END AS w FROM p),
x AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 6], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM t WHERE n >= 12)), y AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
z AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS o FROM y) GROUP BY doc_id, q, o), r AS (SELECT doc_id, s, e, min(q) AS q FROM z WHERE e - s >= greatest(12, 2 * q) GROUP BY 1, 2, 3),
l AS (SELECT doc_id, count(*) AS n_runs, max({{'l': e - s, 's': -s, 'q': -q}}) AS b, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS v FROM r GROUP BY 1), f AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM r), c AS (SELECT doc_id, list(i) AS gone FROM f GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, -(b.s) AS start, b.l AS length, -(b.q) AS period, 1000 * b.l // -(b.q) AS exponent_milli, sha256(coalesce(v, '')) AS runs_sha256, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256
FROM t LEFT JOIN l ON l.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id"""

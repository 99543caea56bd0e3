"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from arbora.llm.line_dedup import MIN_NEAR
from arbora.llm.quality_rules import RULES, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


def _rule(r) -> str:
    value = f"{r.numerator}::DOUBLE" + (f" / nullif({r.denominator}, 0)" if r.denominator else "")
    held = " AND ".join(
        [f"coalesce({value} >= {r.low}, TRUE)"] * (r.low is not None) + [f"coalesce({value} <= {r.high}, TRUE)"] * (r.high is not None)
    )
    return f"(n_words < {r.min_words} OR ({held}))" if r.min_words else f"({held})"


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM d WHERE len(words) >= 5),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM w),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop, len(list_filter(words, lambda x: suffix(x, '!'))) AS n_exclaimed,
    len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullets,
    len(list_filter(lines, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…'))) AS n_ellipses
    FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {" AND ".join(map(_rule, RULES))} AS kept FROM b
"""

#: Lines within one edit share the half that the edit leaves whole: a join on halves, then the exact distance.
LINE_DEDUP = rf"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded,
    trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l),
u AS (SELECT norm, length(norm) AS n, min(row(doc_id, pos)) AS place FROM k WHERE worded GROUP BY 1),
h AS (SELECT *, unnest([{{'s': 0, 'q': (n - 1) // 2}}, {{'s': 0, 'q': n // 2}}, {{'s': 1, 'q': (n - 1) // 2}}, {{'s': 1, 'q': n // 2}}]) AS c FROM u WHERE n >= {MIN_NEAR}),
e AS (SELECT DISTINCT norm, n, place, c.s AS s, c.q AS q, CASE WHEN c.s = 0 THEN left(norm, c.q) ELSE right(norm, c.q) END AS half FROM h),
near AS (SELECT DISTINCT x.norm FROM e x JOIN e y ON x.s = y.s AND x.q = y.q AND x.half = y.half AND y.place < x.place AND abs(x.n - y.n) <= 1
    WHERE levenshtein(x.norm, y.norm) = 1),
v AS (SELECT k.doc_id, k.pos, k.line, k.worded, k.worded AND (row(k.doc_id, k.pos) <> u.place OR near.norm IS NOT NULL) AS gone
    FROM k LEFT JOIN u ON k.norm = u.norm AND k.worded LEFT JOIN near ON k.norm = near.norm AND k.worded)
SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, FALSE)), '') AS text FROM v GROUP BY 1
"""

JACCARD_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS raw FROM documents),
w AS (SELECT doc_id, list_transform(raw, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM d),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
f AS (SELECT gram, count(*) AS df FROM g GROUP BY 1 HAVING count(*) > 1),
o AS (SELECT g.doc_id, g.gram, n.n, row_number() OVER (PARTITION BY g.doc_id ORDER BY f.df, g.gram) AS i FROM g JOIN f USING (gram) JOIN n ON n.doc_id = g.doc_id),
s AS (SELECT doc_id, gram, n FROM o JOIN (SELECT g.doc_id AS sd, count(*) AS shared FROM g JOIN f USING (gram) GROUP BY 1) ON sd = doc_id WHERE i <= shared - (9 * n + 9) // 10 + 1),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
p AS (SELECT x, y, count(*) AS k FROM c JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y AND b.gram = a.gram GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
t AS (SELECT x AS node, x AS reach FROM ways UNION SELECT t.node, ways.y FROM t JOIN ways ON ways.x = t.reach)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(z.low, documents.doc_id) AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN (SELECT node, min(reach) AS low FROM t GROUP BY 1) z ON z.node = documents.doc_id
"""

_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {s}) & 31) + 1, 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)
WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""

#: CRC-32 from its table of remainders, over the bytes of ``<doc_id>:<run>``; near words share a string with one letter less.
SPELLING = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM o WHERE length(run) >= 6 GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, (2 * k + 1)::BIGINT, 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM r, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
    UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.v = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.v = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY 1),
f AS (SELECT w.word, CASE WHEN m >= 5 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN m END AS form_n
    FROM w LEFT JOIN best USING (word)),
up AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL),
root AS (SELECT up.word, up.at AS root FROM up JOIN f ON f.word = up.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN root USING (word)
"""

#: All sources against all, term by term.
DIVERGENCE = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
o AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY 1),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + v.v))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.n + v.v))::HUGEINT AS q
    FROM groups g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""

SQL = {
    "op2_quality_rules": QUALITY_RULES,
    "op7_line_dedup": LINE_DEDUP,
    "op8_jaccard_join": JACCARD_JOIN,
    "op10_warc": WARC,
    "op11_spelling_variants": SPELLING,
    "op12_source_divergence": DIVERGENCE,
}

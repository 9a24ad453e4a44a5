"""SQL (DuckDB) for the rows of the queries that SQL can express, built from the operators' own parameters."""

from __future__ import annotations

from tilewright.llm.chat import CLOSE, CONTROL, END, OPEN
from tilewright.llm.quality import CHAR_CLASSES, LETTERS

WORD = "[^\\x20\\x09-\\x0D]"


def near_duplicates(words: int, percent: int) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + {words - 1}], ' ') for i in range(1, len(w) - {words - 2})]) END AS s FROM w),
 c AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), chr(10)))) ELSE doc_id END AS rep FROM s),
 x AS (SELECT doc_id, hash(unnest(s)) AS h FROM s WHERE doc_id IN (SELECT rep FROM c)),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * p.n >= {percent} * (x.n + y.n - p.n)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT DISTINCT rep AS id, rep AS root FROM c UNION SELECT b, root FROM r JOIN e ON a = id WHERE b > root),
 f AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
 SELECT doc_id, n AS n_shingles, root AS component_id, doc_id = root AS kept FROM c JOIN f ON rep = id"""


def _distance(counts: str, total: str, reference: str) -> str:
    p, q = f"{counts}[i]::DOUBLE / {total}", f"{reference}[i] / list_sum({reference})"
    term = f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum([{term} for i in range(1, len({reference}) + 1)]) / 2))"


def quality(
    max_char_distance: float = 0.25, max_word_distance: float = 0.15, word_noise: float = 1.05, max_sum: float = 0.45, min_chars: int = 200, min_words: int = 40,
    words: int = 10, max_languages: int = 64, min_learned: int = 1000,
) -> str:
    gone = lambda s: f"length(t) - length(regexp_replace(t, '[{s}]', '', 'g'))"
    classes = ", ".join(gone(s) for s in CHAR_CLASSES.values())
    word_limit = f"least(0.99 * coalesce(list_min(list_filter(list_transform(rs, lambda y: y.far), lambda y: y > {max_word_distance})), 1), {max_word_distance} + {word_noise} / sqrt(n))"
    sums = f"[{', '.join(f'sum(c[{i + 1}])::DOUBLE' for i in range(len(CHAR_CLASSES) + 1))}]"
    near = f"coalesce(cd[j] <= {max_char_distance}, TRUE) AND (r.far <= {max_word_distance} OR (coalesce(wd[j] <= {word_limit}, TRUE) AND coalesce(cd[j] + wd[j] <= {max_sum}, TRUE)))"
    without = "CASE WHEN o <= 0 THEN 1 ELSE sqrt(greatest(0, (1 - o + log2(2 / (1 + o)) + o * log2(2 * o / (1 + o))) / 2)) END"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS w FROM documents),
 px AS (SELECT lang FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, lang LIMIT {max_languages}),
 py AS (SELECT DISTINCT lang, text FROM documents JOIN px USING (lang) WHERE text IS NOT NULL),
 p AS (SELECT lang, t, list_append(c, length(t) - list_sum(c)) AS c FROM (SELECT lang, text AS t, [{classes.replace("(t", "(text")}] AS c FROM py)),
 p1 AS (SELECT lang, {sums} AS r FROM p GROUP BY 1),
 y AS (SELECT lang, t, c, regexp_extract_all(t, '{WORD}+') AS w FROM p JOIN p1 USING (lang) WHERE length(t) < {min_chars} OR {_distance("c", "length(t)", "r")} <= {max_char_distance}),
 yc AS (SELECT lang, list_transform(r, lambda x: x / list_sum(r)) AS s FROM (SELECT lang, {sums} AS r FROM y GROUP BY 1)),
 yw AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM y) GROUP BY 1, 2),
 ya AS (SELECT lang, sum(n) AS total FROM yw GROUP BY 1 HAVING sum(n) >= {min_learned}),
 yt AS (SELECT lang, x, n::DOUBLE / total AS share FROM yw JOIN ya USING (lang) WHERE regexp_matches(x, '{LETTERS}') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) <= {words}),
 vx AS (SELECT DISTINCT x FROM yt),
 vo AS (SELECT coalesce(list(x ORDER BY x), []) AS v FROM vx),
 ys AS (SELECT lang, list(coalesce(share, 0.0) ORDER BY x) AS s FROM ya CROSS JOIN vx LEFT JOIN yt USING (lang, x) GROUP BY 1),
 yr AS (SELECT lang, yc.s AS c, list_append(coalesce(ys.s, []::DOUBLE[]), 1 - coalesce(list_sum(ys.s), 0)) AS s FROM ya JOIN yc USING (lang) LEFT JOIN ys USING (lang)),
 rs AS (SELECT coalesce(list({{'c': c, 's': s, 'far': {without}}} ORDER BY lang), []) AS rs FROM (SELECT *, s[len(s)] / list_sum(s) AS o FROM yr)),
 u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
 v AS (SELECT doc_id, i, CASE WHEN lead(x, 4) OVER o IS NOT NULL THEN hash([x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o]) END AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 k AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM v),
 m AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM k) GROUP BY 1),
 l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
 b AS (SELECT d.doc_id, t, w, len(w) AS n, coalesce(m.n, 0) AS again, len(l) - len(list_distinct(l)) AS dups, [{classes}] AS c0, list_transform(v, lambda e: len(list_filter(w, lambda x: x = e))) AS w0 FROM d LEFT JOIN m USING (doc_id) JOIN l USING (doc_id) CROSS JOIN vo),
 h AS (SELECT *, list_append(c0, length(t) - list_sum(c0)) AS cc, list_append(w0, len(w) - coalesce(list_sum(w0), 0)) AS wc FROM b),
 z AS (SELECT *, CASE WHEN length(t) >= {min_chars} THEN [{_distance("cc", "length(t)", "r.c")} for r in rs] END AS cd, CASE WHEN n >= {min_words} THEN [{_distance("wc", "len(w)", "r.s")} for r in rs] END AS wd, n < 10 OR 100 * again > 20 * n AS failed FROM h CROSS JOIN rs)
 SELECT doc_id, n AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, dups AS n_dup_lines, again AS n_repeat_words,
 failed AS base_failed, NOT failed AND (len(rs) = 0 OR len(list_filter(rs, lambda r, j: {near})) > 0) AS kept, round(list_min(cd), 6) AS char_distance, round(list_min(wd), 6) AS word_distance FROM z"""


def chat() -> str:
    rests = "|".join("".join(f"\\{x}" if x in "[]|" else x for x in c[1:]) for c in CONTROL)
    escaped = lambda c: f"length(regexp_replace({c}, '([<\\[])(\\\\*)({rests})', '\\1\\\\\\2\\3', 'g'))"
    said = "</s>[INST] ok [/INST]"
    marks = len(OPEN) + len(CLOSE) + len(END)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')),
 s AS (SELECT *, sum({marks} + {escaped('role')} + {escaped('text')}) OVER (PARTITION BY conv_id {order} ROWS UNBOUNDED PRECEDING) AS upto FROM c)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) + max(upto) - coalesce(max(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars FROM s GROUP BY 1"""


def middle(seed: int = 7, rate: int = 100, spm_rate: int = 50) -> str:
    part = lambda k: f"CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT)"
    said = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    p, m, s = said("1", "a"), said("a + 1", "b"), said("b + 1", "n")
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
 u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u FROM t),
 n AS (SELECT *, len(u) AS n, {part(0)} AS h1, {part(1)} AS h2, {part(2)} AS h3, {part(3)} AS h4 FROM u),
 f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM n)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length({p}) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length({m}) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || {p} || '<S>' || {s} || '<M>' || {m} ELSE '<S>' || {s} || '<P>' || {p} || '<M>' || {m} END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""


def resample(buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # the checksum takes four bits at a time, the lower ones of a byte first; its table of 16 follows from the polynomial
    table = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    nibbles = "list_transform(range(0, len(x)), lambda i: strpos('0123456789ABCDEF', x[i + 2 - 2 * (i % 2)]) - 1)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {nibbles}), lambda c, v: xor(c >> 4, ({table}::BIGINT[])[1 + (xor(c, v) & 15)])), 4294967295)"
    words = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    feats = lambda t, key: f"SELECT {key} AS k, w, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS f FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{words}') AS w FROM {t})"
    return f"""WITH df AS (SELECT k, f, count(*) AS n FROM ({feats('documents', 'doc_id')}) GROUP BY 1, 2), tf AS (SELECT f, count(*) AS n FROM ({feats('benchmark', 'item_id')}) GROUP BY 1),
 x AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM tf)), b AS (SELECT f, {crc} % {buckets} AS b FROM x),
 s AS (SELECT b, sum(n) AS s FROM df JOIN b USING (f) GROUP BY 1), t AS (SELECT b, sum(n) AS t FROM tf JOIN b USING (f) GROUP BY 1),
 z AS (SELECT (SELECT coalesce(sum(n), 0) FROM df)::DOUBLE AS sa, (SELECT coalesce(sum(n), 0) FROM tf)::DOUBLE AS ta),
 g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + {buckets}) / ((s + 1)::DOUBLE * (ta + {buckets})))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b) CROSS JOIN z),
 q AS (SELECT k, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * g) AS BIGINT) AS g FROM df JOIN b USING (f) JOIN g USING (b) GROUP BY 1),
 d AS (SELECT doc_id, len(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{words}')) AS w, CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents),
 a AS (SELECT doc_id, w, coalesce(n, 0) AS n_features, CAST(coalesce(g // n - CASE WHEN g % n < 0 THEN 1 ELSE 0 END, 0) AS BIGINT) AS weight, CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM d LEFT JOIN q ON doc_id = k),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM a WHERE w >= {min_words})
 SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= n * {percent} // 100 THEN r END AS rank FROM a LEFT JOIN r USING (doc_id)"""


def exact() -> str:
    return """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
 SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t"""

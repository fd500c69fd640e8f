"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, binary_codes, collocations, cotrain, dart_minhash, decontaminate, exact_topk, filter_audit, html_extract, licenses, line_dedup, mixing, phrase_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.dedup_phrases(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM s),
m AS (SELECT g, min(doc_id) AS m FROM h GROUP BY g HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT h.r, h.i + o.o AS j FROM h JOIN m USING (g), range(13) o(o) WHERE m.m < h.doc_id),
l AS (SELECT d.r, d.doc_id, u.word, u.j FROM d, LATERAL (SELECT unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS j) u),
k AS (SELECT l.r, string_agg(l.word, ' ' ORDER BY l.j) AS t, count(*) AS n FROM l LEFT JOIN x ON x.r = l.r AND x.j = l.j WHERE x.r IS NULL GROUP BY l.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""


def op4_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    return cotrain.quality_scores(docs, _read(spark, sf_dir, "labels")).select("doc_id", *cotrain.RESULT)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, u.line, u.pos FROM (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM d),
      LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS pos) u),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.near_vectors(_read(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT r, vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.r AS a, b.r AS b, a.vec_id AS va, b.vec_id AS vb FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
c AS (SELECT r AS a, r AS b FROM v UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
m AS (SELECT c.a, min(v.vec_id) AS m FROM c JOIN v ON v.r = c.b GROUP BY c.a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.m AS component_id, v.vec_id = m.m AS kept
FROM v JOIN m ON m.a = v.r LEFT JOIN n ON n.a = v.r
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs, licenses.known_licenses(spark)).select("doc_id", "digest", "license_id", "n_notices", "notices")


def _op8_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(c: str) -> str:
        c = f"'  ' || regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || '  '"
        for word, known in sorted(licenses.SPELLINGS, key=lambda s: (" " in s[0], -len(s[0]), s[0])):
            c = f"replace({c}, {quote(f' {word} '.replace(' ', '  ')[1:-1])}, {quote(f' {known} '.replace(' ', '  ')[1:-1])})"
        return f"trim(regexp_replace({c}, ' +', ' ', 'g'))"

    def canonical(c: str) -> str:
        for pattern, to in (("\r\n?", "\n"), ("(?m)" + licenses.COPYRIGHT_LINE, ""), ("(?m)" + licenses.TITLE_LINE, "")):
            c = f"regexp_replace({c}, {quote(pattern)}, {quote(to)}, 'g')"
        return form(c)

    texts = [*licenses.LICENSES, *licenses.NOTICES]
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in texts)
    single = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in texts if "\n" not in b)
    digests = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in licenses.DIGESTS)
    return f"""
WITH k AS (SELECT id, {canonical("lower(t)")} AS c FROM (VALUES {values}) v(id, t)),
g AS (SELECT d, min(id) AS id FROM (SELECT sha256(c) AS d, id FROM k WHERE c <> '' UNION ALL SELECT d, id FROM (VALUES {digests}) v(id, d)) GROUP BY d),
s AS (SELECT sha256(c) AS d, min(id) AS id FROM (SELECT id, {form("lower(t)")} AS c FROM (VALUES {single}) v(id, t)) GROUP BY 1),
x AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, doc_id, sha256({canonical("lower(coalesce(text, ''))")}) AS digest FROM x),
l AS (SELECT r, sha256({form("lower(line)")}) AS d FROM (SELECT r, unnest(string_split(regexp_replace(text, '\r\n?', '\n', 'g'), chr(10))) AS line FROM x)),
n AS (SELECT r, count(*) AS n, string_agg(DISTINCT s.id, ',' ORDER BY s.id) AS ids FROM l JOIN s USING (d) GROUP BY r)
SELECT w.doc_id, w.digest, g.id AS license_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices, coalesce(n.ids, '') AS notices
FROM w LEFT JOIN g ON g.d = w.digest LEFT JOIN n ON n.r = w.r
"""


def public_tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.lm_scores(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizer())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
s AS (SELECT lang, ws, i, unnest([1, 2, 3, 4]) AS k FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
f AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM s WHERE i + k - 1 <= len(ws) GROUP BY ALL),
t AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND n >= 30),
u AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
x AS (SELECT u.lang, u.phrase, u.a, u.j, l.n AS l, r.n AS r, CAST(2000000 * CAST(u.a AS HUGEINT) // (l.n + r.n) AS BIGINT) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.x JOIN f r ON r.lang = u.lang AND r.phrase = u.y),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
h AS (SELECT c.lang, array_to_string(c.ws[i.i:i.i + m.m - 1], ' ') AS phrase, max(c.a) AS longer FROM c JOIN range(2, 4) m(m) ON m.m < c.k JOIN range(1, 4) i(i) ON i.i + m.m - 1 <= c.k GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100 * h.longer < 80 * b.a)
SELECT o.lang, CAST(o.rank AS BIGINT) AS rank, o.phrase, CAST(o.a AS BIGINT) AS a, CAST(o.l AS BIGINT) AS l, CAST(o.r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, o.score
FROM o JOIN t ON t.lang = o.lang WHERE o.rank <= 2000
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.filter_audit(docs, _read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
s AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT w.part, coalesce(s.good, 0) AS good, coalesce(s.bad, 0) AS bad, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
      + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.first < w.doc_id, false) AS INT) AS mask
      FROM w LEFT JOIN s ON s.doc_id = w.doc_id),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
p AS (SELECT '' AS o, CAST(0 AS BIGINT) AS done UNION ALL SELECT o || chr(CAST(65 + b.b AS INT)), done | (1 << b.b) FROM p, range(5) b(b) WHERE done & (1 << b.b) = 0),
t AS (SELECT o AS filter_order, i.i AS step, ascii(o[i.i]) - 65 AS f, list_sum(list_transform(range(1, i.i), lambda j: 1 << (ascii(o[j]) - 65))) AS before FROM p, range(1, 6) i(i) WHERE length(o) = 5),
a AS (SELECT g.part, t.filter_order, t.step, t.f, sum(n) FILTER (WHERE mask & before = 0 AND mask & (1 << f) = 0) AS kept, sum(n) FILTER (WHERE mask & before = 0 AND mask & (1 << f) <> 0) AS removed,
      sum(n) FILTER (WHERE mask & before <> 0 AND mask & (1 << f) <> 0) AS redundant, sum(n) FILTER (WHERE mask = 1 << f) AS unique_fails,
      sum(good) FILTER (WHERE mask & before = 0 AND mask & (1 << f) <> 0) AS good_lost, sum(bad) FILTER (WHERE mask & before = 0 AND mask & (1 << f) <> 0) AS toxic_lost
      FROM g, (SELECT filter_order, step, f, CAST(coalesce(before, 0) AS BIGINT) AS before FROM t) t GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM a
"""


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_top_k(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score, c.r AS other
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS rank FROM s) WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mix_sources, op2_html_extract, op3_phrase_dedup, op4_cotrain, op5_line_dedup, op6_dart_minhash, op7_binary_codes, op8_license_scan, op9_attention_lm, op10_decontaminate)
    return {f.__name__: f for f in (*found, op11_collocations, op12_filter_audit, op13_exact_topk)}


def oracle_sql() -> dict[str, str]:
    return {"op3_phrase_dedup": OP3_SQL, "op5_line_dedup": OP5_SQL, "op7_binary_codes": OP7_SQL, "op8_license_scan": _op8_sql(), "op11_collocations": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_exact_topk": OP13_SQL}

"""The numbered queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, collocations, line_dedup, ngram_join, packing, quality, spelling, suffix_dedup, token_store, toxicity, url_filter, warc
from .common import table

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).drop("lang", "source")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_store(token_store.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model, locate=True).withColumn("held_out", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), length=50)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"), least_docs=10)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"), most_words=4, least=30, accounted=80, best=2000)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(table(spark, sf_dir, "documents"), least_chars=7, least=2, delete_every=31), times=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mcd_quality, op2_url_rules, op3_token_store, op4_byte_bpe, op5_toxicity, op6_ngram_join, op7_neighbours, op8_packing, op9_suffix_dedup, op10_warc, op11_line_dedup, op12_collocations, op13_spelling, pipeline)}

ORACLES = {
    "op2_url_rules": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#].*$', '', 's') ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, coalesce(translate(regexp_replace(rest, '/.*$', '', 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY s.page_id, s.host, s.path ORDER BY length(r.host || r.path) DESC) AS n
      FROM s LEFT JOIN r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1""",
    "op10_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f""",
    "op6_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM g),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k FROM t a JOIN t b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o WHERE 100 * k >= 85 * (nx + ny - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
c(v, root) AS (SELECT doc_id, doc_id FROM g UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.v)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, m.component_id FROM g JOIN (SELECT v, min(root) AS component_id FROM c GROUP BY v) m ON m.v = g.doc_id""",
    "op9_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT s.doc_id, s.i FROM s JOIN f USING (s) WHERE s.doc_id > f.first),
b AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS k FROM r)),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE gap IS NULL OR gap > 1) AS n_spans FROM (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM b) GROUP BY doc_id),
a AS (SELECT d.doc_id, i, substr(h, 2 * i + 1, 2) AS c FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM n)) d LEFT JOIN b ON b.doc_id = d.doc_id AND b.p = d.i WHERE b.p IS NULL),
k AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS h FROM a GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n.n_removed, 0) AS n_removed, coalesce(n.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n.doc_id IS NULL THEN d.h ELSE coalesce(k.h, '') END)) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op11_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines[i] AS line, i, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
g AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g USING (key) GROUP BY doc_id""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s, range(1, 5) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
x AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
y AS (SELECT x.lang, x.phrase, x.a, x.j, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * x.a // (l.f + r.f) AS BIGINT) AS score
      FROM x JOIN g l ON l.lang = x.lang AND l.phrase = x.head JOIN g r ON r.lang = x.lang AND r.phrase = x.tail),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM y),
b AS (SELECT * FROM z WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang = z.lang AND c.phrase <> z.phrase AND contains(' ' || c.phrase || ' ', ' ' || z.phrase || ' ') AND 100 * c.a >= 80 * z.a)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT q.lang, q.rank, q.phrase, q.a, q.l, q.r, n.n, q.score FROM q JOIN n ON n.lang = q.lang WHERE q.rank <= 2000""",
    "op13_spelling": r"""
WITH RECURSIVE t(i, k, v) AS (SELECT i, 0, i FROM range(0, 256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS c FROM t WHERE k = 8),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS n FROM o WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))),
        lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM u), crc),
v AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
         UNION SELECT d.word, w.word, w.n FROM d JOIN words w ON d.less = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN words w ON d.less = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
r(word, its, form) AS (SELECT word, word, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.its AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL""",
}

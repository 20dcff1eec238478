"""The queries of this subpackage and, where SQL can say it, their SQL for DuckDB."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nimbusvec.llm import embeddings, exact, licences, mixing, packing, pii, quality, simhash, urls, warc

#: (verdict, host, path) of the url filter's query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


#: The setting that holds the key of PII surrogates.
PII_KEY = "spark.nimbusvec.pii.key"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the key is a setting of the session; where it has none, it gets one that nobody knows
    key = spark.conf.get(PII_KEY, None)
    if not key:
        spark.conf.set(PII_KEY, key := secrets.token_hex(32))
    return pii.replace(_table(spark, sf_dir, "documents"), key)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.links(_table(spark, sf_dir, "embeddings"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_simhash, op2_license_scan, op3_exact_dedup, op4_warc, op5_mixing, op6_pii, op7_packing, op8_quality, op9_url_filter, op10_embedding_dedup)
    return {f.__name__: f for f in ops} | {"pipeline": _pipeline}


_WS = r"'[\x20\x09-\x0D]'"

def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op2_sql() -> str:
    """All texts, the known ones among them, through one canonical form."""
    spelt = "s"
    for pattern, to in licences.SPELLINGS:
        spelt = f"regexp_replace({spelt}, {_quoted(pattern)}, {_quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
    rows = lambda kind, pairs: ", ".join(f"('{kind}', {_quoted(name)}, {_quoted(text)})" for name, text in pairs)
    known = rows("text", licences.LICENCES.items()) + ", " + rows("line", ((v, k) for k, v in licences.notices().items()))
    listed = ", ".join(f"({_quoted(name)}, '{d}')" for name, ds in licences.DIGESTS.items() for d in ds)
    t = [f"coalesce(regexp_matches(c[{i + 1}], {_quoted(licences.TITLE)}), false)" for i in range(licences.TITLES)]
    gone = f"CASE WHEN NOT {t[0]} THEN 0 WHEN NOT {t[1]} THEN 1 WHEN NOT {t[2]} THEN 2 ELSE 3 END"
    return rf"""
WITH k(kind, name, text) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, 'doc' AS kind, CAST(doc_id AS VARCHAR) AS name, doc_id, coalesce(text, '') AS text FROM documents
      UNION ALL SELECT -row_number() OVER (), kind, name, NULL, text FROM k),
l AS (SELECT r, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT r, regexp_split_to_array(text, '
|
|
') AS x FROM d)),
w AS (SELECT r, pos, lower(line) AS low FROM l),
p AS (SELECT r, pos, trim(regexp_replace(low, '[^\pL\pN]+', ' ', 'g')) AS s FROM w WHERE NOT regexp_matches(low, '^\W*(\(c\)|©|all rights reserved\W*$)') AND NOT (regexp_matches(low, '^\W*copyright') AND NOT regexp_matches(low, '^\W*copyright (holder|owner|notice)'))),
q AS (SELECT r, pos, {spelt} AS s FROM p),
c AS (SELECT r, list(s ORDER BY pos) AS c FROM q WHERE s <> '' GROUP BY r),
f AS (SELECT d.*, coalesce(c.c, []) AS c FROM d LEFT JOIN c USING (r)),
g AS (SELECT *, sha256(array_to_string(c, ' ')) AS whole, sha256(array_to_string(c[1 + {gone}:], ' ')) AS body FROM f),
texts AS (SELECT body, min(name) AS licence FROM (SELECT body, name FROM g WHERE kind = 'text' UNION ALL SELECT digest, name FROM (VALUES {listed}) v(name, digest)) GROUP BY body),
lines AS (SELECT array_to_string(c, ' ') AS line, min(name) AS licence FROM g WHERE kind = 'line' GROUP BY 1),
n AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM (SELECT r, unnest(c) AS line FROM g WHERE kind = 'doc') JOIN lines USING (line) GROUP BY r)
SELECT doc_id, whole AS canonical_sha256, licence, coalesce(notices, '') AS notices FROM g LEFT JOIN texts USING (body) LEFT JOIN n USING (r) WHERE kind = 'doc'
"""


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), {_WS}, '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, sha256(norm) AS text_sha256,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM f
"""

OP5_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS place FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM g),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(v.level * w, cap)) AS target FROM l LEFT JOIN v ON true),
n AS (SELECT *, coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) AS whole FROM t),
r AS (SELECT s.*, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need FROM s JOIN n ON s.source IS NOT DISTINCT FROM n.source),
p AS (SELECT source, place, sum(size) AS size, max(need) AS need FROM r GROUP BY source, place),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
m AS (SELECT source, max(place) AS upto FROM c WHERE before + size / 2 <= need AND before < need GROUP BY source)
SELECT doc_id, size, r.source_size, r.target, CAST(size * least(3, whole + CASE WHEN place <= coalesce(upto, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r LEFT JOIN m ON r.source IS NOT DISTINCT FROM m.source
"""

OP9_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
s AS (SELECT DISTINCT host, path FROM u),
f AS (SELECT host, path, verdict, rhost || rpath AS rule, length(rhost || rpath) * 100000 + length(rhost) AS rank FROM s JOIN r
      ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
b AS (SELECT host, path, arg_max(rule, rank) AS rule, arg_max(verdict, rank) AS verdict FROM f GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN b ON u.host = b.host AND u.path = b.path
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.a, r.c FROM r JOIN p ON p.b = r.id),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = id LEFT JOIN n ON vec_id = a
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": op2_sql(), "op3_exact_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op5_mixing": OP5_SQL, "op9_url_filter": OP9_SQL, "op10_embedding_dedup": OP10_SQL}

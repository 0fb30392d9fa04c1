"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pinweave.llm import audit, bpe, jaccard, langid, lm, mixing, pii, quality, search, secrets, sharding, vectors, warc
from pinweave.runtime import Scratch, ship_package


PII_KEY = b"replace this key in production"


def _table(spark, sf_dir, name):
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"), Scratch(spark, "op1"), shards=40)


def op2_jaccard_join(spark, sf_dir):
    return jaccard.join_components(_table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_vector_dedup(spark, sf_dir):
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op3"))


def op4_quality_rules(spark, sf_dir):
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Scratch(spark, "op4"))


def op5_pii_surrogates(spark, sf_dir):
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY, Scratch(spark, "op5"))


def op6_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"), Scratch(spark, "op6"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_lm_score(spark, sf_dir):
    return lm.score(_table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def op9_secret_scan(spark, sf_dir):
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op11_warc(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return warc.page_records(pages, Scratch(spark, "op11"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_lexical_search(spark, sf_dir):
    return search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Scratch(spark, "op12"))


def op13_filter_audit(spark, sf_dir):
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Scratch(spark, "op13"))


def vector_dedup_planted(spark, sf_dir):
    """op3 over the vectors and near copies of a third and of a fifth of them, as the table itself has no links."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"), "label")

    def copies(each, shift, share):
        moved = F.transform("embedding", lambda v, i: v * (1 + F.lit(share) * ((F.col("vec_id") * 31 + i * 17) % 7 - 3)))
        return rows.where(F.col("vec_id") % each == 0).withColumn("embedding", moved).withColumn("vec_id", F.col("vec_id") + shift)

    return vectors.near_duplicates(rows.union(copies(3, 10_000_000, 0.1)).union(copies(5, 20_000_000, 0.17)), Scratch(spark, "op3-planted"))


QUERIES = {f.__name__: f for f in (vector_dedup_planted, op1_sharding, op2_jaccard_join, op3_vector_dedup, op4_quality_rules, op5_pii_surrogates, op6_language_id, op7_byte_bpe, op8_lm_score, op9_secret_scan, op10_mixing, op11_warc, op12_lexical_search, op13_filter_audit)}
# The joins by brute force over all pairs, which the operators themselves never form.
ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS c FROM s UNION SELECT o.b, r.c FROM r JOIN o ON o.a = r.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.sh
""",
    "op3_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.x),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.c) AS component_id, v.vec_id = min(r.c) AS kept
FROM v JOIN r ON r.x = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id
""",
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS own FROM documents),
w AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS INTEGER)) AS weight, CAST(sum(size) AS DOUBLE) * 3 AS most FROM d GROUP BY skey),
r AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
p AS (SELECT skey, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM
  (SELECT *, least(weight * coalesce((SELECT level FROM r WHERE weight * level < most ORDER BY most / weight, skey LIMIT 1), 1e300), most) AS target FROM w)),
u AS (SELECT doc_id, own, skey, size, 4 * k + j AS seed, CAST('0x' || substr(md5(k || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || own), 1 + 8 * j, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM d, (SELECT CAST(range AS INTEGER) AS k FROM range(8)), (SELECT CAST(range AS INTEGER) AS j FROM range(4))),
h AS (SELECT u.skey, seed, abs(sum(CASE WHEN draw < rate - floor(rate) THEN size ELSE 0 END) - (any_value(target) - floor(any_value(rate)) * any_value(source_size))) AS off FROM u JOIN p USING (skey) GROUP BY u.skey, seed),
b AS (SELECT skey, arg_min(seed, (off, seed)) AS seed FROM h GROUP BY skey),
c AS (SELECT d.doc_id, d.size, source_size, target, rate, CAST(floor(rate) AS BIGINT) + CAST(CAST('0x' || substr(md5(CAST(seed // 4 AS VARCHAR) || '|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || own), 1 + 8 * (seed % 4), 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) AS BIGINT) AS copies
  FROM d JOIN p USING (skey) JOIN b USING (skey))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, rate FROM c
""",
}
ORACLE_SQL["op11_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (j // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL["op12_lexical_search"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_TERM}') AS ts FROM documents),
s AS (SELECT *, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0), g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM s),
i AS (SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark),
iq AS (SELECT q, any_value(item_id) AS item_id, t, count(*) AS c FROM i GROUP BY q, t),
e AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM s) WHERE t IN (SELECT t FROM iq) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM e GROUP BY t), g),
x AS (SELECT item_id, q, s.doc_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS score FROM iq JOIN w USING (t) JOIN e USING (t) JOIN s USING (r), g GROUP BY item_id, q, s.doc_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
ORACLE_SQL["op13_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CAST(len(ws) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INTEGER)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(u.doc_id > first, false) AS INTEGER) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM u LEFT JOIN l USING (doc_id)),
c AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS f, CAST(1 AS BIGINT) << CAST(ascii(substr(filter_order, CAST(step AS INTEGER), 1)) - 65 AS INTEGER) AS own,
  CAST(list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(substr(filter_order, CAST(j AS INTEGER), 1)) - 65))) AS BIGINT) AS prior FROM o, (SELECT unnest(range(1, 6)) AS step)),
a AS (SELECT part, filter_order, step, f, CAST(sum(n) FILTER (WHERE fails & (own | coalesce(prior, 0)) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE fails & own <> 0 AND fails & coalesce(prior, 0) = 0) AS BIGINT) AS removed,
  CAST(sum(n) FILTER (WHERE fails & own <> 0 AND fails & coalesce(prior, 0) <> 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (WHERE fails = own) AS BIGINT) AS unique_fails,
  CAST(sum(good) FILTER (WHERE fails & own <> 0 AND fails & coalesce(prior, 0) = 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (WHERE fails & own <> 0 AND fails & coalesce(prior, 0) = 0) AS BIGINT) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM a
"""
COPIES = "SELECT vec_id + {shift} AS vec_id, list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (1 + {share}::DOUBLE * ((vec_id * 31 + i * 17) % 7 - 3))) AS x, label FROM embeddings WHERE vec_id % {each} = 0"
ORACLE_SQL["vector_dedup_planted"] = ORACLE_SQL["op3_vector_dedup"].replace(
    "WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
    "WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings UNION ALL " + COPIES.format(each=3, shift=10_000_000, share=0.1) + " UNION ALL " + COPIES.format(each=5, shift=20_000_000, share=0.17) + ")",
)

"""Audit queries over the driver's tables."""

from pyspark.sql import functions as F

from scrivenry.functions import text as T
from scrivenry.operators import audit
from scrivenry.plans.common import query, table


@query("""SELECT count(*) AS n, count(*) - count(DISTINCT CAST(conv_id AS VARCHAR) || chr(31) || CAST(turn AS VARCHAR)) AS n_duplicate FROM conversations""")
def audit_counts(spark, sf):
    return audit.duplicate_keys(table(spark, sf, "conversations"), "conv_id", "turn")


@query("""SELECT DISTINCT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL""")
def audit_orphans(spark, sf):
    return audit.orphans(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
j AS (SELECT c.c_custkey, coalesce(a.n, 0) AS n, c.c_nationkey AS declared, CASE WHEN c.c_acctbal > 0 THEN c.c_nationkey END AS declared_null
      FROM customer c LEFT JOIN a ON c.c_custkey = a.o_custkey)
SELECT count_if(n = 0)::BIGINT AS n_without, count_if(n IS DISTINCT FROM declared)::BIGINT AS mismatch_declared,
       count_if(n IS DISTINCT FROM declared_null)::BIGINT AS mismatch_declared_null FROM j""")
def audit_mismatch(spark, sf):
    works = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("declared"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("declared_null"))
    return audit.count_mismatches(works, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k", ["declared", "declared_null"])


@query("""SELECT coalesce(CAST(l.quality AS VARCHAR), 'None') AS value, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def audit_breakdown(spark, sf):
    return audit.breakdown(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left"), "quality")


@query("""
WITH n AS (SELECT d.doc_id, l.quality + 1 AS sub_site, l.toxic AS rating, CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS is_r18 FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT coalesce(sum(CASE WHEN sub_site = 2 THEN 1 ELSE 0 END), 0)::BIGINT AS sub_site_eq_2,
 coalesce(sum(CASE WHEN sub_site <> 2 AND rating = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS rating_eq_1,
 coalesce(sum(CASE WHEN sub_site <> 2 AND rating <> 1 AND is_r18 = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS url_entity_is_r18 FROM n""")
def audit_adult_sources(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    works = d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("ncode"), (F.col("quality") + 1).alias("sub_site"), F.col("toxic").alias("rating"))
    return audit.adult_sources(works, d.select(F.col("doc_id").alias("ncode"), F.when(F.col("lang") == "en", 1).otherwise(0).alias("is_r18")))


@query("""SELECT page_id, CASE WHEN length(html) >= 200 THEN round_even(length(regexp_replace(html, '<[^>]+>', '', 'g')) / length(html), 4) END AS ratio FROM pages""")
def html_ratio(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.markup_ratio("html").alias("ratio"))


@query("""
WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '   ' WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 13 = 0 THEN html || chr(65533) WHEN page_id % 17 = 0 THEN html || chr(7) ELSE html END AS body FROM pages)
SELECT 'empty_body' AS reason, CAST(page_id AS VARCHAR) AS key FROM p WHERE body IS NULL OR trim(body) = ''
UNION ALL SELECT 'encoding_anomaly', CAST(page_id AS VARCHAR) FROM p WHERE contains(body, chr(65533)) OR contains(body, chr(7))
UNION ALL SELECT 'html_ratio_anomaly', CAST(page_id AS VARCHAR) FROM p WHERE length(body) >= 200 AND length(regexp_replace(body, '<[^>]+>', '', 'g')) / length(body) < 0.5""")
def audit_body_faults(spark, sf):
    i = F.col("page_id")
    body = F.when(i % 7 == 0, "   ").when(i % 11 == 0, None).when(i % 13 == 0, F.concat("html", F.lit("�"))).when(i % 17 == 0, F.concat("html", F.lit("\x07"))).otherwise(F.col("html"))
    rows = table(spark, sf, "pages").select(i.cast("string").alias("ncode"), F.lit("1").alias("episode_no"), body.alias("body"))
    return audit.body_faults(rows, least_share=0.5).select("reason", F.col("ncode").alias("key"))


@query("""SELECT doc_id, sha256(text) AS sha, (row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1) AS is_duplicate FROM documents""")
def text_sha(spark, sf):
    from scrivenry.operators.dedup import exact_duplicates

    return exact_duplicates(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", "sha", "is_duplicate")

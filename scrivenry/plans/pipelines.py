"""Queries of whole jobs over the driver's tables."""

from pyspark.sql import functions as F

from scrivenry.operators import measures, pipelines
from scrivenry.plans.common import query, table


def works_of(spark, sf):
    """Conversations in the roles of works and episodes."""
    c = table(spark, sf, "conversations")
    ncode = F.concat(F.lit("n"), F.col("conv_id"))
    novels = c.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        ncode.alias("ncode"), F.concat(F.lit("title "), F.col("conv_id")).alias("title"), F.concat(F.lit("a"), F.col("conv_id") % 9).alias("author"), F.when(F.col("conv_id") % 2 == 0, "war r15").otherwise("SF").alias("main_tag"), F.lit(None).cast("string").alias("sub_tag"),
        F.lit(0).alias("rating"), (F.col("conv_id") % 4 + 1).cast("int").alias("sub_site"), (F.col("conv_id") % 2 + 1).cast("int").alias("site_type"),
    )
    episodes = c.select(ncode.alias("ncode"), F.col("turn").cast("string").alias("episode_no"), F.col("text").alias("body"), F.col("role").alias("e_title"))
    urls = spark.createDataFrame([("n1", 1)], "ncode string, is_r18 int")
    return novels, episodes, urls


@query("""
SELECT 'n' || conv_id AS ncode, conv_id % 4 = 1 OR conv_id = 1 AS is_r18, CASE WHEN conv_id % 2 + 1 = 1 THEN 'syosetu' ELSE 'kakuyomu' END AS site_type, count(*) FILTER (trim(regexp_replace(text, '\\s+', '', 'g')) <> '') AS n_episodes FROM conversations GROUP BY conv_id""")
def dataset_manifest(spark, sf):
    _, works = pipelines.build_dataset(*works_of(spark, sf), target=120, most=160, overlap=10)
    return works.select("ncode", "is_r18", "site_type", "n_episodes")


@query()
def dataset_chunks(spark, sf):
    chunks, _ = pipelines.build_dataset(*works_of(spark, sf), target=120, most=160, overlap=10)
    return chunks.select("id", "text", "control_tags.genre", "meta.ncode", "meta.is_r18", "meta.chunk_count_in_episode", "split")


@query()
def context_samples(spark, sf):
    chunks, _ = pipelines.build_dataset(*works_of(spark, sf), target=120, most=160, overlap=10)
    terms = spark.createDataFrame([("n1", ["x"])], "ncode string, terms array<string>")
    return pipelines.context_view(chunks, terms, 400, 900, 2).select("prompt", "completion", "meta.ncode", "meta.episode_no")


@query("""
WITH c AS (SELECT 'n' || conv_id AS ncode, turn, regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM conversations)
SELECT ncode, sha256(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS sha FROM c WHERE t <> '' GROUP BY ncode HAVING length(string_agg(t, chr(10) || chr(10) ORDER BY turn)) >= 500""")
def exported_works(spark, sf):
    return pipelines.export_works(works_of(spark, sf)[1]).select("ncode", F.sha2("text", 256).alias("sha"))


@query("""
WITH s AS (SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) - 1 AS i FROM s),
f AS (SELECT * FROM r WHERE i < 3 OR source = 'src5'), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) - 1 AS j, count(*) OVER () AS k FROM r WHERE source NOT IN (SELECT source FROM f))
SELECT source, n FROM f UNION ALL SELECT source, n FROM o WHERE j IN (SELECT round_even(i * (k - 1) / 3.0, 0) FROM range(4) t(i), (SELECT max(k) AS k FROM o))""")
def long_works(spark, sf):
    s = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return pipelines.select_works(s, "n", 3, 4, ["src5"], "source")


@query()
def long_work_contexts(spark, sf):
    """Segments of the longest conversations and of some others."""
    c = table(spark, sf, "conversations")
    works = c.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    return pipelines.long_work_contexts(works, c, "n", 3, 6, ["2"], ["turn"], "ends3", 900, "conv_id")


@query("""
WITH p AS (SELECT a.label AS layer, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
i AS (SELECT layer, round_even(1 - avg(list_dot_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[])))), 6) AS influence FROM p GROUP BY layer)
SELECT layer, influence FROM i WHERE layer BETWEEN 2 AND 7 ORDER BY influence, layer LIMIT 3""")
def removable_layers(spark, sf):
    from scrivenry.plans.metrics import plain_influence

    return pipelines.removable_layers(plain_influence(spark, sf), 10, 3)


@query("""
SELECT doc_id, CASE WHEN bool_or(toxic IS NULL) THEN NULL ELSE max(quality) END AS violence, CASE WHEN bool_or(toxic IS NULL) THEN NULL ELSE 0 END AS gore FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id""")
def merged_axes(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = d.select("doc_id", F.lit("violence").alias("axis"), F.col("quality").alias("value"), F.col("toxic").isNull().alias("failed"))
    return pipelines.merged_axes(rows, "doc_id", ["violence", "gore"]).select("doc_id", "content.violence", "content.gore")


@query("""SELECT source, CASE WHEN avg(quality) >= 0.9 THEN 'good' WHEN avg(quality) >= 0.8 THEN 'fair' ELSE 'poor' END AS verdict FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def verdicts(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.avg("quality").alias("q")).select("source", pipelines.verdict(F.col("q"), [(0.8, "fair"), (0.9, "good")], "poor").alias("verdict"))


@query("""SELECT lang AS value, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang""")
def good_shares(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1"), "doc_id")
    return measures.shares(d, "lang").withColumn("share", F.bround("share", 6))

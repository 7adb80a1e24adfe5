"""Queries of samples, splits, set operations and resumed jobs."""

from pyspark.sql import functions as F

from scrivenry.operators import audit, sampling
from scrivenry.plans.common import query, table

_D = "md5(concat_ws(':', '7', CAST(doc_id AS VARCHAR)))"


@query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {_D}, doc_id) AS r FROM documents) WHERE r <= 7""")
def cap_per_work(spark, sf):
    return sampling.cap_per_group(table(spark, sf, "documents"), "source", 7, 7, "doc_id").select("doc_id")


@query(f"""
WITH g AS (SELECT doc_id, unnest([lang, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END]) AS g FROM documents),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY {_D}, doc_id) AS r FROM g WHERE g IN ('en', 'long'))
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE r > CASE g WHEN 'en' THEN 300 ELSE 200 END)""")
def genre_max(spark, sf):
    d = table(spark, sf, "documents").withColumn("g", F.array("lang", F.when(F.col("n_chars") > 1500, "long").otherwise("short")))
    return sampling.genre_maximum(d, "g", {"en": 300, "long": 200}, 7, "doc_id").select("doc_id")


@query("""SELECT g AS genre, coalesce(n, 0) AS n, m AS minimum FROM (VALUES ('en', 10), ('it', 5), ('es', 100000)) v(g, m) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) ON g = lang WHERE coalesce(n, 0) < m""")
def genre_shortage(spark, sf):
    d = table(spark, sf, "documents").withColumn("g", F.array("lang"))
    return sampling.genre_shortage(d, "g", {"en": 10, "it": 5, "es": 100000}).select("genre", "n", F.col("minimum").cast("int").alias("minimum"))


@query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_D}, doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(n * 0.2)""")
def author_share(spark, sf):
    return sampling.author_share(table(spark, sf, "documents"), "lang", 0.2, 7, "doc_id").select("doc_id")


@query(f"""
WITH d AS (SELECT doc_id, coalesce(toxic, 0) = 1 AS f FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT count(*) AS n, count_if(f) AS p FROM d), k AS (SELECT n, p, least(round_even(n * 0.1, 0)::BIGINT, p) AS kp FROM c),
t AS (SELECT kp, least(least(CASE WHEN kp > 0 THEN round_even(kp / 0.1, 0)::BIGINT ELSE 0 END, n) - kp, n - p) AS kq FROM k)
SELECT doc_id, f AS toxic FROM (SELECT doc_id, f, row_number() OVER (PARTITION BY f ORDER BY {_D}, doc_id) AS r FROM d), t WHERE r <= CASE WHEN f THEN kp ELSE kq END""")
def label_ratio(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))
    return sampling.label_ratio(d, "toxic", 0.1, 7, "doc_id").select("doc_id", "toxic")


@query(f"""
WITH d0 AS (SELECT doc_id, source, lang, coalesce(toxic, 0) = 1 AS f FROM documents LEFT JOIN labels USING (doc_id)),
d1 AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_D}, doc_id) AS r FROM d0) WHERE r <= 40),
d2 AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_D}, doc_id) AS r FROM d1) WHERE lang <> 'en' OR r <= 400),
d3 AS (SELECT * EXCLUDE (r, n) FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_D}, doc_id) AS r, count(*) OVER () AS n FROM d2) WHERE r <= floor(n * 0.2)),
c AS (SELECT count(*) AS n, count_if(f) AS p FROM d3), k AS (SELECT n, p, least(round_even(n * 0.05, 0)::BIGINT, p) AS kp FROM c),
t AS (SELECT kp, least(least(CASE WHEN kp > 0 THEN round_even(kp / 0.05, 0)::BIGINT ELSE 0 END, n) - kp, n - p) AS kq FROM k)
SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY {_D}, doc_id) AS r FROM d3), t WHERE r <= CASE WHEN f THEN kp ELSE kq END""")
def stratified_sample(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("g", F.array("lang"))
    config = sampling.Sampling(7, max_per_work=40, genre_max={"en": 400}, max_author_share=0.2, r18_ratio=0.05)
    return sampling.stratified(d, config, "source", "g", "lang", "toxic", "doc_id")[0].select("doc_id", "source", "lang")


@query("""SELECT source, CASE WHEN CAST('0x' || substring(md5(concat_ws(':', '7', source)), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1, 2""")
def split_by_work(spark, sf):
    return sampling.split(table(spark, sf, "documents"), "source", 0.2, 7).groupBy("source", "split").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 0 INTERSECT SELECT DISTINCT source FROM documents WHERE doc_id % 97 <> 0""")
def split_leak(spark, sf):
    d = table(spark, sf, "documents").withColumn("split", F.when(F.col("doc_id") % 97 == 0, "val").otherwise("train"))
    return sampling.leaked(d, "source")


@query("""
WITH w AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), cap AS (SELECT lang, sum(least(n, 12)) AS c FROM w GROUP BY 1),
v AS (SELECT max(l) AS l FROM range(0, 161) r(l) WHERE (SELECT sum(least(c, l)) FROM cap) <= 160),
q AS (SELECT lang, least(c, l) + CASE WHEN c > l AND sum((c > l)::INT) OVER (ORDER BY lang) <= 160 - (SELECT sum(least(c, l)) FROM cap, v) THEN 1 ELSE 0 END AS q FROM cap, v), t AS (SELECT w.lang, source, n, q, unnest(range(1, least(n, 12) + 1)) AS turn FROM w JOIN q USING (lang)),
k AS (SELECT lang, source, n, count(*) AS take FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS r FROM t) WHERE r <= q GROUP BY 1, 2, 3),
p AS (SELECT DISTINCT lang, source, CASE WHEN take = 1 AND n > 1 THEN n // 2 WHEN take >= n THEN j ELSE round_even(j * (n - 1) / greatest(take - 1, 1)::DOUBLE, 0)::BIGINT END AS i FROM (SELECT *, unnest(range(0, take)) AS j FROM k)),
d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, lang, source FROM d JOIN p USING (lang, source, i)""")
def balanced_subset(spark, sf):
    return sampling.balanced_subset(table(spark, sf, "documents"), "lang", "source", ["doc_id"], 160, 12).select("doc_id", "lang", "source")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def resume_anti(spark, sf):
    return sampling.pending(table(spark, sf, "documents"), table(spark, sf, "labels").withColumn("ok", F.col("quality") == 1), ["doc_id"], "ok").select("doc_id")


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS r FROM conversations) WHERE r % 3 = 1""")
def job_shard(spark, sf):
    return sampling.job_shard(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 1, 3)


@query(f"""SELECT doc_id, p AS positive FROM (SELECT doc_id, toxic = 1 AS p, row_number() OVER (PARTITION BY toxic = 1 ORDER BY {_D}, doc_id) AS r FROM labels) WHERE r <= 20""")
def positives_and_controls(spark, sf):
    return sampling.positives_and_controls(table(spark, sf, "labels"), F.col("toxic") == 1, 20, 7, "doc_id").select("doc_id", "positive")


@query("""SELECT doc_id, ncode FROM (SELECT doc_id, 'w' || doc_id AS ncode FROM documents UNION ALL SELECT doc_id, NULL FROM labels) WHERE ncode IS NOT NULL AND ncode NOT IN ('', 'unknown', 'w5')""")
def valid_works(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("w"), F.col("doc_id")).alias("ncode"))
    rows = d.unionByName(table(spark, sf, "labels").select("doc_id"), allowMissingColumns=True)
    return sampling.valid_works(rows, F.col("ncode"), ("", "unknown", "w5"))


@query("""SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels WHERE toxic = 1""")
def union_done(spark, sf):
    return sampling.keys_in_any("doc_id", table(spark, sf, "documents").where("lang = 'en'"), table(spark, sf, "labels").where("toxic = 1"))


@query("""SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""")
def missing_ids(spark, sf):
    return sampling.keys_missing(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("""SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25""")
def first_works(spark, sf):
    return sampling.first_by(table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], 25)


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def newest_per_key(spark, sf):
    return audit.newest(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], "ts").select("user_id", "event_id", "value")


@query("""SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def wanted_rows(spark, sf):
    return sampling.wanted(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").where("quality = 1"), "doc_id")


@query("""SELECT doc_id, r::INT AS run_index FROM documents, range(3) t(r) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) OR r <> 0""")
def repeated_jobs(spark, sf):
    done = table(spark, sf, "labels").where("quality = 1").select("doc_id", F.lit(0).alias("run_index"))
    return sampling.repeated_jobs(table(spark, sf, "documents"), ["doc_id"], 3, done)


@query("""
WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE len(regexp_extract_all(text, '[A-Z][a-z]+')) >= 2 AND source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND doc_id < 300)),
o AS (SELECT source, doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '7', source)), source) AS r FROM p WHERE i = 1) SELECT source, doc_id FROM o WHERE r <= 5""")
def unseen_works(spark, sf):
    """Five works that a first part of the labels, the feature here, hasn't used."""
    d = table(spark, sf, "documents").withColumn("names", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
    seen = table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic = 1 and doc_id < 300"), "doc_id")
    return sampling.unseen_works(d.select("source", "doc_id", "names"), seen, "source", "names", 2, ["doc_id"], 5, 7).select("source", "doc_id")

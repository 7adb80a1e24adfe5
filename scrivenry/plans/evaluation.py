"""Queries of taggers, declared tags, repeated runs, conditions, corpus statistics and views."""

from pyspark.sql import functions as F

from scrivenry.functions import meta, prompts
from scrivenry.operators import audit, classify, evaluation, features, labelfit, pipelines, terms
from scrivenry.plans.common import ORACLE_SQL, query, table
from scrivenry.plans.pipelines import works_of

_LAB = "SELECT doc_id, quality, toxic, n_chars, lang, source FROM documents JOIN labels USING (doc_id)"


def records(spark, sf):
    """Labels in the role of a tagger's answers: one in seven fails."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    ok = F.col("doc_id") % 7 != 0
    content = F.struct((F.col("n_chars") % 4).cast("int").alias("sexual_content"), F.col("quality").cast("int").alias("violence"), F.lit(0).alias("gore"))
    return d.select("doc_id", ok.alias("ok"), (F.col("toxic") == 1).alias("is_r18"), F.when(ok, content).alias("content"), F.when(F.col("doc_id") % 14 == 0, "I'm SORRY").otherwise("?").alias("raw"), (F.col("n_chars") / 100.0).alias("elapsed"))


@query(f"""
WITH d AS (SELECT *, doc_id % 7 <> 0 AS ok, n_chars / 100.0::DOUBLE AS e, (n_chars % 4)::INT AS s FROM ({_LAB})), r AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, count(*) OVER () AS n FROM d),
c AS (SELECT s, quality, count(*) AS n FROM d WHERE ok GROUP BY 1, 2), g AS (SELECT * FROM d WHERE ok)
SELECT (SELECT count(*) FROM d) AS n, (SELECT count_if(ok) FROM d)::BIGINT AS schema_ok, (SELECT round_even(avg(ok::INT), 3) FROM d) AS schema_ok_rate, (SELECT count_if(NOT ok AND doc_id % 14 = 0) FROM d)::BIGINT AS refusal_n,
 (SELECT max(e) FILTER (i = n // 2) FROM r) AS latency_median, (SELECT max(e) FILTER (i = floor(n * 0.9) - 1) FROM r) AS latency_p90,
 (SELECT round_even(count(*) / sum(n), 6)::DOUBLE FROM c) AS distinct_ratio, (SELECT round_even(max(n) / sum(n), 6)::DOUBLE FROM c) AS modal_share,
 (SELECT round_even(avg(s) FILTER (toxic = 1), 2) FROM g) AS sexual_content_mean_r18, (SELECT round_even(avg(s) FILTER (toxic <> 1), 2) FROM g) AS sexual_content_mean_general,
 (SELECT round_even(round_even(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END)::DOUBLE, 6), 3) FROM g a, g b WHERE a.toxic = 1 AND b.toxic <> 1) AS sexual_content_auc,
 (SELECT round_even(avg(quality) FILTER (toxic = 1), 2) FROM g) AS violence_mean_r18, (SELECT round_even(avg(quality) FILTER (toxic <> 1), 2) FROM g) AS violence_mean_general,
 (SELECT round_even(round_even(avg(CASE WHEN a.quality > b.quality THEN 1.0 WHEN a.quality = b.quality THEN 0.5 ELSE 0.0 END)::DOUBLE, 6), 3) FROM g a, g b WHERE a.toxic = 1 AND b.toxic <> 1) AS violence_auc""")
def tagger_summary(spark, sf):
    return evaluation.tagger_summary(records(spark, sf), ["sexual_content", "violence"])


@query(f"""
WITH d AS (SELECT (n_chars % 4)::INT AS s, quality AS v, toxic, doc_id FROM ({_LAB}) WHERE doc_id % 7 <> 0),
p AS (SELECT 'sexual_content' AS axis, s AS p, toxic + 1 AS g FROM d UNION ALL SELECT 'violence', v, CASE WHEN doc_id % 5 <> 0 THEN toxic END FROM d)
SELECT axis, count(*) AS n, round_even(avg((p = g)::INT), 3) AS exact, round_even(avg((abs(p - g) <= 1)::INT), 3) AS within1, round_even(avg(abs(p - g)), 2) AS mae FROM p WHERE g IS NOT NULL GROUP BY axis""")
def gold_agreement(spark, sf):
    found = records(spark, sf).where("ok").select("doc_id", "content.sexual_content", "content.violence")
    gold = table(spark, sf, "labels").select("doc_id", (F.col("toxic") + 1).cast("int").alias("sexual_content"), F.when(F.col("doc_id") % 5 != 0, F.col("toxic").cast("int")).alias("violence"))
    return evaluation.gold_agreement(found, gold, "doc_id", ["sexual_content", "violence"])


def extracted(spark, sf):
    return features.demo(table(spark, sf, "conversations")).select("ncode", "ordinal", (F.col("ordinal") % 5 != 4).alias("ok"), "features")


@query("""
WITH f AS (SELECT conv_id, length(text) AS n FROM conversations WHERE turn % 5 <> 4),
p AS (SELECT conv_id % 3 = 0 AS d, n % 5 = 0 AS male, (n + 3) % 5 = 0 AS reborn, ((n + 2) % 10) IN (0, 5) AS modern, n % 4 >= 3 AS ensemble FROM f),
c AS (SELECT unnest([{'tag': '男主人公', 'd': d, 'g': male}, {'tag': '異世界転生', 'd': false, 'g': reborn}, {'tag': '現代', 'd': d, 'g': modern}, {'tag': '群像劇', 'd': false, 'g': ensemble}], recursive := true) FROM p)
SELECT tag, count_if(d)::BIGINT AS declared_pos, count_if(d AND g)::BIGINT AS tp, count_if(NOT d AND g)::BIGINT AS fp, count_if(d AND NOT g)::BIGINT AS fn, count_if(NOT d AND NOT g)::BIGINT AS tn,
 CASE WHEN count_if(d) > 0 THEN round_even(count_if(d AND g) / count_if(d), 4) END AS recall, CASE WHEN count_if(g) > 0 THEN round_even(count_if(d AND g) / count_if(g), 4) END AS precision FROM c GROUP BY tag""")
def declared_agreement(spark, sf):
    """What features say of four declared tags; a third of the works declare two of them."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("ncode")).distinct().where("ncode % 3 = 0 or ncode % 3 = 1")
    yes = F.col("ncode") % 3 == 0
    manifest = c.select("ncode", F.create_map(F.lit("男主人公"), yes, F.lit("現代"), yes).alias("control_flags"))
    found = evaluation.declared_agreement(extracted(spark, sf), manifest)
    return found.where(F.col("tag").isin("男主人公", "異世界転生", "現代", "群像劇"))


def runs(spark, sf):
    """The first two turns of a conversation as two runs of a method, the next two as those of another."""
    f = features.demo(table(spark, sf, "conversations").where("turn < 4"))
    return f.select("ncode", F.when(F.col("ordinal") < 2, "ends3").otherwise("uniform9").alias("method"), (F.col("ordinal") % 2).cast("int").alias("run_index"), "features", (F.col("ordinal") + 1.0).alias("seconds"), (F.col("ordinal") * 100 + 50).alias("n_chars"))


_RUNS = """
WITH f AS (SELECT conv_id, CASE WHEN turn < 2 THEN 'ends3' ELSE 'uniform9' END AS method, turn % 2 AS run, turn, length(text) AS n FROM conversations WHERE turn < 4),
v AS (SELECT *, n % 5 AS gender, (n + 4) % 7 AS ending, n % 4 AS cnt, n % 3 = 0 AS present, n % 4 AS lvl, (n % 10) / 10.0::DOUBLE AS conf FROM f)"""


@query(_RUNS + """,
p AS (SELECT a.conv_id, a.method, (a.gender = b.gender)::INT AS s1, (a.ending = b.ending)::INT AS s2, (a.present = b.present AND a.lvl = b.lvl)::INT AS s3, (a.conf + b.conf) / 2 AS c, (a.turn + b.turn + 2) / 2.0::DOUBLE AS s, a.turn * 100 + 50 AS n FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.method = b.method AND a.run = 0 AND b.run = 1),
r AS (SELECT method, avg(s1) AS r1, avg(s2) AS r2, avg(s3) AS r3 FROM p GROUP BY 1)
SELECT p.method, count(*) AS n_works, max((r1 = 1)::INT + (r2 = 1)::INT + (r3 = 1)::INT)::BIGINT AS n_fields_always_stable, round_even(max((r1 + r2 + r3) / 3), 4) AS mean_stability, round_even(avg(c), 4) AS mean_confidence, round_even(avg(s), 1) AS mean_seconds, round_even(avg(n), 0)::BIGINT AS mean_chars,
 count_if(s1 + s2 + s3 = 3)::BIGINT AS n_works_fully_stable, round_even(coalesce(sum(c) FILTER (s1 + s2 + s3 = 3), 0) / greatest(1, count_if(s1 + s2 + s3 = 3)), 4) AS conf_when_fully_stable, round_even(coalesce(sum(c) FILTER (s1 + s2 + s3 < 3), 0) / greatest(1, count_if(s1 + s2 + s3 < 3)), 4) AS conf_when_unstable
FROM p JOIN r USING (method) GROUP BY p.method""")
def run_stability(spark, sf):
    return evaluation.stability(runs(spark, sf), ["protagonist_gender", "ending_type", "sexual_content"])


@query(_RUNS + """,
p AS (SELECT a.method, unnest([{'field': 'protagonist_gender', 's': (a.gender = b.gender)::INT}, {'field': 'ending_type', 's': (a.ending = b.ending)::INT}, {'field': 'sexual_content', 's': (a.present = b.present AND a.lvl = b.lvl)::INT}], recursive := true) FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.method = b.method AND a.run = 0 AND b.run = 1)
SELECT method, field, count(*) AS n, round_even(avg(s), 4) AS rate FROM p GROUP BY 1, 2""")
def field_stability(spark, sf):
    """How often two runs agree in each field."""
    return evaluation.field_stability(runs(spark, sf), ["protagonist_gender", "ending_type", "sexual_content"])


@query(_RUNS + """,
p AS (SELECT a.method AS m1, b.method AS m2, (a.gender = b.gender)::INT AS s1, (a.cnt = b.cnt)::INT AS s2, CASE WHEN a.n % 15 = b.n % 15 THEN 1.0 WHEN (a.n + 5) % 15 = b.n % 15 OR (b.n + 5) % 15 = a.n % 15 THEN 1.0 / 3 ELSE 0.0 END AS s3, a.conv_id FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.run = 0 AND b.run = 0 AND a.method < b.method),
s AS (SELECT m1, m2, unnest([{'field': 'protagonist_gender', 's': s1::DOUBLE}, {'field': 'protagonist_count', 's': s2::DOUBLE}, {'field': 'story_shape', 's': s3::DOUBLE}, {'field': 'setting_era', 's': 1.0::DOUBLE}], recursive := true) FROM p)
SELECT m1, m2, field, count(*) AS n, round_even(avg(s), 4) AS agreement FROM s GROUP BY 1, 2, 3""")
def cross_method(spark, sf):
    return evaluation.cross_method(runs(spark, sf), ["protagonist_gender", "protagonist_count", "story_shape", "setting_era"])


@query(_RUNS + """,
p AS (SELECT method, unnest([{'field': 'protagonist_gender', 's': CASE WHEN conv_id % 4 <> 0 THEN (gender = 0)::INT END}, {'field': 'sexual_content', 's': (present AND lvl = 0)::INT}], recursive := true) FROM v WHERE run = 0 AND conv_id % 2 = 0)
SELECT method, field, count(s) AS n, round_even(avg(s), 4) AS agreement FROM p WHERE s IS NOT NULL GROUP BY 1, 2""")
def manual_agreement(spark, sf):
    own = table(spark, sf, "conversations").select(F.col("conv_id").alias("ncode")).distinct().where("ncode % 2 = 0")
    gender = F.when(F.col("ncode") % 4 != 0, "male").otherwise("")
    content = F.struct(F.lit(True).alias("present"), F.lit(0).alias("explicitness"))
    manual = own.select("ncode", F.struct(gender.alias("protagonist_gender"), content.alias("sexual_content")).alias("features"))
    return evaluation.manual_agreement(runs(spark, sf), manual, ["protagonist_gender", "sexual_content"])


@query("""
WITH s AS (SELECT role, regexp_replace(text, '「[^」]*」', '', 'g') AS t FROM conversations), r AS (SELECT role, CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, 'the|ich|que')) * 1000.0::DOUBLE / length(t) ELSE 0 END AS r FROM s),
a AS (SELECT avg(r) FILTER (role = 'user') AS f, median(r) FILTER (role = 'user') AS f2, min(r) FILTER (role = 'user') AS f3, max(r) FILTER (role = 'user') AS f4, avg(r) FILTER (role = 'assistant') AS t, median(r) FILTER (role = 'assistant') AS t2, min(r) FILTER (role = 'assistant') AS t3, max(r) FILTER (role = 'assistant') AS t4 FROM r)
SELECT round_even(f, 6) AS first_mean, round_even(f2, 6) AS first_median, round_even(f3, 6) AS first_least, round_even(f4, 6) AS first_most, round_even(t, 6) AS third_mean, round_even(t2, 6) AS third_median, round_even(t3, 6) AS third_least, round_even(t4, 6) AS third_most,
 round_even(f - t, 6) AS gap, CASE WHEN f - t > 1.0 THEN 'follows' WHEN f - t > 0.3 THEN 'weak' ELSE 'no_effect' END AS verdict FROM a""")
def conditioning_gap(spark, sf):
    return evaluation.conditioning_gap(table(spark, sf, "conversations"), "role", "text", "user", "assistant", ["the", "ich", "que"])


_VERDICT = "CASE WHEN value >= {} THEN 'ok' WHEN value >= {} THEN 'weak' ELSE 'bad' END"


@query(f"""
WITH t AS ({ORACLE_SQL["tagger_summary"]}),
v AS (SELECT unnest([{{'measure': 'distinct_ratio', 'value': distinct_ratio}}, {{'measure': 'sexual_content_auc', 'value': sexual_content_auc}}, {{'measure': 'violence_auc', 'value': violence_auc}}], recursive := true) FROM t)
SELECT measure, value, CASE WHEN measure = 'distinct_ratio' THEN CASE WHEN value >= 0.5 THEN 'ok' ELSE 'bad' END ELSE {_VERDICT.format(0.8, 0.65)} END AS verdict FROM v WHERE value IS NOT NULL""")
def tagger_verdicts(spark, sf):
    """What the tagger's measures say of it."""
    return pipelines.tagger_verdicts(tagger_summary(spark, sf), ["sexual_content", "violence"])


@query("""
WITH h AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'none' ELSE 'foreign' END AS c, len(list_filter(['ing', 'the', 'qu'], lambda x: contains(text, x) AND NOT contains(left(text, 40), x))) AS n FROM documents)
SELECT c AS condition, count(*) AS n, round_even(avg(n), 6) AS mean, round_even(median(n), 6) AS median, round_even(avg((n > 0)::INT), 6) AS any_rate FROM h GROUP BY c""")
def terms_trial(spark, sf):
    condition = F.when(F.col("doc_id") % 3 == 0, "real").when(F.col("doc_id") % 3 == 1, "none").otherwise("foreign")
    hits = terms.used_terms(F.array(*map(F.lit, ["ing", "the", "qu"])), F.col("text"), F.left("text", F.lit(40)))
    return evaluation.terms_trial(table(spark, sf, "documents").select(condition.alias("c"), hits.alias("h")), "c", "h")


@query(f"""
WITH t AS ({ORACLE_SQL["terms_trial"]}), o AS (SELECT max(any_rate) FILTER (condition = 'real') AS real, max(any_rate) FILTER (condition = 'none') AS "none", max(any_rate) FILTER (condition = 'foreign') AS "foreign" FROM t)
SELECT *, CASE WHEN real = 0 AND "none" = 0 AND "foreign" = 0 THEN 'under_powered' WHEN real > 1.5 * "none" AND real > 0.2 THEN 'effective' ELSE 'no_effect' END AS verdict FROM o""")
def trial_verdict(spark, sf):
    """Whether naming terms works."""
    return pipelines.trial_verdict(terms_trial(spark, sf))


@query("""
WITH w AS (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY 1), f AS (SELECT conv_id, length(text) AS n, conv_id % 5 <> 4 AS ok FROM conversations JOIN w USING (conv_id, turn))
SELECT conv_id AS ncode, CASE WHEN ok AND conv_id % 4 <> 0 AND (n + 3) % 5 IN (0, 1) THEN 'isekai' END AS world, CASE WHEN ok THEN ['male', 'female', 'multiple', 'non_human', 'unknown'][n % 5 + 1] ELSE 'unknown' END AS gender, CASE WHEN conv_id % 3 = 0 THEN 'first_person' ELSE 'unknown' END AS viewpoint FROM f""")
def classified_works(spark, sf):
    """The classification of each work from its first chapter's features, its viewpoint and its declared tags."""
    every = features.demo(table(spark, sf, "conversations"))
    first = every.groupBy("ncode").agg(F.min_by("features", "ordinal").alias("features")).select("ncode", (F.col("ncode") % 5 != 4).alias("ok"), "features")
    works = first.select("ncode", F.create_map(F.lit("異世界転生"), F.col("ncode") % 4 == 0).alias("control_flags"))
    viewpoints = first.where("ncode % 3 = 0").select("ncode", F.lit("first_person").alias("viewpoint"))
    found = meta.classify_works(works, first, viewpoints)
    return found.select("ncode", "setting.world", "protagonist.gender", "narrative.viewpoint")


@query()
def feature_ablation(spark, sf):
    """Ranking quality of two tags of conversations under n-grams, extracted features, and both side by side."""
    c = table(spark, sf, "conversations")
    rolled = features.aggregate(features.demo(c))
    vectors = rolled.select("ncode", (F.col("ncode") % 9 != 5).alias("ok"), features.vector(F.struct(*[x for x in rolled.columns if x != "ncode"])).alias("llm"))
    manifest = c.groupBy(F.col("conv_id").alias("ncode")).agg(F.bool_or(F.col("role") == "system").alias("system"), (F.count("*") > 5).alias("long"))
    texts = c.groupBy(F.col("conv_id").alias("ncode")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    works = evaluation.feature_texts(vectors, manifest, texts)
    made = classify.tfidf(works, "text", "tfidf", classify.Vectors(features=20_000))
    made = labelfit.sparse(labelfit.sparse(made, "tfidf"), "llm")
    made = made.withColumn("both", classify.side_by_side(F.col("tfidf"), 20_000, F.col("llm")))
    return classify.ablation(made, {"system": F.col("system"), "long": F.col("long")}, "ncode", {"tfidf": "tfidf", "llm": "llm", "both": "both"})


@query(f"""WITH d AS ({_LAB}) SELECT round_even(avg(n_chars) FILTER (quality = 1), 6) AS with_mean, round_even(avg(n_chars) FILTER (quality <> 1), 6) AS without_mean, round_even(avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality <> 1), 6) AS lift FROM d""")
def plan_lift(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("on", F.col("quality") == 1)
    return evaluation.lift(d, "on", "n_chars")


@query("""
WITH t AS (SELECT unnest(list_distinct([lang, source, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE lang END])) AS value FROM documents) SELECT value, count(*) AS n FROM t GROUP BY value HAVING count(*) >= 20""")
def tag_frequency(spark, sf):
    silver, raw = F.array("lang", "source"), F.array(F.when(F.col("doc_id") % 2 == 0, "even").otherwise(F.col("lang")))
    return evaluation.tag_frequency(table(spark, sf, "documents"), evaluation.either_tags(silver, raw), 20)


def results(spark, sf):
    """Two feature sets' AUC for each source, made by rule."""
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("tag")).agg(F.avg("n_chars").alias("a"), F.max("n_chars").alias("b"))
    sets = F.array(*[F.struct(F.lit(n).alias("features"), e.alias("auc")) for n, e in (("tfidf", F.bround(F.col("a") % 100 / 100, 4)), ("llm", F.bround(F.col("b") % 100 / 100, 4)))])
    return d.select("tag", F.explode(sets).alias("x")).select("tag", "x.*")


_RESULTS = "WITH r AS (SELECT source AS tag, round_even(avg(n_chars) % 100 / 100, 4) AS a, round_even(max(n_chars) % 100 / 100.0::DOUBLE, 4) AS b FROM documents GROUP BY 1)"


@query(_RESULTS + """, d AS (SELECT tag, round_even(b - a, 4) AS delta FROM r), o AS (SELECT *, row_number() OVER (ORDER BY delta DESC, tag) AS t, row_number() OVER (ORDER BY delta, tag) AS s FROM d)
SELECT tag, delta, t::INT AS rank, 'top' AS "end" FROM o WHERE t <= 3 UNION ALL SELECT tag, delta, s::INT, 'bottom' FROM o WHERE s <= 3""")
def feature_deltas(spark, sf):
    return classify.deltas(results(spark, sf), "tfidf", "llm", 3)


@query(_RESULTS + """SELECT 'tfidf' AS features, count_if(a >= b)::BIGINT AS wins FROM r UNION ALL SELECT 'llm', count_if(b >= a)::BIGINT FROM r""")
def feature_wins(spark, sf):
    return classify.wins(results(spark, sf))


@query("""
WITH e AS (SELECT 'n' || conv_id AS ncode, turn // 3 AS episode_no, string_agg(text, chr(10) || chr(10) || '--- chunk boundary ---' || chr(10) || chr(10) ORDER BY turn) AS text, arg_min(role, turn) AS title FROM conversations GROUP BY 1, 2)
SELECT ncode, episode_no, title AS episode_title, length(text)::INT AS n_chars, length(text) > 2500 AS too_long FROM e WHERE length(text) BETWEEN 300 AND 100000""")
def episodes_to_extract(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat(F.lit("n"), "conv_id").alias("ncode"), F.floor(F.col("turn") / 3).alias("episode_no"), F.col("turn").alias("chunk_index"), F.col("role").alias("episode_title"), "text")
    found = pipelines.episodes_to_extract(c, 2500)
    return pipelines.in_length(found.drop("n_chars"), "text", 300, 100000).select("ncode", "episode_no", "episode_title", "n_chars", "too_long")


@query("""
WITH l AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE doc_id % 10 <> 3)
SELECT count(*) AS n_works, count_if(v >= (SELECT max(v) FROM l))::BIGINT AS n_at_cap, min(v) AS least, max(v) FILTER (i = round_even(0.1 * (n - 1), 0)) AS p10, max(v) FILTER (i = round_even(0.25 * (n - 1), 0)) AS p25, max(v) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(v) FILTER (i = round_even(0.75 * (n - 1), 0)) AS p75,
 max(v) FILTER (i = round_even(0.9 * (n - 1), 0)) AS p90, max(v) AS most, round_even(100.0::DOUBLE * count_if(v <= 1000) / count(*), 2) AS pct_1000, round_even(100.0::DOUBLE * count_if(v <= 5000) / count(*), 2) AS pct_5000, (SELECT count(*) FROM documents WHERE doc_id % 10 = 3) AS missing_in_cache FROM l""")
def length_report(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return pipelines.length_report(d.where("doc_id % 10 <> 3"), d, "doc_id", [1000, 5000])


def chunk_rows(spark, sf):
    """Documents in the role of built chunks."""
    tags = F.struct(F.array("lang").alias("genre"), F.array("source").alias("setting"), F.lit("male").alias("protagonist_gender"), F.lit("unknown").alias("viewpoint"), F.array().cast("array<string>").alias("tone"))
    work = F.when(F.col("doc_id") % 9 == 0, "unknown").otherwise(F.col("source"))
    meta = F.struct(work.alias("ncode"), (F.col("doc_id") % 5 == 0).alias("is_r18"), F.when(F.col("doc_id") % 2 == 0, "syosetu").otherwise("kakuyomu").alias("site_type"), F.struct((F.col("n_chars") % 100).cast("int").alias("token_count")).alias("style_metrics"))
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", tags.alias("control_tags"), meta.alias("meta"), F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))


@query("""
SELECT CASE WHEN doc_id % 9 = 0 THEN 'unknown' ELSE source END AS ncode, doc_id::VARCHAR AS id, CASE WHEN doc_id % 9 <> 0 AND source IN (SELECT source FROM documents WHERE doc_id % 4 = 0) THEN ['new'] ELSE [lang] END AS genre FROM documents""")
def retagged(spark, sf):
    """Chunks with new tags for registered works; those of the others stay, and nothing else changes."""
    chunks = chunk_rows(spark, sf)
    known = table(spark, sf, "documents").where("doc_id % 4 = 0").select(F.col("source").alias("ncode")).distinct()
    tags = known.select("ncode", F.struct(F.array(F.lit("new")).alias("genre"), F.array().cast("array<string>").alias("setting"), F.lit("female").alias("protagonist_gender"), F.lit("unknown").alias("viewpoint"), F.array().cast("array<string>").alias("tone")).alias("control_tags"))
    found = pipelines.retag(chunks, tags)
    if pipelines.changed_elsewhere(chunks, found, "id", "control_tags"):
        raise ValueError("re-tagging changed something else")
    return found.select("meta.ncode", "id", "control_tags.genre")


@query("""
SELECT count(*) AS chunks, count_if(doc_id % 9 <> 0 AND source IN (SELECT source FROM documents WHERE doc_id % 4 = 0))::BIGINT AS retagged, count(DISTINCT CASE WHEN doc_id % 9 = 0 THEN 'unknown' WHEN source NOT IN (SELECT source FROM documents WHERE doc_id % 4 = 0) THEN source END) AS works_not_registered FROM documents""")
def registered_tags(spark, sf):
    return pipelines.registered_tags(chunk_rows(spark, sf), table(spark, sf, "documents").where("doc_id % 4 = 0").select(F.col("source").alias("ncode")))


@query("""
SELECT '[viewpoint=unknown][protagonist_gender=male][setting=' || source || '][genre=' || lang || '][r18=' || CASE WHEN doc_id % 5 = 0 THEN 'yes' ELSE 'no' END || '][dialogue=unknown][sentence=unknown]' AS condition, count(*) AS n FROM documents WHERE doc_id % 9 <> 0 GROUP BY 1""")
def training_conditions(spark, sf):
    """Condition lines of the training view."""
    view, _ = pipelines.training_view(chunk_rows(spark, sf))
    return pipelines.condition_counts(view)


@query("""
WITH g AS (SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1)
SELECT 7::BIGINT AS works, 2::BIGINT AS works_without_chunks, 3::BIGINT AS works_r18, 9::BIGINT AS dropped_duplicates, count(*) AS chunks, count_if(doc_id % 10 = 0)::BIGINT AS chunks_val, sum(length(text))::BIGINT AS chars, sum(n_chars % 100)::BIGINT AS tokens,
 (SELECT list(value || '=' || n ORDER BY value) FROM g) AS genre, ['kakuyomu=' || count_if(doc_id % 2 = 1), 'syosetu=' || count_if(doc_id % 2 = 0)] AS site_type FROM documents""")
def corpus_stats(spark, sf):
    works = spark.range(7).select(F.when(F.col("id") < 2, 0).otherwise(5).alias("n_chunks"), (F.col("id") > 3).alias("is_r18"), F.when(F.col("id") == 6, 9).otherwise(0).alias("dropped_duplicates"))
    listed = lambda c: F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))).alias(c)
    one = pipelines.corpus_stats(chunk_rows(spark, sf), works)
    return one.select("works", "works_without_chunks", "works_r18", "dropped_duplicates", "chunks", "chunks_val", "chars", "tokens", listed("genre"), listed("site_type"))


@query("""
WITH n AS (SELECT conv_id, count(*) AS c FROM conversations GROUP BY 1)
SELECT count(*) AS novels_total, 0::BIGINT AS novels_duplicate_ncode, (SELECT count(*) FROM conversations) AS episodes_total, 0::BIGINT AS episodes_duplicate_key, 0::BIGINT AS n_without, count_if(c <> c + conv_id % 2)::BIGINT AS mismatch_general_all_no, count(*) AS mismatch_total_ep,
 0::BIGINT AS orphans, (SELECT count_if(trim(text, ' ') = '') FROM conversations)::BIGINT AS empty_bodies FROM n""")
def audit_report(spark, sf):
    """The report over conversations in the roles of works and episodes."""
    novels, episodes, urls = works_of(spark, sf)
    counts = episodes.groupBy("ncode").agg(F.count("*").alias("c"))
    novels = novels.join(counts, "ncode").withColumn("general_all_no", F.col("c") + F.substring("ncode", 2, 10).cast("long") % 2).withColumn("total_ep", F.lit(None).cast("long"))
    r = audit.report(novels, episodes, urls)
    return r.select("novels_total", "novels_duplicate_ncode", "episodes_total", "episodes_duplicate_key", "n_without", "mismatch_general_all_no", "mismatch_total_ep", F.col("n_orphan_episode_ncodes").alias("orphans"), F.col("empty_body_episode_count").alias("empty_bodies"))


@query("""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ['x', role] ELSE [] END AS t FROM conversations)
SELECT conv_id, turn, t AS terms, ['new'] AS replaced FROM t""")
def header_terms(spark, sf):
    """Terms read from a prompt's header, and put there."""
    listed = F.when(F.col("turn") % 2 == 0, F.array(F.lit("x"), F.col("role"))).otherwise(F.array().cast("array<string>"))
    prompt = prompts.sample_prompt({}, F.lit("t"), F.lit("e"), listed, F.left("text", F.lit(50)))
    swapped = prompts.with_terms(prompt, F.array(F.lit("new")))
    return table(spark, sf, "conversations").select("conv_id", "turn", prompts.header_terms(prompt).alias("terms"), prompts.header_terms(swapped).alias("replaced"))


@query("""SELECT conv_id AS ncode, turn AS ordinal, 77 AS size, (length(text) % 5 = 0)::INT::DOUBLE AS male, ((length(text) % 10) / 10.0)::DOUBLE AS confidence FROM conversations""")
def feature_vectors(spark, sf):
    f = features.demo(table(spark, sf, "conversations")).select("ncode", "ordinal", features.vector(F.col("features")).alias("v"))
    return f.select("ncode", "ordinal", F.size("v").alias("size"), F.col("v")[0].alias("male"), F.element_at("v", -1).alias("confidence"))

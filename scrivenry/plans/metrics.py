"""Queries of distributions, agreement, and ranking quality."""

from pyspark.sql import functions as F

from scrivenry.operators import features, measures
from scrivenry.plans.common import query, table

_RANK = "WITH r AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)"


@query(f"""{_RANK} SELECT count(*) AS n, min(v) AS least, max(v) FILTER (i = round_even(0.1 * (n - 1), 0)) AS p10, max(v) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(v) FILTER (i = round_even(0.9 * (n - 1), 0)) AS p90, max(v) AS most FROM r""")
def length_quantiles(spark, sf):
    return measures.nearest_ranks(table(spark, sf, "documents"), "n_chars", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query(f"""{_RANK} SELECT max(v) FILTER (i = n // 2) AS median, max(v) FILTER (i = floor(n * 0.9) - 1) AS p90, max(v) FILTER (i = floor(n * 0.99)) AS p99 FROM r""")
def index_quantiles(spark, sf):
    n = F.col("__n")
    return measures.at_index(table(spark, sf, "documents"), "n_chars", {"median": F.floor(n / 2), "p90": F.floor(n * 0.9) - 1, "p99": F.floor(n * 0.99)})


@query("""SELECT level::INT AS level, (SELECT count_if(n_chars <= level) FROM documents)::BIGINT AS n, round_even((SELECT count_if(n_chars <= level) * 100.0 / count(*) FROM documents), 6)::DOUBLE AS pct FROM (VALUES (500), (1000), (5000), (20000)) v(level)""")
def length_levels(spark, sf):
    return measures.at_most(table(spark, sf, "documents"), "n_chars", [500, 1000, 5000, 20000])


@query("""SELECT least(n_chars // 500, 12)::INT AS bin, count(*) AS n FROM documents GROUP BY 1""")
def length_hist(spark, sf):
    return measures.histogram(table(spark, sf, "documents"), "n_chars", 500, 12)


@query("""SELECT lang AS value, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM documents GROUP BY lang""")
def tag_shares(spark, sf):
    return measures.shares(table(spark, sf, "documents"), "lang").withColumn("share", F.bround("share", 6))


_LAB = "SELECT doc_id, quality, toxic, n_chars, lang, source FROM documents JOIN labels USING (doc_id)"


def labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


@query(f"""
WITH d AS ({_LAB}), c AS (SELECT unnest([{{'tag': 'long', 't': quality = 1, 'g': n_chars > 1000}}, {{'tag': 'toxic', 't': toxic = 1, 'g': n_chars < 600}}, {{'tag': 'none', 't': false, 'g': lang = 'xx'}}], recursive := true) FROM d),
k AS (SELECT tag, count_if(t AND g)::BIGINT AS tp, count_if(NOT t AND g)::BIGINT AS fp, count_if(t AND NOT g)::BIGINT AS fn, count_if(NOT t AND NOT g)::BIGINT AS tn FROM c GROUP BY tag)
SELECT *, CASE WHEN tp + fn > 0 THEN round_even(tp / (tp + fn), 4) END AS recall, CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 4) END AS precision FROM k""")
def confusion(spark, sf):
    n = F.col("n_chars")
    return measures.confusion(labelled(spark, sf), {"long": (F.col("quality") == 1, n > 1000), "toxic": (F.col("toxic") == 1, n < 600), "none": (F.lit(False), F.col("lang") == "xx")})


@query(f"""WITH d AS ({_LAB}) SELECT round_even((count_if(quality = 1 AND n_chars > 1000) + count_if(toxic = 1 AND n_chars < 600)) / (count_if(quality = 1) + count_if(toxic = 1)), 4) AS micro_recall FROM d""")
def micro_recall(spark, sf):
    return measures.micro_recall(confusion(spark, sf))


_SETS = """
WITH d AS (SELECT doc_id, list_filter([lang, CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS gold,
 list_filter([lang, CASE WHEN n_chars > 1000 THEN 'good' END, CASE WHEN n_chars < 400 THEN 'toxic' END], lambda x: x IS NOT NULL) AS guess FROM documents JOIN labels USING (doc_id)),
s AS (SELECT doc_id, gold, guess, len(list_intersect(gold, guess)) AS tp, len(list_filter(guess, lambda x: NOT list_contains(gold, x))) AS fp, len(list_filter(gold, lambda x: NOT list_contains(guess, x))) AS fn FROM d)"""


def tag_arrays(spark, sf):
    n = F.col("n_chars")
    gold = F.array_compact(F.array("lang", F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    return labelled(spark, sf).select("doc_id", gold.alias("gold"), F.array_compact(F.array("lang", F.when(n > 1000, "good"), F.when(n < 400, "toxic"))).alias("guess"))


@query(f"""{_SETS}, a AS (SELECT count(*) AS n, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg((fp = 0 AND fn = 0)::INT) AS e, avg((tp > 0)::INT) AS p FROM s)
SELECT n, tp, fp, fn, round_even(tp / (tp + fp), 4) AS precision, round_even(tp / (tp + fn), 4) AS recall, round_even(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1, round_even(e, 4) AS exact, round_even(p, 4) AS partial FROM a""")
def micro_prf(spark, sf):
    return measures.tag_sets(tag_arrays(spark, sf), "gold", "guess")


@query(f"""{_SETS} SELECT doc_id, CASE WHEN fp = 0 AND fn = 0 THEN 'exact' WHEN tp > 0 THEN 'partial' ELSE 'none' END AS mark FROM s""")
def match_marks(spark, sf):
    return tag_arrays(spark, sf).select("doc_id", measures.match_mark(F.col("gold"), F.col("guess")).alias("mark"))


@query(f"""WITH d AS (SELECT quality AS g, least(n_chars // 1000, 3) AS p FROM ({_LAB})) SELECT round_even(avg(abs(g - p)), 6) AS mae, round_even(avg((g = p)::INT), 6) AS exact, round_even(avg((abs(g - p) <= 1)::INT), 6) AS within_one FROM d""")
def ordinal_agreement(spark, sf):
    return labelled(spark, sf).agg(*measures.ordinal_agreement(F.col("quality"), F.least(F.floor(F.col("n_chars") / 1000), F.lit(3))))


@query(f"""
WITH d AS ({_LAB}), p AS (SELECT a.n_chars AS x, b.n_chars AS y FROM d a, d b WHERE a.quality = 1 AND b.quality <> 1)
SELECT (SELECT count_if(quality = 1) FROM d)::BIGINT AS n_pos, (SELECT count_if(quality <> 1) FROM d)::BIGINT AS n_neg, round_even(avg(CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0.0 END), 6)::DOUBLE AS auc FROM p""")
def auc_rank(spark, sf):
    return measures.auc(labelled(spark, sf), "quality", "n_chars")


@query(f"""
WITH d AS ({_LAB}), c AS (SELECT n_chars AS s, count_if(quality = 1) AS p, count(*) AS n FROM d GROUP BY 1), w AS (SELECT p, sum(p) OVER (ORDER BY s DESC) / sum(n) OVER (ORDER BY s DESC) AS pr FROM c)
SELECT round_even(sum(p * pr) / sum(p), 6)::DOUBLE AS ap FROM w""")
def average_precision(spark, sf):
    return measures.average_precision(labelled(spark, sf), "quality", "n_chars")


@query(f"""
WITH d AS ({_LAB}), c AS (SELECT n_chars AS s, count_if(quality = 1) AS p, count_if(quality <> 1) AS q FROM d GROUP BY 1),
w AS (SELECT s, (sum(p) OVER (ORDER BY s DESC))::BIGINT AS tp, (sum(q) OVER (ORDER BY s DESC))::BIGINT AS fp, sum(p) OVER () AS a FROM c), f AS (SELECT *, 2.0::DOUBLE * tp / (tp + fp + a) AS f1 FROM w)
SELECT s AS threshold, tp, fp, round_even(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, s DESC LIMIT 1""")
def best_f1(spark, sf):
    return measures.best_f1(labelled(spark, sf), "quality", "n_chars")


@query("""
WITH c AS (SELECT conv_id, role, count(*) AS c FROM conversations GROUP BY 1, 2), o AS (SELECT conv_id, sum(c * (c - 1)) AS s, sum(c) AS m FROM c GROUP BY 1),
ob AS (SELECT avg(s / (m * (m - 1))) AS o FROM o WHERE m > 1), f AS (SELECT role, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM conversations GROUP BY 1),
e AS (SELECT sum(p * p) AS e, arg_max(role, n) AS mv, max(p) AS mp, count(*) AS k FROM f)
SELECT round_even(o, 6)::DOUBLE AS observed, round_even(e, 6)::DOUBLE AS expected, round_even((o - e) / (1 - e), 6)::DOUBLE AS kappa, mv AS majority, round_even(mp, 6)::DOUBLE AS majority_share, k AS n_values FROM ob, e""")
def kappa(spark, sf):
    return measures.chance_corrected(table(spark, sf, "conversations"), "conv_id", "role")


@query("""WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2) SELECT round_even(count(*) / sum(n), 6)::DOUBLE AS distinct_ratio, round_even(max(n) / sum(n), 6)::DOUBLE AS modal_share FROM c""")
def modal_share(spark, sf):
    return measures.modal_share(table(spark, sf, "labels"), "quality", "toxic")


@query(f"""
WITH d AS (SELECT quality AS y, n_chars / 40000.0 AS p FROM ({_LAB})), c AS (SELECT avg(p) FILTER (y = 1) AS c, avg(p) AS m, avg((y = 1)::INT) AS r FROM d)
SELECT round_even(c, 6)::DOUBLE AS pu_c, round_even((SELECT avg(least(1.0, p / c)) FROM d), 6)::DOUBLE AS prevalence, round_even(m, 6)::DOUBLE AS calibrated_mean, round_even(r, 6)::DOUBLE AS silver_rate, (m BETWEEN 0.5 * r AND 3.0 * r) AS calibration_ok FROM c""")
def pu_correct(spark, sf):
    d = labelled(spark, sf).select("quality", (F.col("n_chars") / 40000.0).alias("p"))
    return measures.unlabelled_correction(d, "quality", "p")


@query("""SELECT round_even(exp(sum(n_chars / 20000.0 * n_chars) / sum(n_chars)), 6)::DOUBLE AS perplexity FROM documents""")
def perplexity(spark, sf):
    return measures.perplexity(table(spark, sf, "documents").withColumn("loss", F.col("n_chars") / 20000.0), "loss", "n_chars")


def _influence(spark, sf, tokens):
    e = table(spark, sf, "embeddings")
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return measures.layer_influence(p.withColumn("w", tokens).withColumnRenamed("label", "layer"), "layer", "embedding", "y", "w")


def plain_influence(spark, sf):
    """The same, each pair of vectors counting once."""
    return _influence(spark, sf, F.lit(1)).select("layer", "influence")


@query("""
WITH p AS (SELECT a.label AS layer, a.embedding AS x, b.embedding AS y, 1 + a.vec_id % 7 AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
c AS (SELECT layer, w, list_dot_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[]))) AS c FROM p)
SELECT layer, sum(w)::BIGINT AS n_tokens, round_even(sum(c * w) / sum(w), 6) AS similarity, round_even(1 - sum(c * w) / sum(w), 6) AS influence FROM c GROUP BY layer""")
def layer_influence(spark, sf):
    """Neighbouring vectors as what goes into a layer and what comes out, by their numbers of tokens."""
    return _influence(spark, sf, 1 + F.col("vec_id") % 7)


@query("""
WITH r AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT max(n) AS n, min(v) AS least, max(v) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(v) FILTER (i = round_even(0.9 * (n - 1), 0)) AS p90, max(v) FILTER (i = round_even(0.99 * (n - 1), 0)) AS p99, max(v) AS most,
 count_if(v > 4096)::BIGINT AS over, round_even(count_if(v > 4096) / max(n), 6) AS over_share FROM r""")
def lengths_over(spark, sf):
    """The lengths of all documents and the share above a limit."""
    return measures.lengths_over(table(spark, sf, "documents"), "n_chars", 4096)


@query("""
WITH w AS (SELECT source, lang, sum(CASE WHEN coalesce(quality, 0) = 0 THEN 1.0 ELSE 2.0 END) AS w FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
m AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY w DESC, lang DESC) AS r FROM w),
t AS (SELECT source, sum(CASE WHEN coalesce(quality, 0) = 0 THEN 1.0 ELSE 2.0 END) AS sw, sum(n_chars * CASE WHEN coalesce(quality, 0) = 0 THEN 1.0 ELSE 2.0 END) AS sx, bool_or(coalesce(toxic, 0) = 1) AS any_toxic, max(n_chars) AS longest FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, lang, round_even(sx / sw, 0)::DOUBLE AS mean_chars, any_toxic, longest FROM t JOIN m USING (source) WHERE r = 1""")
def weighted_rollup(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    weight = F.when(F.coalesce("quality", F.lit(0)) == 0, 1.0).otherwise(2.0)
    mode = measures.weighted_mode(d, ["source"], "lang", weight, "lang")
    sums = d.groupBy("source").agg(F.bround(F.sum(F.col("n_chars") * weight) / F.sum(weight)).alias("mean_chars"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("any_toxic"), F.max("n_chars").alias("longest"))
    return mode.join(sums, "source")


def _rollup_sql() -> str:
    pick = lambda values, n: f"({list(values)!r})[({n}) % {len(values)} + 1]"
    said = [f"SELECT conv_id, turn, '{k}' AS field, {pick(v, f'n + {i}')} AS value, w AS s, 0 AS pos FROM c" for i, (k, v) in enumerate(features.CATEGORICAL.items())]
    said += [f"SELECT conv_id, turn, 'story_shape', {pick(features.SHAPES, f'n + {5 * i}')}, w * {1 - 0.25 * i}, {i} FROM c" for i in (0, 1)]
    said.append(f"SELECT conv_id, turn, 'main_relationships', {pick(features.RELATIONSHIPS, 'n')}, w * {pick([str(x) for x in features.SALIENCE.values()], 'n')}::DOUBLE, 0 FROM c")
    mode = ", ".join(f"max(value) FILTER (field = '{k}' AND m = 1) AS {k}" for k in features.CATEGORICAL)
    return f"""
WITH c AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN length(text) % 10 = 0 THEN 1.0 ELSE (length(text) % 10) / 10.0 END::DOUBLE AS w FROM conversations),
x AS ({" UNION ALL ".join(said)}),
g AS (SELECT conv_id, field, value, round(sum(s), 9) AS s, min(turn * 10 + pos) AS first FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, field ORDER BY s DESC, value DESC) AS m, row_number() OVER (PARTITION BY conv_id, field ORDER BY s DESC, first) AS k FROM g),
t AS (SELECT conv_id, round(sum(w), 9) AS total, round_even(sum((n % 4) * w) / round(sum(w), 9), 0)::INT AS protagonist_count, bool_or(n % 3 = 0) AS sexual_present, max(n % 4)::INT AS sexual_level, bool_or((n + 1) % 3 = 0) AS violence_present, max((n + 1) % 4)::INT AS violence_level, round_even(avg((n % 10) / 10.0::DOUBLE), 4) AS confidence FROM c GROUP BY 1)
SELECT conv_id AS ncode, {mode}, 'now' AS setting_era, max(protagonist_count) AS protagonist_count, bool_or(sexual_present) AS sexual_present, max(sexual_level) AS sexual_level, bool_or(violence_present) AS violence_present, max(violence_level) AS violence_level,
 string_agg(value, ',' ORDER BY k) FILTER (field = 'story_shape' AND k <= 3) AS shapes, string_agg(value || ':' || CASE WHEN s >= total * 0.75 THEN 'central' ELSE 'major' END, ',' ORDER BY k) FILTER (field = 'main_relationships' AND k <= 4) AS relationships, max(confidence) AS confidence
FROM r JOIN t USING (conv_id) GROUP BY conv_id"""


@query(_rollup_sql())
def feature_rollup(spark, sf):
    """The roll-up of chapter features to works, on features made from conversations."""
    found = features.aggregate(features.demo(table(spark, sf, "conversations")))
    content = [F.col(f"{c}_content.{x}").alias(f"{c}_{n}") for c in ("sexual", "violence") for x, n in (("present", "present"), ("explicitness", "level"))]
    kinds = F.transform("main_relationships", lambda x: F.concat(x["kind"], F.lit(":"), x["salience"]))
    return found.select("ncode", *features.ROLLED_UP, "protagonist_count", *content, F.array_join("story_shape", ",").alias("shapes"), F.array_join(kinds, ",").alias("relationships"), "confidence")


@query("""
WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY lang) AS k FROM d)
SELECT lang, min(n) AS least, max(n) FILTER (i = k // 2) AS p50, max(n) AS most FROM r GROUP BY lang""")
def per_condition(spark, sf):
    n = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return measures.spread(n, "lang", "n")


@query("""WITH d AS (SELECT conv_id, role, avg(length(text)) AS v FROM conversations GROUP BY 1, 2) SELECT a.role AS m1, b.role AS m2, count(*) AS n, round_even(avg((abs(a.v - b.v) < 100)::INT), 6) AS agreement FROM d a JOIN d b ON a.conv_id = b.conv_id AND a.role < b.role GROUP BY 1, 2""")
def method_pairs(spark, sf):
    d = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.avg(F.length("text")).alias("v"))
    return measures.pairwise(d, "conv_id", "role", "v", lambda a, b: F.abs(a - b) < 100)


@query("""SELECT quality = 1 AS good, count(*) AS n, round_even(avg(n_chars), 6) AS mean_chars, round_even(median(n_chars), 6) AS median_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def group_means(spark, sf):
    return measures.group_means(labelled(spark, sf), F.col("quality") == 1, "n_chars").toDF("good", "n", "mean_chars", "median_chars")


@query("""SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 1000""")
def status_counts(spark, sf):
    return measures.frequent(table(spark, sf, "events"), F.col("event_type"), 1000).withColumnRenamed("value", "status")


@query("""
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS t, row_number() OVER (ORDER BY n_chars, doc_id) AS b FROM documents)
SELECT doc_id, n_chars, t::INT AS rank, 'top' AS "end" FROM r WHERE t <= 5 UNION ALL SELECT doc_id, n_chars, b::INT, 'bottom' FROM r WHERE b <= 5""")
def extremes(spark, sf):
    return measures.extremes(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 5, "doc_id")

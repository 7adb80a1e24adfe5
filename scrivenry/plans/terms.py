"""Queries of terms, lexicons, viewpoint rates and text overlap, with Latin patterns for the driver's tables."""

from pyspark.sql import functions as F

from scrivenry.functions import text as T
from scrivenry.operators import dedup, terms
from scrivenry.plans.common import query, spread, table

_STOP = ["that", "with", "this", "from"]
_LEXICON = ["ing", "the", "tion", "ou"]


@query(r"""
WITH t AS (SELECT source, unnest(list_filter(regexp_extract_all(text, '[a-z]{4,9}'), lambda w: w NOT IN ('that', 'with', 'this', 'from'))) AS term FROM documents),
c AS (SELECT source, term, count(*) AS tf FROM t GROUP BY 1, 2 HAVING count(*) >= 3), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(DISTINCT source) AS n FROM documents),
s AS (SELECT source, c.term, tf, tf * ln(n / df) AS score FROM c JOIN d USING (term), n WHERE df <= n * 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term DESC, tf DESC) AS rank FROM s)
SELECT source, term, tf, round_even(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 8""")
def term_topk(spark, sf):
    d = spread(table(spark, sf, "documents").select("source", "text"))
    found = terms.candidates(F.col("text"), always="(?!)", filtered="[a-z]{4,9}", stop=_STOP)
    return terms.top_terms(d, "source", found, 8, 3, 0.3).withColumn("score", F.bround("score", 6))


@query(r"""
WITH s AS (SELECT source, regexp_replace(text, '"[^"]*"', '', 'g') AS story FROM documents),
h AS (SELECT source, story, regexp_extract_all(story, 'the|of|la') AS hits FROM s),
a AS (SELECT source, sum(length(story))::BIGINT AS narration_chars, sum(len(hits))::BIGINT AS first_person_hits, sum(len(list_filter(hits, lambda x: x = 'the')))::BIGINT AS p_the, sum(len(list_filter(hits, lambda x: x = 'of')))::BIGINT AS p_of, sum(len(list_filter(hits, lambda x: x = 'la')))::BIGINT AS p_la, count(*) AS n, count_if(len(hits) > 0) AS nh FROM h GROUP BY 1)
SELECT source, narration_chars, first_person_hits, round_even(first_person_hits * 1000.0 / narration_chars, 4)::DOUBLE AS rate_per_1000, round_even(nh / n, 4)::DOUBLE AS line_rate,
 CASE WHEN narration_chars < 2000 THEN 'unknown' WHEN first_person_hits * 1000.0 / narration_chars >= 12 THEN 'first_person' WHEN first_person_hits * 1000.0 / narration_chars < 10 THEN 'third_person' ELSE 'unknown' END AS viewpoint, p_the, p_of, p_la FROM a""")
def rate_rule(spark, sf):
    found = terms.viewpoints(spread(table(spark, sf, "documents").select("source", "text")), "source", "text", ["the", "of", "la"], '"', '"', 10.0, 12.0)
    own = lambda p: F.coalesce(F.try_element_at("pronouns", F.lit(p)), F.lit(0)).cast("long").alias(f"p_{p}")
    return found.select("source", "narration_chars", "first_person_hits", "rate_per_1000", "line_rate", "viewpoint", own("the"), own("of"), own("la"))


@query("""
WITH s AS (SELECT source, doc_id, ((length(text) - length(replace(text, 'ing', ''))) // 3 + (length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'tion', ''))) // 4 + (length(text) - length(replace(text, 'ou', ''))) // 2)::INT AS score FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM s) SELECT source, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def lexicon_hardest(spark, sf):
    return terms.hardest(spread(table(spark, sf, "documents").select("source", "doc_id", "text")), "text", _LEXICON, "source", 5).select("source", "doc_id", "score", "rank")


_PAIR = "SELECT d.doc_id, b.item_id, d.text || left(b.text, 60) AS a, b.text AS b FROM documents d JOIN benchmark b ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id"


@query(f"""
WITH p AS ({_PAIR}), t AS (SELECT doc_id, item_id, right(a, 1200) AS tail, b, left(b, 20) AS head FROM p WHERE length(a) >= 20 AND length(b) >= 20),
i AS (SELECT doc_id, item_id, tail, b, unnest(range(1, greatest(length(tail) - 18, 2))) AS i FROM t WHERE contains(tail, head)),
k AS (SELECT doc_id, item_id, max(length(tail) - i + 1) AS n FROM i WHERE substr(tail, i, 20) = left(b, 20) AND starts_with(b, substr(tail, i)) GROUP BY 1, 2)
SELECT p.doc_id, p.item_id, coalesce(k.n, 0)::INT AS overlap FROM p LEFT JOIN k USING (doc_id, item_id)""")
def overlap_len(spark, sf):
    """How much of an item each document ends with, every document against one item."""
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark").withColumnRenamed("text", "item")
    n = b.agg((F.max("item_id") + 1).alias("n"))  # one row
    p = d.crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(b, "item_id").withColumn("a", F.concat("text", F.left("item", F.lit(60))))
    return p.select("doc_id", "item_id", T.overlap_length(F.col("a"), F.col("item")).alias("overlap"))


@query("""
WITH p AS (SELECT c.conv_id, c.turn, c.text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS ctx FROM conversations c)
SELECT conv_id, turn, list_filter(['ing', 'once', 'house', 'ation', 'qu'], lambda t: contains(text, t) AND NOT contains(ctx, t)) AS used FROM p""")
def used_terms(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").withColumn("ctx", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    known = F.array(*map(F.lit, ["ing", "once", "house", "ation", "qu"]))
    return c.select("conv_id", "turn", terms.used_terms(known, F.col("text"), F.col("ctx")).alias("used"))


@query("""
WITH s AS (SELECT len(list_filter(['ing', 'zzz', 'the'], lambda t: contains(text, t))) / 3.0::DOUBLE AS s FROM conversations)
SELECT count(*) AS n, round_even(avg(s), 6) AS mean, round_even(median(s), 6) AS median, round_even(avg((s > 0)::INT), 6) AS any_rate FROM s""")
def terms_coverage(spark, sf):
    c = table(spark, sf, "conversations").withColumn("t", F.array(F.lit("ing"), F.lit("zzz"), F.lit("the")))
    return terms.coverage(c, "t", "text")


@query(r"""
WITH e AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,5}')) AS own, ['Then', 'Them', 'Ouier'] AS known FROM documents),
n AS (SELECT *, list_filter(own, lambda x: NOT list_contains(known, x)) AS novel FROM e)
SELECT doc_id, round_even(CASE WHEN len(own) > 0 THEN len(novel) / len(own) ELSE 0 END, 6) AS novel,
 round_even(CASE WHEN len(own) > 0 THEN len(list_filter(novel, lambda x: list_bool_or(list_transform(known, lambda k: levenshtein(x, k) = 1)))) / len(own) ELSE 0 END, 6) AS drift,
 round_even(len(list_filter(known, lambda k: contains(text, k) AND NOT contains(left(text, length(text) // 2), k))) / len(known), 6) AS late FROM n""")
def plot_following(spark, sf):
    d = table(spark, sf, "documents").withColumn("p", terms.plot_following(F.col("text"), F.array(F.lit("Then"), F.lit("Them"), F.lit("Ouier")), r"[A-Z][a-z]{3,5}"))
    return d.select("doc_id", *[F.bround(f"p.{c}", 6).alias(c) for c in ("novel", "drift", "late")])


@query("""
WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'),
o AS (SELECT conv_id, text, row_number() OVER (ORDER BY md5(concat_ws(':', '7', CAST(conv_id AS VARCHAR))), conv_id) AS i, count(*) OVER () AS n FROM r WHERE i = 1)
SELECT a.conv_id, length(b.text)::INT AS foreign_chars FROM o a JOIN o b ON b.i = CASE WHEN a.i = a.n THEN 1 ELSE a.i + 1 END""")
def foreign_terms(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    first = table(spark, sf, "conversations").where("role = 'user'").withColumn("i", F.row_number().over(w)).where("i = 1")
    return terms.foreign(first, "conv_id", "text", 7, "other").select("conv_id", F.length("other").alias("foreign_chars"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\x{A0}]+', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN length(t) < 5 THEN CASE WHEN t = '' THEN [] ELSE [t] END ELSE list_distinct([substring(t, i, 5) FOR i IN range(1, length(t) - 3)]) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT x.doc_id, count(*) AS c FROM g x JOIN g y ON y.doc_id = x.doc_id + 20 AND x.g = y.g GROUP BY 1)
SELECT a.doc_id, o.doc_id AS other, round_even(CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 1.0 ELSE coalesce(c, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(c, 0))::DOUBLE END, 6)::DOUBLE AS jaccard
FROM documents a JOIN documents o ON o.doc_id = a.doc_id + 20 LEFT JOIN n x ON x.doc_id = a.doc_id LEFT JOIN n y ON y.doc_id = o.doc_id LEFT JOIN b ON b.doc_id = a.doc_id""")
def gram_jaccard(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.without_space("text").alias("text"))
    other = d.select((F.col("doc_id") - 20).alias("doc_id"), F.col("doc_id").alias("other"), F.col("text").alias("other_text"))
    pairs = d.join(other, "doc_id")  # texts are joined, not grams: these are many times as large
    grams = pairs.select("doc_id", "other", *[dedup.char_grams(c).alias(c) for c in ("text", "other_text")])
    return grams.select("doc_id", "other", F.bround(dedup.jaccard(F.col("text"), F.col("other_text")), 6).alias("jaccard"))


@query()
def near_dups(spark, sf):
    """Greedy near-duplicates among the turns of a conversation."""
    return dedup.greedy_near_duplicates(table(spark, sf, "conversations"), ["conv_id"], "turn", "text", 0.9).select("conv_id", "turn", "duplicate_of")


@query(r"""
SELECT doc_id, doc_id % 5 = 1 OR regexp_matches(text, '(?i)cannot assist|i''m sorry|as an ai|i can''?t') AS refusal, doc_id % 3 = 1 AS afterword, regexp_matches(text, 'And then|The end') AS latin_afterword, length(regexp_replace(text, '\s+', '', 'g')) = 0 AS blank FROM documents""")
def text_flags(spark, sf):
    """Refusals and afterwords by the library's patterns, planted in some texts, and by one that is given."""
    t = F.col("text")
    planted = F.concat(t, F.when(F.col("doc_id") % 5 == 1, " できません ").otherwise(""), F.when(F.col("doc_id") % 3 == 1, " 誤字報告 ").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", T.is_refusal(planted).alias("refusal"), T.is_afterword(planted).alias("afterword"), T.is_afterword(t, "And then|The end").alias("latin_afterword"), T.is_blank(t).alias("blank"))


@query(r"""
WITH t AS (SELECT doc_id, [x FOR x IN ['ing', 'the', 'zzz'] IF doc_id % 4 <> 0] AS t, left(text, 200) AS c, text FROM documents),
o AS (SELECT len(t) AS n, len(list_filter(t, lambda x: contains(c, x))) AS c, len(list_filter(t, lambda x: contains(text, x))) AS x FROM t WHERE len(t) > 0)
SELECT (SELECT count_if(len(t) = 0) FROM t)::BIGINT AS without_terms, count(*) AS with_terms, median(n) AS terms_median, round_even(avg(n), 6) AS terms_mean, median(c) AS in_context_median, round_even(avg(c), 6) AS in_context_mean,
 median(x) AS in_text_median, round_even(avg(x), 6) AS in_text_mean, round_even(avg((x > 0)::INT), 6) AS any_rate, 3::BIGINT AS distinct_terms, 0.0::DOUBLE AS katakana_share, 0.0::DOUBLE AS kanji_share FROM o""")
def terms_summary(spark, sf):
    listed = F.when(F.col("doc_id") % 4 != 0, F.array(F.lit("ing"), F.lit("the"), F.lit("zzz"))).otherwise(F.array().cast("array<string>"))
    d = table(spark, sf, "documents").select(listed.alias("t"), F.left("text", F.lit(200)).alias("c"), "text")
    return terms.summary(d, "t", "c", "text")


@query(r"""
SELECT doc_id, list_filter(['ing', 'the', 'zzz'], lambda x: contains(text, x)) AS hits, round_even(len(list_filter(['ing', 'the', 'zzz'], lambda x: contains(text, x))) / 3.0, 6)::DOUBLE AS rate, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents""")
def terms_present(spark, sf):
    known = F.array(*map(F.lit, ["ing", "the", "zzz"]))
    d = table(spark, sf, "documents").select("doc_id", terms.present(known, F.col("text")).alias("p"), T.space_digest("text").alias("digest"))
    return d.select("doc_id", "p.hits", F.bround("p.rate", 6).alias("rate"), "digest")


@query("""SELECT doc_id, (length(text) + 3 + CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END)::INT AS n FROM documents""")
def nested_quotations(spark, sf):
    """Quotations nested up to 22 deep behind each text."""
    deep = (F.col("doc_id") % 23).cast("int")
    t = F.concat("text", F.repeat(F.lit("「"), deep), F.lit("q"), F.repeat(F.lit("」"), deep), F.lit("end"))
    return table(spark, sf, "documents").select("doc_id", F.length(T.strip_nested(t)).alias("n"))


@query(r"""
WITH p AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS c FROM conversations),
t AS (SELECT conv_id, turn, rtrim(c || left(text, CASE WHEN turn % 4 = 0 THEN 30 ELSE 0 END), chr(10)) AS c, ltrim(text, chr(10)) AS t FROM p),
k AS (SELECT conv_id, turn, max(n) AS n FROM t, range(20, 1201) r(n) WHERE n <= length(c) AND n <= length(t) AND right(c, n) = left(t, n) GROUP BY 1, 2)
SELECT (SELECT count(*) FROM t) AS rows, count(*) AS overlapping, median(n) AS median, max(n)::INT AS most FROM k""")
def copied_context(spark, sf):
    from pyspark.sql import Window

    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    c = table(spark, sf, "conversations").withColumn("c", F.concat(before, F.left("text", F.when(F.col("turn") % 4 == 0, 30).otherwise(0))))
    return terms.copied_context(c, "c", "text")

"""Characteristic terms of works, lexicon scores, viewpoint by pronoun rates, and how texts use terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.functions.text import occurrences, only_script, overlap_length, strip_nested
from scrivenry.operators.ranks import drawn

# What a candidate term looks like, common words that are none, and first-person pronouns.
KATAKANA, KANJI = "[ァ-ヴー]{2,}", "[一-龥]{2,4}"
STOP_WORDS = [
    "自分", "相手", "本当", "今日", "明日", "昨日", "時間", "場所", "世界", "人間",
    "言葉", "気持", "様子", "感じ", "普通", "問題", "必要", "以上", "以下", "一人",
    "二人", "全部", "最初", "最後", "今回", "前回", "程度", "状態", "場合", "理由",
    "方法", "結果", "関係", "意味", "存在", "可能", "無理", "大丈夫", "一緒", "一体",
]
PRONOUNS = ["俺", "私", "僕", "あたし", "儂", "わし", "拙者", "吾輩", "我輩", "オレ", "ワタシ", "ボク", "わたし", "ぼく", "おれ"]


def candidates(text: Column, always: str = KATAKANA, filtered: str = KANJI, stop: list[str] | None = None) -> Column:
    """Terms of a text: all matches of one pattern, and those of the other that aren't common words."""
    words = F.regexp_extract_all(text, F.lit(filtered), F.lit(0))
    stop = STOP_WORDS if stop is None else stop
    return F.concat(F.regexp_extract_all(text, F.lit(always), F.lit(0)), F.filter(words, lambda w: ~w.isin(stop)) if stop else words)


def top_terms(df: DataFrame, work: str, terms: Column, top: int = 8, least: int = 5, widest: float = 0.3) -> DataFrame:
    """Rows (work, term, tf, score, rank): the ``top`` terms of each work by tf * ln(works / df).

    A term counts where it occurs ``least`` times in the work, and is left out where more than ``widest`` of
    all works have it.  Equal scores: by term, then by count, both descending.  Counts are summed before they are
    exchanged, and ranks are limited in each task before the works' rows meet.
    """
    counts = df.select(work, F.explode(terms).alias("term")).groupBy(work, "term").agg(F.count("*").alias("tf")).where(F.col("tf") >= least)
    works = df.agg(F.countDistinct(work).alias("__n"))
    spread = counts.groupBy("term").agg(F.count("*").alias("__df"))
    scored = counts.join(spread, "term").crossJoin(F.broadcast(works)).where(F.col("__df") <= F.col("__n") * widest)
    scored = scored.withColumn("score", F.col("tf") * F.log(F.col("__n") / F.col("__df")))
    w = Window.partitionBy(work).orderBy(F.desc("score"), F.desc("term"), F.desc("tf"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(work, "term", "tf", "score", "rank")


def hardest(df: DataFrame, text: str, lexicon: list[str], group: str, top: int) -> DataFrame:
    """The ``top`` rows of each group by occurrences of the lexicon's terms."""
    return ranked(df.withColumn("score", occurrences(text, lexicon)), group, "score", top)


def ranked(df: DataFrame, group: str, score: str, top: int, tie: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _only(hits: str, pronoun: str) -> Column:
    return F.filter(hits, lambda h: h == F.lit(pronoun))


def viewpoints(df: DataFrame, work: str, text: str, pronouns: list[str] | None = None, opening: str = "「『", closing: str = "」』", low: float = 0.5, high: float = 1.0, least_chars: int = 2000) -> DataFrame:
    """Per work: viewpoint by first-person pronouns in a thousand characters of narration, with the counts.

    Between ``low`` and ``high``, and below ``least_chars`` of narration, it is unknown.
    """
    if low > high:
        raise ValueError("low must not exceed high")
    pronouns = pronouns or PRONOUNS
    story = strip_nested(F.coalesce(F.col(text), F.lit("")), opening, closing)
    hits = F.regexp_extract_all("__story", F.lit("|".join(pronouns)), F.lit(0))
    rows = df.select(work, story.alias("__story")).withColumn("__hits", hits)
    sums = rows.groupBy(work).agg(
        F.sum(F.length("__story")).alias("narration_chars"), F.sum(F.size("__hits")).alias("first_person_hits"), F.count("*").alias("lines"), F.count_if(F.size("__hits") > 0).alias("lines_hit"),
        *[F.sum(F.size(_only("__hits", p))).alias(f"__p{i}") for i, p in enumerate(pronouns)],
    )
    rate = F.coalesce(F.try_divide(F.col("first_person_hits") * 1000.0, F.col("narration_chars")), F.lit(0.0))
    view = F.when(F.col("narration_chars") < least_chars, "unknown").when(rate >= high, "first_person").when(rate < low, "third_person").otherwise("unknown")
    entries = F.filter(F.array(*[F.struct(F.lit(p).alias("k"), F.col(f"__p{i}").alias("v")) for i, p in enumerate(pronouns)]), lambda e: e["v"] > 0)
    line_rate = F.coalesce(F.try_divide("lines_hit", F.col("lines")), F.lit(0.0))
    return sums.select(work, view.alias("viewpoint"), "narration_chars", "first_person_hits", F.bround(rate, 4).alias("rate_per_1000"), F.bround(line_rate, 4).alias("line_rate"), F.map_from_entries(entries).alias("pronouns"))


def pronoun_rate(text: Column, pronouns: list[str] | None = None) -> Column:
    """First-person pronouns in a thousand characters of narration."""
    story = strip_nested(text, "「『", "」』")
    return F.coalesce(F.try_divide(F.regexp_count(story, F.lit("|".join(pronouns or PRONOUNS))) * 1000.0, F.length(story)), F.lit(0.0))


def used_terms(terms: Column, text: Column, context: Column) -> Column:
    """Terms that a text has and its context hasn't."""
    return F.filter(terms, lambda t: text.contains(t) & ~context.contains(t))


def coverage(df: DataFrame, terms: str, text: str) -> DataFrame:
    """One row: mean and median share of terms that occur in the text, and how many rows have one at least."""
    share = F.try_divide(F.size(F.filter(terms, lambda t: F.col(text).contains(t))), F.size(terms))
    own = df.where(F.size(terms) > 0).select(share.alias("s"))
    return own.agg(F.count("*").alias("n"), F.bround(F.avg("s"), 6).alias("mean"), F.bround(F.median("s"), 6).alias("median"), F.bround(F.avg((F.col("s") > 0).cast("int")), 6).alias("any_rate"))


def entities(text: Column, pattern: str = "[ァ-ヴー]{3,}", common: list[str] | None = None) -> Column:
    """Distinct names of a text but for common words."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, common))) if common else found


def plot_following(text: Column, known: Column, pattern: str = "[ァ-ヴー]{3,}", common: list[str] | None = None) -> Column:
    """struct<novel, drift, late>: names the plan doesn't have, of these those one edit from a planned one, and
    planned names that occur only in the second half; each as a share of the names (or of the planned)."""
    own = entities(text, pattern, common)
    novel = F.array_except(own, known)
    drift = F.filter(novel, lambda n: F.exists(known, lambda k: F.levenshtein(n, k) == 1))
    half = F.floor(F.length(text) / 2).cast("int")
    late = F.filter(known, lambda k: text.contains(k) & ~F.left(text, half).contains(k))
    over = lambda a, b: F.coalesce(F.try_divide(F.size(a), F.size(b)), F.lit(0.0))
    return F.struct(over(novel, own).alias("novel"), over(drift, own).alias("drift"), over(late, known).alias("late"))


def foreign(df: DataFrame, key: str, value: str, seed: int, out: str = "foreign") -> DataFrame:
    """Adds another row's value: rows in drawn order, each takes the next one's, the last the first's.  Keys are
    numbered, and values joined to the numbers; a key stands in one row."""
    keys = drawn(df.select(F.col(key).alias("__key")), [], seed, "__key", "__i")
    n = keys.agg(F.count("*").alias("__n"))
    following = F.when(F.col("__i") == F.col("__n"), F.lit(1)).otherwise(F.col("__i") + 1)
    pairs = keys.crossJoin(F.broadcast(n)).select(F.col("__key").alias(key), following.alias("__i")).join(keys, "__i").select(key, "__key")
    others = pairs.join(df.select(F.col(key).alias("__key"), F.col(value).alias(out)), "__key").drop("__key")
    return df.join(others, key)


def summary(df: DataFrame, terms: str, context: str, text: str) -> DataFrame:
    """One row on named terms as a signal: rows without any, and of the others how many terms they have, how many of
    these the context has, and the text; the share of rows whose text has one; distinct terms and the shares of them
    in each script."""
    count = lambda c: F.size(F.filter(terms, lambda t: F.col(c).contains(t)))
    own = df.where(F.size(terms) > 0).select(F.size(terms).alias("n"), count(context).alias("c"), count(text).alias("t"))
    two = lambda c, name: [F.bround(F.median(c), 6).alias(f"{name}_median"), F.bround(F.avg(c), 6).alias(f"{name}_mean")]
    per_row = own.agg(F.count("*").alias("with_terms"), *two("n", "terms"), *two("c", "in_context"), *two("t", "in_text"), F.bround(F.avg((F.col("t") > 0).cast("int")), 6).alias("any_rate"))
    distinct = df.select(F.explode(terms).alias("t")).distinct()
    share = lambda script: F.coalesce(F.bround(F.avg(only_script("t", script).cast("int")), 6), F.lit(0.0))
    scripts = distinct.agg(F.count("*").alias("distinct_terms"), share("ァ-ヶー").alias("katakana_share"), share("一-龥").alias("kanji_share"))
    without = df.agg(F.count_if(F.coalesce(F.size(terms), F.lit(0)) <= 0).alias("without_terms"))
    return without.crossJoin(per_row).crossJoin(scripts)  # each has one row


def present(terms: Column, text: Column) -> Column:
    """struct<hits, rate>: the terms a text has, and their share."""
    hits = F.filter(terms, lambda t: text.contains(t))
    return F.struct(hits.alias("hits"), F.coalesce(F.try_divide(F.size(hits), F.size(terms)), F.lit(0.0)).alias("rate"))


def copied_context(df: DataFrame, context: str, text: str, least: int = 20, most: int = 1200) -> DataFrame:
    """One row: rows whose text begins with the end of its context, which none should, and how long that is."""
    size = overlap_length(F.rtrim(F.col(context), F.lit("\n")), F.ltrim(F.col(text), F.lit("\n")), least, most)
    own = df.select(size.alias("n"))
    return own.agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 0).alias("overlapping"), F.median(F.when(F.col("n") > 0, F.col("n"))).alias("median"), F.max(F.when(F.col("n") > 0, F.col("n"))).alias("most"))

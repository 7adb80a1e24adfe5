"""Order statistics, distributions, agreement and ranking measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.operators.ranks import running


def _placed(df: DataFrame, column: str) -> DataFrame:
    """Counts of each value with the ranks they take: first __a, last __b, of __n in all.

    Values are counted before they are ordered, and ordered in stretches.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"))
    return running(counts, "v", {"__e": "__c"}).crossJoin(F.broadcast(total)).select("v", (F.col("__e") - F.col("__c")).alias("__a"), (F.col("__e") - 1).alias("__b"), "__n")


def _at(place: Column) -> Column:
    return F.max(F.when((F.col("__a") <= place) & (place <= F.col("__b")), F.col("v")))


def tertiles(df: DataFrame, column: str) -> DataFrame:
    """One row (low, high): the values at places n // 3 and 2n // 3 of the ordered column."""
    return _placed(df, column).agg(_at(F.floor(F.col("__n") / 3)).alias("low"), _at(F.floor(F.col("__n") * 2 / 3)).alias("high"))


def nearest_ranks(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the value at place round(share * (n - 1)), half to even, with n, least and most."""
    picks = [_at(F.bround(F.lit(q) * (F.col("__n") - 1)).cast("long")).alias(name) for name, q in shares.items()]
    return _placed(df, column).agg(F.coalesce(F.max("__n"), F.lit(0)).alias("n"), F.min("v").alias("least"), *picks, F.max("v").alias("most"))


def at_index(df: DataFrame, column: str, places: dict[str, Column]) -> DataFrame:
    """One row: values at places given as columns of __n (n // 2, int(0.9 n) - 1, ...)."""
    return _placed(df, column).agg(*[_at(p).alias(n) for n, p in places.items()])


def at_most(df: DataFrame, column: str, levels: list[int]) -> DataFrame:
    """Rows (level, n, pct): how many values are at or below each level."""
    sums = F.array(*[F.struct(F.lit(t).alias("level"), F.count_if(F.col(column) <= t).alias("n")) for t in levels])
    one = df.agg(F.count(column).alias("__n"), sums.alias("__s")).select("__n", F.explode("__s").alias("s"))
    return one.select("s.level", "s.n", F.bround(F.try_divide(F.col("s.n") * F.lit(100.0), F.col("__n")), 6).alias("pct"))


def histogram(df: DataFrame, column: str, width: int, bins: int) -> DataFrame:
    """Rows (bin, n) of fixed-width bins; the last takes what is beyond."""
    return df.where(F.col(column).isNotNull()).groupBy(F.least(F.floor(F.col(column) / width), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, n, share), the parts of all rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column, out: str) -> DataFrame:
    """For each key the value with the largest sum of weights; of equal ones the largest as text."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    return sums.groupBy(*keys).agg(F.max_by(F.col(value), F.struct("__w", F.col(value).cast("string"))).alias(out))


def confidence_weight(confidence: Column) -> Column:
    """A confidence of none or 0 weighs 1."""
    c = F.coalesce(confidence.cast("double"), F.lit(0.0))
    return F.when(c == 0, 1.0).otherwise(c)


def confusion(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows (tag, tp, fp, fn, tn, recall, precision) of (truth, prediction) for each tag; null where undefined."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    cells = []
    for tag, (truth, guess) in pairs.items():
        t, g = flag(truth), flag(guess)
        cells.append(F.struct(F.lit(tag).alias("tag"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn")))
    rows = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return rows.select("*", F.bround(F.try_divide("tp", F.col("tp") + F.col("fn")), 4).alias("recall"), F.bround(F.try_divide("tp", F.col("tp") + F.col("fp")), 4).alias("precision"))


def micro_recall(confusions: DataFrame) -> DataFrame:
    """Over tags that have positives."""
    return confusions.where("tp + fn > 0").agg(F.bround(F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))), 4).alias("micro_recall"))


def tag_sets(df: DataFrame, gold: str, guess: str) -> DataFrame:
    """One row: micro precision, recall and F1 of tag arrays, shares of exact and partial matches."""
    hit, extra, lost = (F.sum(F.size(x)) for x in (F.array_intersect(gold, guess), F.array_except(guess, gold), F.array_except(gold, guess)))
    equal = (F.size(F.array_except(gold, guess)) == 0) & (F.size(F.array_except(guess, gold)) == 0)
    one = df.agg(F.count("*").alias("n"), hit.alias("tp"), extra.alias("fp"), lost.alias("fn"), F.avg(equal.cast("int")).alias("exact"), F.avg(F.arrays_overlap(gold, guess).cast("int")).alias("partial"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    rounded = lambda c, n: F.bround(c, 4).alias(n)
    return one.select("n", "tp", "fp", "fn", rounded(p, "precision"), rounded(r, "recall"), rounded(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), "f1"), rounded(F.col("exact"), "exact"), rounded(F.col("partial"), "partial"))


def match_mark(gold: Column, guess: Column) -> Column:
    """exact, partial, none, or failed for a null guess."""
    equal = (F.size(F.array_except(gold, guess)) == 0) & (F.size(F.array_except(guess, gold)) == 0)
    return F.when(guess.isNull(), "failed").when(equal, "exact").when(F.arrays_overlap(gold, guess), "partial").otherwise("none")


def ordinal_agreement(gold: Column, guess: Column) -> list[Column]:
    """Mean absolute error, exact and within-one agreement."""
    d = F.abs(gold - guess)
    return [F.bround(F.avg(d), 6).alias("mae"), F.bround(F.avg((d == 0).cast("int")), 6).alias("exact"), F.bround(F.avg((d <= 1).cast("int")), 6).alias("within_one")]


def _by_score(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """__score, p and q: positives and others at each distinct score."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*by, F.col(score).alias("__score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))


def auc(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """One row (n_pos, n_neg, auc), or one for each ``by``: the rank sum with ties averaged."""
    below = running(_by_score(df, label, score, by), "__score", {"b": "q"}, by=by)
    one = below.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("b") - F.col("q") / 2)).alias("u"))
    return one.select(*by, "n_pos", "n_neg", F.bround(F.try_divide("u", F.col("n_pos") * F.col("n_neg")), 6).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """One row (ap), or one for each ``by``: precision at each distinct score, weighted by the positives it adds."""
    above = running(_by_score(df, label, score, by), "__score", {"tp": "p", "fp": "q"}, descending=True, by=by)
    at = above.select(*by, "p", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    return at.groupBy(*by).agg(F.bround(F.try_divide(F.sum(F.col("p") * F.col("precision")), F.sum("p")), 6).alias("ap"))


def best_f1(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (threshold, tp, fp, f1): the cut with the best F1, the highest of equal ones."""
    counts = _by_score(df, label, score)
    total = counts.agg(F.sum("p").alias("all"))
    cut = running(counts, "__score", {"tp": "p", "fp": "q"}, descending=True).crossJoin(F.broadcast(total))
    cut = cut.select(F.col("__score").alias("threshold"), "tp", "fp", F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all")).alias("f1"))
    return cut.agg(F.max_by(F.struct("threshold", "tp", "fp", F.bround("f1", 6).alias("f1")), F.struct("f1", "threshold")).alias("b")).select("b.*")


def chance_corrected(df: DataFrame, item: str, value: str) -> DataFrame:
    """One row (observed, expected, kappa, majority, majority_share, n_values): agreement of an item's values in
    pairs, beyond what the values' frequencies give."""
    known = df.where(F.col(value).isNotNull())
    own = known.groupBy(item, value).agg(F.count("*").alias("c")).groupBy(item).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sum("c").alias("m"))
    observed = own.where("m > 1").agg(F.avg(F.col("same") / (F.col("m") * (F.col("m") - 1))).alias("observed"))
    freq = shares(known, value)
    expected = freq.agg(F.sum(F.col("share") * F.col("share")).alias("expected"), F.max_by("value", F.struct("n", "value")).alias("majority"), F.max("share").alias("majority_share"), F.count("*").alias("n_values"))
    one = observed.crossJoin(expected)
    kappa = F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected"))
    return one.select(F.bround("observed", 6).alias("observed"), F.bround("expected", 6).alias("expected"), F.bround(kappa, 6).alias("kappa"), "majority", F.bround("majority_share", 6).alias("majority_share"), "n_values")


def modal_share(df: DataFrame, *columns: str) -> DataFrame:
    """One row (distinct_ratio, modal_share) of the vectors that the columns make."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.agg(F.bround(F.count("*") / F.sum("n"), 6).alias("distinct_ratio"), F.bround(F.max("n") / F.sum("n"), 6).alias("modal_share"))


def unlabelled_correction(df: DataFrame, label: str, probability: str) -> DataFrame:
    """One row (pu_c, prevalence, calibrated_mean, silver_rate, calibration_ok) for positives among unlabelled
    rows: c is the mean probability of labelled positives, each probability over c, cut to [0, 1]."""
    one = df.agg(F.avg(F.when(F.col(label) == 1, F.col(probability))).alias("c"), F.avg(probability).alias("mean"), F.avg((F.col(label) == 1).cast("double")).alias("rate"))
    fixed = df.crossJoin(F.broadcast(one)).agg(
        F.max("c").alias("c"), F.avg(F.when(F.col("c") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col(probability), F.col("c"))))).otherwise(F.col(probability))).alias("p"), F.max("mean").alias("mean"), F.max("rate").alias("rate")
    )
    ok = F.col("mean").between(0.5 * F.col("rate"), 3.0 * F.col("rate"))
    return fixed.select(F.bround("c", 6).alias("pu_c"), F.bround("p", 6).alias("prevalence"), F.bround("mean", 6).alias("calibrated_mean"), F.bround("rate", 6).alias("silver_rate"), ok.alias("calibration_ok"))


def perplexity(df: DataFrame, loss: str, tokens: str) -> DataFrame:
    """One row: exp of the mean loss, weighted by tokens."""
    return df.agg(F.bround(F.exp(F.try_divide(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens))), 6).alias("perplexity"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def layer_influence(df: DataFrame, layer: str, before: str, after: str, tokens: str) -> DataFrame:
    """Rows (layer, n_tokens, similarity, influence): the mean cosine of what goes into a layer and what comes out,
    weighted by tokens, and what is missing to 1.  Rows without a cosine (a zero vector) or tokens don't count."""
    c = cosine(F.col(before), F.col(after))
    known = df.select(layer, F.col(tokens).cast("double").alias("__n"), c.alias("__c")).where("__c is not null and __n > 0")
    mean = F.sum(F.col("__c") * F.col("__n")) / F.sum("__n")
    return known.groupBy(layer).agg(F.sum("__n").cast("long").alias("n_tokens"), F.bround(mean, 6).alias("similarity"), F.bround(1 - mean, 6).alias("influence"))


def lengths_over(df: DataFrame, column: str, limit: int) -> DataFrame:
    """One row (n, least, p50, p90, p99, most, over, over_share): a distribution of lengths, by nearest ranks, and how
    many are above a limit."""
    over = df.agg(F.count_if(F.col(column) > limit).alias("over"), F.bround(F.try_divide(F.count_if(F.col(column) > limit), F.count(column)), 6).alias("over_share"))
    return nearest_ranks(df, column, {"p50": 0.5, "p90": 0.9, "p99": 0.99}).crossJoin(F.broadcast(over))  # one row each


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows (by, least, p50, most): of a number in each group, the middle one at place n // 2."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(by).orderBy(value)
    placed = counts.withColumn("__e", F.sum("__c").over(w)).withColumn("__n", F.sum("__c").over(Window.partitionBy(by)))
    middle = F.floor(F.col("__n") / 2)
    return placed.groupBy(by).agg(F.min(value).alias("least"), F.max(F.when((F.col("__e") - F.col("__c") <= middle) & (middle < F.col("__e")), F.col(value))).alias("p50"), F.max(value).alias("most"))


def extremes(df: DataFrame, value: str, each: int, key: str) -> DataFrame:
    """The ``each`` rows with the largest and the smallest value, as end top or bottom, with their rank."""
    sides = []
    for end, order in (("top", [F.desc(value), key]), ("bottom", [value, key])):
        first = df.orderBy(*order).limit(each)
        sides.append(first.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("end", F.lit(end)))  # few rows
    return sides[0].unionByName(sides[1])


def pairwise(df: DataFrame, item: str, method: str, value: str, agree) -> DataFrame:
    """Rows (m1, m2, n, agreement): how far two methods agree on the items both have; ``agree`` takes two columns."""
    a, b = (df.select(F.col(item).alias("__i"), F.col(method).alias(m), F.col(value).alias(v)) for m, v in (("m1", "__a"), ("m2", "__b")))
    both = a.join(b, "__i").where("m1 < m2")
    return both.groupBy("m1", "m2").agg(F.count("*").alias("n"), F.bround(F.avg(agree(F.col("__a"), F.col("__b")).cast("double")), 6).alias("agreement"))


def group_means(df: DataFrame, by: Column, value: str) -> DataFrame:
    """Rows (group, n, mean, median) of a number."""
    return df.groupBy(by.alias("group")).agg(F.count("*").alias("n"), F.bround(F.avg(value), 6).alias("mean"), F.bround(F.median(value), 6).alias("median"))


def frequent(df: DataFrame, value: Column, least: int = 1) -> DataFrame:
    """Rows (value, n) of values that occur at least so often."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= least)

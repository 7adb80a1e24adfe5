"""Tags from text: character n-gram TF-IDF, logistic regression, out-of-fold scores, calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.operators import labelfit, measures, vocabulary
from scrivenry.operators.ranks import drawn
from scrivenry.sources.scratch import stored


@dataclass(frozen=True)
class Vectors:
    features: int = 200_000
    least_docs: int = 3
    low: int = 2
    high: int = 3


def tfidf(df: DataFrame, text: str, out: str = "features", config: Vectors = Vectors()) -> DataFrame:
    """Adds unit vectors of (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) over the most frequent n-grams.

    The vocabulary is exact, see ``vocabulary.most_frequent``; it, and the summary it is chosen from, are the only
    things that leave the cluster.
    """
    found, docs, n = vocabulary.most_frequent(df, text, config.low, config.high, config.features, config.least_docs)
    return vocabulary.vectors(df, text, out, config.low, config.high, found, np.log((1 + n) / (1 + docs)) + 1.0)


def folds(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """Adds fold: equal shares of each class, by drawn order."""
    return drawn(df, [label], seed, key, "__r").withColumn("fold", ((F.col("__r") - 1) % k).cast("int")).drop("__r")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds __weight: n / (2 * rows of the class)."""
    counts = df.agg(F.count("*").alias("__n"), F.count_if(F.col(label) == 1).alias("__p"))
    own = F.when(F.col(label) == 1, F.col("__p")).otherwise(F.col("__n") - F.col("__p"))
    return df.crossJoin(F.broadcast(counts)).withColumn("__weight", F.try_divide(F.col("__n").cast("double"), 2.0 * own)).drop("__n", "__p")


def out_of_fold(df: DataFrame, label: str, features: str, k: int, c: float = 1.0, class_weights: bool = True, iterations: int = 20) -> DataFrame:
    """Adds score: each fold's probabilities from a model of the others.  df has a column fold."""
    out = None
    for i in range(k):
        train = df.where(F.col("fold") != i)
        train = balanced(train, label) if class_weights else train.withColumn("__weight", F.lit(1.0))
        n = train.count()
        model = LogisticRegression(labelCol=label, featuresCol=features, weightCol="__weight", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=iterations).fit(train)  # keeps its blocks of rows itself
        scored = model.transform(df.where(F.col("fold") == i)).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        out = scored if out is None else out.unionByName(scored)
    return out


def calibrated(df: DataFrame, label: str, score: str, fold: str = "fold") -> DataFrame:
    """Adds calibrated: a sigmoid of the score's log odds.  Each fold's is fitted on the other folds' scores, so no
    row is calibrated by its own label; where there is one fold, or the others have one class, the score stays."""
    odds = F.log(F.greatest(F.col(score), F.lit(1e-9)) / F.greatest(1 - F.col(score), F.lit(1e-9)))
    one = df.withColumn("__x", array_to_vector(F.array(odds)))
    out = None
    for (i,) in sorted(tuple(r) for r in df.select(fold).distinct().collect()):
        own, others = one.where(F.col(fold) == i), one.where(F.col(fold) != i)
        if others.select(label).distinct().count() < 2:
            scored = own.withColumn("calibrated", F.col(score)).drop("__x")
        else:
            model = LogisticRegression(labelCol=label, featuresCol="__x", regParam=0.0).fit(others)
            scored = model.transform(own).withColumn("calibrated", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")
        out = scored if out is None else out.unionByName(scored)
    return df.withColumn("calibrated", F.col(score)) if out is None else out


def evaluate(df: DataFrame, label: str, key: str, features: str, k: int = 3, c: float = 1.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(one row of measures, scored rows): ranking quality, the best cut, and the correction for unlabelled
    positives, all from out-of-fold scores."""
    # Stored before the folds are drawn, which reads the rows twice, and with them: every fold's model reads all.
    made = stored(df.select(key, F.col(label).cast("double").alias(label), features), "made")
    own = stored(folds(made, label, key, k, seed), "vectors")
    raw = stored(out_of_fold(own, label, features, k, c).select(key, label, "fold", "score"), "raw")
    scored = stored(calibrated(raw, label, "score"), "scores")
    parts = [measures.auc(scored, label, "score"), measures.average_precision(scored, label, "score"), measures.best_f1(scored, label, "score"), measures.unlabelled_correction(scored, label, "calibrated")]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(p)  # each has one row
    return row, scored


def candidates(scored: DataFrame, label: str, top: int, key: str = "doc_id", by: list[str] = ()) -> DataFrame:
    """Unlabelled rows that most look like positives (of each ``by``), by calibrated probability before it is cut;
    of equal ones those with the smallest key."""
    order = [F.desc("calibrated"), F.col(key)]
    rows = scored.where(F.col(label) != 1)
    if not by:
        return rows.orderBy(*order).limit(top)
    # First of each part of a group, as one may have most rows.
    parts = rows.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(64)))
    for keys in ([*by, "__part"], by):
        parts = parts.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= top)
    return parts.drop("__part", "__r")


def side_by_side(a: Column, width: int, b: Column) -> Column:
    """Two structs of indices and values as one; the second's indices come after the first's ``width``."""
    return F.struct(F.concat(a["indices"], F.transform(b["indices"], lambda i: (i + width).cast("int"))).alias("indices"), F.concat(a["values"], b["values"]).alias("values"))


def ablation(df: DataFrame, tags: dict[str, Column], key: str, sets: dict[str, str], k: int = 3, c: float = 1.0, seed: int = 7) -> DataFrame:
    """Rows (tag, features, n_pos, n_total, auc, ap, delta) of each tag under each feature set; sets: name and column,
    delta against the first.  All tags of a set are fitted at once, and all sets have the same folds."""
    labels, out, names = F.array(*[t.cast("double") for t in tags.values()]).alias("__labels"), None, list(tags)
    for name, column in sets.items():
        rows = labelfit.matrix_rows(df.select(key, labels, F.col(column).alias("__f")), "__labels", "__f", key, k, seed)
        weights, models = labelfit.fit(rows, [c], k, labelfit.width(rows))
        scored = stored(labelfit.scores(rows, weights, models, key), "scores")
        own = measures.auc(scored, "label", "score", ["tag"]).join(measures.average_precision(scored, "label", "score", ["tag"]), "tag").withColumn("features", F.lit(name))
        out = own if out is None else out.unionByName(own)
    base = out.where(F.col("features") == next(iter(sets))).select("tag", F.col("auc").alias("__base"))
    tag = F.element_at(F.array(*map(F.lit, names)), F.col("tag") + 1).alias("tag")
    return out.join(base, "tag").select(tag, "features", "n_pos", (F.col("n_pos") + F.col("n_neg")).alias("n_total"), "auc", "ap", F.bround(F.col("auc") - F.col("__base"), 4).alias("delta"))


def grid(df: DataFrame, text: str, tags: dict[str, Column], key: str, configs: list[Vectors], strengths: list[float], k: int = 3, stop=None, seed: int = 7) -> DataFrame:
    """Rows (tag, low, high, features, c, auc, ap): each tag under each vectoriser and strength.

    One fit for each vectoriser has all tags, strengths and folds; with ``stop`` it is one for each strength, asked
    before each, and a grid that it ends has the rows so far.  Keys are unique.
    """
    out, names = None, list(tags)
    # Each vectoriser reads the texts several times; what they are made from is read once.
    texts = stored(df.select(key, text, F.array(*[c.cast("double") for c in tags.values()]).alias("__labels")), "texts") if configs else None
    for config in configs:
        vectors = tfidf(texts, text, "features", config)
        rows = labelfit.matrix_rows(vectors, "__labels", "features", key, k, seed)
        for some in [[c] for c in strengths] if stop is not None else [strengths]:
            if stop is not None and stop():
                return _grid_rows(df, out)
            weights, models = labelfit.fit(rows, some, k, labelfit.width(rows))
            scored = stored(labelfit.scores(rows, weights, models, key), "scores")
            cell = ["tag", "strength"]
            found = measures.auc(scored, "label", "score", cell).join(measures.average_precision(scored, "label", "score", cell), cell)
            tag, c = (F.element_at(F.array(*map(F.lit, v)), F.col(n) + 1).alias(o) for v, n, o in ((names, "tag", "tag"), ([float(c) for c in some], "strength", "c")))
            own = found.select(tag, F.lit(config.low).alias("low"), F.lit(config.high).alias("high"), F.lit(config.features).alias("features"), c, "auc", "ap")
            out = own if out is None else out.unionByName(own)
    return _grid_rows(df, out)


def _grid_rows(df: DataFrame, out: DataFrame | None) -> DataFrame:
    return out if out is not None else df.sparkSession.createDataFrame([], "tag string, low int, high int, features int, c double, auc double, ap double")


def tag_candidates(df: DataFrame, features: str, tags: dict[str, Column], key: str, top: int, c: float = 1.0, k: int = 3, seed: int = 7) -> DataFrame:
    """Rows (tag, key, score, calibrated): for each tag the ``top`` rows without it that most look like those with
    it.  All tags are fitted at once, and scores calibrated by tag on the other folds' scores."""
    labels = F.array(*[t.cast("double") for t in tags.values()]).alias("__labels")
    rows = labelfit.matrix_rows(df.select(key, features, labels), "__labels", features, key, k, seed)
    weights, models = labelfit.fit(rows, [c], k, labelfit.width(rows))
    scored = stored(labelfit.scores(rows, weights, models, key).drop("strength"), "scores")
    odds = F.log(F.greatest("score", F.lit(1e-9)) / F.greatest(1 - F.col("score"), F.lit(1e-9)))
    one = scored.select(key, "tag", "label", "fold", "score", odds.alias("__odds"))
    fitted = F.broadcast(labelfit.sigmoids(one, "label", "__odds", "tag", "fold"))
    calibrated_ = one.join(fitted, ["tag", "fold"], "left").withColumn("calibrated", F.coalesce(1 / (1 + F.exp(-(F.col("slope") * F.col("__odds") + F.col("intercept")))), F.col("score")))
    found = candidates(calibrated_, "label", top, key, ["tag"])
    return found.select(F.element_at(F.array(*map(F.lit, tags)), F.col("tag") + 1).alias("tag"), key, "score", "calibrated")


def deltas(results: DataFrame, base: str, other: str, each: int = 10) -> DataFrame:
    """Rows (tag, delta, end, rank) of results (tag, features, auc): the tags that another feature set serves most
    and least, against the base."""
    wide = results.groupBy("tag").agg(*[F.max(F.when(F.col("features") == f, F.col("auc"))).alias(n) for f, n in ((base, "__a"), (other, "__b"))])
    return measures.extremes(wide.select("tag", F.bround(F.col("__b") - F.col("__a"), 4).alias("delta")).where("delta is not null"), "delta", each, "tag")


def wins(results: DataFrame) -> DataFrame:
    """Rows (features, wins): for how many tags a feature set has the best AUC; equal ones all count."""
    best = results.groupBy("tag").agg(F.max("auc").alias("__best"))
    return results.join(best, "tag").groupBy("features").agg(F.count_if(F.col("auc") == F.col("__best")).alias("wins"))

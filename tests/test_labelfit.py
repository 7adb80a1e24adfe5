"""The fit of a whole label matrix against one model at a time, and order numbers on composite keys."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from scrivenry.operators import classify, labelfit, measures, pipelines, ranks, sampling


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(4)
    words = {0: "aebi", 1: "xyzw", 2: "qjkv"}
    rows = []
    for i in range(240):
        kinds = [t for t in range(3) if rng.random() < 0.4]
        rows.append((i, "".join(rng.choice("mnop" + "".join(words[t] for t in kinds)) for _ in range(rng.randint(0, 60))), kinds))
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds array<int>")
    tags = {f"t{t}": F.array_contains("kinds", t) for t in range(3)} | {"none": F.lit(False)}
    return classify.tfidf(df, "text", "features", classify.Vectors(features=300)).cache(), tags


def test_every_cell_agrees_with_one_fit_at_a_time(spark, vectors, monkeypatch):
    df, tags = vectors
    rows = labelfit.matrix_rows(df.withColumn("__labels", F.array(*[t.cast("double") for t in tags.values()])), "__labels", "features", "doc_id", 3, 7)
    size, strengths, passes = labelfit.width(rows), [0.3, 3.0], []
    plain = labelfit._gradients
    monkeypatch.setattr(labelfit, "_gradients", lambda *a: passes.append(1) or plain(*a))
    weights, models = labelfit.fit(rows, strengths, 3, size)
    assert len(passes) <= 41 and len(models) == 4 * 2 * 3
    scored = labelfit.scores(rows, weights, models, "doc_id").cache()
    assert scored.count() == 240 * 4 * 2 and scored.groupBy("doc_id", "tag", "strength").count().where("count > 1").isEmpty()
    cells = {(r.tag, r.strength): r for r in measures.auc(scored, "label", "score", ["tag", "strength"]).join(measures.average_precision(scored, "label", "score", ["tag", "strength"]), ["tag", "strength"]).collect()}
    for t in range(4):
        for s, c in enumerate(strengths):
            own = rows.select("doc_id", F.col("labels")[t].alias("y"), F.col("folds")[t].alias("fold")).join(df.select("doc_id", "features"), "doc_id")
            if t == 3:
                assert cells[t, s].auc is None and cells[t, s].n_pos == 0
                continue
            raw = classify.out_of_fold(own, "y", "features", 3, c, iterations=60).cache()
            one = measures.auc(raw, "y", "score").first()
            assert cells[t, s].auc == pytest.approx(one.auc, abs=0.01) and cells[t, s].n_pos == one.n_pos
            assert cells[t, s].ap == pytest.approx(measures.average_precision(raw, "y", "score").first().ap, abs=0.02)
            both = raw.select("doc_id", F.col("score").alias("s")).join(scored.where((F.col("tag") == t) & (F.col("strength") == s)), "doc_id")
            assert both.agg(F.max(F.abs(F.col("s") - F.col("score")))).first()[0] < 0.05


def test_weights_beyond_the_bound_are_fitted_in_turn(vectors, monkeypatch):
    df, tags = vectors
    rows = labelfit.matrix_rows(df.withColumn("__labels", F.array(*[t.cast("double") for t in tags.values()])), "__labels", "features", "doc_id", 2, 7)
    size = labelfit.width(rows)
    whole, models = labelfit.fit(rows, [1.0], 2, size, iterations=8)
    monkeypatch.setattr(labelfit, "WEIGHTS", 3 * (size + 1))
    parts, _ = labelfit.fit(rows, [1.0], 2, size, iterations=8)
    assert len(models) == 8 and np.abs(whole - parts).max() < 1e-3


def test_candidates_of_each_tag(spark, vectors):
    df, tags = vectors
    found = classify.tag_candidates(df, "features", tags, "doc_id", 5).collect()
    assert {t: sum(r.tag == t for r in found) for t in tags} == {t: 5 for t in tags}
    kinds = {r.doc_id: r.kinds for r in df.select("doc_id", "kinds").collect()}
    assert all(int(r.tag[1]) not in kinds[r.doc_id] for r in found if r.tag != "none") and all(0 <= r.calibrated <= 1 for r in found)
    assert found == classify.tag_candidates(df.repartition(7), "features", tags, "doc_id", 5).collect() or {(r.tag, r.doc_id) for r in found} == {(r.tag, r.doc_id) for r in classify.tag_candidates(df.repartition(7), "features", tags, "doc_id", 5).collect()}
    ties = spark.createDataFrame([(i, 0.0, 0.5) for i in range(100)], "doc_id long, y double, calibrated double")
    assert [r.doc_id for r in classify.candidates(ties, "y", 4).collect()] == [0, 1, 2, 3]


def test_calibration_by_group_equals_the_library(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, float(rng.random() < 0.2 + 0.6 * (i % 7) / 7), (i % 7 - 3) / 2.0 + i % 2, i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, tag int, y double, x double, fold int")
    found = {(r.tag, r.fold): (r.slope, r.intercept) for r in labelfit.sigmoids(df, "y", "x", "tag", "fold").collect()}
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    for (tag, fold), (slope, intercept) in list(found.items())[::2]:
        model = LogisticRegression(labelCol="y", featuresCol="v", regParam=0.0).fit(df.where((F.col("tag") == tag) & (F.col("fold") != fold)).withColumn("v", array_to_vector(F.array("x"))))
        assert slope == pytest.approx(model.coefficients[0], abs=0.01) and intercept == pytest.approx(model.intercept, abs=0.01)
    assert len(found) == 6


def test_order_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randint(0, 3), i) for i in range(500)] + [(None, 1, 900), (None, None, 901)]
    df = spark.createDataFrame(rows, "g string, x int, id long").repartition(7)
    for by in ([], ["g"], ["g", "x"]):
        order = [F.desc("x"), F.col("id")] if by != ["g", "x"] else [F.col("id")]
        want = df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) if by else df.withColumn("n", F.row_number().over(Window.orderBy(*order)) - 1)
        found = ranks.numbered(df, order, "n", by)
        assert sorted(found.collect(), key=str) == sorted(want.collect(), key=str)
    assert ranks.numbered(df.where("false"), [F.col("id")]).collect() == []
    for made in (sampling.job_shard(df, ["x", "id"], 1, 3), pipelines.select_works(df.where("g is not null"), "x", 3, 5, ["17"], "id"), sampling.balanced_subset(df.where("g is not null"), "g", "x", ["id"], 20, 5)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan


def test_first_drawn_moves_one_bucket_of_a_group(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aaaab"), i) for i in range(3000)] + [(None, 5000 + i) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(6)
    for most in (0, 1, 5, 700, 2999):
        ranked = ranks.drawn(df, ["g"], 3, "id").where(F.col("__r") <= most).drop("__r")
        found = ranks.first_drawn(df, ["g"], 3, "id", spark.range(1).select(F.lit(most).alias("m")), F.col("m"))
        assert sorted(found.collect(), key=str) == sorted(ranked.collect(), key=str)

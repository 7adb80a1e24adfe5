"""Plans and operators that must not depend on the number of groups or on one task."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from scrivenry.functions import text as T
from scrivenry.operators import classify, measures, ranks, reading, sampling, terms
from scrivenry.sources import files, schemas, services


def numbers(spark, n=3000):
    return spark.range(n).select(F.col("id"), (F.col("id") % 2 == 0).alias("flag"), F.when(F.col("id") % 50 != 0, (F.xxhash64("id") % 700) / 7.0).alias("score"), (F.xxhash64("id", F.lit(1)) % 3 == 0).cast("int").alias("y"))


def test_drawn_places_equal_row_number(spark):
    df = numbers(spark).withColumn("g", F.when(F.col("id") % 5 != 0, F.col("flag")))
    plain = F.row_number().over(Window.partitionBy("g").orderBy(ranks.draw(7, "id"), "id"))
    both = ranks.drawn(df, ["g"], 7, "id").withColumn("want", plain)
    assert both.count() == 3000 and both.where("__r <> want").count() == 0
    alone = ranks.drawn(df, [], 7, "id").withColumn("want", F.row_number().over(Window.orderBy(ranks.draw(7, "id"), "id")))
    assert alone.where("__r <> want").count() == 0 and ranks.drawn(df.where("false"), ["g"], 7, "id").count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_equal_a_window(spark, descending):
    df = numbers(spark).where("score is not null")
    order = F.col("score").desc() if descending else F.col("score")
    found = ranks.running(df, "score", {"s": "y"}, descending).withColumn("want", F.sum("y").over(Window.orderBy(order)))
    assert found.count() == df.count() and found.where("s <> want").count() == 0


def window_partitions(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Window [" in f" {line}" or "+- Window" in line]


def test_no_window_over_all_rows(spark):
    """Ordered stretches hold a bucket; only counts of buckets are ordered as a whole."""
    df = numbers(spark)
    for made in (sampling.label_ratio(df, "flag", 0.3, 7, "id"), sampling.author_share(df, "flag", 0.2, 7, "id"), classify.folds(df, "y", "id", 5, 7)):
        text = made._jdf.queryExecution().executedPlan().toString()
        wide = [line for line in text.splitlines() if "Window" in line and "__d" in line]
        assert wide and all("__bucket" in line for line in wide)
    text = measures.auc(df, "y", "score")._jdf.queryExecution().executedPlan().toString()
    assert all("__s" in line for line in text.splitlines() if "Window [" in line)


def test_look_back_needs_few_rows(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 0, 1, 3, 9]))) for _ in range(200)]
    df = spark.createDataFrame([("w", i, t or None) for i, t in enumerate(texts)], "w string, i int, t string")
    found = {r.i: r.context for r in reading.look_back(df, ["w"], ["i"], "t", 12).collect()}
    assert found == {i: "".join(texts[:i])[-12:] for i in range(200)}


def plain_nested(t):
    while True:
        import re

        n = re.sub("[「『][^「『」』]*[」』]", "", t)
        if n == t:
            return t
        t = n


def test_quotations_of_any_depth(spark):
    rng = random.Random(4)
    texts = ["「" * 40 + "x" + "」" * 40 + "y", "「" * 9 + "」" * 9, "『「」』「", "」「"] + ["".join(rng.choice("「」『』ab") for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.strip_nested("t", "「『", "」』")).collect()] == [plain_nested(t) for t in texts]
    deep = spark.createDataFrame([("w", "地の文" * 900 + "「" * 30 + "俺" + "」" * 30)], "w string, t string")
    assert terms.viewpoints(deep, "w", "t").first().first_person_hits == 0


def test_quotas_are_a_water_level():
    def plain(capacity, target):
        quota = dict.fromkeys(capacity, 0)
        while target > 0 and (least := min((q for c, q in quota.items() if q < capacity[c]), default=None)) is not None:
            name = min(c for c, q in quota.items() if q < capacity[c] and q == least)
            quota[name] += 1
            target -= 1
        return quota

    rng = random.Random(5)
    for _ in range(300):
        capacity = {c: rng.randint(0, 9) for c in "dbaec"[: rng.randint(0, 5)]}
        target = rng.randint(0, 30)
        assert sampling.quotas(capacity, target) == plain(capacity, target)


def test_calibration_leaves_the_own_fold_out(spark):
    rows = [(i, float(i % 2), 0.9 if i % 2 else 0.1, i % 4) for i in range(80)] + [(900, 1.0, 0.1, 0)]
    found = {r.id: r.calibrated for r in classify.calibrated(spark.createDataFrame(rows, "id long, y double, score double, fold int"), "y", "score").collect()}
    assert len(found) == 81 and found[1] > 0.5 > found[0] and found[900] == pytest.approx(found[0])
    one = spark.createDataFrame([(1, 1.0, 0.4, 0)], "id long, y double, score double, fold int")
    assert classify.calibrated(one, "y", "score").first().calibrated == 0.4


def test_grid_stops_and_keeps_what_it_has(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abc" if i % 2 else "xyz") for _ in range(40))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string")
    left = iter([False, False, True])
    found = classify.grid(df, "text", {"odd": F.col("id") % 2 == 1}, "id", [classify.Vectors(features=50, high=2)], [0.5, 1.0, 2.0], 2, lambda: next(left)).collect()
    assert [r.c for r in found] == [0.5, 1.0] and all(r.auc == 1.0 for r in found)


def test_sinks(spark, tmp_path):
    df = spark.range(10).select("id", F.lit("x").alias("t"))
    path = f"{tmp_path}/s"
    files.append_shards(df.coalesce(1), path, 4)
    files.append_shards(df.coalesce(1), path, 4)
    sizes = [r["count"] for r in spark.read.text(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 20 and max(sizes) == 4
    files.write_version(spark, f"{tmp_path}/VERSION.json", {"seed": 7}, 3, True)
    assert files.read_json(spark, f"{tmp_path}/VERSION.json", "schema_version int, partial boolean").first() == (3, True)
    (tmp_path / "s.json").write_text('{"$schema": "u", "$id": "i", "title": "t", "type": "object"}')
    assert files.read_schema(spark, str(tmp_path / "s.json")) == {"type": "object"}
    files.blank_template(df, f"{tmp_path}/labels", ["violence"])
    with pytest.raises(Exception, match="already exists"):
        files.blank_template(df, f"{tmp_path}/labels", ["violence"])
    (tmp_path / "raw").write_bytes(b"ok \xed\xa0\x80")
    (tmp_path / "fine").write_bytes("한글 ok".encode())
    found = {r.path.split("/")[-1]: r.bad for r in spark.read.format("binaryFile").load([f"{tmp_path}/raw", f"{tmp_path}/fine"]).select("path", files.surrogate_faults(F.col("content")).alias("bad")).collect()}
    assert found == {"raw": True, "fine": False}


def test_guards(spark):
    df = spark.createDataFrame([("available",), ("gone",)], "s string")
    assert df.where("s = 'available'").select(services.status_guard(F.col("s"))).first()[0] in schemas.AVAILABILITY
    with pytest.raises(Exception, match="no such status: gone"):
        df.select(services.status_guard(F.col("s"))).collect()
    works = spark.createDataFrame([(1,), (2,), (None,)], "site_type int")
    assert services.api_targets(works).count() == 1
    with pytest.raises(ValueError, match="no rows for s: here"):
        sampling.wanted(df, spark.createDataFrame([("here",)], "s string"), "s")
    assert [r[0] for r in df.select(reading.shared_budget(F.array(F.lit("abcdef"), F.lit("xyz")), 6, "|")).collect()] == ["abc|xyz"] * 2


def test_extraction_keeps_faults(spark):
    def client(prompt):
        if "down" in prompt:
            raise ConnectionError("no")
        return "no json" if "bad" in prompt else '{"a": 2}'

    df = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "down"), (4, "x" * 50), (5, None)], "id long, text string")
    found = {r.id: r for r in services.extract(df, "id", "text", client, {"properties": {"a": {"enum": [1]}}}, str, 20).collect()}
    assert found[1].ok and found[1].problems == ["enum:a=2"] and found[4].skipped == "too_long" and not found[4].ok
    assert not found[2].ok and "JSONDecodeError" in found[2].error and "ConnectionError" in found[3].error and found[5].ok

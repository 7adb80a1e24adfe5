"""Jobs that put the operators together, against plain versions."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F
from scrivenry.functions import meta
from scrivenry.operators import classify, dedup, labelfit, pipelines, reading
from scrivenry.plans.registry import QUERIES
from scrivenry.sources import files

SF = "/root/testdata/sf0.001"


def conversations(spark):
    return sorted(map(tuple, spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text").collect()))


def test_long_work_contexts(spark):
    works: dict[int, list[str]] = {}
    for conv, _, text in conversations(spark):
        works.setdefault(conv, []).append(text)
    order = sorted(works, key=lambda w: (-sum(map(len, works[w])), w))
    first = set(order[:3]) | {2} & set(works)
    rest = [w for w in order if w not in first]
    even = {rest[round(i * (len(rest) - 1) / 5)] for i in range(6)}
    want = {(w, p, s, n, t) for w in first | even for p, s, n, t in reading.allocate(works[w], reading.METHODS["ends3"], 900)}
    found = {(r.conv_id, r.position, r.start_chunk, r.n_chunks, r.text) for r in QUERIES["long_work_contexts"](spark, SF).collect()}
    assert found == want


def test_near_dups_of_whole_scopes(spark):
    df = spark.createDataFrame([(s, i, t) for s in "ab" for i, t in enumerate(["one two three four", "one two three four", "one two three five", "other words here now", " one  two three four ", None, ""])], "s string, i int, t string")
    found = {(r.s, r.i): r.duplicate_of for r in dedup.greedy_near_duplicates(df, ["s"], "i", "t", 0.8).collect()}
    texts = ["one two three four", "one two three four", "one two three five", "other words here now", " one  two three four ", "", ""]
    want = dedup.find_duplicates(texts, 0.8)
    assert found == {(s, i): want.get(i) for s in "ab" for i in range(7)}


@pytest.mark.parametrize(("threshold", "head", "part"), [(0.9, 4, 5), (0.8, 3, 2), (0.6, 7, 100)])
def test_large_scopes_in_rounds(spark, monkeypatch, threshold, head, part):
    monkeypatch.setattr(dedup, "HEAD", head)
    monkeypatch.setattr(dedup, "PART", part)
    rng = random.Random(head)
    base = ["the quick brown fox jumps over", "pack my box with five dozen jugs", "a b", "", "sphinx of black quartz judge my vow é漢"]

    def some():
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t.insert(rng.randint(0, len(t)), rng.choice("xyz \u3000\n"))
        return "".join(t)

    rows = [(s, i, None if rng.random() < 0.05 else some(), "k") for s in ("a", "b", None) for i in range(60 if s != "b" else 3)]
    df = spark.createDataFrame(rows, "s string, i int, t string, extra string").repartition(5)
    found = {(r.s, r.i): r.duplicate_of for r in dedup.greedy_near_duplicates(df, ["s"], "i", "t", threshold).collect()}
    want = {}
    for s in ("a", "b", None):
        own = [r for r in rows if r[0] == s]
        dup = dedup.find_duplicates([r[2] or "" for r in own], threshold)
        want |= {(s, r[1]): dup.get(k) for k, r in enumerate(own)}
    assert found == want


def test_a_large_scope_is_spread_over_tasks(spark):
    df = spark.range(4000).select(F.lit("one").alias("s"), F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("a very common text, copied and hardly changed at all, number "), F.col("id") % 7)).otherwise(F.md5(F.col("id").cast("string"))).alias("t"))
    found = dedup.greedy_near_duplicates(df.where("id % 3 = 0 or id < 700"), ["s"], "i", "t", 0.9)
    rows = found.collect()
    assert sum(r.duplicate_of is not None for r in rows) == 4000 // 3 and {r.duplicate_of for r in rows} == {None, 0}


def test_ablation_equals_one_fit_at_a_time(spark):
    rows = [(i, [float(i % 2), (i * 7 % 10) / 10.0], [(i * 3 % 11) / 11.0, 0.0, 1.0 if i % 3 == 0 else 0.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    df = labelfit.sparse(labelfit.sparse(df, "a"), "b").withColumn("both", classify.side_by_side(F.col("a"), 2, F.col("b")))
    found = {(r.tag, r.features): r for r in classify.ablation(df, {"odd": F.col("id") % 2 == 1, "third": F.col("id") % 3 == 0}, "id", {"a": "a", "b": "b", "both": "both"}).collect()}
    assert len(found) == 6 and all(r.n_total == 90 for r in found.values()) and found["third", "a"].n_pos == 30
    assert found["odd", "a"].auc > 0.99 and found["odd", "both"].auc > 0.95 and found["third", "b"].auc > 0.99 and found["third", "both"].auc > 0.95
    assert found["odd", "a"].delta == 0 and found["third", "b"].delta == pytest.approx(found["third", "b"].auc - found["third", "a"].auc, abs=1e-4)


def test_small_pieces(spark):
    one = spark.createDataFrame([(True, False, 0.7, 0.4), (False, True, 0.7, 0.4), (False, False, 0.7, 0.4), (True, True, None, 0.4)], "w boolean, c boolean, wc double, cc double")
    found = [tuple(r.p) for r in one.select(meta.provenance(F.col("w"), F.col("c"), F.col("wc"), F.col("cc")).alias("p")).collect()]
    assert found == [("rules+lmstudio", 0.7), ("rules+lmstudio", 0.4), ("rules", 0.0), ("rules+lmstudio", 0.4)]
    out = io.StringIO()
    report = files.write_report(spark.createDataFrame([(1, "é", None)], "n int, s string, x string"), out)
    assert json.loads(out.getvalue()) == report and report["s"] == "é" and "é" in out.getvalue()
    with pytest.raises(ValueError):
        files.write_report(spark.range(2), out)
    rows = files.label_template(spark.createDataFrame([("k", "a\tb\n" + "c" * 80)], "k string, t string"), "k", "t", ["x", "y"]).collect()
    assert [tuple(r) for r in rows] == [("k", "", "", "a b " + "c" * 56)]
    view = spark.createDataFrame([(("n1",), "a b c"), (("unknown",), "a"), ((None,), "a"), (("n2",), "a")], "meta struct<ncode:string>, t string")
    tokens = F.size(F.split("t", " "))
    assert [r.n_tokens for r in pipelines.trainer_rows(view, tokens, 2).collect()] == [1]
    assert sorted(r.n_tokens for r in pipelines.trainer_rows(view, tokens, 3, strict=True).collect()) == [1, 3]
    with pytest.raises(Exception, match="too long: 3"):
        pipelines.trainer_rows(view, tokens, 2, strict=True).collect()

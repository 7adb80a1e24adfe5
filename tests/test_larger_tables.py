"""What only larger or odder tables than sf0.001 bring up."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from scrivenry.operators import classify, labelfit, vocabulary
from scrivenry.plans import reading as reading_plans
from scrivenry.plans.registry import ORACLE_SQL
from scrivenry.streaming import jobs


def test_open_entities_stay_as_in_the_sql(spark, tmp_path):
    bodies = ["cut&amp", "a&ampp{x}\n&ltb &copy2;", "&am&amp;p;&amp;lt; &quot;q&quot;", "<p>x &amp y&amp;</p>", "&", ""]
    spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: r for r in reading_plans.normalised_bodies(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.execute(ORACLE_SQL["normalised_bodies"]).fetchall()
    assert len(wanted) == len(bodies) and all(tuple(found[w[0]]) == w for w in wanted)


def test_batches_look_up_what_is_pending_once(spark, tmp_path, monkeypatch):
    asked, plain = [], jobs.pending
    monkeypatch.setattr(jobs, "pending", lambda *a: asked.append(1) or plain(*a))
    df = spark.createDataFrame([(i // 2 if i else None, i) for i in range(41)], "k int, v int").repartition(5)
    left, path = iter([False, False, True]), f"{tmp_path}/done"
    first = jobs.batches_until(df, lambda d: d, path, ["k"], 5, lambda: next(left))
    assert sorted(r.v for r in first.collect()) == list(range(10)) and not asked
    every = jobs.batches_until(df, lambda d: d.where("v <> 33"), path, ["k"], 3, lambda: False)
    assert sorted(r.v for r in every.collect()) == [v for v in range(41) if v != 33] and len(asked) == 1
    assert jobs.batches_until(df, lambda d: d, path, ["k"], 3, lambda: True).count() == 40
    assert jobs.batches_until(df.where("false"), lambda d: d, f"{tmp_path}/none", ["k"], 3, lambda: False).count() == 0


def test_workers_get_small_batches(spark, monkeypatch):
    """Rows of texts, of vectors and of blocks of sums come in batches of a bounded size, and none of a whole summary."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("ab"), F.col("id").cast("string")).alias("text")).coalesce(2)
    monkeypatch.setattr(vocabulary, "BLOCK", 64)
    made = classify.tfidf(df, "text", "features", classify.Vectors(features=300, least_docs=1))
    kinds = labelfit.sparse(made, "features").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "most": [b.nbytes]}) for b in bs), "rows long, most long")
    assert kinds.agg(F.max("rows")).first()[0] <= 1024 and kinds.agg(F.sum("rows")).first()[0] == 3000


def test_summaries_in_blocks_are_one_summary():
    rng = np.random.default_rng(3)
    whole, merged = vocabulary.Summary(10_000), vocabulary._Merged(10_000)
    for i in range(20):
        codes, counts = np.unique(rng.integers(0, 900, 500).astype(np.uint64), return_counts=True)
        whole.add(codes, counts, i)
        for j in range(0, len(codes), 64):
            merged.add(codes[j : j + 64].tobytes(), counts[j : j + 64].tobytes(), i if j == 0 else 0)
    own = merged.summary()
    assert own.codes.tolist() == whole.codes.tolist() and own.counts.tolist() == whole.counts.tolist() and own.lost == whole.lost == 190


def test_scopes_pass_in_a_stream(spark, monkeypatch):
    """Scopes that go on in the next batch are one scope, and no group of rows is sent to Python for each."""
    from scrivenry.operators import dedup

    monkeypatch.setattr(dedup, "small_batches", lambda spark: None)
    rows = [(f"s{s}", i, None if i == 5 else f"text number {i % 3} of the scope " * 3) for s in range(40) for i in range(s % 7)]
    rows += [(None, i, f"row {i // 2} and nothing else") for i in range(4)]
    df = spark.createDataFrame(rows, "s string, i int, t string").repartition(3)
    want = {}
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        found = dedup.find_duplicates([r[2] or "" for r in own], 0.95)
        want |= {(s, r[1]): own[found[j]][1] if j in found else None for j, r in enumerate(own)}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    try:
        for size in (1, 3, 5000):
            spark.conf.set(name, size)
            made = dedup.greedy_near_duplicates(df, ["s"], "i", "t", 0.95)
            assert {(r.s, r.i): r.duplicate_of for r in made.collect()} == want
            assert "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(name, held)


def test_evaluation_makes_vectors_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("double").alias("y"), F.array((F.col("id") % 2).cast("double"), (F.col("id") % 5).cast("double")).alias("v"))
    vectors = df.mapInArrow(seen, df.schema).withColumn("features", array_to_vector("v")).drop("v")
    row = classify.evaluate(vectors, "y", "doc_id", "features", k=2)[0].first()
    assert row.n_pos == 30 and row.auc == 1.0 and made.value == 60


def test_a_grid_makes_its_vectors_once_and_packs_its_rows(spark, monkeypatch):
    """F1 of round 4: every pass decoded lists and ordered features anew, and the folds' draw made the vectors again."""
    made, frames, plain = spark.sparkContext.accumulator(0), [], labelfit._gradients

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(60).select(F.col("id").alias("doc_id"), F.array((F.col("id") % 2 == 0).cast("double")).alias("y"), F.array(F.col("id") % 3 - 1.0, F.lit(1.0)).alias("v")).coalesce(2)
    rows = labelfit.matrix_rows(df.mapInArrow(counted, df.schema), "y", "v", "doc_id", 2, 7)
    assert rows.count() == 60 and made.value == 60
    monkeypatch.setattr(labelfit, "_gradients", lambda *a: frames.append(a[0]) or plain(*a))
    labelfit.fit(rows, [1.0], 2, 2, iterations=2)
    assert frames and all(t == "binary" or c == "n" for f in frames for c, t in f.dtypes)


def test_blocks_are_the_rows(monkeypatch):
    """Blocks of few cells or of one long row hold every value; equal numbers in a row add up, empty rows stay."""
    monkeypatch.setattr(labelfit, "CELLS", 40)
    rng = np.random.default_rng(5)
    at = [[], [3], [2, 2, 7], *[sorted(rng.choice(90, n, replace=False).tolist()) for n in (5, 60, 0, 9, 1, 30)], []]
    value = [rng.random(len(a)).astype(np.float32).tolist() for a in at]
    want = np.zeros((len(at), 90))
    for i, (a, v) in enumerate(zip(at, value, strict=True)):
        np.add.at(want[i], a, v)
    batch = pa.RecordBatch.from_pydict({"at": pa.array(at, pa.list_(pa.int32())), "value": pa.array(value, pa.list_(pa.float32())), "labels": [[float(i % 2), 0.0] for i in range(len(at))], "folds": [[i, i + 1] for i in range(len(at))]})
    for b, first in ((batch, 0), (batch.slice(2, 5), 2), (batch.slice(0, 0), 0)):
        found, folds = np.zeros((b.num_rows, 90)), []
        for some, own, x, y, f in labelfit._blocks(b, 90):
            assert len(x) == len(y) == some.stop - some.start and (x.size <= 40 or len(x) == 1)
            found[np.ix_(range(some.start, some.stop), own)] = x
            folds += f[:, 0].tolist()
        assert np.allclose(found, want[first : first + b.num_rows]) and folds == list(range(first, first + b.num_rows))

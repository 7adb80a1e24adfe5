"""Shards that change at once, exact places in files, and filters passed to SQLite."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from scrivenry.sources import files, shards, sqlite
from scrivenry.streaming import jobs

SCHEMA = "id long, t string"


def rows_of(spark, path):
    return sorted(map(tuple, shards.read(spark, path, SCHEMA).collect()), key=str)


def test_shards_are_filled_and_keep_their_names(spark, tmp_path):
    path = f"{tmp_path}/s"
    df = spark.range(25).select("id", F.concat(F.lit("ü"), "id").alias("t"))
    shards.append(df.where("id < 11").coalesce(1), path, 4)
    first = shards.manifest(path)
    assert sorted(n for _, n in first["shards"].values()) == [3, 4, 4] and first["generation"] == 1
    shards.append(df.where("id >= 11").coalesce(1), path, 4)
    second = shards.manifest(path)
    full = {n for n, (_, rows) in first["shards"].items() if rows == 4}
    assert all(second["shards"][n] == first["shards"][n] for n in full) and sorted(n for _, n in second["shards"].values()) == [2, 3, *[4] * 5]
    assert set(second["shards"]) == {f"shard-{k:05d}" for k in range(7)}
    assert rows_of(spark, path) == sorted(((r.id, r.t) for r in df.collect()), key=str)
    assert spark.read.schema(SCHEMA).json(path).count() == 25  # files without a manifest's name are gone
    placed = {(r.id, r.t): (r["__shard"], r["__pos"]) for r in shards.read(spark, path, SCHEMA, position=True).collect()}
    shards.rewrite(spark, path, SCHEMA, lambda d: d.where("id <> 5").withColumn("t", F.when(F.col("id") == 7, None).otherwise(F.col("t"))))
    assert set(shards.manifest(path)["shards"]) == set(second["shards"])
    after = {r.id: (r.t, r["__shard"], r["__pos"]) for r in shards.read(spark, path, SCHEMA, position=True).collect()}
    assert len(after) == 24 and after[7][0] is None and {after[i][1] for i in after} == set(second["shards"])
    for name in second["shards"]:
        order = lambda found: [i for _, i in sorted((p, i) for i, (s, p) in found.items() if s == name)]  # noqa: E731, B023
        assert order({i: (s, p) for i, (_, s, p) in after.items()}) == [i for i in order({i: at for (i, _), at in placed.items()}) if i != 5]
    with pytest.raises(RuntimeError, match="meanwhile"):
        shards.ShardWriter({"path": path, "most": 4, "replaces": "[]", "generation": 1}).commit([])


def test_a_task_that_fails_and_a_run_that_stops_lose_and_repeat_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    df = spark.range(10).select("id", F.lit("x").alias("t"))
    shards.append(df, path, 3)
    before, state = rows_of(spark, path), shards.manifest(path)
    broken = spark.range(4).select(F.col("id") + 100, F.when(F.col("id") < 3, "y").otherwise(F.raise_error(F.lit("down"))).alias("t")).toDF("id", "t")
    with pytest.raises(Exception, match="down"):
        shards.append(broken, path, 3)
    assert rows_of(spark, path) == before and shards.manifest(path) == state

    class Down:
        def delete_file(self, _):
            raise OSError("stopped")

    plain = shards._fs
    with monkeypatch.context() as m:  # the new manifest stands, the files of the old one are still there
        m.setattr(shards, "_fs", lambda p: (Down(), "") if p == path else plain(p))
        with pytest.raises(OSError, match="stopped"):
            shards.append(spark.createDataFrame([(50, "z")], SCHEMA), path, 3)
    assert rows_of(spark, path) == sorted([*before, (50, "z")], key=str)
    assert shards.vacuum(path) > 0
    assert spark.read.schema(SCHEMA).json(path).count() == 11 and rows_of(spark, path) == sorted([*before, (50, "z")], key=str)


def test_shards_by_split_and_empty_tables(spark, tmp_path):
    path = f"{tmp_path}/s"
    df = spark.range(12).select("id", F.lit("x").alias("t"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"))
    shards.append(df.coalesce(2), path, 3)
    shards.append(df.where("false"), path, 3)
    found = shards.read(spark, path, f"{SCHEMA}, split string").collect()
    assert {r.id: r.split for r in found} == {i: "val" if i % 3 == 0 else "train" for i in range(12)}
    assert all(n.startswith(("val/shard-", "train/shard-")) for n in shards.manifest(path)["shards"])
    assert shards.read(spark, f"{tmp_path}/none", SCHEMA).collect() == []
    shards.append(df.where("false").drop("split"), f"{tmp_path}/empty", 3)
    assert shards.read(spark, f"{tmp_path}/empty", SCHEMA).collect() == []


def test_places_are_exact_however_files_are_split(spark, tmp_path):
    for k in range(3):
        with open(f"{tmp_path}/f{k}.txt", "w") as f:
            f.writelines(f"{k}-{i} {'é' * (i * 37 % 400)}\n" for i in range(500 * k))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("3000", "50000", kept):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = spark.read.text(str(tmp_path))
            found = files.with_position(df).select(F.substring_index("value", " ", 1).alias("v"), "__pos").collect()
            assert len(found) == 1500 and all(int(r.v.split("-")[1]) == r["__pos"] for r in found)
            first = [r.value.split(" ")[0] for r in files.first_rows(df, 520).collect()]
            assert first == [f"1-{i}" for i in range(500)] + [f"2-{i}" for i in range(20)]
            assert sorted(r.value.split(" ")[0] for r in files.first_per_file(df, 2).collect()) == ["1-0", "1-1", "2-0", "2-1"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_filters_reach_sqlite(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/a.db"
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE t (id INTEGER, name TEXT COLLATE NOCASE, x REAL, raw BLOB)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, None if i % 7 == 0 else f"{'Ab' if i % 2 else 'ab'}{i}", i / 4, b"z") for i in range(1000)])
    c.execute("CREATE VIEW v AS SELECT id, name FROM t WHERE id < 10")
    c.execute("CREATE TABLE w (k TEXT PRIMARY KEY) WITHOUT ROWID")
    c.execute("INSERT INTO w VALUES ('one')")
    c.commit()
    c.close()
    df = sqlite.read_table(spark, path, "t", 4)
    every = df.collect()
    for where, want in (
        (F.col("name").startswith("Ab1"), lambda r: (r.name or "").startswith("Ab1")), (F.col("id").isin(1, 2, 3, 4000), lambda r: r.id in (1, 2, 3)), (F.col("name") == "ab2", lambda r: r.name == "ab2"),
        (F.col("name").isNull() & (F.col("x") >= 100), lambda r: r.name is None and r.x >= 100), (~F.col("id").isin(5) & (F.col("id") < 9), lambda r: r.id < 9 and r.id != 5), (F.col("name") > "Ab9", lambda r: r.name is not None and r.name > "Ab9"), (F.col("x").isNotNull() & (F.col("x") <= 1), lambda r: r.x <= 1),
    ):
        assert sorted(df.where(where).collect(), key=str) == sorted((r for r in every if want(r)), key=str)
    plan = df.where("id > 990 and name = 'ab992'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (name" in plan and "990" not in plan  # SQLite alone applies the filter on numbers
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    from pyspark.sql.types import StructType

    reader = sqlite.SqliteReader(StructType.fromDDL("id long, name string"), {"path": path, "dbtable": "t"})
    filters = [GreaterThan(("id",), 990), EqualTo(("name",), "ab992"), In(("id",), (992, None))]
    assert list(reader.pushFilters(filters)) == filters[1:2]  # Spark applies those on text again
    sql, values = reader.statement(sqlite.Range(1, 2000))
    assert values == [990, "ab992", 992, 1, 2000] and '"name" COLLATE BINARY = ?' in sql and "raw" not in sql
    assert list(reader.read(sqlite.Range(1, 2000))) == [(992, "ab992")]
    assert sqlite.read_table(spark, path, "t", 4, ["x"]).columns == ["x"] and sqlite.read_table(spark, path, "t", 4, ["x"]).count() == 1000
    assert sqlite.read_table(spark, path, "v").count() == 10 and [r.k for r in sqlite.read_table(spark, path, "w").collect()] == ["one"]


def test_resume_looks_for_the_path_and_knows_null_keys(spark, tmp_path):
    path, seen = f"{tmp_path}/done", []
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "k long, v string")
    work = lambda d: seen.append(d.count()) or d
    for _ in range(2):
        assert jobs.resumed(df, work, path, ["k"]).count() == 3
    assert seen == [3, 0]
    with pytest.raises(Exception, match="nosuch"):  # not taken for work that isn't done yet
        jobs.resumed(df, work, path, ["nosuch"])
    assert seen == [3, 0]


def test_a_lineage_log_goes_on_where_it_stopped(spark, tmp_path):
    source, log, state = (f"{tmp_path}/{n}" for n in ("in", "log", "state"))
    like = spark.createDataFrame([], "run long, k long, work string")

    def more(low, high):
        spark.range(low, high).select((F.col("id") % 2).alias("run"), F.col("id").alias("k"), F.concat(F.lit("w"), F.floor(F.col("id") / 20)).alias("work")).write.mode("append").parquet(source)

    def go():
        return jobs.logged(jobs.lineage_stream(jobs.file_stream(spark, source, like), "run", "k", "work", 5, 3), log, state)

    more(0, 23)
    first = sorted(map(tuple, go().collect()))
    assert [r[:4] for r in first] == [(0, 1, 1, 1), (0, 2, 1, 2), (1, 1, 1, 1), (1, 2, 1, 2)]
    assert sorted(map(tuple, go().collect())) == first  # nothing new, nothing again
    more(23, 60)
    found = sorted(map(tuple, go().collect()))
    want = []
    for run in (0, 1):
        own = [i for i in range(60) if i % 2 == run]
        want += [(run, m + 1, m // 3 + 1, m % 3 + 1, sorted({f"w{i // 20}" for i in own[5 * m : 5 * m + 5]}), 5) for m in range(6)]
    assert found == want
    # A batch that is run again, its end not having been noted, replaces its lines.
    import os

    commits = f"{state}/commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{commits}/{f}"):
            os.remove(f"{commits}/{f}")
    assert sorted(map(tuple, go().collect())) == want

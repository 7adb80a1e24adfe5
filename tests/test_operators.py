"""Audit, reading order, chunks, duplicates, samples, features and services."""

import gzip
import json
import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from scrivenry.operators import audit, chunking, dedup, features, measures, reading, sampling, terms
from scrivenry.sources import files, schemas, services, sqlite
from scrivenry.streaming import jobs


@pytest.fixture(scope="module")
def corpus(spark):
    novels = spark.createDataFrame([("a", 1, 2, 2, 1, 1), ("b", 2, None, 1, 2, 0), ("b", None, 1, 1, 2, 0), ("c", 1, 0, 0, 1, None)], "ncode string, site_type int, general_all_no int, total_ep int, sub_site int, rating int")
    episodes = spark.createDataFrame([("a", "1", "  "), ("a", "2", "x�"), ("a", "2", "<b>" + "<i></i>" * 60 + "</b>"), ("b", "1", None), ("z", "1", "fine"), (None, "1", "fine")], "ncode string, episode_no string, body string")
    return novels, episodes, spark.createDataFrame([("a", 1), ("a", 0), ("c", 1)], "ncode string, is_r18 int")


def test_audit_report(corpus):
    r = audit.report(*corpus).first()
    assert (r.novels_total, r.novels_duplicate_ncode, r.episodes_total, r.episodes_duplicate_key) == (4, 1, 6, 2)
    assert (r.n_without, r.mismatch_general_all_no, r.mismatch_total_ep) == (1, 2, 1)
    assert r.site_type_breakdown == {"1": 2, "2": 1, "None": 1} and r.n_orphan_episode_ncodes == 1
    assert (r.empty_body_episode_count, r.encoding_anomaly_episode_count, r.html_ratio_anomaly_episode_count) == (2, 1, 1)
    assert (r.sub_site_eq_2, r.rating_eq_1, r.url_entity_is_r18) == (2, 2, 0)
    assert {x.ncode for x in audit.rejected(*corpus[:2]).collect() if x.reason == "orphan_episode"} == {"z", None}
    assert sorted(x.reason for x in audit.rejected(*corpus[:2]).collect()) == ["empty_body", "empty_body", "encoding_anomaly", "html_ratio_anomaly", "orphan_episode", "orphan_episode"]


def test_missing_schema(corpus):
    absent, columns = audit.missing_schema({"episodes": corpus[1]})
    assert absent == ["novels_descs", "url_entity", "episode_mapping"] and columns == {"episodes": ["e_title", "update_time"]}


def test_look_back_and_ahead(spark):
    texts = [random.Random(i).choice(["", "ab", "xyz" * 5, "q"]) for i in range(30)]
    df = spark.createDataFrame([("w", i, t) for i, t in enumerate(texts)], "w string, i int, t string")
    found = reading.look_ahead(reading.look_back(df, ["w"], ["i"], "t", 12), ["w"], ["i"], "t", 3, 9).orderBy("i").collect()
    assert [r.context for r in found] == ["".join(texts[:i])[-12:] for i in range(30)]
    assert [r.continuation for r in found] == ["".join(texts[i : i + 3])[:9] for i in range(30)]


def test_even_places(spark):
    rows = [(n, k) for n in range(1, 12) for k in range(1, 13)]
    found = spark.createDataFrame(rows, "n long, k long").select("n", "k", reading.even_places(F.col("n"), F.col("k")).alias("p")).collect()
    for r in found:
        want = list(range(r.n)) if r.k >= r.n else [r.n // 2] if r.k == 1 else sorted({round(i * (r.n - 1) / (r.k - 1)) for i in range(r.k)})
        assert sorted(r.p) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=30), st.sampled_from(list(reading.METHODS)), st.integers(1, 200))
def test_segments_do_not_overlap(sizes, method, chars):
    texts = [chr(97 + i % 26) * n for i, n in enumerate(sizes)]
    found = reading.allocate(texts, reading.METHODS[method], chars)
    share = max(1, chars // len(reading.METHODS[method]))
    taken = [i for _, s, n, _ in found for i in range(s, s + n)]
    assert len(taken) == len(set(taken)) and all(0 < len(t) <= share for _, _, _, t in found)
    assert all(0 <= i < len(texts) for i in taken)
    assert all(t in "".join(texts[s : s + n]) for _, s, n, t in found)


@settings(max_examples=40, deadline=None)
@given(st.text("ab。 \n！」", max_size=300), st.integers(5, 30), st.integers(0, 4))
def test_chunks_lose_nothing(text, target, overlap):
    found = chunking.chunk(text, target=target, most=target + 10, overlap=overlap)
    whole = "".join(t for _, t, _ in found)
    assert set(text.split()) == set() or all(c in whole for c in set(text) - set(" \n"))
    assert [i for i, _, _ in found] == list(range(len(found)))
    assert all(n == len(chunking.regex_tokens(t)) for _, t, n in found)
    if not overlap:
        keep = lambda s: "".join(s.split())
        assert keep(whole) == keep(text)


def test_chunks_prefer_paragraphs_and_join_short_tails():
    text = "one two three. four five.\n\nsix seven"
    assert [t for _, t, _ in chunking.chunk(text, target=8, most=8, overlap=0)] == [text[:25], "six seven"]
    paragraphs = "\n\n".join(f"p{i} " + "w " * 28 + "end." for i in range(40))
    found = chunking.chunk(paragraphs, target=150, most=200, overlap=50)
    assert len(found) > 5 and all(n <= 200 for _, _, n in found[:-1])
    assert all(b.split()[0] in a for (_, a, _), (_, b, _) in zip(found, found[1:]))
    tail = chunking.chunk("w " * 100 + ".\n\nx y", target=100, most=101, overlap=0)
    assert len(tail) == 1 and tail[0][2] > 101
    for bad in ((0, 1, 0), (3, 2, 0), (3, 4, 3), (3, 4, -1)):
        with pytest.raises(ValueError):
            chunking.chunk("x", target=bad[0], most=bad[1], overlap=bad[2])
    assert chunking.chunk(None) == chunking.chunk(" 　") == []


def test_greedy_duplicates(spark):
    base = "a sentence that is long enough to have many grams in it, and then some more words"
    assert dedup.find_duplicates([base, "quite other text here", base, base.replace(",", " ,"), base[:-1] + "z"]) == {2: 0, 3: 0, 4: 0}
    assert dedup.find_duplicates(["", " ", "a"]) == {1: 0}
    df = spark.createDataFrame([("w", 0, base), ("w", 1, base), ("v", 0, base), ("w", 2, None)], "n string, i long, t string")
    assert {(r.n, r.i): r.duplicate_of for r in dedup.greedy_near_duplicates(df, ["n"], "i", "t").collect()} == {("w", 0): None, ("w", 1): 0, ("v", 0): None, ("w", 2): None}


def sample_rows(spark):
    works = {"nA": ("X", "fantasy", False, 10), "nB": ("X", "romance", False, 8), "nC": ("Y", "fantasy", True, 15), "nD": ("Z", "sf", False, 5)}
    rows = [(f"{n}:{i}", n, a, [g], r) for n, (a, g, r, k) in works.items() for i in range(k)]
    return spark.createDataFrame(rows, "id string, ncode string, author string, genre array<string>, is_r18 boolean")


def test_stratified_sample_is_stable_and_adds_up(spark):
    df = sample_rows(spark)
    config = sampling.Sampling(5, max_per_work=6, genre_max={"fantasy": 8}, max_author_share=0.4, r18_ratio=0.2)
    one, report = sampling.stratified(df, config)
    two, _ = sampling.stratified(df.repartition(9), config)
    assert [r.id for r in one.collect()] == [r.id for r in two.collect()]
    assert report["total_input"] == 38 == report["total_selected"] + sum(report[k] for k in ("max_per_work", "genre_max", "max_author_share", "r18_ratio"))
    assert [r.id for r in sampling.stratified(df, sampling.Sampling(6))[0].collect()] != [r.id for r in sampling.stratified(df, sampling.Sampling(5))[0].collect()]
    with pytest.raises(ValueError):
        sampling.stratified(df, sampling.Sampling(1, length_strata={}))
    for share in (0, 1.5):
        with pytest.raises(ValueError):
            sampling.author_share(df, "author", share, 1, "id")


def test_quotas_fill_up():
    assert sampling.quotas({"a": 2, "b": 100, "c": 100}, 62) == {"a": 2, "b": 30, "c": 30}
    assert sampling.quotas({"a": 2}, 10) == {"a": 2} and sampling.quotas({}, 3) == {}


def test_shares_and_agreement(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (1, "y", 1.0), (2, "y", 2.0), (2, "y", 1.0)], "i int, v string, w double")
    k = measures.chance_corrected(df, "i", "v").first()
    assert k.observed == pytest.approx((1 / 3 + 1) / 2, abs=1e-6) and k.expected == pytest.approx(0.52) and k.majority == "y"
    assert {r.i: r.m for r in measures.weighted_mode(df.withColumn("w", F.when(F.col("v") == "y", 2.0).otherwise(F.col("w"))), ["i"], "v", F.col("w"), "m").collect()} == {1: "y", 2: "y"}


def test_feature_rollup(spark):
    f = lambda g, c, shapes, kinds, n=1: (g, None, None, None, None, None, None, n, (c > 0.5, int(c * 4)), (False, 0), shapes, kinds, c)
    rows = [("w", 0, f("male", 0.5, ["quest_adventure", "comedy"], [("family", "minor")])), ("w", 1, f("female", 0.9, ["comedy"], [("family", "central"), ("rivalry", "major")], 4)), ("w", 2, f("male", 0.0, None, None))]
    (r,) = features.aggregate(spark.createDataFrame(rows, f"ncode string, ordinal int, features {features.SCHEMA}")).collect()
    assert r.protagonist_gender == "male" and r.viewpoint_person == "unclear" and r.protagonist_count == 2
    assert r.sexual_content.present and r.sexual_content.explicitness == 3
    assert r.story_shape == ["comedy", "quest_adventure"] and [k.kind for k in r.main_relationships] == ["family", "rivalry"] and r.confidence == 0.4667
    v = spark.createDataFrame(rows[:2], f"ncode string, ordinal int, features {features.SCHEMA}").select(features.vector(F.col("features")).alias("v")).collect()
    assert len(v[0].v) == 77 and v[0].v[0] == 1.0 and sum(v[0].v[44:56]) == pytest.approx(0.3)
    tags = spark.createDataFrame(rows[1:2], f"ncode string, ordinal int, features {features.SCHEMA}").select(*[c.alias(str(i)) for i, c in enumerate(features.tag_predicates(F.col("features")).values())]).first()
    assert tags[1] and tags[2] and not tags[0]


def test_schema_problems():
    schema = {"required": ["a", "b"], "properties": {"a": {"enum": [1]}, "b": {"items": {"properties": {"c": {}}, "required": ["c"]}}}}
    assert features.problems({"a": 2, "b": [{"c": 1}, {"d": 1}], "x": 0}, schema) == ["enum:a=2", "missing:b[1].c", "unknown:b[1].d", "unknown:x"]
    assert features.problems({"a": 1}, schema) == ["missing:b"]


def test_viewpoints(spark):
    rows = [("w1", "俺は歩いた。「私は」" * 400), ("w2", "彼は歩いた。" * 500), ("w3", "俺")]
    found = {r.w: r for r in terms.viewpoints(spark.createDataFrame(rows, "w string, t string"), "w", "t").collect()}
    assert [found[w].viewpoint for w in ("w1", "w2", "w3")] == ["first_person", "third_person", "unknown"]
    assert found["w1"].pronouns == {"俺": 400} and found["w1"].narration_chars == 2400


def test_candidates_keep_counts(spark):
    found = spark.createDataFrame([("アリス 自分 王国 王国 ア",)], "t string").select(terms.candidates(F.col("t")).alias("c")).first().c
    assert found == ["アリス", "王国", "王国"]


def answers(script):
    calls = []

    def transport(url, params):
        calls.append(url)
        step = script[len(calls) - 1]
        if isinstance(step, Exception):
            raise step
        return step

    return transport, calls


def body(*records):
    return gzip.compress(json.dumps([{"allcount": len(records)}, *records]).encode())


@pytest.mark.parametrize(
    ("script", "status", "attempts", "waits"),
    [
        ([(200, body({"title": "t", "genre": 101}))], "available", 1, []), ([(200, body())], "not_found", 1, []), ([(404, b"")], "unknown", 1, []), ([(503, b""), (200, body({"ncode": "n"}))], "available", 2, [1]),
        ([ConnectionError("x")] * 5, "unknown", 5, [1, 2, 4, 8]), ([(200, b"not json"), (200, json.dumps([{}, {"ncode": "n"}]).encode())], "available", 2, [1]),
    ],
)
def test_fetch(script, status, attempts, waits):
    transport, calls = answers(script)
    waited = []
    r = services.fetch("n1", True, transport, sleep=waited.append, now=lambda: "now")
    assert (r[1], r[4], waited) == (status, attempts, waits) and set(calls) == {services.ADULT_URL}
    if script == [(200, body({"title": "t", "genre": 101}))]:
        assert r[3]["genre"] == "101" and len(r[3]) == 22


def test_model_answers():
    check = lambda x: features.problems(x, {"required": ["a"], "properties": {"a": {}}})
    texts = iter(["junk", '{"b": 1}', '<think>x</think>{"a": 1}'])
    assert services.answer("p", lambda p: next(texts), check, 3) == ({"a": 1}, None)
    assert services.answer("p" * 7000, lambda p: "{}", check, 3) == (None, "too_long")
    assert services.answer("p", lambda p: "{}", check, 2) == (None, "missing:a")


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.db")
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE episodes (ncode TEXT, episode_no TEXT, body TEXT, n INTEGER)")
    c.execute("CREATE TABLE empty (a TEXT)")
    c.executemany("INSERT INTO episodes VALUES (?, ?, ?, ?)", [(f"n{i}", str(i), None if i % 3 else "text", i) for i in range(500)])
    c.commit()
    c.close()
    df = sqlite.read_table(spark, path, "episodes", 4)
    assert df.dtypes == [("ncode", "string"), ("episode_no", "string"), ("body", "string"), ("n", "bigint")]
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("n")).first()[0] == sum(range(500)) and df.where("body is not null").count() == 167
    assert sqlite.read_table(spark, path, "empty").count() == 0 and sqlite.tables(path)["empty"] == ["a"]
    with pytest.raises(sqlite3.OperationalError):
        sqlite.connect(path).execute("DELETE FROM episodes")


def test_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"s{k}.jsonl").write_text("\n".join([json.dumps({"id": f"{k}-{i}", "text": "x" if i else ""}) for i in range(4)] + ["", "{bad"]))
    df = files.read_jsonl(spark, str(tmp_path / "*.jsonl"), "id string, text string")
    assert df.count() == 12 and files.read_jsonl(spark, str(tmp_path), "id string, text string", "keep").where("id is null and _corrupt_record is not null").count() == 3
    assert sorted(r.id for r in files.first_per_file(df, 2).collect()) == ["0-0", "0-1", "1-0", "1-1", "2-0", "2-1"]
    assert files.calibration_texts(df, 2, 1).count() == 0
    assert sorted(r.ncode for r in files.id_list(spark, " a, b,,a").collect()) == ["a", "b"]
    assert [r.v for r in spark.createDataFrame([("a, ,b",), ("",), (None,)], "c string").select(files.comma_list(F.col("c")).alias("v")).collect()] == [["a", "b"], None, None]
    files.write_shards(df.withColumn("split", F.lit("train")), str(tmp_path / "out"), 5)
    assert spark.read.json(str(tmp_path / "out")).count() == 12 and files.file_digests(spark, str(tmp_path / "*.jsonl")).count() == 3
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        files.write_shards(df, str(tmp_path / "out"), 5)


def test_defaults(spark):
    r = spark.range(1).select(schemas.default_chunk_classification().alias("c"), schemas.default_work_classification().alias("w"))
    row = r.select("c", "w", schemas.content_intensity(F.col("c.content")).alias("i")).first()
    assert row.c.content.minor_related == "none" and row.i == 0 and row.w.protagonist.gender == "unknown" and row.w.genre == []


def test_resume(spark, tmp_path):
    df, path = spark.range(10).withColumnRenamed("id", "k"), str(tmp_path / "done")
    work = lambda d: d.withColumn("ok", F.col("k") % 2 == 0)
    assert jobs.resumed(df.where("k < 4"), work, path, ["k"], "ok").count() == 4
    assert jobs.resumed(df, work, path, ["k"], "ok").count() == 4 + 8
    assert jobs.resumed(df, work, path, ["k"]).count() == 12


def test_feature_rollup_has_two_exchanges(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("ncode"), F.col("id").alias("ordinal"), F.lit(None).cast(features.SCHEMA).alias("features"))
    made = features.aggregate(df)
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") <= 2 and "Join" not in plan
    (r, *_) = made.collect()
    assert r.protagonist_gender == "unclear" and r.story_shape == ["other"] and r.main_relationships == [] and r.confidence == 0.0 and r.protagonist_count == 0


def test_segments_equal_the_plain_allocation(spark):
    rng = random.Random(12)
    rows = [(w, None if w == 2 and i == 1 else "".join(rng.choice("abcé😀") for _ in range(rng.choice([0, 3, 40, 90]))), i) for w in (1, 2, 3, None) for i in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "w int, t string, i int").repartition(5)
    for method, chars in (("stratified9", 300), ("ends3", 50), ("uniform9", 5000)):
        found = {(r.w, r.position): (r.start_chunk, r.n_chunks, r.n_chars, r.text) for r in reading.segments(df, ["w"], ["i"], "t", method, chars).collect()}
        want = {(w, p): (s, n, len(t), t) for w in (1, 2, 3, None) for p, s, n, t in reading.allocate([t or "" for v, t, _ in rows if v == w], reading.METHODS[method], chars)}
        assert found == want
    plan = reading.segments(df, ["w"], ["i"], "t", "ends3", 50)._jdf.queryExecution().optimizedPlan().toString()
    assert [p for p in plan.split("\n") if "FlatMapGroupsInPandas" in p and "__size" in p and " t#" not in p]


def test_chunks_by_a_tokenizers_offsets():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokens = chunking.FileTokens(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    text = "\n\n".join(f"{i}. " + " ".join(rng.choice(["river", "Straße", "naïve", "unbelievable", "日本語", "x"]) for _ in range(rng.randint(1, 60))) + rng.choice([".", "!", "。"]) for i in range(40))
    found = chunking.chunk(text, tokens, 150, 200, 50)
    assert len(found) > 3 and all(n == len(tokens(t)) for _, t, n in found) and all(n <= 200 + chunking.MARGIN for _, _, n in found[:-1])
    assert "".join(text.split()).startswith("".join(found[0][1].split())) and text.split()[-1] == found[-1][1].split()[-1]
    # One long sentence is cut at tokens, with a margin, and nothing of it is lost.
    long = " ".join(rng.choice(["tokenization", "élan", "ж"]) for _ in range(500))
    parts = chunking.chunk(long, tokens, 60, 60, 0)
    assert len(parts) > 5 and "".join("".join(t for _, t, _ in parts).split()) == "".join(long.split())
    assert all(len(library.encode(t, add_special_tokens=False).ids) <= 60 for _, t, _ in parts[:-1])

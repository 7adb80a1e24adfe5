"""Queries of sources, chunks, models and streams."""

import json

from pyspark.sql import functions as F

from scrivenry.functions import meta
from scrivenry.functions import text as T
from scrivenry.operators import audit, chunking, classify, pipelines
from scrivenry.plans.common import query, spread, table
from scrivenry.sources import files, services, shards, sqlite
from scrivenry.sources.scratch import scratch
from scrivenry.streaming import jobs


@query("""
SELECT doc_id, lang, length(text)::INT AS n FROM documents WHERE doc_id % 10 <> 3""")
def jsonl_roundtrip(spark, sf):
    """Documents written as JSON lines, some of them broken, and read back under a schema."""
    d, path = table(spark, sf, "documents"), scratch(spark, "jsonl")
    line = F.to_json(F.struct("doc_id", "lang", "text"))
    d.select(F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("{bad"), line)).otherwise(line).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.length("text").alias("n"))


@query("""SELECT 'en' AS split, doc_id, n_chars FROM documents WHERE lang = 'en' UNION ALL SELECT 'other', doc_id, n_chars FROM documents WHERE lang <> 'en'""")
def sharded_output(spark, sf):
    """Shards of at most 100 rows in a folder for each split, read back."""
    path = scratch(spark, "shards")
    files.write_shards(table(spark, sf, "documents").select("doc_id", "n_chars", F.when(F.col("lang") == "en", "en").otherwise("other").alias("split")), path, 100)
    return spark.read.schema("doc_id long, n_chars long, split string").json(path).select("split", "doc_id", "n_chars")


@query("""SELECT doc_id, quality AS a, toxic AS b FROM labels WHERE doc_id % 5 <> 0""")
def label_table(spark, sf):
    """Labels written with tabs, some not numbers, and read back."""
    path = scratch(spark, "labels")
    a = F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("quality").cast("string"))
    table(spark, sf, "labels").select("doc_id", a.alias("a"), F.col("toxic").alias("b")).write.option("sep", "\t").option("header", True).csv(path)
    return files.read_labels(spark, path, "doc_id", ["a", "b"]).withColumn("doc_id", F.col("doc_id").cast("long"))


def _site(url: str, params: dict) -> tuple[int, bytes]:
    """A stand-in for the status API, so that the query runs without a network."""
    import gzip

    n = int(params["ncode"][1:])
    if n % 7 == 0:
        raise ConnectionError("down")
    if n % 5 == 0:
        return 404, b""
    work = [{"allcount": 1}] + ([{"ncode": params["ncode"], "title": "t", "genre": 101}] if n % 3 else [])
    return 200, gzip.compress(json.dumps(work).encode())


@query("""
SELECT 'n' || conv_id AS ncode, CASE WHEN conv_id % 7 = 0 OR conv_id % 5 = 0 THEN 'unknown' WHEN conv_id % 3 = 0 THEN 'not_found' ELSE 'available' END AS status,
 CASE WHEN conv_id % 7 = 0 THEN 5 ELSE 1 END::INT AS attempts FROM (SELECT DISTINCT conv_id FROM conversations)""")
def api_refresh(spark, sf):
    works = table(spark, sf, "conversations").select(F.concat(F.lit("n"), F.col("conv_id")).alias("ncode"), F.lit(False).alias("is_r18")).distinct()
    return services.refresh(works, _site, sleep=_no_wait).select("ncode", "status", "attempts")


@query("""
WITH w AS (SELECT DISTINCT conv_id FROM conversations), s AS (SELECT CASE WHEN conv_id % 7 = 0 OR conv_id % 5 = 0 THEN 'unknown' WHEN conv_id % 3 = 0 THEN 'not_found' ELSE 'available' END AS status, count(*) AS n FROM w WHERE conv_id % 2 = 1 GROUP BY 1)
SELECT (SELECT count(*) FROM w WHERE conv_id % 2 = 1) AS processed, (SELECT count(*) FROM w WHERE conv_id % 2 = 0) AS skipped, (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM s) AS statuses""")
def api_refresh_resumed(spark, sf):
    """Half of the works are asked, and then all: the second run asks only those that have no answer."""
    works, path = table(spark, sf, "conversations").select(F.concat(F.lit("n"), F.col("conv_id")).alias("ncode"), F.lit(False).alias("is_r18"), "conv_id"), scratch(spark, "answers")
    services.refresh_resumed(works.where("conv_id % 2 = 0"), _site, path, sleep=_no_wait)
    found = services.refresh_resumed(works, _site, path, sleep=_no_wait)
    listed = F.array_join(F.transform(F.map_entries("status_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select("processed", "skipped", listed.alias("statuses"))


@query("""SELECT 'encoding_anomaly' AS reason, ['unpaired_surrogate'] AS detail, count(*) AS n FROM documents WHERE doc_id % 10 = 3""")
def raw_faults(spark, sf):
    """Lines of a file with half of a surrogate pair."""
    path, text = scratch(spark, "raw"), F.translate("text", "\n\r", "  ").cast("binary")
    broken = F.concat(F.unhex(F.lit("EDA0BD")), text)
    table(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 == 3, broken).otherwise(text).cast("string").alias("value")).write.text(path)
    return audit.raw_faults(spark, path).groupBy("reason", "detail").agg(F.count("*").alias("n"))


def _no_wait(seconds: float) -> None:
    return None


def _model(prompt: str) -> str:
    """A stand-in for a language model."""
    return "<think>hm</think>" + json.dumps({"size": "long" if len(prompt) > 1000 else "short"})


@query("""SELECT doc_id, length(text) <= 6000 AS ok, CASE WHEN length(text) > 6000 THEN NULL WHEN length(text) > 1000 THEN 'long' ELSE 'short' END AS size FROM documents""")
def model_answers(spark, sf):
    schema = {"required": ["size"], "properties": {"size": {"enum": ["long", "short"]}}}
    found = services.classify(table(spark, sf, "documents"), "doc_id", "text", _model, schema)
    return found.select("doc_id", "ok", F.get_json_object("answer", "$.size").alias("size"))


@query("""
WITH w AS (SELECT lang, source, [lang, source, CASE WHEN doc_id % 2 = 0 THEN 'war' ELSE 'SF' END] AS k, doc_id FROM documents)
SELECT doc_id, [lang, source, CASE WHEN doc_id % 2 = 0 THEN '戦争' ELSE 'SF' END] AS tags, CASE WHEN doc_id % 2 = 0 THEN ['戦争'] ELSE ['SF'] END AS set_flags, 23::INT AS n_flags FROM w""")
def keyword_tags(spark, sf):
    d = table(spark, sf, "documents").withColumn("k", meta.source_keywords(F.concat_ws(" ", "lang", "source"), F.when(F.col("doc_id") % 2 == 0, "Ｗａｒ").otherwise("ＳＦ")))
    return meta.normalise_keywords(d, "k", "tags").withColumn("f", meta.flags("tags")).select("doc_id", "tags", F.map_keys(F.map_filter("f", lambda _, v: v)).alias("set_flags"), F.size("f").alias("n_flags"))


@query("""
SELECT doc_id, CASE WHEN quality = 1 THEN true WHEN toxic = 1 THEN true WHEN lang = 'es' THEN true ELSE false END AS is_r18,
 CASE WHEN quality = 1 THEN 'sub_site' WHEN toxic = 1 THEN 'rating' WHEN lang = 'es' THEN 'url_entity' ELSE 'none' END AS source FROM documents LEFT JOIN labels USING (doc_id)""")
def adult_rating(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", meta.adult_rating(F.col("quality") + 1, F.col("toxic"), F.col("lang") == "es").alias("r")).select("doc_id", "r.is_r18", "r.source")


@query()
def chunk_docs(spark, sf):
    """Every document in chunks of about 200 tokens."""
    d = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("ncode"), F.lit(1).alias("episode_no"), "text"))
    return chunking.chunk_episodes(d, ["ncode", "episode_no"], "text", 200, 260, 30).withColumn("id", chunking.chunk_id())


@query()
def tfidf_classifier(spark, sf):
    """Quality from character n-grams: measures of out-of-fold scores, with the operator's vocabulary and five folds.
    Every labelled document takes part, whole."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "quality")
    vectors = classify.tfidf(d, "text")
    return classify.evaluate(vectors, "quality", "doc_id", "features", k=5)[0]


@query("""
WITH r AS (SELECT user_id % 4 AS run, event_type, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS i FROM events), m AS (SELECT run, i // 64 AS m, list_sort(list(DISTINCT event_type)) AS works, count(*) AS n FROM r GROUP BY 1, 2)
SELECT run, m + 1 AS micro_batch, m // 8 + 1 AS optimizer_step, m % 8 + 1 AS accumulation_index, works, n FROM m WHERE n = 64""")
def lineage_log(spark, sf):
    """The log of the micro-batches of four runs, from a stream of what they read."""
    events = table(spark, sf, "events")
    stream = jobs.file_stream(spark, sf, events, "events.parquet").withColumn("run", F.col("user_id") % 4)
    return jobs.logged(jobs.lineage_stream(stream, "run", "event_id", "event_type", 64, 8), scratch(spark, "log"), scratch(spark, "log-state"))


@query("""SELECT event_id, user_id, event_type FROM events""")
def stream_dedup(spark, sf):
    events = table(spark, sf, "events")
    doubled = jobs.file_stream(spark, sf, events, "events.parquet")
    return jobs.run_once(jobs.unique_within(doubled.union(doubled), "ts", ["event_id"], "60 days"), "dedup").select("event_id", "user_id", "event_type")


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf):
    events = table(spark, sf, "events")
    found = jobs.tumbling(jobs.file_stream(spark, sf, events, "events.parquet"), "ts", "1 day", ["event_type"], "1 day")
    return jobs.run_once(found, "windows", "complete").withColumn("total", F.bround("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
WITH b AS (SELECT event_id // 8 + 1 AS micro_batch, event_type FROM events)
SELECT micro_batch, (micro_batch - 1) // 4 + 1 AS optimizer_step, (micro_batch - 1) % 4 + 1 AS accumulation_index, list_sort(list_distinct(list(event_type))) AS works, count(*) AS n FROM b GROUP BY micro_batch""")
def batch_lineage(spark, sf):
    return jobs.lineage(table(spark, sf, "events"), "event_id", "event_type", 8, 4)


@query(r"""SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n\v\f]')) AS n FROM documents) WHERE n <= 512""")
def token_budget(spark, sf):
    """Rows within a budget of tokens, by the trainer's filter."""
    view = table(spark, sf, "documents").select("doc_id", "text", F.struct(F.concat(F.lit("w"), F.col("doc_id")).alias("ncode")).alias("meta"))
    n = F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n\x0b\f]"), F.lit(0))).cast("long")
    return pipelines.trainer_rows(view, n, 512).select("doc_id", F.col("n_tokens").alias("n"))


@query("""SELECT doc_id, length(text) AS n_chars, length(text) <= 3000 AS ok, CASE WHEN length(text) > 3000 THEN 'too_long' END AS skipped, CASE WHEN length(text) <= 3000 THEN CASE WHEN length(text) > 1000 THEN 'long' ELSE 'short' END END AS size,
 CASE WHEN length(text) <= 3000 AND length(text) > 1000 THEN ['enum:size=' || chr(39) || 'long' || chr(39)] WHEN length(text) <= 3000 THEN [] END AS problems FROM documents""")
def extracted_features(spark, sf):
    """Features by a stand-in for a model, under a schema that knows one of its two answers."""
    schema = {"required": ["size"], "properties": {"size": {"enum": ["short"]}}}
    found = services.extract(table(spark, sf, "documents"), "doc_id", "text", _plain_model, schema, str, 3000)
    return found.select("doc_id", "n_chars", "ok", "skipped", F.get_json_object("features", "$.size").alias("size"), "problems")


def _plain_model(prompt: str) -> str:
    return json.dumps({"size": "long" if len(prompt) > 1000 else "short"})


@query("""
WITH c AS (SELECT 'n' || conv_id AS ncode, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
w AS (SELECT 'work:' || ncode AS key, 'work' AS kind, length(left(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) FILTER (i % greatest(1, n // 3) = 0), 900)) AS n FROM c GROUP BY ncode),
r AS (SELECT 'recent:' || ncode || ':' || turn AS key, 'recent' AS kind, length(right(coalesce(string_agg(text, '' ORDER BY turn) OVER (PARTITION BY ncode ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 600)) AS n FROM c)
SELECT key, kind, n, CASE WHEN kind = 'work' THEN 'S' || n WHEN n >= 400 THEN 'S' || n END AS summary, CASE WHEN kind = 'recent' AND n < 400 THEN 'too_little_text' END AS reason FROM (SELECT * FROM w UNION ALL SELECT * FROM r)""")
def summaries(spark, sf):
    """Summaries of works and of what came before each episode, by a stand-in for a model."""
    chunks = table(spark, sf, "conversations").select(F.concat(F.lit("n"), "conv_id").alias("ncode"), F.col("turn").alias("episode_no"), F.lit(0).alias("chunk_index"), "text")
    works, episodes = pipelines.summary_targets(chunks.select(F.struct("ncode", "episode_no").alias("meta")))
    made = pipelines.summary_jobs(chunks, works, episodes, None, 900, 600, 3)
    found = services.summaries(made, _summary)
    return found.join(made.select("key", F.length("material").cast("long").alias("n")), "key").select("key", "kind", "n", "summary", "reason")


def _summary(prompt: str) -> str:
    return json.dumps({"summary": f"S{len(prompt)}", "characters": [], "setting_terms": [], "open_threads": []})


@query("""SELECT doc_id, lang, length(text)::INT AS n FROM documents""")
def appended_shards(spark, sf):
    """Shards of 70 rows, filled in two runs: the files left short by the first are filled, and no row is lost."""
    d, path = table(spark, sf, "documents").select("doc_id", "lang", "text"), scratch(spark, "resumed")
    for part in (d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0")):
        shards.append(part, path, 70)
    return shards.read(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.length("text").alias("n"))


@query("""SELECT lang AS split, doc_id, upper(source) AS source FROM documents WHERE doc_id % 5 <> 0""")
def rewritten_shards(spark, sf):
    """Shards of 100 rows in a folder for each language, rewritten in place: some rows change, others go."""
    path = scratch(spark, "rewritten")
    shards.append(table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("split")), path, 100)
    schema = "doc_id long, source string, split string"
    shards.rewrite(spark, path, schema, lambda rows: rows.where("doc_id % 5 <> 0").withColumn("source", F.upper("source")))
    return shards.read(spark, path, schema).select("split", "doc_id", "source")


@query("""SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents""")
def placed_rows(spark, sf):
    """Rows of a file for each source, numbered by where they stand in it."""
    path = scratch(spark, "placed")
    d = table(spark, sf, "documents").select("source", "doc_id", "text").repartition("source").sortWithinPartitions("source", "doc_id")
    d.write.partitionBy("source").json(path)
    placed = files.with_position(spark.read.schema("doc_id long, text string, source string").json(path))
    return placed.select("source", "doc_id", F.col("__pos").alias("place"))


@query("""SELECT source, doc_id FROM documents WHERE doc_id % 3 = 1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 4""")
def first_of_files(spark, sf):
    """The first four rows of each file."""
    path = scratch(spark, "first")
    d = table(spark, sf, "documents").select("source", "doc_id").where("doc_id % 3 = 1").repartition("source").sortWithinPartitions("source", "doc_id")
    d.write.partitionBy("source").json(path)
    return files.first_per_file(spark.read.schema("doc_id long, source string").json(path), 4).select("source", "doc_id")


@query("""SELECT doc_id, source, n_chars FROM documents WHERE lang IN ('en', 'fr') AND n_chars > 500 AND source LIKE 'src1%'""")
def sqlite_scan(spark, sf):
    """A SQLite copy of the documents' columns but the text, read with its filters passed on."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    path = scratch(spark, "sqlite").removeprefix("file://")
    d.coalesce(1).mapInArrow(sqlite.written(path, "documents"), "n long").collect()  # SQLite has one writer
    rows = sqlite.read_table(spark, path, "documents", 4, ["doc_id", "lang", "source", "n_chars"])
    return rows.where(F.col("lang").isin("en", "fr") & (F.col("n_chars") > 500) & F.col("source").startswith("src1")).drop("lang")


def _tags(spark, sf):
    """Labelled documents with n-gram vectors, and three tags to learn."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "lang", "quality", "toxic")
    return d, {"french": F.col("lang") == "fr", "good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}


@query()
def tag_grid(spark, sf):
    """Ranking quality of each tag under two vectorisers and two strengths, whole labelled texts."""
    d, tags = _tags(spark, sf)
    configs = [classify.Vectors(features=20_000), classify.Vectors(features=5_000, low=1, high=2)]
    return classify.grid(d, "text", tags, "doc_id", configs, [0.3, 3.0])


@query()
def tag_candidates(spark, sf):
    """For each tag the 50 documents without it that most look like those with it."""
    d, tags = _tags(spark, sf)
    return classify.tag_candidates(classify.tfidf(d, "text", "features", classify.Vectors(features=20_000)), "features", tags, "doc_id", 50)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents""")
def replaced_table(spark, sf):
    """A table put in place of the one it was made from."""
    path = f"{scratch(spark, 'replaced')}/t"
    table(spark, sf, "documents").select("doc_id", "lang").write.json(path)
    old = spark.read.schema("doc_id long, lang string").json(path)
    files.replace_table(old.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))), path)
    return spark.read.schema("doc_id long, lang string").json(path)


@query("""SELECT source, count(*) AS n, 1::BIGINT AS files FROM documents GROUP BY source""")
def works_in_files(spark, sf):
    """A file for each source."""
    path = scratch(spark, "works")
    files.write_works(table(spark, sf, "documents").select("doc_id", "source"), path, "source")
    back = spark.read.schema("doc_id long, source string").json(path).withColumn("f", F.input_file_name())
    return back.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("f").alias("files"))


@query("""SELECT doc_id, ((length(text) - length(replace(text, 'ing', ''))) // 3 + (length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'ou', ''))) // 2)::INT AS score FROM documents""")
def lexicon_file(spark, sf):
    """A word list written as lines, read back, and counted."""
    path = scratch(spark, "lexicon")
    files.write_lines(spark.createDataFrame([("ing",), (" the ",), ("",), ("ou",)], "w string").coalesce(1), "w", path)
    return table(spark, sf, "documents").select("doc_id", T.occurrences("text", files.read_lines(spark, f"{path}/*.txt")).alias("score"))


@query("""SELECT doc_id, quality AS a FROM labels""")
def cached_table(spark, sf):
    """A table kept under its parameters: made once, read the second time."""
    root = scratch(spark, "cache")
    make = lambda column: files.cached_by(table(spark, sf, "labels").select("doc_id", F.col(column).alias("a")), root, "labels", {"sf": sf, "n": 2})
    make("quality").count()
    return make("toxic")  # the parameters are the same, so what was made first comes back


@query("""SELECT doc_id, quality FROM labels""")
def batches_until_done(spark, sf):
    """Jobs in batches of 60 until a stop, and a second call that goes on."""
    left, path = iter([False, False, True]), scratch(spark, "batches")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    jobs.batches_until(labels, lambda d: d, path, ["doc_id"], 60, lambda: next(left))
    return jobs.batches_until(labels, lambda d: d, path, ["doc_id"], 4000, lambda: False)

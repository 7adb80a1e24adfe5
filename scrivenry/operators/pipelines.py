"""Whole jobs: dataset build, exports, training and context views, re-tagging, corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivenry.functions import meta, prompts
from scrivenry.functions import text as T
from scrivenry.operators import chunking, dedup, measures, reading, sampling
from scrivenry.operators.ranks import numbered
from scrivenry.sources.batches import small_batches
from scrivenry.sources.schemas import default_chunk_classification
from scrivenry.sources.scratch import stored


def build_dataset(novels: DataFrame, episodes: DataFrame, urls: DataFrame, target: int = 1536, most: int = 2048, overlap: int = 128, threshold: float = 0.9, val_share: float = 0.02, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(chunks, works): normalised, chunked and deduplicated episodes under the chunk schema, and the manifest.

    Works without episodes are in the manifest too.  One url row counts for each work.  Near-duplicates are
    looked for inside an episode; chunk_index keeps its gaps and chunk_count_in_episode counts before them.
    """
    spark = novels.sparkSession
    url = urls.where("ncode is not null").groupBy("ncode").agg(F.max("is_r18").alias("url_r18"))
    works = novels.withColumn("source_keywords", meta.source_keywords("main_tag", "sub_tag"))
    works = meta.normalise_keywords(works, "source_keywords", "keywords").join(url, "ncode", "left")
    works = works.withColumn("control_flags", meta.flags("keywords")).withColumn("rating_", meta.adult_rating(F.col("sub_site"), F.col("rating"), F.col("url_r18")))
    works = works.withColumn("control_tags", meta.control_tags(F.col("control_flags"))).withColumn("site", meta.site_name(F.col("site_type")))
    works = sampling.split(works, "ncode", val_share, seed)

    body = episodes.where(~T.is_blank("body")).withColumn("n", T.normalise_body("body"))
    body = body.select("ncode", T.lenient_int("episode_no").alias("episode_no"), F.col("e_title").alias("episode_title"), F.col("n.text").alias("text"), F.col("n.raw_sha256").alias("source_sha256")).where(~T.is_blank("text"))
    small_batches(spark)
    body = stored(body, "episodes")
    chunks = chunking.chunk_episodes(body, ["ncode", "episode_no"], "text", target, most, overlap)
    # Chunks and the answer are stored: the duplicates' count, the manifest and the chunks' readers take them from there.
    unique = stored(dedup.greedy_near_duplicates(stored(chunks, "chunks"), ["ncode", "episode_no"], "chunk_index", "text", threshold), "unique")
    dropped = unique.where("duplicate_of is not null").groupBy("ncode").agg(F.count("*").alias("dropped_duplicates"))
    kept = unique.where("duplicate_of is null").join(body.drop("text"), ["ncode", "episode_no"]).join(works, "ncode")
    content = default_chunk_classification()["content"]
    record = F.struct(
        "ncode", "title", "author", F.col("site").alias("site_type"), F.col("rating_.is_r18").alias("is_r18"), "episode_no", "episode_title", "chunk_index", "chunk_count_in_episode", "source_keywords",
        F.lit(None).cast("string").alias("api_genre"), F.lit(None).cast("string").alias("api_biggenre"), content.alias("content"), T.style_metrics("text", F.col("token_count")).alias("style_metrics"),
        F.struct(F.lit("rules").alias("method"), F.lit(None).cast("string").alias("model"), F.lit(1).alias("schema_version"), F.lit(0.0).alias("confidence")).alias("classification"), "source_sha256",
    )
    out = kept.select(chunking.chunk_id().alias("id"), "text", "control_tags", record.alias("meta"), "split")
    counts = kept.groupBy("ncode").agg(F.countDistinct("episode_no").alias("n_episodes"), F.count("*").alias("n_chunks"))
    manifest = works.join(counts, "ncode", "left").join(dropped, "ncode", "left").select(
        "ncode", "title", "author", F.col("site").alias("site_type"), F.col("rating_.is_r18").alias("is_r18"), F.col("rating_.source").alias("r18_source"), "source_keywords", "control_flags", "control_tags", "split",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_episodes", "n_chunks", "dropped_duplicates")],
    )
    return out, manifest


def corpus_stats(chunks: DataFrame, works: DataFrame) -> DataFrame:
    """One row of counts and distributions of a built corpus, counted from its rows."""
    pairs = lambda df, name: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias(name))
    by = lambda df, c: df.groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("n")).where("value is not null")
    m = F.col("meta")
    parts = [
        works.agg(F.count("*").alias("works"), F.count_if(F.col("n_chunks") == 0).alias("works_without_chunks"), F.count_if("is_r18").alias("works_r18"), F.coalesce(F.sum("dropped_duplicates"), F.lit(0)).alias("dropped_duplicates")),
        chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("split") == "val").alias("chunks_val"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum("meta.style_metrics.token_count"), F.lit(0)).alias("tokens")),
        pairs(by(chunks.select(F.explode("control_tags.genre").alias("g")), F.col("g")), "genre"), pairs(by(chunks, m["site_type"]), "site_type"), pairs(by(chunks, m["is_r18"]), "is_r18"),
        pairs(by(chunks, F.col("control_tags.viewpoint")), "viewpoint"), pairs(by(chunks, F.col("control_tags.protagonist_gender")), "protagonist_gender"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # each has one row
    return out


def export_works(episodes: DataFrame, least: int = 500) -> DataFrame:
    """(ncode, text): cleaned episodes in reading order; short works go."""
    cleaned = episodes.select("ncode", T.leading_int("episode_no").alias("o"), T.legacy_clean(F.coalesce("body", F.lit(""))).alias("t")).where("t <> ''")
    return reading.joined_text(cleaned, ["ncode"], ["o"], "t", "\n\n", least)


def retag(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """Chunks with the control tags of their work; works that aren't registered keep theirs."""
    new = tags.select(F.col("ncode").alias("__n"), F.col("control_tags").alias("__t"))
    joined = chunks.join(new, F.col("meta.ncode") == F.col("__n"), "left")
    return joined.select(*[F.coalesce("__t", "control_tags").alias(c) if c == "control_tags" else F.col(c) for c in chunks.columns])


def changed_elsewhere(before: DataFrame, after: DataFrame, key: str, column: str) -> int:
    """How many rows differ in anything but one column: compared with the source, not with themselves."""
    digest = lambda df, n: df.select(key, F.xxhash64(F.to_json(F.struct(*[c for c in df.columns if c != column]))).alias(n))
    return digest(before, "a").join(digest(after, "b"), key, "full").where("not (a <=> b)").count()


def training_view(chunks: DataFrame) -> tuple[DataFrame, int]:
    """((text, meta<ncode>), rows left out for want of a work id)."""
    ok = ~F.coalesce(F.col("meta.ncode"), F.lit("")).isin("", "unknown")
    view = chunks.where(ok).select(prompts.training_text(F.col("control_tags"), F.col("meta.is_r18"), F.col("text")).alias("text"), F.struct(F.col("meta.ncode").alias("ncode")).alias("meta"))
    return view, chunks.where(~ok).count()


def condition_counts(view: DataFrame, column: str = "text") -> DataFrame:
    return view.groupBy(F.substring_index(column, "\n", 1).alias("condition")).agg(F.count("*").alias("n"))


def context_view(chunks: DataFrame, terms: DataFrame, context_chars: int = 2400, continuation_chars: int = 2900, stride: int = 2) -> DataFrame:
    """(prompt, completion, meta<ncode, episode_no>): what was read so far, and what comes next, of every
    ``stride``-th chunk of a work.  Works are whole, however their files were cut."""
    flat = chunks.select(
        F.col("meta.ncode").alias("ncode"), F.col("meta.episode_no").alias("episode_no"), F.col("meta.chunk_index").alias("chunk_index"), F.col("meta.title").alias("title"), F.col("meta.episode_title").alias("episode_title"),
        F.col("meta.is_r18").alias("is_r18"), F.col("meta.style_metrics.dialogue_ratio").alias("dialogue"), F.col("meta.style_metrics.avg_sentence_length").alias("sentence"), "control_tags", "text",
    )
    edges = measures.tertiles(flat, "dialogue").toDF("d0", "d1").crossJoin(measures.tertiles(flat, "sentence").toDF("s0", "s1"))
    keys, order = ["ncode"], ["episode_no", "chunk_index"]
    read = reading.look_ahead(reading.look_back(flat, keys, order, "text", context_chars), keys, order, "text", 3, continuation_chars)
    read = reading.strided(read, keys, order, stride).where((F.length("continuation") >= 400) & (F.length("context") >= 200))
    read = read.join(terms.select("ncode", "terms"), "ncode", "left").crossJoin(F.broadcast(edges))
    tags = F.col("control_tags")
    fields = {n: tags[n] for n in ("viewpoint", "protagonist_gender", "setting", "genre")} | {
        "r18": F.when(F.coalesce("is_r18", F.lit(False)), "yes").otherwise("no"), "dialogue": T.bucket("dialogue", F.col("d0"), F.col("d1")),
        "sentence": T.bucket("sentence", F.col("s0"), F.col("s1"), ("short", "mid", "long")),
    }
    listed = F.coalesce("terms", F.array().cast("array<string>"))
    prompt = prompts.sample_prompt(fields, F.col("title"), T.informative_title("episode_title"), listed, F.col("context"))
    return read.select(prompt.alias("prompt"), F.col("continuation").alias("completion"), F.struct("ncode", "episode_no").alias("meta"))


def trainer_rows(view: DataFrame, tokens: Column, most: int, strict: bool = False) -> DataFrame:
    """Rows with a work id and at most ``most`` tokens; strict: a longer one is an error."""
    ok = view.where(~F.coalesce(F.col("meta.ncode"), F.lit("")).isin("", "unknown")).withColumn("n_tokens", tokens)
    if strict:
        return ok.withColumn("n_tokens", F.when(F.col("n_tokens") <= most, F.col("n_tokens")).otherwise(F.raise_error(F.concat(F.lit("too long: "), F.col("n_tokens").cast("string"))).cast("int")))
    return ok.where(F.col("n_tokens") <= most)


def leaking_works(train: DataFrame, val: DataFrame) -> DataFrame:
    """Works on both sides; a build with any is wrong."""
    side = lambda df: df.select(F.col("meta.ncode").alias("ncode"))
    return side(train).intersect(side(val))


def select_works(works: DataFrame, length: str, top: int, spread: int, pinned: list[str], key: str = "ncode") -> DataFrame:
    """The longest works, the pinned ones, and ``spread`` others at even places of the order by length."""
    order = [F.desc(length), F.col(key)]
    placed = numbered(works, order)
    first = placed.where((F.col("__r") < top) | F.col(key).isin(pinned))
    rest = placed.join(first.select(key), key, "left_anti")
    rest = numbered(rest.drop("__r"), order, "__i").crossJoin(F.broadcast(rest.agg(F.count("*").alias("__n"))))
    even = rest.where(F.array_contains(reading.even_places(F.col("__n"), F.lit(spread), "first"), F.col("__i").cast("long")))
    return first.select(*works.columns).unionByName(even.select(*works.columns))


def removable_layers(influence: DataFrame, layers: int, count: int, head: int = 2, tail: int = 2) -> DataFrame:
    """The ``count`` layers with the least influence, but for the first and last ones."""
    return influence.where(F.col("layer").between(head, layers - tail - 1)).orderBy("influence", "layer").limit(count)


def merged_axes(results: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """(key, content): results (key, axis, value, failed) of single questions as one struct; unasked axes are 0,
    and a key with any failed one is left null."""
    values = [F.coalesce(F.max(F.when(F.col("axis") == a, F.col("value"))), F.lit(0)).alias(a) for a in axes]
    one = results.groupBy(key).agg(F.bool_or("failed").alias("__f"), F.struct(*values).alias("__c"))
    return one.select(key, F.when(~F.col("__f"), F.col("__c")).alias("content"))


def verdict(value: Column, levels: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first level that a value reaches, from the highest down."""
    out = None
    for level, label in sorted(levels, reverse=True):
        out = F.when(value >= level, label) if out is None else out.when(value >= level, label)
    return out.otherwise(otherwise)


def tagger_verdicts(summary: DataFrame, axes: list[str]) -> DataFrame:
    """Rows (measure, value, verdict) of a tagger's summary: whether its answers vary, and whether each axis tells the
    two kinds of works apart."""
    said = [F.struct(F.lit("distinct_ratio").alias("measure"), F.col("distinct_ratio").alias("value"), verdict(F.col("distinct_ratio"), [(0.5, "ok")], "bad").alias("verdict"))]
    said += [F.struct(F.lit(f"{a}_auc").alias("measure"), F.col(f"{a}_auc").alias("value"), verdict(F.col(f"{a}_auc"), [(0.8, "ok"), (0.65, "weak")], "bad").alias("verdict")) for a in axes]
    return summary.select(F.explode(F.array(*said)).alias("x")).select("x.*").where("value is not null")


def trial_verdict(trial: DataFrame) -> DataFrame:
    """One row (real, none, foreign, verdict) of a trial's rates (condition, any_rate)."""
    one = trial.agg(*[F.coalesce(F.max(F.when(F.col("condition") == c, F.col("any_rate"))), F.lit(0.0)).alias(c) for c in ("real", "none", "foreign")])
    return one.withColumn("verdict", terms_verdict(F.col("real"), F.col("none"), F.col("foreign")))


def long_work_contexts(works: DataFrame, chunks: DataFrame, length: str, top: int, spread: int, pinned: list[str], order: list[str], method: str, chars: int, key: str = "ncode") -> DataFrame:
    """Segments of the longest, pinned and evenly spread works (see ``select_works``), by a method of sampling."""
    chosen = select_works(works, length, top, spread, pinned, key).select(key)
    return reading.segments(chunks.join(chosen, key, "left_semi"), [key], order, "text", method, chars)


def terms_verdict(real: Column, none: Column, foreign: Column) -> Column:
    """Whether naming terms works: more than half as often again as without them, and in a fifth of the cases."""
    return F.when((real == 0) & (none == 0) & (foreign == 0), "under_powered").when((real > 1.5 * none) & (real > 0.2), "effective").otherwise("no_effect")


def episodes_to_extract(chunks: DataFrame, longest: int, works: DataFrame | None = None) -> DataFrame:
    """Rows (ncode, episode_no, episode_title, text, n_chars, too_long): whole episodes from their chunks, overlaps
    and all.  Long ones are flagged, not cut.  chunks: ncode, episode_no, chunk_index, episode_title, text."""
    own = chunks if works is None else sampling.wanted(chunks, works, "ncode")
    joined = reading.joined_text(own, ["ncode", "episode_no"], ["chunk_index"], "text", "\n\n--- chunk boundary ---\n\n")
    titles = own.groupBy("ncode", "episode_no").agg(F.min_by("episode_title", "chunk_index").alias("episode_title"))
    return joined.join(titles, ["ncode", "episode_no"]).select("ncode", "episode_no", "episode_title", "text", F.length("text").alias("n_chars"), (F.length("text") > longest).alias("too_long"))


def in_length(df: DataFrame, text: str, least: int, most: int) -> DataFrame:
    """Rows whose text has a length in a range, the shortest first where order matters: adds n_chars."""
    return df.withColumn("n_chars", F.length(text)).where(F.col("n_chars").between(least, most))


def length_report(lengths: DataFrame, manifest: DataFrame, key: str, levels: list[int]) -> DataFrame:
    """One row on text lengths (key, n_chars): quantiles, how many are at the longest, shares up to each level, and
    works of the manifest that have no length."""
    most = lengths.agg(F.max("n_chars").alias("__most"))
    capped = lengths.crossJoin(F.broadcast(most)).agg(F.count("*").alias("n_works"), F.count_if(F.col("n_chars") >= F.col("__most")).alias("n_at_cap"))
    quantiles = measures.nearest_ranks(lengths, "n_chars", {f"p{int(q * 100)}": q for q in (0.1, 0.25, 0.5, 0.75, 0.9)}).drop("n")
    shares = lengths.agg(*[F.bround(100.0 * F.count_if(F.col("n_chars") <= t) / F.count("*"), 2).alias(f"pct_{t}") for t in levels])
    missing = sampling.keys_missing(manifest, lengths, key).agg(F.count("*").alias("missing_in_cache"))
    return capped.crossJoin(quantiles).crossJoin(shares).crossJoin(missing)  # each has one row


def summary_targets(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((ncode), (ncode, episode_no)): distinct works and episodes of samples with meta; those without either key go."""
    keys = samples.select(F.col("meta.ncode").alias("ncode"), F.col("meta.episode_no").alias("episode_no")).where("ncode is not null and episode_no is not null")
    return keys.select("ncode").distinct(), keys.distinct()


def summary_jobs(chunks: DataFrame, works: DataFrame, episodes: DataFrame, done: DataFrame | None = None, work_chars: int = 12000, recent_chars: int = 6000, parts: int = 12) -> DataFrame:
    """Rows (key, kind, ncode, episode_no, material) of the summaries to be made: of works from evenly skipped
    chunks, of episodes from the text strictly before them; those in ``done`` (key) are left out."""
    order = ["episode_no", "chunk_index"]
    own = chunks.join(works, "ncode", "left_semi")
    whole = reading.skipped_text(own, ["ncode"], order, "text", parts, "\n\n---\n\n", work_chars)
    whole = whole.select(F.concat(F.lit("work:"), "ncode").alias("key"), F.lit("work").alias("kind"), "ncode", F.lit(None).cast("int").alias("episode_no"), F.col("text").alias("material"))
    # Targets without chunks of their own take part as episodes without text, so that the window sees them.
    marks = episodes.select("ncode", F.col("episode_no").cast("int").alias("episode_no"))
    rows = own.select("ncode", F.col("episode_no").cast("int").alias("episode_no"), F.col("chunk_index").cast("int").alias("chunk_index"), "text")
    every = rows.unionByName(marks.withColumn("chunk_index", F.lit(-1)).withColumn("text", F.lit("")))
    before = reading.prior_text(every, ["ncode"], "episode_no", ["chunk_index"], "text", recent_chars).where("chunk_index = -1")
    recent = before.select(F.concat(F.lit("recent:"), "ncode", F.lit(":"), F.col("episode_no").cast("string")).alias("key"), F.lit("recent").alias("kind"), "ncode", "episode_no", F.col("prior").alias("material"))
    jobs = whole.unionByName(recent)
    return jobs if done is None else sampling.pending(jobs, done, ["key"])


def registered_tags(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """One row of a re-tagging: chunks, those whose work is registered, and works that aren't."""
    known = tags.select(F.col("ncode").alias("__n")).distinct()
    joined = chunks.select(F.col("meta.ncode").alias("ncode")).join(known, F.col("ncode") == F.col("__n"), "left")
    return joined.agg(F.count("*").alias("chunks"), F.count("__n").alias("retagged"), F.countDistinct(F.when(F.col("__n").isNull(), F.col("ncode"))).alias("works_not_registered"))

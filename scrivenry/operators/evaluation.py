"""How well models and extracted features do: taggers, declared tags, repeated runs, conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivenry.functions.text import is_refusal
from scrivenry.operators import measures, terms
from scrivenry.operators.features import ROLLED_UP, tag_predicates

# The fields whose agreement is measured, by kind.
SCALARS = [*ROLLED_UP, "protagonist_count"]
CONTENTS = ["sexual_content", "violence_content"]
SETS = ["main_relationships", "story_shape"]
AXES = ["sexual_content", "violence", "gore"]


def _one_row(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(b), parts)  # each has one row


def tagger_summary(records: DataFrame, axes: list[str] | None = None) -> DataFrame:
    """One row on a model's records (ok boolean, is_r18, content struct or null, raw, elapsed): schema adherence,
    refusals among failures, latency, how varied the answers are, and for each axis how it tells the groups apart."""
    axes = axes or AXES
    n = F.col("__n")
    base = records.agg(F.count("*").alias("n"), F.count_if("ok").alias("schema_ok"), F.bround(F.avg(F.col("ok").cast("int")), 3).alias("schema_ok_rate"), F.count_if(~F.col("ok") & is_refusal("raw")).alias("refusal_n"))
    late = F.when(n > 1, F.floor(n * 0.9) - 1).otherwise(0)
    latency = measures.at_index(records, "elapsed", {"latency_median": F.floor(n / 2), "latency_p90": late})
    good = records.where("ok and content is not null").select("is_r18", *[F.col(f"content.{a}").alias(a) for a in axes])
    variety = measures.modal_share(good.where(" and ".join(f"{a} is not null" for a in axes)), *axes)
    parts = [base, latency, variety]
    for a in axes:
        own = good.where(f"{a} is not null").select(F.col("is_r18").cast("int").alias("y"), F.col(a).alias("x"))
        means = own.agg(*[F.bround(F.avg(F.when(F.col("y") == v, F.col("x"))), 2).alias(f"{a}_mean_{g}") for v, g in ((1, "r18"), (0, "general"))])
        parts += [means, measures.auc(own, "y", "x").select(F.bround("auc", 3).alias(f"{a}_auc"))]
    return _one_row(parts)


def gold_agreement(records: DataFrame, gold: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """Rows (axis, n, exact, within1, mae) of integer axes; a key or axis that one side lacks isn't counted."""
    pairs = records.select(key, *[F.col(a).alias(f"__p_{a}") for a in axes]).join(gold.select(key, *[F.col(a).alias(f"__g_{a}") for a in axes]), key)
    every = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"__g_{a}").alias("g"), F.col(f"__p_{a}").alias("p")) for a in axes])
    rows = pairs.select(F.explode(every).alias("x")).select("x.*").where("g is not null and p is not null")
    off = F.abs(F.col("g") - F.col("p"))
    return rows.groupBy("axis").agg(F.count("*").alias("n"), F.bround(F.avg((off == 0).cast("int")), 3).alias("exact"), F.bround(F.avg((off <= 1).cast("int")), 3).alias("within1"), F.bround(F.avg(off), 2).alias("mae"))


def declared_agreement(features: DataFrame, manifest: DataFrame, key: str = "ncode") -> DataFrame:
    """Rows (tag, declared_pos, tp, fp, fn, tn, recall, precision): what extracted features say about each declared
    tag.  features: key, ok, features; manifest: key, control_flags map.  Works that the manifest lacks declare
    nothing; failed extractions aren't counted."""
    flags = manifest.select(key, "control_flags")
    both = features.where("ok").join(flags, key, "left")
    says = tag_predicates(F.col("features"))
    pairs = {tag: (F.try_element_at("control_flags", F.lit(tag)), guess) for tag, guess in says.items()}
    return measures.confusion(both, pairs).select("tag", (F.col("tp") + F.col("fn")).alias("declared_pos"), "tp", "fp", "fn", "tn", "recall", "precision")


def field_agreement(field: str, a: Column, b: Column) -> Column:
    """1 where two records agree in a field, 0 where not; of sets the share of common members."""
    if field in CONTENTS:
        same = a[field]["present"].eqNullSafe(b[field]["present"]) & a[field]["explicitness"].eqNullSafe(b[field]["explicitness"])
        return same.cast("double")
    if field in SETS:
        of = lambda f: F.array_distinct(F.coalesce(F.transform(f[field], lambda r: r["kind"]) if field == "main_relationships" else f[field], F.array().cast("array<string>")))
        union = F.size(F.array_union(of(a), of(b)))
        return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(of(a), of(b))) / union)
    if field == "setting_era":  # free text
        plain = lambda f: F.lower(F.trim(F.coalesce(f[field], F.lit(""))))
        return (plain(a) == plain(b)).cast("double")
    return a[field].eqNullSafe(b[field]).cast("double")


def _agreements(pairs: DataFrame, keys: list[str], a: str, b: str, fields: list[str]) -> DataFrame:
    """Rows (keys, field, score)."""
    scores = F.array(*[F.struct(F.lit(f).alias("field"), field_agreement(f, F.col(a), F.col(b)).alias("score")) for f in fields])
    return pairs.select(*keys, F.explode(scores).alias("s")).select(*keys, "s.*")


def _repeated(runs: DataFrame) -> DataFrame:
    first, second = (runs.where(F.col("run_index") == i).select("ncode", "method", F.col("features").alias(f"__f{i}"), F.coalesce("seconds", F.lit(0.0)).alias(f"__s{i}"), F.col("n_chars").alias(f"__n{i}")) for i in (0, 1))
    return first.join(second, ["ncode", "method"])


def field_stability(runs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Rows (method, field, n, rate): how often the first two runs of a work agree in each field."""
    scores = _agreements(_repeated(runs), ["ncode", "method"], "__f0", "__f1", fields or [*SCALARS, *CONTENTS, *SETS])
    return scores.groupBy("method", "field").agg(F.count("*").alias("n"), F.bround(F.avg("score"), 4).alias("rate"))


def feature_texts(features: DataFrame, manifest: DataFrame, texts: DataFrame, key: str = "ncode") -> DataFrame:
    """Works with features that could be read (ok), a manifest row and a text, all columns of the three; others go.
    features: key, ok, ...; texts: key, text."""
    return features.where("ok").drop("ok").join(manifest, key).join(texts.where("text is not null"), key)


def stability(runs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Rows (method, n_works, n_fields_always_stable, mean_stability, mean_confidence, mean_seconds, mean_chars,
    n_works_fully_stable, conf_when_fully_stable, conf_when_unstable) of the first two runs of each work.

    runs: ncode, method, run_index, features, seconds, n_chars.  An empty side's mean confidence is 0.
    """
    fields = fields or [*SCALARS, *CONTENTS, *SETS]
    pairs = _repeated(runs)
    scores = _agreements(pairs, ["ncode", "method"], "__f0", "__f1", fields)
    by_field = scores.groupBy("method", "field").agg(F.avg("score").alias("rate")).groupBy("method").agg(F.count_if(F.col("rate") == 1).alias("n_fields_always_stable"), F.bround(F.avg("rate"), 4).alias("mean_stability"))
    by_work = scores.groupBy("ncode", "method").agg(F.min("score").alias("__least"))
    confidence = (F.coalesce(F.col("__f0.confidence"), F.lit(0.0)) + F.coalesce(F.col("__f1.confidence"), F.lit(0.0))) / 2
    work = pairs.select("ncode", "method", confidence.alias("c"), ((F.col("__s0") + F.col("__s1")) / 2).alias("s"), F.col("__n0").alias("n")).join(by_work, ["ncode", "method"])
    stable = F.col("__least") == 1
    side = lambda on: F.bround(F.coalesce(F.sum(F.when(on, F.col("c"))), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if(on)), 4)
    sums = work.groupBy("method").agg(
        F.count("*").alias("n_works"), F.bround(F.avg("c"), 4).alias("mean_confidence"), F.bround(F.avg("s"), 1).alias("mean_seconds"), F.bround(F.avg("n")).cast("long").alias("mean_chars"),
        F.count_if(stable).alias("n_works_fully_stable"), side(stable).alias("conf_when_fully_stable"), side(~stable).alias("conf_when_unstable"),
    )
    return sums.join(by_field, "method")


def cross_method(runs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Rows (m1, m2, field, n, agreement): first runs of two methods on the works that both have."""
    fields = fields or [*SCALARS, *CONTENTS, *SETS]
    first = runs.where("run_index = 0")
    a, b = (first.select("ncode", F.col("method").alias(m), F.col("features").alias(f)) for m, f in (("m1", "__a"), ("m2", "__b")))
    scores = _agreements(a.join(b, "ncode").where("m1 < m2"), ["m1", "m2"], "__a", "__b", fields)
    return scores.groupBy("m1", "m2", "field").agg(F.count("*").alias("n"), F.bround(F.avg("score"), 4).alias("agreement"))


def manual_agreement(runs: DataFrame, manual: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Rows (method, field, n, agreement) of first runs with labels (ncode, features) made by hand; fields that were
    left blank aren't counted."""
    fields = fields or [*SCALARS, *CONTENTS, *SETS]
    pairs = runs.where("run_index = 0").select("ncode", "method", F.col("features").alias("__a")).join(manual.select("ncode", F.col("features").alias("__b")), "ncode")
    b = F.col("__b")
    blank = {f: F.coalesce(F.size(b[f]), F.lit(0)) <= 0 if f in SETS else b[f].isNull() if f in CONTENTS else F.coalesce(b[f].cast("string"), F.lit("")) == "" for f in fields}
    scores = F.array_compact(F.array(*[F.when(~blank[f], F.struct(F.lit(f).alias("field"), field_agreement(f, F.col("__a"), b).alias("score"))) for f in fields]))
    rows = pairs.select("method", F.explode(scores).alias("s")).select("method", "s.*")
    return rows.groupBy("method", "field").agg(F.count("*").alias("n"), F.bround(F.avg("score"), 4).alias("agreement"))


def conditioning_gap(df: DataFrame, condition: str, text: str, first: str = "first_person", third: str = "third_person", pronouns: list[str] | None = None) -> DataFrame:
    """One row (mean, median, least and most of each condition's pronoun rates, gap, verdict): whether texts written
    under a condition follow it."""
    rate = df.select(condition, terms.pronoun_rate(F.col(text), pronouns).alias("r"))
    of = lambda c, name: [f(F.when(F.col(condition) == c, F.col("r"))).alias(f"{name}_{n}") for n, f in (("mean", F.avg), ("median", F.median), ("least", F.min), ("most", F.max))]
    one = rate.agg(*of(first, "first"), *of(third, "third"))
    gap = F.col("first_mean") - F.col("third_mean")
    verdict = F.when(gap > 1.0, "follows").when(gap > 0.3, "weak").otherwise("no_effect")
    rounded = [F.bround(c, 6).alias(c) for c in one.columns]
    return one.select(*rounded, F.bround(gap, 6).alias("gap"), verdict.alias("verdict"))


def terms_trial(df: DataFrame, condition: str, hits: str) -> DataFrame:
    """Rows (condition, n, mean, median, any_rate) of how many of its own terms, that its context lacks, a text has."""
    n = F.size(hits)
    return df.groupBy(F.col(condition).alias("condition")).agg(F.count("*").alias("n"), F.bround(F.avg(n), 6).alias("mean"), F.bround(F.median(n), 6).alias("median"), F.bround(F.avg((n > 0).cast("int")), 6).alias("any_rate"))


def lift(df: DataFrame, on: str, value: str) -> DataFrame:
    """One row (with_mean, without_mean, lift): of a number where a flag is set and where it isn't."""
    one = df.agg(F.avg(F.when(F.col(on), F.col(value))).alias("a"), F.avg(F.when(~F.col(on), F.col(value))).alias("b"))
    return one.select(F.bround("a", 6).alias("with_mean"), F.bround("b", 6).alias("without_mean"), F.bround(F.col("a") - F.col("b"), 6).alias("lift"))


def tag_frequency(works: DataFrame, tags: Column, least: int) -> DataFrame:
    """Rows (value, n): tags by how many works have them, rare ones left out."""
    return measures.frequent(works.select(F.explode(F.array_distinct(tags)).alias("__tag")), F.col("__tag"), least).orderBy(F.desc("n"), "value")


def either_tags(silver: Column, raw: Column) -> Column:
    """Tags from flags and from keywords together."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(silver, none), F.coalesce(raw, none))

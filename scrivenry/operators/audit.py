"""Audit of a corpus: duplicate keys, orphans, counts that differ from what is declared, faults of bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivenry.functions.text import encoding_faults, is_empty_ascii, markup_ratio, without_tags
from scrivenry.sources import files

# The tables an audit needs, and their columns.
REQUIRED = {
    "novels_descs": ["ncode", "title", "author", "Synopsis", "main_tag", "sub_tag", "rating", "total_ep", "general_all_no", "site_type", "sub_site", "noveltype", "length", "updated_at", "last_update_date"],
    "episodes": ["ncode", "episode_no", "body", "e_title", "update_time"],
    "url_entity": ["ncode", "api_url", "url", "is_r18"],
    "episode_mapping": ["ncode", "episode_no", "kakuyomu_episode_id"],
}
LEAST_TEXT_SHARE = 0.10


def missing_schema(tables: dict[str, DataFrame], required: dict[str, list[str]] | None = None) -> tuple[list[str], dict[str, list[str]]]:
    """(missing tables, missing columns of the others)."""
    required = required or REQUIRED
    absent = [t for t in required if t not in tables]
    columns = {t: sorted(set(own) - set(tables[t].columns)) for t, own in required.items() if t in tables}
    return absent, {t: c for t, c in columns.items() if c}


def duplicate_keys(df: DataFrame, *keys: str) -> Column | DataFrame:
    """One row: n, n_duplicate.  A key with a null part isn't counted among the distinct ones."""
    key = F.concat(*[x for i, k in enumerate(keys) for x in ([F.lit("\x1f")] if i else []) + [F.col(k).cast("string")]])
    return df.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct(key)).alias("n_duplicate"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``children`` without a parent; a null key has none."""
    return children.join(parents.select(key), key, "left_anti").select(key).distinct()


def count_mismatches(parents: DataFrame, children: DataFrame, key: str, declared: list[str]) -> DataFrame:
    """One row: parents without children, and for each declared column those whose count differs (null differs)."""
    found = children.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    joined = parents.join(found, key, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    sums = [F.count_if(~F.col("__n").eqNullSafe(F.col(d).cast("long"))).alias(f"mismatch_{d}") for d in declared]
    return joined.agg(F.count_if(F.col("__n") == 0).alias("n_without"), *sums)


def breakdown(df: DataFrame, column: str) -> DataFrame:
    """Rows for each value, null shown as None."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("n"))


def adult_sources(works: DataFrame, urls: DataFrame) -> DataFrame:
    """One row: works that each source of the adult rating decides, under SQL's logic of nulls."""
    n = works.join(urls, "ncode", "left")
    site, rating, url = F.col("sub_site"), F.col("rating"), F.col("is_r18")
    total = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return n.agg(total(site == 2).alias("sub_site_eq_2"), total((site != 2) & (rating == 1)).alias("rating_eq_1"), total((site != 2) & (rating != 1) & (url == 1)).alias("url_entity_is_r18"))


def body_faults(episodes: DataFrame, least_share: float = LEAST_TEXT_SHARE) -> DataFrame:
    """Rows (reason, ncode, episode_no, detail, raw_len, stripped_len, ratio) of bodies with faults."""
    base = episodes.select("ncode", F.col("episode_no").cast("string").alias("episode_no"), "body")
    empty = base.where(is_empty_ascii("body")).select(F.lit("empty_body").alias("reason"), "ncode", "episode_no")
    faults = base.withColumn("detail", encoding_faults("body")).where(F.size("detail") > 0).select(F.lit("encoding_anomaly").alias("reason"), "ncode", "episode_no", "detail")
    share = F.length(without_tags("body")) / F.length("body")
    thin = base.where((F.length("body") >= 200) & (share < least_share)).select(
        F.lit("html_ratio_anomaly").alias("reason"), "ncode", "episode_no", F.length("body").alias("raw_len"), F.length(without_tags("body")).alias("stripped_len"), markup_ratio("body").alias("ratio")
    )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [empty, faults, thin])


def raw_faults(spark: SparkSession, path: str) -> DataFrame:
    """Rows (reason, file, line, detail) of lines that hold half of a surrogate pair: Spark's strings keep a file's
    bytes, in which alone it can be seen."""
    lines = files.with_position(spark.read.text(path)).where(files.surrogate_faults(F.col("value").cast("binary")))
    return lines.select(F.lit("encoding_anomaly").alias("reason"), F.col("__file").alias("file"), F.col("__pos").alias("line"), F.array(F.lit("unpaired_surrogate")).alias("detail"))


def rejected(novels: DataFrame, episodes: DataFrame) -> DataFrame:
    """All rejected rows: orphans and faulty bodies, under one nullable schema."""
    lone = orphans(episodes, novels, "ncode").select(F.lit("orphan_episode").alias("reason"), "ncode")
    return lone.unionByName(body_faults(episodes), allowMissingColumns=True)


def report(novels: DataFrame, episodes: DataFrame, urls: DataFrame) -> DataFrame:
    """The whole audit as one row; the orphans are counted here and listed by ``rejected``."""
    pairs = lambda: F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n"))))
    parts = [
        duplicate_keys(novels, "ncode").toDF("novels_total", "novels_duplicate_ncode"), duplicate_keys(episodes, "ncode", "episode_no").toDF("episodes_total", "episodes_duplicate_key"),
        count_mismatches(novels, episodes, "ncode", ["general_all_no", "total_ep"]), adult_sources(novels, urls),
        breakdown(novels, "site_type").agg(pairs().alias("site_type_breakdown")), breakdown(novels, "sub_site").agg(pairs().alias("sub_site_breakdown")),
        orphans(episodes, novels, "ncode").agg(F.count("ncode").alias("n_orphan_episode_ncodes")),
        body_faults(episodes).agg(*[F.count_if(F.col("reason") == r).alias(n) for r, n in (("empty_body", "empty_body_episode_count"), ("encoding_anomaly", "encoding_anomaly_episode_count"), ("html_ratio_anomaly", "html_ratio_anomaly_episode_count"))]),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # each has one row


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key; of equal ones the greatest by the other columns.  One aggregation."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(order, row)).alias("__row")).select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])

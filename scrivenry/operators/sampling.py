"""Reproducible samples: order by a hash of seed and id takes the place of every shuffle."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.operators.ranks import draw, drawn, first_drawn, numbered
from scrivenry.operators.reading import even_places
from scrivenry.sources.scratch import stored


def _ranked(df: DataFrame, by: list[str], seed: int, key: str, out: str = "__r") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(draw(seed, key), key)))


def cap_per_group(df: DataFrame, group: str, most: int, seed: int, key: str) -> DataFrame:
    """At most ``most`` rows of each group.  Spark plans this as a group limit before the exchange."""
    return _ranked(df, [group], seed, key).where(F.col("__r") <= most).drop("__r")


def genre_maximum(df: DataFrame, genres: str, limits: dict[str, int], seed: int, key: str) -> DataFrame:
    """A row goes if it is beyond the maximum of any of its genres.  ``genres`` is an array column."""
    listed = df.select(key, F.explode(F.array_distinct(F.col(genres))).alias("__g")).where(F.col("__g").isin(list(limits)))
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("__g")]
    over = drawn(listed, ["__g"], seed, key).where(F.col("__r") > limit).select(key).distinct()
    return df.join(over, key, "left_anti")


def genre_shortage(df: DataFrame, genres: str, least: dict[str, int]) -> DataFrame:
    """Genres with fewer rows than their minimum: (genre, n, minimum); nothing is dropped for these."""
    wanted = df.sparkSession.createDataFrame(list(least.items()), "genre string, minimum long")
    found = df.select(F.explode(F.array_distinct(F.col(genres))).alias("genre")).groupBy("genre").agg(F.count("*").alias("n"))
    return wanted.join(found, "genre", "left").select("genre", F.coalesce("n", F.lit(0)).alias("n"), "minimum").where("n < minimum")


def author_share(df: DataFrame, author: str, share: float, seed: int, key: str) -> DataFrame:
    """No author has more than int(rows * share) rows."""
    if not 0 < share <= 1:
        raise ValueError(f"share must be in (0, 1], got {share}")
    total = df.agg(F.floor(F.count("*") * F.lit(share)).alias("__most"))
    return first_drawn(df, [author], seed, key, total.withColumnRenamed("__most", "__limit"), F.col("__limit"))


def label_ratio(df: DataFrame, label: str, ratio: float, seed: int, key: str) -> DataFrame:
    """Rows with a true label are ``ratio`` of all, by leaving rows out; fewer rows in all where they are rare."""
    if not 0 <= ratio <= 1:
        raise ValueError(f"ratio must be in [0, 1], got {ratio}")
    flag = F.coalesce(F.col(label).cast("boolean"), F.lit(False))
    counts = df.agg(F.count("*").alias("n"), F.count_if(flag).alias("p"))
    chosen = F.least(F.bround(F.col("n") * ratio).cast("long"), F.col("p"))
    total = F.least(F.when(F.col("__p") > 0, F.bround(F.col("__p") / ratio).cast("long")).otherwise(0) if ratio > 0 else F.col("n") - F.col("p"), F.col("n"))
    targets = counts.withColumn("__p", chosen).withColumn("__q", F.least(total - F.col("__p"), F.col("n") - F.col("p"))).select("__p", "__q")
    own = F.when(F.col("__flag"), F.col("__p")).otherwise(F.col("__q"))
    return first_drawn(df.withColumn("__flag", flag), ["__flag"], seed, key, targets, own).drop("__flag")


@dataclass(frozen=True)
class Sampling:
    seed: int
    max_per_work: int | None = None
    genre_max: dict[str, int] | None = None
    max_author_share: float | None = None
    r18_ratio: float | None = None
    length_strata: dict | None = None


def stratified(df: DataFrame, config: Sampling, work: str = "ncode", genres: str = "genre", author: str = "author", label: str = "is_r18", key: str = "id") -> tuple[DataFrame, dict[str, int]]:
    """Cap per work, genre maximum, author share, label ratio, in this order; rows in drawn order, and how many
    each step dropped."""
    if config.length_strata is not None:
        raise ValueError("length_strata is declared but has no meaning; leave it out")
    steps = [
        ("max_per_work", config.max_per_work, lambda d: cap_per_group(d, work, config.max_per_work, config.seed, key)),
        ("genre_max", config.genre_max, lambda d: genre_maximum(d, genres, config.genre_max, config.seed, key)),
        ("max_author_share", config.max_author_share, lambda d: author_share(d, author, config.max_author_share, config.seed, key)),
        ("r18_ratio", config.r18_ratio, lambda d: label_ratio(d, label, config.r18_ratio, config.seed, key)),
    ]
    n = df.count()
    dropped = {"total_input": n}
    for name, on, step in steps:
        if on is not None:
            df = stored(step(df), name)  # each step's counts need its rows
            left = df.count()
            dropped[name], n = n - left, left
    return df.orderBy(draw(config.seed, key)), dropped | {"total_selected": n}


def split(df: DataFrame, group: str, share: float, seed: int, out: str = "split") -> DataFrame:
    """Adds train or val by a hash of the group: stable when groups come and go."""
    level = F.conv(F.substring(draw(seed, group), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn(out, F.when(level < share, "val").otherwise("train"))


def leaked(df: DataFrame, group: str, column: str = "split") -> DataFrame:
    """Groups that occur on both sides of a split."""
    side = lambda s: df.where(F.col(column) == s).select(group)
    return side("train").intersect(side("val"))


def quotas(capacity: dict[str, int], target: int) -> dict[str, int]:
    """Water-filling: the highest level that groups, each filled to its capacity at most, can share within
    ``target``; what is left over raises the first groups by name that have room by one."""
    filled = lambda level: sum(min(n, level) for n in capacity.values())
    level = bisect_right(range(1, max(capacity.values(), default=0) + 1), target, key=filled)
    quota = {c: min(n, level) for c, n in capacity.items()}
    room = sorted(c for c, n in capacity.items() if n > level)
    return quota | {c: level + 1 for c in room[: max(0, target - filled(level))]}


def balanced_subset(df: DataFrame, condition: str, work: str, order: list[str], target: int, max_per_work: int) -> DataFrame:
    """``target`` rows: conditions as equal as their capacity lets them be, works in turn inside a condition,
    even places inside a work.

    Only conditions and their capacity (a few hundred rows) come to the driver, for the quotas.
    """
    spark = df.sparkSession
    works = df.groupBy(condition, work).agg(F.count("*").alias("__n"))
    room = F.least("__n", F.lit(max_per_work))
    capacity = {r[0]: r[1] for r in works.groupBy(condition).agg(F.sum(room).alias("c")).collect()}
    quota = spark.createDataFrame([(c, q) for c, q in quotas(capacity, target).items() if q > 0], f"`{condition}` string, __quota long")
    # The k-th row of a work comes in the k-th turn; turns go through the works by name.
    turns = works.join(F.broadcast(quota), condition).select(condition, work, "__n", "__quota", F.explode(F.sequence(F.lit(1), room.cast("int"))).alias("__turn"))
    taken = numbered(turns, ["__turn", work], "__r", [condition]).where("__r < __quota")
    count = taken.groupBy(condition, work).agg(F.count("*").alias("__take"))
    placed = numbered(df, order, "__i", [condition, work])
    joined = placed.join(count.join(works, [condition, work]), [condition, work])
    return joined.where(F.array_contains(even_places(F.col("__n"), F.col("__take")), F.col("__i").cast("long"))).drop("__i", "__n", "__take")


def job_shard(df: DataFrame, order: list[str], shard: int, shards: int) -> DataFrame:
    """Every ``shards``-th row of the ordered jobs; jobs are keys, not texts."""
    return numbered(df, order).where(F.col("__r") % shards == shard).drop("__r")


def pending(df: DataFrame, done: DataFrame, keys: list[str], ok: str | None = None) -> DataFrame:
    """Rows whose keys aren't done, null among them; with ``ok`` failed ones are taken again."""
    finished = (done.where(F.col(ok)) if ok else done).select(*[F.col(k).alias(f"__done{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__done{i}"))
    return df.join(finished, same, "left_anti")


def positives_and_controls(df: DataFrame, positive: Column, each: int, seed: int, key: str) -> DataFrame:
    """``each`` rows with and without a property, drawn from both."""
    ranked = _ranked(df.withColumn("positive", F.coalesce(positive, F.lit(False))), ["positive"], seed, key)  # a group limit before the exchange
    return ranked.where(F.col("__r") <= each).drop("__r")


def valid_works(df: DataFrame, work: Column, invalid: tuple[str, ...] = ("", "unknown")) -> DataFrame:
    """Rows with a work id."""
    return df.where(~F.coalesce(work, F.lit("")).isin(*invalid))


def first_by(df: DataFrame, order: list[str], most: int) -> DataFrame:
    return df.orderBy(*order).limit(most)


def keys_in_any(key: str, *tables: DataFrame) -> DataFrame:
    """Distinct keys of all tables."""
    every = tables[0].select(key)
    for t in tables[1:]:
        every = every.union(t.select(key))
    return every.distinct()


def keys_missing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` hasn't."""
    return df.select(key).distinct().join(other.select(key), key, "left_anti")


def wanted(df: DataFrame, ids: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Rows of the wanted keys.  strict: a wanted key without rows is an error that names some."""
    if strict and (absent := keys_missing(ids, df, key).orderBy(key).limit(5).collect()):
        raise ValueError(f"no rows for {key}: {', '.join(str(r[0]) for r in absent)}")
    return df.join(ids.select(key).distinct(), key, "left_semi")


def repeated_jobs(items: DataFrame, keys: list[str], repeats: int, done: DataFrame | None = None) -> DataFrame:
    """Each item ``repeats`` times with its run_index, but for those that are done."""
    jobs = items.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("run_index")) if repeats > 0 else items.select(*keys, F.lit(0).alias("run_index")).limit(0)
    return jobs if done is None else pending(jobs, done, [*keys, "run_index"])


def unseen_works(df: DataFrame, seen: DataFrame, work: str, terms: str, least: int, order: list[str], most: int, seed: int) -> DataFrame:
    """One row, the first by ``order``, of each work that wasn't seen and has enough terms; ``most`` drawn works."""
    pool = df.where(F.coalesce(F.size(terms), F.lit(0)) >= least).join(seen.select(work).distinct(), work, "left_anti")
    one = pool.groupBy(work).agg(F.min_by(F.struct(*pool.columns), F.struct(*order)).alias("__first")).select("__first.*")
    return one.orderBy(draw(seed, work), work).limit(most)

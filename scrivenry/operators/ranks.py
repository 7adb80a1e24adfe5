"""Order numbers and running sums over all rows without one ordered stretch: rows are cut into buckets that keep
the order, buckets are counted, and what stands before a bucket is added to what is numbered inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.sources.scratch import stored

#: Bits of a hash that choose a bucket, and stretches of equal numbers of values.
HASH_BITS, STRETCHES = 12, 200


def draw(seed: int, key: str) -> Column:
    """The order in which rows are drawn; the same on any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def drawn(df: DataFrame, by: list[str], seed: int, key: str, out: str = "__r") -> DataFrame:
    """Adds ``out``, the place from 1 of each row among those with equal ``by``, in drawn order and then by key.

    A drawn value is uniform, so its first bits cut any group, however few groups there are, into even buckets;
    only their counts, a row for each group and bucket, are ordered by group.
    """
    bucket = F.conv(F.substring(draw(seed, key), 1, HASH_BITS // 4), 16, 10).cast("int")
    df = df.withColumn("__d", draw(seed, key)).withColumn("__bucket", bucket)
    counts = df.groupBy(*by, "__bucket").agg(F.count("*").alias("__c"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(order), F.lit(0))).select(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col("__bucket").alias("__own"), "__before")
    same = F.col("__bucket") == F.col("__own")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__by{i}"))
    inside = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__d", key))
    numbered = df.withColumn("__inside", inside).join(before, same)
    return numbered.withColumn(out, F.col("__inside") + F.col("__before")).drop("__d", "__bucket", "__own", "__before", "__inside", *[f"__by{i}" for i in range(len(by))])


def first_drawn(df: DataFrame, by: list[str], seed: int, key: str, limits: DataFrame, most: Column) -> DataFrame:
    """The first ``most`` rows, in drawn order and then by key, of each group of equal ``by``.

    limits: one row of numbers for ``most``, which may read them and ``by``.  Buckets of the drawn value are counted;
    those before the one that the limit cuts stay whole and those after it go, so only the rows of one bucket of
    each group that loses any are moved and ordered.  Such groups have more than ``most`` rows each, and are sent to
    all tasks: callers' limits are shares of all rows, which bounds their number.
    """
    bucket = F.conv(F.substring(draw(seed, key), 1, HASH_BITS // 4), 16, 10).cast("int")
    counts = df.groupBy(*by, bucket.alias("__bucket")).agg(F.count("*").alias("__c"))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("__before", F.coalesce(F.sum("__c").over(earlier), F.lit(0))).crossJoin(F.broadcast(limits)).withColumn("__most", most)
    whole = F.col("__before") + F.col("__c") <= F.col("__most")
    partly = ~whole & (F.col("__before") < F.col("__most"))
    cuts = placed.groupBy(*by).agg(
        F.coalesce(F.max(F.when(whole, F.col("__bucket"))), F.lit(-1)).alias("__whole"), F.max(F.when(partly, F.col("__bucket"))).alias("__part"),
        F.max(F.when(partly, F.col("__most") - F.col("__before"))).alias("__room"), F.bool_and(whole).alias("__all"),
    ).where("not __all")
    cuts = F.broadcast(cuts.select("__whole", "__part", "__room", *[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)]))
    same = F.lit(True)
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__by{i}"))
    joined = df.withColumn("__bucket", bucket).join(cuts, same, "left")
    kept = joined.where("__whole is null or __bucket <= __whole").select(*df.columns)
    inside = Window.partitionBy(*by, "__bucket").orderBy("__d", key)
    cut = joined.where("__bucket = __part").withColumn("__d", draw(seed, key)).withColumn("__r", F.row_number().over(inside))
    return kept.unionByName(cut.where("__r <= __room").select(*df.columns))


def running(df: DataFrame, value: str, sums: dict[str, str], descending: bool = False, by: list[str] = ()) -> DataFrame:
    """Adds for each out: column the sum of the column over rows up to and with this one in the order of a number
    (rows of equal value together), null and all, among rows with equal ``by``.  The stretches come from approximate
    quantiles, which decide how rows are dealt and nothing else."""
    by = list(by)
    cuts = df.agg(F.percentile_approx(value, [i / STRETCHES for i in range(1, STRETCHES)], 10 * STRETCHES).alias("__cuts"))
    above = F.aggregate("__cuts", F.lit(0), lambda a, c: a + F.when(F.col(value) >= c, 1).otherwise(0))
    dealt = df.crossJoin(F.broadcast(cuts)).withColumn("__s", F.coalesce(above, F.lit(0))).drop("__cuts")
    totals = dealt.groupBy(*by, "__s").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])  # a row for each stretch
    order = Window.partitionBy(*by).orderBy(F.col("__s").desc() if descending else F.col("__s")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("__s").alias("__k"), *[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], *[F.coalesce(F.sum(f"__t{i}").over(order), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))])
    inside = Window.partitionBy(*by, "__s").orderBy(F.col(value).desc() if descending else F.col(value))
    same = F.col("__s") == F.col("__k")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__by{i}"))
    joined = dealt.join(before if by else F.broadcast(before), same)
    return joined.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"__b{i}")).alias(o) for i, (o, c) in enumerate(sums.items())])


def numbered(df: DataFrame, order: list[Column | str], out: str = "__r", by: list[str] = ()) -> DataFrame:
    """Adds ``out``, the place from 0 of each row in an order of several columns; with ``by``, which the order then
    begins with, the place among rows with equal ``by``.

    Rows are dealt by ranges of the order and stored, each with its place in its range; the ranges are counted, and
    what stands before a range is added.  A number for each range comes to the driver, and nothing is ordered in one
    task, not even one group's rows.
    """
    order = [*by, *order]
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a row is that of its partition, shifted, and its place there.
    placed = stored(sorted_.withColumn("__m", F.monotonically_increasing_id()), "order")
    part = F.shiftright("__m", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    begin, at = [], 0
    for p in sorted(sizes):
        begin.append((p, at))
        at += sizes[p]
    first = df.sparkSession.createDataFrame(begin, "__p long, __first long")
    found = placed.withColumn("__own", part).join(F.broadcast(first), F.col("__own") == F.col("__p"))
    found = found.withColumn(out, F.col("__first") + F.col("__m").bitwiseAND((1 << 33) - 1)).select(*df.columns, out)
    if not by:
        return found
    start = found.groupBy(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)]).agg(F.min(out).alias("__start"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__by{i}"))
    return found.join(start, same).withColumn(out, F.col(out) - F.col("__start")).select(*df.columns, out)

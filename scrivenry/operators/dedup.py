"""Duplicates inside a scope: exact ones by hash, and greedy near-duplicates against what was kept."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from scrivenry.functions.text import without_space
from scrivenry.sources.batches import small_batches
from scrivenry.sources.scratch import stored

#: Rows of a scope that are compared in one group, and rows of a larger one that a task compares with kept ones.
HEAD, PART = 256, 1024


def exact_duplicates(df: DataFrame, text: str, order: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Adds sha and is_duplicate: not the first, by ``order``, of its hash in its scope.

    The first of each hash is found by an aggregation with partial sums and joined back, so a hash that a
    third of all rows share isn't sorted in one task.  Equal ``order`` values count as first together.
    """
    hashed = df.withColumn("sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    first = hashed.groupBy(*scope, "sha").agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return hashed.join(first, [*scope, "sha"], "left").withColumn("is_duplicate", F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__first")


def char_grams(c: Column | str, n: int = 5) -> Column:
    """Distinct character n-grams; a shorter text is its own."""
    t = F.col(c) if isinstance(c, str) else c
    # One pass by a pattern: substr would walk the text anew for each place.
    long = F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))
    return F.when(F.length(t) >= n, long).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def similar(a: str, b: str, threshold: float) -> bool:
    """Whether two texts, without white space, reach the threshold by 5-gram Jaccard or matching blocks."""
    import difflib

    a, b = "".join(a.split()), "".join(b.split())
    if a == b:
        return True
    if not a or not b:
        return False
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)} or {t}
    x, y = grams(a), grams(b)
    if len(x & y) >= threshold * len(x | y):
        return True
    matcher = difflib.SequenceMatcher(None, a, b)
    # Both are upper bounds of the ratio and cheap.
    return matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold


def find_duplicates(texts: list[str], threshold: float = 0.9) -> dict[int, int]:
    """{place of a duplicate: place of the first kept text that it equals or resembles}."""
    by_text: dict[str, int] = {}
    kept, out = [], {}
    for i, text in enumerate(texts):
        found = by_text.get(text)
        if found is None:
            found = next((j for j in kept if similar(text, texts[j], threshold)), None)
            if found is None:
                by_text[text] = i
                kept.append(i)
                continue
        out[i] = found
    return out


def greedy_near_duplicates(df: DataFrame, scope: list[str], order: str, text: str, threshold: float = 0.9) -> DataFrame:
    """Adds duplicate_of: the ``order`` of the kept row, in the same scope, that a row repeats; null if kept.

    Greedy: a row is compared with kept ones only, in order, so the answer isn't transitive.  ``order`` tells the
    rows of a scope apart.  Null texts count as empty.  Scopes of up to ``HEAD`` rows (chunks of one episode) are
    each one task's group; larger ones are decided in rounds, see ``_in_rounds``.
    """

    names = df.columns
    places, own_order, own_text = [names.index(c) for c in scope], names.index(order), names.index(text)

    def run(batches):
        import pyarrow as pa

        # Rows of a scope come together and in order; the last scope of a batch may go on in the next.
        rest = None
        for b in batches:
            b = b if rest is None or not rest.num_rows else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            keys = list(zip(*(b.column(i).to_pylist() for i in places), strict=True)) if places else [()] * b.num_rows
            begin = next((i + 1 for i in range(len(keys) - 2, -1, -1) if keys[i] != keys[-1]), 0)
            rest = b.slice(begin)
            if begin:
                yield marked(b.slice(0, begin), keys[:begin])
        if rest is not None and rest.num_rows:
            yield marked(rest, None)

    def marked(b, keys):
        import pyarrow as pa

        orders, texts = b.column(own_order).to_pylist(), [t or "" for t in b.column(own_text).to_pylist()]
        ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] if keys else []
        out: list[int | None] = [None] * b.num_rows
        for first, end in zip([0, *ends], [*ends, b.num_rows], strict=True):
            for i, kept in find_duplicates(texts[first:end], threshold).items() if end > first + 1 else ():
                out[first + i] = orders[first + kept]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*names, "duplicate_of"])

    schema = StructType([*df.schema.fields, StructField("duplicate_of", LongType())])
    named = [F.col(c).alias(f"__scope{i}") for i, c in enumerate(scope)]
    large = stored(df.groupBy(*named).agg(F.count("*").alias("__rows")).where(F.col("__rows") > HEAD), "large")
    same = F.lit(True)
    for i, c in enumerate(scope):
        same &= F.col(c).eqNullSafe(F.col(f"__scope{i}"))
    # Comparing costs more than the bytes tell, so the exchange's tasks aren't merged by size.
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small_batches(df.sparkSession)
    # Scopes pass through in a stream: a group of its own for each costs more than comparing its few rows.
    decided = lambda rows: (rows.repartition(width, *scope) if scope else rows.coalesce(1)).sortWithinPartitions(*scope, order).mapInArrow(run, schema)
    if large.isEmpty():
        return decided(df)
    small = decided(df.join(large, same, "left_anti"))
    return small.unionByName(_in_rounds(df.join(large, same, "left_semi"), scope, order, text, threshold))


def _in_rounds(df: DataFrame, scope: list[str], order: str, text: str, threshold: float) -> DataFrame:
    """``greedy_near_duplicates`` of large scopes, each spread over tasks.

    Rows with one text, white space aside, are one node, which stands where the first of them does.  A round takes
    the first ``HEAD`` undecided nodes of each scope and decides them among themselves; all others of the scope, in
    parts of ``PART``, are compared with those that were kept, in order.  A node that resembles one repeats it: it
    resembled none that was kept in earlier rounds.  So no pairs are emitted, near copies of a kept node go in one
    round, and rounds are as many as kept nodes over ``HEAD``.
    """
    key = F.to_json(F.struct(*scope)) if scope else F.lit("")
    rows = df.withColumn("__g", key).withColumn("__t", without_space(F.coalesce(text, F.lit("")))).withColumn("__h", F.sha2("__t", 256))
    rows = stored(rows.withColumn("__o", F.col(order).cast("long")), "scopes")
    first = rows.groupBy("__g", "__h").agg(F.min("__o").alias("__rep"))
    left = stored(rows.join(first, ["__g", "__h"]).where(F.col("__o") == F.col("__rep")).select("__g", "__o", "__t").dropDuplicates(["__g", "__o"]), "nodes")
    decided: list[DataFrame] = []

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__o").reset_index(drop=True)
        found = find_duplicates(pdf["__t"].tolist(), threshold)
        pdf["dup"] = pd.array([pdf["__o"].iloc[found[i]] if i in found else None for i in range(len(pdf))], dtype="Int64")
        return pdf[["__g", "__o", "__t", "dup"]]

    def compare(batches):
        import pyarrow as pa

        own, kept = None, []
        for b in batches:
            gs, parts, heads, os_, ts = (c.to_pylist() for c in b.columns)
            out = []
            for g, part, head, o, t in zip(gs, parts, heads, os_, ts, strict=True):
                if (g, part) != own:
                    own, kept = (g, part), []
                if head == 0:
                    kept.append((o, t))
                else:
                    out.append((g, o, t, next((k for k, other in kept if similar(t, other, threshold)), None)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["__g", "__o", "__t", "dup"])

    while not left.isEmpty():
        ranked = left.withColumn("__r", F.row_number().over(Window.partitionBy("__g").orderBy("__o"))).where(F.col("__r") <= HEAD).drop("__r")
        heads = stored(ranked.groupBy("__g").applyInPandas(decide, "__g string, __o long, __t string, dup long"), "heads")
        decided.append(heads.select("__g", "__o", "dup"))
        ends = heads.groupBy("__g").agg(F.max("__o").alias("__end"))
        rest = left.join(ends, "__g").where(F.col("__o") > F.col("__end"))
        sizes = rest.groupBy("__g").agg(F.ceil(F.count("*") / PART).cast("int").alias("__parts"))
        others = rest.join(sizes, "__g").select("__g", F.pmod(F.xxhash64("__o"), F.col("__parts")).cast("int").alias("__part"), F.lit(1).alias("__head"), "__o", "__t")
        kept = heads.where("dup is null").join(sizes, "__g").select("__g", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), F.lit(0).alias("__head"), "__o", "__t")
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = kept.unionByName(others).repartition(width, "__g", "__part").sortWithinPartitions("__g", "__part", "__head", "__o")
        compared = stored(dealt.mapInArrow(compare, "__g string, __o long, __t string, dup long"), "compared")
        decided.append(compared.where("dup is not null").select("__g", "__o", "dup"))
        left = compared.where("dup is null").drop("dup")
    nodes = reduce(lambda a, b: a.unionByName(b), decided).withColumnRenamed("__o", "__rep")
    answer = first.join(nodes, ["__g", "__rep"])
    copy = F.when(F.col("__o") > F.col("__rep"), F.coalesce("dup", "__rep")).otherwise(F.col("dup"))
    return rows.join(answer, ["__g", "__h"]).select(*df.columns, copy.alias("duplicate_of"))


def gram_jaccard(df: DataFrame, a: str, b: str) -> Column:
    return jaccard(char_grams(without_space(a)), char_grams(without_space(b)))


@F.pandas_udf(DoubleType())
def matching_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matching characters over those of both texts, by longest matching blocks."""
    import difflib

    for x, y in pairs:
        yield pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

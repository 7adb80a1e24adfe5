"""Reading order: text before and after a row, strides, even picks, and segments of a whole work."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.operators import ranks as places

# Where the segments of each sampling method begin, as shares of a work.
METHODS = {
    "uniform9": [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0],
    "stratified9": [0.00, 0.03, 0.07, 0.22, 0.45, 0.68, 0.90, 0.96, 1.00],
    "ends3": [0.0, 0.5, 1.0],
}


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds __i, the place from 0 in reading order, and __n, the rows of the work."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))


def look_back(df: DataFrame, keys: list[str], order: list[str], text: str, chars: int, out: str = "context") -> DataFrame:
    """Adds the last ``chars`` characters of all text before a row.

    Rows are placed by the characters before them.  A row holds the text of the one before it, so the texts that
    reach into the last ``chars`` characters are those of the rows placed there, and the frame has no others.
    """
    w, t = Window.partitionBy(*keys).orderBy(*order), F.coalesce(F.col(text), F.lit(""))
    placed = df.withColumn("__at", F.coalesce(F.sum(F.length(t)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    placed = placed.withColumn("__before", F.lag(F.right(t, F.lit(chars)), 1, "").over(w))
    frame = Window.partitionBy(*keys).orderBy("__at").rangeBetween(1 - chars, 0)
    return placed.withColumn(out, F.right(F.array_join(F.collect_list("__before").over(frame), ""), F.lit(chars))).drop("__at", "__before")


def look_ahead(df: DataFrame, keys: list[str], order: list[str], text: str, rows: int, chars: int, out: str = "continuation") -> DataFrame:
    """Adds the first ``chars`` characters of a row's text and the following ones', ``rows`` in all."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, rows - 1)
    return df.withColumn(out, F.left(F.array_join(F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(w), ""), F.lit(chars)))


def prior_text(df: DataFrame, keys: list[str], episode: str, order: list[str], text: str, chars: int, out: str = "prior") -> DataFrame:
    """Adds the last ``chars`` characters of strictly earlier episodes.

    Episodes are joined into one tail each first, so the window sees a row for each episode.
    """
    ordered = F.sort_array(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("__t"))))
    tails = df.groupBy(*keys, episode).agg(F.right(F.array_join(F.transform(ordered, lambda s: s["__t"]), ""), F.lit(chars)).alias("__tail"))
    return df.join(look_back(tails, keys, [episode], "__tail", chars, out).drop("__tail"), [*keys, episode])


def strided(df: DataFrame, keys: list[str], order: list[str], stride: int) -> DataFrame:
    """Every ``stride``-th row of a work, from its second."""
    return numbered(df, keys, order).where(f"__i >= 1 and (__i - 1) % {stride} = 0").drop("__i", "__n")


def stepped(df: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """At most ``keep`` rows of a work in equal steps."""
    places = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda k: F.least(F.floor(k * F.col("__n") / keep), F.col("__n") - 1))
    return numbered(df, keys, order).where((F.col("__n") <= keep) | F.array_contains(places, F.col("__i").cast("long"))).drop("__i", "__n")


def even_places(n: Column, keep: Column, alone: str = "middle") -> Column:
    """``keep`` places of n, both ends among them, rounded half to even; one place: the middle or the first."""
    spread = F.transform(F.sequence(F.lit(0), F.greatest(keep.cast("int") - 1, F.lit(1))), lambda i: F.bround(i * (n - 1) / F.greatest(keep - 1, F.lit(1))).cast("long"))
    one = F.array((F.floor(n / 2) if alone == "middle" else F.lit(0)).cast("long"))
    every = F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), lambda i: i.cast("long"))
    return F.when(keep >= n, every).when(keep == 1, one).otherwise(F.array_distinct(spread))


def even_picks(df: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """``keep`` rows of a work at even places."""
    places = even_places(F.col("__n"), F.lit(keep))
    return numbered(df, keys, order).where(F.array_contains(places, F.col("__i").cast("long"))).drop("__i", "__n")


def skipping(df: DataFrame, keys: list[str], order: list[str], parts: int) -> DataFrame:
    """Every (n // parts)-th row, one step at least."""
    return numbered(df, keys, order).where(F.col("__i") % F.greatest(F.lit(1), F.floor(F.col("__n") / parts)) == 0).drop("__i", "__n")


def within_budget(df: DataFrame, keys: list[str], order: list[str], text: str, chars: int) -> DataFrame:
    """Rows read until their text reaches ``chars`` characters; the one that does is the last."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__read", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))).where(F.col("__read") < chars).drop("__read")


def representative(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first, middle and last row of a work."""
    return numbered(df, keys, order).where("__i in (0, __n div 2, __n - 1)").drop("__i", "__n")


def joined_text(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str, least: int = 0) -> DataFrame:
    """One row for each work: its text in reading order; works shorter than ``least`` go."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda s: s["__t"]), separator).alias("text")).where(F.length("text") >= least)


def intervals(lengths: list[int], positions: list[float], chars: int) -> list[tuple[float, int, int, int, int]]:
    """(position, first row, row after the last, first character, character after the last) of the segments of a work,
    from the lengths of its rows; characters are counted from the work's beginning.

    A segment is an interval of rows, and each has an equal budget: from its position, or the next place that no
    segment has, on until the characters reach it; where another segment, a row without text or the end stops it
    before, back from there for the rest.  The rows at both ends are cut.
    """
    share, read = max(1, chars // len(positions)), [0, *accumulate(lengths)]
    blank = [i for i, n in enumerate(lengths) if not n]
    taken: list[tuple[int, int]] = []  # rows [first, last) of segments so far, ascending
    out = []
    for position in positions:
        start = round(position * (len(lengths) - 1)) if len(lengths) > 1 else 0
        for low, high in taken:
            start = high if low <= start < high else start
        if start >= len(lengths):
            continue
        walls = [len(lengths), *(low for low, _ in taken if low > start), *blank[bisect_left(blank, start) :][:1]]
        last = bisect_left(read, read[start] + share, start, min(walls))
        rest = share - (read[last] - read[start])
        floors = [0, *(high for _, high in taken if high <= start), *(i + 1 for i in blank[: bisect_left(blank, start)][-1:])]
        first = max(max(floors), bisect_right(read, read[start] - rest) - 1) if rest > 0 else start
        if first < last:
            out.append((position, first, last, max(read[first], read[start] - max(rest, 0)), min(read[last], read[start] + share)))
            insort(taken, (first, last))
    return out


def allocate(texts: list[str], positions: list[float], chars: int) -> list[tuple[float, int, int, str]]:
    """(position, first place, rows, text) of the segments of a work."""
    whole = "".join(texts)
    return [(p, first, last - first, whole[begin:end]) for p, first, last, begin, end in intervals([len(t) for t in texts], positions, chars)]


def segments(df: DataFrame, keys: list[str], order: list[str], text: str, method: str, chars: int) -> DataFrame:
    """Rows (keys, position, start_chunk, n_chunks, n_chars, text): segments of each work by a method.

    Segments are chosen by the rows' lengths, which are all that Python sees of a work; the rows chosen are joined
    back, cut and put together, and a segment has its share of ``chars`` characters at most.
    """
    positions = METHODS[method]
    rows = places.numbered(df.select(*keys, *order, text), order, "__i", keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        lengths, head = pdf["__size"].tolist(), [pdf[k].iloc[0] for k in keys]
        read, out = [0, *accumulate(lengths)], []
        for position, first, last, begin, end in intervals(lengths, positions, chars):
            out += [(*head, position, first, last - first, i, max(begin, read[i]) - read[i], max(0, min(end, read[i + 1]) - max(begin, read[i]))) for i in range(first, last)]
        return pd.DataFrame(out, columns=[*keys, "position", "start_chunk", "n_chunks", "__i", "__from", "__take"])

    sizes = rows.select(*keys, F.col("__i").cast("int").alias("__i"), F.coalesce(F.length(text), F.lit(0)).alias("__size"))
    chosen = sizes.groupBy(*keys).applyInPandas(run, f"{kinds}, position double, start_chunk int, n_chunks int, __i int, __from int, __take int")
    same = F.col("__i") == F.col("__row")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__key{i}"))
    texts = rows.select(F.col("__i").alias("__row"), *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col(text).alias("__text"))
    cut = chosen.join(texts, same).withColumn("__part", F.substr(F.coalesce("__text", F.lit("")), F.col("__from") + 1, F.col("__take")))
    parts = F.array_sort(F.collect_list(F.struct("__i", "__part")))
    made = cut.groupBy(*keys, "position", "start_chunk", "n_chunks").agg(F.array_join(F.transform(parts, lambda x: x["__part"]), "").alias("text"))
    return made.select(*keys, "position", "start_chunk", "n_chunks", F.length("text").alias("n_chars"), "text")


def skipped_text(df: DataFrame, keys: list[str], order: list[str], text: str, parts: int, separator: str, chars: int) -> DataFrame:
    """One row for each work: every (n // parts)-th row's text, joined, and cut to ``chars`` characters."""
    joined = joined_text(skipping(df, keys, order, parts), keys, order, text, separator)
    return joined.withColumn("text", F.left("text", F.lit(chars)))


def shared_budget(texts: Column, chars: int, separator: str = "\n\n---\n\n") -> Column:
    """Texts, each cut to an equal share of ``chars`` characters, joined."""
    share = F.floor(F.lit(chars) / F.greatest(F.size(texts), F.lit(1))).cast("int")
    return F.array_join(F.transform(texts, lambda t: F.left(t, share)), separator)

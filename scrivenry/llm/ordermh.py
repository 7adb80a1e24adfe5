"""Order MinHash fingerprints, in DataFrame operations only.

A text's k-mers are runs of three words.  The n-th occurrence of a k-mer counts as an element of its own,
hashed with its number.  The hash's upper bits choose one of ``COMPONENTS``; in each component the two least
elements are taken, put back into text order, and hashed as a tuple.  So two fingerprints agree in a component
only if both elements survived and kept their order, which follows the edit distance rather than the set.  A
component that has fewer than two, as in short texts, takes what is missing from those after it, in a circle: its
two are the first at or behind its beginning in the order of hashes.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.llm.common import shuffle_width
from scrivenry.llm.histsort import LEAST, place

#: Bits of a place in an element's number (a string of Spark's has fewer words than that), and of its component.
PLACE_BITS, COMPONENT_BITS = 30, 6
COMPONENTS = 1 << COMPONENT_BITS
_MASK = (1 << PLACE_BITS) - 1
_SPACES = "' \\t\\n\\r\\f\\u000b'"
# Scripts written without spaces: each of their characters is a word.
_DENSE = "[\\\\p{IsHan}\\\\p{IsHiragana}\\\\p{IsKatakana}\\\\p{IsThai}]"


def sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, array<int>: the hash of each component's tuple; empty for a text without words, and from its
    one element alone for a text that has but one.

    Each array below is read more than once in the next step, so the optimiser keeps the steps apart.
    """
    top, bits = f"shiftright(%s, {64 - COMPONENT_BITS})", PLACE_BITS
    words = f"__{out}_words"
    spaced = f"if({text} rlike '{_DENSE}', regexp_replace({text}, '({_DENSE})', ' $1 '), {text})"
    trimmed = f"btrim({spaced}, {_SPACES})"
    df = df.withColumn(words, F.expr(f"if({trimmed} = '', cast(array() as array<bigint>), transform(split({trimmed}, '[ \\\\t\\\\n\\\\r\\\\f\\\\x0b]+'), w -> xxhash64(w)))"))
    run = f"__{out}_run"
    kmer = f"xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2))"
    df = df.withColumn(run, F.expr(f"if(size({words}) = 0, cast(array() as array<bigint>), sort_array(transform(sequence(0, greatest(size({words}) - 3, 0)), i -> ({kmer} & ~{_MASK}L) | cast(least(i, {_MASK}) as bigint))))"))
    start = f"__{out}_start"
    df = df.withColumn(start, F.expr(f"filter(transform({run}, (x, i) -> if(i > 0 and shiftright(x, {bits}) = shiftright({run}[greatest(i - 1, 0)], {bits}) and size({run}) > 0, -1, i)), i -> i >= 0)"))
    element = lambda x, n: f"(xxhash64(shiftright({x}, {bits}), {n}) & ~{_MASK}L) | ({x} & {_MASK}L)"
    one = f"transform({run}, x -> {element('x', '0')})"
    several = f"flatten(transform({start}, (b, r) -> transform(slice({run}, b + 1, coalesce(get({start}, r + 1), size({run})) - b), (x, n) -> {element('x', 'n')})))"
    own = f"__{out}_own"
    df = df.withColumn(own, F.expr(f"sort_array(if(size({start}) = size({run}), {one}, {several}))"))
    first, n = f"__{out}_first", f"size({own})"
    df = df.withColumn(first, F.expr(f"filter(transform({own}, (x, i) -> if(i = 0 or {top % f'{own}[greatest(i - 1, 0)]'} != {top % 'x'}, i, -1)), i -> i >= 0)"))
    kept = lambda i: f"({own}[{i}] & ~{_MASK}L)"
    after = f"if(i + 1 < {n}, i + 1, 0)"
    tuple_ = f"if({n} = 1, xxhash64({kept('i')}), if(({own}[i] & {_MASK}L) <= ({own}[{after}] & {_MASK}L), xxhash64({kept('i')}, {kept(after)}), xxhash64({kept(after)}, {kept('i')})))"
    # A component up to the one where an element begins, and behind the last one, takes that element and its next.
    half = COMPONENTS // 2
    number = lambda i: f"cast({top % f'{own}[{i}]'} as int)"
    value, before = f"cast({tuple_} & {(1 << 31) - 1}L as int)", f"if(r = 0, {-half - 1}, {number(f'{first}[greatest(r - 1, 0)]')})"
    spread = f"transform({first}, (i, r) -> array_repeat({value}, {number('i')} - {before}))"
    found = f"__{out}_found"
    df = df.withColumn(found, F.expr(f"if({n} = 0, cast(array() as array<int>), flatten({spread}))"))
    whole = f"if(size({found}) in (0, {COMPONENTS}), {found}, concat({found}, array_repeat({found}[0], {COMPONENTS} - size({found}))))"
    return df.withColumn(out, F.expr(whole)).drop(words, run, start, own, first, found)


def shown(sketch: str) -> Column:
    """A fingerprint as a string: eight hex digits for each component."""
    return F.expr(f"array_join(transform({sketch}, v -> lpad(hex(v), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Share of components that agree; 1 if neither text has words, 0 if one has none."""
    agree = f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, v) -> s + v)"
    return F.expr(f"if(size({a}) = 0 or size({b}) = 0, if(size({a}) = size({b}), 1.0D, 0.0D), {agree} / {COMPONENTS}.0D)")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and rows in ``__b`` stretches of ascending doc_id, rows of one doc_id by a hash
    of their texts; ``__ghost`` marks a copy of the row that follows a stretch (after the last: the first row),
    there so that every row meets its next.  A doc_id that would fill several stretches is cut by that hash."""
    spark, key = docs.sparkSession, F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("__key"))
    rows = rows.withColumn("__tie", F.xxhash64("text"))
    n = rows.count()
    stretches = min(16384, max(4 * shuffle_width(spark), n // 2048))
    cuts = rows.select(F.percentile_approx("__key", [i / stretches for i in range(1, stretches)], 10 * stretches)).first()[0] if n else []
    bounds = sorted((c, LEAST + (j << 64) // k) for c, k in Counter(cuts or []).items() for j in range(k))
    rows = rows.withColumn("__b", place("__key", "__tie", bounds)).withColumn("__ghost", F.lit(0))
    firsts = sorted(rows.groupBy("__b").agg(F.min(F.struct("__key", "__tie")).alias("k")).collect())  # a row for each stretch
    follows = [(b, *firsts[(i + 1) % len(firsts)].k) for i, (b, _) in enumerate(firsts)]
    following = spark.createDataFrame(follows, "__b int, __key long, __tie long")
    # The first row of a stretch; of rows that are alike so far the one with the least text, as below.
    first = F.col("__key").isin([k for _, k, _ in follows]) & F.col("__tie").isin([t for _, _, t in follows])
    ghosts = rows.where(first).groupBy("__key", "__tie").agg(F.min("text").alias("text"))
    ghosts = following.join(ghosts, ["__key", "__tie"]).select(F.lit(None).cast("long").alias("doc_id"), "text", "__key", "__tie", "__b", F.lit(1).alias("__ghost"))
    return rows.unionByName(ghosts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many of the next
    document's text (or all of it), by ascending doc_id, after the last the first.  Null text: empty.  Null
    doc_id: before all others.  Repeated doc_ids: in the order of a hash of their texts.  A text without words has an
    empty fingerprint, like only to another such one.  A single row is its own next.  Other columns aren't read.  An
    empty table gives an empty one.

    One exchange moves the texts; the windows over a stretch share it and its order.
    """
    order = Window.partitionBy("__b").orderBy("__ghost", "__key", "__tie", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    df = with_next(docs).withColumn("__next", F.coalesce(F.lead("text").over(order), F.lit("")))
    edited = F.concat(F.left("text", F.length("text") - half), F.left("__next", half))
    df = df.withColumn("__edited", F.when(F.col("__ghost") == 0, edited).otherwise(F.lit(""))).drop("__next")
    df = sketch(sketch(df, "text", "__fp"), "__edited", "__efp")
    df = df.withColumn("__nfp", F.lead("__fp").over(order)).where("__ghost = 0")
    return df.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("__edited", 256).alias("edited_sha256"),
        shown("__fp").alias("fingerprint"), shown("__efp").alias("edited_fingerprint"),
        likeness("__fp", "__efp").alias("near_edited"), likeness("__fp", "__nfp").alias("near_next"),
    )

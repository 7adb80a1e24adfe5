"""Sharding by histogram sort, in DataFrame operations only.

Documents are ordered by a key: the hash of the text, then doc_id, so equal texts lie side by side.  The
shards are the stretches between splitters.  Splitters are found by counting, not by sampling: a pass over
the keys gives the exact bytes below each probe, the probes around each wanted share are refined, and that
is repeated until every splitter meets the tolerance.  Then rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.llm.common import Scratch, stored, width_for

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Probes for each splitter and pass; parts of a shard that are numbered apart (least and most), and their rows.
PROBES, PARTS, PART_ROWS = 64, (16, 1024), 8192
#: Bytes of documents that a task of the exchange should get.
TASK_BYTES = 64 << 20


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def place(key: str, tie: str, bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending bounds are at or below (key, tie), by binary search in constant arrays."""
    if not bounds:
        return F.lit(0)
    keys, ties = ("array(" + ",".join(f"{v}L" if v > LEAST else f"({LEAST + 1}L - 1L)" for v in side) + ")" for side in zip(*bounds, strict=True))
    mid = "((s.low + s.high) div 2)"
    above = f"({key} > {keys}[int({mid})] or {key} = {keys}[int({mid})] and {tie} >= {ties}[int({mid})])"
    step = f"if(s.low >= s.high, s, if({above}, named_struct('low', {mid} + 1L, 'high', s.high), named_struct('low', s.low, 'high', {mid})))"
    return F.expr(f"cast(aggregate(sequence(1, {len(bounds).bit_length()}), named_struct('low', 0L, 'high', {len(bounds)}L), (s, i) -> {step}, s -> s.low) as int)")


def histogram(keys: DataFrame, bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) between neighbouring bounds.  Partial sums travel: a row for each bin and task."""
    found = keys.groupBy(place("key", "tie", bounds).alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    out = [(0, 0)] * (len(bounds) + 1)
    for r in found:
        out[r.bin] = (r.bytes, r.n)
    return out


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """``parts`` - 1 bounds (key, tie) with bytes below each within ``tolerance`` shares of its wanted sum.

    keys: key long, tie long, size long.  A bound lies between two keys (tie = the least) unless the rows of
    one key are more than the tolerance; then, and only then, it lies inside that key, by tie.  Bounds inside
    a key whose rows all share one tie can't get nearer; they stay at its edge.
    """
    total, first, last = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.min("tie"), F.lit(0)), F.coalesce(F.max("tie"), F.lit(0))).first()
    slack = tolerance * total / parts
    wanted = [total * (i + 1) / parts for i in range(parts - 1)]
    done: dict[int, tuple[int, int]] = {}
    # Each open interval: low and high bound as (key, tie) and whether it is refined inside one key.
    open_ = {i: ((LEAST, LEAST), (MOST, MOST)) for i in range(parts - 1)}
    best: dict[int, tuple[float, tuple[int, int]]] = {}
    while open_:
        probes: set[tuple[int, int]] = set()
        for low, high in open_.values():
            a, b = (low[0], high[0]) if high[0] > low[0] else (low[1], high[1])
            cuts = {a + (b - a) * j // (PROBES + 1) for j in range(1, PROBES + 1)}
            cuts |= {b} if b - a <= PROBES else set()
            probes |= {(c, LEAST) if high[0] > low[0] else (low[0], c) for c in cuts if c > a}
            probes |= {low, high}
        bounds = sorted(probes)
        below, before, sums, rows = 0, 0, {}, {}
        for bound, (size, n) in zip(bounds, histogram(keys, bounds), strict=False):
            below, before = below + size, before + n
            sums[bound], rows[bound] = below, before
        for i, (low, high) in list(open_.items()):
            inside = [b for b in bounds if low <= b <= high]
            near = min(inside, key=lambda b: abs(sums[b] - wanted[i]))
            if i not in best or abs(sums[near] - wanted[i]) < best[i][0]:
                best[i] = (abs(sums[near] - wanted[i]), near)
            under = max((b for b in inside if sums[b] <= wanted[i]), default=low)
            over = min((b for b in inside if b > under), default=high)
            narrow = over[0] - under[0] <= 1
            if best[i][0] <= slack or rows[over] - rows[under] <= 1 or narrow and (over[1] - under[1] <= 1 if under[0] == over[0] else False) or (under, over) == (low, high) and not narrow:
                done[i] = best[i][1]
                del open_[i]
            elif narrow and under[0] < over[0]:
                open_[i] = ((under[0], first), (under[0], min(last, MOST - 1) + 1))  # one key holds more than the tolerance: go on by tie
            else:
                open_[i] = (under, over)
    return sorted(done.values())


def numbering(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int]], list[int], list[int], int]:
    """(bounds of the parts, the shard of each part, the slots before it in that shard, bytes of all documents)."""
    bounds = splitters(keys, shards, tolerance)
    # Parts for numbering: even steps of the key between the splitters, so that no part waits for a whole shard.
    # Keys with more rows than a part should have (there are fewer of them than parts) are cut by doc_id too.
    edges, n_rows = [(LEAST, LEAST), *bounds, (MOST, MOST)], keys.count()
    parts = min(max(PARTS[0], n_rows // (shards * PART_ROWS)), PARTS[1])
    fine = {*bounds, *((a[0] + (b[0] - a[0]) * j // parts, LEAST) for a, b in zip(edges, edges[1:], strict=False) for j in range(1, parts))}
    share = max(1, n_rows // (shards * parts))
    hot = [r.key for r in keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > share).select("key").collect()]
    cuts = [j / 64 for j in range(1, 64)]
    for key, n, ties in keys.where(F.col("key").isin(hot)).groupBy("key").agg(F.count("*"), F.percentile_approx("tie", cuts, 1000)).collect():
        every = max(1, 64 * share // n)
        fine |= {(key, LEAST), (key + 1, LEAST), *((key, t) for t in ties[::every])}
    fine = sorted(b for b in fine if b > (LEAST, LEAST))
    counts = histogram(keys, fine)
    own, slots, at = [], [], {}
    for k in range(len(fine) + 1):
        # the shard of a part: how many splitters are at or below the part's lower end
        s = sum(b <= fine[k - 1] for b in bounds) if k else 0
        own.append(s)
        slots.append(at.get(s, 0))
        at[s] = at.get(s, 0) + counts[k][1]
    return fine, own, slots, sum(n for n, _ in counts)


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.01, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` plus shard int, slot long (gapless from 0 in each shard) and shard_size long.

    Shards are near equal by bytes: UTF-8 bytes of the text (null: none) plus 8 for each row.  Equal texts
    share a shard unless their rows alone exceed the tolerance; then they are split by doc_id, and rows that have
    that in common too are numbered in one task.  Null doc_id sorts as the least number.  Repeated rows are all
    kept.  Columns of ``docs`` named shard, slot or shard_size are replaced; all others, whatever their names,
    pass as they are.  An empty table gives an empty one.

    Passes read only (hash, doc_id, size), stored once in the shared folder.  Rows are exchanged once, by
    (shard, part of it); slots are numbered in each part and the exact count of the parts before is added.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot", "shard_size")]
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8
    row = F.struct(*[F.col(f"`{c}`") for c in columns])  # no column of theirs meets one of those below
    keyed = docs.select(row.alias("row"), text_key(text).alias("__key"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST)).alias("__tie"), size.alias("shard_size"))
    with Scratch(docs.sparkSession):
        keys = stored(keyed.select(F.col("__key").alias("key"), F.col("__tie").alias("tie"), F.col("shard_size").alias("size")), "keys")
        fine, own, slots, total = numbering(keys, shards, tolerance)
    moved = keyed.withColumn("__part", place("__key", "__tie", fine)).repartition(width_for(docs.sparkSession, total, TASK_BYTES), "__part")
    order = Window.partitionBy("__part").orderBy("__key", "__tie", F.col("row")[text])
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("__part") + 1)
    return moved.withColumn("__row", F.row_number().over(order)).select(*[F.col("row")[c].alias(c) for c in columns], "shard_size", pick(own).cast("int").alias("shard"), (pick(slots).cast("long") + F.col("__row") - 1).alias("slot"))

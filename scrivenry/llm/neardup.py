"""Near-duplicate groups by SuperMinHash, banding, verification on full shingle sets, and union-find.

SuperMinHash gives each element a permutation of the m places, drawn step by step, and at step j the rank
j + r (r uniform in [0, 1)) at the step's place; a place keeps the least rank.  All elements of a document
take their step j together; once every place has a rank the later steps can't lower any, and they are not
taken.  Long documents stop after step 0.

Documents with equal shingle sets are one class.  Classes that share a band's value form a bucket and are
compared in the group of the bucket's least member, its pivot.  A group that a task can hold is compared there.  In
a larger one each member is compared with the pivot first; its Jaccard distance to the pivot is a metric, so two
members can be linked only if their distances to the pivot differ by the threshold's at most.  Members linked to
the pivot are joined already and meet only those of the next ring; rings are cut into blocks, and each pair of
blocks is a task's work.  Every pair that these bounds leave and that isn't joined yet is confirmed on full sets;
only the links that joined two parts come out.  So no pairs are emitted, and no link between different sets is
left out but by the chance of the bands.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivenry.llm.common import Scratch, claim, parts, small_batches, stored, width_for

HASHES = 128
#: A pair at the threshold shares no band with at most this chance.
MISS = 1e-4
#: Most members and shingles of a block, rows of a task, and ids of documents that are sent to all tasks at once.
BLOCK, BLOCK_SHINGLES, TASK_ROWS, SENT_IDS = 192, 4_000_000, 4096, 2_000_000
#: Rounding of a distance.
SLACK = 1e-9
_WORDS = 200_000


class _WordHash(dict):
    """64-bit hashes of words; bounded, as it starts afresh when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > _WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles: runs of ``words`` words, letters A-Z in lower
    case, words as stretches without ASCII white space.  Fewer words: the whole sequence as one shingle.
    No words: none."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    out = h[: len(h) - size + 1].copy()
    for j in range(1, size):
        out = _mix(out) + h[j : len(h) - size + 1 + j]
    return np.unique(_mix(out ^ np.uint64(size)))


def superminhash(elements: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The signature of a set that isn't empty: for each place the least rank, step in the upper 32 bits."""
    n = len(elements)
    out = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    places = None
    for step in range(hashes):
        draw = _mix(elements + np.uint64(0x9E3779B97F4A7C15 * (step + 1) & (1 << 64) - 1))
        at = step + (((draw >> np.uint64(32)) * np.uint64(hashes - step)) >> np.uint64(32)).astype(np.int64)
        rank = (draw & np.uint64(0xFFFFFFFF)) | np.uint64(step << 32)
        if places is None and step:
            places = np.tile(np.arange(hashes, dtype=np.uint8), (n, 1))
            rows = np.arange(n)
            places[rows, first], places[:, 0] = 0, first  # step 0's exchange
        if places is None:
            first = at.astype(np.uint8)
            np.minimum.at(out, at, rank)
        else:
            taken = places[rows, at]
            places[rows, at] = places[:, step]
            places[:, step] = taken
            np.minimum.at(out, taken, rank)
        if out.max() < np.uint64((step + 1) << 32):
            break
    return out


def bands_for(percent: int, hashes: int = HASHES) -> tuple[int, int]:
    """(rows, bands): the most rows a band may have for a pair at the threshold to be missed with ``MISS``."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISS:
            return rows, bands
    return 1, hashes


def prints(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set; null if empty), bands array<long>."""
    rows, bands = bands_for(percent)

    def make(batches):
        import pyarrow as pa

        claim("shingles", _hashes.clear)
        for b in parts(batches):
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = shingles(text, words)
                if not len(own):
                    out.append((doc_id, 0, None, None))
                    continue
                signature = superminhash(own)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for column in signature[: rows * bands].reshape(bands, rows).T:
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
                out.append((doc_id, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), key.view(np.int64).tolist()))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, n_shingles long, digest binary, bands array<long>")


class Forest:
    """Union-find; the least member is a part's root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _runs(batches, keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches by runs of their first ``keys`` columns; a run's rows come one after another."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for now, run in groupby(rows, key=lambda r: r[:keys]):
        yield now, (r[keys:] for r in run)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements of two ascending arrays of distinct values that both have."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _compare(members: list, across: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join parts.  members: (side, rep, linked, distance, set), of which the linked are joined already;
    across: only pairs of different sides."""
    members.sort(key=lambda m: (m[0], m[1]))
    side, linked = np.array([m[0] for m in members]), np.array([m[2] for m in members])
    distance = np.array([m[3] for m in members])
    arrays = [np.frombuffer(m[4], np.uint64) for m in members]
    sizes = np.array([len(a) for a in arrays])
    reps, width = [m[1] for m in members], 1 - percent / 100 + SLACK
    sets: dict[int, set] = {}
    held = 0

    def full(i: int) -> set:
        nonlocal held
        if i not in sets:
            if held > BLOCK_SHINGLES // 4:
                sets.clear()
                held = 0
            sets[i] = set(arrays[i].tolist())
            held += len(arrays[i])
        return sets[i]

    forest, links = Forest(), []
    joined = np.flatnonzero(linked).tolist()
    for i in joined[1:]:
        forest.join(reps[joined[0]], reps[i])
    for i in range(len(members) - 1):
        ok = 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])
        ok &= np.abs(distance[i + 1 :] - distance[i]) <= width
        if across:
            ok &= side[i + 1 :] != side[i]
        if linked[i]:
            ok &= ~linked[i + 1 :]
        for j in (np.flatnonzero(ok) + i + 1).tolist():
            a, b = reps[i], reps[j]
            if forest.find(a) != forest.find(b):
                small, large = (i, j) if sizes[i] <= sizes[j] else (j, i)
                both = len(full(i) & full(j)) if sizes[large] < 20_000 else _shared(arrays[small], arrays[large])
                if 100 * both >= percent * (len(arrays[i]) + len(arrays[j]) - both):
                    forest.join(a, b)
                    links.append((max(a, b), min(a, b)))
    return links


def _sets(docs: DataFrame, member: DataFrame, words: int) -> DataFrame:
    """digest, own: the full set of each class in ``member``, from texts read again.  The few ids wanted go to all
    tasks, so that only their texts are touched; where they are many, both sides are dealt by id."""
    ids = stored(member.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sent = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sent, "doc_id", "left_semi").select("text")

    def make(batches):
        import pyarrow as pa

        claim("shingles", _hashes.clear)
        for b in parts(batches):
            own = [shingles(t, words).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(o, digest_size=16).digest() for o in own], pa.binary()), pa.array(own, pa.binary())], names=["digest", "own"])

    # One doc_id may come with several texts: a class may turn up twice, or one that nobody wants.
    return stored(texts.mapInArrow(make, "digest binary, own binary").groupBy("digest").agg(F.first("own").alias("own")), "sets")


def _from_pivots(large: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """pivot, rep, digest, n, linked, distance for each member of a large group but its pivot.  Members are dealt in
    parts, and each part gets a copy of the pivot's set."""
    spark = large.sparkSession
    salt = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = large.where("rep != pivot").select("pivot", salt.alias("part"), F.lit(1).alias("place"), "rep", "digest", "n")
    first = large.where("rep = pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(0).alias("place"), "rep", "digest", "n")
    rows = others.unionByName(first).join(full, "digest").select("pivot", "part", "place", "rep", "digest", "n", "own")

    def measure(batches):
        import pyarrow as pa

        schema = pa.schema([("pivot", pa.int64()), ("rep", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("linked", pa.bool_()), ("distance", pa.float64())])
        for (pivot, _), run in _runs(batches, 2):
            base, out = np.frombuffer(next(run)[4], np.uint64), []
            for _, rep, digest, n, own in run:
                both = _shared(base, np.frombuffer(own, np.uint64))
                union = n + len(base) - both
                out.append((pivot, rep, digest, n, 100 * both >= percent * union, 1 - both / union))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    width = width_for(spark, large.count(), TASK_ROWS)
    dealt = rows.repartition(width, "pivot", "part").sortWithinPartitions("pivot", "part", "place")
    return stored(dealt.mapInArrow(measure, "pivot long, rep long, digest binary, n long, linked boolean, distance double"), "distances")


def _cells(ringed: DataFrame) -> DataFrame:
    """pivot, i, j, side and the row's columns: each row once for each pair of blocks in which it is compared.
    Blocks of one ring meet each other (but not in ring 0, which is joined) and those of the next."""
    sizes = ringed.groupBy("pivot", "ring").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sizes = stored(sizes, "rings")
    next_, last = (sizes.select("pivot", (F.col("ring") + d).alias("ring"), F.col("blocks").alias(n)) for d, n in ((-1, "above"), (1, "below")))
    rows = ringed.join(sizes, ["pivot", "ring"]).join(next_, ["pivot", "ring"], "left").join(last, ["pivot", "ring"], "left")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    block = lambda ring, i: ring.cast("long") * (1 << 24) + i
    ring, own = F.col("ring"), block(F.col("ring"), F.col("own"))
    none = F.array().cast("array<long>")
    of = lambda n, r: F.when(F.coalesce(n, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: block(r, i))).otherwise(none)
    partners = F.concat(F.when(ring > 0, of(F.col("blocks"), ring)).otherwise(none), of(F.col("above"), ring + 1), of(F.col("below"), ring - 1))
    rows = rows.withColumn("side", own).withColumn("other", F.explode(partners))
    return rows.select("pivot", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "linked", "distance", "digest")


def links(docs: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (child > parent, doc_ids of class representatives), enough to join every group.

    found: the stored ``prints``.  The texts of classes that share a bucket are read again for their sets.
    """
    spark = docs.sparkSession
    # Number of shingles and bands are functions of the set, so any row of a class has its.
    own = found.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    banded = stored(own.select("digest", "rep", "n", F.explode("bands").alias("band")), "bands")
    shared = stored(banded.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).where("size > 1").select("band", "pivot"), "buckets")
    # A representative may stand for several classes, where one doc_id has several texts.
    member = stored(banded.join(shared, "band").select("pivot", "rep", "digest", "n").distinct(), "members")
    full = _sets(docs, member, words)
    sizes = member.groupBy("pivot").agg(F.count("*").alias("size"), F.sum("n").alias("sum")).where((F.col("size") > BLOCK) | (F.col("sum") > BLOCK_SHINGLES))
    sizes = stored(sizes.select("pivot", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("sum") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "large")
    small = member.join(sizes, "pivot", "left_anti").select("pivot", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("side"), "rep", F.lit(False).alias("linked"), F.lit(0.0).alias("distance"), "digest")
    near = _from_pivots(member.join(sizes, "pivot"), full, percent)
    step = 1 - percent / 100 + SLACK
    ring = F.when(F.col("linked"), 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("distance") / step))).cast("int")
    work = small.unionByName(_cells(near.withColumn("ring", ring)))
    work = work.join(full, "digest").select("pivot", "i", "j", "side", "rep", "linked", "distance", "own")

    def confirm(batches):
        import pyarrow as pa

        for (_, i, j), members in _runs(batches, 3):
            if made := _compare(list(members), i != j, percent):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=["child", "parent"])

    width = width_for(spark, member.count(), TASK_ROWS)
    dealt = work.repartition(width, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    return dealt.mapInArrow(confirm, "child long, parent long").union(near.where("linked").select(F.greatest("rep", "pivot"), F.least("rep", "pivot")))


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """child, parent: each node of ``edges`` (child > parent) that isn't the least of its component, and that
    least node.

    A round deals edges by child, joins what meets in a task by union-find, gives each node's edge to the
    least node it saw there (a task sees a child's edges from all others, at most one from each), and then
    moves each edge on to its parent's parent.  Rounds end when every child has one parent and no parent is
    a child.
    """
    def contract(batches):
        import pyarrow as pa

        forest, nodes = Forest(), set()
        for b in batches:
            for child, parent in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                forest.join(child, parent)
                nodes.update((child, parent))
        out = [(n, r) for n in sorted(nodes) if (r := forest.find(n)) != n]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["child", "parent"])

    edges = stored(edges.distinct(), name)
    while True:
        width = width_for(edges.sparkSession, edges.count(), 200_000)
        edges = stored(edges.repartition(width, "child").mapInArrow(contract, "child long, parent long").distinct(), name)
        several = edges.groupBy("child").count().where("count > 1")
        above = edges.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        if several.isEmpty() and edges.join(above, "parent", "left_semi").isEmpty():
            return edges
        edges = edges.join(above, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Linked: 100 * shared shingles >= ``percent`` * shingles of either.  component_id: the smallest doc_id
    reachable over links, its own included; kept: doc_id = component_id.  Null or empty text, or no word:
    n_shingles 0 and linked with nothing.  Null doc_id: grouped with nothing unless its text's class has an
    id; kept is then false, and component_id null if there is none.  Repeated rows give repeated rows, all
    with the same answer.  Other columns are not read.  An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    with Scratch(docs.sparkSession) as tables:
        found = stored(prints(docs, words, percent), "prints")
        least = found.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
        roots = components(links(docs, found, words, percent))
        own = least.join(roots, F.col("rep") == F.col("child"), "left").select("digest", F.coalesce("parent", "rep").alias("root"), "rep", "n")
        # Only classes whose answer isn't the row's own doc_id are joined back.
        others = stored(own.where("n > 1 or root != rep").select("digest", "root"), "roots")
        tables.keep(found, others)
    joined = found.select("doc_id", "n_shingles", "digest").join(others, "digest", "left")
    component = F.coalesce("root", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group that ``near_duplicates`` finds: that with the smallest
    doc_id.  Rows repeated with doc_id and text stay once.  Where one doc_id has several texts, each of them is a
    document of its own, which stands after all others: it goes only if its own text resembles one that stays.  Rows
    without doc_id are in no group and stay.  doc_ids are below 2^62.  An empty table gives an empty one."""
    rows, one = docs, f"row_{uuid.uuid4().hex[:8]}"
    repeated = stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        rows = docs.withColumn(one, F.col("doc_id").cast("long"))
    else:
        last = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
        # Stored, so that the number of a row doesn't change when a task is run again.
        several = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
        several = stored(several.withColumn(one, F.monotonically_increasing_id() + (last + 1)), "several")
        texts = several.groupBy(F.col("doc_id").alias(f"{one}_id")).agg((F.count("*") == 1).alias(f"{one}_single"))
        several = several.join(texts, F.col("doc_id") == F.col(f"{one}_id"))
        several = several.withColumn(one, F.when(F.col(f"{one}_single"), F.col("doc_id").cast("long")).otherwise(F.col(one))).select(*docs.columns, one)
        rows = docs.join(repeated, "doc_id", "left_anti").select(*docs.columns).withColumn(one, F.col("doc_id").cast("long")).unionByName(several)
    answer = near_duplicates(rows.select(F.col(one).alias("doc_id"), "text"), words, percent)
    gone = stored(answer.where("not kept and doc_id is not null").select(F.col("doc_id").alias(one)), "dropped")
    return rows.join(gone, one, "left_anti").select(*docs.columns)

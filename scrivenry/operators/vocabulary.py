"""The most frequent character n-grams of a corpus, exactly, without counting every distinct one.

Each task keeps a summary of so many n-grams: when it has more, the count of the first that is too many is taken from
all, and those left with none go.  What a summary lost of any n-gram is at most the sum of what it took, and
summaries merge.  The n-grams of the merged summary are then counted exactly; if the least count that gets into the
vocabulary isn't above the loss, the summary is made anew, larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scrivenry.sources.batches import parts as parts_of
from scrivenry.sources.batches import small_batches

#: N-grams of a summary at first, numbers that travel together, summaries merged by a task, rows and bytes of a part.
CAPACITY, BLOCK, FAN_IN, ROWS, BYTES = 1 << 20, 1 << 16, 16, 1024, 2 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(text: str | None, low: int, high: int) -> np.ndarray:
    """A number for each character n-gram of a text, repeats included: of up to three characters their code points,
    of more a 63-bit hash of them."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    out, own = [], points
    for n in range(1, high + 1):
        if n > len(points):
            break
        if n > 1:
            tail = points[n - 1 :]
            own = own[: len(tail)] << np.uint64(21) | tail if n <= 3 else _mix(own[: len(tail)] * np.uint64(0x9E3779B97F4A7C15) + tail) | np.uint64(1 << 63)
        if n >= low:
            out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Summary:
    """Counts of at most ``capacity`` numbers, and how much any count, also a missing one, may be too small."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, codes: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Ascending numbers, each once."""
        at, hit = lookup(self.codes, codes)
        self.counts[at] += counts[hit]
        new = np.searchsorted(self.codes, codes[~hit])
        every, sums = np.insert(self.codes, new, codes[~hit]), np.insert(self.counts, new, counts[~hit])
        self.lost += lost
        if len(every) > self.capacity:
            taken = int(np.partition(sums, len(sums) - self.capacity - 1)[len(sums) - self.capacity - 1])
            kept = sums > taken
            every, sums = every[kept], sums[kept] - taken
            self.lost += taken
        self.codes, self.counts = every, sums


class _Merged:
    """A summary of blocks of others, added once they are as many numbers as it may hold."""

    def __init__(self, capacity: int):
        self.own, self.held, self.size = Summary(capacity), [], 0

    def add(self, codes: bytes, counts: bytes, lost: int) -> None:
        self.own.lost += lost
        self.held.append((np.frombuffer(codes, np.uint64), np.frombuffer(counts, np.int64)))
        self.size += len(self.held[-1][0])
        if self.size >= self.own.capacity:
            self.summary()

    def summary(self) -> Summary:
        if self.held:
            codes, at = np.unique(np.concatenate([c for c, _ in self.held]), return_inverse=True)
            sums = np.zeros(len(codes), np.int64)
            np.add.at(sums, at, np.concatenate([n for _, n in self.held]))
            self.held, self.size = [], 0
            self.own.add(codes, sums)
        return self.own


def _texts(batches) -> Iterator[list[str | None]]:
    """Texts of a few rows, of ``BYTES`` in all: a worker holds several numbers of 8 bytes for each character."""
    for part in parts_of(batches, ROWS, BYTES):
        yield part.column(0).to_pylist()


def summary(df: DataFrame, text: str, low: int, high: int, capacity: int) -> Summary:
    """Of all texts.  A summary of ``capacity`` numbers comes to the driver."""

    def make(batches):
        from pyspark import TaskContext

        own = Summary(capacity)
        for texts in _texts(batches):
            found, n = np.unique(np.concatenate([codes(t, low, high) for t in texts]), return_counts=True)
            own.add(found, n)
        yield from sent(TaskContext.get().partitionId(), own)

    def sent(part: int, own: Summary):
        import pyarrow as pa

        for i in range(0, len(own.codes), BLOCK):
            lost = own.lost if i == 0 else 0
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.codes[i : i + BLOCK].tobytes()]), pa.array([own.counts[i : i + BLOCK].tobytes()]), pa.array([lost], pa.int64())], names=["part", "codes", "counts", "lost"])

    def merge(batches):
        part, own = None, None
        for b in batches:
            for now, found, n, lost in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != part:
                    if own:
                        yield from sent(part, own.summary())
                    part, own = now, _Merged(capacity)
                own.add(found, n, lost)
        if own:
            yield from sent(part, own.summary())

    small_batches(df.sparkSession)
    schema = "part int, codes binary, counts binary, lost long"
    rows, parts = df.select(F.col(text).cast("string")).mapInArrow(make, schema), max(1, df.rdd.getNumPartitions())
    while parts > 1:
        parts = -(-parts // FAN_IN)
        rows = rows.withColumn("part", (F.col("part") / FAN_IN).cast("int")).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, schema)
    out = _Merged(capacity)
    for r in rows.collect():
        out.add(r["codes"], r["counts"], r["lost"])
    return out.summary()


def exact_counts(df: DataFrame, text: str, low: int, high: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(occurrences, documents) of each of the ascending ``wanted``, and the number of documents."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        import pyarrow as pa

        sums, n = np.zeros((2, len(wanted)), np.int64), 0
        for texts in _texts(batches):
            for t in texts:
                n += 1
                found, times = np.unique(codes(t, low, high), return_counts=True)
                at, hit = lookup(sent.value, found)
                sums[0, at] += times[hit]
                sums[1, at] += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.array([[n]]).tobytes()])], names=["block", "sums"])
            for i in range(0, len(wanted), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([sums[:, i : i + BLOCK].tobytes()])], names=["block", "sums"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(part, np.int64)
                sums[block] = sums[block] + own if block in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()])], names=["block", "sums"])

    counted = df.select(F.col(text).cast("string")).mapInArrow(count, "block int, sums binary")
    width = max(1, min(df.rdd.getNumPartitions(), len(wanted) // BLOCK))
    found = {r["block"]: np.frombuffer(r["sums"], np.int64) for r in counted.repartition(width, "block").mapInArrow(add, "block int, sums binary").collect()}
    sent.unpersist()
    n = int(found.pop(-1, np.zeros(1))[0])
    both = np.concatenate([found[i].reshape(2, -1) for i in sorted(found)], axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1], n


def lookup(ascending: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, which of the wanted are there) in an ascending array."""
    if not len(ascending):
        return np.zeros(0, np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ascending, wanted), len(ascending) - 1)
    hit = ascending[at] == wanted
    return at[hit], hit


def most_frequent(df: DataFrame, text: str, low: int, high: int, size: int, least_docs: int, capacity: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes, documents of each, documents in all): the ``size`` n-grams that occur most among those in
    ``least_docs`` documents, the most frequent first, of equal ones the smaller code.  Always exact."""
    capacity = capacity or max(CAPACITY, 2 * size)
    while True:
        found = summary(df, text, low, high, capacity)
        times, docs, n = exact_counts(df, text, low, high, found.codes)
        order = np.lexsort((found.codes, -times))
        order = order[docs[order] >= least_docs][:size]
        # What the summary hasn't got occurs no more often than it lost.
        least = times[order[-1]] if len(order) == size else max(least_docs, 1)
        if found.lost < least:
            return found.codes[order], docs[order], n
        capacity *= max(2, -(-found.lost // max(int(least), 1)))


def vectors(df: DataFrame, text: str, out: str, low: int, high: int, vocabulary: np.ndarray, weights: np.ndarray) -> DataFrame:
    """Adds ``out``, unit vectors of (1 + ln n) * weight over the vocabulary; texts without any of it have none."""
    from pyspark.ml.linalg import VectorUDT

    small_batches(df.sparkSession)
    order = np.argsort(vocabulary)
    sent = df.sparkSession.sparkContext.broadcast((vocabulary[order], order, weights))
    place, size = df.columns.index(text), len(vocabulary)

    def make(batches):
        import pyarrow as pa

        ascending, number, weight = sent.value
        for part in parts_of(batches, ROWS, BYTES):
            if part.num_rows:
                at, values, ends = [], [], [0]
                for t in part.column(place).to_pylist():
                    found, times = np.unique(codes(t, low, high), return_counts=True)
                    where, hit = lookup(ascending, found)
                    where = number[where]
                    value = (1 + np.log(times[hit])) * weight[where]
                    sorted_ = np.argsort(where)
                    at.append(where[sorted_].astype(np.int32))
                    values.append(value[sorted_] / max(float(np.sqrt(value @ value)), 1e-300))
                    ends.append(ends[-1] + len(where))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), kind)) for x, kind in ((at, pa.int32()), (values, pa.float64()))]
                made = pa.StructArray.from_arrays([pa.array(np.zeros(len(at), np.int8)), pa.array(np.full(len(at), size, np.int32)), *lists], names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])

    return df.mapInArrow(make, StructType([*df.schema.fields, StructField(out, VectorUDT())]))

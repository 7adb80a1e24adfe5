"""Packing documents into training sequences by lexical retrieval.

Documents are ordered by their most telling terms (by count times inverse document frequency over the corpus),
so that those with the same subject stand together, and cut into shards of ``SHARD_DOCS``: the order alone decides,
not the number of tasks or of the session's partitions.  A shard has a BM25
inverted index over the token ids of its whole documents, with document frequencies and mean length of the whole
corpus.  Full windows of a document become sequences as they are; what is left of it (less than a window) is
packed: a seed opens a window, the index ranks the shard's unused documents against it, and the best ones fill
the window in turn.  The last one is cut where the window ends and its rest is the next seed.  A shard's last
window is cut into sequences of powers of two, so there is no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from scrivenry.llm.common import claim, parts, small_batches, stored, trimmed, width_for
from scrivenry.llm.encoding import Encoder

WINDOW, SHARD_DOCS = 1024, 2000
#: Terms of a document that place it, shards in a task, and most tasks (more documents: more shards in each).
TELLING, TASK_SHARDS, TASKS = 4, 2, 20_000
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Corpus:
    """What BM25 needs of all documents: their number, their mean length, and each token's document frequency."""

    n: int
    mean: float
    frequency: np.ndarray


class Index:
    """BM25 over a shard, by the statistics of a corpus (its own if none is given).  A term in half of the corpus'
    documents or more weighs nothing and has no postings."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], corpus: Corpus | None = None):
        n = len(terms)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        term, count = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float64)
        size = np.bincount(doc, count, minlength=n)
        corpus = corpus or Corpus(n, size.mean(), np.bincount(term))
        weight = np.maximum(0.0, np.log((corpus.n - corpus.frequency + 0.5) / (corpus.frequency + 0.5)))[term]
        kept = weight > 0
        doc, term, count, weight = doc[kept], term[kept], count[kept], weight[kept]
        value = weight * count * (K1 + 1) / (count + (K1 * (1 - B + B * size / max(corpus.mean, 1e-9)))[doc])
        there = np.bincount(term) > 0
        term = (np.cumsum(there) - 1)[term] if len(term) else term
        most = int(there.sum())
        order = np.argsort(term.astype(np.uint16) if most <= 1 << 16 else term, kind="stable")  # by radix, of short ones
        # The postings of all terms one after another, and where each term's begin and end.
        self.n, self.docs, self.values = n, doc[order], value[order]
        self.ends = np.append(0, np.cumsum(np.bincount(term, minlength=most))).tolist()
        self.own = [t.tolist() for t in np.split(term, np.cumsum(np.bincount(doc, minlength=n))[:-1])]

    def without(self, used: np.ndarray) -> None:
        """Drop the postings of documents that are used up; their scores are 0 from then on."""
        kept = ~used[self.docs]
        self.docs, self.values = self.docs[kept], self.values[kept]
        self.ends = np.append(0, np.cumsum(kept))[self.ends].tolist()

    def scores(self, doc: int) -> np.ndarray:
        """Of all documents against the distinct terms of one."""
        terms = self.own[doc]
        if not terms:
            return np.zeros(self.n)
        own = [(self.ends[t], self.ends[t + 1]) for t in terms]
        return np.bincount(np.concatenate([self.docs[i:j] for i, j in own]), np.concatenate([self.values[i:j] for i, j in own]), minlength=self.n)


def fill(index: Index, rest: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, from, length) over the rest of each document; all but the last are full."""
    used = np.array([r == 0 for r in rest])
    out: list[list[tuple[int, int, int]]] = []
    following, seed, at, held = 0, -1, 0, len(rest)
    while True:
        if (left := len(rest) - int(used.sum())) < 0.9 * held:  # lists get shorter as documents are used
            index.without(used)
            held = left
        if seed < 0:
            while following < len(rest) and used[following]:
                following += 1
            if following == len(rest):
                return out
            seed, at = following, 0
            used[seed] = True
        pieces, room = [], window
        take = min(room, rest[seed] - at)
        pieces.append((seed, at, take))
        room, at = room - take, at + take
        scores = None
        while room:
            if scores is None:
                scores = index.scores(seed)
                scores[used] = -1.0
            best = int(scores.argmax())  # of equal ones the first; those without a shared term come last
            if scores[best] < 0:
                break
            used[best], scores[best] = True, -1.0
            take = min(room, rest[best])
            pieces.append((best, 0, take))
            room -= take
            if take < rest[best]:
                following_seed, following_at = best, take
                break
        else:
            best = -1
        out.append(pieces)
        if room == 0 and len(pieces) > 1 and pieces[-1][2] < rest[pieces[-1][0]]:
            seed, at = following_seed, following_at
        elif at < rest[seed]:
            continue  # the seed itself goes on
        else:
            seed = -1


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window cut into sequences whose lengths are its powers of two, the largest first."""
    total, out, pieces = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        room, own = total & 1 << bit, []
        while room:
            doc, at, n = pieces.pop()
            take = min(n, room)
            own.append((doc, at, take))
            room -= take
            if take < n:
                pieces.append((doc, at + take, n - take))
        if own:
            out.append(own)
    return out


def _ids(data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(data, "<u4" if wide else "<u2")


def statistics(counted: DataFrame) -> Corpus:
    """Of all documents, from rows (term, n) of parts of them; term -2 has documents and -1 ids.  A number for each
    token of the vocabulary comes to the driver."""
    found = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = found.pop(-2, 0), found.pop(-1, 0)
    frequency = np.zeros(max(found, default=0) + 1, np.int64)
    frequency[list(found)] = list(found.values())
    return Corpus(n, total / max(n, 1), frequency)


def places(terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The place of each document in the order of subjects: its ``TELLING`` terms with the most weight (of equal
    weights the smaller term), 16 bits each.  terms: ascending, one at least."""
    sizes = np.array([len(t) for t in terms])
    begin, every = np.cumsum(sizes) - sizes, np.concatenate(terms).astype(np.int64)
    weight, number = idf[every].astype(np.float64) * np.concatenate(counts), np.arange(len(every))
    out = np.zeros(len(terms), np.int64)
    for i in range(TELLING):
        most = np.maximum.reduceat(weight, begin)
        first = np.minimum.reduceat(np.where(weight == np.repeat(most, sizes), number, len(every)), begin)
        out = out << 16 | np.where(sizes > i, every[first] * 65536 // max(len(idf), 65536), 0)
        weight[first] = -1.0
    return out ^ np.int64(-1 << 63)


def place(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> int:
    return int(places([terms], [counts], idf)[0])


def shards(batches, size: int) -> Iterator[tuple[int, list[tuple]]]:
    """(task, rows) of sorted rows (task, ...), ``size`` at a time; none has rows of two tasks."""
    held: list[tuple] = []
    own = None
    for b in parts(batches):
        for task, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and (len(held) == size or task != own):
                yield own, held
                held = []
            own = task
            held.append(row)
    if held:
        yield own, held


def order_cuts(keys: DataFrame, step: int) -> list[tuple]:
    """Every ``step``th row of ``keys`` in the order of its columns, the first left out.  Rows are counted in ranges
    of the order; a number for each range and the rows themselves are all that comes to the driver."""
    names = keys.columns
    width = width_for(keys.sparkSession, 0, 1)
    ranged = keys.repartitionByRange(width, *names).sortWithinPartitions(*names).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "order")
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    begin, at = {}, 0
    for k in sorted(sizes):
        begin[k], at = at, at + sizes[k]

    def pick(batches):
        import pyarrow as pa

        own, at = None, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[-1] != own:
                    own, at = row[-1], begin[row[-1]]
                if at and at % step == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row[:-1]], names=names)
                at += 1

    found = ranged.repartition(width, "range").sortWithinPartitions("range", *names).mapInArrow(pick, ranged.drop("range").schema)
    return sorted(tuple(r) for r in found.collect())


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids and ``end_id`` lie in exactly one piece each; null or empty text: only ``end_id``.
    Null doc_id: packed, shown as null.  Repeated rows are packed each; equal places are ordered by a hash of the
    row, so rows of one doc_id, or without one, are dealt like any others.  Other columns are not read.  An empty
    table gives no piece.  What is left of each document, the counts of its ids and four bytes for each of its
    full windows are stored once and moved by one exchange, after the places alone were put in order and cut at every
    ``shard_docs``th; a task holds one shard at a time.  The shards, and so the sequences, are the same however many
    partitions the session has.
    """

    def encode(batches):
        import pyarrow as pa

        encoder = Encoder.of(tokenizer)
        end = np.array([end_id], "<u4")
        n = total = 0
        frequency = np.zeros(max(encoder.library.get_vocab_size(), end_id + 1), np.int64)
        names = ["doc_id", "n", "crcs", "rest", "terms", "counts", "wide", "kind"]
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.int32())
        for b in parts(batches, 2048, 8 << 20):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.column(b.column(1)), strict=True):
                ids = np.append(ids, end)
                terms, counts = np.unique(ids, return_counts=True)
                frequency[terms] += 1
                n, total, full = n + 1, total + len(ids), len(ids) // window * window
                crcs = [zlib.crc32(ids[i : i + window]) for i in range(0, full, window)]
                wide = int(terms[-1]) >= 1 << 16 or int(counts.max()) >= 1 << 16
                small = "<u4" if wide else "<u2"
                rows.append((doc_id, len(ids), np.array(crcs, "<u4").tobytes(), ids[full:].astype(small).tobytes(), terms.astype(small).tobytes(), counts.astype(small).tobytes(), wide, 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            trimmed()
        found = frequency.nonzero()[0]
        terms, counts = np.append([-2, -1], found), np.append([n, total], frequency[found])
        empty = pa.nulls(len(terms), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts, pa.int64()), empty, empty, empty, empty, pa.nulls(len(terms), pa.bool_()), pa.array(np.ones(len(terms)), pa.int32())], names=names)

    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n long, crcs binary, rest binary, terms binary, counts binary, wide boolean, kind int"
    every = stored(read.mapInArrow(encode, schema), "packing")
    encoded = every.where("kind = 0").drop("kind")
    corpus = statistics(every.where("kind = 1").select(F.col("doc_id").alias("term"), "n"))
    idf = np.maximum(0.0, np.log((corpus.n - corpus.frequency + 0.5) / (corpus.frequency + 0.5))).astype(np.float32)

    def placed(batch):
        terms, counts, wide = (batch.column(batch.schema.names.index(n)).to_pylist() for n in ("terms", "counts", "wide"))
        return places([_ids(t, w) for t, w in zip(terms, wide, strict=True)], [_ids(c, w) for c, w in zip(counts, wide, strict=True)], idf)

    def keys(batches):
        import pyarrow as pa

        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(placed(b)), b.column(0), b.column(1)], names=["place", "tie", "row"])

    def fill_shards(batches):
        import pyarrow as pa

        claim("shards", lambda: None)  # the encoder goes
        last, sequence = None, 0
        for task, members in shards(batches, shard_docs):
            if task != last:
                last, sequence = task, task << 40
            rows, rests = [], []
            for doc_id, n, crcs, rest, _, _, wide in members:
                own = np.frombuffer(crcs, "<u4")
                for w, crc in enumerate(own.tolist()):
                    rows.append((doc_id, w * window, window, crc, n, sequence, 0))
                    sequence += 1
                rests.append(_ids(rest, wide).astype("<u4"))
            index = Index([_ids(m[4], m[6]) for m in members], [_ids(m[5], m[6]) for m in members], corpus)
            windows = fill(index, [len(r) for r in rests], window)
            if windows and sum(p[2] for p in windows[-1]) < window:
                windows += powers(windows.pop())
            for pieces in windows:
                offset = 0
                for d, at, n in pieces:
                    total = members[d][1]
                    rows.append((members[d][0], total - len(rests[d]) + at, n, zlib.crc32(rests[d][at : at + n]), total, sequence, offset))
                    offset += n
                sequence += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
            del index, rests, rows
            trimmed()

    own = encoded.columns
    # Rows that are equal in everything are told apart by where they are stored; which is which makes no difference.
    keyed = encoded.select(F.xxhash64("doc_id", "n", "crcs", "rest").alias("tie"), F.monotonically_increasing_id().alias("row"), *own)
    task_docs = shard_docs * max(TASK_SHARDS, -(-corpus.n // (shard_docs * TASKS)))
    light = keyed.select("tie", "row", "terms", "counts", "wide").mapInArrow(keys, "place long, tie long, row long")
    cuts = order_cuts(light, task_docs)

    def assigned(batches):
        import pyarrow as pa

        for b in parts(batches):
            where = placed(b).tolist()
            at = zip(where, b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            task = pa.array([bisect_right(cuts, k) for k in at], pa.int32())
            yield pa.RecordBatch.from_arrays([task, pa.array(where, pa.int64()), *b.columns], names=["task", "place", *b.schema.names])

    dealt = keyed.mapInArrow(assigned, StructType([StructField("task", IntegerType()), StructField("place", LongType()), *keyed.schema.fields]))
    dealt = dealt.repartitionById(len(cuts) + 1, "task").sortWithinPartitions("task", "place", "tie", "row")
    return dealt.select("task", *own).mapInArrow(fill_shards, SCHEMA)

"""Token ids in Simple-8b files: word-aligned blocks with escapes and per-block offsets.

A 64-bit word holds a 4-bit selector above 60 bits of payload.  Selectors 2 to 15 pack as many ids as the
selector's width allows; selector 1 is a run of one id (28 bits of count above 32 of value); selector 0 is
an escape, its payload the place in the block's list of ids that are too wide.  A block starts anew every
``BLOCK_IDS`` ids and says how many words and escapes it has, so blocks decode apart from each other and,
inside, all words of one selector decode in one step.

File: blocks; documents (doc_id, ids in the file before it, ids, below 0 where there is no doc_id); block table (ids before it, byte offset);
trailer (ids, documents, blocks, crc32 of the two tables, magic).
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivenry.llm.common import AtomicFile, open_fs, parts, scratch, small_batches, width_for
from scrivenry.llm.encoding import Encoder

BLOCK_IDS = 1 << 16
#: Bytes of text in a file, and what a document counts beside its text, as its entry in the table takes memory.
FILE_BYTES, ENTRY_BYTES = 256 << 20, 512
MAGIC = b"S8BTOKN1"
#: selector -> (ids in a word, bits of each)
PACKED = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
RUN, ESCAPE, RUN_LEAST = 1, 0, 61
_TRAILER = struct.Struct("<QQQI8s")


def _bits(ids: np.ndarray) -> np.ndarray:
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)  # exact for 32-bit ids; 0 for 0


def encode_block(ids: np.ndarray) -> bytes:
    """At most ``BLOCK_IDS`` unsigned 32-bit ids as a block."""
    n = len(ids)
    width = _bits(ids)
    fit = np.zeros(n, np.uint8)  # the selector at each place, were a word to begin there
    most, have = width.copy(), 1  # the widest of the next `have` ids
    for selector in range(15, 1, -1):
        count, bits = PACKED[selector]
        while have < count:
            step = min(have, count - have)
            if step < n:
                most[: n - step] = np.maximum(most[: n - step], most[step:])
            have += step
        if count <= n:
            ok = most[: n - count + 1] <= bits
            fit[: n - count + 1][ok] = selector
    fit[width > 30] = ESCAPE
    run = np.ones(n, np.int64)
    change = np.flatnonzero(np.diff(ids)) + 1
    ends = np.append(change, n)
    run = np.repeat(ends, np.diff(np.append(np.append(0, change), n))) - np.arange(n)
    fit[run >= RUN_LEAST] = RUN
    counts = np.array([1, 0, *(PACKED[s][0] for s in range(2, 16))])
    step = np.where(fit == RUN, run, counts[fit]).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    kinds = fit[starts] if n else np.zeros(0, np.uint8)
    words = kinds.astype(np.uint64) << np.uint64(60)
    escapes = ids[starts[kinds == ESCAPE]].astype("<u4")
    words[kinds == ESCAPE] |= np.arange(len(escapes), dtype=np.uint64)
    own = starts[kinds == RUN]
    words[kinds == RUN] |= (run[own].astype(np.uint64) << np.uint64(32)) | ids[own].astype(np.uint64)
    for selector, (count, bits) in PACKED.items():
        own = np.flatnonzero(kinds == selector)
        if len(own):
            values = ids[starts[own][:, None] + np.arange(count)].astype(np.uint64)
            words[own] |= np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    return struct.pack("<III", n, len(words), len(escapes)) + words.astype("<u8").tobytes() + escapes.tobytes()


def decode_block(data: bytes, at: int = 0) -> np.ndarray:
    """The ids of the block that begins at byte ``at``; all words of a selector at a time."""
    n, n_words, n_escapes = struct.unpack_from("<III", data, at)
    words = np.frombuffer(data, "<u8", n_words, at + 12)
    escapes = np.frombuffer(data, "<u4", n_escapes, at + 12 + 8 * n_words)
    kinds = (words >> np.uint64(60)).astype(np.uint8)
    payload = words & np.uint64((1 << 60) - 1)
    counts = np.array([1, 0, *(PACKED[s][0] for s in range(2, 16))])[kinds]
    counts[kinds == RUN] = (payload[kinds == RUN] >> np.uint64(32)).astype(np.int64)
    starts = np.cumsum(counts) - counts
    out = np.empty(n, np.uint32)
    for selector, (count, bits) in PACKED.items():
        own = np.flatnonzero(kinds == selector)
        if len(own):
            mask = np.uint64((1 << bits) - 1)
            out[starts[own][:, None] + np.arange(count)] = (payload[own][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & mask
    for k in np.flatnonzero(kinds == RUN):
        out[starts[k] : starts[k] + counts[k]] = payload[k] & np.uint64(0xFFFFFFFF)
    own = np.flatnonzero(kinds == ESCAPE)
    out[starts[own]] = escapes[payload[own].astype(np.int64)]
    return out


class TokenFile:
    """Writes a shard: documents one after another, ids in blocks."""

    def __init__(self, out):
        self.out, self.waiting, self.n_waiting = out, [], 0
        self.at = self.n_ids = self.n_blocked = 0
        self.docs, self.blocks = array("q"), array("q")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """ids: one at least, as a document without an id shows by the sign of their number."""
        self.docs.extend((doc_id or 0, self.n_ids, -len(ids) if doc_id is None else len(ids)))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            data = encode_block(ids[i : min(i + BLOCK_IDS, whole)])
            self.blocks.extend((self.n_blocked, self.at))
            self.out.write(data)
            self.at += len(data)
            self.n_blocked += min(BLOCK_IDS, whole - i)
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._blocks(True)
        tables = np.array(self.docs, "<i8").tobytes() + np.array(self.blocks, "<i8").tobytes()
        self.out.write(tables + _TRAILER.pack(self.n_ids, len(self.docs) // 3, len(self.blocks) // 2, zlib.crc32(tables), MAGIC))


def read_documents(uri: str) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
    """(doc_id or None, ids in the file before it, parts of its ids) of each document of a shard, in its order.
    The parts of a document must be taken before the next document is; a block is in memory at a time."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - _TRAILER.size)
        n_ids, n_docs, n_blocks, crc, magic = _TRAILER.unpack(f.read(_TRAILER.size))
        begin = size - _TRAILER.size - 24 * n_docs - 16 * n_blocks
        f.seek(begin)
        tables = f.read(size - _TRAILER.size - begin)
        if magic != MAGIC or zlib.crc32(tables) != crc:
            raise ValueError(f"{uri} is not a whole token file")
        docs = np.frombuffer(tables, "<i8", 3 * n_docs).reshape(-1, 3)
        blocks = np.frombuffer(tables, "<i8", 2 * n_blocks, 24 * n_docs).reshape(-1, 2)
        offsets = np.append(blocks[:, 1], begin)
        held, ids = -1, np.zeros(0, np.uint32)

        def parts(at: int, end: int) -> Iterator[np.ndarray]:
            nonlocal held, ids
            while at < end:
                k = int(np.searchsorted(blocks[:, 0], at, side="right")) - 1
                if k != held:
                    f.seek(int(offsets[k]))
                    held, ids = k, decode_block(f.read(int(offsets[k + 1] - offsets[k])))
                first = int(blocks[k, 0])
                part = ids[at - first : end - first]
                yield part
                at += len(part)

        for doc_id, at, n in docs.tolist():
            yield None if n < 0 else doc_id, at, parts(at, at + abs(n))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order as Simple-8b files.

    Null or empty text: only ``end_id``.  Null doc_id: first, shown as null again by the reader.  Repeated
    doc_ids are all written, in the order of a hash of their texts; other columns, whatever their names, are
    not read.  An empty table gives empty files.  Returns the manifest: shard, path, n_docs, n_ids, start (ids
    in all shards before it), as a DataFrame of one row for each file.

    One shuffle, by ranges of doc_id and that hash (rows of one doc_id, or without one, are cut too), moves each
    text once; a task writes one file of about ``FILE_BYTES`` as it encodes, so its memory is a batch of texts
    and a table of documents that the size bounds.  Only the manifest comes to the driver: a row for each file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "tokens")
    if not shards:
        size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ENTRY_BYTES), F.lit(0))).first()[0]
        shards = width_for(spark, size, FILE_BYTES)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    placed = placed.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, encoder, end = TaskContext.get().partitionId(), Encoder.of(tokenizer), np.array([end_id], "<u4")
        uri = f"{folder}/shard-{shard:06d}.s8b"
        with AtomicFile(uri) as out:
            file = TokenFile(out)
            for b in parts(batches, 2048, 8 << 20):
                for doc_id, ids in zip(b.column(0).to_pylist(), encoder.column(b.column(1)), strict=True):
                    file.add(doc_id, np.append(ids, end))
            file.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "n_docs": [len(file.docs) // 3], "n_ids": [file.n_ids]})

    made = sorted(placed.mapInArrow(write, "shard long, path string, n_docs long, n_ids long").collect())
    starts = np.cumsum([0, *(r.n_ids for r in made)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(made, starts, strict=False)], "shard long, path string, n_docs long, n_ids long, start long")


def read_tokens(manifest: DataFrame, files: int | None = None) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.  A task for each file.  Documents written
    without doc_id have none; a manifest or file without documents gives no row; columns of the manifest beside
    path and start are not read.  A file that isn't whole is an error."""

    def read(batches):
        import pyarrow as pa

        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, at, parts in read_documents(path):
                    n = crc = 0
                    for part in parts:
                        n, crc = n + len(part), zlib.crc32(part.astype("<u4", copy=False), crc)
                    rows.append((doc_id, start + at, n, crc))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    files = files or max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

A line's key is the 128-bit hash of the line without white space at both ends and with A-Z in lower case; lines
shorter than ``chars`` code points have none.  The index keeps three tables in a shared folder:

* references (hi, lo, doc_id): one row for each key in each document, in generations, with the ids removed since;
* counts (hi, lo, docs, newest): how many documents hold a key, and the largest id of them;
* filters (shard, data): for each shard of the keys a cuckoo filter of those that ``copies`` documents hold.

Adding documents and removing them moves counts up and down, and a key that passes the limit either way enters or
leaves its shard's filter.  To find what a document loses, its keys go to their shard, most end at the filter, and
the rest are looked up in the exact counts: a line stays in the newest document that holds it.
"""

from __future__ import annotations

import json
import posixpath
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivenry.llm.common import AtomicFile, claim, forgotten, open_fs, parts, scratch, small_batches, stored, width_for

#: Least code points of a line that has a key, and documents that must hold it before copies are dropped.
CHARS, COPIES = 20, 3
#: Keys of a shard's filter, references of a task, and the most keys that count as hot: each of them has at least
#: one in so many of all references, so no more than that many exist, and they are sent to all tasks.
SHARD_KEYS, TASK_REFS, HOT = 1 << 19, 1_000_000, 1000
SPACE = " \t\n\x0b\x0c\r"


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: buckets of four fingerprints of 16 bits, two buckets for each key."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) - 1)

    @classmethod
    def of_size(cls, keys: int) -> Cuckoo:
        buckets = 1
        while buckets * 4 * 0.8 < keys:
            buckets *= 2
        return cls(np.zeros((buckets, 4), np.uint16))

    @classmethod
    def of_bytes(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, 4).copy())

    def tobytes(self) -> bytes:
        return self.table.tobytes()

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        step = (print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return bucket ^ (step & self.mask)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (keys >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        bucket = keys & self.mask
        return print_, bucket, self._other(bucket, print_)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be there; never false for one that is."""
        print_, one, two = self._places(keys)
        return (self.table[one] == print_[:, None]).any(1) | (self.table[two] == print_[:, None]).any(1)

    def add(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """Put in keys that aren't there, all of them at once: each takes a free place in its bucket, else one of
        each bucket drives another print out and the rest go to their second bucket.  False: no room for all."""
        print_, bucket, _ = self._places(keys)
        for turn in range(rounds):
            if not len(bucket):
                return True
            order = np.argsort(bucket, kind="stable")
            bucket, print_ = bucket[order], print_[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            free = np.cumsum(self.table[bucket] == 0, axis=1)
            fits = free[:, 3] > rank
            self.table[bucket[fits], (free[fits] == rank[fits, None] + 1).argmax(1)] = print_[fits]
            bucket, print_ = bucket[~fits], print_[~fits]
            if turn and len(bucket):
                first = np.append(True, bucket[1:] != bucket[:-1])
                slot = ((bucket[first] + np.uint64(turn)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(62)).astype(np.int64)
                out = self.table[bucket[first], slot]
                self.table[bucket[first], slot], print_[first] = print_[first], out
            bucket = self._other(bucket, print_)
        return not len(bucket)

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were put in, one print for each."""
        print_, one, two = self._places(keys)
        while len(print_):
            flat = np.full(len(print_), -1, np.int64)
            for bucket in (two, one):
                match = self.table[bucket] == print_[:, None]
                flat = np.where(match.any(1), bucket.astype(np.int64) * 4 + match.argmax(1), flat)
            if (flat < 0).any():
                raise ValueError("a key that was never put in")
            _, first = np.unique(flat, return_index=True)  # of equal prints each takes a place of its own
            self.table.reshape(-1)[flat[first]] = 0
            left = np.ones(len(print_), bool)
            left[first] = False
            print_, one, two = print_[left], one[left], two[left]


def keys(texts, chars: int = CHARS):
    """(row, hi, lo, n_lines) of an Arrow column of texts: the row, and the halves of the key, of each line with a
    key, and the number of lines in each text."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh3_128_digest

    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    own, n_lines = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=SPACE)), pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    long = pc.greater_equal(pc.utf8_length(own), chars).to_numpy(zero_copy_only=False)
    digests = np.frombuffer(b"".join([xxh3_128_digest(t) for t in own.filter(pa.array(long)).cast(pa.large_binary()).to_pylist()]), ">i8").astype(np.int64).reshape(-1, 2)
    return np.flatnonzero(long), digests[:, 0], digests[:, 1], n_lines


def references(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """hi, lo, doc_id: each key of each document once, also where rows of one doc_id share it."""

    def make(batches):
        import pyarrow as pa

        claim("lines", lambda: None)
        for b in parts(batches):
            line, hi, lo, n_lines = keys(b.column(1), chars)
            row = np.repeat(np.arange(b.num_rows), n_lines)[line]
            _, first = np.unique(np.rec.fromarrays([row, hi, lo]), return_index=True)
            ids = b.column(0).take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays([pa.array(hi[first], pa.int64()), pa.array(lo[first], pa.int64()), ids], names=["hi", "lo", "doc_id"])

    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(make, "hi long, lo long, doc_id long").distinct()


def _runs(batches, columns: int):
    """(key, arrays of the other columns) of rows sorted by their first column, a batch's worth at a time."""
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False)
        at = [*np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist(), len(key)] if len(key) else [0]
        for i, j in zip(at[:-1], at[1:], strict=True):
            part = b.slice(i, j - i)
            yield int(key[i]), [part.column(c) for c in range(1, columns)]


class LineIndex:
    """Lines of a corpus in a folder that driver and executors share (``path``; made there by the first ``add``).

    A change writes new tables and then the name of its state in ``CURRENT``, by rename: one that stops halfway
    leaves the state before.  Changes must come one after another.
    """

    def __init__(self, spark: SparkSession, path: str, chars: int = CHARS, copies: int = COPIES):
        if chars < 1 or copies < 2:
            raise ValueError("a key has one code point at least, and a copy is in two documents")
        self.spark, self.path, self.chars, self.copies = spark, path.rstrip("/"), chars, copies

    # State

    def state(self) -> dict:
        fs, path = open_fs(f"{self.path}/CURRENT")
        if fs.get_file_info(path).is_file:
            with fs.open_input_stream(path) as f:
                return json.loads(f.read())
        return {"generation": 0, "references": [], "removed": [], "counts": None, "filters": None, "shards": 1}

    def _commit(self, state: dict) -> None:
        with AtomicFile(f"{self.path}/CURRENT") as f:
            f.write(json.dumps(state | {"generation": state["generation"] + 1}).encode())

    def _write(self, df: DataFrame, name: str) -> str:
        path = posixpath.join(self.path, f"{name}-{uuid.uuid4().hex[:12]}")
        df.write.option("compression", "lz4").parquet(path)
        return path

    def _read(self, path: str | None, schema: str) -> DataFrame:
        if path:
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.range(1).where("false").select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))])

    def references(self, state: dict | None = None) -> DataFrame:
        """hi, lo, doc_id of all documents that are in the index."""
        state = state or self.state()
        live = self._read(None, "hi long, lo long, doc_id long")
        for generation, path in state["references"]:
            own = self._read(path, "hi long, lo long, doc_id long")
            for later, gone in state["removed"]:
                if later > generation:
                    own = own.join(self._read(gone, "doc_id long"), "doc_id", "left_anti")
            live = live.unionByName(own)
        return live

    def counts(self, state: dict | None = None) -> DataFrame:
        """hi, lo, docs, newest: the exact reference counts."""
        return self._read((state or self.state())["counts"], "hi long, lo long, docs long, newest long").where("docs > 0")

    # Changes

    def add(self, docs: DataFrame) -> None:
        """Add the lines of ``docs`` (doc_id, text).  Lines that the index knows of a document already add nothing,
        so adding twice is adding once.  Rows without doc_id are one document, older than all others; an empty table
        changes no count."""
        state, new = self.state(), references(docs, self.chars)
        if state["references"]:
            there = self.references(state)
            new = new.join(there, (new.hi == there.hi) & (new.lo == there.lo) & new.doc_id.eqNullSafe(there.doc_id), "left_anti")
        path = self._write(new, "references")
        delta = self._read(path, "hi long, lo long, doc_id long").groupBy("hi", "lo").agg(F.count("*").alias("docs"), F.max("doc_id").alias("newest"))
        state["references"].append([state["generation"], path])
        self._change(state, delta)

    def remove(self, ids: DataFrame) -> None:
        """Remove documents by doc_id; their lines no longer count, and copies that were dropped for them come back.
        Ids that aren't in the index, null and repeated ones change nothing."""
        state = self.state()
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        path = self._write(ids, "removed")
        gone = self.references(state).join(self._read(path, "doc_id long"), "doc_id", "left_semi")
        delta = gone.groupBy("hi", "lo").agg((-F.count("*")).alias("docs"), F.lit(None).cast("long").alias("newest"))
        state["removed"].append([state["generation"], path])
        self._change(state, delta, gone.select("hi", "lo").distinct())

    def _change(self, state: dict, delta: DataFrame, touched: DataFrame | None = None) -> None:
        before = self.counts(state)
        rows = before.select("*", F.col("docs").alias("was")).unionByName(delta.withColumn("was", F.lit(0).cast("long")))
        after = rows.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.max("newest").alias("newest"), F.sum("was").alias("was")).where("docs > 0 or was > 0")
        if touched is not None:  # the newest holder may be gone
            left = self.references(state).join(touched, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.max("doc_id").alias("now"), F.lit(True).alias("again"))
            after = after.join(left, ["hi", "lo"], "left").withColumn("newest", F.when(F.col("again"), F.col("now")).otherwise(F.col("newest")))
            after = after.select("hi", "lo", "docs", "newest", "was")
        path = self._write(after, "changed")
        changed = self._read(path, "hi long, lo long, docs long, newest long, was long")
        repeated = changed.where(F.col("docs") >= self.copies)
        state["counts"] = path
        need = max(1, -(-repeated.count() // SHARD_KEYS))
        if state["filters"] is None or need > state["shards"] or not self._moved(state, changed):
            while state["shards"] < need:
                state["shards"] *= 2
            while not self._moved(state | {"filters": None}, repeated.withColumn("was", F.lit(0).cast("long")), state):
                state["shards"] *= 2
        self._commit(state)

    def _moved(self, state: dict, changed: DataFrame, into: dict | None = None) -> bool:
        """Write the filters with the keys that passed the limit; False if one of them has no room."""
        into = into if into is not None else state
        shard, up, down = self._shard(state), f"docs >= {self.copies} and was < {self.copies}", f"docs < {self.copies} and was >= {self.copies}"
        moves = changed.where(f"({up}) or ({down})").select(shard.alias("shard"), F.expr(f"IF({up}, 2, 1)").alias("kind"), "lo", F.lit(None).cast("binary").alias("data"))
        old = self._read(state["filters"], "shard int, data binary").select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("lo"), "data")

        def move(batches):
            import pyarrow as pa

            def done():
                if own is not None:
                    gone, new = (np.concatenate([np.zeros(0, np.int64), *m]).view(np.uint64) for m in (moved[1], moved[2]))
                    filter_ = Cuckoo.of_bytes(data) if data else Cuckoo.of_size(max(SHARD_KEYS // 64, 2 * len(new)))
                    filter_.remove(gone)
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([own], pa.int32()), "data": pa.array([filter_.tobytes() if filter_.add(new) else None], pa.binary())})

            own, data, moved = None, None, {}
            for shard, (kind, lo, blob) in _runs(batches, 4):
                if shard != own:
                    yield from done()
                    own, data, moved = shard, None, {1: [], 2: []}
                kind = kind.to_numpy(zero_copy_only=False)
                if kind[0] == 0:
                    data = blob[0].as_py()
                for k in (1, 2):
                    moved[k].append(lo.to_numpy(zero_copy_only=False)[kind == k])
            yield from done()

        dealt = moves.unionByName(old).repartition(min(state["shards"], 10_000), "shard").sortWithinPartitions("shard", "kind")
        path = self._write(dealt.mapInArrow(move, "shard int, data binary"), "filters")
        if not self._read(path, "shard int, data binary").where("data is null").isEmpty():
            return False
        into["filters"] = path
        return True

    def _shard(self, state: dict):
        return F.pmod(F.col("hi"), F.lit(state["shards"])).cast("int")

    # Answers

    def losses(self, refs: DataFrame | None = None) -> DataFrame:
        """doc_id, hi, lo: the keys whose lines each document loses, of the index's documents or of ``refs``."""
        state = self.state()
        counts = self.counts(state)
        held = counts if refs is None else refs.groupBy("hi", "lo").agg(F.count("*").alias("docs"))
        refs = refs if refs is not None else self.references(state)
        total = refs.count()
        repeated = counts.where(F.col("docs") >= self.copies).select("hi", "lo", "newest")
        hot = F.broadcast(repeated.join(held.where(F.col("docs") > total / HOT).select("hi", "lo"), ["hi", "lo"]))
        older = ~F.col("doc_id").eqNullSafe(F.col("newest"))
        common = refs.join(hot, ["hi", "lo"]).where(older).select("doc_id", "hi", "lo")
        null = lambda kind, name: F.lit(None).cast(kind).alias(name)
        shard = self._shard(state).alias("shard")
        rows = self._read(state["filters"], "shard int, data binary").select("shard", F.lit(0).alias("kind"), null("long", "hi"), null("long", "lo"), null("long", "id"), "data")
        rows = rows.unionByName(repeated.select(shard, F.lit(1).alias("kind"), "hi", "lo", F.col("newest").alias("id"), null("binary", "data")))
        rows = rows.unionByName(refs.join(hot, ["hi", "lo"], "left_anti").select(shard, F.lit(2).alias("kind"), "hi", "lo", F.col("doc_id").alias("id"), null("binary", "data")))

        def probe(batches):
            import pyarrow as pa

            own, filter_, held, exact = None, None, [], None
            for shard, (kind, *columns, blob) in _runs(batches, 6):
                if shard != own:
                    own, filter_, held, exact = shard, None, [], None
                kind = kind.to_numpy(zero_copy_only=False)
                if kind[0] == 0 and (data := blob[0].as_py()):
                    filter_ = Cuckoo.of_bytes(data)
                hi, lo = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in columns[:2])
                ids = columns[2]
                if (kind == 1).any():
                    held.append((hi[kind == 1], lo[kind == 1], ids.filter(pa.array(kind == 1))))
                asked = np.flatnonzero(kind == 2)
                if not len(asked) or filter_ is None or not held:
                    continue
                if exact is None:  # all of the shard's counts have come
                    at = np.lexsort((held_lo := np.concatenate([h[1] for h in held]), held_hi := np.concatenate([h[0] for h in held])))
                    table = np.rec.fromarrays([held_hi[at], held_lo[at]], names="hi,lo")
                    exact = table, pa.concat_arrays([h[2] for h in held]).take(pa.array(at))
                hit = asked[filter_.has(lo[asked].view(np.uint64))]
                place = _find(exact[0], hi[hit], lo[hit])
                hit, place = hit[place >= 0], place[place >= 0]
                mine, newest = ids.take(pa.array(hit)), exact[1].take(pa.array(place))
                lost = np.array([a != b for a, b in zip(mine.to_pylist(), newest.to_pylist(), strict=True)], bool)
                yield pa.RecordBatch.from_arrays([mine.filter(pa.array(lost)), pa.array(hi[hit[lost]], pa.int64()), pa.array(lo[hit[lost]], pa.int64())], names=["doc_id", "hi", "lo"])

        dealt = rows.repartition(max(state["shards"], width_for(self.spark, total, TASK_REFS)), "shard").sortWithinPartitions("shard", "kind")
        return common.unionByName(dealt.mapInArrow(probe, "doc_id long, hi long, lo long"))

    def cleaned(self, docs: DataFrame, indexed: bool = False) -> DataFrame:
        """Per row of ``docs`` (doc_id, text): doc_id, text (what is left), n_lines, n_dropped.

        A line stays in the document with the largest doc_id that the index knows to hold it, in all its rows and
        as often as it stands there, and goes from all others, also from those that aren't in the index.  indexed:
        ``docs`` are the index's documents, so their stored references are used.  Null or empty text: one empty line,
        which stays.  Rows without doc_id lose every line that enough documents hold.  Other columns are not read.
        """
        small_batches(self.spark)
        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        lost = self.losses(None if indexed else stored(references(docs, self.chars), "references"))
        lost = lost.groupBy("doc_id").agg(F.collect_list("hi").alias("hi"), F.collect_list("lo").alias("lo")).withColumnRenamed("doc_id", "of")
        rows = read.join(lost, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "hi", "lo")
        chars = self.chars

        def rewrite(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            claim("lines", lambda: None)
            for b in parts(batches):
                text = pc.fill_null(b.column(1), "")
                n_lines = pc.add(pc.count_substring(text, "\n"), 1)
                dropped = np.zeros(b.num_rows, np.int64)
                if len(some := np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False))):
                    out = text.to_pylist()
                    for i in some.tolist():
                        lines = out[i].split("\n")
                        line, hi, lo, _ = keys(b.column(1).slice(i, 1), chars)
                        gone = set(zip(b.column(2)[i].as_py(), b.column(3)[i].as_py(), strict=True))
                        drop = {n for n, *key in zip(line.tolist(), hi.tolist(), lo.tolist(), strict=True) if tuple(key) in gone}
                        out[i], dropped[i] = "\n".join([t for n, t in enumerate(lines) if n not in drop]), len(drop)
                    text = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), text, n_lines.cast(pa.int64()), pa.array(dropped)], names=["doc_id", "text", "n_lines", "n_dropped"])

        return rows.mapInArrow(rewrite, "doc_id long, text string, n_lines long, n_dropped long")


def _find(table: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The place of each key in a table sorted by its halves, -1 if it isn't there."""
    asked = np.rec.fromarrays([hi, lo], names="hi,lo")
    at = np.minimum(np.searchsorted(table, asked), len(table) - 1)
    return np.where((table.hi[at] == hi) & (table.lo[at] == lo), at, -1)


def deduplicated(docs: DataFrame, chars: int = CHARS, copies: int = COPIES) -> DataFrame:
    """``LineIndex.cleaned`` of documents by an index of themselves, in the session's shared folder; it is deleted
    when the application ends."""
    spark = docs.sparkSession
    index = LineIndex(spark, scratch(spark, "lines"), chars, copies)
    forgotten(spark, index.path)
    index.add(docs)
    return index.cleaned(docs, indexed=True)

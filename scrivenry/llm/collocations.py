"""Phrase collocations: exact counts in the slots of minimal perfect hashes.

Texts are read three times.  First each run of words is counted in a bucket of its hash; a bucket below the least
count holds nothing frequent.  Then the distinct phrases that may be frequent are listed: those whose bucket may be,
and whose two parts without the last and the first word may be.  By the Apriori rule nothing frequent is left out.  The candidates are dealt to
shards, and each shard gets a minimal perfect hash and the candidates' 128-bit keys in the order of its slots.
The third time mappers send each shard's keys to tasks that look up the slots, verify the stored keys and
``bincount`` into an array; the arrays are summed in a tree.  What a phrase is cut into is a candidate too, so cuts
are read by slot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.llm.common import Scratch, claim, open_fs, parts, small_batches, stored, width_for

#: Words of a phrase at most, its least count, per cent of it at which a longer phrase hides it, phrases a language.
LONGEST, LEAST, WITHIN, TOP = 3, 10, 50, 2000
#: Candidates of a shard, slots whose counts travel together, arrays summed by a node, keys that are held before
#: they are sent.
SLOTS, BLOCK, FAN_IN, HELD = 1 << 21, 1 << 16, 16, 2_000_000
#: Bits of a bucket's number, by the size of the corpus; the upper one bounds the table of 64 MB that a worker
#: holds, and where the corpus has many more words the buckets say less and more candidates are counted.
BITS, RANGE_BITS = (20, 29), 20
#: Exact for counts below 10^15.
SCORE = "CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(8,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
_MARK = re.compile(rb"[.,;:!?\x0a-\x0d]")
#: Every mark a line end, a tab a space.
_CUT = bytes.maketrans(b"\t.,;:!?\x0a\x0b\x0c\x0d", b" " + b"\n" * 10)
_HI, _LO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_tables: dict = {}


def _groups(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and how often it occurs."""
    order = np.argsort(hi)
    same, also = hi[order][1:] == hi[order][:-1], lo[order][1:] == lo[order][:-1]
    if (same & ~also).any():  # two keys share an upper half
        order = np.lexsort((lo, hi))
        same = (hi[order][1:] == hi[order][:-1]) & (lo[order][1:] == lo[order][:-1])
    begin = np.flatnonzero(np.append(True, ~same)) if len(hi) else np.zeros(0, np.int64)
    return order[begin], np.diff(np.append(begin, len(hi)))


def split_words(lang: str, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, keys, ids) of texts: the distinct words, the halves of their keys, and the number of the word at each
    place; word 0 is the mark between pieces and texts."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh3_128_digest

    data = b"\n".join(texts).lower().translate(_CUT).replace(b"\n", b" \n ")
    found = pc.split_pattern(pa.array([data], pa.large_binary()), " ").flatten().dictionary_encode()
    distinct, at = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)
    words, place = [b"\n"], np.zeros(len(distinct), np.int32)
    for i, word in enumerate(distinct):
        if word and word != b"\n":
            place[i] = len(words)
            words.append(word)
        elif not word:  # between two spaces
            place[i] = -1
    ids, own = place[at], lang.encode() + b" "
    keys = np.frombuffer(b"".join([xxh3_128_digest(own + w) for w in words]), np.uint64).reshape(-1, 2)
    return words, keys, ids[ids >= 0]


def stretches(texts: list[bytes], most: int = 4 << 20) -> Iterator[list[bytes]]:
    """Texts, the long ones in pieces that end at a mark, about ``most`` bytes at a time."""
    out, size = [], 0
    for text in texts:
        begin = 0
        while len(text) - begin > most and (mark := _MARK.search(text, begin + most)):
            yield [text[begin : mark.end()]]
            begin = mark.end()
        out.append(text[begin:])
        size += len(out[-1])
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def phrases(batches, longest: int) -> Iterator[tuple[str, list[bytes], np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(lang, words, ids, grams) of rows (lang, text): for n = 1, 2, ... whether n words of a piece begin at each
    place, and the halves of their key."""
    import pyarrow as pa

    claim("phrases", _tables.clear)
    for b in parts(batches, 2048, 8 << 20):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            texts.setdefault("und" if lang is None else lang, []).append(text or b"")
        for lang, all_ in texts.items():
            for own in stretches(all_):
                words, keys, ids = split_words(lang, own)
                yield lang, words, ids, grams(keys, ids, longest)


def grams(keys: np.ndarray, ids: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ok, hi, lo = ids > 0, keys[ids, 0], keys[ids, 1]
    out, first = [(ok, hi, lo)], (ok, hi, lo)
    for n in range(2, longest + 1):
        ok, hi, lo = (a[: len(ids) - n + 1] if len(ids) >= n else a[:0] for a in out[-1])
        last = [a[n - 1 :] for a in first]
        out.append((ok & last[0], _mix(hi * _HI + last[1]), _mix(lo * _LO + last[2])))
    return out


def bucket_bits(n_bytes: int) -> int:
    """About a bucket for each word, within ``BITS``."""
    return min(max((n_bytes // 6).bit_length(), BITS[0]), BITS[1])


def buckets(texts: DataFrame, bits: int, least: int, longest: int) -> DataFrame:
    """range, frequent (a bit for each of its buckets), and lang, words: the words of each language, in parts."""

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("range", pa.int32()), ("at", pa.binary()), ("n", pa.binary()), ("lang", pa.string()), ("words", pa.int64())])
        held, size, total = [], 0, {}

        def sent():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(found, (np.arange(1, (1 << bits - RANGE_BITS) + 1) << RANGE_BITS).astype(np.uint32))
            rows, begin = [], 0
            low, n = found & np.uint32((1 << RANGE_BITS) - 1), np.minimum(n, 255).astype(np.uint8)
            for i, end in enumerate(ends.tolist()):
                if end > begin:
                    rows.append((i, low[begin:end].tobytes(), n[begin:end].tobytes(), None, None))
                begin = end
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 64], strict=True), schema, strict=True)], schema=schema)

        for lang, _, ids, found in phrases(batches, longest):
            total[lang] = total.get(lang, 0) + int(np.count_nonzero(ids))
            for ok, hi, _ in found:
                held.append((hi[ok] >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(held[-1])
            if size > HELD:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()
        part = -1 - TaskContext.get().partitionId() % 64
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(total), pa.int32()), pa.nulls(len(total), pa.binary()), pa.nulls(len(total), pa.binary()), pa.array(list(total)), pa.array(list(total.values()), pa.int64())], schema=schema)

    def add(batches):
        import pyarrow as pa

        schema = pa.schema([("range", pa.int32()), ("frequent", pa.binary()), ("lang", pa.string()), ("words", pa.int64())])
        own, sums, total = None, None, {}

        def done():
            if own is not None and own >= 0:
                yield pa.RecordBatch.from_pylist([{"range": own, "frequent": np.packbits(sums >= least, bitorder="little").tobytes()}], schema=schema)

        for b in batches:
            for range_, at, n, lang, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if range_ != own:
                    yield from done()
                    own, sums = range_, np.zeros(1 << RANGE_BITS, np.uint32)
                if own < 0:
                    total[lang] = total.get(lang, 0) + words
                else:
                    sums[np.frombuffer(at, "<u4")] += np.frombuffer(n, np.uint8)
        yield from done()
        if total:
            yield pa.RecordBatch.from_pylist([{"range": -1, "lang": k, "words": v} for k, v in total.items()], schema=schema)

    least = min(least, 255)  # a task's counts of a bucket stop there
    counted = texts.mapInArrow(count, "range int, at binary, n binary, lang string, words long")
    width = min(width_for(texts.sparkSession, 1 << bits, 1 << 24), 1 << bits - RANGE_BITS)
    dealt = counted.repartition(width, "range").sortWithinPartitions("range")
    return stored(dealt.mapInArrow(add, "range int, frequent binary, lang string, words long"), "buckets", codec="zstd")


def _table(path: str, columns: list[str], **wanted):
    """Columns of a stored table, for workers: only rows with the wanted values."""
    import pyarrow.dataset as ds

    fs, place = open_fs(path)
    where = None
    for name, value in wanted.items():
        where = ds.field(name) == value
    return ds.dataset(place, filesystem=fs, format="parquet").to_table(columns=columns, filter=where)


class Frequent:
    """Which buckets may hold frequent phrases."""

    def __init__(self, path: str, bits: int):
        self.bits, self.map = bits, np.zeros(1 << bits - 3, np.uint8)
        found = _table(path, ["range", "frequent"])
        size = 1 << RANGE_BITS - 3
        for i, bits_ in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            if i >= 0:
                self.map[i * size : (i + 1) * size] = np.frombuffer(bits_, np.uint8)

    def has(self, hi: np.ndarray) -> np.ndarray:
        at = hi >> np.uint64(64 - self.bits)
        return (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def passed(self, found: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, hi, lo) of the candidates among the grams of each length."""
        may = None
        for ok, hi, lo in found:
            if may is not None:
                ok = ok & may[: len(ok)] & may[1 : len(ok) + 1]
            may = ok.copy()
            may[ok] = self.has(hi[ok])
            at = np.flatnonzero(may)
            yield at, hi[at], lo[at]


def _held(key, make):
    """What a worker made for ``key`` last; one of a kind at a time."""
    if _tables.get(key[0], (None,))[0] != key:
        _tables.pop(key[0], None)
        _tables[key[0]] = key, make()
    return _tables[key[0]][1]


def candidates(texts: DataFrame, path: str, bits: int, longest: int) -> DataFrame:
    """hi, lo, lang, n, phrase: each phrase that may be frequent."""

    def find(batches):
        import pyarrow as pa

        frequent = _held(("frequent", path), lambda: Frequent(path, bits))
        seen = np.zeros(1 << 21, np.uint64)  # upper halves by the lower ones' first bits: what it forgets comes twice
        for lang, words, ids, found in phrases(batches, longest):
            for n, (at, hi, lo) in enumerate(frequent.passed(found), 1):
                first, _ = _groups(hi, lo)
                at, hi, lo = at[first], hi[first], lo[first]
                slot = lo >> np.uint64(43)
                new = (seen[slot] != hi) | (hi == 0)
                seen[slot[new]] = hi[new]
                at, hi, lo = at[new], hi[new], lo[new]
                if len(at):
                    own = [b" ".join([words[i] for i in row]) for row in ids[at[:, None] + np.arange(n)].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array([lang] * len(at)), pa.array(np.full(len(at), n, np.int32)), pa.array(own, pa.binary()).cast(pa.string())], names=["hi", "lo", "lang", "n", "phrase"])

    return stored(texts.mapInArrow(find, "hi long, lo long, lang string, n int, phrase string").distinct(), "candidates")


class PerfectHash:
    """A minimal perfect hash of 128-bit keys: at each level a key sets a bit that no other key wants, or goes on
    to the next; its slot is the number of bits before its own."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.append(0, np.cumsum(np.bitwise_count(bits), dtype=np.int64))

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        return _mix(hi ^ _mix(lo + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1))) % np.uint64(size)

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        """Of distinct keys."""
        sizes, bits = [], []
        while len(hi):
            if len(sizes) == 64:
                raise ValueError("keys repeat")
            size = -(-len(hi) * 2 // 64) * 64
            at = cls._place(hi, lo, len(sizes), size).astype(np.int64)
            single = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(single, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = ~single[at]
            hi, lo = hi[left], lo[left]
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, np.uint64))

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Of each key; of one that was not among those of ``build`` some slot or -1."""
        out, left, offset = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            at = self._place(hi[left], lo[left], level, size) + np.uint64(offset)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            there = (self.bits[word] >> bit) & np.uint64(1) > 0
            below = self.bits[word[there]] & ((np.uint64(1) << bit[there]) - np.uint64(1))
            out[left[there]] = self.before[word[there]] + np.bitwise_count(below)
            left, offset = left[~there], offset + size
            if not len(left):
                break
        return out


class Shard:
    """A shard's perfect hash, its stored keys by slot, and their counts where they are known."""

    def __init__(self, shard: int, path: str, sums: str | None = None):
        row = next(iter(_table(path, ["sizes", "bits", "hi", "lo"], shard=shard).to_pylist()), {"sizes": [], "bits": b"", "hi": b"", "lo": b""})
        self.hash = PerfectHash(row["sizes"], np.frombuffer(row["bits"], np.uint64))
        self.hi, self.lo = np.frombuffer(row["hi"], np.uint64), np.frombuffer(row["lo"], np.uint64)
        self.counts = np.zeros(len(self.hi), np.int64)
        for r in _table(sums, ["block", "counts"], shard=shard).to_pylist() if sums else ():
            part = np.frombuffer(r["counts"], "<i8")
            self.counts[r["block"] * BLOCK :][: len(part)] = part

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Of each key, -1 where the stored key is another."""
        at = self.hash.slots(hi, lo)
        if not len(self.hi):
            return at
        return np.where((at >= 0) & (self.hi[at] == hi) & (self.lo[at] == lo), at, -1)

    def read(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        at = self.slots(hi, lo)
        return np.where(at >= 0, self.counts[at], 0)


def shard_of(lo, shards: int):
    return F.pmod(lo, F.lit(shards)).cast("int")


def perfect_hashes(found: DataFrame, shards: int) -> DataFrame:
    """shard, sizes, bits, hi, lo: the perfect hash of each shard and its keys by slot."""

    def build(batches):
        import pyarrow as pa

        schema = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("hi", pa.binary()), ("lo", pa.binary())])
        own, held = None, []

        def done():
            if own is not None:
                hi, lo = (np.concatenate([h[k] for h in held]).view(np.uint64) for k in (0, 1))
                made = PerfectHash.build(hi, lo)
                order = np.empty(len(hi), np.int64)
                order[made.slots(hi, lo)] = np.arange(len(hi))
                yield pa.RecordBatch.from_pylist([{"shard": own, "sizes": made.sizes, "bits": made.bits.tobytes(), "hi": hi[order].tobytes(), "lo": lo[order].tobytes()}], schema=schema)

        for b in batches:
            shard = b.column(0).to_numpy()
            for value in np.unique(shard).tolist():
                if value != own:
                    yield from done()
                    own, held = value, []
                rows = shard == value
                held.append((b.column(1).to_numpy()[rows], b.column(2).to_numpy()[rows]))
        yield from done()

    dealt = found.select(shard_of(F.col("lo"), shards).alias("shard"), "hi", "lo").repartition(shards, "shard").sortWithinPartitions("shard")
    return stored(dealt.mapInArrow(build, "shard int, sizes array<long>, bits binary, hi binary, lo binary"), "hashes", codec="zstd")


def counts(texts: DataFrame, path: str, bits: int, hashes: str, shards: int, splits: int, longest: int) -> DataFrame:
    """shard, block, counts: how often each candidate occurs, by slot.  splits: tasks that count for one shard."""

    def send(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        frequent = _held(("frequent", path), lambda: Frequent(path, bits))
        split, held, size = TaskContext.get().partitionId(), [], 0
        names = ["shard", "split", "hi", "lo", "n"]

        def sent():
            nonlocal split
            hi, lo = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            first, n = _groups(hi, lo)
            own, lo = hi[first], lo[first]
            shard = np.mod(lo.view(np.int64), shards)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            for k in range(shards):
                at = order[ends[k] : ends[k + 1]]
                for i in range(0, len(at), 1 << 19):
                    some = at[i : i + (1 << 19)]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([split % splits], pa.int32()), *(pa.array([a[some].astype(t).tobytes()], pa.binary()) for a, t in ((own, "<u8"), (lo, "<u8"), (n, "<u4")))], names=names)
            split += 1

        for _, _, _, found in phrases(batches, longest):
            for _, hi, lo in frequent.passed(found):
                held.append((hi, lo))
                size += len(hi)
            if size > HELD:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    def count(batches):
        import pyarrow as pa

        own, sums = None, None
        for b in batches:
            for shard, split, hi, lo, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (shard, split) != own:
                    if own:
                        yield from blocks(*own, sums)
                    own, here = (shard, split), _held(("shard", hashes, shard), lambda: Shard(shard, hashes))  # noqa: B023
                    sums = np.zeros(len(here.hi), np.int64)
                at = here.slots(np.frombuffer(hi, "<u8"), np.frombuffer(lo, "<u8"))
                known = at >= 0
                sums += np.bincount(at[known], np.frombuffer(n, "<u4")[known], minlength=len(sums)).astype(np.int64)
        if own:
            yield from blocks(*own, sums)

    def blocks(shard, split, sums):
        import pyarrow as pa

        for i in range(0, len(sums), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([i // BLOCK], pa.int32()), pa.array([split], pa.int32()), pa.array([sums[i : i + BLOCK].astype("<i8").tobytes()], pa.binary())], names=["shard", "block", "split", "counts"])

    def add(batches):
        import pyarrow as pa

        own, sums = None, None

        def done():
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in own), pa.array([sums.tobytes()], pa.binary())], names=["shard", "block", "split", "counts"])

        for b in batches:
            for *key, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != own:
                    if own is not None:
                        yield done()
                    own, sums = key, np.zeros(len(part) // 8, "<i8")
                sums = sums + np.frombuffer(part, "<i8")
        if own is not None:
            yield done()

    schema = "shard int, block int, split int, counts binary"
    sent = texts.mapInArrow(send, "shard int, split int, hi binary, lo binary, n binary")
    rows = sent.repartition(shards * splits, "shard", "split").sortWithinPartitions("shard", "split").mapInArrow(count, schema)
    while splits > 1:
        splits = -(-splits // FAN_IN)
        rows = rows.withColumn("split", (F.col("split") / FAN_IN).cast("int")).repartition(width_for(texts.sparkSession, shards * splits, 4), "shard", "block", "split")
        rows = rows.sortWithinPartitions("shard", "block", "split").mapInArrow(add, schema)
    return stored(rows.select("shard", "block", "counts"), "sums", codec="zstd")


def _read_slots(rows: DataFrame, hashes: str, sums: str, shards: int, least: int) -> DataFrame:
    """``rows`` (hi, lo and others) with f, the count by slot of hi and lo, where it is ``least`` at least."""
    from pyspark.sql.types import LongType, StructField, StructType

    def read(batches):
        import pyarrow as pa

        for b in batches:
            shard, hi, lo = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy().view(np.uint64)
            f = np.zeros(len(shard), np.int64)
            for k in np.unique(shard).tolist():
                here = _held(("counted", sums, k), lambda: Shard(k, hashes, sums))  # noqa: B023
                f[shard == k] = here.read(hi[shard == k], lo[shard == k])
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(f)], names=[*b.schema.names, "f"])
            yield out.filter(pa.array(f >= least))

    rows = rows.select(shard_of(F.col("lo"), shards).alias("shard"), "hi", "lo", *[c for c in rows.columns if c not in ("hi", "lo")])
    salts = max(1, width_for(rows.sparkSession, 0, 1) // shards)
    dealt = rows.repartition(shards * salts, "shard", F.pmod(F.xxhash64("phrase"), F.lit(salts))).sortWithinPartitions("shard")
    return dealt.mapInArrow(read, StructType([*dealt.schema.fields, StructField("f", LongType())])).drop("shard")


def cuts(frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, k, side, hi, lo: the keys of both sides of each cut after k words."""

    def cut(batches):
        import pyarrow as pa

        claim("phrases", _tables.clear)
        for b in batches:
            by_lang: dict[str, list[tuple[bytes, int]]] = {}
            for lang, phrase, a in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by_lang.setdefault(lang, []).append((phrase.encode(), a))
            for lang, own in by_lang.items():
                _, keys, ids = split_words(lang, [p for p, _ in own])
                sizes = np.array([p.count(b" ") + 1 for p, _ in own])
                begin = np.cumsum(sizes + 1) - sizes - 1  # a mark stands between two phrases
                found = grams(keys, ids, int(sizes.max()))
                for k in range(1, int(sizes.max())):
                    some = np.flatnonzero(sizes > k)
                    for side, at, n in ((0, begin[some], np.full(len(some), k)), (1, begin[some] + k, sizes[some] - k)):
                        hi, lo = (np.array([found[m - 1][j][i] for i, m in zip(at.tolist(), n.tolist(), strict=True)], np.uint64).view(np.int64) for j in (1, 2))
                        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "phrase": [own[i][0].decode() for i in some], "a": pa.array([own[i][1] for i in some], pa.int64()), "k": pa.array([k] * len(some), pa.int32()), "side": pa.array([side] * len(some), pa.int32()), "hi": hi, "lo": lo})

    return frequent.mapInArrow(cut, "lang string, phrase string, a long, k int, side int, hi long, lo long")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language, numbered from 1; of each part of a language first, as one may have most."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts_ = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    own = parts_.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, within: int = WITHIN, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's most telling phrases.

    Texts, with A-Z in lower case, are cut at ``.,;:!?`` and line ends into pieces, and those at spaces and tabs
    into words.  A phrase is 2 to ``longest`` words of a piece and occurs a times, ``least`` at least.  Of its cuts
    into two phrases that occur l and r times the one with the least floor(1000000 * a * a / (l * r)) counts, its
    score; of equal ones the first.  n: all words of the language.  Phrases inside a longer one that occurs
    ``within`` per cent as often are left out.  Equal scores are ordered by a and then by the phrase.  Rows with the
    same doc_id count each; null text is empty, null lang is ``und``.  Other columns are not read.  An empty table,
    or one without a frequent phrase, gives an empty one.
    """
    if longest < 2 or least < 1 or top < 1:
        raise ValueError("phrases have two words or more, and occur")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with Scratch(spark) as tables:
        bits = bucket_bits(n_bytes)
        made = buckets(texts, bits, least, longest)
        path = tables.paths[-1]
        found = candidates(texts, path, bits, longest)
        shards = max(1, -(-found.count() // SLOTS))
        perfect_hashes(found, shards)
        hashes = tables.paths[-1]
        splits = -(-width_for(spark, n_bytes, 64 << 20) // shards)
        counts(texts, path, bits, hashes, shards, splits, longest)
        sums = tables.paths[-1]
        frequent = stored(_read_slots(found.where("n > 1"), hashes, sums, shards, least).select("lang", "phrase", "n", F.col("f").alias("a")), "frequent")
        sides = _read_slots(cuts(frequent.select("lang", "phrase", "a")), hashes, sums, shards, 0)
        both = sides.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
        least_cut = both.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        scored = stored(least_cut.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")
        longer = frequent.where("n > 2").withColumn("w", F.split("phrase", " ")).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n") - 1)))
        inner = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1), lambda i: F.concat_ws(" ", F.slice("w", i, F.col("size"))))
        longer = longer.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        words = made.where("lang is not null").groupBy("lang").agg(F.sum("words").alias("n"))
        kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * within)).drop("longer")
        result = stored(_first(kept, top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
        tables.keep(result)
    return result

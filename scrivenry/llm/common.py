"""Helpers shared by the training-data operators: scratch storage, safe files, column plumbing."""

from __future__ import annotations

import contextlib
import os
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares.

    ``spark.checkpoint.dir`` of the session when it is set.  Only where it is unset and the session runs in one
    process (local, as in tests) a temporary folder of this machine is chosen and set as the checkpoint folder;
    on a cluster each executor would write to a disk of its own, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scrivenry-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing exists there yet."""
    return posixpath.join(shared_dir(spark).rstrip("/"), f"scrivenry-{name}-{uuid.uuid4().hex[:12]}")


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths; those that are gone already are no error."""
    for path in paths:
        fs, place = _hadoop(spark, path)
        fs.delete(place, True)


class Scratch:
    """Paths of scratch tables written while it is open; at the end all but the kept ones are deleted.  Lazy
    results that still read one must be kept, and go when the application ends."""

    open_: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> Scratch:
        Scratch.open_.append(self)
        return self

    def keep(self, *tables: DataFrame) -> None:
        """Tables that what is returned reads."""
        self.kept.update(p for t in tables for p in self.paths if any(p.split("/")[-1] in f for f in t.inputFiles()))

    def __exit__(self, kind, value, trace):
        Scratch.open_.remove(self)
        dropped(self.spark, *[p for p in self.paths if p not in self.kept])
        if Scratch.open_:
            Scratch.open_[-1].paths += [p for p in self.paths if p in self.kept]


def forgotten(spark: SparkSession, path: str) -> None:
    """Have a path deleted with the ``Scratch`` it was made in, or when the application ends."""
    fs, place = _hadoop(spark, path)
    fs.deleteOnExit(place)
    if Scratch.open_:
        Scratch.open_[-1].paths.append(path)


def stored(df: DataFrame, name: str, partition_by: str | None = None, codec: str = "lz4") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, sizes are known.  The
    table is deleted with the ``Scratch`` it was made in, or when the application ends.  What Python workers read
    too needs the codec zstd: Arrow and Hadoop frame large pages of lz4 differently."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    forgotten(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def width_for(spark: SparkSession, amount: int, each: int) -> int:
    """Tasks for an exchange of ``amount`` (rows or bytes) of which a task should get ``each``: the session's
    number at least, more where the data are more."""
    return max(shuffle_width(spark), -(-amount // each))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def open_fs(uri: str):
    """(filesystem, path) of a URI or an absolute path, for readers and writers in Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_held: dict = {}


def claim(owner: str, release) -> None:
    """Name the owner of this worker's caches; those of other operators, from earlier tasks, are released, and
    their memory goes back to the system, as the executor's limit counts it."""
    others = [o for o in _held if o != owner]
    for other in others:
        _held.pop(other)()
    _held[owner] = release
    if others:
        import gc

        gc.collect()
        trimmed()


def trimmed() -> None:
    """Give freed memory of this worker back to the system; allocators keep it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1024, most: int = 4 << 20) -> None:
    """Have Arrow batches hold ``rows`` rows and ``most`` bytes (or one row), unless the session says otherwise: a
    row is a whole text, and Spark's 10,000 of them, written by doubling buffers, take more memory outside the heap
    than a task should."""
    name, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)
        spark.conf.set(size, min(most, int(spark.conf.get(size).removesuffix("b"))))


def parts(batches, rows: int = 1024, most: int = 32 << 20):
    """The batches in parts of at most ``rows`` rows and ``most`` bytes (or one row), so that little of one is in
    Python objects at a time."""
    for b in batches:
        left = [b.slice(i, rows) for i in range(0, b.num_rows, rows)][::-1]
        while left:
            part = left.pop()
            if part.nbytes > most and part.num_rows > 1:
                half = part.num_rows // 2
                left += [part.slice(half), part.slice(0, half)]
            else:
                yield part


class AtomicFile:
    """A file that appears under its name only when complete.

    Every attempt writes to a name of its own and renames it at the end, so a task that is run again
    after a lost executor replaces the file by equal bytes and never leaves half of one.
    """

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temp = f"{os.path.dirname(self.path)}/.{os.path.basename(self.path)}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.temp)
        return self.out

    def __exit__(self, kind, value, trace):
        self.out.close()
        if kind is None:
            self.fs.move(self.temp, self.path)
        else:
            self.fs.delete_file(self.temp)


def slices(texts: list, most: int = 1 << 21, size=len):
    """Cut a list of texts into (from, to) runs of about ``most`` characters, one text at least."""
    begin = total = 0
    for i, text in enumerate(texts):
        total += size(text)
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)

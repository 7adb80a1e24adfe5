"""WARC archives: a writer with revisit records, and a reader that splits files at any byte.

A record is a gzip member of its own.  A reading task gets a byte range; it looks for gzip's magic bytes,
takes a place for a record only if inflating there gives a WARC version line, and owns the records whose
first byte lies in its range, reading past the end of the range to finish the last one.  Compressed data
may hold the magic bytes by chance; such places fail the header test and the search goes on behind them.

Members stand end to end, so the reader knows where each must begin: at the file's beginning, and where the one
before ended.  A place where none does, or one that is cut off or damaged, is reported by the task that comes to
it, once, and not passed over.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivenry.llm.common import AtomicFile, open_fs, scratch, small_batches, stored, width_for

GZIP_MAGIC = b"\x1f\x8b\x08"
CHUNK, TASK_BYTES = 1 << 20, 64 << 20
_URN = "<urn:page:%s>"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    kind = "revisit" if refers_to is not None else "response"
    target = "".join(c for c in (url or "") if c > " " and c != "\x7f").encode()
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + (_URN % page_id).encode(), b"WARC-Target-URI: " + target, b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + (_URN % refers_to).encode()]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null html: empty), payload_digest, refers_to: null, or the largest page_id
    with an equal payload where that is another page and the payload has ``least_bytes`` or more.

    Only digests and ids are grouped, with partial sums before the exchange, and only digests that occur
    more than once are joined back, so a payload that a third of all pages share costs one row a task.
    Null page_id: never referred to; refers to the largest of its group.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("sha1", F.sha1("payload"))
    several = stored(keyed.where(F.length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("sha1", "newest"), "digests")
    joined = keyed.join(several, "sha1", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")).alias("refers_to"))


def write_warc(pages: DataFrame, least_bytes: int = 0, files: int | None = None, folder: str | None = None) -> DataFrame:
    """Write one record for each row of ``pages`` (page_id, url, html) and return the manifest (path, size).

    Repeated rows give repeated records.  Null html: an empty payload; null url: an empty one; null page_id: a
    record without a number, that no other refers to.  Empty tables give no file.  Other columns, whatever their
    names, are not read.
    """
    folder = folder or scratch(pages.sparkSession, "warc")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        uri, size = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with AtomicFile(uri) as out:
            for b in chain([first], batches):
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = _record(page_id, url, payload, payload_digest(payload), refers_to)
                    size += len(data)
                    out.write(data)
        yield pa.RecordBatch.from_pydict({"path": [uri], "size": [size]})

    rows = revisits(pages, least_bytes).select("page_id", "url", "payload", "refers_to")
    if files:
        rows = rows.repartition(files)
    spark = pages.sparkSession
    small_batches(spark)
    return spark.createDataFrame(rows.mapInArrow(write, "path string, size long").collect(), "path string, size long")


def _inflate(read, at: int, data: bytes) -> tuple[bytes, int] | None | str:
    """The member that begins at byte ``at`` of the file and its length; None if none begins there; if it is a
    record's that can't be read to its end, why.  data: bytes from ``at`` on that are at hand already."""
    inflate, out, size, used = zlib.decompressobj(31), [], 0, 0
    try:
        while True:
            if size < 7 and not inflate.eof:  # a header may be long, so the version line decides
                part = inflate.decompress(data, 64)
                rest = inflate.unconsumed_tail or inflate.unused_data
                used, data = used + len(data) - len(rest), rest
            else:
                part = inflate.decompress(data)
                used, data = used + len(data) - len(inflate.unused_data), b""
            out.append(part)
            size += len(part)
            if (size >= 7 or inflate.eof) and not b"".join(out[:8]).startswith(b"WARC/1."):
                return None
            if inflate.eof:
                return b"".join(out), used
            if not data and not (data := read(at + used, CHUNK)):
                return "cut off" if size >= 7 else None
    except zlib.error as e:
        return str(e) if size >= 7 else None


def read_range(uri: str, begin: int, end: int, size: int | None = None) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, byte where it begins) of each record whose first byte lies in [begin, end) of the file.

    Where a record should begin and none does, or one that can't be read to its end, headers are {"": why}, and the
    search goes on behind that place.  Such a place at or behind ``end`` is reported by the range whose last record
    ends there.  size: of the file, asked if not given.
    """
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        size = f.size() if size is None else size

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        at, base, held, due = begin, begin, b"", begin == 0
        while at < end or due and at < size:
            if len(held) - (at - base) < len(GZIP_MAGIC):
                base, held = at, read(at, CHUNK)
                if not held:
                    return
            found = at - base if held.startswith(GZIP_MAGIC, at - base) else -1 if due else held.find(GZIP_MAGIC, at - base)
            if found < 0:
                if due:
                    yield {"": "no record begins here"}, b"", at
                    due, at = False, at + 1
                else:
                    at = max(at + 1, base + len(held) - len(GZIP_MAGIC) + 1)
                continue
            at = base + found
            if at >= end and not due:
                return
            member = _inflate(read, at, held[found:])
            if at >= end:  # the next range's record; only its beginning is looked at
                if member is None:
                    yield {"": "no record begins here"}, b"", at
                return
            if member is None or isinstance(member, str):
                if due or member:
                    yield {"": member or "no record begins here"}, b"", at
                due, at = False, at + 1
                continue
            head, _, block = member[0].partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
            length = fields.get("Content-Length", "")
            yield fields, block[: int(length)] if length.isdigit() else block, at
            at, due = at + member[1], True


def ranges(spark: SparkSession, manifest: DataFrame, split_bytes: int) -> DataFrame:
    """path, begin, end, size: the files cut into ranges of ``split_bytes``, at any byte."""
    cuts = F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    return manifest.select("path", "size", F.explode(cuts).alias("begin")).select("path", "begin", F.least(F.col("begin") + split_bytes, F.col("size")).alias("end"), "size")


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if (urn or "").startswith("<urn:page:") and text.lstrip("-").isdigit() else None


def read_warc(manifest: DataFrame, split_bytes: int = 4 << 20, tasks: int | None = None, broken: str = "fail") -> DataFrame:
    """Per record: page_id, url, record_type, refers_to, payload_digest, payload_bytes (of the full payload,
    which a revisit's HTTP header still states), payload (binary; null for a revisit), path, offset.

    Records of any writer are read: page_id and refers_to are null where they aren't this writer's names, and the
    payload of a record that isn't an HTTP message (warcinfo, metadata, ...) is its block.  Length and digest of a
    payload that is there are computed; one that differs from a SHA-1 in its header raises an error.  What can't be
    read: broken="fail" raises an error that names the place, "keep" gives a row of record_type broken with the
    reason as url.  A manifest without files gives an empty table; null paths aren't read, nor are its other
    columns.
    """
    spark = manifest.sparkSession
    if broken not in ("fail", "keep"):
        raise ValueError(f"broken must be fail or keep, got {broken!r}")

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])

        def row(uri, fields, block, at):
            if "" in fields:
                if broken == "fail":
                    raise ValueError(f"{uri} at byte {at}: {fields['']}")
                return None, fields[""], "broken", None, None, None, None, uri, at
            kind, http = fields.get("WARC-Type"), fields.get("Content-Type", "").startswith("application/http")
            head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
            algorithm, _, stated = fields.get("WARC-Payload-Digest", "").rpartition(":")
            if kind == "revisit":
                length = head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0]
                digest, n, payload = stated or None, int(length) if length.isdigit() else None, None
            else:
                digest, n = payload_digest(payload), len(payload)
                if kind == "response" and algorithm == "sha1" and digest != stated:
                    raise ValueError(f"{uri} at byte {at}: the payload of {fields.get('WARC-Record-ID')} differs from its digest")
            return _number(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), kind, _number(fields.get("WARC-Refers-To")), digest, n, payload, uri, at

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for uri, begin, end, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held = [], 0
                for fields, block, at in read_range(uri, begin, end, size):
                    rows.append(row(uri, fields, block, at))
                    held += len(block)
                    if held > CHUNK * 8:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    cut = ranges(spark, manifest.where("path is not null"), split_bytes)
    total = manifest.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return cut.repartition(tasks or width_for(spark, total, TASK_BYTES)).mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, path string, offset long")

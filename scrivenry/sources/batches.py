"""How much of a table Python workers hold at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch, or one row.
ROWS, BYTES = 1024, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches hold ``ROWS`` rows and ``BYTES`` bytes, unless the session says otherwise: Spark's 10,000
    rows of whole texts, vectors or blocks of sums are more than a worker should hold."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, ROWS)
        spark.conf.set(size, min(BYTES, int(spark.conf.get(size).removesuffix("b"))))


def parts(batches, rows: int = ROWS, most: int = BYTES) -> Iterator:
    """The batches in parts of at most ``rows`` rows and ``most`` bytes (or one row)."""
    for b in batches:
        left = [b.slice(i, rows) for i in range(0, b.num_rows, rows)][::-1]
        while left:
            part = left.pop()
            if part.nbytes > most and part.num_rows > 1:
                half = part.num_rows // 2
                left += [part.slice(half), part.slice(0, half)]
            else:
                yield part

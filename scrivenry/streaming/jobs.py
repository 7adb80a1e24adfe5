"""Incremental jobs on Structured Streaming: deduplication in a watermark, windows, lineage of batches, resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from scrivenry.operators.ranks import numbered
from scrivenry.operators.sampling import pending
from scrivenry.sources.scratch import ends_with_session, scratch, stored


def file_stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder, those there and those to come."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Event time as Spark's watermarks take it: one without a zone is read in the session's."""
    plain = isinstance(stream.schema[time].dataType, TimestampNTZType)
    return stream.withColumn(time, F.col(time).cast("timestamp")) if plain else stream


def unique_within(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key inside the watermark; state is dropped as the watermark passes."""
    kept = _timed(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return kept.withColumn(time, F.col(time).cast(stream.schema[time].dataType))


def tumbling(stream: DataFrame, time: str, width: str, keys: list[str], delay: str, slide: str | None = None) -> DataFrame:
    """Rows (window_start, keys, n, total) of windows; late rows beyond the delay are left out."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = _timed(stream, time).withWatermark(time, delay).groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], delay: str) -> DataFrame:
    grouped = _timed(stream, time).withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return what it wrote.

    Appended rows go to a Parquet sink, exactly once; a result that is replaced as a whole is written for each
    batch under its number, and the last one is returned.  Both folders are on shared storage.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch(spark, name), checkpoint or scratch(spark, f"{name}-state")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        ends_with_session(spark, out)
        return spark.read.schema(stream.schema).parquet(out)
    last = {}

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{batch}")
        last["batch"] = batch

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/{last['batch']}") if last else spark.createDataFrame([], stream.schema)


def lineage(df: DataFrame, order: str, work: str, batch_rows: int, accumulate: int) -> DataFrame:
    """Rows (micro_batch, optimizer_step, accumulation_index, works, n): which works each micro-batch read.
    df: order (a dense number from 0) and work."""
    n = (F.floor(F.col(order) / batch_rows) + 1).alias("micro_batch")
    rows = df.groupBy(n).agg(F.array_sort(F.collect_set(work)).alias("works"), F.count("*").alias("n"))
    m = F.col("micro_batch") - 1
    return rows.select("micro_batch", (F.floor(m / accumulate) + 1).alias("optimizer_step"), (m % accumulate + 1).alias("accumulation_index"), "works", "n")


def lineage_stream(stream: DataFrame, run: str, order: str, work: str, batch_rows: int, accumulate: int) -> DataFrame:
    """Rows (run, micro_batch, optimizer_step, accumulation_index, works, n) as rows of a run come in: a micro-batch's
    line is written when its last row is there.  The state of a run is the number of its micro-batches and the
    works of the one begun; rows that come together are taken by ``order``."""
    kind = stream.schema[run].dataType.simpleString()

    def step(key, frames, state):
        import pandas as pd

        done, held = state.get if state.exists else (0, [])
        works = [*held, *pd.concat(list(frames)).sort_values(order, kind="stable")[work].tolist()]
        full, rows = len(works) // batch_rows, []
        for m in range(done, done + full):
            own = works[(m - done) * batch_rows : (m - done + 1) * batch_rows]
            rows.append((*key, m + 1, m // accumulate + 1, m % accumulate + 1, sorted({w for w in own if w is not None}), len(own)))
        state.update((done + full, works[full * batch_rows :]))
        yield pd.DataFrame(rows, columns=[run, "micro_batch", "optimizer_step", "accumulation_index", "works", "n"])

    rows = stream.select(F.col(run), F.col(order), F.col(work).cast("string").alias(work))
    out = f"`{run}` {kind}, micro_batch long, optimizer_step long, accumulation_index long, works array<string>, n long"
    return rows.groupBy(run).applyInPandasWithState(step, out, "done long, held array<string>", "append", "NoTimeout")


def logged(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, adding its rows to the log at ``path``; the whole log.  Each batch has a
    folder of its number, so one that is run again after a failure replaces its own lines and repeats none."""

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = written(stream.sparkSession, path)
    return stream.sparkSession.createDataFrame([], stream.schema) if found is None else found.select(*stream.columns)


def resumed(df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, keys: list[str], ok: str | None = None) -> DataFrame:
    """Do what isn't done yet and append it: rows whose keys ``path`` has (with ``ok``: and that succeeded) are
    skipped.  An append is atomic, so a run that is cut short loses only itself."""
    spark = df.sparkSession
    found = written(spark, path)
    todo = df if found is None else pending(df, found, keys, ok)
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def batches_until(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, keys: list[str], each: int, stop: Callable[[], bool], ok: str | None = None) -> DataFrame:
    """Do pending jobs ``each`` at a time, by key, until none is left or ``stop`` says so, as at a deadline: what is
    done by then is kept, and the same call goes on from there.  Rows whose work gives nothing stay pending and are
    not tried again in this call.

    What is pending is looked up once, numbered by key and stored, so that a batch reads its own rows and not all
    that is done; rows with equal keys are all done, also where a batch ends between them."""
    spark = jobs.sparkSession
    if not stop():
        found = written(spark, path)
        todo = stored(numbered(jobs if found is None else pending(jobs, found, keys, ok), keys, "__place"), "pending")
        left = todo.agg(F.coalesce(F.max("__place") + 1, F.lit(0)).alias("n")).first()["n"]
        for i in range(0, left, each):
            if i and stop():
                break
            work(todo.where(F.col("__place").between(i, i + each - 1)).drop("__place")).write.mode("append").parquet(path)
    found = written(spark, path)
    return jobs.limit(0) if found is None else found


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``path`` holds; None where nothing was written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(place) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(place))
    return spark.read.parquet(path) if there else None

"""JSON lines, tables of labels, lists of ids, and writers of shards."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, corrupt: str = "drop") -> DataFrame:
    """JSON lines under a fixed schema.  corrupt: drop, keep (as _corrupt_record), or fail."""
    if corrupt == "fail":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if corrupt == "keep":
        return spark.read.schema(f"{schema}, _corrupt_record string").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def with_position(df: DataFrame) -> DataFrame:
    """Adds __file and __pos: the file of each row of a file scan, and its place there from 0.

    A file is read in splits, each by one task and from its beginning.  Rows are numbered in their task, the rows of
    each split are counted, and what stands in a file's earlier splits is added: the place is exact, however files
    are split.  ``df`` is a scan of files (a reader's result).
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__m"))
    splits = placed.groupBy("__file", "__block").agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select(F.col("__file").alias("__f"), F.col("__block").alias("__b"), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__add"))
    found = placed.join(before, (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    return found.select(*df.columns, "__file", (F.col("__m") + F.col("__add")).alias("__pos"))


def first_per_file(df: DataFrame, most: int) -> DataFrame:
    """At most the first ``most`` rows of each file."""
    return with_position(df).where(F.col("__pos") < most).drop("__file", "__pos")


def first_rows(df: DataFrame, most: int) -> DataFrame:
    """The first rows in the order of files and places."""
    return with_position(df).where(F.col("__pos") < most).orderBy("__file", "__pos").limit(most).drop("__file", "__pos")


def calibration_texts(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The first row of each of ``n`` files, drawn by a hash; rows without text go after that."""
    one = with_position(df).where(F.col("__pos") == 0)
    return one.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "__file")), "__file").limit(n).drop("__file", "__pos").where("coalesce(text, '') <> ''")


def read_labels(spark: SparkSession, path: str, key: str, axes: list[str]) -> DataFrame:
    """A table of labels with tabs and a header; rows with a label that isn't a whole number go."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    df = raw.select(key, *[F.col(a).try_cast("int").alias(a) for a in axes])
    return df.where(" and ".join(f"`{a}` is not null" for a in axes))


def id_list(spark: SparkSession, ids: str, column: str = "ncode") -> DataFrame:
    """Ids from a comma list, or from the lines of a file where the name has a slash or ends in .txt."""
    if "/" in ids or ids.endswith(".txt"):
        return spark.read.text(ids).select(F.trim("value").alias(column)).where(F.col(column) != "").distinct()
    return spark.createDataFrame([(i.strip(),) for i in ids.split(",") if i.strip()], f"`{column}` string").distinct()


def comma_list(c: Column) -> Column:
    """Trimmed, non-empty items; null for an empty input."""
    items = F.filter(F.transform(F.split(c, ",", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(c, F.lit("")) != "", items)


def write_shards(df: DataFrame, path: str, most: int, mode: str = "errorifexists") -> None:
    """JSON lines with at most ``most`` rows a file, a folder for each split; complete files only."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", most).option("ignoreNullFields", False)
    (writer.partitionBy("split") if "split" in df.columns else writer).json(path)


def write_report(df: DataFrame, open_out) -> dict:
    """The single row of a report as JSON text, written by the driver to an open file."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a report has one row")
    report = json.loads(rows[0])
    open_out.write(json.dumps(report, ensure_ascii=False, indent=2))
    return report


def label_template(df: DataFrame, key: str, text: str, axes: list[str]) -> DataFrame:
    """Rows to be labelled by hand: key, blank columns, and 60 characters of text on one line."""
    return df.select(key, *[F.lit("").alias(a) for a in axes], F.translate(F.left(text, F.lit(60)), "\t\n\r", "   ").alias("excerpt"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, length, sha256) of files, read as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read_schema(spark: SparkSession, path: str) -> dict:
    """A JSON Schema from a file, without the keys that only name it."""
    (text,) = spark.read.text(path, wholetext=True).first()
    return {k: v for k, v in json.loads(text).items() if k not in ("$schema", "$id", "title")}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one JSON value each, an object or a list of them."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """A word list: trimmed lines with something on them, in the file's order.  For lists that fit a query's plan."""
    (text,) = spark.read.text(path, wholetext=True).first()
    return [line.strip() for line in text.splitlines() if line.strip()]


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Put a table's rows in place of what ``path`` holds, which ``df`` may read: they are written beside it and take
    its name when complete.  Between two renames there is no table of that name, and the old one is beside it, under
    ``.former``; a table of shards (``shards.rewrite``) changes at one moment."""
    spark, fresh, former = df.sparkSession, f"{path.rstrip('/')}.fresh", f"{path.rstrip('/')}.former"
    fs, place = _fs(spark, path)
    for left in (fresh, former):
        fs.delete(_fs(spark, left)[1], True)
    df.write.option("ignoreNullFields", False).json(fresh)
    if fs.exists(place) and not fs.rename(place, _fs(spark, former)[1]):
        raise OSError(f"can't move {path}")
    if not fs.rename(_fs(spark, fresh)[1], place):
        fs.rename(_fs(spark, former)[1], place)
        raise OSError(f"can't put {fresh} in place")
    fs.delete(_fs(spark, former)[1], True)


def write_version(spark: SparkSession, path: str, config: dict, schema_version: int, partial: bool) -> None:
    """What a build was made with, as one JSON file."""
    out = _fs(spark, path)[0].create(_fs(spark, path)[1], True)
    out.write(bytearray(json.dumps({"schema_version": schema_version, "partial": partial, "config": config}, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    out.close()


def write_works(df: DataFrame, path: str, key: str) -> None:
    """One folder with one JSON-lines file for each key; equal keys are dealt to one task."""
    df.withColumn("__key", F.col(key)).repartition("__key").write.partitionBy("__key").option("ignoreNullFields", False).json(path)


def append_shards(df: DataFrame, path: str, most: int) -> None:
    """Add rows to shards of JSON lines, see ``shards.append``."""
    from scrivenry.sources import shards

    shards.append(df, path, most)


def cached_by(df: DataFrame, root: str, name: str, parameters: dict) -> DataFrame:
    """The rows from a table that equal parameters made before; made and stored if there is none."""
    import hashlib

    digest = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{name}-{digest}"
    if not _fs(spark, path)[0].exists(_fs(spark, f"{path}/_SUCCESS")[1]):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def surrogate_faults(raw: Column) -> Column:
    """Whether a file's bytes hold an unpaired surrogate as UTF-8 would spell it, which Spark strings can't."""
    return F.hex(raw).rlike("^(?:..)*?ED[AB]")


def blank_template(df: DataFrame, path: str, columns: list[str]) -> None:
    """A table to be filled in by hand, with blank columns added; a path that exists is never overwritten."""
    df.select("*", *[F.lit("").alias(c) for c in columns]).write.mode("errorifexists").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)

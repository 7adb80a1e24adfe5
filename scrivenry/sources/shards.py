"""Shards of JSON lines that change all at once: tasks write files of their own, and a manifest that names the files
takes the place of the one before by rename, when all tasks have ended.

A task that is run again, or a run that is cut short, leaves files that no manifest names; ``vacuum`` deletes them.
Readers go by the manifest, so they see the rows from before a change or those from after it.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "_manifest.json"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def manifest(path: str) -> dict:
    """generation, and shards: {name: [file, rows]}."""
    fs, place = _fs(f"{path.rstrip('/')}/{MANIFEST}")
    if not fs.get_file_info(place).is_file:
        return {"generation": 0, "shards": {}}
    with fs.open_input_stream(place) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    files: list  # (shard or None, split, file, rows)


class ShardWriter(DataSourceWriter):
    """Rows (shard, split, value), sorted by them: those with a shard go to its file, the others to files of at most
    ``most`` rows of one split."""

    def __init__(self, options):
        self.path, self.most = options["path"].rstrip("/"), int(options["most"])
        self.replaces, self.generation = json.loads(options["replaces"]), int(options["generation"])

    def write(self, iterator):
        fs, root = _fs(self.path)
        files, now, out = [], None, None
        try:
            for row in iterator:
                shard, split, value = row["shard"], row["split"] or "", row["value"]
                if now is None or now != (shard, split) or shard is None and files[-1][3] == self.most:
                    if out:
                        out.close()
                    now, name = (shard, split), f"{split}/{uuid.uuid4().hex}.json".lstrip("/")
                    fs.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                    files.append([shard, split, name, 0])
                out.write(value.encode() + b"\n")
                files[-1][3] += 1
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages):
        state = manifest(self.path)
        if state["generation"] != self.generation:
            raise RuntimeError(f"{self.path} was changed meanwhile")
        kept = {n: e for n, e in state["shards"].items() if n not in set(self.replaces)}
        free = sorted(self.replaces)
        for shard, split, file, rows in (f for m in messages if m for f in m.files):
            kept[shard or self._name(kept, free, split)] = [file, rows]
        fs, place = _fs(f"{self.path}/{MANIFEST}")
        fs.create_dir(posixpath.dirname(place), recursive=True)
        fresh = f"{place}.{uuid.uuid4().hex}"
        with fs.open_output_stream(fresh) as f:
            f.write(json.dumps({"generation": self.generation + 1, "shards": kept}).encode())
        fs.move(fresh, place)

    @staticmethod
    def _name(kept: dict, free: list[str], split: str) -> str:
        """A name that was given up, else the next number of the split."""
        for name in free:
            if posixpath.dirname(name) == split:
                free.remove(name)
                return name
        k = sum(posixpath.dirname(n) == split for n in kept)
        while (name := posixpath.join(split, f"shard-{k:05d}")) in kept:
            k += 1
        return name

    def abort(self, messages):
        fs, root = _fs(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{f[2]}")


class ShardSink(DataSource):
    @classmethod
    def name(cls):
        return "scrivenry_shards"

    def writer(self, schema, overwrite):
        return ShardWriter(self.options)


def _save(rows: DataFrame, path: str, state: dict, replaces: list[str], most: int) -> None:
    rows.sparkSession.dataSource.register(ShardSink)
    writer = rows.write.format("scrivenry_shards").mode("append").option("path", path).option("most", most)
    writer.option("replaces", json.dumps(replaces)).option("generation", state["generation"]).save()
    fs, root = _fs(path)
    for name in replaces:  # no manifest names them any more
        fs.delete_file(f"{root}/{state['shards'][name][0]}")


def _lines(df: DataFrame, split: bool):
    own = [c for c in df.columns if not (split and c == "split") and c not in ("__shard", "__pos")]
    return F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("value")


def append(df: DataFrame, path: str, most: int) -> None:
    """Add rows, at most ``most`` a shard; a column ``split`` becomes a folder.  Shards that aren't full are read with
    the new rows and their names used again, full ones stay.  All of it happens or nothing."""
    state, spark, split = manifest(path), df.sparkSession, "split" in df.columns
    short = [n for n, (_, rows) in state["shards"].items() if rows < most]
    every = df
    if short:
        every = _files(spark, path, state, short, df.schema).select(*df.columns).unionByName(df)
    rows = every.select(F.lit(None).cast("string").alias("shard"), (F.col("split").cast("string") if split else F.lit("")).alias("split"), _lines(df, split))
    _save(rows.sortWithinPartitions("split") if split else rows, path, state, short, most)


def _files(spark: SparkSession, path: str, state: dict, names: list[str], schema) -> DataFrame:
    """Rows of some shards, with __shard and __pos, their place in it."""
    from pyspark.sql.types import StringType, StructField, StructType

    from scrivenry.sources.files import with_position

    files = {f"{path.rstrip('/')}/{state['shards'][n][0]}": n for n in names}
    own = StructType([f for f in schema.fields if f.name != "split"]) if "split" in schema.names else schema
    if not files:
        return spark.createDataFrame([], StructType([*schema.fields, StructField("__shard", StringType()), StructField("__pos", StringType())]))
    placed = with_position(spark.read.schema(own).json(list(files)))
    known = spark.createDataFrame([(f.rsplit("/", 1)[-1], n, posixpath.dirname(n)) for f, n in files.items()], "__name string, __shard string, split string")
    found = placed.withColumn("__name", F.substring_index("__file", "/", -1)).join(F.broadcast(known), "__name").drop("__name", "__file")
    return found if "split" in schema.names else found.drop("split")


def read(spark: SparkSession, path: str, schema: str, position: bool = False) -> DataFrame:
    """The rows that the manifest's files hold; position: with __shard and __pos."""
    from pyspark.sql.types import _parse_datatype_string

    state = manifest(path)
    found = _files(spark, path, state, list(state["shards"]), _parse_datatype_string(schema))
    return found if position else found.drop("__shard", "__pos")


def rewrite(spark: SparkSession, path: str, schema: str, change) -> None:
    """Put ``change`` of all rows in their place; rows keep their shard, shards their name, and rows their order.
    change gets and returns rows with __shard and __pos; shards of which it leaves nothing go."""
    state = manifest(path)
    rows = change(read(spark, path, schema, position=True))
    split = "split" in rows.columns
    width = max(1, min(len(state["shards"]), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.repartition(width, "__shard").sortWithinPartitions("__shard", "__pos")
    made = dealt.select(F.col("__shard").alias("shard"), (F.col("split").cast("string") if split else F.lit("")).alias("split"), _lines(rows, split))
    _save(made, path, state, list(state["shards"]), 1 << 62)


def vacuum(path: str) -> int:
    """Delete files that the manifest doesn't name, left by runs that were cut short; not while one is writing."""
    from pyarrow.fs import FileSelector

    fs, root = _fs(path)
    known = {f"{root}/{f}" for f, _ in manifest(path)["shards"].values()} | {f"{root}/{MANIFEST}"}
    left = [f.path for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.is_file and f.path not in known]
    for f in left:
        fs.delete_file(f)
    return len(left)

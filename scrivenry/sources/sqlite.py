"""A read-only SQLite source, split by ranges of rowid; SQLite reads the wanted columns and applies Spark's filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith

#: Fixed value: what SQLite's declared types become.
TYPES = {"INT": "long", "REA": "double", "FLO": "double", "DOU": "double", "BLO": "binary"}


def connect(path: str):
    """A connection that can't write, to a file nobody writes to."""
    import sqlite3

    c = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
    c.execute("PRAGMA query_only = ON")
    return c


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(f: Filter, types: dict[str, str]) -> tuple[str, list] | None:
    """(SQL, values) that every row passes which Spark's filter keeps; None where there is none.  Text is compared by
    its bytes, as Spark does, whatever the column's collation."""
    if isinstance(f, Not):
        return None
    (name, *rest) = f.attribute
    kind = types.get(name)
    if rest or kind is None:
        return None
    column = quoted(name) + (" COLLATE BINARY" if kind == "string" else "")
    alike = lambda v: isinstance(v, str) if kind == "string" else isinstance(v, (int, float)) and not isinstance(v, bool) and kind in ("long", "bigint", "double")
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{quoted(name)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
    if isinstance(f, In):
        values = [v for v in f.value if v is not None]
        if len(values) > 900 or not all(map(alike, values)):
            return None
        return f"{column} IN ({', '.join('?' * len(values))})", values
    if type(f) in _COMPARED and alike(f.value):
        return f"{column} {_COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, StringStartsWith) and kind == "string":
        return f"substr({quoted(name)}, 1, {len(f.value)}) = ? COLLATE BINARY", [f.value]
    return None


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.types = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.path, self.table = options["path"], options["dbtable"]
        self.parts = int(options.get("numpartitions", 8))
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        """SQLite applies those it can.  Spark applies those on text again, as a column may be text to Spark and of
        another affinity to SQLite."""
        for f in filters:
            made = condition(f, self.types)
            if made is not None:
                self.where.append(made)
            if made is None or self.types[f.attribute[0]] == "string" and made[1]:
                yield f

    def partitions(self):
        import sqlite3

        c = connect(self.path)
        try:
            if c.execute("SELECT type FROM sqlite_master WHERE name = ?", (self.table,)).fetchone() == ("view",):
                return [Range(None, None)]
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a table without rowid
            return [Range(None, None)]
        finally:
            c.close()
        if low is None:
            return [Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(i, min(i + step, high + 1)) for i in range(low, high + 1, step)]

    def statement(self, partition: Range) -> tuple[str, list]:
        where = [*self.where, *([("rowid >= ? AND rowid < ?", [partition.low, partition.high])] if partition.low is not None else [])]
        sql = f"SELECT {', '.join(map(quoted, self.columns)) or '1'} FROM {quoted(self.table)}"
        return sql + (" WHERE " + " AND ".join(w for w, _ in where) if where else ""), [v for _, own in where for v in own]

    def read(self, partition: Range):
        c = connect(self.path)
        rows = c.execute(*self.statement(partition))
        while batch := rows.fetchmany(2000):
            yield from batch
        c.close()


class SqliteSource(DataSource):
    """Options: path (on a folder all executors see), dbtable, numPartitions."""

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        c = connect(self.options["path"])
        info = c.execute(f"PRAGMA table_info('{self.options['dbtable']}')").fetchall()
        c.close()
        return ", ".join(f"`{r[1]}` {TYPES.get((r[2] or '').upper()[:3], 'string')}" for r in info)

    def reader(self, schema):
        return SqliteReader(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 8, columns: list[str] | None = None) -> DataFrame:
    """A table, or only some of its columns: the others are not read.  Comparisons, lists of ids (``isin``) and the
    beginnings of texts in ``where`` are passed on to SQLite."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite").option("path", path).option("dbtable", table).option("numPartitions", partitions)
    if columns is not None:
        c = connect(path)
        kinds = {r[1]: TYPES.get((r[2] or "").upper()[:3], "string") for r in c.execute(f"PRAGMA table_info({quoted(table)})")}
        c.close()
        reader = reader.schema(", ".join(f"`{n}` {kinds[n]}" for n in columns))
    return reader.load()


def tables(path: str) -> dict[str, list[str]]:
    """Tables of a file and their columns."""
    c = connect(path)
    names = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
    found = {n: [r[1] for r in c.execute(f"PRAGMA table_info('{n}')")] for n in names}
    c.close()
    return found


def written(path: str, table: str):
    """For ``mapInArrow`` over one partition: its rows as a table of a new file at ``path``, which takes that name when
    it is complete."""

    def work(batches):
        import os
        import sqlite3
        import uuid

        import pyarrow as pa

        temp, n = f"{path}.{uuid.uuid4().hex}", 0
        os.makedirs(os.path.dirname(path), exist_ok=True)
        c = sqlite3.connect(temp)
        for b in batches:
            if not n:
                kind = lambda t: "REAL" if pa.types.is_floating(t) else "INTEGER" if pa.types.is_integer(t) else "BLOB" if pa.types.is_binary(t) else "TEXT"
                c.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({', '.join(f'{quoted(f.name)} {kind(f.type)}' for f in b.schema)})")
            c.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * b.num_columns)})", zip(*(x.to_pylist() for x in b.columns), strict=True))
            n += b.num_rows
        c.commit()
        c.close()
        os.replace(temp, path)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return work

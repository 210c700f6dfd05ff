"""SQLite tables as a partitioned source: ranges of row ids as partitions, columns and filters handed to the database."""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

_COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local_path(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


def condition(f: Filter) -> tuple[str, list] | None:
    """A filter as SQL with its values, or None where the database may see it otherwise than Spark: other kinds, nested columns, values but whole numbers and text."""
    if len(f.attribute if hasattr(f, "attribute") else ()) != 1:
        return None
    column = quoted(f.attribute[0])

    def plain(x: object) -> bool:
        return isinstance(x, (int, str)) and not isinstance(x, bool)

    if isinstance(f, (IsNull, IsNotNull)):
        return f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
    if isinstance(f, In) and all(map(plain, f.value)):
        return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if type(f) in _COMPARED and plain(f.value):
        return f"{column} {_COMPARED[type(f)]} ?", [f.value]
    return None


@dataclass
class RowRange(InputPartition):
    file: str
    low: int
    high: int


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.table, self.rows, self.batch = options["table"], int(options.get("rowspartition", 100_000)), int(options.get("batch", 10_000))
        self.files = _files(options["path"])
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if (own := condition(f)) is None:
                yield f
            else:
                self.where.append(own)

    def partitions(self) -> Sequence[RowRange]:
        """Ranges of row ids of each file: each of at most `rowspartition` ids, whether rows have them or not."""
        out = []
        for file in self.files:
            with closing(_opened(file)) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            if low is not None:
                n = -(-(high - low + 1) // self.rows)
                step = -(-(high - low + 1) // n)
                out += [RowRange(file, a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
        return out or [RowRange("", 0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        names = ", ".join(quoted(f.name) for f in self.schema.fields)
        text = " AND ".join(["rowid >= ? AND rowid < ?", *[w for w, _ in self.where]])
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        with closing(_opened(part.file)) as db:
            cursor = db.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {text}", [part.low, part.high, *[v for _, values in self.where for v in values]])
            while rows := cursor.fetchmany(self.batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class SqliteSource(DataSource):
    """Format `sqlite`: option path, a file, a folder or a pattern of files that every machine can open, all with the table of option `table`.

    Tables without row ids and views aren't read. Without a schema, columns have
    the types that the first file declares: whole numbers, reals, blobs, else text.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        file = _files(self.options["path"])[0]
        with closing(_opened(file)) as db:
            columns = [(row[1], row[2].upper()) for row in db.execute(f"PRAGMA table_info({quoted(self.options['table'])})")]
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {file}")

        def kind(declared: str) -> T.DataType:
            return T.LongType() if "INT" in declared else T.DoubleType() if any(x in declared for x in ("REAL", "FLOA", "DOUB")) else T.BinaryType() if "BLOB" in declared else T.StringType()

        return T.StructType([T.StructField(name, kind(declared)) for name, declared in columns])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def _files(path: str) -> list[str]:
    own = local_path(path)
    found = sorted(glob.glob(os.path.join(own, "*.sqlite") if os.path.isdir(own) else own))
    if not found:
        raise FileNotFoundError(path)
    return found


def _opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def read_sqlite(spark: SparkSession, path: str, table: str, *, schema: T.StructType | str | None = None, rows: int = 100_000) -> DataFrame:
    """A table of SQLite files with a partition for each `rows` row ids; only the columns and rows asked for leave the database where it can tell."""
    spark.dataSource.register(SqliteSource)
    # What the database filters is Spark's to hand over only with this setting.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite").option("table", table).option("rowsPartition", rows)
    return (reader.schema(schema) if schema else reader).load(path)


def write_sqlite(df: DataFrame, folder: str, table: str, *, files: int = 4) -> DataFrame:
    """Writes df's whole numbers, reals and text to SQLite files in a folder that all machines share, each by a task of its own: (file, rows).

    A task writes beside its file and renames it at the end, so a task that is
    run again leaves one file. df is dealt by its first column's hash.
    """
    own = local_path(folder)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL"}
    declared = ", ".join(f"{quoted(n)} {kinds.get(t, 'TEXT')}" for n, t in df.dtypes)
    marks = ", ".join("?" * len(df.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.makedirs(own, exist_ok=True)
        task = TaskContext.get()
        file = os.path.join(own, f"part-{task.partitionId():05d}.sqlite")
        beside = f"{file}.{task.taskAttemptId()}"
        n = 0
        with closing(sqlite3.connect(beside)) as db:
            db.execute(f"CREATE TABLE {quoted(table)} ({declared})")
            for batch in batches:
                db.executemany(f"INSERT INTO {quoted(table)} VALUES ({marks})", zip(*[c.to_pylist() for c in batch.columns], strict=True))
                n += len(batch)
            db.commit()
        os.replace(beside, file)
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64())], names=["file", "rows"])

    return df.repartition(files, df.columns[0]).mapInArrow(run, "file string, rows bigint")

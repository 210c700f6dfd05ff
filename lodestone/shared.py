"""Tables that cut lineage: written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that an operator asks for: tasks on whole texts hold some of them at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bytes of an Arrow batch to BATCH_BYTES unless it has been set: only how rows are grouped on their way to Python."""
    if spark.conf.getAll.get(_BATCH) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def unused(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores after it as it takes to be no column of the frames (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on one machine (tests), a temporary one is set.

    Without it on a cluster a RuntimeError says so: a machine's own folder would
    lose what other machines write.
    """
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="lodestone-")
        folder = f"file://{_own}"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_made: list[Scratch] = []
_scopes: list[list[Scratch]] = []


def clean() -> None:
    """Drops every table that operators of this process have left, outside of scopes, for results which still read them: call it once those are written."""
    while _made:
        _made.pop().drop()


@contextmanager
def scope() -> Iterator[None]:
    """Tables that operators leave inside the block are dropped at its end, and no others: results made in it are written in it.

    Scopes may stand in each other; a table belongs to the innermost.
    """
    own: list[Scratch] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        while own:
            own.pop().drop()


class Scratch:
    """Tables written for one run of an operator; drop() removes them once the result no longer needs them, clean() those that are left."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        (_scopes[-1] if _scopes else _made).append(self)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """Computes df once; the returned DataFrame reads the written rows."""
        path = f"{self.root}/{tag}"
        self.paths[tag] = path
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, tag: str) -> str:
        """A folder for files that others write, dropped with the tables."""
        self.paths[tag] = f"{self.root}/{tag}"
        return self.paths[tag]

    def drop(self, *tags: str) -> None:
        for tag in tags or list(self.paths):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(tag))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
